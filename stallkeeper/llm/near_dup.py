"""Near-duplicate detection with bottom-k sketches from one hash function.

How a link is found:

1. A text's shingles are hashed with one 64-bit hash; the k smallest hashes are its sketch. Texts with equal sets
   form one class, of which only one representative goes on.
2. Inverted lists over the retained values. A pair of similarity 0.8 shares over OVERLAP of its sketches (5 standard
   errors), so it shares some of each sketch's rarest values, by document frequency; with the rest it is likely to share
   most of these. Small sets are listed under each rare value, others under each run of RUN consecutive values with a
   rare one, which texts that merely share frequent shingles hardly ever have in common (a pair of similarity 0.8 has no
   such run in common with a chance of about 1e-7; sets from LARGE to SMALL are listed under both, so pairs across the
   bounds meet). A list under single values would hold a third of all texts for a frequent shingle.
3. Each list has a pivot, its most central text. Pairs of pivot and member whose union-sketch estimate leaves a link
   possible (7 standard errors) are verified on full sets; connected components follow. This is linear in a group's size.
4. What a pivot left apart is compared in blocks with all texts of the pivot's group: the union-sketch estimate
   filters, exact Jaccard verifies. A block passes on only links that join components, so rows stay linear here too.

Nothing is capped. Full sets are compared as sets of 64-bit shingle hashes. The estimate loses a link of similarity 0.80
with a chance of 1.8e-10 for sets far larger than the sketch, less for smaller ones, so the lists' 1e-7 is what counts;
the tests plant pairs between 0.80 and 0.82 of several sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.common import join_groups, small_batches, unused, written

SKETCH = 64
OVERLAP = 0.55
RUN = 3
SMALL, LARGE = 25, 16  # sets below SMALL are listed under values, those of LARGE and more under runs
MARGIN = 0.35  # by which an estimate may fall short: 7 standard errors at SKETCH values
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # texts on either side of a block comparison, and their shingles, about
WANTED_BITS = 20  # 2 to so many buckets of ids at most are broadcast, to leave out most texts before a shuffle
PAIRS = 256  # of one pivot that are verified together; a pivot of more is dealt into parts


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer words, of the whole sequence."""
    found = text.lower().split()  # of bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    n = len(h) - width + 1
    mixed = np.full(n, width, np.uint64)
    for j in range(width):
        mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, second, sketch = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                own = shingle_hashes(text or b"", words)
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                n.append(len(own))
                first.append((digest >> 64) - (1 << 63))
                second.append((digest & (1 << 64) - 1) - (1 << 63))
                sketch.append((own[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64))  # signed, in the same order
            at = np.concatenate([[0], np.cumsum([len(x) for x in sketch])]).astype(np.int32)
            values = pa.array(np.concatenate(sketch) if sketch else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(at), values)], ["id", "n", "sig1", "sig2", "sketch"])

    return run


def features(docs: DataFrame, words: int) -> DataFrame:
    """id, n (set size), sig1 and sig2 (128 bits of the set), sketch, of a table with id and text."""
    return small_batches(docs).select("id", "text").mapInArrow(_features(words), "id long, n long, sig1 long, sig2 long, sketch array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those similar on full sets. a's text is sent once for each part of its pairs, of about PAIRS,
    and stands before them in its partition, through which texts stream one by one."""
    sizes = written(pairs.groupBy("a").agg(F.count("*").alias("n")), "sizes")
    dealt = join_groups(pairs.select("a", "b"), sizes, ["a"], how="inner").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIRS)).cast("int").alias("salt"))
    b = dealt.join(texts, dealt.b == texts.id).select("a", "salt", "b", "text")
    a = dealt.select("a", "salt").distinct().join(texts, F.col("a") == texts.id).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found = []
            for x, salt, y, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if key != (x, salt):
                    key, own = (x, salt), []
                other = shingle_hashes(text or b"", words)
                if y is None:
                    own.append(other)
                elif any(similar(s, other, percent) for s in own):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return a.unionByName(b).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable over links (a, b): neighbours' smallest label, then pointer jumping,
    until nothing changes. Rounds are written tables; nothing but a count comes to the driver."""
    both = written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("comp").alias("above"))
        following = written(hooked.join(up, "via").select("node", "was", F.least("via", "above").alias("comp")), "labels")
        labels = following.select("node", "comp")
        if following.where("was != comp").isEmpty():
            return labels


def _estimate(a: Column, b: Column, percent: int) -> Column:
    """Whether the union-sketch estimate of two sketches leaves a similarity of percent possible."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) >= F.size(union) * (percent / 100 - MARGIN)


def _sized(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _block(asks: list[tuple], members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between asking and member texts (id, component, set) that join components."""
    comp: dict[int, int] = {}

    def find(x: int) -> int:
        while comp.setdefault(x, x) != x:
            comp[x] = x = comp[comp[x]]
        return x

    sketches = [[r[2][:SKETCH] for r in side] for side in (asks, members)]
    values = [np.concatenate(side) for side in sketches]
    shared = np.intersect1d(*values)
    if not len(shared):
        return []
    grids, sizes = [], []
    for side, v in zip(sketches, values, strict=True):
        size = np.array([len(x) for x in side])
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[at] == v
        grid = np.zeros((len(side), len(shared)), np.float32)
        grid[np.repeat(np.arange(len(side)), size)[hit], at[hit]] = 1
        grids.append(grid)
        sizes.append(size)
    comps, ns = [np.array([r[1] for r in side]) for side in (asks, members)], [np.array([len(r[2]) for r in side]) for side in (asks, members)]
    least = percent / 100 - MARGIN
    overlap = grids[0] @ grids[1].T
    enough = overlap >= least * np.minimum(sizes[0][:, None], sizes[1][None, :])
    enough &= (comps[0][:, None] != comps[1][None, :]) & (100 * np.minimum(ns[0][:, None], ns[1][None, :]) >= percent * np.maximum(ns[0][:, None], ns[1][None, :]))
    i, j = np.nonzero(enough)
    out = []
    for k in np.argsort(-overlap[i, j], kind="stable"):  # the likeliest links first: they spare others
        (x, comp_x, a), (y, comp_y, b) = asks[i[k]], members[j[k]]
        if find(comp_x) != find(comp_y):
            union = np.union1d(a[:SKETCH], b[:SKETCH])[:SKETCH]
            if np.isin(union, np.intersect1d(a[:SKETCH], b[:SKETCH], assume_unique=True), assume_unique=True).sum() >= least * len(union) and similar(a, b, percent):
                comp[find(comp_x)] = find(comp_y)
                out.append((x, y))
    return out


def _blocks(words: int, percent: int):
    """Over rows sorted by block: a block's rows (of bounded size) are gathered and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def links() -> list[tuple[int, int]]:
            return _block(*sides, percent) if all(sides) else []

        for batch in batches:
            found = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("pivot", "size", "i", "j", "asks", "id", "comp")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            for *now, asks, x, comp, text in rows:
                if now != key:
                    found += links()
                    key, sides = now, ([], [])
                sides[not asks].append((x, comp, shingle_hashes(text or b"", words)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = links()
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _left_apart(stars: DataFrame, labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within a pivot's group, pivots left out: their pairs are verified."""
    members = written(stars.join(labels, stars.b == labels.node, "left").select("a", F.col("b").alias("id"), "n", F.coalesce("comp", "b").alias("comp")), "members")
    groups = members.groupBy("a", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("a").agg(F.sum("c").alias("m"), F.sum("s").alias("shingles"), F.max(F.struct("c", "comp", "s")).alias("main"))
    parts = lambda count, shingles: F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    groups = groups.where("m > main.c").select(F.col("a").alias("pivot"), F.col("main.comp").alias("main"), parts(F.col("m"), F.col("shingles")).alias("parts"), parts(F.col("m") - F.col("main.c"), F.col("shingles") - F.col("main.s")).alias("ask_parts"))
    rows = members.join(groups, members.a == groups.pivot)
    rows = rows.withColumn("size", F.when(F.col("parts") > 1, F.floor(F.ln("n") / float(np.log(100 / percent)))).otherwise(0).cast("int"))  # similar sets stand at most 1 apart
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    part = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    keys = ["pivot", "size", "i", "j"]
    out = [*keys, "asks", "id", "comp"]
    m = rows.withColumn("asks", F.lit(False)).withColumn("i", part("parts")).withColumn("j", spread("ask_parts")).select(out)
    q = rows.where("comp != main").withColumn("asks", F.lit(True)).withColumn("j", part("ask_parts")).withColumn("i", spread("parts"))
    near = F.when(F.col("parts") > 1, F.array(*(F.col("size") + d for d in (-1, 0, 1)))).otherwise(F.array("size"))
    q = q.withColumn("size", F.explode(near)).select(out)
    tasks = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return m.unionByName(q).join(texts, "id").select(*out, "text").repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_blocks(words, percent), "a long, b long").distinct()


def _keys() -> tuple[Column, Column]:
    """Of vals (a text's values that other texts have too, as structs df, value, pos, rarest first): its lists."""
    kept = F.least("n", F.lit(SKETCH)).cast("int")
    rare = kept - F.ceil(kept * OVERLAP).cast("int") + 1 - (kept - F.size("vals"))  # values that no other text has come first
    marked = F.array_sort(F.transform("vals", lambda v, i: F.struct(v["pos"].alias("pos"), v["value"].alias("value"), (i < rare).alias("rare"))))
    alone = F.when(F.col("n") < SMALL, F.transform(F.filter("marked", lambda v: v["rare"]), lambda v: v["value"]))
    at = lambda i, k: F.get(F.col("marked"), i + k)
    run = lambda i: (at(i, RUN - 1)["pos"] - at(i, 0)["pos"] == RUN - 1) & F.exists(F.slice("marked", i + 1, RUN), lambda v: v["rare"])
    starts = F.filter(F.sequence(F.lit(0), F.size("marked") - RUN), run)
    runs = F.when((F.col("n") >= LARGE) & (F.size("marked") >= RUN), F.transform(starts, lambda i: F.xxhash64(F.lit(RUN), *(at(i, k)["value"] for k in range(RUN)))))
    none = F.array().cast("array<bigint>")
    return marked, F.concat(F.coalesce(alone, none), F.coalesce(runs, none))


def classes_and_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per text features; classes of equal sets (rep, n, sketch and signature); labels of representatives that have links."""
    own = written(features(docs, words), "features")
    classes = written(own.where("n > 0 and id is not null").groupBy("sig1", "sig2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    posts = classes.select("rep", "n", F.posexplode("sketch").alias("pos", "value"))
    shared = posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = posts.join(shared, "value").groupBy("rep").agg(F.first("n").alias("n"), F.sum("df").alias("central"), F.sort_array(F.collect_list(F.struct("df", "value", "pos"))).alias("vals"))  # SKETCH values at most
    marked, keys = _keys()
    index = written(ranked.withColumn("marked", marked).select("rep", "n", "central", F.explode(keys).alias("key")), "index")
    pivots = index.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("r"))).alias("p"), F.count("*").alias("m")).where("m > 1").select("key", (-F.col("p.r")).alias("a"))
    stars = written(index.join(pivots, "key").where("a != rep").select("a", F.col("rep").alias("b"), "n").distinct(), "stars")
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    near = stars.select("a", "b").join(side("b"), "b").join(side("a"), "a").where(_sized(F.col("n_a"), F.col("n_b"), percent)).where(_estimate(F.col("s_a"), F.col("s_b"), percent))
    near = written(near.select("a", "b"), "near")
    wanted = written(stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct(), "wanted")
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 << WANTED_BITS)).alias("bucket")
    rough = docs.select("id", "text", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi")  # at most 2 ** WANTED_BITS numbers
    texts = written(rough.join(wanted, "id", "left_semi").select("id", "text"), "texts")
    links = written(verify(near, texts, words, percent), "verified")
    more = written(_left_apart(stars, components(links), texts, words, percent), "joined")
    return own, classes, components(links.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable over links, itself included) and
    kept (whether the row is its component's smallest id). Two texts are linked if 100 * |intersection| is at least
    percent * |union| of their sets of word shingles (percent: 80 or more).

    Null and empty texts, and those without words, have n_shingles 0, are linked with nothing and kept. Rows without an
    id are kept, with a null component. Rows that repeat an id are one node with all their texts. Other columns are
    ignored."""
    if percent < 80:
        raise ValueError("the sketches are sized for a similarity of 80 percent or more")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own, classes, labels = classes_and_links(docs, words, percent)
    comp = classes.select("sig1", "sig2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("sig1", "sig2", F.coalesce("comp", "rep").alias("comp"))
    component: Column = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return own.select("id", "n", "sig1", "sig2").join(comp, ["sig1", "sig2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that near_duplicates() doesn't keep. Rows without an id, and null and
    empty texts, stay; so do rows that repeat the id of a kept one. An empty table stays empty."""
    name = unused("__gone", docs)
    gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias(name))
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
