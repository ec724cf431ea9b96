"""Line dedup with a log-template tree, on DataFrame functions only.

A line's place in the tree is fixed by its number of tokens, then by its first LEADING tokens with runs of digits
masked. In a leaf that recurs across documents, each token position keeps its commonest token if most of the leaf's
lines have it and is a wildcard else; lines that agree with SIMILAR of the leaf's tokens follow the leaf's template, all
others are templates of their own (digits masked). A template found in MIN_DOCS different documents is boilerplate: its
first line stays, the others are dropped.

Exact copies of a whole document count as one document, so groups of copies are left to near-duplicate detection.

A passage that recurs inside longer lines is no line of its own: dedup_passages() finds it by clauses, and dedup() does
both. Rows of a hot leaf, template, clause or window are joined to what is known of it by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.common import join_groups, unused, written

LEADING = 3
MIN_DOCS = 3
CONSTANT = 0.5  # share of a leaf's lines that have the token of a constant position
SIMILAR = 0.7  # share of a line's tokens behind the leading ones that are those of the template
FILTER_BITS = 20  # 2 to so many buckets of leaves at most are broadcast, to leave out most lines before a shuffle


def _masked(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "<*>")


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line that isn't blank: doc, print (of the whole text), line_no, raw, tokens, leaf, line (of the masked line)."""
    rows = docs.select("doc", F.xxhash64("text").alias("print"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw")).withColumn("raw", F.trim("raw")).where("raw != ''")
    tokens = F.length("raw") - F.length(F.replace("raw", F.lit(" "), F.lit(""))) + 1
    return rows.select("doc", "print", "line_no", "raw", tokens.alias("tokens"), F.xxhash64(tokens, _masked(F.substring_index("raw", " ", LEADING))).alias("leaf"), F.xxhash64(tokens, _masked(F.col("raw"))).alias("line"))


def _bucket() -> Column:
    return F.pmod("leaf", F.lit(1 << FILTER_BITS)).cast("int")


def _near(rows: DataFrame, keys: DataFrame, bucket: Column) -> DataFrame:
    """Most of the rows whose key isn't among keys left out before a shuffle, by 2 ** FILTER_BITS integers at most."""
    return rows.withColumn("bucket", bucket).join(F.broadcast(keys.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")


def _recurring(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    return rows.select(key, "print").distinct().groupBy(key).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _templates(lines: DataFrame, docs: DataFrame, min_docs: int) -> DataFrame:
    """leaf, line, n (lines) and template of the lines in recurring leaves."""
    leaves = written(_recurring(lines, "leaf", min_docs).select("leaf"), "leaves")
    texts = _near(_lines(docs).select("leaf", "line", "tokens", "raw"), leaves, _bucket())
    counts = texts.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"), F.first(_masked(F.col("raw"))).alias("masked"))
    counts = written(counts.join(leaves, "leaf", "left_semi"), "lines")  # different lines, no copies
    behind = F.slice(F.split("masked", " "), F.lit(LEADING + 1), F.greatest(F.col("tokens") - LEADING, F.lit(0)))
    mixed = written(counts.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("kinds > 1"), "mixed")
    parsed = join_groups(counts.where(F.col("tokens") > LEADING), mixed, ["leaf"], "kinds", "inner").select("leaf", "line", "n", "total", behind.alias("rest"))
    tokens = parsed.select("leaf", "n", "total", F.posexplode("rest").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    common = tokens.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("top"), F.first("total").alias("total"))
    field = F.when(F.col("top.n") > F.col("total") * CONSTANT, F.col("top.token"))  # null: a wildcard
    shape = common.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", field.alias("token")))), lambda x: x["token"]).alias("shape"))
    shape = written(shape.join(mixed.select("leaf", "kinds"), "leaf"), "shapes")
    agrees = F.aggregate(F.zip_with("rest", "shape", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    follows = join_groups(written(parsed.select("leaf", "line", "rest"), "parsed"), shape, ["leaf"], "kinds", "inner").where(agrees >= F.size("rest") * SIMILAR).select("leaf", "line", F.lit(True).alias("follows"))
    return counts.select("leaf", "line", "n").join(follows, ["leaf", "line"], "left").select("leaf", "line", "n", F.when(F.col("follows"), F.xxhash64("leaf", F.lit("template"))).otherwise(F.xxhash64("leaf", "line")).alias("template"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, print and drop (line numbers from 0, a set) of the documents that lose lines."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    lines = written(_lines(docs).drop("raw", "tokens"), "lines")
    known = written(_templates(lines, docs, min_docs), "templates")
    templated = written(join_groups(lines, known, ["leaf", "line"], how="inner").select("doc", "print", "line_no", "template"), "templated")
    first = templated.groupBy("template").agg(F.min(F.struct("doc", "line_no", "print")).alias("first"), F.count("*").alias("n"))
    again = written(_recurring(templated, "template", min_docs).join(first, "template"), "recurring")
    gone = join_groups(templated, again, ["template"], how="inner").where(~F.struct("doc", "line_no", "print").eqNullSafe(F.col("first")))
    return gone.groupBy("doc", "print").agg(F.collect_set("line_no").alias("drop"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with text_col rid of repeated lines, and n_lines and n_dropped.

    A recurring template's first line by id and line number stays. Null texts stay null, with 0 lines; empty and blank
    lines are never dropped; a text of dropped lines only becomes empty. Lines of any length are parsed whole. Rows that
    repeat id and text are one document, and so treated alike; a null id comes first in order. Extra columns are kept,
    save n_lines and n_dropped; an empty table stays empty."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, text_print, drop = (unused(c, docs) for c in ("__doc", "__print", "__drop"))
    gone = dropped_lines(docs, min_docs, id_col, text_col).select(F.col("doc").alias(doc), F.col("print").alias(text_print), F.col("drop").alias(drop))
    joined = docs.select(*kept).join(gone, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(text_print)), "left")
    lines = F.split(text_col, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in kept), n_lines.alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))


# Passages inside longer lines or over several lines

PASSAGE = 35  # words in whole clauses that a window must exceed: of a passage of over 50 words, up to 15 may lie in clauses cut at its ends
PASSAGE_DOCS = 2  # so long a passage isn't in two texts by chance
ANCHOR = 6  # words of a clause by which texts that share passages are found
ANCHORED = 16  # words in recurring clauses of ANCHOR words that a passage must have
APART = 6  # clauses between such clauses, of one passage
#: Ends of clauses; a line break is one too.
ENDS = r"\n|[.!?,;:…] |[。！？，]"
_CUT, _ESCAPE = "\ue000", "\ue001"  # characters for private use; those of a text itself are escaped


def _parts(text: str | Column) -> Column:
    """A text's clauses, with what ends them. Joined and unescaped they are the text."""
    own = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "a")), F.lit(_CUT), F.lit(_ESCAPE + "b"))
    return F.split(F.regexp_replace(own, f"({ENDS})", "$1" + _CUT), _CUT)


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE + "b"), F.lit(_CUT)), F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))


def _clauses(docs: DataFrame, least: int = 1) -> DataFrame:
    """A row per clause of least words or more: doc, print, size (words of the text), at (clause number), words, leaf (of
    the clause, digits masked)."""
    bare = F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    size = (F.octet_length("text") - F.octet_length(bare) + 1).cast("long")
    texts = docs.select("doc", F.xxhash64("text").alias("print"), size.alias("size"), _parts(_masked(F.col("text"))).alias("parts"))  # masked once a text
    rows = texts.select("doc", "print", "size", F.posexplode_outer("parts").alias("at", "raw")).withColumn("raw", F.trim(F.replace("raw", F.lit("\n"), F.lit("")))).where("raw != ''")
    words = (F.octet_length("raw") - F.octet_length(F.replace("raw", F.lit(" "), F.lit(""))) + 1).cast("long")
    return rows.withColumn("words", words).where(F.col("words") >= least).select("doc", "print", "size", "at", "words", F.xxhash64("raw").alias("leaf"))


def _sharing(docs: DataFrame) -> DataFrame:
    """doc and print of the texts that may share a passage: ANCHORED words in clauses of ANCHOR words or more that recur,
    near each other. The same clauses recur in all texts that share a passage, so all of these are found."""
    anchors = written(_clauses(docs, ANCHOR).drop("size"), "anchors")
    hot = anchors.groupBy("leaf").agg(F.min("print").alias("low"), F.max("print").alias("high"), F.count("*").alias("n")).where("low != high")
    hot = written(hot.select("leaf", "n"), "met")
    met = join_groups(_near(anchors, hot, _bucket()), hot, ["leaf"], how="inner")
    order = Window.partitionBy("doc", "print").orderBy("at")
    met = met.withColumn("run", F.sum((F.col("at") - F.lag("at", 1, 0).over(order) > APART + 1).cast("int")).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return met.groupBy("doc", "print", "run").agg(F.sum("words").alias("words")).where(F.col("words") >= ANCHORED).select("doc", "print").distinct()


def _copies(spans: DataFrame, clauses: DataFrame, min_docs: int) -> DataFrame:
    """print and other: pairs of texts of which the passages that no third text has make up half of either text or more."""
    cells = spans.where((F.col("n_docs") < min_docs) & (F.col("print") != F.col("other")))
    cells = cells.select("print", "other", "size", "other_size", F.explode(F.sequence("at", "to")).alias("cell")).distinct()
    long = clauses.select("print", F.col("at").alias("cell"), "words").distinct()
    both = cells.join(long, ["print", "cell"]).groupBy("print", "other").agg(F.sum("words").alias("shared"), F.max(F.greatest("size", "other_size")).alias("larger"))
    return both.where(F.col("shared") * 2 >= F.col("larger")).select("print", "other")


def dropped_clauses(docs: DataFrame, min_docs: int = PASSAGE_DOCS, words: int = PASSAGE) -> DataFrame:
    """Of docs (doc, text): doc, print and drop (clause numbers from 0, a set) of those that lose clauses.

    A passage consists of clauses that each recur, so only runs of these are looked at. From each clause of a run forth
    and back, the fewest that exceed words are a window; together the windows in a passage cover all of it.

    Exact copies have the same windows, so only the copy with the smallest id is looked at. What it keeps as a window's
    first place, the other copies lose."""
    sharing = written(_sharing(docs), "sharing")
    texts = written(sharing.groupBy("print").agg(F.min(F.struct("doc"))["doc"].alias("doc"), F.count("*").alias("n")), "texts")
    bucket = lambda text_print: F.pmod(F.xxhash64("doc", text_print), F.lit(1 << FILTER_BITS)).cast("int")
    near = F.broadcast(texts.select(bucket("print").alias("bucket")).distinct())  # at most 2 ** FILTER_BITS integers
    rough = docs.withColumn("bucket", bucket(F.xxhash64("text"))).join(near, "bucket", "left_semi")
    docs = written(rough.join(texts, rough.doc.eqNullSafe(texts.doc) & (F.xxhash64("text") == texts.print), "left_semi").drop("bucket"), "shared")
    clauses = _clauses(docs)
    hot = written(_recurring(clauses, "leaf", min_docs), "clauses")
    rough = written(_near(clauses, hot, _bucket()), "rough")
    found = join_groups(rough, hot, ["leaf"], "n_docs", "inner").drop("n_docs").distinct()
    run = found.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("print").orderBy("at")))
    one = Window.partitionBy("print", "run")
    run = run.withColumn("upto", F.sum("words").over(one.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("words"))
    run = written(run.withColumn("all", F.sum("words").over(one)).where(F.col("all") > words).drop("all"), "runs")

    def windows(frame):
        of = lambda c: c.over(frame)
        made = run.select("doc", "print", "size", of(F.min("at")).alias("at"), of(F.max("at")).alias("to"), of(F.sum("words")).alias("words"), of(F.collect_list("leaf")).alias("leaves"))
        return made.where(F.col("words") > words).select("doc", "print", "size", "at", "to", F.xxhash64("leaves").alias("window"))

    units = written(windows(one.orderBy("before").rangeBetween(0, words)).union(windows(one.orderBy("upto").rangeBetween(-words, 0))).distinct(), "windows")
    first = units.groupBy("window").agg(F.min(F.struct("doc", "at", "print", "to", "size")).alias("first"), F.count("*").alias("n"))
    again = written(_recurring(units, "window", min_docs).join(first, "window"), "repeated")
    gone = join_groups(units, again, ["window"], how="inner")
    own = (F.col("print") == F.col("first.print")) & (F.col("at") <= F.col("first.to"))  # the first one, or over it
    spans = written(gone.select("print", "size", "n_docs", own.alias("own"), F.col("first.print").alias("other"), F.col("first.size").alias("other_size"), "at", "to"), "spans")
    copies = _copies(spans, run, MIN_DOCS).withColumn("copy", F.lit(True))
    spans = spans.join(copies, ["print", "other"], "left").where((F.col("n_docs") >= MIN_DOCS) | F.col("copy").isNull())
    spans = spans.select("print", "own", F.explode(F.sequence("at", "to")).alias("cell"))
    drops = spans.groupBy("print").agg(F.collect_set("cell").alias("of_copies"), F.collect_set(F.when(~F.col("own"), F.col("cell"))).alias("of_first"))
    drops = written(texts.withColumnRenamed("doc", "least").join(drops, "print"), "drops")
    drop = F.when(F.col("doc").eqNullSafe(F.col("least")), F.col("of_first")).otherwise(F.col("of_copies"))
    return join_groups(sharing, drops, ["print"], how="inner").select("doc", "print", drop.alias("drop")).where(F.size("drop") > 0)


def dedup_passages(docs: DataFrame, min_docs: int = PASSAGE_DOCS, words: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with text_col rid of passages of more than words words, in whole clauses, that
    recur (digits masked) in min_docs different texts, whatever stands before or behind them. Two texts that are half or
    more the same, by passages that no third text has, keep these: near-duplicate detection is for such pairs.

    The first occurrence by id and place stays. What stays is unchanged; a line break stays where a dropped clause ended
    a line. Null texts stay null."""
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    doc, text_print, drop, split = (unused(c, docs) for c in ("__doc", "__print", "__drop", "__parts"))
    gone = dropped_clauses(own, min_docs, words).select(F.col("doc").alias(doc), F.col("print").alias(text_print), F.col("drop").alias(drop))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(text_print)), "left")
    joined = joined.withColumn(split, F.when(F.col(drop).isNotNull(), _parts(text_col)))
    parts = F.col(split)
    ends = lambda x: F.endswith(x, F.lit("\n"))
    inside = lambda i: (i > 0) & ~ends(F.get(parts, i - 1))
    kept = F.transform(parts, lambda x, i: F.when(~F.array_contains(drop, i), x).when(ends(x) & inside(i), "\n").otherwise(""))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(_unescaped(F.array_join(kept, "")))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup_lines(), then dedup_passages() on what it leaves: all columns of docs, n_lines and n_dropped (lines)."""
    return dedup_passages(written(dedup_lines(docs, id_col=id_col, text_col=text_col), "lines"), id_col=id_col, text_col=text_col)
