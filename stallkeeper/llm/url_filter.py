"""URL filters: rules, and a tree of path templates per host, on DataFrame functions only.

Per host, paths are parsed into segments level by level. The children of a node of the tree are compared by the share of
labelled pages that are good:

- A child with fewer than SUPPORT pages, without labels, or whose share doesn't differ from that of its siblings taken
  together (two-proportion z below Z) is generalised to the wildcard *.
- The children that differ, to either side, are put in order of their share, in whole percents; neighbours are merged
  while they don't differ from each other. A branch of several is named *- (fewer good pages than the siblings) or *+
  and a number; one that is alone stays literal.

Merged branches go on as one node, so what lies below them is compared over all of them. The tree goes on for as long as a
node has SUPPORT pages; what lies below a smaller one is /**. How many pages a host or a parent has plays no part. A
template is blocked if the smoothed share of good pages, (good + PRIOR * overall rate) / (labelled + PRIOR), is below
PURITY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.common import join_groups, written

SUPPORT = 5
Z = 1.96
PRIOR = 10
PURITY = 0.5
WILD, LOW, HIGH, REST = "*", "*-", "*+", "**"


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string (host and path) and verdict of the longest fitting rule, else nulls. rules: (host, path, verdict)."""
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in rules]
    ranked = sorted(zip(rules, fits, strict=True), key=lambda x: -len(x[0][0] + x[0][1]))
    pick = lambda value: F.coalesce(F.lit(None).cast("string"), *(F.when(fit, F.lit(value(r))) for r, fit in ranked))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def _differs(good: str, labelled: str, all_good: str, all_labelled: str, z: float) -> Column:
    """Whether a part's share of good pages differs from that of the rest of the whole it belongs to."""
    g, n, gg, nn = (F.col(c) for c in (good, labelled, all_good, all_labelled))
    rate = gg / nn
    score = F.abs(g / n - (gg - g) / (nn - n)) / F.sqrt(rate * (1 - rate) * (1 / n + 1 / (nn - n)))
    return F.when((n > 0) & (nn > n) & (gg > 0) & (gg < nn), score >= z).otherwise(False)


def _labels(children: DataFrame, support: int, z: float) -> DataFrame:
    """node, seg, n, label: what each child of a node is called in templates. children: node, seg, n (rows), pages, good,
    labelled."""
    nodes = written(children.groupBy("node").agg(F.count("*").alias("m"), F.sum("pages").alias("all"), F.sum("good").alias("gg"), F.sum("labelled").alias("nn")), "nodes")
    own = join_groups(children, nodes, ["node"], "m", "inner").drop("m")
    tested = (F.col("all") >= support) & (F.col("pages") >= support) & ~F.startswith("seg", F.lit(WILD))
    less = F.col("good") / F.col("labelled") < (F.col("gg") - F.col("good")) / (F.col("nn") - F.col("labelled"))
    own = written(own.withColumn("side", F.when(tested & _differs("good", "labelled", "gg", "nn", z), F.when(less, LOW).otherwise(HIGH))), "sides")
    own = own.withColumn("bin", F.when(F.col("side").isNotNull(), F.floor(F.col("good") * 100 / F.col("labelled"))))
    bins = own.where("side is not null").groupBy("node", "side", "bin").agg(F.count("*").alias("m"), F.sum("good").alias("sg"), F.sum("labelled").alias("sn"))
    order = Window.partitionBy("node", "side").orderBy("bin")  # 101 rows at most
    bins = bins.withColumn("both_g", F.col("sg") + F.lag("sg").over(order)).withColumn("both_n", F.col("sn") + F.lag("sn").over(order))
    bins = bins.withColumn("cluster", F.sum(_differs("sg", "sn", "both_g", "both_n", z).cast("int")).over(order) + 1).withColumn("size", F.sum("m").over(Window.partitionBy("node", "side", "cluster")))
    bins = written(bins.select("node", "side", "bin", "m", "cluster", "size"), "bins")
    apart = join_groups(own.where("side is not null"), bins, ["node", "side", "bin"], "m", "inner")
    apart = apart.select("node", "seg", "n", F.when(F.col("size") == 1, F.col("seg")).otherwise(F.concat("side", "cluster")).alias("label"))
    return apart.unionByName(own.where("side is null").select("node", "seg", "n", F.when(F.col("all") < support, REST).otherwise(WILD).alias("label")))


def templates(shapes: DataFrame, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """shapes (host, shape, rest: the segments, pages, good, labelled) with a column node, their template. A round a level;
    rounds end when no shape goes on."""
    shapes = written(shapes.withColumn("node", F.col("host")), "tree")
    while True:
        going = shapes.where("size(rest) > 0")
        children = going.groupBy("node", F.get("rest", F.lit(0)).alias("seg")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("pages", "good", "labelled")))
        children = written(children, "children")
        if children.isEmpty():
            return shapes
        named = written(_labels(children, support, z), "labels")
        stepped = join_groups(going.withColumn("seg", F.get("rest", F.lit(0))), named, ["node", "seg"], how="inner")
        rest = F.when(F.col("label") == REST, F.array().cast("array<string>")).otherwise(F.slice("rest", F.lit(2), F.size("rest")))
        stepped = stepped.withColumn("rest", rest).withColumn("node", F.concat("node", F.lit("/"), "label")).drop("seg", "n", "label")
        shapes = written(stepped.unionByName(shapes.where("size(rest) = 0")), "tree")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", purity: float = PURITY, prior: int = PRIOR, support: int = SUPPORT) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict (allow or block), template.

    labels: rows (id, good) for pages of that id, good a boolean; rows with nulls are left out and several of one id all
    count. Null urls and those without :// have an empty host and path, which is a template like others. Repeated rows
    are judged alike and count each; of rules of equal length that fit, the first counts. Urls of any length and depth are
    parsed whole. Other columns are ignored; without any label the overall rate counts as 1, so all is allowed but for
    rules. An empty table gives no rows."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = written(rows.withColumn("shape", F.array_join(parts, "/")), "urls")
    votes = labels.where("id is not null and good is not null").groupBy("id").agg(F.sum(F.col("good").cast("int")).alias("good"), F.count("*").alias("labelled"))
    shapes = rows.join(votes, "id", "left").groupBy("host", "shape").agg(F.count("*").alias("pages"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("labelled", F.lit(0))).alias("labelled"))
    tree = templates(shapes.withColumn("rest", F.filter(F.split("shape", "/"), lambda x: x != "")), support)
    good, labelled = tree.agg(F.sum("good"), F.sum("labelled")).first()
    base = good / labelled if labelled else 1.0
    pure = tree.groupBy("node").agg(F.count("*").alias("n"), F.sum("good").alias("g"), F.sum("labelled").alias("m"))
    pure = written(pure.select("node", "n", F.when((F.col("g") + prior * base) / (F.col("m") + prior) < purity, F.lit("block")).otherwise(F.lit("allow")).alias("learned")), "purity")
    verdicts = written(join_groups(tree.select("host", "shape", "node", "pages"), pure, ["node"], how="inner").select("host", "shape", F.col("pages").alias("n"), "node", "learned"), "verdicts")
    rule, said = by_rules(F.col("host"), F.col("path"), rules)
    found = join_groups(rows, verdicts, ["host", "shape"], how="inner")
    return found.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, "learned").alias("verdict"), F.col("node").alias("template"))
