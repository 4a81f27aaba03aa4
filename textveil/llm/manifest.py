"""Merkle manifest of a dataset: one tree for each language, and a tree over their roots.

Every row is a leaf, a digest of its columns; eight neighbours make a node. Nodes carry nested intervals: the ranks of the leaves
that they cover, half open, where leaves are ranked over all trees by (tree, id). A node's children, with their intervals and digests,
stand in its row. Proofs go from the roots down: a node meets its ancestor by a containment join of intervals, in buckets as wide as
the level's nodes, so that no node lies in more than two; what the ancestor's other children cover is the difference of the
intervals within it, and they are the siblings, to the left and to the right. Proofs of upper levels are made once for all below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, id_value, ranked, spread_join, written

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


def told(value: Column) -> Column:
    """A value in a leaf's digest: its bytes' number and its text; ``-`` where it is null."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[told(c) for c in columns.values()]), 256)


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def grown(leaves: DataFrame, most: int, name: str) -> list[DataFrame]:
    """All levels over ``leaves`` (tree, n, lo, hi, digest), where a tree is named by its first rank and has ``n`` leaves, ``most`` at most.

    A level's rows are (tree, n, lo, hi, digest, kids), written; trees of one node grow no further. Each level has an eighth of the rows
    of the one below it, and a group is eight rows, whatever the tree's size.
    """
    levels = [leaves.withColumn("kids", F.array().cast("array<struct<lo:long,hi:long,digest:string>>"))]
    while ARITY ** (len(levels) - 1) < most:
        width = ARITY ** len(levels)
        below = levels[-1].where(F.col("n") > width // ARITY)
        kids = below.groupBy("tree", "n", F.expr(f"(lo - tree) div {width}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
        node = kids.select("tree", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), F.sha2(_joined(F.col("kids")), 256).alias("digest"), "kids")
        levels.append(written(node, f"{name}{len(levels)}"))
    return levels


def _height(n: Column, levels: int) -> Column:
    """The level of the one node at the top of a tree with ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(levels - 1)]).cast("array<long>"), lambda w: w < n))


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, n, digest), one row for each tree."""
    tops = [x.where(_height(F.col("n"), len(levels)) == k).select("tree", "n", "digest") for k, x in enumerate(levels)]
    out = tops[0]
    for x in tops[1:]:
        out = out.union(x)
    return out


def attached(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path``, their siblings level by level, and what ``tops`` (tree, path and more) say of the tree."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in range(len(levels) - 1, -1, -1):
        here = levels[level]
        alone = here.where(_height(F.col("n"), len(levels)) == level).join(tops, "tree")
        if above is not None:
            width = ARITY ** (level + 1)
            up = above.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("kids").alias("__kids"), "path", *more, F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("__bucket"))
            met = here.where(F.col("n") > width // ARITY).withColumn("__bucket", F.expr(f"lo div {width}")).join(up, "__bucket").where("__lo <= lo AND hi <= __hi")
            step = F.struct(_joined(F.filter("__kids", lambda k: k["hi"] <= F.col("lo"))).alias("left"), _joined(F.filter("__kids", lambda k: k["lo"] >= F.col("hi"))).alias("right"))
            below = met.withColumn("path", F.concat(F.array(step).cast(_STEP), "path")).select(*here.columns, "path", *more)
            alone = alone.select(*below.columns).union(below)
        above = alone
    return above.drop("kids")


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def manifest(docs: DataFrame, seen: dict[str, Column] | None = None, tree: str = "lang") -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) of each row of ``docs``, one tree for each value of ``tree``.

    ``seen`` has columns as they were found later, by name: ``folded_root`` is the root that follows from these and from the proof, and
    ``verified`` tells whether it is the manifest's. Leaves go by doc_id, null first, then by digest, so rows that repeat are leaves
    each; trees by value, null first. An empty table has no rows. Columns that are not in COLUMNS are not read. A text is read once,
    by the digest; texts are not moved.
    """
    spark = docs.sparkSession
    first = {c: F.col(f"`{c}`") for c in COLUMNS}
    later = first | (seen or {})
    rows = docs.select(id_key().alias("doc_id"), F.col(tree).alias("tree_value"), leaf(first).alias("leaf"), leaf(later).alias("later"))
    rows = ranked(rows.withColumn("later", F.when(F.col("later") != F.col("leaf"), F.col("later"))), ["tree_value", "doc_id", "leaf"], "leaves")
    # a tree is named by its first rank
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "tree_value"), F.lit("")))
    trees = written(rows.groupBy("key").agg(F.min("rank").alias("tree"), F.count("*").alias("n")), "trees")
    size = trees.agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("trees")).first()
    if not size.trees:
        return spark.createDataFrame([], f"doc_id long, leaf string, subroot string, root string, path {_STEP}, folded_root string, verified boolean")
    leaves = spread_join(rows, trees, "key", "n", size.total)
    leaves = leaves.select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), "doc_id", "later")
    levels = grown(leaves.drop("doc_id", "later"), size.most, "level")
    levels[0] = leaves.withColumn("kids", F.array().cast("array<struct<lo:long,hi:long,digest:string>>"))
    # the trees' roots are the leaves of one more tree, in the order of the values, which is that of the first ranks
    under = ranked(roots(levels).select(F.col("tree").alias("name"), "digest"), ["name"], "subroots")
    over = grown(under.select(F.lit(0).cast("long").alias("tree"), F.lit(size.trees).cast("long").alias("n"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "name"), size.trees, "over")
    root = roots(over).first().digest
    tops = attached(over, spark.range(1).select(F.col("id").alias("tree"), F.array().cast(_STEP).alias("path")))
    tops = written(tops.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "tops")
    got = attached(levels, tops)
    again = folded(F.coalesce("later", "digest"), F.col("path"))
    return got.select(id_value().alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", again.alias("folded_root")).withColumn("verified", F.col("folded_root") == root)
