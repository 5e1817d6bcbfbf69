"""Merkle manifest of a dataset, by checkpoint and recompute.

Rows are the leaves of one ordered tree for each source; the roots of these
trees are the leaves of a tree above them. Only every ``STRIDE``-th level is
written. Between two written levels lie aligned subtrees of ``RUN**STRIDE``
nodes; proof extraction makes the missing nodes of each subtree again from its
written ones, takes the siblings of every child from them and drops them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import stored
from cataloom.operators.sequence import number_within

#: Consecutive nodes under one node, and levels from one written level to the next.
RUN, STRIDE = 3, 4
SPAN = RUN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**instead: Column) -> Column:
    """SHA-256 of a row's ``FIELDS``, each as its length in UTF-8 bytes, a colon
    and its value, or ``-`` where null; ``instead`` stands for fields."""
    said = []
    for name in FIELDS:
        value = instead.get(name, F.col(name)).cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*said), 256)


@dataclass
class Manifest:
    """Written tables. ``levels[k]`` has the nodes of level ``k * STRIDE`` of
    every source's tree that reaches it: (tree, pos, depth, digest), on level 0
    also ``row`` (doc_id, source and what was carried). ``above`` is the same of
    the tree over ``sources`` (tree, source, n_rows, depth, subroot), whose place there is
    the number of their tree. ``root`` is None for an empty table."""
    levels: list[DataFrame]
    above: list[DataFrame]
    sources: DataFrame
    root: str | None


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: the least d with RUN**d >= n."""
    powers = F.array(*[F.lit(RUN**k).cast("long") for k in range(39)])
    return F.size(F.filter(powers, lambda p: p < n)).cast("long")


def _above(nodes: Column) -> Column:
    """The level over ``nodes``: a hash for each run of them."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * RUN + 1, RUN), ""), 256))


def _subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """The aligned subtrees over ``nodes`` of a written level: (tree, node: their
    number, depth, children by place, s0 to s<STRIDE>: digests of each level, made
    again from the children; a tree that ends on the way keeps its root)."""
    node = F.floor(F.col("pos") / SPAN).cast("long").alias("node")
    held = [c for c in ("pos", "digest", "row") if c in nodes.columns]
    out = (nodes.where(F.col("depth") > level).groupBy("tree", "depth", node)
           .agg(F.sort_array(F.collect_list(F.struct(*held))).alias("children"))
           .withColumn("s0", F.col("children.digest")))
    for k in range(STRIDE):
        under = F.col(f"s{k}")
        out = out.withColumn(f"s{k + 1}", F.when(F.col("depth") > level + k, _above(under)).otherwise(under))
    return out


def _levels(nodes: DataFrame) -> list[DataFrame]:
    levels = [nodes]
    top = nodes.agg(F.max("depth")).first()[0] or 0
    for level in range(0, top, STRIDE):
        risen = _subtrees(levels[-1].drop("row"), level).select("tree", F.col("node").alias("pos"), "depth", F.get(f"s{STRIDE}", F.lit(0)).alias("digest"))
        levels.append(stored(risen))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    roots = [nodes.where(F.col("depth") <= k * STRIDE).select("tree", "digest") for k, nodes in enumerate(levels)]
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return out


def manifest(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text).

    A source's rows ascend by doc_id (null first; rows that repeat a doc_id by
    digest, and equal ones are equal leaves); a null source is a source, the
    first one, and the others follow by their UTF-8 bytes. While a level has
    several nodes, each RUN consecutive ones (the last run may be shorter)
    become one. ``carried`` columns are kept with their leaf. A text of any
    length is hashed whole; empty texts differ from null ones. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              leaf_digest().alias("digest"), *[c.alias(name) for name, c in carried.items()]))
    numbered = stored(number_within(rows, [], ["source", "doc_id", "digest"], "at"))
    per = numbered.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    trees = stored(number_within(per, [], ["source"], "tree").select(
        "source", (F.col("tree") - 1).alias("tree"), "first", "n_rows", _depth(F.col("n_rows")).alias("depth")))
    own = trees.select(F.col("source").alias("t_source"), "tree", "first", "depth")
    leaves = stored(numbered.join(own, F.col("source").eqNullSafe(F.col("t_source")))
                    .select("tree", (F.col("at") - F.col("first")).alias("pos"), "depth", "digest", F.struct("doc_id", "source", *carried).alias("row")))
    levels = _levels(leaves)
    sources = stored(trees.join(_roots(levels).withColumnRenamed("digest", "subroot"), "tree").select("tree", "source", "n_rows", "depth", "subroot"))
    n = sources.count()
    if not n:
        return Manifest(levels, [], sources, None)
    zero = F.lit(0).cast("long")
    above = _levels(sources.select(zero.alias("tree"), F.col("tree").alias("pos"), _depth(F.lit(n).cast("long")).alias("depth"),
                                   F.col("subroot").alias("digest"), F.struct(F.col("tree").alias("own")).alias("row")))
    return Manifest(levels, above, sources, _roots(above).first()["digest"])


def _other_than(place: Column):
    return lambda _, i: i != place


def _siblings(level: int) -> Column:
    """(place, siblings) of a child within its runs in the levels of its
    subtree, from the lowest: siblings from left to right as one text."""
    out = []
    for k in range(STRIDE):
        at = F.floor(F.col("j") / RUN**k).cast("int")
        run = F.slice(F.col(f"s{k}"), F.floor(at / RUN).cast("int") * RUN + 1, RUN)
        place = at % RUN
        others = F.array_join(F.filter(run, _other_than(place)), "")
        out.append(F.when(F.col("depth") > level + k, F.struct(place.alias("place"), others.alias("siblings"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _paths(levels: list[DataFrame], roots: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(tree, row, digest, path, the other columns of ``roots``) of the leaves. ``roots`` has the path above
    each root (tree, path). Of ``only`` (tree, pos: leaves), no other subtree is opened."""
    more = [c for c in roots.columns if c not in ("tree", "path")]
    upper = None
    for k in range(len(levels) - 1, -1, -1):
        level, nodes = k * STRIDE, levels[k]
        if only is not None:
            under = SPAN**k
            node = only.select("tree", F.floor(F.col("pos") / (under * SPAN)).cast("long").alias("o_node")).distinct().withColumnRenamed("tree", "o_tree")
            leaf = only.select(F.col("tree").alias("o_tree"), F.floor(F.col("pos") / under).cast("long").alias("o_pos")).distinct()
            nodes = nodes.join(node, (F.col("tree") == F.col("o_tree")) & (F.floor(F.col("pos") / SPAN) == F.col("o_node")), "left_semi")
        ends = nodes.where(F.col("depth") <= level).join(roots, "tree").select("tree", "pos", *[c for c in ("row", "digest") if c in nodes.columns], "path", *more)
        if upper is not None:
            over = upper.select(F.col("tree").alias("u_tree"), F.col("pos").alias("u_pos"), F.col("path").alias("u_path"), *more)
            opened = (_subtrees(nodes, level).join(over, (F.col("tree") == F.col("u_tree")) & (F.col("node") == F.col("u_pos")))
                      .select("*", F.posexplode("children").alias("j", "child"))
                      .select("tree", "child.*", F.concat(_siblings(level), F.col("u_path")).alias("path"), *more))
            ends = ends.unionByName(opened)
        if only is not None:
            ends = ends.join(leaf, (F.col("tree") == F.col("o_tree")) & (F.col("pos") == F.col("o_pos")), "left_semi")
        upper = ends
    return upper


def proofs(made: Manifest, only: DataFrame | None = None) -> DataFrame:
    """One row for each leaf, or each leaf of the doc_ids in ``only``: row
    (doc_id, source, what was carried), leaf, subroot, root, path (place in the
    run and siblings as one text for each level, up to ``root``). Null doc_ids
    are no ids that can be asked for."""
    if made.root is None:
        row = made.levels[0].select("row", F.col("digest").alias("leaf"))
        path = F.expr("cast(array() as array<struct<place: int, siblings: string>>)")
        return row.select("row", "leaf", F.lit("").alias("subroot"), F.lit("").alias("root"), path.alias("path"))
    start = F.expr("cast(array() as array<struct<place: int, siblings: string>>)")
    top = made.sources.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), start.alias("path"))
    roots = stored(_paths(made.above, top).select(F.col("row.own").alias("tree"), "path", F.col("digest").alias("subroot")))
    asked = None
    if only is not None:
        ids = only.select(F.col("doc_id").cast("long").alias("o_id")).distinct()
        asked = stored(made.levels[0].join(ids, F.col("row.doc_id") == F.col("o_id"), "left_semi").select("tree", "pos"))
    return _paths(made.levels, roots, asked).select("row", F.col("digest").alias("leaf"), "subroot", F.lit(made.root).alias("root"), "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    width = 64

    def step(node, x):
        left = x["place"] * width
        return F.sha2(F.concat(F.substring(x["siblings"], F.lit(1), left), node, F.substring(x["siblings"], left + 1, F.length(x["siblings"]))), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda x: x["siblings"]), ""), 256)
