"""A Merkle manifest of a dataset, in blocks of leaves that higher-order functions collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.operators.ranks import running

#: Nodes that become one, and levels that one block collapses: a block holds ARITY ** LEVELS = 729 nodes.
ARITY, LEVELS = 3, 6


def field(value: Column) -> Column:
    """A column's part of a leaf: ``-`` for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _up(nodes: Column, arity: int) -> Column:
    """The next level: every run of ``arity`` nodes, the last one may be shorter, becomes its digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * arity + 1, arity), ""), 256))


def _levels(nodes: Column, size: Column, arity: int, levels: int) -> Column:
    """All levels of a block from its nodes up, for a tree of ``size`` nodes at this level: a level is collapsed while the tree, not the block, has several nodes."""

    def step(done: Column, i: Column) -> Column:
        return F.when(size > F.pow(F.lit(float(arity)), i - 1), F.concat(done, F.array(_up(F.element_at(done, -1), arity)))).otherwise(done)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(nodes), step)


def _path(levels: Column, place: Column, arity: int) -> Column:
    """The siblings of the node at ``place`` (from 0) of the lowest level: for each level (left, right), digests joined."""

    def at(level: Column, j: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(arity)), j)).cast("int")
        first = own - own % arity
        return F.struct(F.array_join(F.slice(level, first + 1, own - first), "").alias("left"), F.array_join(F.slice(level, own + 2, first + arity - 1 - own), "").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), at)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, joined, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, block, size, rows, levels): ``nodes`` (tree, nth, size, leaf, row) by blocks of arity ** levels."""
    per = arity**levels
    got = nodes.groupBy("tree", F.expr(f"nth div {per}").alias("block"), "size").agg(F.array_sort(F.collect_list(F.struct("nth", "leaf", "row"))).alias("nodes"))
    got = got.select("tree", "block", "size", F.transform("nodes", lambda n: n["row"]).alias("rows"), F.transform("nodes", lambda n: n["leaf"]).alias("leaves"))
    return written(got.select("tree", "block", "size", "rows", _levels(F.col("leaves"), F.col("size"), arity, levels).alias("levels")))


def tree_blocks(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The blocks of all trees, round by round: the leaves' blocks, the blocks of their roots, and so on until every tree is one block.

    ``nodes`` has tree (a key that isn't null), nth (from 0, without gaps), size (the tree's nodes), leaf and row (whatever is to be kept with a leaf). The largest tree decides the number of
    rounds, each 1 / arity ** levels of the one before; trees of one block stay as they are.
    """
    rounds = []
    while True:
        rounds.append(_blocks(nodes, arity, levels))
        most = rounds[-1].agg(F.max("block")).first()[0]
        if not most:
            return rounds
        up = F.ceil(F.col("size") / arity**levels).cast("long")
        nodes = rounds[-1].select("tree", F.col("block").alias("nth"), up.alias("size"), F.element_at(F.element_at("levels", -1), 1).alias("leaf"), F.lit(0).alias("row"))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    return rounds[-1].select("tree", F.element_at(F.element_at("levels", -1), 1).alias("root"))


def paths(rounds: list[DataFrame], above: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(tree, row, leaf, path, and all other columns of ``above``) of every leaf: its siblings up to the tree's root and then those of ``above`` (tree, path, ...).

    Paths go down from round to round, joined block by block: no row that is joined stands for more than one block, so a tree with any share of all leaves is no hot key.
    """
    also = [c for c in above.columns if c not in ("tree", "path")]
    top = above.withColumn("block", F.lit(0).cast("long")).withColumnRenamed("path", "higher")
    for blocks in reversed(rounds):
        each = F.transform(
            F.sequence(F.lit(0), F.size("rows") - 1),
            lambda i: F.struct(i.alias("place"), F.get("rows", i).alias("row"), F.get(F.get("levels", F.lit(0)), i).alias("leaf"), F.concat(_path(F.col("levels"), i, arity), F.col("higher")).alias("path")),
        )
        # Paths grow with the input: never broadcast.
        out = blocks.join(top.hint("shuffle_hash"), ["tree", "block"]).select("tree", "block", *also, F.explode(each).alias("e"))
        out = out.select("tree", (F.col("block") * arity**levels + F.col("e.place")).alias("nth"), "e.row", "e.leaf", "e.path", *also)
        top = out.select("tree", F.col("nth").alias("block"), F.col("path").alias("higher"), *also)
    return out.drop("nth")


def manifest(df: DataFrame, columns: tuple[str, ...], doc_id: str = "doc_id", source: str = "source", tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, tampered_leaf, subroot, root, path): the place of every row in a tree of sources, each a tree of its rows.

    A leaf is the SHA-256 of ``columns`` in their order (``field``); digests are lowercase hex. In a source, leaves ascend by id; sources ascend by name, null first, bytewise. While there are several nodes, every
    three consecutive ones become the digest of their hex digests (the last run may be shorter, down to one). ``path`` has the siblings of a leaf for each level up to ``root``: ``fold(leaf, path)`` gives the root
    for an untampered leaf. ``tampered`` gives some columns another content: ``tampered_leaf`` is the leaf of that row, null where nothing is tampered with.

    Leaves are placed by ``running`` ranks, so a source of any size is spread over tasks; blocks of ``3 ** levels`` (729) ordered leaves are collapsed natively and their roots again, until a source is one block.
    Null columns are ``-``. Null ids come first; rows of one id go by leaf, and repeated rows are leaves of their own. A null source is a source. No rows: no rows. Further columns are ignored,
    so their names can't clash.
    """
    leaf = digest(*[field(F.col(c)) for c in columns])
    other = digest(*[field((tampered or {}).get(c, F.col(c))) for c in columns]) if tampered else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    leaves = written(df.select(tree.alias("tree"), F.col(doc_id).alias("id"), leaf.alias("leaf"), other.alias("other")))
    placed = running(leaves, [F.col("tree")], [F.col("id"), F.col("leaf")], {"nth": F.lit(1)}, {"size": F.lit(1)})
    rounds = tree_blocks(placed.select("tree", "nth", "size", "leaf", F.struct("id", F.when(F.col("other") != F.col("leaf"), F.col("other")).alias("other")).alias("row")), levels=levels)

    sources = roots(rounds).select(F.col("tree").alias("row"), F.col("root").alias("leaf"))
    sources = running(sources, [], [F.col("row")], {"nth": F.lit(1)}, {"size": F.lit(1)}).withColumn("tree", F.lit(""))
    source_rounds = tree_blocks(sources, levels=levels)
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = paths(source_rounds, roots(source_rounds).withColumn("path", none), levels=levels).select(F.col("row").alias("tree"), "path", F.col("leaf").alias("subroot"), "root")
    out = paths(rounds, above, levels=levels)
    return out.select(F.col("row.id").alias("doc_id"), F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("source"), "leaf", F.col("row.other").alias("tampered_leaf"), "subroot", "root", "path")
