"""Merkle manifest of a data set: few stored levels, the nodes between them recomputed.

Every row is a leaf; the leaves of one tree (say, a language) ascend by id, every two
consecutive nodes become one, a last single node becomes the hash of itself. The
subroots, ordered by the tree's name, are the leaves of the crown, whose top is the
root of the data set. Only every ``EVERY``-th level is written. A proof regenerates
the levels in between for one aligned subtree (at most ``2 ** EVERY`` stored nodes)
from its lowest stored level, emits the siblings of every node of that level, and keeps
nothing else; the siblings above come from the subtree's own top, which is a node
of the next stored level. So the proofs go down the stored levels, and each leaf's
siblings exist only in the task that needs them.

All of it is DataFrame functions; a task holds one subtree at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedweave.llm.shared import written

EVERY = 6          # levels from one stored level to the next: subtrees of 64 nodes


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(*[part(c) for c in fields])


def tree_name(value: Column) -> Column:
    """A name without nulls that sorts like ``value``, null first, else bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def depth(n: Column) -> Column:
    """Levels above the leaves of a tree with ``n`` leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def level_up(nodes: Column) -> Column:
    """The next level of an array of digests."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(2)), lambda i: digest(
        F.element_at(nodes, i), F.coalesce(F.try_element_at(nodes, i + 1), F.lit(""))))


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (with ``tree``) with the place ``pos`` in their tree and its size ``n``, written.

    One range partitioning over all trees: a tree of any size is spread over many tasks.
    Rows equal in every column of the order are told apart by their place in the input,
    so that their number doesn't matter either.
    """
    salted = leaves.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["tree", *order, "_salt"]
    rows = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt") \
        .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "leaves")
    runs = rows.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(tree).alias("n"))
    return rows.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")) \
        .drop("_part", "_row", "_shift")


def subtrees(nodes: DataFrame, level: int, every: int, *carried: str) -> DataFrame:
    """One row per aligned subtree: tree, pos (of its top), n, steps (levels inside), nodes (in order)."""
    grouped = nodes.groupBy("tree", F.shiftright("pos", every).alias("pos")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("nodes"))
    return grouped.withColumn("steps", F.greatest(F.lit(0), F.least(F.lit(every), depth(F.col("n")) - level * every)))


@dataclass(frozen=True)
class Forest:
    """Trees by their stored levels; ``levels[k]`` has the nodes ``k * every`` levels up, the last one every tree's top."""

    levels: list[DataFrame]
    every: int

    def tops(self) -> DataFrame:
        return self.levels[-1]


def grow(leaves: DataFrame, every: int = EVERY) -> Forest:
    """The stored levels over ``leaves`` (tree, pos, n, digest and any more); one job per stored level."""
    size = leaves.agg(F.max("n")).first()[0] or 1
    rounds = max(1, -(-(size - 1).bit_length() // every))
    levels = [leaves]
    for k in range(rounds):
        groups = subtrees(levels[k], k, every)
        start = F.transform("nodes", lambda x: x["digest"])
        top = F.when(F.col("steps") > 0, F.aggregate(F.sequence(F.lit(1), F.col("steps")), start,
                                                     lambda nodes, _: level_up(nodes))).otherwise(start)
        levels.append(written(groups.select("tree", "pos", "n", F.element_at(top, 1).alias("digest")), "nodes"))
    return Forest(levels, every)


def descend(forest: Forest, paths: DataFrame, carried: str) -> DataFrame:
    """(tree, pos, digest, ``carried`` of the leaf, up, top) of every leaf.

    ``paths`` has (tree, pos, up, top) of the tops; ``up`` lists what a node meets on its way
    to the root: one (sibling or null, left) per level. ``top`` is handed down as it is.
    """
    every = forest.every
    for k in reversed(range(len(forest.levels) - 1)):
        more = [carried] if k == 0 else []
        groups = subtrees(forest.levels[k], k, every, *more).join(paths, ["tree", "pos"])
        start = F.transform("nodes", lambda x: x["digest"])
        inside = F.when(F.col("steps") > 1, F.aggregate(
            F.sequence(F.lit(2), F.col("steps")), F.array(start),
            lambda levels, _: F.concat(levels, F.array(level_up(F.element_at(levels, -1)))))).otherwise(F.array(start))
        groups = groups.withColumn("inside", inside)

        def met(x: Column, j: int) -> Column:
            at = F.shiftright(x["pos"], j).cast("int") % F.lit(1 << (every - j))
            beside = F.try_element_at(F.element_at("inside", j + 1), at.bitwiseXOR(F.lit(1)) + 1)
            return F.when(F.col("steps") > j, F.struct(beside.alias("sibling"), (at % 2 == 1).alias("left")))

        nodes = F.transform("nodes", lambda x: F.struct(
            x["pos"].alias("pos"), x["digest"].alias("digest"), *[x[c].alias(c) for c in more],
            F.concat(F.filter(F.array(*[met(x, j) for j in range(every)]), lambda s: s.isNotNull()),
                     F.col("up")).alias("up")))
        paths = groups.select("tree", "top", F.inline(nodes))
        if k:
            paths = paths.drop("digest")
    return paths


def fold(leaf: Column, up: Column) -> Column:
    """The root that follows from a leaf and the (sibling, left) pairs on its way up."""
    return F.aggregate(up, leaf, lambda node, s: F.when(s["sibling"].isNull(), digest(node))
                       .when(s["left"], digest(s["sibling"], node)).otherwise(digest(node, s["sibling"])))


@dataclass(frozen=True)
class Manifest:
    """The stored levels of all trees and of the crown above their subroots."""

    trees: Forest
    crown: Forest

    def root(self) -> str | None:
        """The data set's root; None of an empty one."""
        top = self.crown.tops().first()
        return top and top["digest"]

    def proofs(self) -> DataFrame:
        """One row per leaf: row (its carried columns), leaf, subroot, root, up (siblings from the leaf to the root)."""
        none = F.array().cast("array<struct<sibling:string,left:boolean>>")
        crown = self.crown.tops().select("tree", "pos", none.alias("up"), F.col("digest").alias("top"))
        subroots = descend(self.crown, crown, "row")
        paths = subroots.select(F.col("row.tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "up",
                                F.struct(F.col("top").alias("root"), F.col("digest").alias("subroot")).alias("top"))
        return descend(self.trees, paths, "row").select(
            "row", F.col("digest").alias("leaf"), "top.subroot", "top.root", "up")


def write_manifest(leaves: DataFrame, *order: str, every: int = EVERY) -> Manifest:
    """Manifest of ``leaves``: tree, digest, the columns of ``order`` (in which leaves ascend) and a struct ``row``, carried along."""
    trees = grow(placed(leaves, *order), every)
    subroots = trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest",
                                   F.struct(F.col("tree").alias("tree")).alias("row"))
    return Manifest(trees, grow(placed(subroots, "name"), every))


def verified_documents(docs: DataFrame, now: dict[str, Column] | None = None, every: int = EVERY) -> DataFrame:
    """Manifest of ``docs`` by language, and the check of every document as it is ``now``.

    ``now`` maps columns to what they hold when the document is checked (default: unchanged).
    Returns doc_id, leaf, subroot, root, proof_sha256 (of the siblings in order), folded_root
    and verified per row. Nulls in any column are values of their own; a null ``lang`` is the
    first tree, a null ``doc_id`` comes first in its tree. Rows with one id ascend by their
    digest; equal rows are leaves of their own, next to each other. Empty and very long texts
    are hashed like any other; more columns don't count. An empty table gives no rows.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    now = now or {}
    leaf = leaf_digest(*[F.col(c) for c in fields])
    found = leaf_digest(*[now.get(c, F.col(c)) for c in fields])
    leaves = docs.select(tree_name(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"), leaf.alias("digest"),
                         found.alias("found"))
    # The document's digest is stored again only where it differs.
    leaves = leaves.select("tree", "id", "digest", F.struct(
        F.col("id").alias("doc_id"), F.when(F.col("found") != F.col("digest"), F.col("found")).alias("found")).alias("row"))
    proofs = write_manifest(leaves, "id", "digest", every=every).proofs()
    out = proofs.select(
        "row.doc_id", "leaf", "subroot", "root",
        digest(F.array_join(F.transform("up", lambda s: s["sibling"]), "")).alias("proof_sha256"),
        fold(F.coalesce("row.found", "leaf"), F.col("up")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def one_more_char(every: int = 7) -> dict[str, Column]:
    """Documents tampered with: one more in ``n_chars`` where ``every`` divides the CRC-32 of the decimal id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return {"n_chars": F.when(chosen, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))}
