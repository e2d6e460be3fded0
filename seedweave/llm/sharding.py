"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a key belongs to the next point
clockwise. A shard takes at most its capacity; keys of a full shard continue
clockwise to the next shard with room. Capacities are ``rows // shards`` or one
more and add up to the number of rows, so counts differ by one at most (law
``rows``), and only keys of overfull shards leave their place on the ring.

Only counts per arc (``shards * vnodes`` numbers, a fixed bound) reach the
driver, which decides how many keys each arc passes on; every row then finds its
shard and slot from its rank on the ring. Ranks are counted inside narrow cells
of the ring (``CELLS`` of them), and a cell with more than ``CELL_ROWS`` rows (many
rows of one key) is dealt into parts by a hash of the row's number, so no window holds
more than a sliver of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedweave.llm.shared import written
from seedweave.operators.common import local_table

RING = 1 << 60            # positions: the first 15 hex digits of an MD5
CELLS = 1 << 16           # windows are cut at these cells, whatever the number of shards
CELL_WIDTH = RING // CELLS
CELL_ROWS = 1 << 17       # rows of a cell that are ranked in one window


def ring_position(key: Column) -> Column:
    """Place on the ring: 60 bits of the MD5 of the key's text form (null: the empty string)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order; ``shards * vnodes`` rows."""
    grid = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        ring_position(F.concat(F.lit("shard "), (F.col("id") % shards).cast("string"), F.lit(" point "),
                               F.floor(F.col("id") / shards).cast("string"))).alias("pos"))
    return sorted((r["pos"], r["shard"]) for r in grid.collect())


def arc_plan(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple]:
    """Rows (arc, lo, hi, shard, slot): ranks lo..hi-1 of the arc go to the shard, from that slot on.

    First every shard takes its own keys in ring order up to its capacity, then
    what is left of an arc walks clockwise to the next shards with room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out, rest = [], []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            out.append((arc, lo, lo + n, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return lo + n

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        lo = take(arc, 0, n, shard)
        if lo < n:
            rest.append((arc, lo, n))
    for arc, lo, hi in rest:
        step = arc
        while lo < hi:
            step = (step + 1) % len(points)
            lo = take(arc, lo, hi, points[step][1])
    return out


def assign_shards(df: DataFrame, key: str, shards: int, vnodes: int = 64, tie: list[str] | None = None,
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``home_shard``, ``shard`` and ``slot`` (0-based, gapless within a shard) to every row of ``df``.

    Rows with equal keys (null keys count as one key) lie at one place of the
    ring and are told apart by ``tie`` columns, in a cell of over ``cell_rows`` rows by
    their number; rows equal in all of them are interchangeable. ``df`` is written once,
    which fixes the numbers. An empty table gives an empty table. Columns of ``df`` are
    kept, helper columns start with ``_ring_``.
    """
    spark = df.sparkSession
    points = ring_points(spark, shards, vnodes)
    at = [p for p, _ in points]
    # For every cell the number of points before it and the points inside: CELLS rows, a fixed bound.
    first = spark.range(CELLS).select(F.col("id").alias("_ring_cell"))
    bounds = local_table(spark, [(p // CELL_WIDTH, p) for p in at], ["cell", "point"], ["long", "long"])
    per_cell = bounds.groupBy("cell").agg(F.sort_array(F.collect_list("point")).alias("_ring_points"))
    before = Window.orderBy("_ring_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_table = first.join(per_cell, first["_ring_cell"] == per_cell["cell"], "left").drop("cell") \
        .withColumn("_ring_points", F.coalesce("_ring_points", F.array().cast("array<bigint>"))) \
        .withColumn("_ring_base", F.coalesce(F.sum(F.size("_ring_points")).over(before), F.lit(0)))

    fixed = written(df.withColumn("_ring_row", F.monotonically_increasing_id()), "ring-rows")
    placed = fixed.withColumn("_ring_pos", ring_position(F.col(key))) \
        .withColumn("_ring_cell", F.floor(F.col("_ring_pos") / CELL_WIDTH).cast("long"))
    placed = placed.join(F.broadcast(cell_table), "_ring_cell")  # CELLS rows
    past = F.size(F.filter("_ring_points", lambda p: p < F.col("_ring_pos")))
    placed = placed.withColumn("_ring_arc", ((F.col("_ring_base") + past) % len(points)).cast("int")) \
        .withColumn("_ring_lap", (F.col("_ring_base") + past >= len(points)).cast("int")) \
        .drop("_ring_points", "_ring_base")

    # Keys past the last point belong to arc 0, after which come the keys before the first point.
    cell = ["_ring_arc", "_ring_lap", "_ring_cell"]
    # Overfull cells: as many of them at most as there are ``cell_rows`` rows.
    over = placed.groupBy(cell).agg(F.count(F.lit(1)).alias("_ring_rows")).where(F.col("_ring_rows") > cell_rows) \
        .select(*cell, F.ceil(F.col("_ring_rows") / cell_rows).alias("_ring_parts"))
    placed = placed.join(over, cell, "left").withColumn("_ring_part", F.when(
        F.col("_ring_parts").isNotNull(), F.pmod(F.xxhash64("_ring_row"), F.col("_ring_parts"))).otherwise(F.lit(0)).cast("long"))
    cell = [*cell, "_ring_part"]
    sizes = placed.groupBy(cell).agg(F.count(F.lit(1)).alias("_ring_rows"))
    by_arc = Window.partitionBy("_ring_arc").orderBy(F.desc("_ring_lap"), "_ring_cell", "_ring_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_ring_off", F.coalesce(F.sum("_ring_rows").over(by_arc), F.lit(0)))
    counts = {r["_ring_arc"]: r["n"] for r in sizes.groupBy("_ring_arc").agg(F.sum("_ring_rows").alias("n")).collect()}
    plan = local_table(spark, arc_plan(points, counts, shards),
                       ["_ring_arc", "_ring_lo", "_ring_hi", "shard", "_ring_slot"],
                       ["int", "long", "long", "int", "long"])
    home = local_table(spark, [(i, s) for i, (_, s) in enumerate(points)], ["_ring_arc", "home_shard"], ["int", "int"])

    in_cell = Window.partitionBy(cell).orderBy("_ring_pos", key, *(tie or []))
    ranked = placed.withColumn("_ring_rn", F.row_number().over(in_cell) - 1) \
        .join(F.broadcast(offsets.drop("_ring_rows")), cell) \
        .withColumn("_ring_rank", F.col("_ring_off") + F.col("_ring_rn"))
    ranked = ranked.join(F.broadcast(home), "_ring_arc")
    p = plan.withColumnRenamed("_ring_arc", "_ring_plan_arc")
    out = ranked.join(F.broadcast(p), (F.col("_ring_arc") == F.col("_ring_plan_arc"))
                      & (F.col("_ring_rank") >= F.col("_ring_lo")) & (F.col("_ring_rank") < F.col("_ring_hi")))
    out = out.withColumn("slot", F.col("_ring_slot") + F.col("_ring_rank") - F.col("_ring_lo"))
    return out.select(*df.columns, "home_shard", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 16; null text: 16), text_crc32, law, shard, slot, grown_shard.

    Text is read once for size and checksum and never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"))
    out = assign_shards(keyed, "doc_id", shards, vnodes, tie=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home_shard")
