"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source of weight w (a share of all slots) has blocks of equally many rows. Block j may
not start before slot floor(j / w) and must end by slot ceil((j + 1) / w). In every slot
the released block with the earliest deadline goes next; as the weights sum to one slot in
each slot, every deadline holds, and a source is never a whole block ahead or behind.

Weights are numbers of slots in a period, so the schedule repeats: it is made once for one
period, on the driver, from parameters alone, and a block's slot follows from its number.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Production parameters. Rows in a block; slots in a period at least, and for each source;
#: leading hex digits of the order hash that split a source into cells which are ranked apart.
BLOCK_ROWS, PERIOD, SLOTS_PER_SOURCE, CELL_DIGITS = 16, 1000, 4, 3


def target_slots(sizes: dict[str, float], period: int = PERIOD, power: float = 0.5) -> dict[str, int]:
    """Slots of each source in a period: in proportion to size ** power, one at least.

    Largest remainders get the slots that rounding leaves; ties go to the smaller name. The
    period grows with the number of sources, to SLOTS_PER_SOURCE slots for each.
    """
    period = max(period, SLOTS_PER_SOURCE * len(sizes))
    if not sizes:
        return {}
    total = sum(v**power for v in sizes.values())
    exact = {s: (period - len(sizes)) * v**power / total for s, v in sizes.items()}
    slots = {s: 1 + int(x) for s, x in exact.items()}
    left = period - sum(slots.values())
    for s in sorted(sizes, key=lambda s: (-round(exact[s] - int(exact[s]), 9), s))[:left]:
        slots[s] += 1
    return slots


def edf_period(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period: earliest deadline first among released blocks."""
    period, out = sum(slots.values()), []
    waiting, ready = [(0, s, 0) for s in slots], []
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * period // slots[s]), s, block))
        _, s, block = heapq.heappop(ready)
        out.append((s, block, t))
        if block + 1 < slots[s]:
            heapq.heappush(waiting, ((block + 1) * period // slots[s], s, block + 1))
    return out


def _ranked(docs: DataFrame, payload: list[Column], cell_digits: int) -> DataFrame:
    """Adds _pos, a row's 0-based place in its source in the order of md5(doc_id).

    A source is split into 16 ** cell_digits cells by the leading digits of the hash. Rows
    are ranked within their cell and the sizes of earlier cells are added, so no task holds
    a whole source.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        *payload,
        F.col("doc_id").alias("_d"),
        F.coalesce("source", F.lit("")).alias("_source"),
        order.alias("_order"),
        F.substring(order, 1, cell_digits).alias("_cell"),
    )
    earlier = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy("_source", "_cell")
        .agg(F.count("*").alias("_n"))
        .select("_source", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_source", "_cell").orderBy("_order", "_d")
    return rows.withColumn("_rn", F.row_number().over(within)).join(cells, ["_source", "_cell"]).withColumn(
        "_pos", F.col("_before") + F.col("_rn") - 1
    )


def _scheduled(docs: DataFrame, payload: list[Column], weights: dict[str, int] | None, block_rows: int, cell_digits: int):
    if weights is None:
        counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("n"))
        # one row a source: the schedule, and so what the driver holds, is that of the sources alone
        weights = target_slots({r["s"]: r["n"] for r in counts.collect()})
    period = sum(weights.values())
    plan = edf_period(weights)
    spark = docs.sparkSession
    schedule = spark.range(1).select(
        F.explode(F.from_json(F.lit(_as_json(plan)), "array<struct<s:string,j:long,t:long>>")).alias("x")
    ).select(F.col("x.s").alias("_source"), F.col("x.j").alias("_within"), F.col("x.t").alias("_slot"))
    shares = spark.range(1).select(
        F.explode(F.from_json(F.lit(_as_json([(s, n, 0) for s, n in weights.items()])), "array<struct<s:string,j:long,t:long>>")).alias("x")
    ).select(F.col("x.s").alias("_source"), F.col("x.j").alias("_slots"))
    return (
        _ranked(docs, payload, cell_digits)
        .join(shares, "_source", "left")
        .withColumn("_slots", F.coalesce("_slots", F.raise_error(F.concat(F.lit("no weight for source "), "_source")).cast("long")))
        .withColumn("_block", F.floor(F.col("_pos") / block_rows))
        .withColumn("_within", F.pmod("_block", "_slots"))
        .join(schedule, ["_source", "_within"])
        .withColumn("_slot", F.floor(F.col("_block") / F.col("_slots")) * period + F.col("_slot"))
    )


def _as_json(rows: list[tuple]) -> str:
    return json.dumps([{"s": s, "j": j, "t": t} for s, j, t in rows])


def mix_plan(
    docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, cell_digits: int = CELL_DIGITS
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, source_pos, block, slot.

    `weights` are slots in a period for each source, by default by target_slots over the
    sources' row counts. Rows of a source are taken in the order of md5(doc_id), ties by
    doc_id; rows that share a doc_id are alike in the plan (texts are not read), and those
    of one source are ranked in one task. A null source counts as the source ''. No row is dropped: slots of a source that has run out stay empty, and the
    others go on by their weights. A source without a weight is an error when its rows are met.
    An empty table gives no rows; other columns are ignored.
    """
    return _scheduled(docs, [], weights, block_rows, cell_digits).select(
        F.col("_d").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_pos").alias("source_pos"),
        F.col("_block").alias("block"),
        F.col("_slot").alias("slot"),
    )


def placed(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, cell_digits: int = CELL_DIGITS) -> DataFrame:
    """All rows of `docs` with all their columns and their mix_plan() slot and source_pos, in the order of these."""
    rows = _scheduled(docs, [F.struct("*").alias("_row")], weights, block_rows, cell_digits)
    return rows.select("_row.*", F.col("_slot").alias("slot"), F.col("_pos").alias("source_pos")).sort("slot", "source_pos")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, cell_digits: int = CELL_DIGITS) -> DataFrame:
    """All rows of `docs` with all their columns, in slot order (range-partitioned by slot)."""
    placed = _scheduled(docs, [F.struct("*").alias("_row")], weights, block_rows, cell_digits)
    return placed.select("_row", "_slot", "_pos").sort("_slot", "_pos").select("_row.*")


def oracle(block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> str:
    """mix_plan() with default weights in DuckDB SQL, which makes its own schedule."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) - 1 AS source_pos FROM d),
sizes AS (SELECT source, count(*) AS n FROM d GROUP BY source),
exact AS (
  SELECT source, ({period} - count(*) OVER ()) * sqrt(n) / sum(sqrt(n)) OVER () AS x FROM sizes),
remainders AS (
  SELECT source, 1 + floor(x)::BIGINT AS whole,
    row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS r FROM exact),
slots AS (
  SELECT source, whole + CASE WHEN r <= {period} - (SELECT sum(whole) FROM remainders) THEN 1 ELSE 0 END AS k
  FROM remainders),
sched(t, source, j, done) AS (
  SELECT -1, NULL::VARCHAR, NULL::BIGINT, (SELECT map_from_entries(list((source, 0::BIGINT))) FROM slots)
  UNION ALL
  SELECT t, s, c, map_from_entries(list_transform(map_entries(done), lambda e: (e.key, e.value + CASE WHEN e.key = s THEN 1 ELSE 0 END)))
  FROM (
    SELECT w.t + 1 AS t, w.done, arg_min(s.source, (ceil((w.done[s.source] + 1) * {period} / s.k)::BIGINT, s.source)) AS s,
      arg_min(w.done[s.source], (ceil((w.done[s.source] + 1) * {period} / s.k)::BIGINT, s.source)) AS c
    FROM sched w, slots s
    WHERE w.t + 1 < {period} AND w.done[s.source] < s.k AND (w.done[s.source] * {period}) // s.k <= w.t + 1
    GROUP BY w.t, w.done)
)
SELECT r.doc_id, r.source, r.source_pos, r.source_pos // {block_rows} AS block,
  ((r.source_pos // {block_rows}) // k.k) * {period} + p.t AS slot
FROM ranked r JOIN slots k USING (source)
JOIN sched p ON p.source = r.source AND p.j = (r.source_pos // {block_rows}) % k.k
"""
