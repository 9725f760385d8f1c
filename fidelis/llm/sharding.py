"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: start at an
offset and step by a skip, both from a hash of the shard's name. Shards take turns
claiming their next free slot until the table is full. A row goes to the shard that holds
slot hash(key) mod table size. Adding or removing a shard moves few rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters: the table has over 100 slots for each shard, so that shards'
#: shares differ by about one part in a hundred at most.
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
TABLE_SIZE = 4099


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard number in each slot. Its cost depends on the parameters, never on the data.

    `size` must be prime (every skip then visits all slots) and at least len(shards).
    """
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"table size {size} is not prime")
    if not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and no more than slots")
    offsets = [_hash(f"offset:{s}") % size for s in shards]
    skips = [_hash(f"skip:{s}") % (size - 1) + 1 for s in shards]
    turn, owner, filled = [0] * len(shards), [-1] * size, 0
    while True:
        for i in range(len(shards)):
            slot = (offsets[i] + turn[i] * skips[i]) % size
            while owner[slot] >= 0:
                turn[i] += 1
                slot = (offsets[i] + turn[i] * skips[i]) % size
            owner[slot], turn[i], filled = i, turn[i] + 1, filled + 1
            if filled == size:
                return owner


def assign_shards(
    df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """Rows (key, slot, shard) for every row of `df`, whatever else it carries.

    Repeated keys get the same shard; a null key counts as the empty string. An empty table
    gives no rows. The table (`size` short entries, a parameter) is broadcast and looked up
    once a row; no rows are shuffled, so hot keys cost nothing here.
    """
    spark = df.sparkSession
    owners = ",".join(shards[i] for i in fill_table(shards, size))
    lookup = spark.range(1).select(
        F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")
    )
    digest = F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")
    rows = df.select(F.col(key).alias("_key")).withColumn("slot", slot)
    return rows.join(F.broadcast(lookup), "slot", "left").select(F.col("_key").alias(key), "slot", "shard")


def oracle(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    """The same placement in DuckDB SQL, which fills the table by its own recursion."""
    names = ", ".join(f"('{s}', {i})" for i, s in enumerate(shards))
    n = len(shards)
    return f"""
WITH RECURSIVE shards(name, i) AS (VALUES {names}),
prefs AS (
  SELECT i, name, list_transform(range({size}), lambda j: (o + j * s) % {size}) AS p FROM (
    SELECT i, name,
      ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {size} AS o,
      ('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {size - 1} + 1 AS s
    FROM shards)
),
walk(step, slot, taken) AS (
  SELECT -1, -1::BIGINT, repeat('0', {size})
  UNION ALL
  SELECT step, slot, substr(taken, 1, slot::BIGINT) || '1' || substr(taken, slot::BIGINT + 2) FROM (
    SELECT w.step + 1 AS step, w.taken,
      list_filter(p.p, lambda x: substr(w.taken, x::BIGINT + 1, 1) = '0')[1] AS slot
    FROM walk w JOIN prefs p ON p.i = (w.step + 1) % {n}
    WHERE w.step + 1 < {size})
),
filled AS (SELECT w.slot, s.name AS shard FROM walk w JOIN shards s ON s.i = w.step % {n} WHERE w.step >= 0),
docs AS (
  SELECT doc_id,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot
  FROM documents
)
SELECT doc_id, docs.slot::INTEGER AS slot, shard FROM docs JOIN filled USING (slot)
"""
