"""Hard-negative mining by a secondary sort.

Anchors meet all rows in blocks. First each block's best rows of the anchor's label give its
positives; then each block keeps, of the windows below these, the best rows of other labels.
What is kept is packed into keys of anchor, descending score, positive before negative, and
id. repartitionAndSortWithinPartitions puts each anchor's keys in that order into one
task, where an iterator opens a window as it meets a positive, and emits the negatives that
fall into open windows. No task holds an anchor's rows: it remembers a few windows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.llm.common import cut_lineage

#: Production parameters: anchors are the ids that EVERY divides; positives and negatives of
#: each; a negative's score is LOW to HIGH per cent of the positive's.
EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
#: Rows of a shard (about, at most), rows that are worth a shard, and scores held at a time.
SHARD_ROWS, LEAST_ROWS, HELD = 32768, 1024, 1 << 22
#: Components times the scale stay where their floor is a long.
_FAR = float(1 << 62)
_EXACT = 1 << 53
_LONG = (-(1 << 63), (1 << 63) - 1)
_KEY = struct.Struct(">QQQBQ")
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(_id, _label, _v, _dim): the rows that take part, with floor(scale * x) of each component as a long."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), x * F.lit(float(scale))))))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("_id"), F.col("label").cast("long").alias("_label"), v.alias("_v"), whole.alias("_w"), bad.alias("_bad"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull() & ~F.col("_bad"))
        .select("_id", "_label", F.col("_w").alias("_v"), F.size("_w").alias("_dim"))
    )


def mine(
    embeddings: DataFrame, label: Column | None = None, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows are of vec_id, embedding and label; `label` is an expression that replaces the
    label. A score is the integer inner product of floor(256 x). Anchors are the rows whose
    vec_id `every` divides. Its positives are the first `positives` other rows of its label,
    higher scores first, ties by smaller vec_id; for each of them the first `negatives` rows
    of other labels with low * positive <= 100 * negative <= high * positive are returned.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no
    part. An anchor meets the rows of as many components as it has. Wholly repeated rows
    count once; rows that share a vec_id otherwise are rows of their own, but never each
    other's positives or negatives. Scores beyond a long are taken as the long nearest.
    Anchors without positives, and positives without negatives, give no rows, nor does an
    empty table. Other columns are ignored.
    """
    if not 0 <= low < high <= 100:
        raise ValueError("0 <= low < high <= 100 is needed: negatives come after their positive")
    source = embeddings if label is None else embeddings.withColumn("label", label)
    rows = cut_lineage(vectors(source).dropDuplicates(["_id", "_label", "_v"]).withColumn("_tag", F.xxhash64("_label", "_v")))
    anchors = rows.filter(F.pmod("_id", F.lit(every)) == 0)
    count, tasks = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-count // shard_rows), min(tasks, count // LEAST_ROWS))
    met = _meet(rows, anchors.withColumn("_best", F.array().cast("array<long>")), shards, _Positives(positives), "_id long, _tag long, _score long, _other long")
    # thin lists of the shards: what ranks a row among an anchor's positives is its score and id
    order = Window.partitionBy("_id", "_tag").orderBy(F.desc("_score"), "_other")
    firsts = cut_lineage(met.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= positives))
    best = firsts.groupBy("_id", "_tag").agg(F.sort_array(F.collect_set("_score"), False).alias("_best"))
    opened = anchors.join(best, ["_id", "_tag"])
    below = _meet(rows, opened, shards, _Below(negatives, low, high), "_id long, _tag long, _score long, _other long")
    keys = firsts.select("_id", "_tag", "_score", "_other", F.lit(True).alias("_positive")).unionByName(below.withColumn("_positive", F.lit(False)))
    packed = keys.mapInArrow(_pack, "key binary").rdd.map(lambda r: (bytes(r[0]), None))
    in_order = packed.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:16]))
    found = in_order.mapPartitions(lambda pairs: windows((key for key, _ in pairs), negatives, low, high))
    return rows.sparkSession.createDataFrame(found, FOUND, verifySchema=False)


def pack(anchor: int, tag: int, score: int, positive: bool, other: int) -> bytes:
    """A key whose bytes sort by anchor, falling score, positives first, and rising id."""
    bias = 1 << 63
    return _KEY.pack(anchor + bias, tag + bias, bias - 1 - score, not positive, other + bias)


def windows(keys: Iterator[bytes], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of FOUND from keys in order.

    A window is a positive and the count of its negatives so far; it is closed when that is
    reached or scores have fallen below its low end.
    """
    bias, at, open_ = 1 << 63, None, []
    for key in keys:
        anchor, tag, score, negative, other = _KEY.unpack(key)
        if (anchor, tag) != at:
            at, open_ = (anchor, tag), []
        score = bias - 1 - score
        if not negative:
            open_.append([other - bias, score, 0])
            continue
        for window in open_:
            positive_id, positive, count = window
            if low * positive <= 100 * score <= high * positive:
                window[2] = count + 1
                yield anchor - bias, positive_id, count + 1, other - bias, positive, score
        open_ = [w for w in open_ if w[2] < negatives and low * w[1] <= 100 * score]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("_id", "_tag", "_score", "_positive", "_other")]
        yield pa.RecordBatch.from_arrays([pa.array([pack(*row) for row in zip(*columns, strict=True)], pa.binary())], ["key"])


def _meet(rows: DataFrame, anchors: DataFrame, shards: int, keep: Callable, schema: str) -> DataFrame:
    """`keep`'s rows of each block of anchors and shard of rows; all anchors meet all shards."""
    dealt = rows.select(
        "_id", "_tag", "_label", "_v", "_dim", F.array().cast("array<long>").alias("_best"), F.lit(False).alias("_asked"),
        F.pmod(F.xxhash64("_id", "_tag"), F.lit(shards)).cast("int").alias("_shard"),
    )
    asked = anchors.select(
        "_id", "_tag", "_label", "_v", "_dim", "_best", F.lit(True).alias("_asked"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard")
    )
    tasks = max(min(shards, 20_000), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    streams = dealt.unionByName(asked).repartition(tasks, "_dim", "_shard").sortWithinPartitions("_dim", "_shard", "_asked", "_id")
    return streams.mapInArrow(lambda batches: _streamed(batches, keep), schema)


def _streamed(batches: Iterator[pa.RecordBatch], keep: Callable) -> Iterator[pa.RecordBatch]:
    """A shard's rows are gathered; then its anchors go past in blocks."""
    shard, held, whole = None, [], None
    for batch in batches:
        dims, shards, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_dim", "_shard", "_asked"))
        edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(asked.astype(int)) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(dims)], strict=True):
            if a == b:
                continue
            if shard != (dims[a], shards[a]):
                shard, held, whole = (dims[a], shards[a]), [], None
            if not asked[a]:
                held.append(_Block(batch.slice(a, b - a)))
                continue
            if whole is None and held:
                whole, held = _Block.joined(held), []
            if whole is not None:
                step = max(1, HELD // len(whole.ids))
                for i in range(a, b, step):
                    yield from keep(_Block(batch.slice(i, min(step, b - i))), whole)


class _Block:
    """Ids, tags, labels and vectors (a matrix of longs) of rows of as many components."""

    def __init__(self, batch: pa.RecordBatch | None):
        if batch is not None:
            self.ids, self.tags, self.labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_tag", "_label"))
            self.vectors = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            self.best = batch.column("_best")

    @classmethod
    def joined(cls, blocks: list[_Block]) -> _Block:
        out = cls(None)
        for name in ("ids", "tags", "labels", "vectors"):
            setattr(out, name, np.concatenate([getattr(b, name) for b in blocks]))
        out.floats = out.vectors.astype(float).T.copy()
        return out

    def far(self) -> np.ndarray:
        """The greatest size of a component of each row."""
        return np.abs(self.vectors).max(1, initial=0).astype(float)

    def scores(self, rows: _Block) -> np.ndarray:
        """Exact inner products with `rows`: by floats where all sums are whole floats, else by Python's integers."""
        found = self.vectors.astype(float) @ rows.floats
        far = np.outer(self.far(), rows.far()) * self.vectors.shape[1] >= _EXACT
        found[far] = 0
        found = found.astype(np.int64)
        for i in np.flatnonzero(far.any(1)):
            j = np.flatnonzero(far[i])
            exact = rows.vectors[j].astype(object) @ self.vectors[i].astype(object)
            found[i, j] = np.clip(exact, *_LONG).astype(np.int64)
        return found


def _firsts(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k allowed entries of each row that come first: falling scores, then rising ids."""
    if scores.shape[1] > k:
        # each row's k-th best allowed score; what is below it cannot come first
        held = np.where(allowed, scores, _LONG[0])
        held.partition(scores.shape[1] - k, axis=1)
        allowed = allowed & (scores >= held[:, [scores.shape[1] - k]])
    row, column = np.nonzero(allowed)
    order = np.lexsort((ids[column], -1 - scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _rows(anchors: _Block, rows: _Block, scores: np.ndarray, row: np.ndarray, column: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in (anchors.ids[row], anchors.tags[row], scores[row, column], rows.ids[column])]
    return pa.RecordBatch.from_arrays(arrays, ["_id", "_tag", "_score", "_other"])


class _Positives:
    """A shard's first rows of each anchor's own label."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, anchors: _Block, rows: _Block) -> Iterator[pa.RecordBatch]:
        scores = anchors.scores(rows)
        allowed = (anchors.labels[:, None] == rows.labels[None]) & (anchors.ids[:, None] != rows.ids[None])
        yield _rows(anchors, rows, scores, *_firsts(scores, allowed, rows.ids, self.k))


class _Below:
    """A shard's first rows of other labels in each window below an anchor's positives."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def __call__(self, anchors: _Block, rows: _Block) -> Iterator[pa.RecordBatch]:
        scores = anchors.scores(rows)
        other = (anchors.labels[:, None] != rows.labels[None]) & (anchors.ids[:, None] != rows.ids[None])
        tops = [t or [] for t in anchors.best.to_pylist()]
        kept = np.zeros(scores.shape, bool)
        for i in range(max(map(len, tops), default=0)):
            # ceil and floor by Python's integers: no product overflows, no window is left out
            ends = [(-(-self.low * t[i] // 100), self.high * t[i] // 100) if i < len(t) else (1, 0) for t in tops]
            ends = np.array([e if e[0] <= e[1] else (1, 0) for e in ends], np.int64)
            inside = other & (scores >= ends[:, :1]) & (scores <= ends[:, 1:])
            kept[_firsts(scores, inside, rows.ids, self.k)] = True
        yield _rows(anchors, rows, scores, *np.nonzero(kept))
