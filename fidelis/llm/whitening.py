"""Embedding whitening with MLlib's distributed block matrices.

Entries become integers, so counts and sums are exact. Centred rows get consecutive indices
and become an IndexedRowMatrix, cut into blocks of rows. Its transpose times itself, summed
over parts of the rows side by side, is the scatter matrix, whose size is that of one vector
squared; it is decomposed on the driver. A second product with the whitening matrix projects all
rows, and is joined with their ids by index. Rows stay in the JVM throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import cut_lineage

#: Production parameters: components returned, scale and shift of entries, rows of a block,
#: blocks that a task of a product takes (about).
COMPONENTS, SCALE, SHIFT, BLOCK_ROWS, TASK_BLOCKS = 32, 64, 1_000_000, 1024, 16
#: Scaled entries stay within this: sums over 10^6 rows of such are longs.
_FAR = float(1 << 42)
#: Components with less than this share of the first one's variance have none.
_LEAST = 1e-13
WHITENED = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def entries(embeddings: DataFrame) -> DataFrame:
    """(vec_id, _x): the rows that take part, with floor(64 c) + 1000000 of each entry c as a long."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), c * F.lit(float(SCALE))))) + F.lit(SHIFT))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("_v"), scaled.alias("_x"), bad.alias("_bad"))
    return kept.filter(F.col("_v").isNotNull() & ~F.col("_bad")).select("vec_id", "_x")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component.

    Components are unit eigenvectors of the covariance of x = floor(64 c) + 1000000 (divisor n),
    by falling eigenvalue e; whitened is (x - mean) on the component over sqrt(e), explained
    is e over the trace, deviation the exact sum over entries of (n x - S)^2. identity_error is
    the largest entry, in size, of the covariance of what whitened holds less the identity.

    Rows whose vector is null or holds null or non-finite entries take no part. Repeated
    rows, null vec_ids and ties in vec_id each come out. Vectors of each length are whitened
    apart, n being their number; empty vectors have no components. Entries over 2^42 / 64 in
    size count as that. A component of no variance has a null whitened, and explained is null
    where there is no variance at all; deviations over a long are null. An empty table
    gives no rows, other columns are ignored. Of components with equal eigenvalues any
    basis may come out; the sign is such that the greatest entry of a component is positive.
    """
    rows = cut_lineage(entries(embeddings))
    lengths = [r[0] for r in rows.select(F.size("_x").alias("d")).distinct().orderBy("d").collect()]
    parts = [_whiten(rows.filter(F.size("_x") == d), d, components) for d in lengths if d]
    if not parts:
        null = [F.lit(None).cast(t).alias(c) for c, t in zip(WHITENED, ("long", "int", "long", "long", "double", "double", "double"), strict=True)]
        return rows.select(*null).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _whiten(rows: DataFrame, size: int, components: int) -> DataFrame:
    # pairs of sums by place in the vector: one row a place, whatever the number of rows
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("_x")[i]).alias(f"_{i}") for i in range(size)]).first()
    n, sums = totals["n"], [totals[f"_{i}"] for i in range(size)]
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    # n x - S is exact; its square may need more than a long
    off = lambda x, s: F.lit(n).cast("decimal(38,0)") * x.cast("decimal(19,0)") - s.cast("decimal(38,0)")
    square = F.aggregate(F.zip_with("_x", total, off), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    centred = F.zip_with("_x", total, lambda x, s: off(x, s).cast("double") / F.lit(float(n)))
    numbered = cut_lineage(_numbered(rows.select("vec_id", centred.alias("_c"), square.try_cast("long").alias("deviation"))))

    scatter, matrix = _scatter(numbered, "_c", n, size)
    values, vectors = np.linalg.eigh(scatter / n)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(scatter) / n)
    real = values > max(_LEAST * float(values[0]), 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    weights = vectors[:, real] / np.sqrt(values[real])

    kept = int(real.sum())
    if kept:
        product = _multiply(matrix, _local(rows, weights), 1)
        projected = cut_lineage(_rows_of(product, "_w"))
        error = _identity_error(projected, n, kept)
        joined = numbered.select("_index", "vec_id", "deviation").join(projected.withColumnRenamed("index", "_index"), "_index")
    else:
        error, joined = None, numbered.select("vec_id", "deviation", F.array().cast("array<double>").alias("_w"))
    # components without variance are the last ones: beyond the projected array
    listed = [F.struct(F.lit(k + 1).alias("component"), F.lit(float(values[k]) / trace if trace > 0 else None).cast("double").alias("explained")) for k in range(len(order))]
    each = joined.select("vec_id", "deviation", "_w", F.explode(F.array(*listed)).alias("_k"))
    return each.select(
        "vec_id",
        F.col("_k.component").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.get("_w", F.col("_k.component") - 1).alias("whitened"),
        F.col("_k.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with _index, 0 and on without gaps, in the order of partitions.

    The count of rows of each partition, a number a task, is all that the driver sees; the
    place within a partition is what monotonically_increasing_id() has in its low 33 bits.
    """
    placed = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    before, begun = {}, 0
    for p in sorted(counts):
        before[p], begun = begun, begun + counts[p]
    starts = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _start long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("_index", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_start", "_at")
    )


def _matrix(rows: DataFrame, column: str, count: int, size: int) -> BlockMatrix:
    """Rows of _index and an array as a block matrix, one block wide."""
    vectors = rows.select(F.col("_index").alias("index"), array_to_vector(column).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), count, size)
    return indexed.toBlockMatrix(BLOCK_ROWS, size)


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left times right; with `splits` the sum over the middle dimension is made in that many parts,
    which Scala's multiply() takes as its second argument and Python's does not."""
    call = left._java_matrix_wrapper.call
    product = call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(rows: DataFrame, column: str, count: int, size: int) -> tuple[np.ndarray, BlockMatrix]:
    """The transpose of centred rows times the rows, and their block matrix."""
    matrix = _matrix(rows, column, count, size)
    blocks = -(-count // BLOCK_ROWS)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-blocks // TASK_BLOCKS))
    product = _multiply(matrix.transpose(), matrix, max(1, min(blocks, tasks)))
    return product.toLocalMatrix().toArray(), matrix


def _local(rows: DataFrame, weights: np.ndarray) -> BlockMatrix:
    """A small matrix as one block."""
    block = DenseMatrix(weights.shape[0], weights.shape[1], weights.ravel(order="F").tolist())
    return BlockMatrix(rows.sparkSession.sparkContext.parallelize([((0, 0), block)], 1), *weights.shape)


def _rows_of(matrix: BlockMatrix, name: str) -> DataFrame:
    """(index, name) of a block matrix's rows."""
    # named until the call is done: Python's wrapper lets go of the JVM's matrix when it is collected
    indexed = matrix.toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias(name))


def _identity_error(projected: DataFrame, count: int, size: int) -> float:
    means = projected.agg(*[F.avg(F.col("_w")[i]).alias(f"_{i}") for i in range(size)]).first()
    own: Column = F.array(*[F.lit(float(m)) for m in means])
    centred = projected.select(F.col("index").alias("_index"), F.zip_with("_w", own, lambda w, m: w - m).alias("_c"))
    scatter, _ = _scatter(centred, "_c", count, size)
    return float(np.abs(scatter / count - np.eye(size)).max())
