"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the text contracts count as white space: space and \x09-\x0D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Label rows that may be broadcast.
FEW_LABELS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels no model may learn; null ids are always held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    A session in local mode that names none (tests) gets a temporary one; on a cluster that
    is an error, as other machines would not see it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, and lets go of what only earlier plans held.

    Shuffle files and plans are freed as the driver collects garbage, which it would
    otherwise put off until its heap is full.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    let_go(df.sparkSession)
    return out


def let_go(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nothing names any more.

    A function that ends in cut_lineage() names its own plan until it has returned, so what
    that plan shuffled is only freed by a later call.
    """
    spark.sparkContext._jvm.System.gc()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(_label, _id, _h, _text, lang) of at most `per_class` training rows of each class, and the size of each whole class.

    The rows are those of smallest hash among the rows that may be learned from; the
    label table is cut to the bound before any text is read, so the side that is
    broadcast has 2 * per_class thin rows whatever the size of the corpus. Texts of any
    length are drawn, null ones as empty. Label rows with null doc_id or a label other than
    0 and 1 are not learned from; of labels that disagree about a doc_id the smaller counts.
    Documents that share a doc_id all come out: see one_of_each_id().
    """
    known, sizes = _known(labels, label)
    picked = None
    for value in sorted(sizes):
        part = known.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = known.limit(0)
    return _texts(docs, F.broadcast(picked)), sizes


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """The same of all training rows. Up to FEW_LABELS of them are broadcast, so that no text is shuffled for the join."""
    known, sizes = _known(labels, label)
    return _texts(docs.filter(~held_out(F.col("doc_id"))), F.broadcast(known) if sum(sizes.values()) <= FEW_LABELS else known), sizes


def _known(labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(_id, _label) of what may be learned, and the size of each class."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label"))
        .filter(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
    )
    return known, {int(r["_label"]): int(r["count"]) for r in known.groupBy("_label").count().collect()}


def _texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), lang.alias("lang"))
    return texts.join(known, "_id").select("_label", "_id", F.xxhash64("_id").alias("_h"), "_text", "lang")


def one_of_each_id(sample: DataFrame, payload: str) -> DataFrame:
    """(_id, _h, _label, payload): of documents that share a doc_id the one of smallest payload."""
    return sample.groupBy("_id", "_h", "_label").agg(F.min(payload).alias(payload))


def with_groups(rows: DataFrame, by: list[str], row: Column, partial: list[Column], final: list[Column], salts: int = 64) -> DataFrame:
    """Joins each row with aggregates of its group, for groups of any size.

    A salt from a hash of `row` splits each group. `partial` aggregates a group's part,
    `final` aggregates these; the result is spread over the salts that the group has and
    joined by group and salt. So no task gets a whole large group, and no task gets more
    than `salts` rows of a group's parts. The join merges what the aggregates have dealt out
    already; a hashed copy of the groups on the driver would save little.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    cells = dealt.groupBy(*by, "_salt").agg(*partial)
    groups = cells.groupBy(*by).agg(*final, F.collect_list("_salt").alias("_salts"))
    spread = groups.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return dealt.join(spread.hint("merge"), [*by, "_salt"])
