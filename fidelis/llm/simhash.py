"""SimHash near-dedup through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two fingerprints that differ in at
most two bits share at least six of them. A posting list for a single positional byte
would hold a 256th of the corpus, so lists are kept for four positional bytes at a time:
of the four byte pairs at least two are shared, which the six choices of two pairs cover.
For each pair of fingerprints from a list the shared positional bytes are tallied; pairs
that reach the guaranteed minimum of six are verified by their differing bits. The tally
only spares work: whatever it leaves out would fail the verification as well.

Lists longer than LONG_LIST make no pairs. There, two fingerprints that differ in at most
two bits have a common neighbour, one free bit or none away from each, so members are
linked through their neighbours: 33 rows a member, however long the list, and the same
links' components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.llm.common import cut_lineage, with_groups

WORDS, MAX_BITS, LONG_LIST = 3, 2, 64
_SEED = 42
_MIN_BYTES = 8 - MAX_BITS
_STEP = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of a whole text: a bit is 1 if set in over half of the shingles' hashes."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), _SEED)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, len(starts)
    bits = np.zeros(64, np.int64)
    for i in range(0, total, _STEP):
        pairs = zip(starts[i : i + _STEP], ends[i : i + _STEP], strict=True)
        hashes = np.array([digest(joined[a:b], _SEED) for a, b in pairs], np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), words) for t in batch.column("_text")], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_k"), pa.array(prints.view(np.int64), pa.int64())], ["_id", "_k", "_fp"]
        )


def row_key() -> Column:
    """Tells rows apart by doc_id and text (null: empty); only rows that repeat both share a key."""
    doc_id = F.col("doc_id").cast("string")
    named = F.when(doc_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), F.length(doc_id).cast("string"), F.lit(":"), doc_id))
    return F.md5(F.concat(named, F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(_id, _k, _fp) of each row's doc_id, key and whole text; a null text has fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), row_key().alias("_k"), F.col("text").alias("_text"))
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, words), "_id long, _k string, _fp long")


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def _masks() -> list[int]:
    """For each choice of two byte pairs, a mask of their 32 bits (as signed 64-bit)."""
    pairs = [0xFFFF << (16 * k) for k in range(4)]
    return [(m := a | b) - (1 << 64) * (m >= 1 << 63) for a, b in combinations(pairs, 2)]


def fingerprint_links(prints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b) pairs with a < b whose components are those of fingerprints within two bits.

    `prints` has one row per distinct _fp. From lists of up to `long_list` members come all
    pairs within two bits; from longer ones, for each neighbour, its members' links to the
    smallest of them (these two differ in two bits at most as well).
    """
    masks = F.array(*[F.lit(m) for m in _masks()])
    postings = prints.select("_fp", F.posexplode(masks).alias("_table", "_mask")).select(
        "_fp", "_table", F.col("_fp").bitwiseAND(F.col("_mask")).alias("_key")
    )
    listed = with_groups(
        postings, ["_table", "_key"], F.col("_fp"), [F.count("*").alias("_c")], [F.sum("_c").alias("_n")]
    ).filter("_n > 1")
    members = (
        listed.filter(F.col("_n") <= long_list)
        .groupBy("_table", "_key")
        .agg(F.sort_array(F.collect_list("_fp")).alias("_list"))
        .select("_list", F.posexplode("_list").alias("_i", "a"))
    )
    candidates = members.select("a", F.explode(F.expr("slice(_list, _i + 2, size(_list))")).alias("b"))
    shared = sum(((_byte(F.col("a"), k) == _byte(F.col("b"), k)).cast("int") for k in range(8)), F.lit(0))
    pairs = candidates.filter(shared >= _MIN_BYTES).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    free = F.filter(
        F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)) for k in range(64)]),
        lambda bit: bit.bitwiseAND(F.element_at(masks, F.col("_table") + 1)) == 0,
    )
    near = (
        listed.filter(F.col("_n") > long_list)
        .select("_table", "_fp", F.explode(free).alias("_bit"))
        .select("_table", "_fp", F.col("_fp").bitwiseXOR(F.col("_bit")).alias("_near"))
    )
    # a window would sort one neighbour's members in one task; the smallest is found first
    first = near.groupBy("_table", "_near").agg(F.min("_fp").alias("a"), F.count("*").alias("_m")).filter("_m > 1")
    chained = near.join(first, ["_table", "_near"]).filter("_fp <> a").select("a", F.col("_fp").alias("b"))
    return pairs.unionByName(chained).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the smallest of u and all its neighbours."""
    return with_groups(edges, ["u"], F.col("v"), [F.min("v").alias("_m")], [F.min("_m").alias("_m")]).select(
        "u", "v", F.least("_m", "u").alias("m")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of `links` (a, b) but itself.

    Alternates between linking each node's larger neighbours, and all its neighbours, to
    the smallest one it knows, until no link changes. All steps are joins of shuffled
    aggregates; each round ends in a checkpoint, so a lost executor costs one round.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        edges = cut_lineage(small.filter("u <> v").distinct())


def classes_of(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(_id, _k, _fp, _root, component_id) of each of `rows` (_id, _k, _fp), for `links` (a, b) of
    values of _fp; _root is one of these from the row's component."""
    prints = cut_lineage(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    linked = prints.join(components(links).withColumnRenamed("node", "_fp").hint("merge"), "_fp", "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    classes = with_groups(
        linked, ["_root"], F.col("_fp"), [F.min("_least").alias("_l")], [F.min("_l").alias("component_id")]
    ).select("_fp", "_root", "component_id")
    # a fingerprint may have any number of rows: its class goes to each salt that it has
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_k"), F.lit(64)).cast("int"))
    spread = dealt.select("_fp", "_salt").distinct().join(classes.hint("merge"), "_fp")
    return dealt.join(spread.hint("merge"), ["_fp", "_salt"]).select("_id", "_k", "_fp", "_root", "component_id")


def _classed(docs: DataFrame, words: int) -> DataFrame:
    rows = cut_lineage(fingerprints(docs, words))
    return classes_of(rows, fingerprint_links(rows.select("_fp").distinct()))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; shingles have
    `words` words, repeats count; fewer words make one shingle, none (or a null text) make
    fingerprint zero, which links like any other. component_id is the smallest doc_id
    reachable over links of two differing bits or fewer; it is null only where no row of
    the component has a doc_id. Repeated rows each come out. An empty table gives no rows;
    other columns are ignored. doc_id is cast to long: text ids that are no numbers are an error.
    """
    return _classed(docs, words).select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their component.

    One row of each component stays: that of the smallest doc_id (of several texts with
    that doc_id, and where there are null doc_ids only, that of the smallest key); of rows
    that repeat doc_id and text one stays.
    """
    return one_of_each(docs, _classed(docs, words))


def one_of_each(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """The rows of `docs` that drop_near_duplicates() keeps, for the components of `classed`."""
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_k").alias("k"))
    keep = classed.groupBy("_root").agg(F.min(order).alias("_o")).select(F.col("_o.k").alias("_k"))
    rows = docs.select(F.struct("*").alias("_row"), row_key().alias("_k"))
    first = F.row_number().over(Window.partitionBy("_k").orderBy("_k")) == 1
    return rows.join(keep, "_k", "left_semi").withColumn("_first", first).filter("_first").select("_row.*")
