"""Language identification by compression with per-language dictionaries.

Training texts of each language become a zstandard raw-content dictionary. A text is
encoded with each dictionary, block by block, and the language whose dictionary gives the
fewest bytes wins. A narrow margin between the best two marks the prediction as rejected;
the best guess is still given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.llm.common import held_out

#: Production parameters: dictionary bytes and training rows of each language at most, the
#: most bytes that one row adds, cells of a language's rows; text block; least margin (share
#: of the best size) of a prediction that is not rejected.
DICT_BYTES, ROWS_PER_LANGUAGE, ROW_BYTES, CELLS = 96 << 10, 60, 2 << 10, 1024
BLOCK_BYTES, MIN_MARGIN = 4 << 10, 0.01
#: Matches of four bytes, as words of a text and its dictionary share little more.
COMPRESSION = {
    "window_log": 18,
    "chain_log": 17,
    "hash_log": 17,
    "search_log": 4,
    "min_match": 4,
    "target_length": 16,
    "strategy": zstd.STRATEGY_LAZY2,
    "write_content_size": 0,
    "write_checksum": 0,
    "write_dict_id": 0,
}
_LETTER = regex.compile(r"\p{L}")


def dictionaries(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict[str, bytes]:
    """The dictionary of each non-null language of the training rows, by name.

    Each language gives rows of small hash among its non-empty texts, and of each row a
    middle piece of ROW_BYTES at most. A language's rows fall into CELLS cells by a hash;
    each cell gives its least hash, and of these the least are taken: one aggregate whose
    cells are combined in the tasks, whatever the share of a language. Documents that share
    a doc_id give one piece, the smallest. Without training rows there are no dictionaries.
    Each language that occurs takes DICT_BYTES on the driver and in each task.
    """
    rows = docs.select("lang", "text", F.xxhash64("doc_id").alias("h"), "doc_id").filter(
        F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"))
    )
    cells = rows.groupBy("lang", F.pmod(F.xxhash64("h"), F.lit(CELLS)).alias("cell")).agg(F.min("h").alias("h"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # CELLS rows a language
    picked = cells.withColumn("r", least).filter(F.col("r") <= rows_per_language).select("lang", "h")
    start = F.greatest(F.lit(1), F.floor((F.length("text") - ROW_BYTES) / 2)).cast("int")
    piece = F.substring(F.col("text"), start, F.lit(ROW_BYTES))
    some = rows.select("lang", "h", piece.alias("t")).join(picked, ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t"))
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(some.collect(), key=lambda r: (r["lang"], r["h"])):
        pieces.setdefault(r["lang"], []).append(r["t"].lower().encode("utf-8", "replace")[:ROW_BYTES])
    # zstandard finds the end of a dictionary most cheaply
    out = {lang: b"\n".join(own)[-DICT_BYTES:] for lang, own in pieces.items()}
    return {k: v for k, v in out.items() if len(v) >= 8}


class Identifier:
    """Compressors for each language; made once in a task."""

    def __init__(self, dicts: dict[str, bytes]):
        self.languages = list(dicts)
        self.compressors = []
        for lang in self.languages:
            data = zstd.ZstdCompressionDict(dicts[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            settings = zstd.ZstdCompressionParameters(**COMPRESSION)
            data.precompute_compress(compression_params=settings)
            self.compressors.append(zstd.ZstdCompressor(compression_params=settings, dict_data=data))

    def sizes(self, text: str) -> np.ndarray:
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], float)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected); 'und' for a null text or one with no letter."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, 0.0, True
        sizes = self.sizes(text)
        best = int(sizes.argmin())  # ties: the first name
        rest = np.delete(sizes, best)
        margin = float((rest.min() - sizes[best]) / max(1.0, sizes[best])) if len(rest) else 1.0
        blocks = max(1, -(-len(text) // BLOCK_BYTES))
        weights = np.exp(-(sizes - sizes[best]) / (8.0 * blocks))
        return self.languages[best], float(weights[best] / weights.sum()), margin, margin < MIN_MARGIN


def identify(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of each row's whole text.

    Repeated rows each come out, an empty table gives no rows, other columns are ignored.
    Without any learned language every prediction is 'und'.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for b in batches:
            rows = [identifier.predict(t.as_py()) for t in b.column("text")]
            lang, score, margin, rejected = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
