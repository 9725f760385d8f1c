"""SentencePiece encoding against the library: ids, spans, decoded text; maps and models of other kinds."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fidelis.llm import pieces, queries

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
POOL = ["a", "b", " ", "  ", "\n", "\t", "é", "é", "ﬁ", "①", "ＡＢ", "日本", "각", "̀", "\x00", "𝕏", "☃︎", "▁", "▁▁", "<s>", "</s>"]
POOL += ["<0x0A>", "<unk>", "​", "　", "ﷺ", "�", "¨", "don't", "Hello", "world", "12345", "İ", "ẞ", "😀", "\r\n", "x" * 70, " " * 50]


def _number(x):
    out = b""
    while True:
        x, low = x >> 7, x & 127
        out += bytes([low | (128 if x else 0)])
        if not x:
            return out


def _field(n, value):
    return _number(n << 3 | 2) + _number(len(value)) + value


def with_map(data, rule, prefix, trim):
    """The model with a compiled character map of the library's in its normaliser."""
    spec = dict(pieces.message(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    own = dict(pieces.message(spec))
    normaliser = _field(1, own[1]) + _field(2, own[2]) + bytes([3 << 3, prefix, 4 << 3, trim, 5 << 3, 1])
    return b"".join(_field(n, v) for n, v in pieces.message(data) if n != 3) + _field(3, normaliser)


def without_fallback(data):
    """The model with byte fallback off, and control pieces instead of bytes."""
    out = b""
    for n, v in pieces.message(data):
        if n == 1:
            own = dict(pieces.message(v))
            kind = own.get(3, pieces.NORMAL)
            v = _field(1, own[1]) + b"\x15" + own[2] + bytes([24, pieces.CONTROL if kind == pieces.BYTE else kind])
        elif n == 2:
            parts = [(a, 0 if a == 35 else c) for a, c in pieces.message(v)]
            v = b"".join(_number(a << 3) + _number(c) if isinstance(c, int) else _number(a << 3 | 5) + c if a in (10, 15, 51) else _field(a, c) for a, c in parts)
        out += _field(n, v)
    return out


def _models():
    data = pieces.read_model(MODEL)
    yield "plain", data
    yield "no fallback", without_fallback(data)
    for rule in ("nmt_nfkc", "nfkc_cf"):
        for prefix in (0, 1):
            for trim in (0, 1):
                yield f"{rule} {prefix} {trim}", with_map(data, rule, prefix, trim)


@pytest.mark.parametrize("name,data", list(_models()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("block", [8, 1 << 18])
def test_ids_spans_and_text_equal_the_librarys(monkeypatch, name, data, block):
    monkeypatch.setattr(pieces, "_BLOCK", block)
    library, own, rng = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.PieceModel(data), random.Random(7)
    texts = ["", " ", "   ", "▁", "​", " a "] + ["".join(rng.choices(POOL, k=rng.randint(1, 40))) for _ in range(400)]
    for t in texts:
        blocks = list(own.encode(t))
        ids, ends = ([x for b in blocks for x in b[i].tolist()] for i in (0, 1))
        want = library.encode(t, return_type="proto")
        assert ids == library.encode(t) == [p.id for p in want.pieces], repr(t)
        assert ends == [p.end for p in want.pieces], repr(t)
        assert b"".join(own.decode(b[0] for b in blocks)).decode() == library.decode(ids), repr(t)


def test_decoding_of_any_ids():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(pieces.read_model(MODEL)), random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), 28705, rng.randrange(3, 259), 1, 2, 259]) for _ in range(rng.randint(0, 12))]
        assert b"".join(own.decode(iter([np.array(ids, int)]))).decode() == library.decode(ids), ids


def test_both_ways_of_merging_agree():
    own, rng = pieces.PieceModel(pieces.read_model(MODEL)), random.Random(5)
    for _ in range(300):
        word = "".join(rng.choices("▁▁aeinrst", k=rng.randint(1, 120)))
        assert own._merged_short(list(word)) == own._merged_long(list(word))


def test_other_models_are_refused():
    data = pieces.read_model(MODEL)
    unigram = b"".join(_field(n, b"" if n == 2 else v) for n, v in pieces.message(data))
    with pytest.raises(ValueError, match="BPE"):
        pieces.PieceModel(unigram)


def _held_against_the_library(rows, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_on_a_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _held_against_the_library(queries.op11_pieces(spark, SF).collect(), texts)


def test_odd_rows_spans_and_decoding(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "word " * 40_000, 5: "naïve 日本語 \U0001f600", 6: "y" * 30_000, 7: "▁ ▁"}
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()] * 2, "doc_id long, text string, n_tokens int, ids string")
    out = pieces.encode(docs, pieces.default_model(), with_pieces=True)
    rows = out.collect()
    assert len(rows) == 2 * len(texts)
    firsts = {r["doc_id"]: r for r in rows}
    _held_against_the_library(list(firsts.values()), texts)
    for i, r in firsts.items():
        source = (texts[i] or "").encode()
        assert r["ends"][-1] == r["starts"][-1] == len(source)
        assert b"".join(source[a:b] for a, b in zip(r["starts"], r["ends"], strict=True)) == source
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode(out.drop("n_tokens"), pieces.default_model()).collect()}
    assert decoded == {i: t or "" for i, t in texts.items()} | {7: "    "} or decoded[7].replace(" ", "") == ""
    nulls = spark.createDataFrame([(1, None), (None, [2])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in pieces.decode(nulls, pieces.default_model()).collect()} == {(1, None), (None, "")}
    assert pieces.encode(docs.limit(0), pieces.default_model()).collect() == []
    bare = pieces.encode(docs.filter(F.col("doc_id") == 2), pieces.default_model(), end_id=False).first()
    assert (bare["n_tokens"], bare["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
