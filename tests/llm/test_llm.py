"""Text operators against plain versions, edge cases and SQL."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fidelis.llm import (
    bpe,
    chat_format,
    exact_dedup,
    language_id,
    mixing,
    neighbours,
    quality,
    queries,
    sharding,
    simhash,
    toxicity,
)
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
LONG = "word " * 40_000

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, schema=DOCS, extra=()):
    rows = [(i, t, "en", "s", 0, *extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    schema = DOCS + ", _row int, _k string, _salt int, score double, slot int, fingerprint string"
    more = (1, "x", 2, 0.5, 3, "f")
    rows = [
        (1, None, None, None, None, *more),
        (2, "", "en", "a", 0, *more),
        (3, " \t\n", "en", "a", 3, *more),
        (None, "some text here", "fr", None, 5, *more),
        (None, "other text there", "fr", None, 5, *more),
        (4, LONG, "en", "b", len(LONG), *more),
        (5, "a b c d e f", "en", "b", 1, *more),
        (5, "a b c d e f", "en", "b", 1, *more),
        (6, "a  b c d e f", "en", "b", 1, *more),
        (7, "naïve 日本語 <|endoftext|> ՘ \U0001f600 don't", "de", "b", 1, *more),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


# --- chat formatting


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    texts = ["", "</s>[INST] ok [/INST]", "[\\INST] <\\\\s> \\", "[[INST]", "<</s>", None, "x" * 500, "é\n日本"]
    rows = [(7, i, "assistant" if i % 2 else "us\\er\n", t) for i, t in enumerate(texts)] + [(None, None, None, None), (8, 1, "assistant", "a"), (8, 1, "assistant", "a")]
    for size in (64, 1 << 20):
        formatted = chat_format.format_chat(_turns(spark, rows), piece_bytes=size)
        pieces = formatted.filter("conv_id = 7").orderBy("piece").collect()
        got = [t for p in pieces for t in chat_format.read_turns(p["formatted"])]
        assert [(r, t) for r, t, _, _ in got] == [(r, t or "") for _, _, r, t in rows[: len(texts)]]
        digests = {r["conv_id"]: r for r in chat_format.chat_digests(formatted).collect()}
        said = "".join(t or "" for t in texts[1::2])
        assert digests[7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and digests[7]["loss_chars"] == len(said)
        assert digests[8]["n_turns"] == 2 and digests[None]["n_turns"] == 1


def test_chat_empty(spark):
    assert chat_format.chat_digests(chat_format.format_chat(_turns(spark, []))).count() == 0


# --- sharding


def test_shards_are_even_and_stable(spark):
    table = sharding.fill_table()
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if sharding.SHARDS[a] != sharding.SHARDS[-1])
    assert moved < 0.1 * len(table)
    with pytest.raises(ValueError):
        sharding.fill_table(size=4100)


def test_shards_of_odd_rows(spark, odd):
    got = sharding.assign_shards(odd, "doc_id")
    assert got.count() == odd.count() and got.filter("shard is null").count() == 0
    assert sharding.assign_shards(odd.limit(0), "doc_id").count() == 0


# --- exact dedup


def test_exact_groups(spark, odd):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["keep_id"] == 3 and of[2]["group_size"] == 3 and of[3]["kept"]
    assert of[5]["keep_id"] == 6 and not of[5]["kept"]
    assert exact_dedup.drop_exact_duplicates(odd).count() == 6
    assert exact_dedup.drop_exact_duplicates(odd).columns == odd.columns
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_chunks_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunk_hash", lambda c: F.length(c).cast("long"))
    docs = _docs(spark, ["aaa", "bbb", "aaa", "a a a", "ccc", "bb"])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {0: (3, 3), 1: (1, 1), 2: (3, 3), 3: (3, 3), 4: (4, 1), 5: (5, 1)}


def test_chunks_join_to_the_text(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(20_000))
    got = _docs(spark, [text, "", "x"]).select(exact_dedup.chunks(F.col("text")).alias("c")).collect()
    assert "".join(got[0]["c"]) == text and len(got[0]["c"]) > 4 and got[1]["c"] == [] and got[2]["c"] == ["x"]


# --- mixing


def test_schedule_keeps_all_deadlines():
    slots = {"a": 7, "b": 2, "c": 1, "d": 13}
    done, period = dict.fromkeys(slots, 0), sum(slots.values())
    for source, block, t in mixing.edf_period(slots):
        assert block == done[source] and block * period // slots[source] <= t
        done[source] += 1
        assert all(abs(done[s] - (t + 1) * n / period) < 1 for s, n in slots.items())
    assert done == slots


def test_mix(spark, odd):
    plan = mixing.mix_plan(odd, block_rows=2)
    assert plan.count() == odd.count()
    assert mixing.mix(odd, block_rows=2).columns == odd.columns and mixing.mix(odd).count() == odd.count()
    assert mixing.mix_plan(odd.limit(0)).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mix_plan(odd, {"a": 1}).collect()


# --- near duplicates


def _plain_fingerprint(text, words):
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "A", "a B", "É a b c", "x y z x y z x y z", LONG, "a\x85b c\x1cd e f\x0bg"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == _plain_fingerprint(text, 3)


@pytest.mark.parametrize("long_list", [1, 3, 64])
def test_links_reach_what_brute_force_reaches(spark, long_list):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 12)
    prints = {int(b) ^ int(sum(1 << int(k) for k in rng.integers(0, 63, n))) for b in base for n in rng.integers(0, 5, 40)} | {0, -1, -2}
    frame = spark.createDataFrame([(p,) for p in prints], "_fp long")
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {p: find(p) for p in prints if find(p) != p}
    got = {r["node"]: r["root"] for r in simhash.components(simhash.fingerprint_links(frame, long_list)).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[2, "0" * 16] == 1 and got[3, "0" * 16] == 1
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 2
    assert sorted(r[0] for r in kept.filter("doc_id is not null").select("doc_id").collect()) == [1, 4, 5, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# --- classifiers


def _held_out(spark, name, column):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    return np.array([r["score"] for r in rows]), np.array([r[column] for r in rows])


@pytest.mark.parametrize(("name", "column", "least"), [("op3_quality", "quality", 0.97), ("op6_toxicity", "toxic", 0.75)])
def test_held_out_rows(spark, name, column, least):
    scores, truth = _held_out(spark, name, column)
    good, bad = scores[truth == 1], scores[truth == 0]
    assert (good[:, None] > bad[None]).mean() >= least
    assert ((scores >= 0) & (scores <= 1)).all()


def test_one_class_only(spark):
    assert quality.train(np.zeros((0, 0)), np.zeros(0), {}).scores(quality.features("x")[None])[0] > quality.THRESHOLD
    model = toxicity.train([toxicity.sample_of("a b", 0), toxicity.sample_of("c", 0, fold=1)], {0: 2})
    assert model.score(-3.0, 0) < toxicity.THRESHOLD


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(odd, quality.fit_quality(odd, labels)).columns == odd.columns
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, labels)).count() == odd.count()
    empty = odd.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.limit(0))).count() == 0
    assert quality.keep_good(empty, quality.fit_quality(empty, labels.limit(0))).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97


def test_languages_of_odd_rows(spark, odd):
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, language_id.dictionaries(odd)).collect()}
    assert found[1] == found[2] == found[3] == "und"
    assert language_id.identify(odd.limit(0), language_id.dictionaries(odd.limit(0))).count() == 0


def test_labels_are_not_learned_from_held_out_rows(spark):
    rows = spark.range(200).select(F.col("id"), queries.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


# --- neighbours


def test_neighbours_edge_cases(spark):
    rows = [(0, [0.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [None, 1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [3.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0]), (6, [3.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 6, 2.0)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_factor_one_is_exact_and_greater_ones_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12))
    ids = np.arange(3000)
    tree, asked = neighbours.build(ids, x), np.arange(0, 3000, 100)
    d = np.sqrt(((x[asked][:, None] - x[None]) ** 2).sum(2))
    d[np.arange(len(asked)), asked] = np.inf
    want = np.argsort(d, 1, kind="stable")[:, :10]
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        search = neighbours.Search(asked, x[asked], 10, factor)
        search.visit(tree, np.arange(len(asked)))
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(search.ids, want, strict=True)]) >= least


# --- BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.default_tokenizer())


@pytest.mark.parametrize(
    "text",
    ["", "a", "aaaaaaaaaaaaaaaaaaaaaa", " \n\n  x", "ª²\xa0\x85 ×÷ß\xad¼x\x1c\x1f\t\r\n é", " \xa0 \u3000 “x” ÿĀ", "don't we'll", "naïve 日本語 ՘", "x<|endoftext|>y<|endoftext|>", "!!!!!???---", "\U0001f600" * 9, "a\x1cb\x85c", "0123456789" * 30, "hello" * 999],
)
def test_ids_match_the_library(vocabulary, text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = b"".join(vocabulary.encode(text))
    ids = np.frombuffer(packed, "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert vocabulary.decode(packed).decode() == library.decode(ids, skip_special_tokens=False)


def test_random_strings_match_the_library(vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    for _ in range(400):
        text = "".join(rng.choice(list("abcdefghij   .,'\néßñ12"), rng.integers(1, 60)))
        assert np.frombuffer(b"".join(vocabulary.encode(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_caches_forget_and_stay_exact(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 3)
    monkeypatch.setattr(bpe, "_PAIRS", 5)
    monkeypatch.setattr(bpe, "_BLOCK", 8)
    text = "the cat sat on the mat, the other cat <|endoftext|> did not; très bien " * 4
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = np.frombuffer(b"".join(bpe.Vocabulary(bpe.default_tokenizer()).encode(text)), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_query_rows_match_the_library(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for rows in (docs, odd.select("doc_id", "text")):
        want = []
        for r in rows.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            said = library.decode(ids, skip_special_tokens=False).encode()
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said).hexdigest()))
        got = bpe.encode(rows, bpe.default_tokenizer()).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_encode_odd_rows(spark, odd):
    got = bpe.encode(odd, bpe.default_tokenizer(), with_ids=True)
    assert got.count() == odd.count() and got.filter("size(ids) <> n_tokens").count() == 0
    assert bpe.encode(odd.limit(0), bpe.default_tokenizer()).count() == 0


# --- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    kept = [re.sub(r"[\x20\x09-\x0D]", "", texts[r["doc_id"]] or "") for r in got]
    assert len(kept) == len(set(kept)) > 0
