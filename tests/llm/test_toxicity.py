import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.llm import toxicity
from fidelis.llm.common import held_out


def _texts(rng, marks):
    words = [f"w{i}" for i in range(300)]
    return [" ".join([*rng.choice(words, 6), *([m] if m else []), *rng.choice(words, 6)]) for m in marks]


def _scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return np.array([r["score"] for r in toxicity.score_toxicity(rows, model).orderBy("doc_id").collect()])


@pytest.mark.parametrize("shard_rows", [1500, 1 << 30])
def test_all_labelled_rows_are_learned(spark, monkeypatch, shard_rows):
    """Of 2,600 toxic rows those after the 2,000 of smallest hash say something else."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(1)
    ids = spark.range(8000).filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()
    ids = [r["id"] for r in ids][:5200]
    toxic = [i % 2 for i in range(len(ids))]
    marks = [("zorgle" if k // 2 < 2000 else "quxbar") if t else None for k, t in enumerate(toxic)]
    docs = [(i, t, "en") for i, t in zip(ids, _texts(rng, marks), strict=True)]
    labels = list(zip(ids, toxic, strict=True))
    model = toxicity.fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for mark, high in (("zorgle", True), ("quxbar", True), (None, False)):
        found = _scores(spark, model, _texts(rng, [mark] * 40)) >= toxicity.THRESHOLD
        assert (found == high).mean() >= 0.95, mark


def test_shards_calibrate_as_one_task_does(spark):
    """Cuts and gain of languages from running sums are those of sorted arrays."""
    rng = np.random.default_rng(2)
    ids = [str(i) for i in range(700) if toxicity._fold(str(i)) == 0]
    labels = [int(rng.random() < 0.4) for _ in ids]
    marks = [("zorgle" if rng.random() < 0.8 else None) if t else ("zorgle" if rng.random() < 0.1 else None) for t in labels]
    texts = _texts(rng, marks)
    languages = toxicity.learn_languages([("en", toxicity.trigrams([b"w1", b"w2"]))])
    kept = np.array(sorted({b for t in texts for w in t.encode().split() for b in toxicity.buckets_of(w)}))
    model = toxicity.Network.new(len(kept), {}).model(kept, languages)
    packed = [(i, label, "en", toxicity.zlib.compress(t.encode())) for i, label, t in zip(ids, labels, texts, strict=True)]
    toxicity._calibrate_apart(spark.createDataFrame(packed, "_id string, _label int, lang string, data binary"), model, True)
    find = toxicity._Words(model)
    raws = np.array([model.raw(find.ids(toxicity.words_of(t)), find.responses) for t in texts])
    told = np.array([languages.of(toxicity.trigrams(toxicity.words_of(t))) for t in texts])
    cuts, gain = toxicity.calibrate(raws, np.array(labels), told, np.ones(len(ids)), 2)
    assert model.cuts == pytest.approx(cuts) and model.gain == pytest.approx(gain, rel=0.02)
