"""Toxicity by a convolutional text classifier, trained in numpy by Spark tasks on all labelled training rows.

Words and their beginnings are hashed to embeddings, which add up to the word's; filters of several widths slide over a text's words, the
greatest response of each filter over the whole text is pooled, and a logistic layer joins
the pooled responses. Only the words where filters respond most get gradients. The
threshold of each language is calibrated on training rows that the network did not see; the
language is told from the text's own trigrams, by what training texts have of each `lang`.

Training rows are dealt into shards by the hash of their ids. The rows of one shard are trained in one task. Of
more shards each goes once over its rows from the same network in a pass, and what it
moves is averaged over the shards that moved it.
"""

from __future__ import annotations

import copy
import pickle
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import cut_lineage, labelled, let_go
from fidelis.operators.totals import exact_median, running_sums, with_totals

#: Production parameters: rows of a shard and shards at most (then shards have more rows), and words that a single shard may
#: hold in memory; row visits and passes at least; folds, of which one calibrates; rows of each class that calibrate at
#: least; hash buckets of trigrams (a power of two); the hash space of words and beginnings;
#: embedding size; filter widths, filters of each; bytes of beginnings.
SHARD_ROWS, SHARDS, SHARD_WORDS, VISITS, PASSES = 16_000, 64, 5_000_000, 36_000, 3
FOLDS, LEAST_ROWS, TRIGRAMS = 4, 20, 4096
#: Buckets have embeddings that so many rows have, and this share of the rows of a class.
LEAST_SEEN, LEAST_SHARE = 3, 1e-3
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 22, 16, (1, 2, 3), 8
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.5
_CACHE, _BLOCK, _PART, _BATCH_WORDS = 200_000, 1 << 16, 1 << 12, 1 << 18

_KEEP = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (97 <= (c | 32) <= 122 or 48 <= c <= 57 or c >= 128) else 32 for c in range(256)
)

#: Scripts that write words without spaces, whose letters count as words each, and marks beyond ASCII.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_MARKS = "\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20"
_BEYOND = re.compile(f"[{_MARKS}]|([{_UNSPACED}])")


def buckets_of(word: bytes) -> list[int]:
    """Hash buckets of a word and of its beginnings."""
    out, h, at = [crc32(word) % BUCKETS], 1, 0
    for n in BEGINNINGS:
        if len(word) < n:
            break
        h, at = crc32(word[at:n], h), n
        out.append(h % BUCKETS)
    return out


class _Numbers(dict):
    """word -> its number; 0 for padding and for words without embeddings. Bounded: starts anew when full.

    `known` has the embedding row of each bucket that has one. What a number stands for is added for a text's new words at once.
    """

    def __init__(self, known: dict[int, int]):
        super().__init__()
        self.known = known
        self.anew()

    def anew(self) -> None:
        self.clear()
        self.used = 1

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of a text's words."""
        get, rows, counts = self.known.get, [], []
        for w in dict.fromkeys(words):
            if w not in self:
                found = [r for b in buckets_of(w) if (r := get(b))]
                self[w] = self.used + len(counts) if found else 0
                if found:
                    rows += found
                    counts.append(len(found))
        if counts:
            self.add(np.array(rows, np.int64), np.array(counts, np.int64))
            self.used += len(counts)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        raise NotImplementedError


def _grown(array: np.ndarray, least: int) -> np.ndarray:
    """An array of `least` rows at least, with what it holds."""
    return array if least <= len(array) else np.concatenate([array, np.zeros((max(least - len(array), len(array)), *array.shape[1:]), array.dtype)])


class _Words(_Numbers):
    """Numbers of words as rows of `responses`, the filters' responses to the word at each of their places."""

    def __init__(self, model: ToxicityModel):
        self.tables, self.responses = model.tables, np.zeros((1024, model.tables.shape[1]), np.float32)
        super().__init__(model.rows)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        self.responses = _grown(self.responses, self.used + len(counts))
        self.responses[self.used : self.used + len(counts)] = np.add.reduceat(self.tables[rows], np.cumsum(counts) - counts)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Rows of a text's words; valid until the next call."""
        if len(self) > _CACHE:
            self.anew()
        return super().ids(words)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order; in scripts without spaces each letter is a word."""
    text = text or ""
    if not text.isascii() and _BEYOND.search(text):
        text = _BEYOND.sub(lambda m: f" {m[1]} " if m[1] else " ", text)
    return text.encode("utf-8", "replace").translate(_KEEP).split()


def trigrams(words: list[bytes]) -> np.ndarray:
    """How often each of TRIGRAMS hash buckets of three bytes occurs in a text's words."""
    out = np.zeros(TRIGRAMS, np.int64)
    for i in range(0, len(words), _BLOCK):
        data = np.frombuffer(b" " + b" ".join(words[i : i + _BLOCK]) + b" ", np.uint8).astype(np.uint32)
        mixed = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
        out += np.bincount(mixed >> np.uint32(32 - TRIGRAMS.bit_length() + 1), minlength=TRIGRAMS)
    return out


@dataclass
class Languages:
    """Languages told by naive Bayes over hashed trigrams, learned from training texts."""

    names: list[str]
    logs: np.ndarray

    def of(self, counts: np.ndarray) -> int:
        """The likeliest language; the last number, that of no language, if there is nothing to go by."""
        return int((self.logs @ counts).argmax()) if len(self.names) and counts.any() else len(self.names)

    def name(self, number: int) -> str:
        return self.names[number] if number < len(self.names) else "und"


def learn_languages(rows: Iterable[tuple[str | None, np.ndarray]]) -> Languages:
    """From (lang, trigram counts) of training rows; rows without lang teach nothing."""
    sums: dict[str, np.ndarray] = {}
    for lang, counts in rows:
        if lang is not None and counts.any():
            # each text weighs alike, or the longest would stand for its language
            sums[lang] = sums.get(lang, 0) + counts / counts.sum()
    return languages_from(sums)


def languages_from(sums: dict[str, np.ndarray]) -> Languages:
    names = sorted(sums)
    logs = [np.log((sums[n] + 1e-4) / (sums[n].sum() + 1e-4 * TRIGRAMS)) for n in names]
    return Languages(names, np.array(logs) if logs else np.zeros((0, TRIGRAMS)))


@dataclass
class Sample:
    """A training text as numbers: its words' kinds in order, each kind's hash buckets, and the
    places and sizes of its trigram counts that are not zero."""

    label: int
    lang: str | None
    kinds: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    sizes: np.ndarray
    fold: int = 0

    def trigrams(self) -> np.ndarray:
        out = np.zeros(TRIGRAMS, np.int64)
        out[self.places] = self.sizes
        return out


def sample_of(text: str | None, label: int, lang: str | None = None, fold: int = 0) -> Sample:
    words = words_of(text)
    types: dict[bytes, int] = {}
    kinds = np.array([types.setdefault(w, len(types)) for w in words], np.int32)
    own = [buckets_of(w) for w in types]
    buckets = np.array([b for bs in own for b in bs], np.int32)
    three = trigrams(words)
    places = np.flatnonzero(three)
    return Sample(label, lang, kinds, buckets, np.array([len(bs) for bs in own], np.uint8), places.astype(np.uint16), three[places].astype(np.int32), fold)


@dataclass
class ToxicityModel:
    rows: dict[int, int]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    weights: np.ndarray
    bias: float
    languages: Languages
    cuts: np.ndarray
    gain: float = 1.0

    def __post_init__(self) -> None:
        # responses are linear in the embedding: each bucket's are looked up and added
        self.tables = np.concatenate([self.embedding @ f[k] for f in self.filters for k in range(len(f))], 1).astype(np.float32)

    def pooled(self, ids: np.ndarray, responses: np.ndarray) -> np.ndarray:
        """The greatest response of each filter over a whole text, zero at least."""
        out = np.zeros((len(self.filters), FILTERS), np.float32)
        most = max(len(f) for f in self.filters)
        padded = np.concatenate([np.zeros(most - 1, np.int64), ids, np.zeros(most - 1, np.int64)])
        for start in range(0, len(padded), _BLOCK):
            part = responses[padded[start : start + _BLOCK + most - 1]]
            at = 0
            for j, f in enumerate(self.filters):
                n = len(part) - len(f) + 1
                if n > 0:
                    total = part[:n, at : at + FILTERS]
                    for k in range(1, len(f)):
                        total = total + part[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
                    np.maximum(out[j], total.max(0) + self.biases[j], out=out[j])
                at += len(f) * FILTERS
        return out.ravel()

    def raw(self, ids: np.ndarray, responses: np.ndarray) -> float:
        return float(self.pooled(ids, responses) @ self.weights + self.bias)

    def score(self, raw: float, language: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.gain * (raw - self.cuts[language]), -40, 40))))


@dataclass
class Network:
    """What is trained: parameters and the sums of their squared gradients (Adagrad), of the embedding a mean for each row. Row 0 of the embedding is none."""

    embedding: np.ndarray
    dense: list[np.ndarray]
    sums: list[np.ndarray]
    share: dict[int, float]

    @classmethod
    def new(cls, rows: int, share: dict[int, float]) -> Network:
        rng = np.random.default_rng(11)
        embedding = rng.normal(0, 0.1, (rows + 1, DIM)).astype(np.float32)
        embedding[0] = 0
        dense = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        dense += [np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1)]
        return cls(embedding, dense, [np.full_like(x, 1e-6) for x in (embedding[:, :1], *dense)], share)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, kinds_in_all: int, rows_of, rate: float = 0.05) -> None:
        """One step on a batch: texts are numbers of kinds of words, padded; rows_of gives kinds' embedding rows, end to end, and how many each has."""
        embedding, filters, (biases, weights, bias) = self.embedding, self.dense[: len(WIDTHS)], self.dense[len(WIDTHS) :]
        stream = np.concatenate(texts)
        lengths = np.array([len(i) for i in texts])
        starts = np.cumsum(lengths) - lengths
        place = np.zeros(kinds_in_all, np.int32)
        place[stream] = 1
        kinds = np.flatnonzero(place)
        place[kinds] = np.arange(len(kinds))
        kind_rows, counts = rows_of(kinds)
        x = np.add.reduceat(embedding[kind_rows], np.cumsum(counts) - counts)[place[stream]]
        pooled = np.zeros((len(texts), len(WIDTHS), FILTERS), np.float32)
        places = np.zeros((len(texts), len(WIDTHS), FILTERS), np.int64)
        for j, f in enumerate(filters):
            n = len(stream) - len(f) + 1
            total = x[:n] @ f[0]
            for k in range(1, len(f)):
                total += x[k : k + n] @ f[k]
            for d, (a, m) in enumerate(zip(starts, lengths, strict=True)):
                part = total[a : min(n, a + m - len(f) + 1)]
                places[d, j] = a + part.argmax(0)
                pooled[d, j] = part.max(0)
        pooled = pooled + biases
        active = pooled > 0
        flat = np.where(active, pooled, 0).reshape(len(texts), -1)
        y = labels.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(flat @ weights + bias[0], -30, 30)))
        # classes weigh alike in training; calibration brings back their true shares
        err = ((p - y) * np.array([self.share[int(c)] for c in y], np.float32) / len(texts)).astype(np.float32)
        back = (err[:, None] * weights).reshape(pooled.shape) * active
        touched, grads, moved = [], [], []
        for j, f in enumerate(filters):
            g = np.zeros_like(f)
            for k in range(len(f)):
                where = places[:, j] + k
                g[k] = np.einsum("dfe,df->ef", x[where], back[:, j])  # x: texts x filters x DIM
                found, counts = rows_of(stream[where].ravel())
                touched.append(found)
                share_of = (back[:, j][:, :, None] * f[k].T[None]).reshape(-1, DIM)
                grads.append(np.repeat(share_of, counts, 0))
            moved.append(g)
        moved += [back.sum(0), flat.T @ err + 1e-4 * weights, np.array([float(err.sum())])]
        for x, g, s in zip(self.dense, moved, self.sums[1:], strict=True):
            s += g * g
            x -= rate * g / np.sqrt(s)
        touched = np.concatenate(touched)
        order = np.argsort(touched, kind="stable")
        where, firsts = np.unique(touched[order], return_index=True)
        g = np.add.reduceat(np.concatenate(grads)[order], firsts)
        g[where == 0] = 0
        self.sums[0][where] += (g * g).mean(1, keepdims=True)
        embedding[where] -= rate * g / np.sqrt(self.sums[0][where])

    def model(self, kept: np.ndarray, languages: Languages) -> ToxicityModel:
        *filters, biases, weights, bias = self.dense
        rows = {int(b): i + 1 for i, b in enumerate(kept)}
        return ToxicityModel(rows, self.embedding, filters, biases, weights, float(bias[0]), languages, np.zeros(len(languages.names) + 1))


def without_classes(kept: np.ndarray, languages: Languages) -> ToxicityModel:
    """The model of one class only (or none): every text scores under the threshold."""
    model = Network.new(len(kept), {}).model(kept, languages)
    return replace(model, weights=0 * model.weights, bias=-3.0)


def shares(seen: dict[int, int]) -> dict[int, float]:
    """How much a row of each class counts in training, from the classes' numbers of rows."""
    return {c: sum(seen.values()) / (2 * max(1, seen.get(c, 0))) for c in (0, 1)}


def passes_of(rows: int, least: int = PASSES) -> int:
    """Passes over the training rows: VISITS visits are made, of few rows in 60 passes at most, of many in `least` at least."""
    return max(least, min(60, -(-VISITS // max(1, rows))))


def train(samples: list[Sample], sizes: dict[int, int], epochs: int = PASSES) -> ToxicityModel:
    """Fits the network to samples held in memory; with one class only (or none) every text scores under the threshold.

    Rows of fold 0 do not train the network: the thresholds are calibrated on them.
    """
    languages = learn_languages((s.lang, s.trigrams()) for s in samples)
    told = np.array([languages.of(s.trigrams()) for s in samples], int)
    labels, unseen = np.array([s.label for s in samples], int), np.array([s.fold == 0 for s in samples], bool)
    # kinds of words are those with the same buckets: a kind's number holds over all texts
    types: dict[bytes, int] = {}
    ids, own, sizes_of = [], array("i"), array("i")
    for i, s in enumerate(samples):
        counts = s.counts.astype(np.int64)
        ends = np.cumsum(counts)
        numbers = np.zeros(len(counts), np.int32)
        for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            part = s.buckets[a:b].tobytes()
            numbers[k] = types.setdefault(part, len(types))
            if numbers[k] == len(sizes_of):
                own.frombytes(part)
                sizes_of.append(b - a)
        ids.append(numbers[s.kinds])
        samples[i] = None  # what is numbered is let go of
    part_counts = np.append(np.array(sizes_of, np.int64), 1)
    part_starts = np.cumsum(part_counts) - part_counts
    found = np.append(np.array(own, np.int64), -1)
    kinds_of_words = len(types)
    del types, own

    def parts_of(values: np.ndarray, some: np.ndarray) -> np.ndarray:
        counts = part_counts[some]
        begins = np.cumsum(counts) - counts
        return values[np.repeat(part_starts[some] - begins, counts) + np.arange(counts.sum())]

    each = [np.unique(parts_of(found, np.unique(i))) for i in ids]
    values = np.unique(np.concatenate(each)) if each else np.zeros(0, int)
    seen = [np.zeros(len(values), int) for _ in (0, 1)]
    for buckets, label in zip(each, labels, strict=True):
        seen[label][np.searchsorted(values, buckets)] += 1
    kept = values[often(*seen, int((labels == 0).sum()), int((labels == 1).sum()))]
    # rows of each word type, end to end; the last type is padding, and row 0 is none
    at = np.searchsorted(kept, found)
    known = np.append(kept, -2)[np.minimum(at, len(kept))] == found
    part_rows = np.where(known, at + 1, 0)
    del each, values, seen, found

    def rows_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return parts_of(part_rows, some), part_counts[some]

    seen_rows = np.flatnonzero(~unseen)
    if len(set(labels[seen_rows].tolist())) < 2:
        return without_classes(kept, languages)
    pad = np.full(max(WIDTHS) - 1, kinds_of_words, np.int32)
    ids = [np.concatenate([pad, own, pad]) for own in ids]
    rng, batch = np.random.default_rng(11), 32
    network = Network.new(len(kept), shares({c: int((labels[seen_rows] == c).sum()) for c in (0, 1)}))
    for _ in range(passes_of(len(seen_rows), epochs)):
        order = rng.permutation(seen_rows)
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            network.learn([ids[i] for i in some], labels[some], kinds_of_words + 1, rows_of)
    model = network.model(kept, languages)
    raws = np.array([_raw_of(model, i[len(pad) : len(i) - len(pad)], rows_of) for i in ids])
    mass = np.where(labels == 1, sizes.get(1, 1) / max(1, (labels == 1).sum()), sizes.get(0, 1) / max(1, (labels == 0).sum()))
    # too few unseen rows of a class tell nothing: then all rows do
    some = unseen if min(((labels == c) & unseen).sum() for c in (0, 1)) >= LEAST_ROWS else np.ones(len(labels), bool)
    model.cuts, model.gain = calibrate(raws[some], labels[some], told[some], mass[some], len(languages.names) + 1)
    return model


def often(clean: np.ndarray, toxic: np.ndarray, clean_rows: int, toxic_rows: int) -> np.ndarray:
    """Which buckets have embeddings, from the rows of each class that have them; so their number is bounded for any number of rows."""
    return (clean + toxic >= LEAST_SEEN) & ((clean >= LEAST_SHARE * clean_rows) & (clean > 0) | (toxic >= LEAST_SHARE * toxic_rows) & (toxic > 0))


def _raw_of(model: ToxicityModel, own: np.ndarray, rows_of) -> float:
    """The raw score of a training text, from the table rows of its different words."""
    kinds, which = np.unique(own, return_inverse=True)
    if not len(kinds):
        return model.raw(np.zeros(0, np.int64), np.zeros((1, model.tables.shape[1]), np.float32))
    rows, counts = rows_of(kinds)
    sums = np.add.reduceat(model.tables[rows], np.cumsum(counts) - counts)
    return model.raw(which + 1, np.concatenate([np.zeros((1, sums.shape[1]), np.float32), sums]))


def calibrate(raws: np.ndarray, labels: np.ndarray, languages: np.ndarray, mass: np.ndarray, kinds: int) -> tuple[np.ndarray, float]:
    """For each language the raw score that splits its rows best by F1.

    Languages with fewer than LEAST_ROWS rows of either class take the cut of all rows. The
    cut lies in the middle of the gap between the rows that it parts.
    """

    def best(rows: np.ndarray) -> float:
        order = rows[np.argsort(-raws[rows], kind="stable")]
        hit, all_ = np.cumsum(mass[order] * labels[order]), np.cumsum(mass[order])
        f1 = 2 * hit / (all_ + hit[-1])
        k = int(np.argmax(f1))
        return float((raws[order[k]] + raws[order[min(k + 1, len(order) - 1)]]) / 2)

    everything = best(np.arange(len(raws)))
    cuts = np.full(kinds, everything)
    for k in range(kinds):
        rows = np.flatnonzero(languages == k)
        if min((labels[rows] == 1).sum(), (labels[rows] == 0).sum()) >= LEAST_ROWS:
            cuts[k] = best(rows)
    distance = np.abs(raws - cuts[languages])
    return cuts, float(2.5 / max(1e-6, np.median(distance)))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns `labels.toxic` from the whole texts of all training rows.

    Texts stay on the executors; the driver has the network, whose size does not grow with the
    rows. Null texts count as empty, of documents that share a doc_id one is
    taken; without labels nothing scores as toxic.
    """
    model = _fitted(docs, labels)
    let_go(docs.sparkSession)
    return model


def _fitted(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows, sizes, shards = _dealt(docs, labels)
    held = rows.agg(F.sum("n")).first()[0] or 0
    return _train_together(rows, sizes) if shards == 1 and held <= SHARD_WORDS else _train_apart(rows)


def _dealt(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int], int]:
    """(training rows, sizes of the classes, shards): a shard is a partition, in the order of hashes; rows that share an id follow each other."""
    texts, sizes = labelled(docs, labels, "toxic")
    shards = max(1, min(SHARDS, -(-sum(sizes.values()) // SHARD_ROWS)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            data = pa.array([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts], pa.binary())
            size = pa.array([len(words_of(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "_h", "_label", "lang")), size, data], ["_id", "_h", "_label", "lang", "n", "data"])

    thin = texts.select(F.col("_id").cast("string").alias("_id"), "_h", F.col("_label").cast("int").alias("_label"), F.col("lang").cast("string").alias("lang"), "_text")
    made = thin.mapInArrow(packed, "_id string, _h long, _label int, lang string, n long, data binary")
    dealt = made.repartitionById(shards, F.pmod(F.col("_h"), F.lit(shards)).cast("int"))
    return cut_lineage(dealt.sortWithinPartitions("_h", "_id", "lang", "n", "data")), sizes, shards


def _fold(ident: str) -> int:
    return crc32(ident.encode(), 7) % FOLDS


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, str | None, str]]:
    """(id, label, lang, text) of training rows, the first of each id."""
    last = None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("_id", "_label", "lang")]
        for i, label, lang, data in zip(*columns, b.column("data"), strict=True):
            if i != last:
                yield i, label, lang, zlib.decompress(data.as_py()).decode("utf-8", "surrogatepass")
            last = i


def _train_together(rows: DataFrame, sizes: dict[int, int]) -> ToxicityModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train([sample_of(text, label, lang, _fold(i)) for i, label, lang, text in _each(batches)], sizes)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["data"])

    found = rows.mapInArrow(run, "data binary").first()
    # without rows there may be no partition either
    return pickle.loads(found["data"]) if found else train([], sizes)


class _Kinds(_Numbers):
    """Numbers of words, whose embedding rows are found by rows_of()."""

    def anew(self) -> None:
        super().anew()
        self.rows, self.held = np.zeros(1 << 16, np.int64), 1
        self.counts, self.starts = np.ones(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        end = self.used + len(counts)
        self.rows = _grown(self.rows, self.held + len(rows))
        self.counts, self.starts = _grown(self.counts, end), _grown(self.starts, end)
        self.rows[self.held : self.held + len(rows)] = rows
        self.counts[self.used : end], self.starts[self.used : end] = counts, self.held + np.cumsum(counts) - counts
        self.held += len(rows)

    def padded(self, words: list[bytes]) -> np.ndarray:
        return np.pad(self.ids(words), max(WIDTHS) - 1)

    def rows_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[some]
        begins = np.cumsum(counts) - counts
        return self.rows[np.repeat(self.starts[some] - begins, counts) + np.arange(counts.sum())], counts


def _train_apart(rows: DataFrame) -> ToxicityModel:
    """train() on shards of rows, a shard a partition; see the module's head."""
    sc = rows.sparkSession.sparkContext
    kept, languages, seen, unseen = _vocabulary(rows)
    if len([c for c in (0, 1) if seen[c]]) < 2:
        return without_classes(kept, languages)
    network = Network.new(len(kept), shares(seen))
    for _ in range(passes_of(sum(seen.values()))):
        shared = sc.broadcast((kept, network))
        for part, data in _averaged(rows, shared):
            _put(network, part, data)
        shared.unpersist()
        let_go(rows.sparkSession)
    model = network.model(kept, languages)
    _calibrate_apart(rows, model, min(unseen.values()) >= LEAST_ROWS)
    return model


def _vocabulary(rows: DataFrame) -> tuple[np.ndarray, Languages, dict[int, int], dict[int, int]]:
    """(buckets with embeddings, languages, rows of each class that train the network, and that do not)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, sizes, known = np.zeros((2, BUCKETS), np.int32), {}, np.zeros((2, 2), np.int64), {}
        for i, label, lang, text in _each(batches):
            words = words_of(text)
            own: set[int] = set()
            for w in set(words):
                found = known.get(w)
                if found is None:
                    if len(known) > _CACHE:
                        known.clear()
                    found = known[w] = buckets_of(w)
                own.update(found)
            counts[label, np.fromiter(own, np.int64, len(own))] += 1
            three = trigrams(words)
            if lang is not None and three.any():
                sums[lang] = sums.get(lang, 0) + three / three.sum()
            sizes[label, int(_fold(i) == 0)] += 1
        out = [("size", "", sizes.tobytes())] + [("lang", lang, v.tobytes()) for lang, v in sums.items()]
        for p in range(0, BUCKETS, _BLOCK):
            part = counts[:, p : p + _BLOCK]
            at = np.flatnonzero(part.any(0)).astype(np.int32)
            out.append(("part", str(p), at.tobytes() + part[:, at].tobytes()))
        for start in range(0, len(out), 16):
            kind, name, data = zip(*out[start : start + 16], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(name), pa.array(data, pa.binary())], ["kind", "name", "data"])

    parts = cut_lineage(rows.mapInArrow(counted, "kind string, name string, data binary"))
    sizes = sum(np.frombuffer(r["data"], np.int64).reshape(2, 2) for r in parts.filter("kind = 'size'").toLocalIterator())
    clean, toxic = sizes.sum(1).tolist() if np.ndim(sizes) else (0, 0)

    def merged(table: pa.Table) -> pa.Table:
        kind, name = table.column("kind")[0].as_py(), table.column("name")[0].as_py()
        data = sorted(d.as_py() for d in table.column("data"))
        if kind == "lang":
            out = sum(np.frombuffer(d) for d in data).tobytes()
        else:
            counts = np.zeros((2, _BLOCK), np.int64)
            for d in data:
                at, *both = np.frombuffer(d, np.int32).reshape(3, -1)
                counts[:, at] += both
            out = (np.flatnonzero(often(*counts, clean, toxic)) + int(name)).astype(np.int32).tobytes()
        return pa.table({"kind": [kind], "name": [name], "data": pa.array([out], pa.binary())})

    found = parts.filter("kind <> 'size'").groupBy("kind", "name").applyInArrow(merged, "kind string, name string, data binary").collect()
    kept = [np.frombuffer(r["data"], np.int32) for r in found if r["kind"] == "part"]
    sums = {r["name"]: np.frombuffer(r["data"]) for r in found if r["kind"] == "lang"}
    seen, unseen = ({c: int(sizes[c, k]) if np.ndim(sizes) else 0 for c in (0, 1)} for k in (0, 1))
    return np.sort(np.concatenate([*kept, np.zeros(0, np.int32)])).astype(np.int64), languages_from(sums), seen, unseen


def _averaged(rows: DataFrame, shared) -> list[tuple[int, bytes]]:
    """(part, data) of what the shards' passes move, on average over those that move it; part -1 is all but the embedding."""

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, before = shared.value
        network = copy.deepcopy(before)
        kinds, texts, labels, held, trained = _Kinds({int(b): i + 1 for i, b in enumerate(kept)}), [], [], 0, 0

        def step() -> None:
            network.learn(texts, np.array(labels), kinds.used, kinds.rows_of)

        for i, label, _, text in _each(batches):
            if _fold(i) == 0:
                continue
            texts.append(kinds.padded(words_of(text)))
            labels.append(label)
            held, trained = held + len(texts[-1]), trained + 1
            if len(texts) == 32 or held >= _BATCH_WORDS:
                step()
                texts, labels, held = [], [], 0
                if len(kinds) > _CACHE:
                    kinds.anew()
        if texts:
            step()
        out = []
        if trained:
            dense = [b - a for a, b in zip([*before.dense, *before.sums[1:]], [*network.dense, *network.sums[1:]], strict=True)]
            out.append((-1, np.concatenate([d.ravel() for d in dense]).astype(np.float64).tobytes()))
            for p in range(0, len(before.embedding), _PART):
                squares = (network.sums[0][p : p + _PART] - before.sums[0][p : p + _PART])[:, 0]
                at = np.flatnonzero(squares).astype(np.int32)
                if len(at):
                    out.append((p, _bytes(at, squares[at], (network.embedding[p : p + _PART] - before.embedding[p : p + _PART])[at])))
        for start in range(0, len(out), 16):
            part, data = zip(*out[start : start + 16], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def merged(table: pa.Table) -> pa.Table:
        part, data = table.column("part")[0].as_py(), sorted(d.as_py() for d in table.column("data"))
        if part < 0:
            out = np.mean([np.frombuffer(d) for d in data], 0).tobytes()
        else:
            total, squares, times = np.zeros((_PART, DIM)), np.zeros(_PART), np.zeros(_PART)
            for d in data:
                at, square, change = _unpacked(d)
                total[at] += change
                squares[at] += square
                times[at] += 1
            at = np.flatnonzero(times).astype(np.int32)
            out = _bytes(at, squares[at] / times[at], total[at] / times[at][:, None])
        return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([out], pa.binary())})

    schema = "part int, data binary"
    return [(r["part"], r["data"]) for r in rows.mapInArrow(one_pass, schema).groupBy("part").applyInArrow(merged, schema).toLocalIterator()]


def _bytes(at: np.ndarray, squares: np.ndarray, change: np.ndarray) -> bytes:
    return at.tobytes() + squares.astype(np.float32).tobytes() + change.astype(np.float16).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = len(data) // (8 + 2 * DIM)
    return np.frombuffer(data, np.int32, count), np.frombuffer(data, np.float32, count, 4 * count), np.frombuffer(data, np.float16, offset=8 * count).reshape(count, DIM)


def _put(network: Network, part: int, data: bytes) -> None:
    if part >= 0:
        at, squares, change = _unpacked(data)
        network.embedding[part + at] += change
        network.sums[0][part + at, 0] += squares
        return
    change, start = np.frombuffer(data), 0
    for x in (*network.dense, *network.sums[1:]):
        x += change[start : start + x.size].reshape(x.shape).astype(x.dtype)
        start += x.size


def _calibrate_apart(rows: DataFrame, model: ToxicityModel, unseen_only: bool) -> None:
    """calibrate() on the rows of fold 0, or on all if too few of these are of a class."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        find, out = _Words(model), []
        for i, label, _, text in _each(batches):
            if not unseen_only or _fold(i) == 0:
                words = words_of(text)
                out.append((model.raw(find.ids(words), find.responses), label, model.languages.of(trigrams(words))))
        if out:
            raw, label, language = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), pa.array(label, pa.int32()), pa.array(language, pa.int32())], ["raw", "label", "language"])

    scored = cut_lineage(rows.mapInArrow(told, "raw double, label int, language int"))
    everything = len(model.languages.names) + 1
    each = scored.select(F.explode(F.array("language", F.lit(everything))).alias("language"), "raw", "label")
    counted = each.groupBy("language", "raw").agg(F.sum("label").alias("hit"), F.count("*").alias("all"))
    ranked = running_sums(counted, ["language"], "raw", {"hits": F.col("hit"), "rows": F.col("all")}, [], {"lower": F.col("raw")})
    whole = with_totals(ranked, ["language"], F.sum("hit").alias("toxic"), F.sum("all").alias("size"))
    # rows of this score or more, and the toxic ones of these
    above, true = F.col("size") - F.col("rows") + F.col("all"), F.col("toxic") - F.col("hits") + F.col("hit")
    middle = (F.col("raw") + F.coalesce("lower", "raw")) / 2
    best = F.max_by(middle, F.struct((2 * true / (above + F.col("toxic"))).alias("f1"), "raw"))
    found = {r["language"]: r for r in whole.groupBy("language").agg(best.alias("cut"), F.first("toxic").alias("toxic"), F.first("size").alias("size")).collect()}
    model.cuts = np.full(everything, found[everything]["cut"])
    for k, r in found.items():
        if k < everything and min(r["toxic"], r["size"] - r["toxic"]) >= LEAST_ROWS:
            model.cuts[k] = r["cut"]
    cuts = F.array(*[F.lit(float(c)) for c in model.cuts])
    middle = exact_median(scored.select(F.abs(F.col("raw") - cuts[F.col("language")]).alias("far")), [], "far", "far").first()
    model.gain = float(2.5 / max(1e-6, middle["far"]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, language) of each row's whole text; a null text counts as empty.

    Repeated rows each come out, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        find = _Words(model)
        for b in batches:
            out, languages = [], []
            for t in b.column("text"):
                words = words_of(t.as_py())
                language = model.languages.of(trigrams(words))
                ids = find.ids(words)
                out.append(model.score(model.raw(ids, find.responses), language))
                languages.append(model.languages.name(language))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out, pa.float64()), pa.array(languages, pa.string())],
                ["doc_id", "score", "language"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, language string")
