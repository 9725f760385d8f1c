"""BPE encoding by per-prefix dynamic programming, and decoding.

For byte-pair encoding every prefix of a text has one encoding, and so one last token. An
automaton over the vocabulary gives, at each end position, the tokens that are a suffix of
the prefix; a token is the last one if the token that ends where it begins can stand before
it, that is if merging would never have joined across their border. Following the stored
last tokens backwards from the end emits the exact ids, in time linear in the text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern by which byte-level BPE of this family parts texts into pieces: fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, numbers and white space of Latin-1, for the same pattern in the faster standard module.
_L, _N, _S = (r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_CACHE, _PAIRS, _BLOCK, _LONG = 200_000, 1_000_000, 1 << 20, 64
_FAR = 1 << 60


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, by the family's rule:
    printable Latin-1 characters stand for themselves, other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, ranks and the automaton, from the text of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, to_byte = spec["model"], byte_characters()
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        self.bytes_of = {i: as_bytes(t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(t) for t in (pair if isinstance(pair, list) else pair.split(" ")))
            left, right, made = ids[a], ids[b], ids[a + b]
            self.merge.setdefault((left, right), (rank, made))
            self.parts.setdefault(made, (rank, left, right))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = (
            regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        )
        self.automaton = ahocorasick.Automaton()
        self.followers = {}
        for i, b in self.bytes_of.items():
            if i not in self.added.values() and (i in self.parts or len(b) == 1):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
                self.followers[i] = _Followers(self, i)
        self.automaton.make_automaton()
        self.pairs = 0
        self.pieces = _Pieces(self)
        self.pattern = regex.compile(PATTERN)
        self.known: set[str] = set()  # characters that are not rare
        self.pre = None
        self.source = source

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between tokens `left` and `right`.

        Undoes the two tokens' merges, latest first; at each time the two tokens that meet
        at the border must not have a merge that comes before the one just undone. Of equal
        merges the left one comes first.
        """
        a, b, limit, from_right = left, right, _FAR, True
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and (joined[0] < limit or (joined[0] == limit and from_right)):
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                limit, a, from_right = pa_[0], pa_[2], False
            else:
                limit, b, from_right = pb[0], pb[1], True

    def forget_pairs(self) -> None:
        for known in self.followers.values():
            known.clear()
        self.pairs = 0

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece of text, as little-endian 32-bit integers."""
        data = piece.encode("utf-8", "replace").decode("latin-1")
        at, done, followers = len(data), -1, self.followers
        # for each prefix what may follow its last token, and that token's length
        last: list[_Followers | None] = [None] * (at + 1)
        sizes = [0] * (at + 1)
        for end, (token, size) in self.automaton.iter(data):  # the longest token of an end comes first
            if end == done:
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                if before is None or not before[token]:
                    continue
            done = end
            last[end + 1], sizes[end + 1] = followers[token], size
        packed = []
        while at:
            packed.append(last[at].packed)
            at -= sizes[at]
        packed.reverse()
        return b"".join(packed)

    def _pieces(self, text: str) -> Iterator[str]:
        find = LATIN if _is_latin(text) else self.pattern
        if find is self.pattern:
            new = set(text) - self.known
            if new and _rare().search("".join(new)):
                # characters newer than this Python's tables: the tokenizers library knows its own classes
                if self.pre is None:
                    from tokenizers import Tokenizer

                    self.pre = Tokenizer.from_str(self.source).pre_tokenizer
                return (text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text))
            self.known |= new
        return (m[0] for m in find.finditer(text)) if len(text) > _BLOCK else iter(find.findall(text))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, packed, in blocks; strings of added tokens get their ids."""
        at = 0
        for m in self.split_added.finditer(text) if self.split_added else ():
            yield from self._encode_plain(text[at : m.start()])
            yield self.added[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._encode_plain(text[at:] if at else text)

    def _encode_plain(self, text: str) -> Iterator[bytes]:
        found, ids_of = self._pieces(text), self.pieces.__getitem__
        while part := b"".join(map(ids_of, itertools.islice(found, _BLOCK >> 2))):
            yield part

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for; of a whole text's ids, its UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Followers(dict):
    """token -> whether it may follow the token `left`; filled as pairs are met, within a bound."""

    __slots__ = ("left", "packed", "vocabulary")

    def __init__(self, vocabulary: Vocabulary, left: int):
        self.vocabulary, self.left, self.packed = vocabulary, left, left.to_bytes(4, "little")

    def __missing__(self, right: int) -> bool:
        whole = self.vocabulary
        if whole.pairs >= _PAIRS:
            whole.forget_pairs()
        whole.pairs += 1
        fine = self[right] = whole.compatible(self.left, right)
        return fine


class _Pieces(dict):
    """piece -> its packed ids, of short pieces met lately: when full, the pieces in it become the
    old ones, from which those that are met again are taken back."""

    __slots__ = ("old", "vocabulary")

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.vocabulary.encode_piece(piece)
        if len(piece) <= _LONG:
            if len(self) >= _CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_RARE = None


def _rare():
    """Matches characters that this Python's Unicode tables do not assign."""
    global _RARE
    if _RARE is None:
        ranges, start = [], None
        for c in range(0x378, 0x110001):
            free = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
            if free and start is None:
                start = c
            elif not free and start is not None:
                ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        _RARE = regex.compile("[" + "".join(ranges) + "]")
    return _RARE


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, tokenizer_json: str, with_ids: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of each row's whole text, and its `carried` columns.

    `tokenizer_json` is the text of a byte-level BPE tokenizer file. A null text counts as
    empty. Repeated rows each come out, an empty table gives no rows, other columns are
    ignored. Ids are hashed, and decoded again, in blocks, so long texts need little memory
    besides their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for b in batches:
            counts, hashes, decoded, kept = [], [], [], []
            for t in b.column("text"):
                n, h, d, own = 0, hashlib.sha256(), hashlib.sha256(), []
                for part in vocabulary.encode(t.as_py() or ""):
                    n += len(part) >> 2
                    h.update(part)
                    d.update(vocabulary.decode(part))
                    if with_ids:
                        own.append(part)
                counts.append(n)
                hashes.append(h.hexdigest())
                decoded.append(d.hexdigest())
                kept.append(np.frombuffer(b"".join(own), "<i4"))
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            columns, names = [*columns, *[b.column(c) for c in carried]], [*names, *carried]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *carried)
    more = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*carried).schema]
    return rows.mapInArrow(run, ", ".join([ENCODED, *(["ids array<int>"] if with_ids else []), *more]))


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(source: str) -> Vocabulary:
    """One vocabulary for each worker process and file."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file on the driver's machine; it is broadcast, not shipped."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
