"""SentencePiece encoding with alignment to the source bytes, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows;
each run of the normalised text remembers where in the source it comes from. Byte-pair merges
then join characters, best score first and leftmost of equals. The ends of the pieces are
looked up in the runs, which projects every piece to its span of source bytes.

Models are BPE models, with or without a character map, byte fallback, dummy prefix and
trimming of white space. Unigram models, and pieces of the user-defined and unused types, are
refused.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model format: the sign of white space, and types of pieces and models.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE, BPE = 1, 2, 3, 4, 5, 6, 2
_CACHE, _BLOCK, _LONG, _SCANNED = 300_000, 1 << 18, 64, 48
_KINDS = 8
_WORST = float("inf")


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message, in order; nested messages are bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 keys, and replaced strings.

    A unit of the trie holds its label in the low eight bits (and the top one, set in
    values), bit eight tells that a key ends there, bits ten on are the offset to its
    children, shifted by eight more if bit nine is set.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.array = np.frombuffer(blob, "<u4", size // 4, 4)
        self.units: list[int] = self.array.tolist()
        self.strings = blob[4 + size :]
        alone, leading, second = set(), set(), set()
        for c, node, ends in self._characters(0):
            if ends:
                alone.add(c)
            following = {d for d, _, _ in self._characters(node)}
            if following:
                leading.add(c)
                second |= following
        listed = lambda chars: "".join(map(re.escape, sorted(chars)))
        found = [f"[{listed(alone)}]"] if alone else []
        if leading:
            found.append(f"[{listed(leading)}](?=[{listed(second)}])")
        #: Matches wherever a key can begin; what it skips stays as it is.
        self.begins = re.compile("|".join(found) or r"(?!)")

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _characters(self, node: int) -> Iterator[tuple[str, int, bool]]:
        """(character, its node, whether a key ends there) of the characters that may follow a node."""
        stack = [(node, b"")]
        while stack:
            at, head = stack.pop()
            places = self._base(at) ^ np.arange(1, 256)
            places = places[places < len(self.units)]
            labels = places ^ self._base(at)
            for place in places[(self.array[places] & 0x800000FF) == labels].tolist():
                whole = head + bytes([place ^ self._base(at)])
                try:
                    yield whole.decode(), place, bool(self.units[place] & 256)
                except UnicodeDecodeError:
                    if len(whole) < 4:
                        stack.append((place, whole))

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """(characters, replacement) of the longest key that is a prefix of text[at:]."""
        units, node, key, found = self.units, 0, 0, None
        for i in range(at, len(text)):
            for byte in text[i].encode("utf-8", "replace"):
                node = self._base(node) ^ byte
                if node >= len(units) or units[node] & 0x800000FF != byte:
                    return found
            key += 1
            if units[node] & 256:
                start = units[self._base(node)] & 0x7FFFFFFF
                found = (key, self.strings[start : self.strings.index(0, start)].decode())
        return found


class Runs:
    """Where the characters of a normalised text come from: runs of them, in source characters."""

    def __init__(self):
        self.parts: list[str] = []
        self.length, self.at, self.source, self.slope = 0, [], [], []

    def add(self, out: str, source: int, verbatim: bool) -> None:
        self.at.append(self.length)
        self.source.append(source)
        self.slope.append(int(verbatim))
        self.parts.append(out)
        self.length += len(out)

    def finish(self, consumed: int) -> tuple[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.add("", consumed, False)
        return "".join(self.parts), tuple(np.array(x, np.int64) for x in (self.at, self.source, self.slope))


class PieceModel:
    """Pieces, scores, normaliser and flags, from the bytes of a model file."""

    def __init__(self, data: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, value in message(data):
            if field == 1:
                own = dict(message(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif field == 2:
                trainer |= dict(message(value))
            elif field == 3:
                normaliser |= dict(message(value))
            elif field == 5 and dict(message(value)).get(2):
                raise ValueError("models that change texts again after decoding are not supported")
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != BPE or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("a BPE model without user-defined and unused pieces is needed")
        self.map = CharacterMap(normaliser[2]) if normaliser.get(2) else None
        self.prefix, self.trim, self.escape = (bool(normaliser.get(n, 1)) for n in (3, 4, 5))
        self.suffix, self.fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.sign = SPACE if self.escape else " "
        self.rank = {p: -score for p, score, kind in pieces if kind == NORMAL}
        self.packed = {p: i.to_bytes(4, "little") for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.end = next((i for i, (p, _, _) in enumerate(pieces) if p == trainer.get(47, b"</s>").decode()), -1)
        self.byte_ids = [0] * 256
        kind_of = np.array([kind for _, _, kind in pieces])
        value_of = np.zeros(len(pieces), np.int64)
        unknown = trainer.get(44, " ⁇ ".encode())
        self.surface: list[bytes] = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                value_of[i] = int(p[1:-1], 16)
                self.byte_ids[value_of[i]] = i
            self.surface.append(
                b"" if kind == CONTROL else unknown if kind == UNKNOWN else bytes([value_of[i]]) if kind == BYTE else p.replace(SPACE, " ").encode()
            )
        self.decimal = [str(i) for i in range(len(pieces))]
        self.is_byte = kind_of == BYTE
        self.is_rest = self.is_byte & (value_of >> 6 == 2)
        self.begins_blank = np.array([kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces])
        self.is_control = kind_of == CONTROL
        self.characters = np.array([1 if kind == UNKNOWN else 0 if kind in (CONTROL, BYTE) else len(p) for p, _, kind in pieces], np.int64)
        self.words = re.compile(self._stretches())
        self.known = _Words(self)

    def _stretches(self) -> str:
        """A pattern that parts normalised texts where no merge can join.

        A merge needs a piece that has the two characters at the border side by side.
        Characters that pieces have side by side, directly or through others, are of one
        kind; a stretch is of one kind, with signs of white space before it.
        """
        if not self.escape or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.packed):
            return r"[\s\S]+"
        kind: dict[str, str] = {}

        def of(c: str) -> str:
            while kind.setdefault(c, c) != c:
                c = kind[c]
            return c

        for p in self.packed:
            for a, b in itertools.pairwise(p.lstrip(SPACE)):
                kind[of(a)] = of(b)
        groups: dict[str, list[str]] = {}
        for c in sorted(kind):
            groups.setdefault(of(c), []).append(c)
        parts = sorted(groups.values(), key=len, reverse=True)
        # rare kinds may as well be one
        parts = [*parts[:_KINDS], sum(parts[_KINDS:], [])] if len(parts) > _KINDS else parts
        classes = ["".join(map(re.escape, part)) for part in parts]
        return "|".join([*(f"{SPACE}*[{c}]+" for c in classes), f"{SPACE}*[^{SPACE}{''.join(classes)}]", f"{SPACE}+"])

    # --- normalisation

    def _units(self, text: str) -> Iterator[tuple[str, int, int, bool]]:
        """(output, source start, source characters, verbatim) of a text's parts, in order."""
        if self.map is None:
            yield text, 0, len(text), True
            return
        at, search = 0, 0
        while m := self.map.begins.search(text, search):
            found = self.map.longest(text, m.start())
            if found is None:
                search = m.start() + 1
                continue
            if m.start() > at:
                yield text[at : m.start()], at, m.start() - at, True
            yield found[1], m.start(), found[0], False
            at = search = m.start() + found[0]
        if at < len(text):
            yield text[at:], at, len(text) - at, True

    def _trimmed(self, text: str) -> Iterator[tuple[str, int, int, bool]]:
        """_units() with runs of blanks cut to one, none at the beginning."""
        blank = True
        for out, source, size, verbatim in self._units(text):
            if not verbatim:
                out = out.lstrip(" ") if blank else out
                if out:
                    blank = out.endswith(" ")
                    yield out, source, size, False
                continue
            for m in re.finditer(" +|[^ ]+", out):
                if m[0][0] != " ":
                    blank = False
                    yield m[0], source + m.start(), len(m[0]), True
                elif not blank:
                    blank = True
                    yield " ", source + m.start(), 1, True

    def normalise(self, text: str) -> tuple[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The normalised text, and the runs (first character, source character, slope) it is made of."""
        runs, sign = Runs(), self.sign
        units = self._trimmed(text) if self.trim else self._units(text)
        first = next(units, None) if text else None
        if first is None:  # nothing, or blanks alone
            return runs.finish(len(text))
        if self.prefix and not self.suffix:
            runs.add(sign, first[1] if self.trim else 0, False)
        for out, source, _, verbatim in itertools.chain([first], units):
            if out:
                runs.add(out.replace(" ", sign), source, verbatim)
        consumed = len(text)
        if self.trim:
            while runs.parts and (not runs.parts[-1] or runs.parts[-1].endswith(sign)):
                if runs.parts[-1]:
                    runs.parts[-1] = runs.parts[-1][: -len(sign)]
                    runs.length -= len(sign)
                    consumed = runs.source[-1] + runs.slope[-1] * len(runs.parts[-1])
                if not runs.parts[-1]:
                    for x in (runs.parts, runs.at, runs.source, runs.slope):
                        x.pop()
        if self.prefix and self.suffix:
            runs.add(sign, consumed, False)
        return runs.finish(consumed)

    # --- merging

    def encode_word(self, word: str) -> bytes:
        """The ids of a stretch of normalised text, as little-endian 32-bit integers."""
        parts = self._merged_short(list(word)) if len(word) <= _SCANNED else self._merged_long(list(word))
        try:
            return b"".join([self.packed[p] for p in parts])
        except KeyError:
            return b"".join([self.packed.get(p) or self._unknown(p) for p in parts])

    def _unknown(self, character: str) -> bytes:
        ids = [self.byte_ids[b] for b in character.encode("utf-8", "replace")] if self.fallback else [self.unknown]
        return np.array(ids, "<i4").tobytes()

    def _merged_short(self, parts: list[str]) -> list[str]:
        rank, worst = self.rank.get, _WORST
        ranks = [rank(a + b, worst) for a, b in itertools.pairwise(parts)]
        while ranks and (best := min(ranks)) != worst:
            i = ranks.index(best)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, worst)
            if i < len(ranks):
                ranks[i] = rank(joined + parts[i + 1], worst)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap: n log n for stretches without a blank."""
        rank, size = self.rank.get, len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, 2) for i in range(size - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = after[i]
            if j >= size or not parts[i] or len(parts[i]) + len(parts[j]) != length:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size and (r := rank(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def encode(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of a text in blocks; `ends` are the source bytes at which the pieces end.

        A piece begins where the one before it ends. Of the bytes of an unknown character
        the last one has the whole span. Unknown characters in a row are one piece.
        """
        normal, runs = self.normalise(text)
        at, source, slope = runs
        sources = _byte_places(text)
        found = self.words.finditer(normal) if len(normal) > _BLOCK else None
        words = (m[0] for m in found) if found else iter(self.words.findall(normal))
        done = 0
        for ids, sizes in self._joined_unknown(self._sized(words)):
            places = done + np.cumsum(sizes)
            done = int(places[-1])
            run = np.searchsorted(at, places, "right") - 1
            found = source[run] + slope[run] * (places - at[run])
            yield ids, found if sources is None else sources[found]

    def _sized(self, words: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, characters of each) of a text's stretches, in blocks."""
        while part := b"".join(map(self.known.__getitem__, itertools.islice(words, _BLOCK >> 2))):
            ids = np.frombuffer(part, "<i4")
            sizes = self.characters[ids]
            last = self.is_byte[ids]
            last[:-1] &= ~self.is_rest[ids[1:]]
            sizes[last] = 1
            yield ids, sizes

    def _joined_unknown(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The blocks with unknown characters in a row as one piece, also across blocks."""
        if self.fallback:
            yield from blocks
            return
        held = 0  # characters of the unknown piece that the last block ended with
        for ids, sizes in blocks:
            unknown = ids == self.unknown
            if held:
                ids, sizes, unknown = np.append([self.unknown], ids), np.append([held], sizes), np.append([True], unknown)
            firsts = np.flatnonzero(~unknown | ~np.append([False], unknown[:-1]))
            ids, sizes = ids[firsts], np.add.reduceat(sizes, firsts)
            held = int(sizes[-1]) if ids[-1] == self.unknown else 0
            if held:
                ids, sizes = ids[:-1], sizes[:-1]
            if len(ids):
                yield ids, sizes
        if held:
            yield np.array([self.unknown]), np.array([held])

    # --- decoding

    def decode(self, blocks: Iterator[np.ndarray]) -> Iterator[bytes]:
        """The UTF-8 of the text that ids stand for, block by block; a block must not end within a character.

        The blank that the dummy prefix has made goes; with trimming, so do all that lead.
        """
        leading = self.prefix or self.trim
        for ids in blocks:
            if leading:
                for i, x in enumerate(ids.tolist()):
                    blank = bool(self.begins_blank[x])
                    if not self.is_control[x] and not (self.trim and blank and self.surface[x] == b" "):
                        if blank:
                            yield self.surface[x][1:]
                        ids, leading = ids[i + blank :], False
                        break
                else:
                    continue
            yield self._surfaces(ids)

    def _surfaces(self, ids: np.ndarray) -> bytes:
        out = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if not self.is_control[ids[:-1]].any():  # these part the bytes of a character
            try:
                out.decode()
                return out
            except UnicodeDecodeError:
                pass
        parts = []
        for is_byte, group in itertools.groupby(ids.tolist(), lambda i: bool(self.is_byte[i])):
            part = b"".join(map(self.surface.__getitem__, group))
            parts.append(_replaced(part) if is_byte else part)
        return b"".join(parts)


class _Words(dict):
    """stretch of text -> its packed ids; when full, what is in it becomes the old part."""

    def __init__(self, model: PieceModel):
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self.model.encode_word(word)
        if len(word) <= _LONG:
            if len(self) >= _CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _byte_places(text: str) -> np.ndarray | None:
    """The byte at which each character of a text begins, and its end; None where they are the same."""
    if text.isascii():
        return None
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))


def _replaced(data: bytes) -> bytes:
    """UTF-8 with each byte that belongs to no valid character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                data[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            if size <= len(data) - at:
                out.append(data[at : at + size])
                at += size
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encode(docs: DataFrame, model_file: bytes, with_pieces: bool = False, end_id: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (and ids, starts, ends) of each row's whole text.

    `model_file` holds a model file's bytes. The ids of a text are followed by the end id
    unless `end_id` is false. ids_sha256 is of decimal ids joined by one space,
    decoded_sha256 of the text that they decode to, spans_sha256 of the pieces' ends in source
    bytes, as little-endian 64-bit integers; `starts` and `ends` are these spans, the end id's
    is empty. A null text counts as empty. Repeated rows each come out, an empty table gives
    no rows, other columns are ignored. Ids are made, hashed and decoded in blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        tail = [(np.array([model.end], "<i4"), None)] if end_id else []
        for b in batches:
            counts, digests, kept = [], ([], [], []), ([], [])
            for t in b.column("text"):
                text, n, last = t.as_py() or "", 0, 0
                ids_hash, text_hash, ends_hash, own_ids, own_ends = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), [], []

                def blocks(text=text, ids_hash=ids_hash, ends_hash=ends_hash, own_ids=own_ids, own_ends=own_ends):
                    nonlocal n, last
                    for ids, ends in itertools.chain(model.encode(text), tail):
                        ends = np.full(len(ids), last) if ends is None else ends
                        ids_hash.update(((" " if n else "") + " ".join(map(model.decimal.__getitem__, ids.tolist()))).encode())
                        ends_hash.update(ends.astype("<i8").tobytes())
                        n, last = n + len(ids), int(ends[-1])
                        if with_pieces:
                            own_ids.append(ids)
                            own_ends.append(ends)
                        yield ids

                for part in model.decode(blocks()):
                    text_hash.update(part)
                counts.append(n)
                for to, h in zip(digests, (ids_hash, text_hash, ends_hash), strict=True):
                    to.append(h.hexdigest())
                if with_pieces:
                    for to, parts in zip(kept, (own_ids, own_ends), strict=True):
                        to.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(d, pa.string()) for d in digests)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
            if with_pieces:
                starts = [np.append(0, e[:-1]) if len(e) else e for e in kept[1]]
                columns += [pa.array(kept[0], pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(kept[1], pa.list_(pa.int64()))]
                names += ["ids", "starts", "ends"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED + (", ids array<int>, starts array<long>, ends array<long>" if with_pieces else ""))


def decode(rows: DataFrame, model_file: bytes) -> DataFrame:
    """doc_id, text of rows of doc_id and ids; null ids give a null text, ids that the model lacks are an error."""
    shared = rows.sparkSession.sparkContext.broadcast(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in batches:
            texts = [
                None if ids is None else b"".join(model.decode(iter([np.array(ids, np.int64)]))).decode("utf-8", "replace")
                for ids in b.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


_LOADED: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """One model for each worker process and file."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(data)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    """The bytes of a model file on the driver's machine; they are broadcast, not shipped."""
    with open(path, "rb") as f:
        return f.read()


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))
