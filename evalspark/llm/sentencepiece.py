"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding searches instead of merging. A sequence of pieces is the encoding of its text
exactly when merging the text of every two neighbours gives these two pieces again, so:

1. Aho-Corasick over the reversed pieces gives the longest piece that begins at each place.
2. The search takes it, or the next shorter piece that is its prefix, if it is compatible
   with the piece before (``Merges.apart``: the pair's text is merged anew, once per pair).
3. Where nothing fits, the place is marked in a bitfield of failed positions, the last piece
   is taken back and shortened. An encoding up to a place is unique, so a place that failed
   once has failed for good and is not tried again: work is linear in the text.

Merging cannot cross two neighbouring characters that no piece has inside, so texts are cut
there first (in the usual vocabularies: before word signs), and a cut text is searched once
per task while it is remembered (``KEPT`` entries). Documents are encoded in one scan
without a shuffle. The vocabulary, a few ten thousand pieces, is read from ``path`` on the
driver and broadcast.

Defined cases: a null or empty text has no ids and decodes to an empty text; characters
without a piece become byte pieces; equal scores are merged from the left. Rows are taken
one by one, so repeats, ties and null ids are kept. All columns are carried whatever their
names; the name of the added column is a parameter and must be new.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalspark.llm.words import bounded_batches, give_back

PATH = "/opt/tokenizers/piece_bpe_32k.model"
KEPT = 300_000
# Pairs of pieces remembered.
PAIRS = 1_000_000
# Cut texts beyond this many characters are searched each time.
LONG = 64

# Fixed values of the public model format: the word sign, kinds of pieces, the sign for what is no text.
SIGN = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
UNKNOWN_TEXT = " ⁇ "
BROKEN = "�"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
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
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def read_model(path: str = PATH) -> list[tuple[str, float, int]]:
    """``(piece, score, kind)`` by id. Only what ``encode`` is made for is taken: merge type,
    byte pieces, no rewriting of characters, white space kept, a word sign put in front."""
    with open(path, "rb") as file:
        parts = list(fields(file.read()))
    pieces = []
    for number, part in parts:
        if number == 1:
            got = dict(fields(part))
            pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
    trainer = dict(fields(next((p for n, p in parts if n == 2), b"")))
    normal = dict(fields(next((p for n, p in parts if n == 3), b"")))
    kinds = {kind for _, _, kind in pieces}
    if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or kinds & {USER_DEFINED, UNUSED}:
        raise ValueError(f"{path}: only merge-type models with byte pieces and without user-defined pieces can be used")
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError(f"{path}: only models that keep the text and put a word sign in front can be used")
    return pieces


class Merges:
    """The merge rule itself: of neighbours whose joint text is a piece, the best score first,
    of equal scores the first from the left."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def merged(self, text: str, halves: list[str] | None = None) -> list[str]:
        """The pieces of ``text``; ``halves`` gets the two that were merged last, if all became one."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(parts):
                both = parts[left] + parts[after[left]]
                if both in self.scores:
                    heapq.heappush(queue, (-self.scores[both], left, both))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, left, both = heapq.heappop(queue)
            right = after[left]
            if parts[left] is None or right >= len(parts) or parts[left] + parts[right] != both:
                continue
            if halves is not None:
                halves[:] = parts[left], parts[right]
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [p for p in parts if p is not None]

    def learn(self, usable: list[str]) -> None:
        """The last merge of each piece, and its turn among all merges (characters: before all)."""
        by_score = sorted(set(self.scores.values()), reverse=True)
        turn = {score: i for i, score in enumerate(by_score)}
        counted = Counter(score for piece, score in self.scores.items() if len(piece) > 1)
        self.turn = {piece: turn[score] for piece, score in self.scores.items()}
        self.tied = {piece for piece in self.scores if len(piece) > 1 and counted[self.scores[piece]] > 1}
        self.halves: dict[str, list[str]] = {}
        for piece in usable:
            if len(piece) > 1:
                self.merged(piece, halves := [])
                self.halves[piece] = halves

    def apart(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when their text is merged anew.

        Their merges are taken back from the border, the latest first: the two parts that met
        there must not have had a merge of their own before the one taken back. Of equal pieces
        the right one is merged later, and a merge across the border is further left than it.
        """
        if left in self.tied or right in self.tied:
            return self.merged(left + right) == [left, right]
        scores, turn, halves = self.scores, self.turn, self.halves
        until = len(turn) + 1
        while True:
            both = left + right
            if both in scores and (turn[both] < until):
                return False
            a = turn[left] if len(left) > 1 else -1
            b = turn[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                until, left = a, halves[left][1]
            else:
                until, right = b + 1, halves[right][0]


class Encoder:
    """Encoding of texts by backtracking, and decoding of ids."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        byte = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [byte[b] for b in range(256)]
        self.merges = Merges({piece: pieces[i][1] for piece, i in self.ids.items()})
        # Pieces that were found to fit behind a piece, or not.
        self.fits: dict[str | None, dict[str, bool]] = {}
        self.n_fits = 0
        chars = {c for piece in self.ids for c in piece}
        # A piece that merging its own text does not give is never in an encoding.
        usable = [p for p in self.ids if len(p) == 1 or self.merges.merged(p) == [p]] + [c for c in chars if c not in self.ids]
        self.merges.learn(usable)
        self.machine = ahocorasick.Automaton()
        for piece in usable:
            self.machine.add_word(piece[::-1], piece)
        self.machine.make_automaton()
        self.whole = frozenset(usable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None) for p in usable}
        alone = "".join(re.escape(chr(c)) for c in range(256) if chr(c) not in chars and chr(c) != " ")
        alone = f"[{alone}]|" if alone else "", alone
        crossing = any(SIGN in p.lstrip(SIGN) for p in self.ids)
        body = f"[^{alone[1]}]+" if crossing else f"{SIGN}*[^{SIGN}{alone[1]}]+|{SIGN}+"
        self.cuts = re.compile(alone[0] + body, re.S)
        self.known: dict[str, bytes] = {}
        # What a piece adds to a decoded text; bytes are gathered apart.
        self.plain = [p.replace(SIGN, " ") if kind == NORMAL else UNKNOWN_TEXT if kind == UNKNOWN else "" for p, _, kind in pieces]
        self.raw = {i: b for b, i in byte.items()}
        self.pieces = pieces
        # Other ids part runs of bytes: a byte that no text has sends them the long way.
        self.fast = [
            bytes([self.raw[i]]) if kind == BYTE else self.plain[i].encode() if kind == NORMAL else b"\xff"
            for i, (_, _, kind) in enumerate(pieces)
        ]

    def search(self, text: str) -> list[str]:
        """Pieces (or characters without one) of a text that holds no place where it must be cut."""
        if text in self.whole:
            return [text]
        size, shorter, fits = len(text), self.shorter, self.fits
        # Matches that end at a place of the reversed text come longest first: it has to be set last.
        longest = dict(list(self.machine.iter(text[::-1]))[::-1])
        taken: list[str | None] = [None]
        failed, any_failed = None, False
        at, last, piece = 0, None, longest.get(size - 1) or text[0]
        here = self.behind(None)
        while at < size:
            while piece is not None:
                end = at + len(piece)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    fit = here.get(piece)
                    if fit is None:
                        fit = here[piece] = last is None or self.merges.apart(last, piece)
                        self.n_fits += 1
                    if fit:
                        break
                piece = shorter.get(piece)
            if piece is not None:
                taken.append(piece)
                at, last = end, piece
                here = fits.get(last)
                if here is None:
                    here = self.behind(last)
                if at < size:
                    piece = longest.get(size - 1 - at) or text[at]
            elif last is not None:
                if not any_failed:
                    failed, any_failed = bytearray(size // 8 + 1), True
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(last)
                piece = shorter.get(taken.pop())
                last = taken[-1]
                here = self.behind(last)
            else:
                raise ValueError("the vocabulary's merges do not give a unique encoding")
        return taken[1:]

    def behind(self, piece: str | None) -> dict[str, bool]:
        if self.n_fits > PAIRS:
            self.fits.clear()
            self.n_fits = 0
        return self.fits.setdefault(piece, {})

    def _found(self, text: str) -> bytes:
        pieces = self.search(text)
        try:
            return array("i", [self.ids[p] for p in pieces]).tobytes()
        except KeyError:
            ids = ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode("utf-8", "replace")] for p in pieces)
            return array("i", chain.from_iterable(ids)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        if not text:
            return b""
        cut = self.cuts.findall(SIGN + text.replace(" ", SIGN))
        known = self.known
        try:
            return b"".join([known[c] for c in cut])
        except KeyError:
            pass
        if len(known) > KEPT:
            known.clear()
        parts = []
        for c in cut:
            ids = known.get(c)
            if ids is None:
                ids = self._found(c)
                if len(c) <= LONG:
                    known[c] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, word signs as spaces, the one in front left out; bytes that are no text
        as one sign each."""
        if ids and self.plain[ids[0]][:1] == " " and self.pieces[ids[0]][2] == NORMAL:
            # No byte begins inside another piece, so if all are valid together, each run is.
            try:
                return b"".join([self.fast[i] for i in ids])[1:].decode()
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        run = bytearray()
        front = True
        for i in [*ids, None]:
            if i in self.raw:
                run.append(self.raw[i])
                front = False
                continue
            if run:
                out.append(lenient(bytes(run)))
                run.clear()
            if i is None:
                break
            text = self.plain[i]
            if front and text:
                front = False
                if self.pieces[i][2] == NORMAL and text[0] == " ":
                    text = text[1:]
            out.append(text)
        return "".join(out)


def lenient(data: bytes) -> str:
    """UTF-8 with one sign for each byte that is not part of a character."""
    out = []
    while data:
        try:
            return "".join(out) + data.decode()
        except UnicodeDecodeError as error:
            out.append(data[: error.start].decode() + BROKEN)
            data = data[error.start + 1 :]
    return "".join(out)


def lists(column: pa.ListArray) -> Iterator[list[int]]:
    """Its lists, null as empty, without an object per value in between."""
    if column.null_count:
        yield from (x or [] for x in column.to_pylist())
        return
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(ends[:-1], ends[1:]):
        yield values[a:b].tolist()


# The encoder of a worker process, kept between its tasks.
_LAST: list = [None, None]


def encoder(pieces: list[tuple[str, float, int]]) -> Encoder:
    mark = hash(tuple(pieces))
    if _LAST[0] != mark:
        _LAST[:] = [mark, Encoder(pieces)]
    return _LAST[1]


def _added(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {name} is there already: give another name")
    return T.StructType([*docs.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = PATH) -> DataFrame:
    """The rows of ``docs`` with the ids of column ``text`` in the new column ``out``."""
    bounded_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(path))
    at = docs.columns.index(text)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(pieces.value)
        for batch in found:
            ids = [coder.encode(t or "") for t in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            column = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])
        give_back()

    return docs.mapInArrow(batches, _added(docs, out, T.ArrayType(T.IntegerType())))


def decode(coded: DataFrame, ids: str = "ids", out: str = "decoded", path: str = PATH) -> DataFrame:
    """The rows of ``coded`` with the text of column ``ids`` in the new column ``out``; null: empty."""
    bounded_batches(coded.sparkSession)
    pieces = coded.sparkSession.sparkContext.broadcast(read_model(path))
    at = coded.columns.index(ids)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(pieces.value)
        for batch in found:
            column = pa.array([coder.decode(x) for x in lists(batch.column(at))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])
        give_back()

    return coded.mapInArrow(batches, _added(coded, out, T.StringType()))
