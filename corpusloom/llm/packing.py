"""Harmonic packing of token sequences.

Lengths fall into classes by reciprocal capacity: class k takes lengths in (capacity / (k + 1),
capacity / k] and puts exactly k of them into each of its bins. A document longer than the capacity
gives whole sequences first; what is left of it stays in one piece and goes to its class. A bin that
has its k documents may have room left: where that is MIN_PIECE tokens or more, a later document goes
there, whole if it fits, else its first tokens do and the rest of it goes to its class. At its end a
worker chains what is in its open bins, and gives the last tokens in sequences of a power of two.

Bins of one class and worker depend on nothing else, so workers share nothing and a task that is run
again makes the same bins. Less than MIN_PIECE tokens of a sequence are padding (room that only short
documents could have filled is closed beyond MAX_ROOMS such bins); a document is cut once at most,
besides at every capacity.
"""

from __future__ import annotations

import bisect
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

CAPACITY = 2048
#: The id that ends a document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Room that is filled by cutting a document, and the shortest piece that is cut off; bins with room that a worker keeps.
MIN_PIECE, MAX_ROOMS = 32, 64
#: Words whose ids a worker keeps, and the longest of them in bytes: 200 MB at most.
MEMO_WORDS, MEMO_BYTES = 700_000, 48
#: Bits of a sequence id below those of the partition.
_LOCAL = 40
#: Rows of a result batch.
OUT_ROWS = 20_000


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """k with capacity / (k + 1) < length <= capacity / k; documents of a bin of this class."""
    return capacity // length


def powers(length: int) -> list[int]:
    """The powers of two that add up to length, the largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Bins of one worker. Pieces are lists [start, length, sequence, offset, *the document's values]: add()
    takes a document's length and values and returns the pieces that are settled, finish() the others.
    Sequences are numbered from first on."""

    def __init__(self, first: int, capacity: int = CAPACITY, least: int = MIN_PIECE):
        if least < 1 or capacity < 2 * least:
            raise ValueError("a piece must be a token at least and half the capacity at most")
        self.capacity, self.least, self.next = capacity, least, first
        self.open: dict[int, list[list]] = {}  # of a class: pieces of its open bin
        self.rooms: list[tuple[int, int]] = []  # (room, sequence) of bins that have their k documents, sorted

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _room(self, room: int, seq: int) -> None:
        if room >= self.least:
            bisect.insort(self.rooms, (room, seq))
            if len(self.rooms) > MAX_ROOMS:
                self.rooms.pop(0)

    def add(self, length: int, values: tuple = ()) -> list[list]:
        out, start, cap = [], 0, self.capacity
        while length - start >= cap:
            out.append([start, cap, self._new(), 0, *values])
            start += cap
        rest = length - start
        if not rest:
            return out
        if self.rooms:
            at = bisect.bisect_left(self.rooms, (rest, -1))
            if at < len(self.rooms):  # whole, into the smallest room that holds it
                room, seq = self.rooms.pop(at)
                self._room(room - rest, seq)
                return [*out, [start, rest, seq, cap - room, *values]]
            room, seq = self.rooms[-1]
            cut = min(room, rest - self.least)  # what is left of the document is a piece too
            if cut >= self.least and room - cut < self.least:
                self.rooms.pop()
                out.append([start, cut, seq, cap - room, *values])
                start, rest = start + cut, rest - cut
        k = class_of(rest, cap)
        held = self.open.setdefault(k, [])
        held.append([start, rest, -1, sum(p[1] for p in held), *values])
        if len(held) == k:
            seq = self._new()
            for piece in held:
                piece[2] = seq
            self._room(cap - held[-1][3] - rest, seq)
            out += self.open.pop(k)
        return out

    def finish(self) -> Iterator[list]:
        """The pieces of open bins, chained and cut: full sequences, then powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(p[1] for p in left)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        self.open = {}
        size, used, seq = 0, 0, -1
        for piece in left:
            at = 0
            while at < piece[1]:
                if used == size:
                    size, used, seq = sizes.pop(0), 0, self._new()
                n = min(piece[1] - at, size - used)
                yield [piece[0] + at, n, seq, used, *piece[4:]]
                at, used = at + n, used + n


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by a word memo in front of the tokenizer.

    White space separates words in this tokenizer and is dropped, so a text's ids are those of its
    words one after another. A-Z may be lower-cased beforehand, as the tokenizer does, unless the text
    could hold a special token's name. Words of plain Latin letters go to the merge model directly, a
    stop or comma after them being a word of its own; all others go through the whole tokenizer.
    """

    _LATIN = re.compile("[a-zß-öø-ÿ]+")
    _BIG = {c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memo: dict[bytes, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.spell = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.plain = self._agree()

    def _agree(self) -> bool:
        """Whether words of letters may go to the model directly in this tokenizer."""
        sample = ["hello", "straße", "élan", "ñandú", "z", "antidisestablishment", "øre"]
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as little-endian 32-bit numbers")
        return all(self._direct(w) == self._through(w) for w in sample) and self._through("hello.") == self._direct("hello") + self._through(".")

    def _direct(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.spell.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _through(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def _word(self, raw: bytes) -> bytes:
        if self.plain:
            body, tail = (raw[:-1], raw[-1:]) if raw[-1] in b".," else (raw, b"")
            if body.isalpha():  # of ASCII letters
                text = body.decode().lower()
            else:
                text = body.decode().translate(self._BIG)
                if not self._LATIN.fullmatch(text):
                    return self._through(raw.decode())
            if not tail:
                return self._direct(text)
            known = self.memo.get(body)
            return (self._keep(body, self._direct(text)) if known is None else known) + (self.memo.get(tail) or self._keep(tail, self._through(tail.decode())))
        return self._through(raw.decode())

    def _keep(self, raw: bytes, ids: bytes) -> bytes:
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[raw] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        data = text.encode("utf-8", "replace")
        chunks = (data if b"<|" in data else data.lower()).split()
        try:
            return b"".join(map(self.memo.__getitem__, chunks))
        except KeyError:
            memo = self.memo
            return b"".join([memo[c] if c in memo else self._keep(c, self._word(c)) for c in chunks])


#: Each Python worker keeps one encoder for a file.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    tokenizer is the path of a tokenizers file, on every machine. A null or empty text is the end id
    alone; texts of any length are packed whole, their ids are held by one task. Repeated rows are packed each; other columns are not looked at; an empty table gives no
    rows. Sequence ids hold the partition above the worker's own count, so they are unique; a task
    that is run again over the same rows gives the same pieces. A worker holds the ids of the
    documents in its open bins: less than k pieces of capacity / k tokens for each class k.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << _LOCAL, capacity)
        enc = encoder(tokenizer)
        key_type = None
        ready: list[tuple] = []

        def row(start: int, n: int, seq: int, offset: int, key, data: bytes, tokens: int) -> tuple:
            piece = data[4 * start : 4 * (start + n)]
            return (key, start, n, zlib.crc32(piece), tokens, seq, offset, *([piece] if with_ids else []))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), [key_type, *[k for _, k in fields]])]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", *[n for n, _ in fields]])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, value in zip(batch.column(0), batch.column(1)):
                data = enc.ids(value.as_py()) + end
                tokens = len(data) // 4
                for piece in packer.add(tokens, (key.as_py(), data, tokens)):
                    ready.append(row(*piece))
            while len(ready) >= OUT_ROWS:
                yield batch_of(ready[:OUT_ROWS])
                ready = ready[OUT_ROWS:]
        ready += [row(*piece) for piece in packer.finish()]
        while ready:
            yield batch_of(ready[:OUT_ROWS])
            ready = ready[OUT_ROWS:]

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
