"""SentencePiece encoding and decoding over distinct chunks.

No piece of the model runs on past a whitespace marker, nor from a letter to a sign that stands beside no
letter in any piece, so a text's pieces are those of its chunks: words with the markers before them, and
signs. Each distinct chunk is segmented once, whatever the number of texts that hold it, and its ids are
put back by position.

Which chunks are frequent is learnt from SAMPLE_ROWS texts; HEAD_ROWS of them at most are segmented and
broadcast. This choice bears on cost alone: any other chunk is sent, once a text, to the one task of that
chunk, which segments it and sends its ids to the texts. A text itself travels as numbers of its chunks,
and meets those ids in one shuffle. Chunks of the tail are rare by the choice of the head; those that are
too long for the head are salted.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, named, numbered, release, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Texts from which the head is chosen, about.
SAMPLE_ROWS = 20_000
#: Chunks that are broadcast, at most, and the longest of them in bytes: about 80 MB in a worker.
HEAD_ROWS, HEAD_BYTES = 300_000, 48
#: Words, with their signs, whose chunks a worker keeps: about 50 MB.
MEMO_WORDS = 200_000
#: Chunks that a task counts before it hands its counts on, and the bytes of them.
COUNTED_ROWS, COUNTED_BYTES = 400_000, 32 << 20
#: A chunk too long for the head has so many tasks.
LONG_SHARES = 16
#: Bytes of chunks or numbers that make a batch.
OUT_BYTES = 1 << 20
#: A place within a text, below the text's place in its file: more than a cell of 2 GB can hold chunks.
AT_BITS = 28


class Codec:
    """A model whose pieces allow segmenting by chunks; others are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        rules, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        pieces = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if not plain or spec.trainer_spec.treat_whitespace_as_suffix or spec.trainer_spec.model_type != spec.trainer_spec.BPE or any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("the model must leave texts as they are, mark spaces before words, merge pairs and have no pieces of the user's")
        if any(MARK in p.lstrip(MARK) for p in pieces) or MARK not in pieces:
            raise ValueError("a piece of the model crosses a whitespace marker")
        # single signs stand beside nothing in any piece; others may stand beside each other and markers only
        beside = {pair for p in pieces for pair in zip(p, p[1:])}
        signs = {c for c in {*map(chr, range(128)), *"".join(pieces)} if not c.isalpha() and c not in (MARK, " ")}
        single = sorted(s for s in signs if not any(s in pair for pair in beside))
        apart = signs.difference(single)
        while crossed := {s for a, b in beside for s, other in ((a, b), (b, a)) if s in apart and other != MARK and other not in apart}:
            apart -= crossed
        if not single:
            raise ValueError("the model has no sign that stands apart from all others")
        self.lead, self.led = single[0], len(self.model.encode(single[0], num_threads=1))
        one, some = re.escape("".join(single)), re.escape("".join(sorted(apart)))
        self.chunk = re.compile(f"[{one}]|{MARK}*[^{MARK}{one}{some}]+" + (f"|{MARK}*[{some}]+" if some else "") + f"|{MARK}+")
        self.kind = np.uint16 if self.model.get_piece_size() <= 1 << 16 else np.int32  # of ids between tasks
        self.pieces = [None if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) else self.model.id_to_piece(i).replace(MARK, " ") for i in range(self.model.get_piece_size())]

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunk: str) -> bytes:
        """Its ids within a text."""
        if chunk[0] == MARK and chunk != MARK:  # encode() puts the first marker there itself
            ids = self.model.encode(chunk[1:], num_threads=1)
        else:
            ids = self.model.encode(self.lead + chunk, num_threads=1)[self.led :]
        return np.asarray(ids, self.kind).tobytes()

    def said(self, ids: bytes) -> str:
        """What the ids of a chunk decode to within a text. Bytes of a character never lie in two chunks."""
        found = [self.pieces[i] for i in np.frombuffer(ids, self.kind).tolist()]
        if None not in found:
            return "".join(found)
        return self.model.decode([*self.model.encode(self.lead, num_threads=1), *np.frombuffer(ids, self.kind).tolist()])[1:]


@functools.cache
def codec(path: str | None = None) -> Codec:
    """By default the public tokenizers' model, looked up on the machine where it is used."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return Codec(path)


def _count(model: str | None) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, seen, size = codec(model).chunks, Counter(), 0

        def told() -> pa.RecordBatch:
            short = {c: n for c, n in seen.items() if len(c.encode()) <= HEAD_BYTES}
            seen.clear()
            return pa.RecordBatch.from_pydict({"chunk": pa.array(short.keys(), pa.string()), "n": pa.array(short.values(), pa.int64())})

        for batch in batches:
            for text in (t.as_py() for t in batch.column(0)):
                seen.update(chunks(text or ""))
                size += len(text or "")
                if len(seen) > COUNTED_ROWS or size > COUNTED_BYTES:
                    yield told()
                    size = 0
        if seen:
            yield told()

    return count


def _segment(model: str | None) -> Callable:
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model).segment
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(c) for c in batch.column("chunk").to_pylist()], pa.binary())], names=["chunk", "n", "ids"])

    return segment


def frequent_chunks(texts: DataFrame, head_rows: int, model: str | None = None) -> tuple[list[str], list[bytes]]:
    """Chunks of the texts and their ids, head_rows at most, the most frequent first."""
    counted = materialize(texts.mapInArrow(_count(model), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")), "chunk-counts")
    # steps of an eighth of a power of two: so many chunks of the highest counts as are within the bound
    step, left, least = F.floor(8 * F.log2("n")), head_rows, None
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a row a step, 504 at most
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    if least is None:
        release(counted)
        return [], []
    rows = counted.where(step >= least).mapInArrow(_segment(model), "chunk string, n long, ids binary").toArrow()  # head_rows at most
    release(counted)
    rows = rows.sort_by([("n", "descending"), ("chunk", "ascending")])
    return rows["chunk"].to_pylist(), rows["ids"].to_pylist()


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.nonzero(b < 128)[0]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        on = starts + k <= ends
        out[on] |= (b[starts[on] + k].astype(np.int64) & 127) << 7 * k
    return out


class Strings:
    """Byte strings end to end; several are picked, in any order, at once."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.ends = np.cumsum([0, *map(len, items)])

    def pick(self, which: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Their bytes end to end, without the first skip of each, and their lengths."""
        starts = self.ends[which] + skip
        n = self.ends[which + 1] - starts
        at = np.repeat(starts - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.data[at], n

    def with_more(self, items: list[bytes]) -> Strings:
        out = Strings.__new__(Strings)
        more = Strings(items)
        out.data, out.ends = np.concatenate([self.data, more.data]), np.concatenate([self.ends, self.ends[-1] + more.ends[1:]])
        return out


class Head:
    """The frequent chunks, their ids and what these decode to, as flat arrays; the table of their numbers is made where it is
    used, once a worker."""

    def __init__(self, chunks: list[str], ids: list[bytes], said: list[bytes]):
        self.chunks, self.ids, self.said = Strings([c.encode() for c in chunks]), Strings(ids), Strings(said)
        self.table: dict[str, bytes] | None = None
        self.clean: set[str] = set()
        self.words: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None, "clean": set(), "words": {}}

    def known(self) -> dict[str, bytes]:
        """Each chunk's number as it is written."""
        if self.table is None:
            data, ends = self.chunks.data.tobytes(), self.chunks.ends.tolist()
            self.table = {data[i:j].decode(): _number(k) for k, (i, j) in enumerate(zip(ends, ends[1:]))}
        return self.table

    def beyond(self, c: Codec, text: str) -> list[str]:
        """A text's chunks that are not frequent, each once, in order."""
        known = self.known()
        if not regular(text):
            found = set(c.chunks(text)).difference(known)
        else:
            found = set()
            for word in set(text.split(" ")).difference(self.clean):
                rare = [x for x in c.chunks(word) if x not in known]
                found.update(rare)
                if not rare and len(self.clean) < MEMO_WORDS and len(word) <= HEAD_BYTES:
                    self.clean.add(word)
        return in_order(found)

    def numbers(self, c: Codec, text: str) -> bytes:
        """A text as the numbers of its chunks: those of the head, and after them its own others."""
        known, n = self.known(), len(self.table)
        if not regular(text):
            own = c.chunks(text)
            more = {x: _number(n + k) for k, x in enumerate(in_order(set(own).difference(known)))}
            return b"".join([known.get(x) or more[x] for x in own])
        words, here, held, found = text.split(" "), {}, [], set()
        for word in set(words).difference(self.words):
            own = c.chunks(word)
            rare = [x for x in own if x not in known]
            if rare:
                held.append((word, own))
                found.update(rare)
            else:
                kept = self.words if len(self.words) < MEMO_WORDS and len(word) <= HEAD_BYTES else here
                kept[word] = b"".join([known[x] for x in own])
        more = {x: _number(n + k) for k, x in enumerate(in_order(found))}
        here.update((word, b"".join([known.get(x) or more[x] for x in own])) for word, own in held)
        self.words.update(here)  # for this text only
        out = b"".join(map(self.words.__getitem__, words))
        for word in here:
            del self.words[word]
        return out


def regular(text: str) -> bool:
    """Whether single spaces alone part a text into words, so that each has the chunks that it has by itself."""
    return bool(text) and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " "


def in_order(chunks: set[str]) -> list[str]:
    if len(chunks) >= 1 << AT_BITS:
        raise ValueError("a text holds too many chunks")
    return sorted(chunks)


def _rare(model: str | None, head) -> Callable:
    """f, at, chunk: each text's chunks beyond the head, each once, in order; at is the text's place and their number from 1."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, frequent = codec(model), head.value
        for batch in batches:
            place, counts, found, size, first = batch.column("i").to_numpy() << AT_BITS, [], [], 0, 0

            def told() -> pa.RecordBatch:
                n = np.array(counts, np.int64)
                rows = np.repeat(np.arange(first, first + len(counts)), n)
                at = place[rows] + 1 + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                return pa.RecordBatch.from_arrays([batch.column("f").take(pa.array(rows)), pa.array(at), pa.array(found, pa.string())], names=["f", "at", "chunk"])

            for text in (t.as_py() for t in batch.column("text")):
                new = frequent.beyond(c, text or "")
                counts.append(len(new))
                found += new
                size += sum(map(len, new))
                if size > OUT_BYTES:
                    yield told()
                    counts, found, size, first = [], [], 0, first + len(counts)
            if found:
                yield told()

    return rare


def _segment_runs(model: str | None) -> Callable:
    """Ids of each row's chunk; rows come in the order of chunks, and a run of equal ones is segmented once."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, last, ids = codec(model).segment, None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("chunk"))
            names, lengths, out = runs.values.to_pylist(), np.diff(runs.run_ends.to_numpy(), prepend=0), []
            for chunk in names:
                if chunk != last:
                    last, ids = chunk, one(chunk)
                out.append(ids)
            data = pa.array(out, pa.binary()).take(pa.array(np.repeat(np.arange(len(names)), lengths)))
            yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("at"), data], names=["f", "at", "data"])

    return segment


def _by_number(model: str | None, head) -> Callable:
    """Each text as the numbers of its chunks: those of the head, and after them its own others."""

    def by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, frequent = codec(model), head.value
        for batch in batches:
            place = pa.array(batch.column("i").to_numpy() << AT_BITS)
            said, size, first = [], 0, 0

            def told() -> pa.RecordBatch:
                at, own = slice(first, first + len(said)), pa.array(said, pa.binary())
                return pa.RecordBatch.from_arrays([batch.column("f")[at], place[at], own, batch.column("key")[at]], names=["f", "at", "data", "key"])

            for text in (t.as_py() for t in batch.column("text")):
                said.append(frequent.numbers(c, text or ""))
                size += len(said[-1])
                if size > OUT_BYTES:
                    yield told()
                    said, size, first = [], 0, first + len(said)
            if said:
                yield told()

    return by_number


def _put_together(model: str | None, head) -> Callable:
    """Ids and decoded text; a text's row of numbers comes before the ids of its other chunks."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        head_ids, head_said = head.value.ids, head.value.said
        n_head = len(head_ids.ends) - 1

        def met(rows: pa.RecordBatch) -> pa.RecordBatch:
            first = np.nonzero(rows.column("at").to_numpy() % (1 << AT_BITS) == 0)[0]
            is_text = np.zeros(rows.num_rows, bool)
            is_text[first] = True
            payloads = rows.column("data").filter(pa.array(is_text)).to_pylist()
            more = rows.column("data").filter(pa.array(~is_text)).to_pylist()
            numbers = _numbers(b"".join(payloads))
            n = np.array([int((np.frombuffer(p, np.uint8) < 128).sum()) for p in payloads], np.int64)
            of = np.repeat(np.arange(len(n)), n)
            which = np.where(numbers < n_head, numbers, numbers + (first - np.arange(len(first)))[of])  # extras follow the head
            ids, n_ids = head_ids.with_more(more).pick(which)
            opening = np.zeros(len(which), np.int64)
            opening[(np.cumsum(n) - n)[n > 0]] = 1  # the first marker is not the text's
            said, n_said = head_said.with_more([c.said(i).encode() for i in more]).pick(which, opening)
            width = np.dtype(c.kind).itemsize
            total = lambda lengths: np.concatenate([[0], np.cumsum(np.bincount(of, lengths, len(n)).astype(np.int64))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(total(n_ids // width)), pa.array(np.ascontiguousarray(ids).view(c.kind).astype(np.int32)))
            texts = pa.StringArray.from_buffers(len(n), pa.py_buffer(total(n_said).tobytes()), pa.py_buffer(said.tobytes()))
            return pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(first)), lists, texts], names=["key", "ids", "decoded"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            # texts of about OUT_BYTES at a time; the last text's other chunks may follow in the next batch
            first = np.nonzero(batch.column("at").to_numpy() % (1 << AT_BITS) == 0)[0]
            sizes = np.cumsum(pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False))
            lo = 0
            for cut in first.tolist():
                full = cut > lo and sizes[cut - 1] - (sizes[lo - 1] if lo else 0) > OUT_BYTES
                if full or cut == first[-1] or cut == first[0]:
                    if cut > lo:
                        held.append(batch.slice(lo, cut - lo))
                    if held:
                        yield met(pa.concat_batches(held))
                    held, lo = [], cut
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield met(pa.concat_batches(held))

    return put_together


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, head_rows: int = HEAD_ROWS) -> DataFrame:
    """key, ids, decoded of every row: the ids that the sentencepiece library gives the whole text, without begin
    or end ids, and the text that its decode(ids) gives.

    A null or empty text has no ids and decodes to the empty text. Rows that repeat are encoded each. A text of any
    length, with or without a space, is encoded whole. Columns besides key and text are not looked at, whatever their
    names; an empty table gives an empty table. model is a path that every machine has.
    """
    spark, kind = docs.sparkSession, docs.select(named(key)).schema[0].dataType.simpleString()
    base, row = numbered(docs, "texts")
    place = F.col(row)
    base = base.select(place["f"].alias("f"), place["i"].alias("i"), named(key).alias("key"), named(text).cast("string").alias("text"))
    share = min(1.0, SAMPLE_ROWS / max(1, base.count()))
    picked = F.pmod(F.xxhash64("f", "i"), F.lit(1 << 20)) < int(share * (1 << 20)) if share < 1 else F.lit(True)
    chunks, ids = frequent_chunks(base.where(picked).select("text"), head_rows, model)
    head = spark.sparkContext.broadcast(Head(chunks, ids, [codec(model).said(i).encode() for i in ids]))
    rare = base.select("f", "i", "text").mapInArrow(_rare(model, head), "f long, at long, chunk string")
    salt = F.when(F.octet_length("chunk") > HEAD_BYTES, F.pmod(F.xxhash64("f", "at"), F.lit(LONG_SHARES))).otherwise(0)
    segmented = rare.repartition("chunk", salt).sortWithinPartitions("chunk").mapInArrow(_segment_runs(model), "f long, at long, data binary")
    texts = base.mapInArrow(_by_number(model, head), f"f long, at long, data binary, key {kind}")
    both = texts.union(segmented.withColumn("key", F.lit(None).cast(kind)))
    met = both.repartition("f", F.shiftright("at", AT_BITS)).sortWithinPartitions("f", "at")
    return met.mapInArrow(_put_together(model, head), f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_piece_codec": op11_piece_codec}
ORACLES: dict[str, str] = {}
