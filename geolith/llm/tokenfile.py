"""Token-id files written by an adaptive context-mixing range coder.

A file holds whole documents in ascending doc_id order: a header, the documents' ids and token counts,
and blocks of at most BLOCK token ids, each with a CRC-32 of its ids and their code, so that damage is noticed.
UNIT blocks of a file at most share a model, which is fresh at their start.  A file can be decoded alone.  Files are rows (part, seq,
data) of a Parquet table in the shared folder, which any store that Spark writes to can hold.

Model of a unit.  Order 2 and order 1 predict the next id from tables of what followed the same two ids
or the same id last time in any of the unit's blocks, each with a confidence of 0 to 3.  An outcome says which is right: order 2's id,
order 1's, or neither.  Its frequencies are mixed from adaptive counts by both confidences, by order 1's
alone and by order 2's alone.  An id that neither predicted is coded by order 0, by how often it was coded so before; ids that
are new share a part that is as large as new ids were frequent.  Outcome and id are one interval of the
coder.  Frequencies are rebuilt from the counts before ids 1, 2, 4 and so on of all blocks, then every REFRESH ids.

The coder works on many blocks at once: step t codes the t-th id of each block with numpy, which keeps
the sequential model affordable.  Where blocks of a unit write the same place in one step, the last one's id stays.
Arithmetic gives whole numbers that any machine decodes alike.

Null texts are empty: the end id alone.  Rows without doc_id are left out, since the order is that of
doc_id; rows that repeat a doc_id are written one after the other.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.llm import wordtokens
from geolith.llm.bpe import read_vocabulary
from geolith.llm.common import save, sliced, small_batches, table

MAGIC = b"GLTK2\n"
BLOCK = 2048
#: Blocks that share a model at most.
UNIT = 512
#: Ids of a file before a new one begins, at a document's end.
FILE_IDS = 1 << 20
#: Blocks that are coded at once.
LANES = 8192
#: Ids, and places in each of the tables of order 1 (by the id itself) and order 2 (by a hash).
IDS = 1 << 16
#: Frequencies of outcomes are out of 2^OUTCOME_BITS, those of ids out of 2^ID_BITS; together they are the bits of one interval.
#: An id that was seen has whole points, of which there are 2^POINT_BITS; new ones share NEW points at least, twice as many up to NEWEST times.
OUTCOME_BITS, ID_BITS, POINT_BITS = 12, 22, 18
FINE = ID_BITS - POINT_BITS
NEW, NEWEST = IDS >> FINE, 5
#: Neither order's prediction gets the last part, so that every id keeps a frequency.
MISSES = 64
REFRESH = 256
SURE = 3 << 16
TOP = np.uint64(1 << 40)
LOW_MASK = np.uint64((1 << 40) - 1)
ALL, SHIFT, SIXTEEN, FORTY = np.uint64((1 << 56) - 1), np.uint64(OUTCOME_BITS + ID_BITS), np.uint64(16), np.uint64(40)


class Model:
    """State of n blocks of some units that are coded in step; all are fresh at the start."""

    def __init__(self, unit: np.ndarray):
        """The unit, from 0, of each block."""
        units = int(unit.max(initial=-1)) + 1
        self.n, self.unit = len(unit), unit
        self.table = np.zeros(units * 2 * IDS, np.int64)  # ids and, above them, the confidence
        self.base = np.stack([unit * 2 * IDS, unit * 2 * IDS + IDS])
        self.base_outcome, self.base_id, self.base_point = unit * 48, unit * (IDS + 1), unit << POINT_BITS
        self.seen = np.ones((units, 4, 4, 3), np.int64)
        self.seen[..., 2] = 2
        self.counts = np.zeros((units, IDS), np.int64)
        self.start, self.width = np.zeros((units, IDS + 1), np.int64), np.full((units, IDS + 1), 1 << ID_BITS)  # the last: no id is coded
        self.start[:, :IDS], self.width[:, :IDS] = np.arange(IDS) << NEWEST, 1 << NEWEST
        self.starts, self.widths = self.start.ravel(), self.width.ravel()
        self.points = np.zeros((units, 1 << POINT_BITS), np.uint16)
        self.ids_of_points = self.points.ravel()
        self.more = np.full(units, NEWEST)
        self.a, self.b = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.outcomes: list[np.ndarray] = []
        self.missed: list[np.ndarray] = []
        self._outcome_frequencies()
        self._by_lane()

    def refresh(self, t: int) -> None:
        """Before the t-th id: the frequencies from what was counted; larger counts are halved."""
        if t & (t - 1) and t % REFRESH:
            return
        self.seen += 4 * np.bincount(np.concatenate(self.outcomes), minlength=self.seen.size).reshape(self.seen.shape)
        large = self.seen.sum((1, 2, 3)) > 1 << 20
        self.seen[large] = (self.seen[large] + 1) >> 1
        self._outcome_frequencies()
        found = np.bincount(np.concatenate(self.missed), minlength=self.start.size).reshape(self.start.shape)
        for unit, new in enumerate(found[:, :IDS]):
            self._learn(unit, new)
        self.outcomes, self.missed = [], []
        self._by_lane()

    def _outcome_frequencies(self) -> None:
        joint = self.seen
        mixed = (4 * joint + joint.sum(1, keepdims=True) + 2 * joint.sum(2, keepdims=True)).reshape(-1, 3)
        room = (1 << OUTCOME_BITS) - MISSES - 2
        total = mixed.sum(1)
        one = 1 + mixed[:, 0] * room // total
        two = one + 1 + mixed[:, 1] * room // total
        self.below = np.stack([np.zeros_like(one), one, two], 1).ravel()
        self.room = np.stack([one, two - one, (1 << OUTCOME_BITS) - two], 1).ravel()

    def _learn(self, unit: int, new: np.ndarray) -> None:
        """Order 0's frequencies of a unit, with the counts of the ids that it coded since the last time."""
        if not (coded := int(new.sum())):
            return
        counts = self.counts[unit]
        share = (64 * int(new[counts == 0].sum())) // coded
        more = min(max(share.bit_length() - 1, 0), NEWEST)
        counts += new
        ids = np.flatnonzero(counts)
        own = counts[ids]
        first = NEW << more
        width = 1 + own * ((1 << POINT_BITS) - first - len(ids)) // own.sum()
        ends = first + np.cumsum(width)
        self.more[unit] = more
        self.start[unit, :IDS], self.width[unit, :IDS] = np.arange(IDS) << more, 1 << more
        self.start[unit, ids], self.width[unit, ids] = (ends - width) << FINE, width << FINE
        self.points[unit, first : ends[-1]] = np.repeat(ids.astype(np.uint16), width)

    def _by_lane(self) -> None:
        self.more_here = self.more.take(self.unit)
        self.new_here = IDS << self.more_here

    def shrink(self, n: int) -> None:
        """The first n blocks go on; the others are at their end."""
        self.n = n
        for name in ("unit", "base_outcome", "base_id", "base_point", "more_here", "new_here", "a", "b"):
            setattr(self, name, getattr(self, name)[:n])
        self.base = self.base[:, :n]

    def predict(self) -> np.ndarray:
        """Order 1's and order 2's id."""
        at = np.empty((2, self.n), np.int64)
        at[0] = self.a
        at[1] = ((self.a * 40503 + self.b) >> 5) & (IDS - 1)
        at += self.base
        self.at, self.value = at, self.table.take(at)
        sure = self.value >> 16
        self.context = self.base_outcome + (sure[0] * 4 + sure[1]) * 3
        return self.value & 0xFFFF

    def interval(self, outcome: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of an outcome (0: order 2, 1: order 1, 2: neither) and, within "neither", of the id; both are counted."""
        k = self.context + outcome
        e = self.base_id + np.where(outcome == 2, ids, IDS)
        self.outcomes.append(k)
        self.missed.append(e)
        room = self.room.take(k)
        return (self.below.take(k) << ID_BITS) + room * self.starts.take(e), room * self.widths.take(e)

    def find(self, slot: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The outcome and the id whose interval holds the slot."""
        high = slot >> ID_BITS
        two = self.below[2:].take(self.context)
        missed = high >= two
        outcome = np.add(high >= self.below[1:].take(self.context), missed, dtype=np.int64)
        point = ((slot - (two << ID_BITS)) / self.room[2:].take(self.context)).astype(np.int64)  # exact, of 34 bits by 12
        point = np.maximum(point, 0)
        known = self.ids_of_points.take((point >> FINE) + self.base_point)
        ids = np.where(point < self.new_here, point >> self.more_here, known)
        return outcome, np.where(missed, ids, np.where(outcome == 1, predicted[0], predicted[1]))

    def update(self, ids: np.ndarray, right: np.ndarray) -> None:
        """What follows the contexts now; right says whether order 1 and order 2 had the ids."""
        self.table[self.at] = np.where(right, np.minimum(self.value + (1 << 16), ids + SURE), ids)
        self.b = self.a * 30011
        self.a = ids


def _groups(sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and end of the blocks that are coded at once, and the unit of each, for files of as many blocks as given."""
    at, first, of = 0, 0, []
    for size in sizes:
        for begin in range(0, size, UNIT):
            n = min(UNIT, size - begin)
            if len(of) and at - first + n > LANES:
                yield first, at, np.repeat(np.arange(len(of)), of)
                first, of = at, []
            of.append(n)
            at += n
    if of:
        yield first, at, np.repeat(np.arange(len(of)), of)


def encode_blocks(blocks: list[np.ndarray], sizes: list[int] | None = None) -> list[bytes]:
    """Range-codes blocks of ids (below 65536) of files of as many blocks as given, or of one file."""
    out: list[bytes] = []
    for first, end, unit in _groups([len(blocks)] if sizes is None else sizes):
        own = blocks[first:end]
        order = np.argsort([-len(b) for b in own], kind="stable")
        coded = dict(zip(order.tolist(), _encode([own[i] for i in order], unit[order]), strict=True))
        out += [coded[i] for i in range(len(own))]
    return out


def _active(lengths: np.ndarray, steps: int) -> np.ndarray:
    """How many of the blocks, longest first, have an id at each step."""
    return np.searchsorted(-lengths, -np.arange(steps), "left")


def _encode(blocks: list[np.ndarray], unit: np.ndarray) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    n, steps = len(blocks), int(lengths.max(initial=0))
    ids = np.zeros((steps, n), np.uint16)
    for i, block in enumerate(blocks):
        ids[: len(block), i] = block
    model = Model(unit)
    low, size = np.zeros(n, np.uint64), np.full(n, ALL)
    words: list[tuple[np.ndarray, np.ndarray]] = []
    ended: list[np.ndarray] = []
    active = _active(lengths, steps)
    for t in range(steps):
        m = int(active[t])
        if m < model.n:
            model.shrink(m)
            ended.append(low[m:])
            low, size = low[:m], size[:m]
        if t:
            model.refresh(t)
        own = ids[t, :m].astype(np.int64)
        right = model.predict() == own
        start, width = model.interval(np.where(right[1], 0, 2 - right[0]), own)
        part = size >> SHIFT
        low = low + part * start.view(np.uint64)
        size = part * width.view(np.uint64)
        small = np.flatnonzero(size < TOP).astype(np.uint16)
        while len(small):
            of = low.take(small)
            words.append((small, (of >> FORTY).astype(np.uint32)))
            low[small] = (of & LOW_MASK) << SIXTEEN
            of = size.take(small) << SIXTEEN
            size[small] = of
            small = small[of < TOP]
        model.update(own, right)
    low = np.concatenate([low, *reversed(ended)])
    for _ in range(4):  # the last 56 bits
        words.append((np.arange(n, dtype=np.uint16), (low >> FORTY).astype(np.uint32)))
        low = (low & LOW_MASK) << SIXTEEN
    return _carried(words, n)


def _carried(words: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[bytes]:
    """Each block's 16-bit words in order, with carries taken to the words before."""
    lane = np.concatenate([w[0] for w in words])
    value = np.concatenate([w[1] for w in words]).astype(np.int64)
    order = np.argsort(lane, kind="stable")  # by radix, as lanes have 16 bits
    value = value[order]
    ends = np.cumsum(np.bincount(lane, minlength=n))
    while (over := np.flatnonzero(value > 0xFFFF)).size:
        carry = value[over] >> 16
        value[over] &= 0xFFFF
        np.add.at(value, over - 1, carry)
    raw = value.astype(">u2").tobytes()
    return [raw[2 * s : 2 * e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def decode_blocks(payloads: list[bytes], lengths: list[int], sizes: list[int] | None = None) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for first, end, unit in _groups([len(payloads)] if sizes is None else sizes):
        order = np.argsort([-n for n in lengths[first:end]], kind="stable")
        places = (first + order).tolist()
        ids = dict(zip(places, _decode([payloads[i] for i in places], [lengths[i] for i in places], unit[order]), strict=True))
        out += [ids[i] for i in range(first, end)]
    return out


def _decode(payloads: list[bytes], counts: list[int], unit: np.ndarray) -> list[np.ndarray]:
    lengths = np.array(counts)
    n, steps = len(payloads), int(lengths.max(initial=0))
    ids = np.zeros((steps, n), np.uint16)
    model = Model(unit)
    sizes = np.array([len(p) for p in payloads])
    raw = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8).astype(np.uint16)
    words = (raw[:-1] << 8) | raw[1:]  # the 16 bits from each byte on
    place = np.cumsum(sizes) - sizes
    code = np.zeros(n, np.uint64)
    for i in range(0, 8, 2):
        code = (code << SIXTEEN) | words[place + i]
    code >>= np.uint64(8)
    place = place + 7
    size = np.full(n, ALL)
    last = len(words) - 1
    active = _active(lengths, steps)
    for t in range(steps):
        if (m := int(active[t])) < model.n:
            model.shrink(m)
            code, size, place = code[:m], size[:m], place[:m]
        if t:
            model.refresh(t)
        predicted = model.predict()
        part = size >> SHIFT
        slot = np.minimum(code // part, np.uint64((1 << int(SHIFT)) - 1)).view(np.int64)
        outcome, own = model.find(slot, predicted)
        start, width = model.interval(outcome, own)
        code = code - part * start.view(np.uint64)
        size = part * width.view(np.uint64)
        small = np.flatnonzero(size < TOP)
        while len(small):
            where = place.take(small)
            code[small] = (code.take(small) << SIXTEEN) | words.take(np.minimum(where, last))
            place[small] = where + 2
            of = size.take(small) << SIXTEEN
            size[small] = of
            small = small[of < TOP]
        ids[t, :m] = own
        model.update(own, predicted == own)
    return [np.ascontiguousarray(ids[:length, i]) for i, length in enumerate(counts)]


def write_files(documents: list[list[tuple[int, np.ndarray]]]) -> list[bytes]:
    """One file for each list of (doc_id, ids); the blocks of all files are coded together."""
    blocks, of_file = [], []
    for own in documents:
        ids = np.concatenate([x[1] for x in own]) if own else np.zeros(0, np.uint16)
        cut = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
        of_file.append(len(cut))
        blocks += cut
    payloads = encode_blocks(blocks, of_file)
    out, at = [], 0
    for own, n in zip(documents, of_file, strict=True):
        index = zlib.compress(np.array([x[0] for x in own], "<i8").tobytes() + np.array([len(x[1]) for x in own], "<i8").tobytes(), 1)
        parts = [MAGIC, struct.pack("<III", len(own), len(index), n), index]
        for block, payload in zip(blocks[at : at + n], payloads[at : at + n], strict=True):
            parts += [struct.pack("<III", len(block), len(payload), _sum(block, payload)), payload]
        out.append(b"".join(parts))
        at += n
    return out


def _sum(block: np.ndarray, payload: bytes) -> int:
    """CRC-32 of a block's ids and of their code."""
    return zlib.crc32(payload, zlib.crc32(block.astype("<u4").tobytes()))


def read_files(files: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """The documents of each file; ValueError if a checksum does not hold."""
    heads, payloads, lengths, sums = [], [], [], []
    for data in files:
        if data[:6] != MAGIC:
            raise ValueError("not a token-id file")
        n_docs, n_index, n = struct.unpack_from("<III", data, 6)
        index = np.frombuffer(zlib.decompress(data[18 : 18 + n_index]), "<i8")
        heads.append((index[:n_docs], index[n_docs:], n))
        at = 18 + n_index
        for _ in range(n):
            length, size, crc = struct.unpack_from("<III", data, at)
            payloads.append(data[at + 12 : at + 12 + size])
            lengths.append(length)
            sums.append(crc)
            at += 12 + size
    blocks = decode_blocks(payloads, lengths, [n for _, _, n in heads])
    for block, payload, crc in zip(blocks, payloads, sums, strict=True):
        if _sum(block, payload) != crc:
            raise ValueError("a block's checksum does not hold")
    out, at = [], 0
    for ids_of, counts, n in heads:
        ids = np.concatenate(blocks[at : at + n]) if n else np.zeros(0, np.uint16)
        ends = np.cumsum(counts)
        out.append([(int(d), ids[e - c : e]) for d, c, e in zip(ids_of, counts, ends, strict=True)])
        at += n
    return out


#: Files that are coded or decoded together in a task: their blocks are the lanes.
TOGETHER = 16


def write(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Writes the token ids of docs; returns the table of files (part, seq, n_ids, data), read back.

    Parts are ascending ranges of doc_id, as many as given or else as the session's shuffles have (adaptive execution
    joins small ones); files within a part are numbered by seq.  Vocabularies with ids above 65535 are refused.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(vocabulary_path or public_tokenizers.path("word_bpe_49k.json"))
    spec = json.loads(vocabulary)
    if max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) > 0xFFFF:
        raise ValueError("ids above 65535 do not fit into the files")
    shipped = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    dealt = (rows.repartitionByRange(parts, "doc_id") if parts else rows.repartitionByRange("doc_id")).sortWithinPartitions("doc_id")
    end = np.array([end_id], np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordtokens.model(shipped.value)
        part = TaskContext.get().partitionId()
        files: list[list] = []
        held, seq = FILE_IDS, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            data = write_files(files)
            first, seq = seq, seq + len(data)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int32()), pa.array(range(first, seq), pa.int32()), pa.array([sum(len(d[1]) for d in f) for f in files], pa.int64()), pa.array(data, pa.binary())], ["part", "seq", "n_ids", "data"])

        for batch in sliced(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                if held >= FILE_IDS:
                    if len(files) == TOGETHER:
                        yield flush()
                        files = []
                    files.append([])
                    held = 0
                ids = np.concatenate([np.frombuffer(ids, "<u4").astype(np.uint16), end])
                files[-1].append((doc_id, ids))
                held += len(ids)
        if files:
            yield flush()

    files = small_batches(dealt).mapInArrow(run, "part int, seq int, n_ids long, data binary")
    return save(files, "tokens")[0]


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of write()."""
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((part, seq, data) for batch in batches for part, seq, data in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while some := list(itertools.islice(each, TOGETHER)):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for (part, seq, _), documents in zip(some, read_files([data for _, _, data in some]), strict=True):
                start = 0
                for doc_id, ids in documents:
                    for column, value in zip(rows, (part, seq, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                    start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read_back = files.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read_back.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
