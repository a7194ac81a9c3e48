"""Order-preserving packing: windows of the token stream, cut by dynamic programming.

Documents stand in the order of their doc_ids and are dealt out by ranges of it, so that each task holds a stretch
of the stream.  Cuts may fall at the end of a document, which costs nothing, at the end of a sentence inside one
(``sentence_cost``) and, in sentences longer than ``LONG`` tokens, at every ``LONG``-th token (``token_cost``).
With f(j) the least cost of the stream up to the j-th place P(j), pen(j) that of cutting there, and 1 a sequence,

    f(j) = pen(j) + 1 + min over i with P(j) - P(i) <= capacity of f(i) + padding(P(j) - P(i)).

Padding is capacity less the length, but nothing at a power of two.  The first part is a minimum of f(i) + P(i)
over a sliding window, which a monotone queue gives in constant time; for powers of two the few places i
that lie exactly so far back are looked up beforehand for all places at once.

A stretch is solved for ``STRETCH`` tokens of whole documents at a time, within whose last two windows every token may be cut,
so that its end costs hardly any padding.  Memory holds one such stretch, or one longer document.

Null texts count as empty: the end id alone.  Rows without doc_id come first; rows that repeat a doc_id are
packed each.  Every id of every row lies in exactly one piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import wordtokens
from geolith.llm.bpe import byte_of_char, read_vocabulary
from geolith.llm.common import sliced, small_batches, table

#: Tokens of a sentence beyond which it may be cut inside, and tokens that are solved together.
LONG, STRETCH = 32, 1 << 20
#: Costs, in tokens of padding, of a cut at a sentence's end and of one inside a sentence.
SENTENCE_COST, TOKEN_COST = 8.0, 24.0
#: Marks that end a sentence, and those that may follow them before it ends.
ENDS, CLOSES = ".!?…。！？", "\"')]}»”’"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Sentences:
    """Ends of sentences among token ids: a token of closing marks with one that ends a sentence, the last of its run, and no number after it."""

    def __init__(self, encoder: wordtokens.WordTokens):
        vocabulary = encoder.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.ends, self.goes_on = np.zeros(size, bool), np.zeros(size, bool)
        suffix, chars = encoder.tokenizer.model.end_of_word_suffix or "", byte_of_char()
        for token, i in vocabulary.items():
            spelt = token.removesuffix(suffix)
            text = (bytes(chars[c] for c in spelt).decode("utf-8", "replace") if all(c in chars for c in spelt) else spelt).strip()
            marks = bool(text) and all(c in ENDS + CLOSES for c in text)
            self.ends[i] = marks and any(c in ENDS for c in text)
            self.goes_on[i] = marks or text[:1].isdigit()

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of tokens before each end of a sentence inside the ids, ascending."""
        return np.flatnonzero(self.ends[ids[:-1]] & ~self.goes_on[ids[1:]]) + 1


def places(sizes: list[int], sentences: list[np.ndarray], capacity: int, sentence_cost: float, token_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream of these documents may be cut, from 0 to its end, and what each cut costs."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    own = np.concatenate([np.zeros(1, np.int64), ends, *(s + (e - n) for s, e, n in zip(sentences, ends.tolist(), sizes, strict=True))])
    soft = np.unique(own)
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > min(LONG, capacity))
    step = min(LONG, capacity)
    n_inside = (gaps[wide] - 1) // step
    turn = np.arange(int(n_inside.sum())) - np.repeat(np.cumsum(n_inside) - n_inside, n_inside)
    inside = np.repeat(soft[wide], n_inside) + (turn + 1) * step
    last = np.arange(max(0, total - 2 * capacity), total)
    at = np.unique(np.concatenate([soft, inside, last]))
    cost = np.full(len(at), token_cost)
    cost[np.searchsorted(at, soft)] = sentence_cost
    cost[np.searchsorted(at, ends)] = 0.0
    cost[0] = 0.0
    return at, cost


def cuts(at: np.ndarray, cost: np.ndarray, capacity: int) -> list[int]:
    """The places, first and last included, that divide the stream at least cost."""
    n = len(at)
    sources, targets = [], []
    power = 1
    while power <= capacity:
        back = np.searchsorted(at, at - power)
        hit = np.flatnonzero(at[np.minimum(back, n - 1)] == at - power)
        targets.append(hit)
        sources.append(back[hit])
        power *= 2
    target, source = np.concatenate(targets), np.concatenate(sources)
    source = source[np.argsort(target, kind="stable")].tolist()
    upto = np.cumsum(np.bincount(target, minlength=n)).tolist()
    where, costs = at.tolist(), cost.tolist()
    best, before = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(float(where[0]), where[0], 0)])
    k = upto[0]
    for j in range(1, n):
        p = where[j]
        while queue[0][1] < p - capacity:
            queue.popleft()
        least, _, i = queue[0]
        least += capacity - p
        for k in range(k, upto[j]):
            if best[source[k]] < least:
                least, i = best[source[k]], source[k]
        k = upto[j]
        least += costs[j] + 1
        best[j], before[j] = least, i
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out = [n - 1]
    while out[-1]:
        out.append(before[out[-1]])
    return [where[j] for j in reversed(out)]


def pieces_of(sizes: list[int], bounds: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Document, start in it, length, sequence and offset of each piece that the cuts leave, in order."""
    doc, begun, sequence = 0, 0, 0
    for a, b in zip(bounds, bounds[1:], strict=False):
        at = a
        while at < b:
            length = min(b, begun + sizes[doc]) - at
            yield doc, at - begun, length, sequence, at - a
            at += length
            if at == begun + sizes[doc]:
                begun += sizes[doc]
                doc += 1
        sequence += 1


def pack_in_order(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 1, capacity: int = 2048, sentence_cost: float = SENTENCE_COST, token_cost: float = TOKEN_COST) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are its text's and the end id.  sequence_ids grow along the stream and have gaps.
    """
    path = vocabulary_path or public_tokenizers.path("word_bpe_49k.json")
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordtokens.model(shipped.value)
        marks = Sentences(encoder)
        sequence = TaskContext.get().partitionId() << 40
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        sentences: list[np.ndarray] = []
        tokens = 0

        def solved() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            sizes = [len(x) // 4 for x in held]
            at, cost = places(sizes, sentences, capacity, sentence_cost, token_cost)
            found = list(pieces_of(sizes, cuts(at, cost, capacity)))
            for k in range(0, len(found), 4096):
                doc, start, length, own, offset = zip(*found[k : k + 4096], strict=True)
                ids = [held[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
                columns = [pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([sizes[d] for d in doc], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(own, np.int64) + sequence), pa.array(offset, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += found[-1][3] + 1
            for x in (doc_ids, held, sentences):
                x.clear()

        for batch in sliced(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids += end
                doc_ids.append(doc_id)
                held.append(ids)
                sentences.append(marks.of(np.frombuffer(ids, "<u4")))
                tokens += len(ids) // 4
                if tokens >= STRETCH:
                    yield from solved()
                    tokens = 0
        if held:
            yield from solved()

    spread = F.xxhash64("text")  # rows of one doc_id may be very many: they are dealt out as well
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("spread", spread)
    ordered = small_batches(rows).repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread").select("doc_id", "text")
    return ordered.mapInArrow(run, PIECES)


def op12_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_in_order(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
