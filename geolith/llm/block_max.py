"""Ranked lexical search by Block-Max WAND over shards of compressed posting blocks.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased.
``build`` counts documents and terms, then turns each task's documents into shards of at most ``SHARD_BYTES`` of
text (a longer text is a shard of its own).  In a shard documents are numbered by ascending doc_id, and each term
has one row: its postings, in blocks of ``BLOCK``, as variable-length bytes of (gap to the document before,
impact), and for each block the last document, the maximum impact and where its bytes end.  An impact is
``(1000000000 tf) div (1000 tf + 20 m)`` with ``m = 50 + (50 n N) div L``: a whole number below 2^20 that the
query's weights multiply.  The index is a table: nothing is shuffled to build it.

``search`` joins the terms of the queries to the index by term, and each shard answers a block of queries.  Shallow
pointers over the blocks of the query's lists bound every stretch of documents in which no block begins or ends; stretches
that can beat the k-th score become pivots, highest bounds first, and only blocks with a pivot are decompressed.  One shard
at a time takes its pivots in rounds of growing size rather than one by one, since a round is one array operation a
list.  An eighth of the shards go first; the k-th score that they have for a query is where the others start.

Documents without a term (null and empty ones too) are in no ranking and not in N; rows without doc_id are left
out.  Rows that repeat a doc_id are documents each and are ranked each.  Equal scores go by ascending doc_id.  Queries
without a term find nothing; a term counts once for a query; queries with one item_id are one query with the terms of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.llm.common import save, sliced, small_batches, table

#: Postings of a block, bytes of text of a shard, queries that a group of a shard answers.
BLOCK, SHARD_BYTES, QUERIES = 128, 12 << 20, 256
#: One in so many shards gives the first thresholds.
FIRST = 8
#: What a document's length and a term's count weigh in an impact.
FLAT, SLOPE, TF, SCALE = 50, 50, 1000, 1_000_000_000

INDEX = "shard long, term string, df long, lasts array<int>, maxima array<int>, ends array<int>, payload binary"

_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = True
_IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Index(NamedTuple):
    postings: DataFrame
    documents: int
    terms: int


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a space, and where each begins and the last ends."""
    joined = pc.binary_join_element_wise(texts.fill_null(""), "", " ")
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _begins(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    return inside, begins


def term_counts(texts: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    data, offsets = _texts(texts)
    before = np.r_[0, np.cumsum(_begins(data)[1])]
    return np.diff(before[offsets])


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts, the number of each occurrence's term, and the text of each occurrence."""
    data, offsets = _texts(texts)
    inside, begins = _begins(data)
    at = np.flatnonzero(begins)
    spelt = _LOWER[data[inside]]
    bounds = np.r_[np.cumsum(inside)[at] - 1, len(spelt)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(spelt)).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.searchsorted(offsets, at, "right") - 1


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, seven bits each, the last of a value below 128; and where each value's bytes end."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        own = np.flatnonzero(sizes > k)
        rest = values[own] >> 7 * k
        out[ends[own] - sizes[own] + k] = (rest & 127) | np.where(sizes[own] > k + 1, 128, 0)
    return out, ends


def from_varints(data: np.ndarray) -> np.ndarray:
    """The values that these bytes, one value's at least, stand for."""
    ends = np.flatnonzero(data < 128)
    begins = np.r_[0, ends[:-1] + 1]
    turn = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * turn, begins)


def spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(begins - (ends - lengths), lengths)
    return out + np.arange(len(out))


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def shard_rows(number: int, doc_ids: np.ndarray, texts: pa.Array, documents: int, terms: int) -> pa.RecordBatch:
    """The rows of one shard: its postings by term, and under the empty term the doc_ids of its documents."""
    order = np.argsort(doc_ids, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    spelt, codes, at = tokenized(texts)
    lengths = np.bincount(at, minlength=len(doc_ids)).astype(object)  # whole numbers of any size
    m = np.array(FLAT + (SLOPE * lengths * documents) // terms, np.int64)
    keys, tf = np.unique(codes.astype(np.int64) * len(doc_ids) + rank[at], return_counts=True)
    code, doc = np.divmod(keys, len(doc_ids))
    impact = (SCALE * tf) // (TF * tf + 20 * m[order][doc])
    df = np.bincount(code, minlength=len(spelt))
    first = np.cumsum(df) - df  # of each term's postings
    place = np.arange(len(doc)) - first[code]
    gap = np.where(place % BLOCK > 0, np.diff(doc, prepend=0), doc)  # a block's first document is whole
    data, ends = varints(np.stack([gap, impact], 1).ravel())
    ends = ends[1::2]  # of each posting
    begin = np.flatnonzero(place % BLOCK == 0)  # of each block
    last = np.r_[begin[1:], len(doc)] - 1
    blocks = np.r_[0, np.cumsum(-(-df // BLOCK))]
    of_bytes = np.r_[0, ends[first + df - 1]]  # every term of the dictionary has a posting
    own = np.repeat(of_bytes[:-1], np.diff(blocks))
    payload = pa.Array.from_buffers(pa.binary(), len(spelt), [None, pa.py_buffer(of_bytes.astype(np.int32)), pa.py_buffer(data)])
    columns = [pa.array(np.full(len(spelt), number)), spelt, pa.array(df.astype(np.int64)), _lists(blocks, doc[last]), _lists(blocks, np.maximum.reduceat(impact, begin)), _lists(blocks, ends[last] - own), payload]
    ids = [pa.array([number]), pa.array([""]), pa.array([0]), _lists(np.zeros(2), np.zeros(0)), _lists(np.zeros(2), np.zeros(0)), _lists(np.zeros(2), np.zeros(0)), pa.array([doc_ids[order].astype("<i8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(columns, ids, strict=True)], ["shard", "term", "df", "lasts", "maxima", "ends", "payload"])


def build(docs: DataFrame) -> Index:
    """The index of all documents as a table, and how many documents and terms it holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = 0, 0
        for batch in sliced(batches):
            n = term_counts(batch.column(0))
            held, total = held + int(np.count_nonzero(n)), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total])], ["documents", "terms"])

    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL"))
    counted = rows.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).head()
    documents, terms = counted["documents"] or 0, counted["terms"] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list[np.ndarray] = []
        texts: list[pa.Array] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal number
            whole = shard_rows(number, np.concatenate(ids), pa.concat_arrays(texts), documents, terms)
            number += 1
            for at in range(0, whole.num_rows, 16384):
                yield whole.slice(at, 16384)

        for batch in sliced(batches):
            keep = term_counts(batch.column(1)) > 0
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            if ids and size + batch.column(1).nbytes > SHARD_BYTES:
                yield from shard()
                ids, texts, size = [], [], 0
            ids.append(batch.column(0).to_numpy())
            texts.append(batch.column(1))
            size += batch.column(1).nbytes
        if ids:
            yield from shard()

    postings, _ = save(rows.mapInArrow(run, INDEX), "postings")
    return Index(postings, documents, terms)


ONE = np.zeros(1, np.int64)


class Shard:
    """The posting lists of a shard that some queries name, whose blocks are decompressed when a query needs them."""

    def __init__(self, rows: pa.Table, documents: int):
        self.documents = documents
        self.weights = rows.column("weight").to_pylist()
        self.sizes = rows.column("df").to_pylist()
        self.lasts, maxima, self.ends = ([x.values.to_numpy().astype(np.int64) for x in rows.column(c)] for c in ("lasts", "maxima", "ends"))
        self.maxima = [m * w for m, w in zip(maxima, self.weights, strict=True)]
        self.payload = [np.frombuffer(x.as_py(), np.uint8) for x in rows.column("payload")]
        self.firsts = [np.array([self._first(t, b) for b in range(len(ends))], np.int64) for t, ends in enumerate(self.ends)]
        #: Of each term: which blocks are open, and the documents and weighted impacts of those.
        self.open = [np.zeros(len(ends), bool) for ends in self.ends]
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.ends)

    def _first(self, term: int, b: int) -> int:
        """The first document of a block, from its first bytes."""
        at, value, shift = int(self.ends[term][b - 1]) if b else 0, 0, 0
        while (byte := int(self.payload[term][at])) > 127:
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
        return value | byte << shift

    def extents(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last documents and weighted maxima of a list's blocks; of a list of one block, which is as small as a bound on it is loose, of its postings."""
        if len(self.lasts[term]) > 1:
            return self.firsts[term], self.lasts[term], self.maxima[term]
        docs, impacts = self.postings(term, ONE)
        return docs, docs, impacts

    def postings(self, term: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weighted impacts of some blocks, ascending."""
        size, n = self.sizes[term], len(self.ends[term])
        if self.found[term] is None:
            self.found[term] = np.zeros(size, np.int64), np.zeros(size, np.int64)
        docs, impacts = self.found[term]
        new = blocks[~self.open[term][blocks]]
        if len(new):
            ends = self.ends[term]
            begins = np.r_[0, ends[:-1]]
            values = from_varints(self.payload[term][spans(begins[new], ends[new] - begins[new])])
            lengths = np.minimum(BLOCK, size - new * BLOCK)
            gaps = values[::2]
            upto = np.cumsum(gaps)
            first = np.cumsum(lengths) - lengths
            at = spans(new * BLOCK, lengths)
            docs[at] = upto - np.repeat(upto[first] - gaps[first], lengths)  # the first of each block is whole
            impacts[at] = values[1::2] * self.weights[term]
            self.open[term][new] = True
        if len(blocks) == n:
            return docs, impacts
        at = spans(blocks * BLOCK, np.minimum(BLOCK, size - blocks * BLOCK))
        return docs[at], impacts[at]


def block_max_wand(shard: Shard, terms: list[int], k: int, least: int = 0) -> list[tuple[int, int]]:
    """The k best (score, document) of a query's terms with a score above ``least``; ties to smaller documents.

    Shallow pointers pass over the blocks of all lists at once: between two places at which a block begins or ends the
    same blocks hold, and the sum of their maxima bounds every document there.  Stretches become pivots in the order of their
    bounds, a few documents first and then more at a time; those whose bound is below the k-th score so far are skipped, and
    blocks that only lie in skipped stretches are never decompressed.
    """
    terms = [t for t in terms if shard.weights[t] > 0]
    if not terms:
        return []
    extents = [shard.extents(t) for t in terms]
    first, last, most = (np.concatenate(x) for x in zip(*extents, strict=True))
    edges = np.unique(np.concatenate([first, last + 1]))
    low, high = np.searchsorted(edges, first), np.searchsorted(edges, last + 1)
    change = np.zeros(len(edges), np.int64)
    np.add.at(change, low, most)
    np.subtract.at(change, high, most)
    bound, width = np.cumsum(change)[:-1], np.diff(edges)
    order = np.argsort(-bound, kind="stable")
    begins = np.cumsum([0, *(len(x) for x, _, _ in extents)]).tolist()
    scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    quota = 4 * k
    while len(order):
        floor = int(scores[-1]) if len(scores) == k else 0
        order = order[(bound[order] > least) & (bound[order] >= floor)]  # a tie with the k-th may precede it
        n = int(np.searchsorted(np.cumsum(width[order]), quota)) + 1
        pivots, order, quota = order[:n], order[n:], 8 * quota
        if not len(pivots):
            break
        chosen = np.cumsum(np.bincount(pivots + 1, minlength=len(edges)))  # pivots before each edge
        needed = chosen[high] > chosen[low]
        total = np.zeros(shard.documents, np.int64)
        for t, a, b in zip(terms, begins, begins[1:], strict=False):
            if needed[a:b].any():
                own, impacts = shard.postings(t, np.flatnonzero(needed[a:b])) if len(shard.lasts[t]) > 1 else shard.postings(t, ONE)
                total[own] += impacts
        near = spans(edges[pivots], width[pivots])
        near = near[(total[near] > least) & (total[near] >= floor)]
        scores, docs = np.concatenate([scores, total[near]]), np.concatenate([docs, near])
        best = np.lexsort((docs, -scores))[:k]
        scores, docs = scores[best], docs[best]
    return list(zip(scores.tolist(), docs.tolist(), strict=True))


def _answers(rows: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id and score of the best of each shard; rows: postings with their weight and the queries that name them."""

    def run(rows: pa.Table) -> pa.Table:
        of_ids = pc.equal(rows.column("term"), "")
        ids = np.frombuffer(b"".join(rows.filter(of_ids).column("payload").to_pylist()), "<i8")
        lists = rows.filter(pc.invert(of_ids)).combine_chunks()
        shard, named = Shard(lists, len(ids)), {}
        for t, items in enumerate(lists.column("items").to_pylist()):
            for x in items:
                named.setdefault(x["item_id"], (x["least"], []))[1].append(t)
        out: tuple[list, list, list] = ([], [], [])
        for item, (least, terms) in named.items():
            for score, doc in block_max_wand(shard, terms, k, least):
                for column, value in zip(out, (item, int(ids[doc]), score), strict=True):
                    column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

    return rows.groupBy("shard", "part").applyInArrow(run, "item_id long, doc_id long, score long")


def search(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query (item_id, text) with a score above 0."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spelt, codes, at = tokenized(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), spelt.take(pa.array(codes))], ["item_id", "term"])

    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    named = asked.mapInArrow(spell, "item_id long, term string").distinct()
    parts = max(1, -(-asked.select("item_id").distinct().count() // QUERIES))
    named, _ = save(named.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")), "asked")
    # The postings of terms that queries name, and every shard's doc_ids.
    wanted = named.select("term").distinct()
    held, _ = save(index.postings.where("term <> ''").join(wanted, "term", "left_semi"), "named")
    df = held.groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.documents + 2) / (2 * F.col("n") + 1))).cast("long")
    weighted, _ = save(named.join(df, "term").select("part", "item_id", "term", weight.alias("weight")), "weighted")
    ids = index.postings.where("term = ''")

    def answers(first: bool, least: DataFrame | None) -> DataFrame:
        own = (F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0) == F.lit(first)
        start = weighted.withColumn("least", F.lit(0).cast("long")) if least is None else weighted.join(least, "item_id", "left").na.fill(0, ["least"])
        by_term = start.groupBy("part", "term", "weight").agg(F.collect_list(F.struct("item_id", "least")).alias("items"))  # at most the queries of a part
        columns = ["shard", "part", "term", "df", "lasts", "maxima", "ends", "payload", "weight", "items"]
        lists = held.where(own).join(by_term, "term").select(*columns)
        empty = F.lit(None).cast(by_term.schema["items"].dataType)
        of_shards = ids.where(own).withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "weight": F.lit(0).cast("long"), "items": empty}).select(*columns)
        return _answers(lists.unionByName(of_shards), k)

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    early, _ = save(ranked(answers(True, None)).where(F.col("rank") <= k).drop("rank"), "early")
    # A document that ties with the k-th of the first shards may still precede it by doc_id.
    least = early.groupBy("item_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).select("item_id", (F.col("low") - 1).alias("least"))
    return ranked(early.unionByName(answers(False, least))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
