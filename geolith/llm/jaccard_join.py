"""Similarity join of documents by word n-grams: a blocked sparse product with size-derived bounds.

The join is the sparse product of the document by n-gram incidence matrix with its transpose, of which
only entries that reach the threshold are wanted.  The n-gram axis is cut into column blocks by hash.  If two
sets of sizes a <= b reach ``percent``, then a >= percent/100 * b, and they differ in k = 2 * b *
(100 - percent) / (100 + percent) n-grams at most.

- Documents with equal sets are one class from the start.
- A class's columns are cut into k + k/5 + 2 blocks.  A linked pair differs in k of them at most, so only classes
  that share the digest of a block can have an entry to compute.  Empty blocks have no digest: should a linked pair
  share empty blocks only, then each has n-grams in k blocks at most, and such classes also bring the smallest
  n-grams of their set, of which any linked pair shares one.  Sizes are cut into classes such that a pair lies in
  one or in two neighbouring ones; a class takes part in both.
- The parities of the totals of narrow blocks, about one for each n-gram, bound the difference of two sets from
  below; pairs that differ in more than their sizes allow are discarded without looking at the n-grams.
- The entries that are left are the mask of the product.  A class's row of the incidence matrix is cut at fixed borders of
  the n-gram axis; for each column block the incidence entries of all pairs of a slice are multiplied at once and added
  to the pairs' overlap counts, and pairs whose count can't reach the bound with the columns to come are discarded.

Only connectivity is wanted, so a block's digest first pairs all its classes with the smallest one, and a class
meets the smallest of all those partners before the others, which are tested only if they are not connected to it by
then.  Where a block's classes are still not all connected, the pairs across components are tested as well, in tiles
of TILE by TILE, so that no link is lost and no group meets in one task.

Null texts and texts without words have an empty set and link with nothing.  Rows without doc_id are left
out: they have no name to be linked by.  Rows that repeat a doc_id are compared each.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.common import WHITE_BYTES, bit_filter, may_contain, remove, save, sliced, small_batches, table
from geolith.operators.graph import contracted

#: Bits of a class's parities: a power of two from the first to the last, by the size of the set.
PARITIES = (1 << 6, 1 << 18)
TILE = 256
#: A class carries its smallest digests of blocks into the tiles, so many at most: a pair that shares one of them
#: is looked at there alone.
FIRSTS = 64
#: Column blocks in which overlaps are accumulated.
STEPS = 8

#: Bytes of a text that are hashed at once, so that memory stays a small multiple of a text of any length.
PART = 1 << 20
WHITE_BYTES_EACH = [bytes([b]) for b in WHITE_BYTES]

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(3_003).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_K = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, as many as a part of a text has bytes."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for x in (_BASE, inverse):
        p = np.full(PART + 1, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K[0]
    h = (h ^ (h >> np.uint64(27))) * _K[1]
    return h ^ (h >> np.uint64(31))


def _words(raw: bytes) -> np.ndarray:
    """Hashes of the words of a part of a text in lower case."""
    raw = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_WHITE[raw]
    edges = np.diff(word)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if len(raw) > PART:  # a word longer than a part
        return np.array([xxhash.xxh3_64_intdigest(raw[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    power, inverse = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_RANDOM[raw] * power[: len(raw)], out=sums[1:])
    sums = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return mix(sums)


def _parts(raw: bytes) -> Iterator[bytes]:
    """The text in parts of at most PART bytes that end at white space; a longer word is a part by itself."""
    while len(raw) > PART:
        cut = max(raw.rfind(c, 0, PART) for c in WHITE_BYTES_EACH)
        if cut < 0:
            cut = min((at for c in WHITE_BYTES_EACH if (at := raw.find(c, PART)) >= 0), default=len(raw))
        yield raw[:cut]
        raw = raw[cut + 1 :]
    yield raw


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of the whole text, A-Z in lower case."""
    raw = (text or "").encode("utf-8", "replace").lower()
    words = _words(raw) if len(raw) <= PART else np.concatenate([_words(p) for p in _parts(raw)])
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(n, len(words))  # fewer words: the whole sequence is one
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * _K[2] + words[i : len(words) - width + 1 + i])
    return np.unique(out)


@functools.lru_cache(maxsize=None)
def _limits(percent: int, up_to: int) -> tuple[int, ...]:
    """Where the size classes begin: the sizes that can't link with any of the class before the last."""
    limits = [1]
    while limits[-1] <= up_to:
        limits.append(limits[-1] * 100 // percent + 1)
    return tuple(limits)


def blocks_of(ngrams: np.ndarray, percent: int) -> np.ndarray:
    """Digests of the column blocks of a set, for both size classes in which it can meet a partner."""
    size = len(ngrams)
    limits = _limits(percent, 1 << max(10, (2 * size).bit_length()))
    own = int(np.searchsorted(limits, size, "right")) - 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(mix(ngrams ^ _K[2]), out=sums[1:])
    out, short = [], False
    for group in (own, own + 1):
        k = 2 * (limits[group + 1] - 1) * (100 - percent) // (100 + percent)
        p = k + k // 5 + 2
        borders = _borders(ngrams, p)
        held = np.diff(borders) > 0
        short |= int(held.sum()) <= k
        number = np.arange(p, dtype=np.uint64)
        digest = mix(sums[borders[1:]] - sums[borders[:-1]] + mix(number + np.uint64(group << 32) + np.uint64(1)))
        out.append(digest[held])
    if short:
        out.append(mix(ngrams[: size + percent * -size // 100 + 1] ^ _K[0]))
    return np.concatenate(out).view(np.int64)


def _borders(ngrams: np.ndarray, p: int) -> np.ndarray:
    """Where each of p equal ranges of hashes begins, and the end."""
    limits = np.arange(1, p, dtype=np.uint64) * np.uint64((1 << 64) // p)
    return np.concatenate([[0], np.searchsorted(ngrams, limits), [len(ngrams)]])


def parities(ngrams: np.ndarray) -> bytes:
    """A bit for each of many narrow blocks: whether it holds an odd number of n-grams."""
    bits = min(max(1 << (len(ngrams) - 1).bit_length(), PARITIES[0]), PARITIES[1])
    odd = np.bincount((ngrams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(odd: bytes, width: int) -> np.ndarray:
    """Parities of blocks that are joined until width bytes are left."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.uint64).reshape(-1, width // 8), 0)


def differing(a: bytes, b: bytes) -> int:
    """A number that the n-grams in one of two sets only can't be below, from their parities."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())


def wanted(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The least overlap with which sets of sizes a and b reach percent: 100 i >= percent (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


def reaching(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether the overlap of each pair of sorted sets reaches percent.

    The product of the pairs' rows, one block of columns after the other: entries (pair, n-gram) of both sides are
    matched by a hash of the two, and counted by pair.
    """
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    least = wanted(sizes[:, 0], sizes[:, 1], percent)
    counts, open_ = np.zeros(len(left), np.int64), sizes.min(1) >= least
    cuts = [np.array([_borders(x, STEPS) for x in side], np.int64).reshape(-1, STEPS + 1) for side in (left, right)]
    for step in range(STEPS):
        pairs = np.flatnonzero(open_)
        if not len(pairs):
            break
        entries = []
        for side, cut in zip((left, right), cuts, strict=True):
            spans = cut[pairs, step : step + 2]
            ngrams = np.concatenate([side[i][a:b] for i, (a, b) in zip(pairs.tolist(), spans.tolist(), strict=True)])
            pair = np.repeat(pairs, spans[:, 1] - spans[:, 0])
            entries.append((mix(ngrams ^ mix(pair.astype(np.uint64) + _K[1])), pair))
        (a, pair), (b, _) = entries
        b = np.sort(b)
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        hit = b[at] == a if len(b) else np.zeros(len(a), bool)
        counts += np.bincount(pair[hit], minlength=len(counts))
        to_come = np.minimum(*(sizes[:, i] - cuts[i][:, step + 1] for i in (0, 1)))
        open_ &= counts + to_come >= least
    return open_


def _incidence(percent: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, sizes, digests, blocks, odd = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                ngrams = shingles(text, n)
                sizes.append(len(ngrams))
                digests.append(np.array([np.add.reduce(mix(ngrams + k), dtype=np.uint64) for k in _K[:2]]).tobytes() if len(ngrams) else None)
                blocks.append(blocks_of(ngrams, percent) if len(ngrams) else np.zeros(0, np.int64))
                odd.append(parities(ngrams) if len(ngrams) else None)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype(np.int32)
            values = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(odd, pa.binary())], ["doc_id", "n", "digest", "blocks", "parities"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(text, n) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "c", "ngrams"])

    return run


def _bounded(percent: int):
    """Of (x, y, nx, ny, px, py) the pairs whose parities allow the overlap that their sizes ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = nx + ny - 2 * wanted(nx, ny, percent)
            fits = [differing(px, py) <= k for px, py, k in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True)]
            fits = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fits), batch.column(1).filter(fits)], ["x", "y"])

    return run


def _linked(percent: int):
    """Of (x, y, sx, sy) the pairs whose overlap reaches percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3))
            fits = pa.array(reaching(left, right, percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fits), batch.column(1).filter(fits)], ["a", "b"])

    return run


def _tile_pairs(percent: int):
    """Pairs of a tile across components; rows: key, i, j, c, label, n, parities, firsts, chunk.

    A pair that shares a smaller digest among the first ones of both is left to that block's tile, so that it
    comes once and not for every block that it shares.
    """

    def run(tile: pa.Table) -> pa.Table:
        chunk, c, label, size = (tile.column(k).to_numpy() for k in ("chunk", "c", "label", "n"))
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        odd = tile.column("parities").to_pylist()
        width = min(map(len, odd))
        odd = np.stack([folded(x, width) for x in odd])
        key = tile.column("key")[0].as_py()
        smaller = [frozenset(k for k in firsts if k < key) for firsts in tile.column("firsts").to_pylist()]
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        xs, ys = [], []
        for row in left.tolist():
            others = right[(label[right] != label[row]) & ((c[right] > c[row]) if i == j else True)]
            least = wanted(size[others], size[row], percent)
            others = others[np.minimum(size[others], size[row]) >= least]
            most = size[others] + size[row] - 2 * wanted(size[others], size[row], percent)
            others = others[np.bitwise_count(odd[others] ^ odd[row]).sum(1) <= most]
            own = smaller[row]
            others = others[[own.isdisjoint(smaller[y]) for y in others.tolist()]] if own else others
            xs.append(np.full(len(others), c[row]))
            ys.append(c[others])
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (xs, ys))
        return pa.table({"x": x.astype(np.int64), "y": y.astype(np.int64)})

    return run


class _Join:
    """The steps of one join; tables that are needed no longer are removed."""

    def __init__(self, docs: DataFrame, percent: int, n: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
        self.percent, self.n = percent, n
        self.spark = docs.sparkSession
        self.paths: list[str] = []

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = save(df, tag)
        self.paths.append(path)
        return out

    def run(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row with a doc_id."""
        rows, kept = save(small_batches(self.docs).mapInArrow(_incidence(self.percent, self.n), "doc_id long, n long, digest binary, blocks array<long>, parities binary"), "incidence")
        rows = rows.withColumn("c", F.xxhash64("digest"))
        some = rows.where("n > 0")
        self.classes = self.save(some.groupBy("digest", "c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("parities").alias("parities"), F.first(F.slice(F.sort_array("blocks"), 1, FIRSTS)).alias("firsts")), "classes")
        blocks = some.select("c", F.explode("blocks").alias("key"))
        shared = blocks.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "lo")
        shared = self.save(shared, "shared")
        members = may_contain(blocks, F.xxhash64("key"), bit_filter(shared, F.xxhash64("key"))).join(shared, "key").where("c <> lo")
        members = self.save(members.select("key", "lo", "c").distinct(), "members")
        partners = self.save(self.bounded(members.select(F.col("lo").alias("x"), F.col("c").alias("y")).distinct()), "partners")
        edges = self.verified(partners.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"))
        labels = self.components(edges)
        for step in (lambda: self.apart(partners, labels), lambda: self.across(members, labels)):
            more = self.verified(step())
            if not more.isEmpty():
                edges = edges.unionByName(more)
                labels = self.components(edges)
        # The smallest doc_id of each component, for classes with copies or links.
        named = self.classes.join(labels, F.col("c") == F.col("v"), "left").where("copies > 1 OR label IS NOT NULL").select("digest", "rep", F.coalesce("label", "c").alias("label"), "copies")
        least = named.groupBy("label").agg(F.min("rep").alias("component"))
        named, _ = save(named.join(least, "label").select("digest", "component"), "named")
        remove(self.spark, *self.paths)
        return rows.select("doc_id", "n", "digest").join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))

    def components(self, edges: DataFrame) -> DataFrame:
        labels, path = contracted(edges)
        self.paths.append(path)
        return labels

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs (x, y) that are not connected by labels."""
        pairs = pairs.join(labels.toDF("x", "lx"), "x", "left").join(labels.toDF("y", "ly"), "y", "left")
        return pairs.where("coalesce(lx, x) <> coalesce(ly, y)").select("x", "y")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        size = self.classes.select("c", "n", "parities")
        pairs = pairs.join(size.toDF("x", "nx", "px"), "x").join(size.toDF("y", "ny", "py"), "y")
        pairs = pairs.where(f"100 * least(nx, ny) >= {self.percent} * greatest(nx, ny)")
        return pairs.select("x", "y", "nx", "ny", "px", "py").mapInArrow(_bounded(self.percent), "x long, y long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of classes that link, as edges (a, b)."""
        pairs = self.save(pairs, "pairs")
        asked = pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct()
        asked = self.save(asked.join(self.classes, "c").select("c", "rep"), "asked")
        bits = bit_filter(asked, F.xxhash64("rep"))
        texts = may_contain(self.docs, F.xxhash64("doc_id"), bits)
        texts = texts.join(asked, F.col("doc_id") == F.col("rep")).select("doc_id", "c", "text")
        sets = self.save(small_batches(texts).mapInArrow(_sets(self.n), "doc_id long, c long, ngrams binary").dropDuplicates(["c", "ngrams"]).select("c", "ngrams"), "sets")
        both = pairs.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y").select("x", "y", "sx", "sy")
        return self.save(small_batches(both).mapInArrow(_linked(self.percent), "a long, b long"), "links")

    def across(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of classes that share a block and lie in different components; the smallest of a block is tested already."""
        known = members.join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        known = self.save(known.select("key", "c", "label"), "known")
        mixed = known.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("m")).where("l1 <> l2")
        mixed = mixed.select("key", F.ceil(F.col("m") / TILE).cast("int").alias("chunks"))
        chunked = known.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
        chunked = chunked.join(self.classes.select("c", "n", "parities", "firsts"), "c")
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        tiles = chunked.withColumn("o", other).select("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "c", "label", "n", "parities", "firsts", "chunk")
        return tiles.groupBy("key", "i", "j").applyInArrow(_tile_pairs(self.percent), "x long, y long").distinct()


def jaccard_components(docs: DataFrame, percent: int = 90, n: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of docs (doc_id, text): links are pairs of sets with 100 i >= percent u."""
    if not 50 <= percent <= 100 or math.floor(percent) != percent:
        raise ValueError("percent is a whole number from 50 to 100")
    return _Join(docs, percent, n).run()


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
