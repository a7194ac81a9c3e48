"""Language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector of its 1- to 3-byte n-grams (lower case, letters only, hashed into DIMS
places), of length 1.  Each language has up to ``clusters`` centroids from spherical k-means; a text gets
the language of the centroid with the highest cosine.  A text is rejected if it has no letter, or if it
is farther from its centroid than any plausible text of that language and length: its cosine is under
``slack`` times that of the farthest 2 % of equally long passages of the training texts.  Short
passages lie farther from a centroid than long ones, so the limit grows with the number of n-grams.  For
it each passage is compared with centroids that its own text had no part in.

The model is fitted on at most ``per_language`` training rows of each language, the first by a hash of
doc_id; all rows are predicted on their whole texts.  Null texts and texts without letters are ``und``
with score 0.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.llm.common import map_batches, remove, save, sliced, small_batches, table

DIMS = 4096
#: Bytes of a text that are counted at once, so that memory stays bounded for texts of any length.
SLICE = 1 << 20
#: How many times as many rows as are wanted lie under the limit by which training rows are chosen.
OVER = 4
#: Characters of the training texts' passages by which the limits are set.
PASSAGES = (4, 16, 64, 256, 1024)
#: Share of the passages that may be farther than what the limits are set by: some hold digits, keys or junk.
LOW = 0.02
#: ASCII bytes other than letters become spaces; bytes of longer characters stay.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
HAS_LETTER = regex.compile(r"\p{L}").search


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers that hash n-grams: one random number for each byte at each distance."""
    rng = np.random.default_rng(20_001)
    return tuple(rng.integers(0, 1 << 31, 256, dtype=np.int64) for _ in range(3))


def counts(text: str) -> np.ndarray:
    """How often the n-grams of each place occur in the text; those that end in white space count once a word."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(LETTERS), np.uint8)
    a, b, c = _tables()
    out = np.zeros(DIMS)
    for at in range(0, max(len(raw), 1), SLICE):
        part = raw[at : at + SLICE + 2]
        own = part[:SLICE]
        word = own != 32
        one = a[own]
        out += np.bincount((one[word] >> 8) & (DIMS - 1), minlength=DIMS)
        if len(part) > 1:
            k = min(len(own), len(part) - 1)
            two = one[:k] ^ b[part[1 : k + 1]]
            word2 = word[:k] | (part[1 : k + 1] != 32)
            out += np.bincount((two[word2] >> 8) & (DIMS - 1), minlength=DIMS)
            if len(part) > 2:
                k3 = min(len(own), len(part) - 2)
                three = two[:k3] ^ c[part[2 : k3 + 2]]
                out += np.bincount((three[word2[:k3]] >> 8) & (DIMS - 1), minlength=DIMS)
    return out


def passage(text: str) -> str:
    """As much from the middle of the text as the longest of the PASSAGES, from the start of a word if there is one."""
    at = max(0, (len(text) - PASSAGES[-1]) // 2)
    if at:
        at = text.find(" ", at, at + 200) + 1 or at
    return text[at : at + PASSAGES[-1]]


class Centroids:
    """idf, centroids, their languages and least cosines by number of n-grams."""

    def __init__(self, idf: np.ndarray, languages: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """languages: the centroids of each, logarithms of numbers of n-grams, rising, and the least cosine at each."""
        self.idf = idf
        self.names = sorted(languages)
        self.limits = [languages[x][1:] for x in self.names]
        self.rows = np.concatenate([languages[x][0] for x in self.names])
        self.of = np.repeat(np.arange(len(self.names)), [len(languages[x][0]) for x in self.names])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        if not text or not HAS_LETTER(text):
            return "und", 0.0, True
        found = counts(text)
        cosine = self.rows @ _vectors(found[None, :], self.idf)[0]
        best = np.full(len(self.names), -1.0)
        np.maximum.at(best, self.of, cosine)
        at = int(best.argmax())
        odds = np.exp(30.0 * (best - best[at]))
        return self.names[at], float(1.0 / odds.sum()), bool(best[at] < np.interp(np.log1p(found.sum()), *self.limits[at]))


def _vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(found) * idf)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _kmeans(vectors: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from texts at even steps of their cosine to the mean, so that no start is an odd text."""
    k = min(clusters, len(vectors))
    order = np.argsort(vectors @ vectors.mean(0), kind="stable")
    centres = vectors[order[(2 * np.arange(k) + 1) * len(vectors) // (2 * k)]]
    for _ in range(rounds):
        centres = _unit(centres)
        nearest = (vectors @ centres.T).argmax(1)
        # A small cluster is no centre of a language: it could be a few odd texts.
        sizes = np.bincount(nearest, minlength=len(centres))
        keep = np.flatnonzero(sizes >= max(1, len(vectors) // 50))
        centres = np.array([vectors[nearest == k].sum(0) for k in keep])
    return _unit(centres)


def _limits(own: np.ndarray, centres: np.ndarray, passages: list[str], idf: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of numbers of n-grams, rising, and the least cosine at each."""
    nearest = (own @ centres.T).argmax(1)
    sums = np.array([own[nearest == k].sum(0) for k in range(len(centres))])

    def low(rows: np.ndarray, at: np.ndarray) -> float:
        cosine = rows @ centres.T
        others = _unit(sums[nearest[at]] - own[at])  # a text's centre without the text
        cosine[np.arange(len(at)), nearest[at]] = (rows * others).sum(1)
        return slack * float(np.quantile(cosine.max(1), LOW))

    whole, sizes, least = low(own, np.arange(len(own))), [], []
    for width in PASSAGES:
        at = np.array([i for i, x in enumerate(passages) if len(x) >= width and HAS_LETTER(x[:width])], int)
        if len(at):
            found = np.array([counts(passages[i][:width]) for i in at])
            sizes.append(float(np.log1p(np.median(found.sum(1)))))
            least.append(min(whole, low(_vectors(found, idf), at)))
    return np.maximum.accumulate(np.array(sizes or [0.0])), np.array(least or [whole])


def _fitted(idf: np.ndarray, clusters: int, slack: float):
    """Centroids and limits of one language's training texts."""

    def run(rows: pa.Table) -> pa.Table:
        matrix = np.zeros((rows.num_rows, DIMS), np.float32)
        for i, (places, values) in enumerate(zip(rows.column("places").to_pylist(), rows.column("counts").to_pylist(), strict=True)):
            matrix[i, np.frombuffer(places, "<u2")] = np.frombuffer(values, "<f4")
        order = np.lexsort((rows.column("digest").to_numpy(),))  # the same texts give the same centroids
        own = _vectors(matrix[order], idf)
        passages = rows.column("passage").to_pylist()
        centres = _kmeans(own, clusters)
        sizes, least = _limits(own, centres, [passages[i] for i in order.tolist()], idf, slack)
        return pa.table({"lang": rows.column("lang")[:1], "centres": [centres.astype("<f4").tobytes()], "sizes": [sizes.tolist()], "least": [least.tolist()]}, _MODEL)

    return run


_MODEL = pa.schema([("lang", pa.string()), ("centres", pa.binary()), ("sizes", pa.list_(pa.float64())), ("least", pa.list_(pa.float64()))])


def held_out(of: str = "doc_id") -> Column:
    return F.crc32(F.col(of).cast("string")) % 4 == 2


def fit(docs: DataFrame, per_language: int = 500, clusters: int = 3, slack: float = 0.5) -> Centroids:
    """The model, from rows with a language that are not held out.

    At most ``per_language`` different rows of each language, the first by a hash of doc_id and text, are counted.  Texts are counted and each
    language's k-means runs in the executors; the driver gets the idf and the centroids.
    """
    # Rows are chosen, not doc_ids: a row without language is no example, whatever other rows of its doc_id have.
    hashed = F.xxhash64("doc_id", "text").alias("h")
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(True))).select("lang", hashed, "text")
    # A row for each language, of which the model itself, shipped to all tasks, holds centroids.
    # The first by hash are among those under a limit that OVER times as many reach, so that few rows of a common language are ranked.
    shares = own.groupBy("lang").agg((F.lit(float(OVER * per_language)) / F.count("*")).alias("share")).withColumnRenamed("lang", "l")
    near = own.join(F.broadcast(shares), F.col("lang") == F.col("l")).where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))  # of repeated rows one
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = once.withColumn("turn", turn).where(F.col("turn") <= per_language).select(F.col("lang").alias("__lang"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs = [(x, t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if HAS_LETTER(t)]
            found = [counts(t) for _, t in pairs]
            places = [np.flatnonzero(x) for x in found]
            columns = [
                pa.array([x for x, _ in pairs], pa.string()), pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()),
                pa.array([x[p].astype("<f4").tobytes() for x, p in zip(found, places, strict=True)], pa.binary()), pa.array([passage(t) for _, t in pairs], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "places", "counts", "passage"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many texts of a task each place occurs; place DIMS counts the texts."""
        found = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for places in batch.column(0).to_pylist():
                found[np.frombuffer(places, "<u2")] += 1
                found[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(found)], ["place", "n"])

    found, path = save(small_batches(rows).mapInArrow(counted, "lang string, places binary, counts binary, passage string").withColumn("digest", F.xxhash64("counts", "passage")), "languages")
    total = found.select("places").mapInArrow(held, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").toArrow().column("n").to_numpy()
    if not len(total) or not total[DIMS]:
        model = Centroids(np.zeros(DIMS), {"und": (np.zeros((1, DIMS)), np.zeros(1), np.zeros(1))})
    else:
        idf = np.log((1.0 + total[DIMS]) / (1.0 + total[:DIMS])) + 0.1
        fitted = found.groupBy("lang").applyInArrow(_fitted(idf, clusters, slack), "lang string, centres binary, sizes array<double>, least array<double>").collect()
        model = Centroids(idf, {x.lang: (np.frombuffer(x.centres, "<f4").reshape(-1, DIMS).astype(float), np.array(x.sizes), np.array(x.least)) for x in fitted})
    remove(docs.sparkSession, path)
    return model


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """All columns of docs, and __lang, __score and __rejected, which replace columns of those names."""
    docs = docs.drop("__lang", "__score", "__rejected")
    names = docs.columns
    at = names.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in sliced(batches):
            found = [own.predict(text) for text in batch.column(at).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "__lang", "__score", "__rejected"])

    schema = docs.select("*", F.lit("").alias("__lang"), F.lit(0.0).alias("__score"), F.lit(False).alias("__rejected")).schema
    return map_batches(docs, run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))
