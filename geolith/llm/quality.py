"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on the statistics of labelled texts; every path from a root to a node is a
rule, a conjunction of bounds.  Logistic regression with a lasso penalty gives most rules the weight 0, and
the others are compiled into a Spark column expression over the statistics.

The rules are fitted on at most ``most_rows`` labelled rows, the first by a hash of doc_id, that are not held
out; all rows are scored on their whole texts.  Null texts count as empty, and empty texts get a score
like any other.  Labels that are null do not count; of several labels for a doc_id the mean counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.common import map_batches, sliced, table

#: Statistics of a text, in the order in which statistics() returns them.
STATISTICS = (
    "n_chars", "n_words", "mean_word", "symbols", "upper", "digits", "marks", "bars", "stops", "non_ascii",
    "lines_a_word", "distinct_lines", "distinct_words", "common_word", "odd_ends", "longest_word",
)

_SYMBOLS = b"#$%&*+/<=>@\\^_`{}~"
_MARKS = b"!?"
_BAR = b"|"
_STOPS = b".,;:"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_ODD_ENDS = frozenset("#$%&*+/<=>@\\^_`{}~|!")


def statistics(text: str | None) -> tuple[float, ...]:
    """The STATISTICS of a whole text; of an empty one all are 0."""
    if not text:
        return (0.0,) * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    size = len(raw)

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    words = text.split()
    n = max(1, len(words))
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [x for x in text.split("\n") if x]
    return (
        float(len(text)), float(len(words)), sum(map(len, words)) / n, share(_SYMBOLS), share(_UPPER), share(_DIGITS), share(_MARKS), share(_BAR), share(_STOPS), share(_HIGH),
        len(lines) / n, len(set(lines)) / max(1, len(lines)), len(seen) / n, max(seen.values(), default=0) / n, sum(1 for w in words if w[-1] in _ODD_ENDS) / n, float(max(map(len, words), default=0)),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns of docs, and __<statistic> for each of STATISTICS, which replace columns of those names."""
    new = [f"__{s}" for s in STATISTICS]
    docs = docs.drop(*new)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in found.T]], [*names, *new])

    return map_batches(docs, run, docs.select("*", *[F.lit(0.0).alias(n) for n in new]).schema)


Rule = tuple[tuple[int, bool, float], ...]  # conditions: statistic, at most (else above), bound


def _grow(x: np.ndarray, residual: np.ndarray, at: np.ndarray, bounds: list[np.ndarray], depth: int, path: Rule, rules: list[Rule], step: np.ndarray, least: int) -> None:
    """Splits the rows ``at`` by least squares and notes every path."""
    if path:
        rules.append(path)
    best = (1e-9, -1, 0.0)
    r = residual[at]
    total, n = r.sum(), len(at)
    if depth and n >= 2 * least:
        for j, cuts in enumerate(bounds):
            if not len(cuts):
                continue
            bins = np.searchsorted(cuts, x[at, j], "left")  # bin k: at most cuts[k]
            ns = np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1]
            sums = np.cumsum(np.bincount(bins, r, minlength=len(cuts) + 1))[:-1]
            fits = (ns >= least) & (n - ns >= least)
            if fits.any():
                gain = np.where(fits, sums**2 / np.maximum(ns, 1) + (total - sums) ** 2 / np.maximum(n - ns, 1) - total**2 / n, -1)
                if gain[k := int(gain.argmax())] > best[0]:
                    best = (float(gain[k]), j, float(cuts[k]))
    if best[1] < 0:
        step[at] = r.mean()
        return
    _, j, cut = best
    low = x[at, j] <= cut
    for side, rows in ((True, at[low]), (False, at[~low])):
        _grow(x, residual, rows, bounds, depth - 1, (*path, (j, side, cut)), rules, step, least)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, cut in rule:
        out &= (x[:, j] <= cut) == low
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, least: int = 5) -> tuple[float, list[tuple[float, Rule]]]:
    """The intercept, and the rules with weights other than 0."""
    if not len(y) or y.min() == y.max():
        return (4.0 if len(y) and y.min() > 0.5 else -4.0 if len(y) else 0.0), []
    bounds = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, 65), method="lower"))
        above = np.array([column[column > v].min(initial=np.inf) for v in values])
        bounds.append(np.unique((values + above)[np.isfinite(above)] / 2))  # between values that occur
    least = max(1, min(least, len(y) // 20))
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: list[Rule] = []
    for _ in range(trees):
        step = np.zeros(len(y))
        p = 1 / (1 + np.exp(-z))
        _grow(x, y - p, np.arange(len(y)), bounds, depth, (), rules, step, least)
        z += rate * step * 4
    distinct: dict[bytes, Rule] = {}
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):  # of rules that hold for the same rows the shortest stays
        held = _holds(rule, x)
        if 0 < held.sum() < len(y):
            distinct.setdefault(held.tobytes(), rule)
    kept = list(distinct.values())
    design = np.array([_holds(r, x) for r in kept], float).T if kept else np.zeros((len(y), 0))
    scale = np.maximum(design.std(0), 0.05)
    intercept, weights = _lasso(design / scale, y, penalty)
    return intercept, [(float(w / s), r) for w, s, r in zip(weights, scale, kept, strict=True) if w]


def _lasso(design: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal steps."""
    n, k = design.shape
    full = np.column_stack([np.ones(n), design])
    v = np.ones(k + 1)
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(full @ v) ** 2) / 1.05
    w = np.zeros(k + 1)
    w[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    ahead, t = w.copy(), 1.0
    shrink = np.full(k + 1, step * penalty)
    shrink[0] = 0
    for _ in range(rounds):
        slope = full.T @ (1 / (1 + np.exp(-(full @ ahead))) - y) / n
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def compiled(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The score as a column expression over the statistics' columns."""
    z = F.lit(intercept)
    for weight, rule in rules:
        condition = None
        for j, low, cut in rule:
            stat = F.col(f"__{STATISTICS[j]}")
            bound = stat <= F.lit(cut) if low else stat > F.lit(cut)
            condition = bound if condition is None else condition & bound
        z = z + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and rules from labelled rows that are not held out.

    At most ``most_rows`` of them, the first by a hash of their doc_ids, come to the driver as statistics.  Rows that repeat a labelled doc_id
    take part each as long as their statistics differ; a doc_id that is labelled several times has the label of most.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("__y"))
    by = F.xxhash64("doc_id")
    known = known.orderBy(by, "doc_id").limit(most_rows).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    columns = [f"__{s}" for s in STATISTICS]
    found = with_statistics(rows.select("doc_id", "__y", "text")).drop("text").distinct().orderBy(by, "doc_id", *columns).limit(most_rows)
    found = found.toArrow().sort_by([(c, "ascending") for c in ("doc_id", *columns)])
    x = np.array([found.column(c).to_numpy() for c in columns]).T
    return fit_rules(x, found.column("__y").to_numpy())


def score(docs: DataFrame, model: tuple[float, list[tuple[float, Rule]]]) -> DataFrame:
    """All columns of docs, and __score, which replaces a column of that name; columns named like statistics are dropped."""
    docs = docs.drop("__score", *[f"__{s}" for s in STATISTICS])
    return with_statistics(docs).select(*[F.col(f"`{c}`") for c in docs.columns], compiled(*model).alias("__score"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
