"""Fill-in-the-middle transformation of whole texts, cut at units by a sparse checkpoint index.

A unit is a run of ASCII letters or any other single code point (``[A-Za-z]+|[^A-Za-z]``).  Counting the units
of a text records a checkpoint at every ``STEP``-th unit: its number, its byte offset and its code-point offset.
A cut after k units binary-searches the checkpoints and scans on from there to the cut, at most to the next
checkpoint; no list of all units is kept.  A text is counted in windows, so that beside the text itself
memory holds one window and the checkpoints.

Prefix, middle and suffix follow from the hash of the doc_id alone, so rows that repeat a doc_id and text get the
same output and a rerun changes nothing.  A null text counts as empty, and an empty text stays plain.  A row without
doc_id is cut by the hash of ``<seed>:``.  Every row of the input gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.common import sliced, small_batches, table

#: Units between two checkpoints, and bytes that are counted at a time.
STEP, WINDOW = 256, 1 << 20
#: What marks prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _starts(data: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit, and which begin a code point; before: a letter stands in front of the data."""
    letter, point = _LETTER[data], ~_CONTINUES[data]
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    if len(data) and before and letter[0]:
        unit[0] = False
    return unit, point


class CheckpointIndex:
    """Offsets of every step-th unit of a text, in UTF-8, and exact cuts from them."""

    def __init__(self, text: bytes, step: int = STEP, window: int = WINDOW):
        self.data = np.frombuffer(text, np.uint8)
        units, at_bytes, at_points = [], [], []
        self.n_units = self.n_points = 0
        for begin in range(0, len(self.data), window):
            part = self.data[begin : begin + window]
            unit, point = _starts(part, begin > 0 and bool(_LETTER[self.data[begin - 1]]))
            where = np.flatnonzero(unit)
            chosen = where[-self.n_units % step :: step]
            units.append(self.n_units + np.arange(-self.n_units % step, len(where), step))
            at_bytes.append(begin + chosen)
            n_points = np.cumsum(point)
            at_points.append(self.n_points + n_points[chosen] - 1)
            self.n_units += len(where)
            self.n_points += int(n_points[-1])
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.units, self.bytes, self.points = joined(units), joined(at_bytes), joined(at_points)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first so many units."""
        if units >= self.n_units:
            return len(self.data), self.n_points
        k = int(np.searchsorted(self.units, units, "right")) - 1
        begin, end = int(self.bytes[k]), int(self.bytes[k + 1]) if k + 1 < len(self.bytes) else len(self.data)
        unit, point = _starts(self.data[begin:end], False)
        at = int(np.flatnonzero(unit)[units - int(self.units[k])])
        return begin + at, int(self.points[k]) + int(np.count_nonzero(point[:at]))


def _hash_parts(seed: int, doc_id: Column) -> list[Column]:
    """The first four groups of eight hexadecimal digits of sha256(``seed:doc_id``) as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row a document: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``percent`` of the documents are cut, ``spm_percent`` of those with the suffix first.  Documents that hold one of the marks stay plain,
    so that ``restored`` can always tell the marks from the text.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            rows = [c.to_pylist() for c in (batch.column(1).cast(pa.binary()), *batch.columns[2:])]
            for text, h1, h2, h3, h4 in zip(*rows, strict=True):
                text = text or b""
                index = CheckpointIndex(text)
                counts.append(index.n_units)
                if not text or h3 % 100 >= percent or any(x in text for x in marks):
                    for column, value in zip((forms, prefixes, middles, outputs), ("plain", None, None, text), strict=True):
                        column.append(value)
                    continue
                first, second = sorted((h1 % (index.n_units + 1), h2 % (index.n_units + 1)))
                (a, a_points), (b, b_points) = index.cut(first), index.cut(second)
                spm = h4 % 100 < spm_percent
                forms.append("spm" if spm else "psm")
                prefixes.append(a_points)
                middles.append(b_points - a_points)
                outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip((counts, forms, prefixes, middles), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(outputs, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc_id = F.col("doc_id").cast("long")
    return small_batches(docs).select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *_hash_parts(seed, doc_id)).mapInArrow(run, OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(table(spark, sf_dir, "documents"))
    digest = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), digest.alias("restored_sha256"))


SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
parts AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
cuts AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM parts),
made AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM made
"""
