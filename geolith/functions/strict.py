"""Strict reading of JSON documents: what a lenient parser lets pass, found over the bytes of a whole Arrow batch at once."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is found, in this order.  'number': not a number, infinite, or written otherwise than its shortest form.
FAULTS = ["mark", "unclosed", "space", "number", "escape", "repeated_key", "order_of_keys"]

_QUOTE, _SLASH, _COLON = ord('"'), ord("\\"), ord(":")
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_OPENS, _CLOSES = np.isin(np.arange(256), [ord("{"), ord("[")]), np.isin(np.arange(256), [ord("}"), ord("]")])
_PLAIN = np.isin(np.arange(256), [ord(c) for c in '{}[],:"'])
# The escapes of the canonical form are those of quote, backslash and control characters with a short name or hexadecimal digits.
_SHORT = np.isin(np.arange(256), [ord(c) for c in '"\\bfnrtu'])
_LONG = pa.array([f"{i:04x}" for i in range(32) if i not in (8, 9, 10, 12, 13)])
_WORDS = ("true", "false", "null")


def _strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - begins
    total = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(begins - total[:-1], sizes) + np.arange(int(total[-1]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _is_number(token: bytes) -> bool:
    """Whether the token is a number in the shortest form that gives it back."""
    try:
        value = json.loads(token)
    except ValueError:
        return False
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and json.dumps(value).encode() == token


def scan(documents: pa.Array) -> np.ndarray:
    """Rows by FAULTS: whether each document has the fault.  Null documents have none."""
    n = len(documents)
    out = np.zeros((n, len(FAULTS)), bool)
    texts = pc.fill_null(documents.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(n), sizes)
    long = np.flatnonzero(sizes >= 3)
    out[long, 0] = (data[bounds[long][:, None] + np.arange(3)] == np.frombuffer(b"\xef\xbb\xbf", np.uint8)).all(1)
    if not len(data):
        return out

    def mark(rows: np.ndarray, fault: str) -> None:
        out[rows, FAULTS.index(fault)] = True

    # A character is escaped after an odd run of backslashes.
    index = np.arange(len(data))
    slash = data == _SLASH
    other = np.maximum.accumulate(np.where(slash, -1, index))
    run = np.r_[0, (index - other)[:-1]]
    run = np.minimum(run, index - bounds[:-1][row])
    escaped = run % 2 == 1
    quote = (data == _QUOTE) & ~escaped
    upto = np.r_[0, np.cumsum(quote)]
    inside = (upto[:-1] - upto[bounds[:-1]][row]) % 2 == 1  # before this byte
    mark(np.flatnonzero((upto[bounds[1:]] - upto[bounds[:-1]]) % 2 == 1), "unclosed")
    text = inside & ~quote  # what stands in strings
    mark(row[_SPACE[data] & ~inside], "space")
    # Escapes: a known one, and the long form only where there is no shorter one.
    after = np.flatnonzero(escaped & text)
    mark(row[after[~_SHORT[data[after]]]], "escape")
    units = after[data[after] == ord("u")]
    whole = units[units + 5 <= bounds[1:][row[units]]]
    mark(row[np.setdiff1d(units, whole)], "escape")
    if len(whole):
        digits = _strings(data, whole + 1, whole + 5).cast(pa.binary())
        known = pc.is_in(digits, value_set=_LONG.cast(pa.binary())).to_numpy(zero_copy_only=False)
        mark(row[whole[~known]], "escape")
    # Other tokens: words and numbers.
    token = ~inside & ~_PLAIN[data] & ~_SPACE[data]
    token[(bounds[:-1][out[:, 0]][:, None] + np.arange(3)).ravel()] = False
    edge = np.ones(len(data), bool)
    edge[1:] = row[1:] != row[:-1]
    begins = np.flatnonzero(token & (edge | ~np.r_[False, token[:-1]]))
    if len(begins):
        stop = ~token | edge
        stops = np.r_[np.flatnonzero(stop), len(data)]
        ends = stops[np.searchsorted(stops, begins, "right")]
        found = _strings(data, begins, ends).cast(pa.binary()).dictionary_encode()
        good = np.array([x.decode("latin-1") in _WORDS or _is_number(x) for x in found.dictionary.to_pylist()], bool)
        mark(row[begins[~good[found.indices.to_numpy()]]], "number")
    # Keys, and the object that each belongs to: the last one opened before it at its depth.
    opens, closes = _OPENS[data] & ~inside, _CLOSES[data] & ~inside
    depth = np.cumsum(opens.astype(np.int64) - closes)
    depth -= np.r_[0, depth][bounds[:-1]][row]
    mark(np.flatnonzero(np.where(sizes > 0, depth[np.maximum(bounds[1:] - 1, 0)], 0) != 0), "unclosed")
    solid = np.flatnonzero(~(_SPACE[data] & ~inside))
    follows = np.zeros(len(data), bool)
    follows[solid[:-1]] = (data[solid[1:]] == _COLON) & ~inside[solid[1:]] & (row[solid[1:]] == row[solid[:-1]])
    last = np.flatnonzero(quote & inside & follows)
    if not len(last):
        return out
    quotes = np.flatnonzero(quote)
    first = quotes[np.searchsorted(quotes, last) - 1]
    keys = _strings(data, first + 1, last).cast(pa.binary()).dictionary_encode()
    spelt = [json.loads(b'"' + k + b'"', strict=False).encode("utf-8", "surrogatepass") if b"\\" in k and _decodes(k) else k for k in keys.dictionary.to_pylist()]
    ranks = np.unique(np.array(spelt, object), return_inverse=True)[1] if spelt else np.zeros(0, np.int64)
    key_rank = ranks[keys.indices.to_numpy()]
    marks = np.concatenate([np.flatnonzero(opens), first])
    of_key = np.r_[np.full(int(opens.sum()), -1), key_rank]
    order = np.lexsort((marks, depth[marks], row[marks]))  # the depth of an opening is that of its members
    marks, of_key = marks[order], of_key[order]
    objects = np.cumsum(of_key < 0)
    own = of_key >= 0
    obj, rank, at = objects[own], of_key[own], marks[own]
    same = np.r_[False, (obj[1:] == obj[:-1]) & (row[at[1:]] == row[at[:-1]]) & (depth[at[1:]] == depth[at[:-1]])]
    mark(row[at[same & np.r_[False, rank[1:] < rank[:-1]]]], "order_of_keys")
    by = np.lexsort((rank, obj))
    again = np.r_[False, (obj[by][1:] == obj[by][:-1]) & (rank[by][1:] == rank[by][:-1])]
    mark(row[at[by[again]]], "repeated_key")
    return out


def _decodes(key: bytes) -> bool:
    try:
        json.loads(b'"' + key + b'"', strict=False)
    except ValueError:
        return False
    return True


@F.arrow_udf(T.ArrayType(T.StringType()))
def _found(documents: pa.Array) -> pa.Array:
    faults = scan(documents)
    rows, which = np.nonzero(faults)
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(faults)))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(FAULTS).take(pa.array(which)))


def faults(document: str | Column) -> Column:
    """What departs from the canonical form of JSON (sorted keys, no spaces, no needless escapes, shortest numbers) in a document, an empty array if nothing does.

    A document in which that finds nothing but that is no JSON has the fault 'syntax'.
    """
    value = F.col(document) if isinstance(document, str) else document
    found = _found(value)
    return F.when(value.isNull(), F.array().cast("array<string>")).when((F.size(found) == 0) & F.try_parse_json(value).isNull(), F.array(F.lit("syntax"))).otherwise(found)
