"""Geometries of an Arrow batch as flat buffers: one array of x and of y, and offsets of rings, parts and rows.

Codecs, checks and simplification run over all rows of a batch at once; where a step depends on what was read before
(the next ring's length, the next split of a line), it is taken for all rows together, so that loops run as
often as the deepest row needs and never once a row.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Type codes of well-known binary, and what GeoPackage blobs begin with.
WKB_CODES = {"LineString": 2, "Polygon": 3, "MultiLineString": 5, "MultiPolygon": 6}
LINE, POLYGON, MULTI = 2, 3, 3  # a multi geometry's code is its parts' and MULTI
GPKG_HEAD, SRID = b"GP\x00\x03", 4326  # magic, version 0, little-endian with an envelope of two dimensions
NAMES = {code: name for name, code in WKB_CODES.items()}

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PARTS = pa.list_(pa.list_(pa.list_(POINT)))
GEOMETRY = pa.struct([("geometry_type", pa.string()), ("parts", PARTS)])


class Flat(NamedTuple):
    """Points, and where the rings (of points), parts (of rings) and rows (of parts) begin and the last ends."""

    x: np.ndarray
    y: np.ndarray
    rings: np.ndarray
    parts: np.ndarray
    rows: np.ndarray

    def points_of_rows(self) -> np.ndarray:
        """Where the points of each row begin, and the last ends."""
        return self.rings[self.parts[self.rows]]


def spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(begins - (ends - lengths), lengths)
    return out + np.arange(len(out))


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)].astype(np.int64)


def _opened(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return _bounds(lengths), lists.flatten()


def from_arrow(parts: pa.Array) -> Flat:
    """From parts > rings > points {x, y}; what is null has no members, and null ordinates are not a number."""
    rows, lists = _opened(parts)
    of_parts, lists = _opened(lists)
    of_rings, points = _opened(lists)
    x, y = (pc.fill_null(points.field(i) if not points.null_count else pc.struct_field(points, i), np.nan).to_numpy(zero_copy_only=False) for i in (0, 1))
    return Flat(x.astype(float), y.astype(float), of_rings, of_parts, rows)


def to_arrow(flat: Flat, null: np.ndarray | None = None) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(flat.x), pa.array(flat.y)], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(flat.rings, pa.int32()), points)
    parts = pa.ListArray.from_arrays(pa.array(flat.parts, pa.int32()), rings)
    return pa.ListArray.from_arrays(pa.array(flat.rows, pa.int32()), parts, mask=None if null is None else pa.array(null))


def codes(kinds: pa.Array) -> np.ndarray:
    """The codes of type names; 0 for others and null."""
    known = pa.array(list(WKB_CODES))
    at = pc.fill_null(pc.index_in(kinds, value_set=known), -1).to_numpy(zero_copy_only=False)
    return np.r_[0, list(WKB_CODES.values())][at + 1]


def names(of: np.ndarray) -> pa.Array:
    table = pa.array([NAMES.get(i) for i in range(max(NAMES) + 1)])
    return table.take(pa.array(of))


def _each(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: float) -> np.ndarray:
    """The ufunc over each stretch between bounds; empty stretches have the value that is given."""
    full = np.diff(bounds) > 0
    out = np.full(len(full), empty)
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def envelopes(flat: Flat) -> np.ndarray:
    """min x, max x, min y and max y of each row; not a number for rows without points."""
    at = flat.points_of_rows()
    return np.stack([_each(f, v, at, np.nan) for v in (flat.x, flat.y) for f in (np.minimum, np.maximum)], 1)


def distinct_points(flat: Flat) -> np.ndarray:
    """How many different points each ring has."""
    ring = np.repeat(np.arange(len(flat.rings) - 1), np.diff(flat.rings))
    order = np.lexsort((flat.y, flat.x, ring))
    r, x, y = ring[order], flat.x[order], flat.y[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return np.bincount(r[new], minlength=len(flat.rings) - 1)


def sound(flat: Flat, kinds: np.ndarray) -> np.ndarray:
    """Rows whose positions are in range, whose lines have 2 distinct points and whose rings are closed, of 4 points and 3 distinct ones at least."""
    n_rings, n_parts, n_rows = len(flat.rings) - 1, len(flat.parts) - 1, len(flat.rows) - 1
    of_row = np.repeat(np.arange(n_rows), np.diff(flat.rows))  # of each part
    of_part = np.repeat(np.arange(n_parts), np.diff(flat.parts))  # of each ring
    line = (kinds % MULTI == LINE)[of_row][of_part]
    size, distinct = np.diff(flat.rings), distinct_points(flat)
    first, last = flat.rings[:-1], np.maximum(flat.rings[1:] - 1, 0)
    closed = np.zeros(n_rings, bool)
    some = size > 0
    closed[some] = (flat.x[first[some]] == flat.x[last[some]]) & (flat.y[first[some]] == flat.y[last[some]])
    good = np.where(line, (size >= 2) & (distinct >= 2), (size >= 4) & (distinct >= 3) & closed)
    rings_of_part = np.diff(flat.parts)
    part_good = np.where((kinds % MULTI == LINE)[of_row], rings_of_part == 1, rings_of_part > 0)
    part_good &= np.bincount(of_part, ~good, minlength=n_parts) == 0
    placed = (flat.x >= -180) & (flat.x <= 180) & (flat.y >= -90) & (flat.y <= 90)
    point_row = np.repeat(np.arange(n_rows), np.diff(flat.points_of_rows()))
    parts_of_row = np.diff(flat.rows)
    out = (kinds > 0) & (parts_of_row > 0) & ((kinds > MULTI) | (parts_of_row == 1))
    out &= np.bincount(of_row, ~part_good, minlength=n_rows) == 0
    return out & (np.bincount(point_row, ~placed, minlength=n_rows) == 0)


# Well-known binary.


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Writes the bytes of the values at byte positions."""
    width = values.dtype.itemsize
    out[at[:, None] + np.arange(width)] = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)


def to_blobs(flat: Flat, kinds: np.ndarray, header: bool = False) -> pa.Array:
    """Little-endian well-known binary of each row, with the GeoPackage header before it if asked for; null where a row's parts don't fit its type."""
    of_row = np.repeat(np.arange(len(flat.rows) - 1), np.diff(flat.rows))
    of_part = np.repeat(np.arange(len(flat.parts) - 1), np.diff(flat.parts))
    n_parts, n_rings, n_points = np.diff(flat.rows), np.diff(flat.parts), np.diff(flat.rings)
    line, multi = kinds % MULTI == LINE, kinds > MULTI
    fits = (kinds > 0) & (n_parts > 0) & (multi | (n_parts == 1)) & (np.bincount(of_row, line[of_row] & (n_rings != 1), minlength=len(kinds)) == 0)
    if header:
        fits &= np.diff(flat.points_of_rows()) > 0
    ring_size = 4 + 16 * n_points
    part_head = np.where(line[of_row], 5, 9)
    part_size = part_head + _each(np.add, ring_size, flat.parts, 0).astype(np.int64)
    head = np.where(multi, 9, 0) + (40 if header else 0)
    size = head + _each(np.add, part_size, flat.rows, 0).astype(np.int64)
    rows = _bounds(size)
    out = np.zeros(int(rows[-1]), np.uint8)
    # Where each row, part and ring begins: after its elder siblings.
    part_at = (_bounds(part_size)[:-1] - _bounds(part_size)[flat.rows[:-1]][of_row]) + (rows[:-1] + head)[of_row]
    ring_at = (_bounds(ring_size)[:-1] - _bounds(ring_size)[flat.parts[:-1]][of_part]) + (part_at + part_head)[of_part]
    if header:
        at = rows[:-1]
        out[at[:, None] + np.arange(4)] = np.frombuffer(GPKG_HEAD, np.uint8)
        _put(out, at + 4, np.full(len(at), SRID, "<i4"))
        for i, values in enumerate(envelopes(flat).T):
            _put(out, at + 8 + 8 * i, values.astype("<f8"))
    many = np.flatnonzero(multi)
    at = rows[many] + (40 if header else 0)
    out[at] = 1
    _put(out, at + 1, kinds[many].astype("<u4"))
    _put(out, at + 5, n_parts[many].astype("<u4"))
    out[part_at] = 1
    _put(out, part_at + 1, np.where(line, LINE, POLYGON)[of_row].astype("<u4"))
    areas = np.flatnonzero(~line[of_row])
    _put(out, part_at[areas] + 5, n_rings[areas].astype("<u4"))
    _put(out, ring_at, n_points.astype("<u4"))
    at = np.repeat(ring_at + 4, n_points) + 16 * (np.arange(len(flat.x)) - np.repeat(flat.rings[:-1], n_points))
    _put(out, at, flat.x.astype("<f8"))
    _put(out, at + 8, flat.y.astype("<f8"))
    blobs = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(rows), pa.py_buffer(out)]).cast(pa.binary())
    return blobs if fits.all() else pc.if_else(pa.array(fits), blobs, pa.scalar(None, pa.binary()))


#: What can be wrong with a blob, in the order in which it is found.
FAULTS = [None, "null", "short", "header", "byte_order", "type", "ends_early", "left_over", "empty", "envelope"]
_FAULT = {name: i for i, name in enumerate(FAULTS)}


class _Reader:
    """Cursors of all rows of a batch of blobs."""

    def __init__(self, blobs: pa.Array, header: bool):
        blobs = blobs.cast(pa.large_binary())
        offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
        self.data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
        self.at, self.end = offsets[:-1].copy(), offsets[1:].copy()
        self.fault = np.where(pc.is_null(blobs).to_numpy(zero_copy_only=False), _FAULT["null"], 0)
        self.big = np.zeros(len(self.at), bool)
        self.boxes = np.full((len(self.at), 4), np.nan)
        if header:
            self._header()

    def mark(self, rows: np.ndarray, wrong: np.ndarray, name: str) -> np.ndarray:
        """Notes a fault; returns the rows that have none."""
        self.fault[rows[wrong]] = _FAULT[name]
        return rows[~wrong]

    def bytes_at(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.data[at[:, None] + np.arange(n)]

    def _header(self) -> None:
        rows = np.flatnonzero(self.fault == 0)
        rows = self.mark(rows, self.end[rows] - self.at[rows] < 40, "short")
        found = self.bytes_at(self.at[rows], 8)
        want = np.frombuffer(GPKG_HEAD + np.array([SRID], "<i4").tobytes(), np.uint8)
        rows = self.mark(rows, (found != want).any(1), "header")
        self.boxes[rows] = self.bytes_at(self.at[rows] + 8, 32).view("<f8")
        self.at[rows] += 40

    def numbers(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have four more bytes, and those as unsigned numbers in the row's byte order."""
        rows = self.mark(rows, self.end[rows] - self.at[rows] < 4, "ends_early")
        found = self.bytes_at(self.at[rows], 4)
        values = np.where(self.big[rows], found.view(">u4")[:, 0], found.view("<u4")[:, 0]).astype(np.int64)
        self.at[rows] += 4
        return rows, values

    def kinds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte order and type code of the geometries that begin here."""
        rows = self.mark(rows, self.end[rows] - self.at[rows] < 1, "ends_early")
        order = self.data[self.at[rows]]
        good = order <= 1
        self.big[rows] = order == 0
        self.at[rows] += 1
        rows = self.mark(rows, ~good, "byte_order")
        return self.numbers(rows)


def from_blobs(blobs: pa.Array, header: bool = False) -> tuple[np.ndarray, Flat, np.ndarray]:
    """Type codes, geometries and faults (numbers in FAULTS) of well-known binary in either byte order; faulty rows are empty."""
    reader = _Reader(blobs, header)
    n = len(reader.at)
    kinds, parts_left, rings_left, opened = (np.zeros(n, np.int64) for _ in range(4))
    rows, found = reader.kinds(np.flatnonzero(reader.fault == 0))
    good = np.isin(found, list(WKB_CODES.values()))
    kinds[rows[good]] = found[good]
    rows = reader.mark(rows, ~good, "type")
    many, counts = reader.numbers(rows[kinds[rows] > MULTI])
    parts_left[many] = counts
    parts_left[rows[kinds[rows] <= MULTI]] = 1
    empty = np.zeros(0, np.int64)
    part_rows, part_rings, ring_rows, ring_at, ring_points, ring_big = ([empty] for _ in range(6))
    while len(rows := np.flatnonzero((reader.fault == 0) & (parts_left + rings_left > 0))):
        # The next part of rows that have no ring left, and then the next ring of all.
        opening = rows[rings_left[rows] == 0]
        inner = opening[kinds[opening] > MULTI]
        got, found = reader.kinds(inner)
        reader.mark(got, found != kinds[got] - MULTI, "type")
        opening = opening[reader.fault[opening] == 0]
        parts_left[opening] -= 1
        areas, counts = reader.numbers(opening[kinds[opening] % MULTI != LINE])
        lines = opening[kinds[opening] % MULTI == LINE]
        rings_left[areas], rings_left[lines] = counts, 1
        part_rows += [areas, lines]
        part_rings += [counts, np.ones(len(lines), np.int64)]
        opened[opening] += 1
        rows = rows[(reader.fault[rows] == 0) & (rings_left[rows] > 0)]
        rows, counts = reader.numbers(rows)
        short = 16 * counts > reader.end[rows] - reader.at[rows]
        counts = counts[~short]
        rows = reader.mark(rows, short, "ends_early")
        ring_rows.append(rows)
        ring_at.append(reader.at[rows].copy())
        ring_points.append(counts)
        ring_big.append(reader.big[rows].astype(np.int64))
        reader.at[rows] += 16 * counts
        rings_left[rows] -= 1
    rows = np.flatnonzero(reader.fault == 0)
    reader.mark(rows, reader.at[rows] != reader.end[rows], "left_over")
    bad = reader.fault > 0
    kinds[bad] = 0

    def gathered(of: list[np.ndarray], *columns: list[np.ndarray]) -> list[np.ndarray]:
        """Rows that are sound, in order; in a row things keep the order in which they were read."""
        of_row = np.concatenate(of)
        keep = np.flatnonzero(~bad[of_row])
        keep = keep[np.argsort(of_row[keep], kind="stable")]
        return [of_row[keep], *(np.concatenate(c)[keep] for c in columns)]

    of_part, n_rings = gathered(part_rows, part_rings)
    _, at, n_points, big = gathered(ring_rows, ring_at, ring_points, ring_big)
    where = np.repeat(at, n_points) + 16 * (np.arange(int(n_points.sum())) - np.repeat(_bounds(n_points)[:-1], n_points))
    swapped = np.repeat(big, n_points) == 1
    x, y = (_doubles(reader.data, where + shift, swapped) for shift in (0, 8))
    flat = Flat(x, y, _bounds(n_points), _bounds(n_rings), _bounds(np.bincount(of_part, minlength=n)))
    if header:
        boxes = envelopes(flat)
        left = np.flatnonzero(reader.fault == 0)
        left = reader.mark(left, np.isnan(boxes[left]).any(1), "empty")
        reader.mark(left, (boxes[left] != reader.boxes[left]).any(1), "envelope")
    return kinds, flat, reader.fault


def _doubles(data: np.ndarray, at: np.ndarray, big: np.ndarray) -> np.ndarray:
    """Doubles at byte positions of any alignment."""
    out = np.empty(len(at))
    for shift in range(8):
        own = at % 8 == shift
        if own.any():
            usable = (len(data) - shift) // 8 * 8
            out[own] = data[shift : shift + usable].view("<f8")[(at[own] - shift) // 8]
    if big.any():
        out[big] = out[big].byteswap()
    return out


# Simplification.


def _kept(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker over many paths at once: which points stay.  starts, ends: first and last point of each path.

    Of the points of a path farther than the tolerance from its chord the first of the farthest splits it; a step takes all paths of one level.
    """
    keep = np.zeros(len(x), bool)
    keep[starts] = keep[ends] = True
    while True:
        inner = ends - starts - 1
        starts, ends = starts[inner > 0], ends[inner > 0]
        if not len(starts):
            return keep
        inner = ends - starts - 1
        at = spans(starts + 1, inner)
        bounds = _bounds(inner)
        chord = np.repeat(np.arange(len(starts)), inner)
        ax, ay = x[starts], y[starts]
        dx, dy = x[ends] - ax, y[ends] - ay
        square = dx * dx + dy * dy
        px, py = x[at] - ax[chord], y[at] - ay[chord]
        with np.errstate(invalid="ignore", divide="ignore"):
            along = np.where(square[chord] == 0, 0.0, np.clip((px * dx[chord] + py * dy[chord]) / square[chord], 0.0, 1.0))
        rx, ry = px - along * dx[chord], py - along * dy[chord]
        far = rx * rx + ry * ry
        most = np.maximum.reduceat(far, bounds[:-1])
        first = np.minimum.reduceat(np.where(far == most[chord], at, len(x)), bounds[:-1])
        split = most > tolerance * tolerance
        middle = first[split]
        keep[middle] = True
        starts, ends = np.concatenate([starts[split], middle]), np.concatenate([middle, ends[split]])


def _turned(flat: Flat, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the points of closed rings from their smallest vertex on and back to it, bounds, and the place of the vertex farthest from it."""
    begin, size = flat.rings[rings], flat.rings[rings + 1] - flat.rings[rings] - 1
    bounds = _bounds(size)
    at, ring = spans(begin, size), np.repeat(np.arange(len(rings)), size)
    x, y = flat.x[at], flat.y[at]
    low = x == np.minimum.reduceat(x, bounds[:-1])[ring]
    high = np.where(low, y, np.inf)
    low &= high == np.minimum.reduceat(high, bounds[:-1])[ring]
    first = np.minimum.reduceat(np.where(low, at, len(flat.x)), bounds[:-1]) - begin
    place = np.arange(len(at)) - bounds[ring]
    turned = begin[ring] + (first[ring] + place) % size[ring]
    sx, sy = flat.x[begin + first][ring], flat.y[begin + first][ring]
    away = (flat.x[turned] - sx) ** 2 + (flat.y[turned] - sy) ** 2
    most = np.maximum.reduceat(away, bounds[:-1])
    far = np.minimum.reduceat(np.where(away == most[ring], place, len(flat.x)), bounds[:-1])
    closed = _bounds(size + 1)
    out = np.empty(int(closed[-1]), np.int64)
    out[closed[ring] + place] = turned
    out[closed[1:] - 1] = begin + first
    return out, closed, far


def simplified(flat: Flat, kinds: np.ndarray, tolerance: float, untouched: int = 3) -> Flat:
    """Every ring and line within the tolerance.  Lines keep two distinct points, or become their ends; a ring is cut at its smallest
    vertex and at the one farthest from it, and stays as it was if it would have fewer than 3 distinct points, or has ``untouched`` points or fewer."""
    n = len(flat.rings) - 1
    size = np.diff(flat.rings)
    of_row = np.repeat(np.arange(len(flat.rows) - 1), np.diff(flat.rows))
    line = np.repeat((kinds % MULTI == LINE)[of_row], np.diff(flat.parts))
    lines = np.flatnonzero(line & (size > 0))
    rings = np.flatnonzero(~line & (size > max(untouched, 1)))
    index, bounds, far = _turned(flat, rings) if len(rings) else (np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    cut = far > 0  # rings of one point stay
    rings, far = rings[cut], far[cut]
    size_turned = np.diff(bounds)[cut]
    index = index[spans(bounds[:-1][cut], size_turned)]
    # One path for a line, two for a ring, over the concatenated points of both.
    order = np.concatenate([spans(flat.rings[lines], size[lines]), index]).astype(np.int64)
    own = np.concatenate([lines, rings])
    begin = _bounds(np.concatenate([size[lines], size_turned]))
    x, y, is_line = flat.x[order], flat.y[order], line[own]
    first, last = begin[:-1], begin[1:] - 1
    middle = first[len(lines) :] + far
    starts = np.concatenate([first[: len(lines)], first[len(lines) :], middle])
    ends = np.concatenate([last[: len(lines)], middle, last[len(lines) :]])
    keep = np.ones(len(order), bool) if tolerance <= 0 else _kept(x, y, starts, ends, tolerance)
    kept = np.flatnonzero(keep)
    counts = np.add.reduceat(keep, first) if len(first) else np.zeros(0, np.int64)
    found = distinct_points(Flat(x[kept], y[kept], _bounds(counts), None, None))
    ends_only = is_line & (found < 2)
    whole = ~is_line & (found < 3)
    if ends_only.any():
        keep[spans(first[ends_only], (last - first + 1)[ends_only])] = False
        keep[first[ends_only]] = keep[last[ends_only]] = True
    done = np.zeros(n, bool)
    done[own[~whole]] = True
    # Rings that were not simplified keep their points; all are put together in their old order.
    stay = np.flatnonzero(~done)
    ring_of = np.repeat(own, np.diff(begin))
    use = keep & done[ring_of]
    points = np.concatenate([order[use], spans(flat.rings[stay], size[stay])]).astype(np.int64)
    ring = np.concatenate([ring_of[use], np.repeat(stay, size[stay])]).astype(np.int64)
    sorted_ = np.argsort(ring, kind="stable")
    points = points[sorted_]
    return Flat(flat.x[points], flat.y[points], _bounds(np.bincount(ring, minlength=n)), flat.parts, flat.rows)
