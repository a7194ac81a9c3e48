"""Geometry codecs and simplification, a row after the other: what the vectorised ones are compared with."""

import struct

import numpy as np

WKB_CODES = {"LineString": 2, "Polygon": 3, "MultiLineString": 5, "MultiPolygon": 6}
SINGLE_OF = {"MultiLineString": "LineString", "MultiPolygon": "Polygon"}
GPKG_MAGIC, GPKG_VERSION, GPKG_FLAGS, SRID = b"GP", 0, 0b11, 4326
Ring = list[tuple[float, float]]
Parts = list[list[Ring]]



def to_wkb(geometry_type: str, parts: Parts) -> bytes:
    """Little-endian well-known binary."""

    def ring(points_: Ring) -> bytes:
        return struct.pack("<I", len(points_)) + struct.pack(f"<{2 * len(points_)}d", *[v for p in points_ for v in p])

    def single(kind: str, rings: list[Ring]) -> bytes:
        head = struct.pack("<BI", 1, WKB_CODES[kind])
        if kind == "LineString":
            return head + ring(rings[0])
        return head + struct.pack("<I", len(rings)) + b"".join(map(ring, rings))

    if geometry_type in SINGLE_OF:
        return struct.pack("<BII", 1, WKB_CODES[geometry_type], len(parts)) + b"".join(single(SINGLE_OF[geometry_type], p) for p in parts)
    if len(parts) != 1:
        raise ValueError("a single geometry has one part")
    return single(geometry_type, parts[0])


def from_wkb(data: bytes) -> tuple[str, Parts]:
    """Either byte order; ValueError for other types and for bytes that are missing or left over."""
    kinds = {code: kind for kind, code in WKB_CODES.items()}
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("geometry ends early")
        out = struct.unpack_from(form, data, at)
        at += size
        return out

    def ring(order: str) -> Ring:
        (n,) = take(order + "I")
        if 16 * n > len(data) - at:
            raise ValueError("geometry ends early")
        flat = take(f"{order}{2 * n}d")
        return list(zip(flat[::2], flat[1::2], strict=True))

    def head() -> tuple[str, str]:
        (first,) = take("<B")
        if first > 1:
            raise ValueError("unknown byte order")
        order = "<" if first else ">"
        (code,) = take(order + "I")
        if code not in kinds:
            raise ValueError(f"unknown geometry type {code}")
        return order, kinds[code]

    def single(order: str, kind: str) -> list[Ring]:
        if kind == "LineString":
            return [ring(order)]
        (n,) = take(order + "I")
        return [ring(order) for _ in range(n)]

    order, kind = head()
    if kind in SINGLE_OF:
        (n,) = take(order + "I")
        parts = []
        for _ in range(n):
            inner_order, inner = head()
            if inner != SINGLE_OF[kind]:
                raise ValueError("a part is of another type")
            parts.append(single(inner_order, inner))
    else:
        parts = [single(order, kind)]
    if at != len(data):
        raise ValueError("bytes are left over")
    return kind, parts


def _box(parts: Parts) -> tuple[float, float, float, float]:
    flat = np.array([p for rings in parts for r in rings for p in r], float)
    return flat[:, 0].min(), flat[:, 0].max(), flat[:, 1].min(), flat[:, 1].max()


def to_gpkg(geometry_type: str, parts: Parts, srid: int = SRID) -> bytes:
    """A GeoPackage blob: header, envelope (min x, max x, min y, max y), well-known binary."""
    return struct.pack("<2sBBi4d", GPKG_MAGIC, GPKG_VERSION, GPKG_FLAGS, srid, *_box(parts)) + to_wkb(geometry_type, parts)


def from_gpkg(blob: bytes, srid: int = SRID) -> tuple[str, Parts]:
    """ValueError unless the header is the one that to_gpkg writes and the envelope equals the bounds."""
    if len(blob) < 40:
        raise ValueError("blob ends early")
    magic, version, flags, own, *box = struct.unpack_from("<2sBBi4d", blob)
    if (magic, version, flags, own) != (GPKG_MAGIC, GPKG_VERSION, GPKG_FLAGS, srid):
        raise ValueError("not such a blob")
    kind, parts = from_wkb(blob[40:])
    if tuple(box) != tuple(_box(parts)):
        raise ValueError("the envelope is not the bounds")
    return kind, parts



def _distances(points_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances to the segment from a to b."""
    d = b - a
    square = float(d @ d)
    along = np.zeros(len(points_)) if square == 0 else np.clip((points_ - a) @ d / square, 0.0, 1.0)
    rest = points_ - (a + along[:, None] * d)
    return (rest * rest).sum(1)


def simplified_path(path: Ring, tolerance: float) -> Ring:
    """Douglas and Peucker: points farther than the tolerance stay, the first of those as far as the farthest.

    With a tolerance of 0 or less all points stay.
    """
    if tolerance <= 0:
        return list(path)
    at = np.array(path, float).reshape(-1, 2)
    keep = np.zeros(len(at), bool)
    keep[[0, -1]] = True
    todo = [(0, len(at) - 1)]
    while todo:
        start, end = todo.pop()
        if end - start < 2:
            continue
        far = _distances(at[start + 1 : end], at[start], at[end])
        if far[k := int(far.argmax())] > tolerance * tolerance:
            middle = start + 1 + k
            keep[middle] = True
            todo += [(start, middle), (middle, end)]
    return [path[i] for i in np.flatnonzero(keep)]


def simplified_line(path: Ring, tolerance: float) -> Ring:
    out = simplified_path(path, tolerance)
    return out if len(set(out)) >= 2 else [path[0], path[-1]]


def simplified_ring(ring: Ring, tolerance: float, untouched: int = 3) -> Ring:
    """A closed ring, cut at its smallest vertex and the one farthest from it; the original if it collapses.

    untouched: rings of at most so many points stay as they are.
    """
    if len(ring) <= untouched:
        return ring
    open_ = ring[:-1]
    first = min(range(len(open_)), key=lambda i: (open_[i], i))
    turned = open_[first:] + open_[:first]
    at = np.array(turned, float)
    far = int(((at - at[0]) ** 2).sum(1).argmax())
    if far == 0:
        return ring
    out = simplified_path(turned[: far + 1], tolerance)[:-1] + simplified_path([*turned[far:], turned[0]], tolerance)
    return out if len(set(out)) >= 3 else ring
