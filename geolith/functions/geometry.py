"""Geometries as arrays of parts of rings of points: codecs, validity, bounds, scores, simplification, containment.

A geometry is (geometry_type, parts): parts > rings > points {x, y}; a line is a part with one ring.
What Spark's array functions express is a column expression; codecs, inspection and simplification are Arrow UDFs
over the flat buffers of a batch (flat.py).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.functions import flat
from geolith.functions.spatial import col

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))
GEOMETRY = T.StructType([T.StructField("geometry_type", T.StringType()), T.StructField("parts", PARTS)])

#: Coordinates are scored as whole numbers of this fraction of a degree.
SCALE = 1e7


def points(parts: str | Column) -> Column:
    """All points of a geometry."""
    return F.flatten(F.flatten(col(parts)))


def bounds(parts: str | Column) -> Column:
    """Struct of min_x, min_y, max_x, max_y."""
    at = points(parts)
    xs, ys = F.transform(at, lambda p: p["x"]), F.transform(at, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def n_vertices(parts: str | Column) -> Column:
    return F.size(points(parts)).cast("long")


def exteriors(parts: str | Column) -> Column:
    """The geometry without its holes."""
    return F.transform(col(parts), lambda rings: F.slice(rings, 1, 1))


def n_holes(parts: str | Column) -> Column:
    return F.aggregate(col(parts), F.lit(0).cast("long"), lambda n, rings: n + F.size(rings) - 1)


def is_valid(geometry_type: str | Column, parts: str | Column) -> Column:
    """Positions in range; lines of 2 distinct points at least; rings of 4 points, closed, 3 of them distinct."""
    kind = col(geometry_type)

    def line(ring: Column) -> Column:
        return (F.size(ring) >= 2) & (F.size(F.array_distinct(ring)) >= 2)

    def closed(ring: Column) -> Column:
        return (F.size(ring) >= 4) & (F.size(F.array_distinct(ring)) >= 3) & (F.element_at(ring, 1) == F.element_at(ring, -1))

    placed = F.forall(points(parts), lambda p: p["x"].between(-180.0, 180.0) & p["y"].between(-90.0, 90.0))
    full = F.size(col(parts)) > 0
    lines = F.forall(col(parts), lambda rings: (F.size(rings) == 1) & F.forall(rings, line))
    areas = F.forall(col(parts), lambda rings: (F.size(rings) > 0) & F.forall(rings, closed))
    single = ~kind.startswith("Multi") & (F.size(col(parts)) > 1)
    shape = F.when(kind.endswith("LineString"), lines).when(kind.endswith("Polygon"), areas).otherwise(F.lit(False))
    return F.coalesce(full & placed & shape & ~single, F.lit(False))


def _scaled(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.rint(p["x"] * SCALE).cast("long").alias("x"), F.rint(p["y"] * SCALE).cast("long").alias("y")))


def _segments(ring: Column) -> Column:
    return F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))


def ring_area(ring: Column) -> Column:
    """Twice the area in whole units: |sum of x1 y2 - x2 y1|."""
    cross = F.aggregate(_segments(_scaled(ring)), F.lit(0).cast("decimal(38,0)"), lambda s, e: (s + e["a"]["x"].cast("decimal(19,0)") * e["b"]["y"] - e["b"]["x"].cast("decimal(19,0)") * e["a"]["y"]).cast("decimal(38,0)"))
    return F.abs(cross)


def area_score(parts: str | Column) -> Column:
    """Per polygon the outer ring's score less its holes', at least 0; at least 1 in all."""
    one = F.transform(col(parts), lambda rings: F.aggregate(F.transform(F.slice(rings, 2, 1 << 30), ring_area), ring_area(F.element_at(rings, 1)), lambda s, hole: (s - hole).cast("decimal(38,0)")))
    total = F.aggregate(one, F.lit(0).cast("decimal(38,0)"), lambda s, area: (s + F.greatest(area, F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)"))
    return F.greatest(total, F.lit(1).cast("decimal(38,0)"))


def _isqrt(n: Column) -> Column:
    """Whole square root of a whole number below 2^62; the double's root is at most one off."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.when(root * root > n, root - 1).when((root + 1) * (root + 1) <= n, root + 1).otherwise(root)


def length_score(parts: str | Column) -> Column:
    """Sum of the whole lengths of all segments; at least 1."""
    rings = F.flatten(col(parts))

    def length(ring: Column) -> Column:
        squares = F.transform(_segments(_scaled(ring)), lambda e: (e["b"]["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"]))
        return F.aggregate(F.transform(squares, _isqrt), F.lit(0).cast("long"), lambda s, x: s + x)

    return F.greatest(F.aggregate(F.transform(rings, length), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1).cast("long"))


def svg_path(parts: str | Column, closed: bool) -> Column:
    """M x -y L x -y ... for each ring, Z at the end of closed ones."""
    def ring(r: Column) -> Column:
        at = F.transform(r, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), (-p["y"]).cast("string")))
        return F.concat(F.lit("M "), F.array_join(at, " L "), F.lit(" Z" if closed else ""))

    return F.array_join(F.transform(F.flatten(col(parts)), ring), " ")


# Codecs, checks and simplification of whole Arrow batches.


@F.arrow_udf(T.BinaryType())
def wkb(geometry_type: pa.Array, parts: pa.Array) -> pa.Array:
    """Little-endian well-known binary; null where there are no parts, or parts that the type doesn't have."""
    return flat.to_blobs(flat.from_arrow(parts), flat.codes(geometry_type))


@F.arrow_udf(T.BinaryType())
def gpkg(geometry_type: pa.Array, parts: pa.Array) -> pa.Array:
    """A GeoPackage blob: header, envelope (min x, max x, min y, max y), well-known binary."""
    return flat.to_blobs(flat.from_arrow(parts), flat.codes(geometry_type), header=True)


@F.arrow_udf(GEOMETRY)
def decoded(blob: pa.Array) -> pa.Array:
    """The geometry of a GeoPackage blob, or null where it is none."""
    kinds, found, fault = flat.from_blobs(blob, header=True)
    return pa.StructArray.from_arrays([flat.names(kinds), flat.to_arrow(found)], ["geometry_type", "parts"], mask=pa.array(fault > 0))


INSPECTED = T.StructType([T.StructField("fault", T.StringType()), T.StructField("geometry_type", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("min_x", "min_y", "max_x", "max_y")]])


@F.arrow_udf(INSPECTED)
def inspected(blob: pa.Array) -> pa.Array:
    """What a GeoPackage blob holds: the fault that ends its reading or 'invalid' (see is_valid), its type and the bounds of its points."""
    kinds, found, fault = flat.from_blobs(blob, header=True)
    names = pa.array(flat.FAULTS).take(pa.array(fault))
    valid = pa.array(flat.sound(found, kinds) | (fault > 0))
    names = pc.if_else(valid, names, "invalid")
    box = flat.envelopes(found)
    columns = [pa.array(box[:, i], mask=np.isnan(box[:, i])) for i in (0, 2, 1, 3)]
    return pa.StructArray.from_arrays([names, flat.names(kinds), *columns], INSPECTED.names)


def simplify(tolerance: float, untouched: int = 3) -> Callable[[str | Column, str | Column], Column]:
    """A function of geometry type and parts: the simplified parts (see flat.simplified)."""

    @F.arrow_udf(PARTS)
    def run(kind: pa.Array, parts: pa.Array) -> pa.Array:
        found = flat.simplified(flat.from_arrow(parts), flat.codes(kind), tolerance, untouched)
        return flat.to_arrow(found, parts.is_null().to_numpy(zero_copy_only=False))

    return run


# Containment.


def _in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd; the boundary is inside, within 1e-12 of the size of each segment's coordinates."""
    n = F.size(ring)
    segments = F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        size = F.lit(1e-12) * F.greatest(F.lit(1.0), *map(F.abs, (x, y, ax, ay, bx, by)))
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        return (F.abs(cross) <= size) & x.between(F.least(ax, bx) - size, F.greatest(ax, bx) + size) & y.between(F.least(ay, by) - size, F.greatest(ay, by) + size)

    def crosses(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        return F.coalesce(((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax), F.lit(False))

    return F.exists(segments, on) | F.aggregate(segments, F.lit(False), lambda inside, s: inside != crosses(s))


def contains(x: str | Column, y: str | Column, parts: str | Column) -> Column:
    """In the outer ring of a part and in none of its holes; a hole's boundary is in the hole.  Of columns: no Python."""
    x, y = col(x), col(y)

    def in_part(rings: Column) -> Column:
        holes = F.slice(rings, F.lit(2), F.size(rings))
        return (F.size(rings) > 0) & _in_ring(x, y, F.get(rings, 0)) & ~F.exists(holes, lambda hole: _in_ring(x, y, hole))

    return F.coalesce(F.exists(col(parts), in_part), F.lit(False))


# Documents.


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no escapes beyond JSON's own; numbers that are not finite are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical(document: pd.Series, name: pd.Series, value: pd.Series) -> pd.Series:
    """The canonical form of JSON objects, with the value (if not null) in place of what they have under the name; null for what is no object."""

    def one(text: str | None, key: str, own: str | None) -> str | None:
        try:
            found = None if text is None else json.loads(text)
        except ValueError:
            return None
        if not isinstance(found, dict):
            return None
        return canonical_json(found if own is None else found | {key: own})

    return pd.Series([one(*row) for row in zip(document, name, value, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else zlib.compress(bytes(d), 9))


@F.pandas_udf(T.BinaryType())
def inflated(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else zlib.decompress(bytes(d)))
