"""Column expressions over bounds: Morton keys, grid cells, overlap predicates, levels of detail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantize(value: str | Column, low: str | Column, high: str | Column) -> Column:
    """Place of value between low and high as 0 to 65535, truncated; 0 where high is not above low."""
    value, low, high = col(value), col(low), col(high)
    share = F.least(F.greatest((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(high <= low, F.lit(0).cast("long")).otherwise((share * F.lit(65535.0)).cast("long"))


def quantize_strict(value: str | Column, low: str | Column, high: str | Column) -> Column:
    """The same, truncated before it is clamped; degenerate bounds are an error."""
    value, low, high = col(value), col(low), col(high)
    place = ((value - low) / (high - low) * F.lit(65535.0)).cast("long")
    checked = F.when(high > low, place).otherwise(F.raise_error(F.lit("bounds are degenerate")).cast("long"))
    return F.least(F.greatest(checked, F.lit(0).cast("long")), F.lit(65535).cast("long"))


def spread(x: str | Column) -> Column:
    """The 16 low bits of x, each followed by a 0 bit."""
    x = col(x).cast("long").bitwiseAND(F.lit(0xFFFF))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: str | Column, y: str | Column) -> Column:
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def centre(low: str | Column, high: str | Column) -> Column:
    return (col(low) + col(high)) / F.lit(2.0)


def bounds_of(side: str) -> tuple[Column, Column, Column, Column]:
    """min_x, min_y, max_x, max_y of the aliased side."""
    return tuple(F.col(f"{side}.{c}") for c in ("min_x", "min_y", "max_x", "max_y"))


def intersects(a: tuple, b: tuple) -> Column:
    """Closed: boxes that touch count."""
    return ~((col(a[2]) < col(b[0])) | (col(b[2]) < col(a[0])) | (col(a[3]) < col(b[1])) | (col(b[3]) < col(a[1])))


def overlaps(a: tuple, b: tuple) -> Column:
    """Open: boxes that only touch don't count."""
    return (F.least(col(a[2]), col(b[2])) > F.greatest(col(a[0]), col(b[0]))) & (F.least(col(a[3]), col(b[3])) > F.greatest(col(a[1]), col(b[1])))


def gross_bounds_ok(a: tuple, b: tuple) -> Column:
    """b is like a: sizes within a factor of 0.5 to 1.5, edges within 0.02 degrees or a quarter of a side, and overlapping.

    b must lie in valid degrees and not be degenerate.
    """
    a, b = tuple(map(col, a)), tuple(map(col, b))
    out = overlaps(a, b) & (b[0] < b[2]) & (b[1] < b[3]) & b[0].between(-180.0, 180.0) & b[2].between(-180.0, 180.0) & b[1].between(-90.0, 90.0) & b[3].between(-90.0, 90.0)
    for low, high in ((0, 2), (1, 3)):
        width = a[high] - a[low]
        ratio = (b[high] - b[low]) / F.nullif(width, F.lit(0.0))
        most = F.greatest(F.lit(0.02), width * F.lit(0.25))
        out = out & ratio.between(0.5, 1.5) & (F.abs(b[low] - a[low]) <= most) & (F.abs(b[high] - a[high]) <= most)
    return F.coalesce(out, F.lit(False))


def level(zoom: str | Column, middle: float, fine: float) -> Column:
    """0 (overview), 1 or 2 (exact) by zoom; fine and middle are the zooms at which levels begin."""
    zoom = col(zoom)
    return F.when(zoom >= fine, 2).when(zoom >= middle, 1).otherwise(0)


def wheel_scale(delta: str | Column) -> Column:
    """Zoom factor of a wheel event, its delta clamped to 240 either way."""
    return F.exp(F.least(F.greatest(col(delta), F.lit(-240.0)), F.lit(240.0)) * F.lit(0.0015))


def clamp_zoom(zoom: str | Column) -> Column:
    return F.least(F.greatest(col(zoom), F.lit(0.25)), F.lit(4096.0))


def overview(min_x: str | Column, min_y: str | Column, max_x: str | Column, max_y: str | Column, width: float, height: float, margin: float = 0.05) -> Column:
    """centre, extent and the scale at which a box with a margin fits into a picture: a struct of doubles."""
    min_x, min_y, max_x, max_y = map(col, (min_x, min_y, max_x, max_y))
    wide, high = (max_x - min_x) * F.lit(1 + 2 * margin), (max_y - min_y) * F.lit(1 + 2 * margin)
    fit = F.least(F.lit(width) / F.nullif(wide, F.lit(0.0)), F.lit(height) / F.nullif(high, F.lit(0.0)))
    return F.struct(centre(min_x, max_x).alias("x"), centre(min_y, max_y).alias("y"), (max_x - min_x).alias("width"), (max_y - min_y).alias("height"), fit.alias("scale"))


def home_box(min_x: str | Column, min_y: str | Column, max_x: str | Column, max_y: str | Column, margin: float = 0.05) -> Column:
    """The view of a box with a margin; y points down, as on a screen: x, y, width, height."""
    min_x, min_y, max_x, max_y = map(col, (min_x, min_y, max_x, max_y))
    pad_x, pad_y = (max_x - min_x) * F.lit(margin), (max_y - min_y) * F.lit(margin)
    return F.struct((min_x - pad_x).alias("x"), (-max_y - pad_y).alias("y"), (max_x - min_x + 2 * pad_x).alias("width"), (max_y - min_y + 2 * pad_y).alias("height"))


def to_world(view: Column, px: str | Column, py: str | Column, width: float, height: float) -> Column:
    """The point of a view under a pixel of a picture of width by height: x and y (up)."""
    return F.struct((view["x"] + col(px) / F.lit(width) * view["width"]).alias("x"), (-(view["y"] + col(py) / F.lit(height) * view["height"])).alias("y"))


def panned(view: Column, dx: str | Column, dy: str | Column, width: float, height: float) -> Column:
    """The view after a drag by so many pixels."""
    return F.struct((view["x"] - col(dx) / F.lit(width) * view["width"]).alias("x"), (view["y"] - col(dy) / F.lit(height) * view["height"]).alias("y"), view["width"].alias("width"), view["height"].alias("height"))


def zoomed(view: Column, home: Column, factor: str | Column, ax: str | Column, ay: str | Column) -> Column:
    """The view scaled about the anchor (shares of width and height); its zoom against home stays within 0.25 and 4096."""
    zoom = F.least(F.greatest(home["width"] / view["width"] / col(factor), F.lit(0.25)), F.lit(4096.0))
    width, height = home["width"] / zoom, home["height"] / zoom
    return F.struct((view["x"] + col(ax) * (view["width"] - width)).alias("x"), (view["y"] + col(ay) * (view["height"] - height)).alias("y"), width.alias("width"), height.alias("height"))
