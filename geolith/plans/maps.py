"""Queries on boxes and geometries: viewports, joins, levels of detail, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geometry, spatial
from geolith.operators import levels, reconcile, spatial_join
from geolith.plans.frames import accepted, candidate, duck, features, table
from geolith.plans.registry import query
from geolith.sources import container

BOX = ("min_x", "min_y", "max_x", "max_y")


def _spread(x: str) -> str:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = f"(({x} | ({x} << {shift})) & {mask})"
    return x


def _place(low: str, high: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} <= {lo} THEN 0 ELSE CAST(trunc(least(greatest((({low} + {high}) / 2e0 - {lo}) / ({hi} - {lo}), 0e0), 1e0) * 65535e0) AS BIGINT) END"


EXTENT = "SELECT min(min_x) AS lo_x, min(min_y) AS lo_y, max(max_x) AS hi_x, max(max_y) AS hi_y FROM features"
MORTON = f"""SELECT f.*, {_spread("qx")} | ({_spread("qy")} << 1) AS morton FROM (SELECT f.*, {_place("min_x", "max_x", "lo_x", "hi_x")} AS qx, {_place("min_y", "max_y", "lo_y", "hi_y")} AS qy
  FROM features f, ({EXTENT}) e) f"""


def _morton(spark: SparkSession, d: str) -> DataFrame:
    rows = spatial_join.with_extent(features(spark, d), spatial_join.extent(features(spark, d)))
    at = spatial.morton(spatial.quantize(spatial.centre("min_x", "max_x"), "lo_x", "hi_x"), spatial.quantize(spatial.centre("min_y", "max_y"), "lo_y", "hi_y"))
    return rows.withColumn("morton", at).drop("lo_x", "lo_y", "hi_x", "hi_y")


# Predicates.


@query("extent", duck("features", EXTENT))
def extent(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.extent(features(spark, d))


@query("layer_summary", duck("features", "SELECT brand, count(*) AS n, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(DISTINCT kind) AS n_kinds FROM features GROUP BY brand"))
def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    aggs = [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]
    return features(spark, d).groupBy("brand").agg(F.count("*").alias("n"), *aggs, F.count_distinct("kind").alias("n_kinds"))


@query("morton_order", duck("features", f"SELECT id, morton FROM ({MORTON})"))
def morton_order(spark: SparkSession, d: str) -> DataFrame:
    return _morton(spark, d).select("id", "morton").orderBy("morton", "id")


@query("bbox_overlap", duck("features", """SELECT id, size % 2 = 1 AS open, true AS closed FROM features"""))
def bbox_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A box and its neighbour, which touches it or (odd sizes) overlaps it."""
    rows = features(spark, d).withColumn("x0", F.when(F.expr("size % 2 = 1"), spatial.centre("min_x", "max_x")).otherwise(F.col("max_x")))
    other = ("x0", "min_y", F.col("x0") + 1.0, "max_y")
    return rows.select("id", spatial.overlaps(BOX, other).alias("open"), spatial.intersects(BOX, other).alias("closed"))


GROSS = """WITH a AS (SELECT brand, min(min_x) AS ax, min(min_y) AS ay, max(max_x) AS bx, max(max_y) AS by_ FROM features WHERE size < 25 GROUP BY 1),
b AS (SELECT brand, min(min_x) AS cx, min(min_y) AS cy, max(max_x) AS dx, max(max_y) AS dy FROM features WHERE size > 30 GROUP BY 1)
SELECT brand, coalesce(least(bx, dx) > greatest(ax, cx) AND least(by_, dy) > greatest(ay, cy) AND (dx - cx) / nullif(bx - ax, 0) BETWEEN 5e-1 AND 15e-1 AND (dy - cy) / nullif(by_ - ay, 0) BETWEEN 5e-1 AND 15e-1
  AND abs(cx - ax) <= greatest(2e-2, (bx - ax) * 25e-2) AND abs(dx - bx) <= greatest(2e-2, (bx - ax) * 25e-2)
  AND abs(cy - ay) <= greatest(2e-2, (by_ - ay) * 25e-2) AND abs(dy - by_) <= greatest(2e-2, (by_ - ay) * 25e-2), false) AS ok FROM a JOIN b USING (brand)"""


@query("gross_bounds", duck("features", GROSS))
def gross_bounds(spark: SparkSession, d: str) -> DataFrame:
    def box(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
        return rows.groupBy("brand").agg(F.min("min_x").alias(names[0]), F.min("min_y").alias(names[1]), F.max("max_x").alias(names[2]), F.max("max_y").alias(names[3]))

    a, b = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")
    rows = features(spark, d)
    return box(rows.where("size < 25"), a).join(box(rows.where("size > 30"), b), "brand").select("brand", spatial.gross_bounds_ok(a, b).alias("ok"))


@query("zoom_level", duck("features", "SELECT id, CASE WHEN size >= 16 THEN 2 WHEN size >= 4 THEN 1 ELSE 0 END AS level, round(exp(least(greatest(size * 10 - 250, -240), 240) * 15e-4), 6) AS scale FROM features"))
def zoom_level(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("id", spatial.level("size", 4, 16).alias("level"), F.round(spatial.wheel_scale(F.col("size") * 10 - 250), 6).alias("scale"))


# Joins.

VIEWS = "SELECT n_nationkey AS view, -886e-1 + n_nationkey * 1e-2 AS min_x, 4172e-2 + n_nationkey * 15e-3 AS min_y, -886e-1 + n_nationkey * 1e-2 + 6e-2 AS max_x, 4172e-2 + n_nationkey * 15e-3 + 5e-2 AS max_y FROM nation"
POINTS = "SELECT c_custkey AS point, -886e-1 + (c_custkey % 300) * 1e-3 AS x, 4172e-2 + (c_custkey % 433) * 1e-3 AS y FROM customer"


@query("viewport", duck("features", f"SELECT view, id FROM ({VIEWS}) v JOIN features f ON NOT (f.max_x < v.min_x OR v.max_x < f.min_x OR f.max_y < v.min_y OR v.max_y < f.min_y)"))
def viewport(spark: SparkSession, d: str) -> DataFrame:
    views = table(spark, d, "nation").selectExpr(*VIEWS.removeprefix("SELECT ").removesuffix(" FROM nation").split(", "))
    return spatial_join.viewport(features(spark, d), views, "id", "view")


REGIMES = """SELECT 'county' AS regime, lo_x AS min_x, lo_y AS min_y, hi_x AS max_x, hi_y AS max_y FROM e UNION ALL SELECT 'west', lo_x, lo_y, (lo_x + hi_x) / 2, hi_y FROM e UNION ALL SELECT 'quarter', lo_x, lo_y, (lo_x + hi_x) / 2, (lo_y + hi_y) / 2 FROM e
UNION ALL SELECT 'town', lo_x + (hi_x - lo_x) / 4, lo_y + (hi_y - lo_y) / 4, lo_x + (hi_x - lo_x) / 2, lo_y + (hi_y - lo_y) / 2 FROM e UNION ALL SELECT 'street', (lo_x + hi_x) / 2, (lo_y + hi_y) / 2, (lo_x + hi_x) / 2 + (hi_x - lo_x) / 32, (lo_y + hi_y) / 2 + (hi_y - lo_y) / 32 FROM e
UNION ALL SELECT 'edge', hi_x, lo_y, hi_x + 1, hi_y FROM e UNION ALL SELECT 'sparse', hi_x - (hi_x - lo_x) / 256, hi_y - (hi_y - lo_y) / 256, hi_x, hi_y FROM e"""


@query("viewport_regimes", duck("features", f"WITH e AS (SELECT min(min_x) AS lo_x, min(min_y) AS lo_y, max(max_x) AS hi_x, max(max_y) AS hi_y FROM features), v AS ({REGIMES}) SELECT regime, id FROM v JOIN features f ON NOT (f.max_x < v.min_x OR v.max_x < f.min_x OR f.max_y < v.min_y OR v.max_y < f.min_y)"))
def viewport_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Seven views, from the whole extent to a corner without much in it, in one join."""
    e, corner = F.col, "lo_x lo_y hi_x hi_y".split()
    box = {c: e(c) for c in corner}
    lx, ly, hx, hy = (box[c] for c in corner)
    mx, my, w, h = (lx + hx) / 2, (ly + hy) / 2, hx - lx, hy - ly
    views = {"county": (lx, ly, hx, hy), "west": (lx, ly, mx, hy), "quarter": (lx, ly, mx, my), "town": (lx + w / 4, ly + h / 4, lx + w / 2, ly + h / 2), "street": (mx, my, mx + w / 32, my + h / 32), "edge": (hx, ly, hx + 1, hy), "sparse": (hx - w / 256, hy - h / 256, hx, hy)}
    rows = features(spark, d)
    each = F.array(*[F.struct(F.lit(name).alias("regime"), *[v.alias(c) for v, c in zip(view, BOX, strict=True)]) for name, view in views.items()])
    return spatial_join.viewport(rows, spatial_join.extent(rows).select(F.explode(each).alias("v")).select("v.*"), "id", "regime")


@query("hit_test", duck("features", f"SELECT point, id FROM ({POINTS}) p JOIN features f ON x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y"))
def hit_test(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "customer").selectExpr(*POINTS.removeprefix("SELECT ").removesuffix(" FROM customer").split(", "))
    return spatial_join.hit_test(points, features(spark, d), "point", "id")


OPEN = "least(a.max_x, b.max_x) > greatest(a.min_x, b.min_x) AND least(a.max_y, b.max_y) > greatest(a.min_y, b.min_y)"


@query("overlap_pairs", duck("accepted candidate", f"SELECT a.id AS a_key, b.id AS b_key FROM accepted a JOIN candidate b ON {OPEN}"))
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.overlap_pairs(accepted(spark, d), candidate(spark, d), "id", "id")


#: Labels of the nodes of pairs(u, v): each round a node takes the smallest label next to it.
MEMBERS = """edges AS MATERIALIZED (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
members(node, component) USING KEY (node) AS (SELECT u, least(u, min(v)) FROM edges GROUP BY u UNION
  SELECT e.v, min(m.component) FROM members m JOIN edges e ON e.u = m.node JOIN recurring.members o ON o.node = e.v WHERE m.component < o.component GROUP BY e.v)"""
COMPONENTS = f"WITH RECURSIVE pairs AS MATERIALIZED (SELECT 'a:' || a.id AS u, 'b:' || b.id AS v FROM accepted a JOIN candidate b ON {OPEN}), {MEMBERS}\n"


@query("overlap_components", duck("accepted candidate", COMPONENTS + "SELECT node, component FROM members"))
def overlap_components(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.overlap_components(accepted(spark, d), candidate(spark, d), "id", "id")


@query("component_kinds", duck("accepted candidate", COMPONENTS + """SELECT component, n_old, n_new, CASE WHEN n_old = 1 AND n_new = 1 THEN 'uncertain_replacement' WHEN n_old = 1 THEN 'split' WHEN n_new = 1 THEN 'merge' ELSE 'complex' END AS kind
FROM (SELECT component, count(*) FILTER (node LIKE 'a:%') AS n_old, count(*) FILTER (node LIKE 'b:%') AS n_new FROM members GROUP BY 1)"""))  # fmt: skip
def component_kinds(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.component_kinds(overlap_components(spark, d))


RECONCILE = f"""WITH RECURSIVE kept AS (SELECT id FROM accepted JOIN candidate USING (id)),
o AS (SELECT geometry_sha256, count(*) AS n, min(id) AS old_id FROM accepted WHERE id NOT IN (SELECT id FROM kept) GROUP BY 1),
w AS (SELECT geometry_sha256, count(*) AS n, min(id) AS new_id FROM candidate WHERE id NOT IN (SELECT id FROM kept) GROUP BY 1),
moved AS (SELECT old_id, new_id FROM o JOIN w USING (geometry_sha256) WHERE o.n = 1 AND w.n = 1),
ol AS (SELECT * FROM accepted WHERE id NOT IN (SELECT id FROM kept) AND id NOT IN (SELECT old_id FROM moved)),
nl AS (SELECT * FROM candidate WHERE id NOT IN (SELECT id FROM kept) AND id NOT IN (SELECT new_id FROM moved)),
pairs AS MATERIALIZED (SELECT 'a:' || a.id AS u, 'b:' || b.id AS v FROM ol a JOIN nl b ON {OPEN}),
{MEMBERS},
kinds AS (SELECT CASE WHEN n_old = 1 AND n_new = 1 THEN 'uncertain_replacement' WHEN n_old = 1 THEN 'split' WHEN n_new = 1 THEN 'merge' ELSE 'complex' END AS kind
  FROM (SELECT component, count(*) FILTER (node LIKE 'a:%') AS n_old, count(*) FILTER (node LIKE 'b:%') AS n_new FROM members GROUP BY 1))
SELECT 'continuation' AS kind, count(*) AS n FROM kept UNION ALL SELECT 'exact_geometry_replacement', count(*) FROM moved
UNION ALL SELECT 'addition', count(*) FROM nl WHERE 'b:' || id NOT IN (SELECT node FROM members)
UNION ALL SELECT 'disappearance', count(*) FROM ol WHERE 'a:' || id NOT IN (SELECT node FROM members) UNION ALL SELECT kind, count(*) FROM kinds GROUP BY kind"""


@query("reconcile_summary", duck("accepted candidate", RECONCILE))
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.summary(reconcile.plan(accepted(spark, d), candidate(spark, d), "id"))


# Densities and levels.


def _cell(low: str, high: str, lo: str, hi: str) -> str:
    return f"CAST(least(greatest(trunc(coalesce((({low} + {high}) / 2e0 - {lo}) / nullif({hi} - {lo}, 0), 0) * 8), 0), 7) AS BIGINT)"


DENSITY = f"SELECT {_cell('min_x', 'max_x', 'lo_x', 'hi_x')} AS ix, {_cell('min_y', 'max_y', 'lo_y', 'hi_y')} AS iy, count(*) AS n FROM features, ({EXTENT}) GROUP BY 1, 2"


@query("density_grid", duck("features", DENSITY))
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d)
    return spatial_join.density_grid(rows, spatial_join.extent(rows))


@query("density_cells", duck("features", f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY n, ix, iy) AS r, count(*) OVER () AS m FROM ({DENSITY}))
SELECT CASE r WHEN 1 THEN 'sparsest' WHEN m THEN 'densest' ELSE 'median' END AS cell, ix, iy, n FROM c WHERE r = 1 OR r = m OR r = m // 2 + 1"""))  # fmt: skip
def density_cells(spark: SparkSession, d: str) -> DataFrame:
    """The sparsest, the median and the densest of the cells, 64 at most."""
    cells = density_grid(spark, d).agg(F.sort_array(F.collect_list(F.struct("n", "ix", "iy"))).alias("c"))
    picks = [("sparsest", F.lit(1)), ("median", F.floor(F.size("c") / 2).cast("int") + 1), ("densest", F.size("c"))]
    rows = cells.where(F.size("c") >= 3).select(F.explode(F.array(*[F.struct(F.lit(name).alias("cell"), F.element_at("c", at).alias("v")) for name, at in picks])).alias("p"))
    return rows.select("p.cell", "p.v.ix", "p.v.iy", "p.v.n")


def _top(numerator: int, exact: bool) -> str:
    most = f"CAST(total AS HUGEINT) * {numerator}" if exact else f"CAST(total AS DOUBLE) * ({numerator} / 20e0)"
    scaled = "before * 20" if exact else "CAST(before AS DOUBLE)"
    return f"""SELECT id, size FROM (SELECT id, size, coalesce(sum(CAST(size AS BIGINT)) OVER (ORDER BY size DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(CAST(size AS BIGINT)) OVER () AS total FROM features) WHERE {scaled} < {most}"""


@query("top_fraction_exact", duck("features", _top(7, True)))
def top_fraction_exact(spark: SparkSession, d: str) -> DataFrame:
    return levels.top_fraction(features(spark, d).select("id", "size"), "size", "id", 7, 20)


@query("top_fraction_float", duck("features", _top(7, False)))
def top_fraction_float(spark: SparkSession, d: str) -> DataFrame:
    return levels.top_fraction(features(spark, d).select("id", "size"), "size", "id", 7, 20, exact=False)


@query("lod_monotone", duck("features", f"""WITH coarse AS ({_top(7, True)}), fine AS ({_top(13, True)})
SELECT (SELECT count(*) FROM coarse WHERE id NOT IN (SELECT id FROM fine)) AS missing, (SELECT count(*) FROM fine WHERE id NOT IN (SELECT id FROM coarse)) AS added"""))  # fmt: skip
def lod_monotone(spark: SparkSession, d: str) -> DataFrame:
    """How many features of the coarser level the finer one lacks, and the other way round."""
    rows = features(spark, d).select("id", "size")
    coarse, fine = levels.top_fraction(rows, "size", "id", 7, 20), levels.top_fraction(rows, "size", "id", 13, 20)
    counts = [levels.not_monotone(a, b, "id").agg(F.count("*").alias(name)).withColumn("row", F.lit(1)) for a, b, name in ((coarse, fine, "missing"), (fine, coarse, "added"))]
    return counts[0].join(counts[1], "row").drop("row")


CHUNKS = f"SELECT *, (row_number() OVER (ORDER BY morton, id) - 1) // 256 AS chunk FROM ({MORTON})"


@query("spatial_chunks", duck("features", f"SELECT chunk, count(*) AS n, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM ({CHUNKS}) GROUP BY chunk"))
def spatial_chunks(spark: SparkSession, d: str) -> DataFrame:
    return levels.chunk_index(levels.chunks(_morton(spark, d), ["morton", "id"], 256))


@query("rank_sample", duck("features", f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY morton, id) - 1 AS place, count(*) OVER () AS total FROM ({MORTON}))
SELECT id FROM r WHERE place IN (SELECT CAST(round_even(i * (total - 1) / 36e0, 0) AS BIGINT) FROM range(37) t(i))"""))  # fmt: skip
def rank_sample(spark: SparkSession, d: str) -> DataFrame:
    return levels.rank_sample(_morton(spark, d), ["morton", "id"], 37).select("id")


@query("first_of_densest_cell", duck("features", f"""WITH c AS (SELECT ix, iy FROM ({DENSITY}) ORDER BY n DESC, ix, iy LIMIT 1),
f AS (SELECT id, morton, {_cell('min_x', 'max_x', 'lo_x', 'hi_x')} AS ix, {_cell('min_y', 'max_y', 'lo_y', 'hi_y')} AS iy FROM ({MORTON}), ({EXTENT}))
SELECT id FROM f JOIN c USING (ix, iy) ORDER BY morton, id LIMIT 1"""))  # fmt: skip
def first_of_densest_cell(spark: SparkSession, d: str) -> DataFrame:
    rows = _morton(spark, d)
    bounds = spatial_join.extent(rows)
    placed = spatial_join.with_cells(rows, bounds)
    cell = spatial_join.density_grid(rows, bounds).orderBy(F.desc("n"), "ix", "iy").limit(1)
    return placed.join(F.broadcast(cell.select("ix", "iy")), ["ix", "iy"]).orderBy("morton", "id").select("id").limit(1)


@query("ordinal_gaps", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)")
def ordinal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return levels.ordinal_faults(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


# Geometries.


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """The boxes as polygons: geometry_type and parts."""
    corners = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y")]
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners])
    return features(spark, d).select("id", *BOX, F.lit("Polygon").alias("geometry_type"), F.array(F.array(ring)).alias("parts"))


WHOLE = {c: f"CAST(round_even({c} * 1e7, 0) AS BIGINT)" for c in BOX}


@query("area_score", duck("features", f"SELECT id, 2 * ({WHOLE['max_x']} - {WHOLE['min_x']}) * ({WHOLE['max_y']} - {WHOLE['min_y']}) AS score FROM features"))
def area_score(spark: SparkSession, d: str) -> DataFrame:
    return polygons(spark, d).select("id", geometry.area_score("parts").cast("long").alias("score"))


@query("length_score", duck("features", f"SELECT id, 2 * ({WHOLE['max_x']} - {WHOLE['min_x']} + {WHOLE['max_y']} - {WHOLE['min_y']}) AS score FROM features"))
def length_score(spark: SparkSession, d: str) -> DataFrame:
    return polygons(spark, d).select("id", geometry.length_score("parts").alias("score"))


@query("geometry_checks", duck("features", "SELECT id, id % 5 <> 0 AS valid, CAST(CASE WHEN id % 5 = 0 THEN 3 ELSE 5 END AS BIGINT) AS n_vertices, min_x, max_y FROM features"))
def geometry_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth ring is not closed."""
    cut = F.transform("parts", lambda rings: F.transform(rings, lambda r: F.slice(r, 2, 3)))
    rows = polygons(spark, d).withColumn("p", F.when(F.expr("id % 5 = 0"), cut).otherwise(F.col("parts")))
    return rows.select("id", geometry.is_valid("geometry_type", "p").alias("valid"), geometry.n_vertices("p").alias("n_vertices"), geometry.bounds("parts")["min_x"].alias("min_x"), geometry.bounds("parts")["max_y"].alias("max_y"))


@query("codec_roundtrip", duck("features", """SELECT id, 'Polygon' AS kind, CAST(5 AS BIGINT) AS n_vertices, min_x, min_y, max_x, max_y, CAST(40 + 9 + 4 + 5 * 16 AS BIGINT) AS n_bytes FROM features"""))
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Envelope, one ring of five points: what the blobs decode to, and their lengths."""
    rows = polygons(spark, d).select("id", geometry.gpkg("geometry_type", "parts").alias("blob"))
    rows = rows.select("id", F.octet_length("blob").cast("long").alias("n_bytes"), geometry.decoded("blob").alias("g"))
    box = geometry.bounds("g.parts")
    return rows.select("id", F.col("g.geometry_type").alias("kind"), geometry.n_vertices("g.parts").alias("n_vertices"), *[box[c].alias(c) for c in BOX], "n_bytes")


@query("simplify_boxes", duck("features", "SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 6 ELSE 5 END AS BIGINT) AS n_vertices FROM features"))
def simplify_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Rings with a point in the middle of a side, which goes unless (every third) it lies off the side."""
    middle = F.struct(spatial.centre("min_x", "max_x").alias("x"), F.expr("CASE WHEN id % 3 = 0 THEN min_y - 1e-4 ELSE min_y END").alias("y"))
    rows = polygons(spark, d).withColumn("parts", F.transform("parts", lambda rings: F.transform(rings, lambda r: F.concat(F.slice(r, 1, 1), F.array(middle), F.slice(r, 2, 4)))))
    return rows.select("id", geometry.n_vertices(geometry.simplify(1e-9)("geometry_type", "parts")).alias("n_vertices"))


@query("exact_hit_test", duck("features", f"SELECT point, id FROM ({POINTS}) p JOIN features f ON x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y"))
def exact_hit_test(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "customer").selectExpr(*POINTS.removeprefix("SELECT ").removesuffix(" FROM customer").split(", "))
    return spatial_join.hit_test(points, polygons(spark, d), "point", "id", geometry.contains("x", "y", "parts"))


@query("triangle_hits", duck("features", f"""SELECT point, id FROM ({POINTS}) p JOIN features f ON x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y
WHERE (x - min_x) * (max_y - min_y) + (y - min_y) * (max_x - min_x) <= (max_x - min_x) * (max_y - min_y) * (1 + 1e-9)
  AND NOT (x >= min_x + (max_x - min_x) / 8e0 AND x <= min_x + (max_x - min_x) / 4e0 AND y >= min_y + (max_y - min_y) / 8e0 AND y <= min_y + (max_y - min_y) / 4e0)"""))  # fmt: skip
def triangle_hits(spark: SparkSession, d: str) -> DataFrame:
    """Points in the lower left halves of the boxes, out of a square hole in them."""
    points = table(spark, d, "customer").selectExpr(*POINTS.removeprefix("SELECT ").removesuffix(" FROM customer").split(", "))
    near, far = [(F.expr(f"min_x + (max_x - min_x) / {n}"), F.expr(f"min_y + (max_y - min_y) / {n}")) for n in ("8D", "4D")]

    def ring(corners: list) -> Column:
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])

    outer = [(F.col("min_x"), F.col("min_y")), (F.col("max_x"), F.col("min_y")), (F.col("min_x"), F.col("max_y")), (F.col("min_x"), F.col("min_y"))]
    hole = [near, (far[0], near[1]), far, (near[0], far[1]), near]
    shapes = features(spark, d).select("id", *BOX, F.array(F.array(ring(outer), ring(hole))).alias("parts"))
    return spatial_join.hit_test(points, shapes, "point", "id", geometry.contains("x", "y", "parts"))


@query("container_roundtrip", duck("features", "SELECT id, size, morton FROM (" + MORTON + ")"))
def container_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 256 records in Morton order, encoded, verified and decoded again."""
    rows = levels.chunks(_morton(spark, d), ["morton", "id"], 256).withColumn("level", F.lit(2))
    encoded = container.encode(rows.select("level", "chunk", "id", "size", "morton", *BOX), "id")
    return container.decode(encoded, "id long, size int, morton long").select("id", "size", "morton")
