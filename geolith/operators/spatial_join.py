"""Spatial joins on a hierarchy of grids, components of overlap graphs, viewports, hit tests and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.spatial import intersects, overlaps
from geolith.operators import graph
from geolith.tables import remove, save

BOUNDS = ("min_x", "min_y", "max_x", "max_y")


#: Halvings of the world's extent at the deepest level, and how many halvings lie between two levels.
DEEPEST, STEP = 20, 2
#: Boxes of one cell that meet in one group at most; a cell with more of them has several groups.
BLOCK = 2048
#: Keys of these boxes at most, where a box stands for several: the pairs of a group, and so the time of a task, are bounded by its square.
KEYS = 8192
#: Keys of one box that are tested together at most; a box with more of them comes several times.  The pairs of two bundles are in memory at once.
COPIES = 256


def _placed(df: DataFrame, box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Adds __box, __level and the range of cells that the box covers there, two by two at most: the deepest level whose cells are no smaller than the box.

    Boxes with a null or without extent between their bounds meet nothing.
    """
    rows = df.withColumn("__box", F.struct(*[c.alias(n) for c, n in zip(box, BOUNDS, strict=True)]))
    low_x, low_y, high_x, high_y = (F.col(f"__box.{n}") for n in BOUNDS)
    rows = rows.where((high_x >= low_x) & (high_y >= low_y) & ~F.isnan(low_x + low_y + high_x + high_y))
    share = F.greatest((high_x - low_x) / 360.0, (high_y - low_y) / 360.0)
    level = F.coalesce(F.floor(-F.log2(share)), F.lit(DEEPEST))  # no logarithm of nothing
    rows = rows.withColumn("__level", (F.least(F.greatest(F.floor(level / STEP), F.lit(0)), F.lit(DEEPEST // STEP)) * STEP).cast("int"))
    scale = F.pow(F.lit(2.0), F.col("__level"))
    return rows.withColumns({name: F.floor((value + 180.0) / 360.0 * scale).cast("long") for name, value in (("__x0", low_x), ("__x1", high_x), ("__y0", low_y), ("__y1", high_y))})


def _in_cells(rows: DataFrame, side: str) -> DataFrame:
    """Each row once for every cell of its range; the first cell of the range as __<side>x and __<side>y."""
    rows = rows.withColumns({f"__{side}x": F.col("__x0"), f"__{side}y": F.col("__y0"), f"__{side}box": F.col("__box")})
    rows = rows.withColumn("__gx", F.explode(F.sequence("__x0", "__x1"))).withColumn("__gy", F.explode(F.sequence("__y0", "__y1")))
    return rows.drop("__x0", "__x1", "__y0", "__y1", "__box")


CELL_KEY = ["__level", "__gx", "__gy"]


def _sides(owners: DataFrame, visitors: DataFrame, deeper: bool) -> tuple[DataFrame, DataFrame]:
    """Placed owners and visitors, once for each cell and pair of blocks in which they meet.

    An owner stands in the cells that it covers at its own level, a visitor in those that it covers at every level that owners
    have: an equi-join by cell, in which a pair is found in the first cell that both cover.  A cell of more than
    BLOCK owners or visitors, or of more than KEYS keys of theirs (__weight; 1 without that column), is cut on either side, and each block
    of owners meets each block of visitors in a group of its own.
    """
    own = _in_cells(owners, "o")
    levels = owners.agg(F.coalesce(F.collect_set("__level"), F.array().cast("array<int>"))).scalar()  # DEEPEST / STEP + 1 at most
    near = visitors.withColumn("__levels", levels)
    fits = (lambda at: at < F.col("__level")) if deeper else (lambda at: at <= F.col("__level"))
    near = near.withColumn("__at", F.explode(F.filter("__levels", fits))).drop("__levels")
    up = F.col("__level") - F.col("__at")
    near = near.withColumns({c: F.call_function("shiftright", F.col(c), up) for c in ("__x0", "__x1", "__y0", "__y1")}).withColumn("__level", F.col("__at")).drop("__at")
    near = _in_cells(near, "v")

    def counted(rows: DataFrame, side: int) -> DataFrame:
        keys = F.sum("__weight") if "__weight" in rows.columns else F.count("*")
        return rows.groupBy(*CELL_KEY).agg(F.greatest(F.count("*") / BLOCK, keys / KEYS).alias("__n")).withColumn("__of", F.lit(side))

    counts = counted(own, 0).unionByName(counted(near, 1))
    many = counts.where(F.col("__n") > 1).groupBy(*CELL_KEY).agg(*[F.ceil(F.coalesce(F.max(F.when(F.col("__of") == i, F.col("__n"))), F.lit(1))).cast("int").alias(f"__blocks{i}") for i in (0, 1)])

    def blocked(rows: DataFrame, mine: int) -> DataFrame:
        """__b0 and __b1: a block of its own side, and every block of the other."""
        j = rows.join(many, CELL_KEY, "left")
        n, other = F.coalesce(f"__blocks{mine}", F.lit(1)), F.coalesce(f"__blocks{1 - mine}", F.lit(1))
        side = "o" if mine == 0 else "v"
        j = j.withColumn(f"__b{mine}", F.pmod(F.xxhash64(f"__{side}box", F.monotonically_increasing_id()), n).cast("int"))
        return j.withColumn(f"__b{1 - mine}", F.explode(F.sequence(F.lit(0), other - 1))).drop("__blocks0", "__blocks1", "__weight")

    return blocked(own, 0), blocked(near, 1)


def _meet(owners: DataFrame, visitors: DataFrame, test, deeper: bool = False) -> DataFrame:
    """Pairs of rows whose boxes pass the test, of placed owners and visitors at the owner's level or deeper (with ``deeper`` only deeper)."""
    group = [*CELL_KEY, "__b0", "__b1"]
    n = int(owners.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as partitions that are merged by their bytes differ much in their pairs
    own, near = (side.repartition(n, *group) for side in _sides(owners, visitors, deeper))
    j = own.hint("merge").join(near, group)  # sizes of files say little about rows that are alike or were exploded
    first = (F.col("__gx") == F.greatest("__ox", "__vx")) & (F.col("__gy") == F.greatest("__oy", "__vy"))
    hit = test(tuple(F.col(f"__obox.{c}") for c in BOUNDS), tuple(F.col(f"__vbox.{c}") for c in BOUNDS))
    return j.where(first & hit).drop(*group, "__ox", "__oy", "__vx", "__vy", "__obox", "__vbox")


def _bundled(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows that are alike in ``by`` as one row with their keys in an array and their number as __weight, COPIES of them at most on average where keys differ."""
    rows = rows.withColumn("__h", F.xxhash64(*by))  # rows of one digest that differ are cut more often than they need, no more
    many = rows.groupBy("__h").agg(F.count("*").alias("__n")).where(F.col("__n") > COPIES).select("__h", F.ceil(F.col("__n") / COPIES).alias("__of"))
    cut = rows.join(many, "__h", "left")
    slice_ = F.when(F.col("__of").isNotNull(), F.pmod(F.xxhash64(key), F.col("__of"))).otherwise(F.lit(0))
    return cut.withColumn("__slice", slice_).groupBy(*by, "__slice").agg(F.collect_list(F.struct(F.col(key).alias("k"))).alias("__keys"), F.count("*").alias("__weight")).drop("__slice")


def overlap_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, test=overlaps) -> DataFrame:
    """Pairs of keys (a_key, b_key) whose boxes overlap (open, or closed with test=intersects).

    Boxes of all sizes meet in a hierarchy of grids, the broader of the two in its own cells (see _meet), so that one broad box costs as much as
    others, and a cell of very many boxes is divided over tasks.  Boxes that are the same are tested once, and their keys are paired last.
    """
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias("key"), *BOUNDS).repartition("key")  # one small file may hold very many rows
        bundles, _ = save(_bundled(rows, "key", list(BOUNDS)), "bundles")  # read several times below
        return _placed(bundles.withColumnRenamed("__keys", name), tuple(F.col(c) for c in BOUNDS)).drop(*BOUNDS)

    a, b = side(left, left_key, "__a"), side(right, right_key, "__b")
    swapped = lambda x, y: test(y, x)
    found = _meet(a, b, test).select("__a", "__b").unionByName(_meet(b, a, swapped, deeper=True).select("__a", "__b"))
    return _expanded(found, {"__a": "a_key", "__b": "b_key"})


def _expanded(found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Each pair of keys of two bundles.

    Keys leave their structs by a lambda, which Spark doesn't fuse with what lies below.  Explodes that are fused with a merge join hold
    the pairs of a row with all its matches in memory before the first is given.
    """
    found = found.select(*[F.transform(bundle, lambda x: x.k).alias(bundle) for bundle in keys])
    for bundle in keys:
        found = found.withColumn(bundle, F.explode(bundle))
    return found.select(*[F.col(bundle).alias(name) for bundle, name in keys.items()])


def components(pairs: DataFrame, a: str = "a_key", b: str = "b_key", side: bool = True) -> DataFrame:
    """(node, component) of the graph of pairs; with side, the nodes are a:<key> and b:<key>."""
    left = F.concat(F.lit("a:"), F.col(a).cast("string")) if side else F.col(a).cast("string")
    right = F.concat(F.lit("b:"), F.col(b).cast("string")) if side else F.col(b).cast("string")
    return graph.components(pairs.select(left.alias("a"), right.alias("b")))


def overlap_components(left: DataFrame, right: DataFrame, left_key: str, right_key: str, test=overlaps) -> DataFrame:
    """components(overlap_pairs(...)) without the pairs of keys: boxes are the nodes of the graph, each once on a side.

    A key belongs to the component of its box.  A key of several boxes connects those of them that overlap anything.
    """
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("node"), F.struct(F.lit(name).alias("side"), *BOUNDS).alias("box")).where("node IS NOT NULL")

    def boxes(df: DataFrame) -> DataFrame:
        return df.select("box").distinct().select("box", *[F.col(f"box.{c}") for c in BOUNDS])

    a, b = side(left, left_key, "a"), side(right, right_key, "b")
    pairs, path = save(overlap_pairs(boxes(a), boxes(b), "box", "box", test), "boxes")
    used = pairs.select(F.col("a_key").alias("box")).unionByName(pairs.select(F.col("b_key").alias("box"))).distinct()
    nodes, _ = save(a.unionByName(b).join(used.hint("merge"), "box").distinct(), "nodes")
    several = nodes.groupBy("node").agg(F.min("box").alias("a"), F.max("box").alias("__last")).where("a <> __last").select("node", "a")
    shared = nodes.join(several.hint("merge"), "node").select("a", F.col("box").alias("b"))
    of = graph.components(pairs.toDF("a", "b").unionByName(shared)).toDF("box", "label")
    named = nodes.hint("merge").join(of, "box").select("node", "label").distinct()
    least = named.groupBy("label").agg(F.min("node").alias("component"))
    out = named.hint("merge").join(least, "label").select("node", "component")
    remove(left.sparkSession, path)
    return out


def component_kinds(members: DataFrame) -> DataFrame:
    """component, n_old, n_new and kind from (node, component) with nodes a:<old> and b:<new>."""
    old = F.sum(F.col("node").startswith("a:").cast("long"))
    new = F.sum(F.col("node").startswith("b:").cast("long"))
    kind = F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), "uncertain_replacement").when(F.col("n_old") == 1, "split").when(F.col("n_new") == 1, "merge").otherwise("complex")
    return members.groupBy("component").agg(old.alias("n_old"), new.alias("n_new")).withColumn("kind", kind)


def viewport(features: DataFrame, views: DataFrame, key: str, view_key: str) -> DataFrame:
    """(view_key, key) of the features that intersect each view (closed); all views in one join."""
    named = overlap_pairs(views, features, view_key, key, test=intersects)
    return named.select(F.col("a_key").alias(view_key), F.col("b_key").alias(key))


def hit_test(points: DataFrame, features: DataFrame, point_key: str, key: str, inside: Column | None = None) -> DataFrame:
    """(point_key, key) of the features that hold each point (x, y).

    Boxes are compared first, by grid cell; ``inside`` is an exact test over the columns of both but their keys, such as a
    call of geometry.contains.  Points and features that are alike in all other columns (without ``inside``, in place or bounds) are tested once.
    """
    x, y = F.col("x"), F.col("y")
    others = lambda df, own, needed: needed if inside is None else [c for c in df.columns if c != own]
    places = _bundled(points, point_key, others(points, point_key, ["x", "y"])).withColumnRenamed("__keys", "__points")
    shapes = _bundled(features, key, others(features, key, list(BOUNDS))).withColumnRenamed("__keys", "__features")
    found = _meet(_placed(shapes, tuple(F.col(c) for c in BOUNDS)), _placed(places, (x, y, x, y)), intersects)
    return _expanded(found if inside is None else found.where(inside), {"__points": point_key, "__features": key})


def with_cells(features: DataFrame, extent: DataFrame, n: int = 8) -> DataFrame:
    """Adds ix and iy: the cell of each centre, of n by n in the extent (one row with lo_x, lo_y, hi_x, hi_y)."""
    j = with_extent(features, extent)

    def place(low: str, high: str, lo: str, hi: str) -> Column:
        share = ((F.col(low) + F.col(high)) / 2.0 - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))
        return F.least(F.greatest((F.coalesce(share, F.lit(0.0)) * n).cast("long"), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))

    cells = j.withColumns({"ix": place("min_x", "max_x", "lo_x", "hi_x"), "iy": place("min_y", "max_y", "lo_y", "hi_y")})
    return cells.drop("lo_x", "lo_y", "hi_x", "hi_y")


def density_grid(features: DataFrame, extent: DataFrame, n: int = 8, group: list[str] | None = None) -> DataFrame:
    """Counts of centres in n by n cells of the extent."""
    return with_cells(features, extent, n).groupBy(*(group or []), "ix", "iy").agg(F.count("*").alias("n"))


def extent(features: DataFrame) -> DataFrame:
    """One row; nulls when there is no feature."""
    return features.agg(F.min("min_x").alias("lo_x"), F.min("min_y").alias("lo_y"), F.max("max_x").alias("hi_x"), F.max("max_y").alias("hi_y"))


def with_extent(features: DataFrame, bounds: DataFrame) -> DataFrame:
    """The one row of bounds on every feature, by a scalar subquery."""
    row = bounds.select(F.struct("lo_x", "lo_y", "hi_x", "hi_y")).scalar()
    return features.withColumn("__extent", row).withColumns({c: F.col(f"__extent.{c}") for c in ("lo_x", "lo_y", "hi_x", "hi_y")}).drop("__extent")
