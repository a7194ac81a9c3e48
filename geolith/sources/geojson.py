"""GeoJSON feature collections as rows of features, read in byte ranges.

A file is read by Spark's text source in pieces that end at ``}``, so that the ranges of one large file, on one line
or many, go to different tasks.  Whether a piece begins inside a string, how deep its braces are and how many features
ended before it follow from sums over the pieces before: sums inside each range, and sums over the few ranges of a file.
Pieces between two ends of features are then put together by feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.functions import checks
from geolith.functions import geometry as G
from geolith.tables import save

FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:string>"
HEAD = '{"type":"FeatureCollection","features":['


def _count(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, size, block, turn and value of each piece, and what stands outside of its strings if it begins outside (0) or inside (1) of one."""
    meta = [F.col(f"_metadata.{n}").alias(c) for n, c in (("file_path", "file"), ("file_size", "size"), ("file_block_start", "block"))]
    rows = spark.read.option("lineSep", "}").text(path).select("value", *meta).withColumn("turn", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    rows = rows.withColumn("__parts", parts).withColumn("quotes", (F.size("__parts") - 1).cast("long"))
    for s, outer in ((0, lambda _, i: i % 2 == 0), (1, lambda _, i: i % 2 == 1)):
        outside = F.array_join(F.filter("__parts", outer), "")
        rows = rows.withColumn("__outside", outside).withColumns({f"opens{s}": _count(F.col("__outside"), "{"), f"brackets{s}": _count(F.col("__outside"), "[") - _count(F.col("__outside"), "]")})
    return rows.drop("__parts", "__outside")


def _states(pieces: DataFrame) -> DataFrame:
    """Adds depth and brackets after each piece, whether a feature ends with it, and whether its file ends in order.

    A piece without ``}`` at its end can only be the last of its file: then the bytes of the file are one fewer.
    """
    stats = pieces.groupBy("file").agg(F.max(F.struct("block", "turn")).alias("last"), (F.sum(F.octet_length("value") + 1) - F.max("size")).alias("lacks"))
    rows = pieces.join(stats, "file").withColumn("closed", ~((F.col("lacks") == 1) & (F.struct("block", "turn") == F.col("last"))))
    earlier = Window.partitionBy("file", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.lit(2)))

    def effects(start: Column) -> tuple[Column, Column]:
        """Of a piece on the depth and on the brackets, if its range begins outside (0) or inside (1) of a string."""
        at = F.pmod(F.col("inside") + start, F.lit(2))
        closes = F.col("closed") & (F.pmod(at + F.col("quotes"), F.lit(2)) == 0)
        return F.when(at == 0, F.col("opens0")).otherwise(F.col("opens1")) - closes.cast("long"), F.when(at == 0, F.col("brackets0")).otherwise(F.col("brackets1"))

    sums = [F.sum(x).alias(f"{name}{s}") for s in (0, 1) for x, name in zip(effects(F.lit(s)), ("depth", "nest"), strict=True)]
    ranges = rows.groupBy("file", "block").agg(F.sum("quotes").alias("q"), *sums)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.withColumn("start", F.pmod(F.coalesce(F.sum("q").over(before), F.lit(0)), F.lit(2)))
    own = {name: F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")) for name in ("depth", "nest")}
    ranges = ranges.withColumns(own).select("file", "block", "start", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"base_{n}") for n in ("depth", "nest")])
    depth, nest = effects(F.col("start"))
    rows = rows.join(ranges, ["file", "block"]).withColumns({"__d": depth, "__n": nest})
    rows = rows.withColumns({"depth": F.col("base_depth") + F.sum("__d").over(upto), "nest": F.col("base_nest") + F.sum("__n").over(upto)})
    outside = F.pmod(F.col("inside") + F.col("start") + F.col("quotes"), F.lit(2)) == 0
    ends = F.col("closed") & outside & (F.col("depth") == 1) & (F.col("nest") == 1)
    return rows.select("file", "block", "turn", "value", "closed", "lacks", "depth", "nest", outside.alias("outside"), ends.alias("ends"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, place, text of each feature (from 0), and of what is left after the last one, with faults of the file in ``broken``.

    broken: 'mark' (a byte order mark), 'unbalanced' (braces, brackets or a string that don't close, or text after the end).
    """
    states, _ = save(_states(_pieces(spark, path)), "pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = states.groupBy("file", "block").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    bases = bases.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    numbered = states.join(bases, ["file", "block"]).withColumn("place", F.col("base") + F.coalesce(F.sum(F.col("ends").cast("long")).over(inside), F.lit(0)))
    piece = F.struct("block", "turn", F.concat("value", F.when(F.col("closed"), "}").otherwise("")).alias("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["text"]), "")
    grouped = numbered.groupBy("file", "place").agg(text.alias("text"))
    roots = F.col("closed") & F.col("outside") & (F.col("depth") == 0)
    stray = ~F.col("closed") & (checks.stripped("value") != "")
    after = [F.count(F.when(roots, 1)).alias("roots"), F.count(F.when(stray, 1)).alias("stray")]
    end = states.groupBy("file").agg(F.max_by(F.struct("depth", "nest", "outside"), F.struct("block", "turn")).alias("e"), F.max("lacks").alias("lacks"), F.min("depth").alias("least"), F.sum(F.col("ends").cast("long")).alias("n"), *after)
    unbalanced = (F.col("e.depth") != 0) | (F.col("e.nest") != 0) | ~F.col("e.outside") | (F.col("least") < 0) | (F.col("roots") != 1) | (F.col("stray") > 0)
    broken = F.when(~F.col("lacks").isin(0, 1), "mark").when(unbalanced, "unbalanced")
    return grouped.join(end.select("file", "n", broken.alias("broken")), "file")


def _files(rows: DataFrame) -> DataFrame:
    """file, n (features) and rule of what is wrong with each file of ``texts``, null where nothing is."""
    head = F.when(F.col("place") == 0, F.regexp_extract("text", r'(?s)^.*?"features"\s*:\s*\[', 0))
    tail = F.when(F.col("place") == F.col("n"), F.col("text"))
    files = rows.groupBy("file", "n", "broken").agg(F.max(head).alias("head"), F.max(tail).alias("tail"))
    frame = F.when(F.col("n") == 0, F.col("tail")).otherwise(F.concat("head", "tail"))
    whole = F.from_json(frame, "struct<type:string,features:array<string>>")
    sound = F.coalesce((whole["type"] == "FeatureCollection") & (F.size(whole["features"]) == 0), F.lit(False))
    return files.select("file", "n", F.coalesce("broken", F.when(~sound, "collection")).alias("rule"))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, source_ordinal (from 1 in each file), geometry_type, coordinates and properties (JSON text) and fault of each feature.

    fault is 'feature' where an item of a collection is no feature, and 'separator' where items don't follow each other by one comma.
    With strict such an item, or a file that is no collection, fails the query; else these files have no rows, and ``collection_faults`` names them.
    """
    rows = texts(spark, path)
    head = F.regexp_extract("text", r'(?s)^.*?"features"\s*:\s*\[', 0)
    comma = F.regexp_extract("text", r"^\s*,", 0)
    lead = F.when(F.col("place") == 0, head).otherwise(comma)
    files = _files(rows).select("file", F.col("rule").alias("__rule"))
    rows = rows.join(files, "file").where(F.lit(True) if strict else F.col("__rule").isNull()).withColumn("__lead", lead)
    rows = rows.withColumn("f", F.from_json(F.expr("substring(text, char_length(__lead) + 1)"), FEATURE))
    fault = F.when(F.col("__lead") == "", "separator").when(~F.coalesce(F.col("f.type") == "Feature", F.lit(False)), "feature")
    fault = F.when(F.col("place") < F.col("n"), fault)
    if strict:
        wrong = F.coalesce("__rule", fault)
        fault = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("not a collection of features: "), wrong)).cast("string"))
    place = (F.col("place") + 1).cast("long").alias("source_ordinal")
    columns = [place, F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")]
    out = rows.withColumn("fault", fault).where("fault IS NOT NULL OR place < n")  # the faults of a file whose only row is what is left come up here
    return out.select("file", *columns, "fault")


def collection_faults(spark: SparkSession, path: str, expected_count: int | None = None, expected_files: int | None = 1) -> DataFrame:
    """file, rule and n of what is wrong with the collections at a path, before any feature is looked at.

    'mark' and 'unbalanced' as in ``texts``; 'collection': what is around the features is no FeatureCollection; 'count': a file has n features, not
    as many as expected; 'files': there are n collections (a row without file), not as many as expected ('exactly one').
    """
    files = _files(texts(spark, path))
    checked = files.withColumn("__rule", F.col("rule"))
    rules = [F.when(F.col("__rule").isNotNull(), F.struct(F.col("__rule").alias("rule"), F.col("n")))]
    if expected_count is not None:
        rules += [F.when(F.col("__rule").isNull() & (F.col("n") != expected_count), F.struct(F.lit("count").alias("rule"), F.col("n")))]
    out = checked.select("file", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("f")).select("file", "f.rule", "f.n")
    if expected_files is None:
        return out
    number = files.agg(F.count("*").alias("n")).where(F.col("n") != expected_files)
    return out.unionByName(number.select(F.lit(None).cast("string").alias("file"), F.lit("files").alias("rule"), "n"))


def write(rows: DataFrame, path: str) -> None:
    """Each partition of rows (geometry_type, coordinates and properties as JSON text) as a file with one collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield one([HEAD])
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield one([lines[0] if first else "," + lines[0], *("," + x for x in lines[1:])])
                first = False
        yield one(["]}"])

    kind = F.regexp_replace(F.to_json(F.struct(F.col("geometry_type").alias("k"))), r'^\{"k":|\}$', "")
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":'), F.when(F.col("geometry_type").isNull(), "null").otherwise(kind), F.lit(',"coordinates":'), F.coalesce("coordinates", F.lit("null")), F.lit('},"properties":'), F.coalesce("properties", F.lit("null")), F.lit("}"))
    rows.select(line.alias("value")).mapInArrow(run, "value string").write.text(path)


def parts(geometry_type: str = "geometry_type", coordinates: str = "coordinates") -> Column:
    """The parts of a geometry from the text of its coordinates; null if a position has not exactly two numbers."""

    def points(depth: int) -> T.DataType:
        out: T.DataType = T.ArrayType(T.DoubleType())
        for _ in range(depth):
            out = T.ArrayType(out)
        return out

    def structs(ring: Column) -> Column:
        good = F.forall(ring, lambda p: (F.size(p) == 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())
        return F.when(F.coalesce(good, F.lit(False)), F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))

    def whole(found: Column) -> Column:
        """Null unless every ring is there."""
        return F.when(F.forall(found, lambda rings: rings.isNotNull() & F.forall(rings, lambda r: r.isNotNull())), found)

    at = F.col(coordinates)
    line = F.array(F.array(structs(F.from_json(at, points(1)))))
    lines = F.transform(F.from_json(at, points(2)), lambda r: F.array(structs(r)))
    polygon = F.array(F.transform(F.from_json(at, points(2)), structs))
    polygons = F.transform(F.from_json(at, points(3)), lambda rings: F.transform(rings, structs))
    kind = F.col(geometry_type)
    return F.when(kind == "LineString", whole(line)).when(kind == "MultiLineString", whole(lines)).when(kind == "Polygon", whole(polygon)).when(kind == "MultiPolygon", whole(polygons))


def normalise(features: DataFrame, id_property: str) -> DataFrame:
    """The stored form: identity, geometry blob, canonical attributes, three digests and bounds.

    The identity is stripped of white space, in the attributes as well, before they are digested.  Rows whose identity is missing,
    blank or repeated, or whose geometry is not valid (a position with another number of ordinates than two, too), keep a reason in ``fault``.
    """
    name = id_property.replace("'", "\\'")
    identity = checks.stripped(F.get_json_object("properties", f"$['{name}']"))
    rows = features.withColumns({"source_feature_id": F.when(identity != "", identity), "parts": parts()})
    again = rows.where("source_feature_id IS NOT NULL").groupBy("source_feature_id").agg(F.count("*").alias("n")).where("n > 1").select("source_feature_id", F.lit(True).alias("__again"))
    rows = rows.join(again, "source_feature_id", "left")
    earlier = [F.col("fault")] if "fault" in features.columns else []
    valid = F.coalesce(G.is_valid("geometry_type", "parts"), F.lit(False))
    own = F.when(F.col("source_feature_id").isNull(), "identity").when(F.col("__again"), "duplicate").when(~valid, "geometry")
    rows = rows.withColumn("fault", F.coalesce(*earlier, own)).withColumn("attributes_json", G.canonical("properties", F.lit(id_property), "source_feature_id"))
    sound = F.col("fault").isNull()
    rows = rows.withColumns({"geometry": F.when(sound, G.gpkg("geometry_type", "parts")), "wkb": F.when(sound, G.wkb("geometry_type", "parts")), "box": G.bounds("parts")})
    rows = rows.withColumns({"geometry_sha256": F.sha2("wkb", 256), "attributes_sha256": F.sha2("attributes_json", 256)})
    body = F.concat(F.lit('{"attributes_sha256":"'), "attributes_sha256", F.lit('","geometry_sha256":"'), "geometry_sha256", F.lit('","source_feature_id":"'), "source_feature_id", F.lit('"}'))
    return rows.withColumn("content_sha256", F.sha2(body, 256)).select(
        "source_feature_id", "source_ordinal", "geometry", "geometry_type", "geometry_sha256", "attributes_json", "attributes_sha256", "content_sha256", "box.min_x", "box.min_y", "box.max_x", "box.max_y", "fault"
    )
