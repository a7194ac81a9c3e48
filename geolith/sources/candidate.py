"""Staged candidates: what a harvest leaves beside its features, and the check that all of it follows from them again.

A candidate is three tables: features (as geojson.normalise makes them, with object_id), inventory (object_id) and a manifest of one row.
Nothing in the manifest is taken on trust: counts, digests, pages and the key of the release are computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions import checks
from geolith.operators.diff import missing_and_extra
from geolith.operators.release import state_digest
from geolith.sources import geojson
from geolith.tables import save

CONTENT = ["source_feature_id", "object_id", "source_ordinal", "geometry_sha256", "attributes_sha256", "content_sha256"]
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def normalised(collection: DataFrame, id_property: str, object_id_property: str) -> DataFrame:
    """Rows of geojson.read in their stored form, with object_id from the attributes."""
    rows = geojson.normalise(collection, id_property)
    return rows.withColumn("object_id", checks.object_id(F.get_json_object("attributes_json", f"$['{object_id_property}']")))


def manifest(features: DataFrame, inventory: DataFrame, harvest: dict[str, Column], stem: str) -> DataFrame:
    """One row: counts and digests of features and inventory, the harvest (page_size, started_at, completed_at, published_day) and what follows from all that."""
    one = F.lit(1).alias("row")
    content = state_digest(features, CONTENT).select(one, F.col("n").alias("feature_count"), F.col("sha256").alias("content_sha256"))
    pairs = state_digest(features, ["object_id", "source_feature_id"]).select(one, F.col("sha256").alias("identity_map_sha256"))
    stable = features.agg(F.count_distinct("source_feature_id").alias("stable_id_count")).select(one, "stable_id_count")
    ids = state_digest(inventory, ["object_id"]).select(one, F.col("n").alias("object_count"), F.col("sha256").alias("object_ids_sha256"))
    row = content.join(pairs, "row").join(stable, "row").join(ids, "row").drop("row").withColumns(harvest)
    pages = F.ceil(F.col("object_count") / F.col("page_size")).cast("long")
    return row.withColumns({"page_count": pages, "release_key": checks.release_key(stem, "published_day", "content_sha256")})


def faults(staged: dict[str, DataFrame], collection: DataFrame, stem: str, id_property: str, object_id_property: str) -> DataFrame:
    """rule and n of what is wrong with a staged candidate (features, inventory, manifest) of a collection.

    'feature': features with a fault of their own; 'not_normalised': features that aren't what the collection gives now, are lost or added; 'inventory_missing' and
    'inventory_extra': object ids of the inventory without a feature, and the other way round; 'inventory_repeated'; 'manifest <field>': what is not as it is computed again; 'times': timestamps
    that are no timestamps, or end before they begin.
    """
    held, inventory, stored = staged["features"], staged["inventory"], staged["manifest"]
    again, _ = save(normalised(collection, id_property, object_id_property), "normalised")
    rows = again.select(*CONTENT, F.lit(1).alias("now"), F.lit(0).alias("then")).unionByName(held.select(*CONTENT, F.lit(0).alias("now"), F.lit(1).alias("then")))
    more = rows.groupBy(*CONTENT).agg((F.sum("now") - F.sum("then")).alias("more")).where("more <> 0")
    lost, extra = (F.coalesce(F.sum(F.greatest(x, F.lit(0))), F.lit(0)) for x in (F.col("more"), -F.col("more")))
    other = more.agg(F.greatest(lost, extra).alias("n")).select(F.lit("not_normalised").alias("rule"), "n")
    ids = missing_and_extra(inventory, held.where("object_id IS NOT NULL"), ["object_id"])
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = [count(held.where("fault IS NOT NULL"), "feature"), other, count(ids.where("kind = 'missing'"), "inventory_missing"), count(ids.where("kind = 'extra'"), "inventory_extra")]
    out.append(count(inventory.groupBy("object_id").agg(F.count("*").alias("c")).where("c > 1"), "inventory_repeated"))
    harvest = ["page_size", "started_at", "completed_at", "published_day"]
    known = stored.select(*harvest).limit(1).select(F.struct(*harvest).alias("h"))
    want = manifest(held, inventory, {c: known.select(f"h.{c}").scalar() for c in harvest}, stem)
    fields = [c for c in want.columns if c not in harvest]
    differ = F.filter(F.array(*[F.when(~F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")), F.lit(f"manifest {c}")) for c in fields]), lambda x: x.isNotNull())
    begun, ended = (F.try_to_timestamp(F.col(f"s.{c}"), F.lit(TIME)) for c in ("started_at", "completed_at"))
    timed = checks.is_timestamp(F.col("s.started_at")) & checks.is_timestamp(F.col("s.completed_at")) & F.coalesce(begun <= ended, F.lit(False))
    one = lambda df, name: df.select(F.lit(1).alias("row"), F.struct("*").alias(name))
    compared = one(want, "w").join(one(stored, "s"), "row")
    out.append(compared.select(F.explode(differ).alias("rule"), F.lit(1).cast("long").alias("n")))
    out.append(compared.where(~timed).select(F.lit("times").alias("rule"), F.lit(1).cast("long").alias("n")))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.where("n > 0")
