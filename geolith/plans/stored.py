"""Queries on stored releases: scans, rules, promotion, snapshots, text and view functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import checks, geometry, spatial
from geolith.operators import promotion, reconcile, release, stored
from geolith.plans.frames import accepted, candidate, duck, features, table
from geolith.plans.maps import polygons
from geolith.plans.registry import query
from geolith.sources import staging


def digest_sql(relation: str, columns: list[str]) -> str:
    """n and sha256 of a relation, as release.state_digest computes them."""
    text = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(coalesce(string_agg(h, ',' ORDER BY h), '')) AS sha256 FROM (
  SELECT substr(p, 1, 2) || ':' || sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM (
    SELECT substr(h, 1, 4) AS p, substr(h, 1, 4) || ':' || sha256(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS n FROM (
      SELECT sha256(concat_ws('|', {text})) AS h FROM {relation}) GROUP BY substr(h, 1, 4)) GROUP BY substr(p, 1, 2))"""


IDS = ["id", "geometry_sha256", "attributes_sha256"]


@query("state_digest", duck("accepted", digest_sql("accepted", IDS)))
def state_digest(spark: SparkSession, d: str) -> DataFrame:
    return release.state_digest(accepted(spark, d), IDS)


# Which release is accepted, and its features.

RELEASES = "SELECT o_custkey AS dataset, o_orderkey AS release_key, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'candidate' ELSE 'rejected' END AS lifecycle FROM orders"
CHOSEN = f"chosen AS (SELECT dataset, min(release_key) AS release_key FROM ({RELEASES}) WHERE lifecycle = 'accepted' GROUP BY 1 HAVING count(*) = 1)"


def _releases(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "candidate").otherwise("rejected")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("release_key"), status.alias("lifecycle"))


@query("accepted_release", f"""SELECT dataset, CASE WHEN count(*) FILTER (lifecycle = 'accepted') = 1 THEN min(release_key) FILTER (lifecycle = 'accepted') END AS release,
CASE count(*) FILTER (lifecycle = 'accepted') WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'several' END AS fault FROM ({RELEASES}) GROUP BY 1""")  # fmt: skip
def accepted_release(spark: SparkSession, d: str) -> DataFrame:
    return stored.accepted_release(_releases(spark, d), "dataset", "release_key")


@query("candidate_release", f"""SELECT p_partkey * 3 AS release_key, CASE WHEN lifecycle IS NULL THEN 'missing' WHEN lifecycle <> 'candidate' THEN 'not_candidate' END AS fault
FROM part LEFT JOIN ({RELEASES}) ON release_key = p_partkey * 3""")  # fmt: skip
def candidate_release(spark: SparkSession, d: str) -> DataFrame:
    return stored.candidate_release(table(spark, d, "part").selectExpr("p_partkey * 3 AS release_key"), _releases(spark, d), "release_key")


@query("accepted_features", f"WITH {CHOSEN} SELECT dataset, release_key, l_linenumber AS ordinal, l_partkey AS id FROM lineitem JOIN chosen ON release_key = l_orderkey")
def accepted_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release_key"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("id"))
    return stored.accepted_features(rows, _releases(spark, d), "dataset", "release_key").select("dataset", "release_key", "ordinal", "id")


MAPPED = """confirmed AS (SELECT l_partkey AS id, l_suppkey AS project, CASE s_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'retired' END AS status
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'F')"""


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    mappings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("project"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("proposed").alias("mapping_status"))
    identities = table(spark, d, "supplier").selectExpr("s_suppkey AS project", "CASE s_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'retired' END AS identity_status")
    return stored.mapped(accepted(spark, d), mappings, identities, "id", "project")


@query("mapped_features", duck("accepted", f"WITH {MAPPED} SELECT a.id, count(c.id) AS n_mappings, min(project) AS project, max(status) AS identity_status FROM accepted a LEFT JOIN confirmed c ON c.id = a.id GROUP BY a.id"))
def mapped_features(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("id", "n_mappings", "project", "identity_status")


LINES = "SELECT * FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_linenumber = 2)"
SCAN_RULES = {"discount": "l_discount > 0.08", "returned_open": "l_returnflag = 'R' AND l_linestatus = 'O'", "quantity": "l_quantity > 48"}


@query("scan_faults", f"""SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter([{", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in SCAN_RULES.items())}], lambda x: x IS NOT NULL)) AS rule FROM ({LINES}))
UNION ALL SELECT l_orderkey, NULL, 'ordinals' FROM ({LINES}) GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)""")  # fmt: skip
def scan_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("NOT (l_orderkey % 7 = 0 AND l_linenumber = 2)")
    return stored.scan_faults(rows, ["l_orderkey", "l_linenumber"], "l_orderkey", "l_linenumber", SCAN_RULES)


KEY = """'kcb-' || sha256('{"algorithm":"sha256-release-feature-v1","release_key":"' || release_key || '","source_feature_id":"' || id || '"}')"""
IDENTITIES = f"SELECT *, CASE WHEN id % 10 = 0 THEN 'kcb-' || sha256('x' || id) ELSE {KEY} END AS project_key FROM (SELECT p_partkey AS id, 'r-' || (p_partkey % 5) AS release_key FROM part)"


@query("identity_faults", f"""WITH i AS ({IDENTITIES}), m AS (SELECT project_key, CASE WHEN id % 13 = 0 THEN 'r-9' ELSE release_key END AS release_key FROM i WHERE id % 11 <> 0 UNION ALL SELECT project_key, release_key FROM i WHERE id % 17 = 0),
g AS (SELECT project_key, count(*) AS n, min(release_key) AS a, max(release_key) AS b FROM m GROUP BY 1)
SELECT project_key, 'not_derived' AS rule FROM i WHERE id % 10 = 0 UNION ALL
SELECT project_key, rule FROM (SELECT i.project_key, CASE WHEN n IS NULL THEN 'no_initial' WHEN n > 1 THEN 'several_initial' WHEN a <> i.release_key OR b <> i.release_key THEN 'other_origin' END AS rule FROM i LEFT JOIN g USING (project_key)) WHERE rule IS NOT NULL""")  # fmt: skip
def identity_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", "concat('r-', p_partkey % 5) AS release_key", "cast(p_partkey AS string) AS source_feature_id")
    key = F.when(F.expr("id % 10 = 0"), F.concat(F.lit("kcb-"), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256))).otherwise(checks.project_key("sha256-release-feature-v1", "release_key", "source_feature_id"))
    identities = rows.withColumn("project_key", key)
    mappings = identities.where("id % 11 <> 0").selectExpr("project_key", "CASE WHEN id % 13 = 0 THEN 'r-9' ELSE release_key END AS release_key").unionByName(identities.where("id % 17 = 0").select("project_key", "release_key"))
    return stored.identity_faults(identities, mappings.withColumn("relationship", F.lit("initial")), "sha256-release-feature-v1")


# Pages of a source.

PAGED = """SELECT p_partkey AS id, p_partkey // 10 AS page, CASE WHEN p_partkey % 23 <> 0 THEN 'g' END AS geometry, CASE WHEN p_partkey % 401 = 0 THEN 'Point' WHEN p_size % 2 = 0 THEN 'LineString' ELSE 'MultiLineString' END AS geometry_type FROM part"""


def _paged(spark: SparkSession, d: str) -> DataFrame:
    kind = "CASE WHEN p_partkey % 401 = 0 THEN 'Point' WHEN p_size % 2 = 0 THEN 'LineString' ELSE 'MultiLineString' END AS geometry_type"
    return table(spark, d, "part").selectExpr("p_partkey AS id", "p_partkey div 10 AS page", "CASE WHEN p_partkey % 23 <> 0 THEN 'g' END AS geometry", kind)


MARKED = f"m AS (SELECT *, CASE WHEN geometry IS NULL THEN 'no_geometry' WHEN geometry_type = 'Point' THEN 'type' END AS reason FROM ({PAGED}))"


@query("page_excluded", f"WITH {MARKED} SELECT id, coalesce(reason, CASE WHEN page IN (SELECT page FROM m WHERE reason = 'type') THEN 'group' END) AS reason FROM m WHERE reason IS NOT NULL OR page IN (SELECT page FROM m WHERE reason = 'type')")
def page_excluded(spark: SparkSession, d: str) -> DataFrame:
    return stored.pages(_paged(spark, d), "page", "geometry", "geometry_type", "roads")[1].select("id", "reason")


@query("page_rejected", f"WITH {MARKED} SELECT id FROM m WHERE page NOT IN (SELECT page FROM m WHERE reason IS NOT NULL)")
def page_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What is left where a row without geometry rejects its page: the water layers' rule."""
    return stored.pages(_paged(spark, d), "page", "geometry", "geometry_type", "water", keep_null="reject")[0].select("id")


@query("field_projection", "SELECT trim(CAST(s_suppkey AS VARCHAR)) AS s_suppkey, s_name FROM supplier")
def field_projection(spark: SparkSession, d: str) -> DataFrame:
    return stored.projected(table(spark, d, "supplier"), ["s_suppkey", "s_name"], "s_suppkey")


@query("recorded_outcomes", duck("accepted candidate", """SELECT c.id, CASE WHEN a.id IS NULL THEN 'insert' WHEN a.geometry_sha256 = c.geometry_sha256 AND a.attributes_sha256 = c.attributes_sha256 THEN 'equal' ELSE 'conflict' END AS outcome FROM candidate c LEFT JOIN accepted a USING (id)"""))
def recorded_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return stored.recorded(accepted(spark, d), candidate(spark, d), ["id"], IDS[1:])


@query("set_report", duck("accepted candidate", """SELECT *, n_missing = 0 AND n_extra = 0 AS equal, n_extra = 0 AS subset FROM (SELECT (SELECT count(*) FROM candidate WHERE id NOT IN (SELECT id FROM accepted)) AS n_missing, (SELECT count(*) FROM accepted WHERE id NOT IN (SELECT id FROM candidate)) AS n_extra)"""))
def set_report(spark: SparkSession, d: str) -> DataFrame:
    return stored.set_report(accepted(spark, d), candidate(spark, d), "id")


# Rules on stored rows: each query derives the columns of a rule set from a table, the same in either engine.


def _rules_sql(rows: str, key: str, rules: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items())
    return f"SELECT {key}, rule FROM (SELECT {key}, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule FROM (SELECT {rows}))"


def _select(rows: str) -> list[str]:
    return rows.rsplit(" FROM ", 1)[0].split(";; ")


HARVESTS = """o_orderkey;; CASE o_orderkey % 5 WHEN 0 THEN 'planned' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'lost' END AS status;; CASE WHEN o_orderkey % 3 = 0 THEN 'then' END AS completed_at;; CASE o_orderkey % 4 WHEN 0 THEN 'bad' WHEN 1 THEN ' ' END AS error_message FROM orders"""
STORED_RELEASES = """o_orderkey;; CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'candidate' ELSE 'superseded' END AS lifecycle;; CASE WHEN o_orderkey % 3 = 0 THEN 'then' END AS accepted_at;; CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS superseded_by FROM orders"""
MAPPINGS = """o_orderkey;; CASE o_orderkey % 4 WHEN 0 THEN 'deterministic-seed' WHEN 1 THEN 'automatic' WHEN 2 THEN 'reviewed' END AS decision_method;; CASE o_orderkey % 7 WHEN 0 THEN 'proposed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'other' ELSE 'confirmed' END AS mapping_status;; CASE WHEN o_orderkey % 3 = 0 THEN 'then' END AS reviewed_at FROM orders"""
RETIREMENTS = """s_suppkey;; CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'retired' END AS identity_status;; CASE WHEN s_suppkey % 2 = 0 THEN 'then' END AS retired_at FROM supplier"""
PROMOTIONS = """o_orderkey;; CASE o_orderkey % 3 WHEN 0 THEN 'promotion' WHEN 1 THEN 'rollback' END AS event_kind;; CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS related_event FROM orders"""
BOUNDS = """p_partkey;; p_partkey % 400 - 200.0e0 AS min_x;; p_partkey % 390 - 199.5e0 AS max_x;; p_size * 2.0e0 AS min_y;; CASE WHEN p_size <> 7 THEN p_size * 1.9e0 END AS max_y FROM part"""


def _rule_query(name: str, rows: str, rules: dict[str, str], source: str) -> None:
    columns = _select(rows)
    key = columns[0]

    @query(name, _rules_sql(", ".join(columns) + " FROM " + source, key, rules))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return stored.broken(table(spark, d, source).selectExpr(*columns), [key], rules)


for _name, _rows, _rules, _source in (
    ("harvest_rules", HARVESTS, stored.HARVEST_RULES, "orders"), ("release_rules", STORED_RELEASES, stored.RELEASE_RULES, "orders"), ("mapping_rules", MAPPINGS, stored.MAPPING_RULES, "orders"),
    ("retirement_rules", RETIREMENTS, stored.RETIREMENT_RULES, "supplier"), ("promotion_rules", PROMOTIONS, stored.PROMOTION_RULES, "orders"), ("bounds_rules", BOUNDS, stored.BOUNDS_RULES, "part"),
):
    _rule_query(_name, _rows, _rules, _source)


@query("initial_duplicates", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_linestatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def initial_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey", "CASE WHEN l_linenumber = 1 THEN 'initial' ELSE 'continuation' END AS relationship", "CASE WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'proposed' END AS mapping_status")
    return stored.initial_duplicates(rows, "l_suppkey")


# Promotion.

NEWEST = f"r AS ({RELEASES}), c AS (SELECT dataset, max(release_key) AS promoted FROM r WHERE lifecycle = 'candidate' GROUP BY 1)"
AFTER = """after AS (SELECT dataset, release_key, lifecycle AS before, CASE WHEN lifecycle = 'accepted' AND promoted IS NOT NULL THEN 'superseded' WHEN lifecycle = 'candidate' AND release_key = promoted THEN 'accepted' ELSE lifecycle END AS after,
  CASE WHEN lifecycle = 'accepted' THEN promoted END AS superseded_by FROM r LEFT JOIN c USING (dataset))"""


@query("promotion_plan", f"""WITH {NEWEST}, {AFTER} SELECT dataset, release_key, before, after, superseded_by, CASE WHEN before <> after AND dataset % 5 <> 0 THEN sha256('c' || dataset) END AS comparison_sha256,
CASE WHEN before <> after AND dataset % 5 = 0 THEN 'no_comparison' END AS fault FROM after""")  # fmt: skip
def promotion_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = _releases(spark, d)
    compared = rows.where("dataset % 5 <> 0").select("dataset").distinct().withColumn("comparison_sha256", F.sha2(F.concat(F.lit("c"), F.col("dataset").cast("string")), 256))
    return promotion.with_comparisons(release.transition(rows, "dataset", "release_key"), compared, "dataset")


#: Releases that were superseded before the promotion, by the one after them, beside the accepted ones and candidates.
HELD = "SELECT dataset, release_key, CASE lifecycle WHEN 'rejected' THEN 'superseded' ELSE lifecycle END AS lifecycle, CASE lifecycle WHEN 'rejected' THEN release_key + 1 END AS superseded_by"


def _held(spark: SparkSession, d: str) -> DataFrame:
    return _releases(spark, d).selectExpr(*HELD.removeprefix("SELECT ").split(", "))


HELD_SQL = f"""r AS ({HELD} FROM ({RELEASES})), c AS (SELECT dataset, max(release_key) AS promoted FROM r WHERE lifecycle = 'candidate' GROUP BY 1),
after AS (SELECT dataset, release_key, lifecycle AS before, CASE WHEN lifecycle = 'accepted' AND promoted IS NOT NULL THEN 'superseded' WHEN lifecycle = 'candidate' AND release_key = promoted THEN 'accepted' ELSE lifecycle END AS after,
  CASE WHEN lifecycle = 'accepted' THEN promoted ELSE superseded_by END AS superseded_by FROM r LEFT JOIN c USING (dataset))"""


@query("promoted_state", f"""WITH {HELD_SQL}, s AS (SELECT dataset, release_key, CASE WHEN release_key % 19 = 0 THEN 'rejected' ELSE after END AS lifecycle, CASE WHEN release_key % 7 <> 0 THEN superseded_by END AS superseded_by FROM after WHERE release_key % 23 <> 0)
SELECT dataset, release_key, 'missing' AS rule FROM after WHERE release_key % 23 = 0 UNION ALL SELECT dataset, release_key, 'lifecycle' FROM s JOIN after a USING (dataset, release_key) WHERE s.lifecycle <> a.after
UNION ALL SELECT dataset, release_key, 'superseded_by' FROM s JOIN after a USING (dataset, release_key) WHERE before <> after AND s.superseded_by IS DISTINCT FROM a.superseded_by""")  # fmt: skip
def promoted_state(spark: SparkSession, d: str) -> DataFrame:
    """Faults that others left after a promotion; releases that were superseded earlier are sound."""
    rows = _held(spark, d)
    plan = release.transition(rows, "dataset", "release_key")
    held = promotion.activated(rows, plan, "dataset", "release_key").where("release_key % 23 <> 0")
    held = held.withColumns({"lifecycle": F.expr("CASE WHEN release_key % 19 = 0 THEN 'rejected' ELSE lifecycle END"), "superseded_by": F.expr("CASE WHEN release_key % 7 <> 0 THEN superseded_by END")})
    return promotion.state_faults(held, plan, "dataset", "release_key")


@query("activated_releases", f"WITH {HELD_SQL} SELECT dataset, release_key, after AS lifecycle, superseded_by FROM after")
def activated_releases(spark: SparkSession, d: str) -> DataFrame:
    rows = _held(spark, d)
    return promotion.activated(rows, release.transition(rows, "dataset", "release_key"), "dataset", "release_key").select("dataset", "release_key", "lifecycle", "superseded_by")


@query("restored_releases", f"WITH {HELD_SQL} SELECT dataset, release_key, CASE WHEN before <> after THEN before WHEN release_key % 29 = 0 THEN 'archived' ELSE after END AS lifecycle, CASE WHEN before = after THEN superseded_by END AS superseded_by FROM after")
def restored_releases(spark: SparkSession, d: str) -> DataFrame:
    """Rows that others changed after the promotion keep their state: only what the plan moved goes back."""
    rows = _held(spark, d)
    plan = release.transition(rows, "dataset", "release_key")
    held = promotion.activated(rows, plan, "dataset", "release_key")
    held = held.withColumn("lifecycle", F.expr("CASE WHEN release_key % 29 = 0 THEN 'archived' ELSE lifecycle END"))
    return promotion.restored(held, plan, "dataset", "release_key").select("dataset", "release_key", "lifecycle", "superseded_by")


@query("digest_separates", f"""SELECT 'divided' AS name, a.n AS n_before, a.sha256 AS sha256_before, b.n AS n_now, b.sha256 AS sha256_now, true AS refused
FROM ({digest_sql("(SELECT p_name || '|=' || p_brand AS a, p_type AS b FROM part)", ["a", "b"])}) a, ({digest_sql("(SELECT p_name AS a, p_brand || '|=' || p_type AS b FROM part)", ["a", "b"])}) b""")  # fmt: skip
def digest_separates(spark: SparkSession, d: str) -> DataFrame:
    """The same text divided otherwise over two columns is another state."""
    rows, mark = table(spark, d, "part"), F.lit("|=")
    before = rows.select(F.concat("p_name", mark, "p_brand").alias("a"), F.col("p_type").alias("b"))
    now = rows.select(F.col("p_name").alias("a"), F.concat("p_brand", mark, "p_type").alias("b"))
    return promotion.guard({"divided": before}, {"divided": now}, {"divided": ["a", "b"]})


@query("rollback_guard", duck("accepted candidate", f"""SELECT 'identities' AS name, a.n AS n_before, a.sha256 AS sha256_before, b.n AS n_now, b.sha256 AS sha256_now, a.sha256 <> b.sha256 AS refused FROM ({digest_sql("accepted", IDS)}) a, ({digest_sql("candidate", IDS)}) b
UNION ALL SELECT 'classifications', a.n, a.sha256, a.n, a.sha256, false FROM ({digest_sql("customer", ["c_custkey", "c_mktsegment"])}) a"""))  # fmt: skip
def rollback_guard(spark: SparkSession, d: str) -> DataFrame:
    classes = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    before = {"identities": accepted(spark, d), "classifications": classes}
    now = {"identities": candidate(spark, d), "classifications": classes.orderBy(F.desc("c_mktsegment"))}
    return promotion.guard(before, now, {"identities": IDS, "classifications": ["c_custkey", "c_mktsegment"]})


PROJECTS = "projects AS (SELECT l_suppkey AS project_key, l_partkey AS id FROM lineitem WHERE l_linenumber = 1), identities AS (SELECT s_suppkey AS project_key, CASE s_nationkey % 4 WHEN 0 THEN 'inactive' WHEN 1 THEN 'retired' ELSE 'active' END AS before FROM supplier)"


@query("identity_changes", duck("accepted candidate", f"""WITH {PROJECTS}, kept AS (SELECT id FROM accepted JOIN candidate USING (id)), fate AS (SELECT id, id IN (SELECT id FROM kept) AS goes_on FROM accepted),
touched AS (SELECT project_key, bool_or(goes_on) AS goes_on FROM projects JOIN fate USING (id) GROUP BY 1)
SELECT project_key, before, CASE WHEN before = 'retired' THEN 'retired' WHEN goes_on THEN 'active' ELSE 'inactive' END AS after FROM touched JOIN identities USING (project_key)"""))  # fmt: skip
def identity_changes(spark: SparkSession, d: str) -> DataFrame:
    """Without replacements: features of the accepted release that the candidate lacks have disappeared."""
    old, new = accepted(spark, d), candidate(spark, d)
    parts = {
        "continuations": reconcile.continuations(old, new, "id"), "replacements": old.select(F.col("id").alias("old_id"), F.col("id").alias("new_id")).where("false"),
        "disappearances": old.join(new.select("id"), "id", "left_anti").select("id"),
    }
    projects = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("project_key"), F.col("l_partkey").alias("id"))
    identities = table(spark, d, "supplier").selectExpr("s_suppkey AS project_key", "CASE s_nationkey % 4 WHEN 0 THEN 'inactive' WHEN 1 THEN 'retired' ELSE 'active' END AS identity_status")
    return reconcile.identity_changes(projects, identities, parts, "id")


@query("classifications_preserved", f"""SELECT a.n AS n_before, a.sha256 AS sha256_before, b.n AS n_after, b.sha256 AS sha256_after, a.sha256 = b.sha256 AS preserved
FROM ({digest_sql("customer", ["c_custkey", "c_mktsegment"])}) a, ({digest_sql("(SELECT * FROM customer WHERE c_custkey <> 7)", ["c_custkey", "c_mktsegment"])}) b""")  # fmt: skip
def classifications_preserved(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return reconcile.classifications_preserved(rows, rows.where("c_custkey <> 7"), ["c_custkey", "c_mktsegment"])


# Snapshots and manifests.

CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SHOWN = "c_custkey % 3 <> 0"


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "customer")
    return staging.snapshot(rows.select("c_custkey", F.col("c_mktsegment").alias("classification")), rows.where(SHOWN), "c_custkey", CLASSES)


@query("snapshot_header", f"""SELECT r.n AS count, concat_ws(',', {", ".join(f"'{c}=' || (SELECT count(*) FROM customer WHERE {SHOWN} AND c_mktsegment = '{c}')" for c in CLASSES)}) AS counts,
(SELECT count(*) FROM customer WHERE NOT ({SHOWN})) AS not_rendered, r.sha256 AS records_sha256, k.n AS render_count, k.sha256 AS render_sha256
FROM ({digest_sql(f"(SELECT * FROM customer WHERE {SHOWN})", ["c_custkey", "c_mktsegment"])}) r, ({digest_sql(f"(SELECT * FROM customer WHERE {SHOWN})", ["c_custkey"])}) k""")  # fmt: skip
def snapshot_header(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d)[1]


@query("snapshot_faults", f"""SELECT 'repeated_key' AS rule, count(*) AS n FROM customer WHERE {SHOWN} AND c_custkey % 10 = 1 UNION ALL
SELECT 'unknown_class', count(*) FROM customer WHERE {SHOWN} AND c_custkey % 10 = 1 UNION ALL SELECT 'count', count(*) FROM customer WHERE {SHOWN} AND c_custkey % 10 = 1 UNION ALL SELECT 'records_sha256', 1""")  # fmt: skip
def snapshot_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth record comes again with another class."""
    records, header = _snapshot(spark, d)
    more = records.where("c_custkey % 10 = 1").withColumn("classification", F.lit("OTHER"))
    return staging.snapshot_faults(records.unionByName(more), header, "c_custkey", CLASSES)


PACKED = "SELECT {level} AS level, id, {sha}(concat('g', CAST({geometry} AS VARCHAR))) AS geometry_sha256, size FROM features WHERE {where}"
LARGE = {"level": "2", "geometry": "id % 900", "where": "size >= 25"}
ALL = {"level": "CASE WHEN size >= 16 THEN 1 ELSE 0 END", "geometry": "id % 900", "where": "true"}
PACKED_COLUMNS = ["geometry_sha256", "id", "level", "size"]


def _packed(spark: SparkSession, d: str, level: str, geometry: str, where: str) -> DataFrame:
    sha = F.sha2(F.concat(F.lit("g"), F.expr(geometry).cast("string")), 256)
    return features(spark, d).where(where).select(F.expr(level).alias("level"), "id", sha.alias("geometry_sha256"), "size")


def _packed_sql(level: str, geometry: str, where: str) -> str:
    return digest_sql("(" + PACKED.format(sha="sha256", level=level, geometry=geometry, where=where) + ")", PACKED_COLUMNS)


@query("package_manifest", duck("features", f"SELECT 'large' AS role, n AS n_records, '2' AS levels, sha256 FROM ({_packed_sql(**LARGE)}) UNION ALL SELECT 'all' AS role, n, '0,1', sha256 FROM ({_packed_sql(**ALL)})"))
def package_manifest(spark: SparkSession, d: str) -> DataFrame:
    return staging.manifest({"large": _packed(spark, d, **LARGE), "all": _packed(spark, d, **ALL)})


@query("manifest_changes", duck("features", f"""WITH a AS (SELECT 'large' AS role, * FROM ({_packed_sql(**LARGE)}) UNION ALL SELECT 'all', * FROM ({_packed_sql(**ALL)}) UNION ALL SELECT 'gone', * FROM ({_packed_sql(**LARGE)})),
b AS (SELECT 'large' AS role, * FROM ({_packed_sql(**LARGE)}) UNION ALL SELECT 'all', * FROM ({_packed_sql(**ALL | {"geometry": "CASE WHEN id % 50 = 7 THEN -id ELSE id % 900 END"})}) UNION ALL SELECT 'new', * FROM ({_packed_sql(**LARGE)}))
SELECT role, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unknown' ELSE 'changed' END AS fault FROM a FULL JOIN b USING (role) WHERE a.sha256 IS DISTINCT FROM b.sha256"""))  # fmt: skip
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """The same keys with another geometry are another package."""
    large, everything = _packed(spark, d, **LARGE), _packed(spark, d, **ALL)
    other = _packed(spark, d, **ALL | {"geometry": "CASE WHEN id % 50 = 7 THEN -id ELSE id % 900 END"})
    return staging.manifest_faults(staging.manifest({"large": large, "all": everything, "gone": large}), staging.manifest({"large": large, "all": other, "new": large}))


# Text, time and view functions.


@query("time_functions", """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05:09.250' AS naive FROM orders)
SELECT o_orderkey, epoch_ms(CAST(replace(naive, 'T', ' ') AS TIMESTAMP)) AS utc_ms, epoch_ms(CAST(replace(naive, 'T', ' ') AS TIMESTAMP)) - 5400000 AS zoned_ms, CAST(NULL AS BIGINT) AS without_zone, naive || 'Z' AS iso, left(naive, 19) || 'Z' AS seconds FROM t""")  # fmt: skip
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    naive = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":05:09.250"))
    rows = table(spark, d, "orders").select("o_orderkey", naive.alias("naive")).withColumn("utc_ms", checks.naive_epoch_ms("naive"))
    zoned = F.concat("naive", F.lit("+01:30"))
    return rows.select("o_orderkey", "utc_ms", checks.epoch_ms(zoned).alias("zoned_ms"), checks.epoch_ms("naive").alias("without_zone"), checks.iso_of("utc_ms").alias("iso"), checks.utc_seconds(F.concat("naive", F.lit("Z"))).alias("seconds"))


@query("document_faults", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS keys, CASE s_suppkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'blank' WHEN 2 THEN 'untrimmed' END AS text,
CASE s_suppkey % 3 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'blank' END AS items FROM supplier""")  # fmt: skip
def document_faults(spark: SparkSession, d: str) -> DataFrame:
    document = F.expr("""CASE s_suppkey % 4 WHEN 0 THEN '{"a":1,"b":2}' WHEN 1 THEN '{"a":1}' WHEN 2 THEN '{"c":0,"b":1,"a":2}' ELSE 'no object' END""")
    text = F.expr("CASE s_suppkey % 4 WHEN 1 THEN '\\t' WHEN 2 THEN 'x\\n' WHEN 3 THEN 'x' END")
    items = F.expr("CASE s_suppkey % 3 WHEN 0 THEN array('a', 'b', 'a') WHEN 1 THEN array('a', '') ELSE array('a', 'b') END")
    rows = table(spark, d, "supplier")
    return rows.select("s_suppkey", F.array_join(checks.key_faults(document, ["a", "b"]), ",").alias("keys"), checks.text_fault(text).alias("text"), checks.array_fault(items).alias("items"))


@query("class_colours", "SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'red' WHEN 2 THEN 'green' WHEN 3 THEN 'yellow' ELSE 'gray' END AS colour FROM customer")
def class_colours(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'Unclassified' WHEN 1 THEN 'Other' WHEN 2 THEN 'Condominium' WHEN 3 THEN 'Apartments' WHEN 4 THEN 'unheard of' END")
    return table(spark, d, "customer").select("c_custkey", checks.colour(name).alias("colour"))


@query("identity_and_position", duck("features", "SELECT id, id % 4 = 0 AS identity, NOT (id % 7 = 0 OR id % 11 = 0) AS position FROM features"))
def identity_and_position(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE id % 4 WHEN 0 THEN concat('\\t', id) WHEN 1 THEN ' ' WHEN 2 THEN '\\t\\n\\u00a0' END")
    x, y = F.expr("CASE WHEN id % 7 = 0 THEN 181 ELSE min_x END"), F.expr("CASE WHEN id % 11 = 0 THEN double('NaN') ELSE min_y END")
    return features(spark, d).select("id", checks.is_identity(text).alias("identity"), checks.is_position(x, y).alias("position"))


@query("strict_places", duck("features", "SELECT id, CAST(least(greatest(trunc((min_x + 89e0) / (-87e0 + 89e0) * 65535e0), 0), 65535) AS BIGINT) AS place FROM features"))
def strict_places(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("id", spatial.quantize_strict("min_x", F.lit(-89.0), F.lit(-87.0)).alias("place"))


VIEW = "min_x - (max_x - min_x) * 5e-2 AS hx, -max_y - (max_y - min_y) * 5e-2 AS hy, max_x - min_x + 2 * ((max_x - min_x) * 5e-2) AS hw, max_y - min_y + 2 * ((max_y - min_y) * 5e-2) AS hh"


@query("view_boxes", duck("features", f"""SELECT id, round((min_x + max_x) / 2e0, 9) AS centre_x, round(hx + 100e0 / 800e0 * hw, 9) AS world_x, round(-(hy + 50e0 / 600e0 * hh), 9) AS world_y, round(hx - 20e0 / 800e0 * hw, 9) AS panned_x,
round(hx + 5e-1 * (hw - hw / 4096e0), 9) AS zoomed_x, round(hw / 4096e0, 12) AS zoomed_width, round(least(800e0 / ((max_x - min_x) * 11e-1), 600e0 / ((max_y - min_y) * 11e-1)), 3) AS scale FROM (SELECT *, {VIEW} FROM features)"""))  # fmt: skip
def view_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = ("min_x", "min_y", "max_x", "max_y")
    rows = features(spark, d).withColumn("home", spatial.home_box(*box))
    home = F.col("home")
    world, closer = spatial.to_world(home, F.lit(100.0), F.lit(50.0), 800.0, 600.0), spatial.zoomed(home, home, F.lit(1e-5), F.lit(0.5), F.lit(0.5))
    seen = spatial.overview(*box, 800.0, 600.0)
    return rows.select(
        "id", F.round(seen["x"], 9).alias("centre_x"), F.round(world["x"], 9).alias("world_x"), F.round(world["y"], 9).alias("world_y"), F.round(spatial.panned(home, F.lit(20.0), F.lit(0.0), 800.0, 600.0)["x"], 9).alias("panned_x"),
        F.round(closer["x"], 9).alias("zoomed_x"), F.round(closer["width"], 12).alias("zoomed_width"), F.round(seen["scale"], 3).alias("scale"),
    )


@query("ring_counts", duck("features", "SELECT id, CAST(1 AS BIGINT) AS exteriors, CAST(id % 3 AS BIGINT) AS holes FROM features"))
def ring_counts(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with 0 to 2 holes."""
    ring = F.col("parts")[0][0]
    rows = polygons(spark, d).withColumn("parts", F.array(F.concat(F.array(ring), F.array_repeat(ring, F.expr("CAST(id % 3 AS INT)")))))
    return rows.select("id", F.size(geometry.exteriors("parts")).cast("long").alias("exteriors"), geometry.n_holes("parts").cast("long").alias("holes"))
