"""Queries on releases, identities and the classification log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.functions import checks
from geolith.operators import diff, history, reconcile, release
from geolith.plans.frames import accepted, actions, candidate, duck, features, table
from geolith.plans.registry import query

# Joins.


@query("release_trace", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def release_trace(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return release.trace(orders, (customer, "c_custkey"), (nation, "n_nationkey"), (table(spark, d, "region"), "r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("confirmed_left_join", "SELECT o_orderkey, count(l_linestatus) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F' GROUP BY o_orderkey")
def confirmed_left_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    rows = release.left_confirmed(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "l_linestatus", "F")
    return rows.groupBy("o_orderkey").agg(F.count("l_linestatus").alias("n"))


@query("orphan_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_anti(spark: SparkSession, d: str) -> DataFrame:
    return release.without(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("having_zero_anti", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) = 0")
def having_zero_anti(spark: SparkSession, d: str) -> DataFrame:
    return release.without(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


LINKED = """WITH l AS (SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS predecessor FROM events)
SELECT l.event_id, coalesce(p.event_type, '') AS predecessor_name, coalesce(r.event_type, '') AS reverses_name
FROM l LEFT JOIN events p ON p.event_id = l.predecessor LEFT JOIN events r ON r.event_id = l.predecessor AND l.event_type = 'purchase'"""


@query("event_self_join", LINKED)
def event_self_join(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    log = table(spark, d, "events").select("event_id", "event_type", before.alias("predecessor"))
    log = log.withColumn("reverses", F.when(F.col("event_type") == "purchase", F.col("predecessor")))
    return release.log_links(log, "event_id", "predecessor", "reverses", "event_type").select("event_id", "predecessor_name", "reverses_name")


@query("match_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def match_semi(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return release.matching(table(spark, d, "orders").select("o_orderkey"), returned, "o_orderkey")


DIFF = """SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
  WHEN a.geometry_sha256 = b.geometry_sha256 AND a.attributes_sha256 = b.attributes_sha256 THEN 'unchanged'
  WHEN a.attributes_sha256 = b.attributes_sha256 THEN 'geometry_changed' WHEN a.geometry_sha256 = b.geometry_sha256 THEN 'attributes_changed'
  ELSE 'both_changed' END AS category FROM accepted a FULL JOIN candidate b USING (id)"""


@query("feature_diff", duck("accepted candidate", DIFF))
def feature_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.feature_diff(accepted(spark, d), candidate(spark, d), "id")


@query("feature_diff_counts", duck("accepted candidate", f"SELECT category, count(*) AS n FROM ({DIFF}) GROUP BY category"))
def feature_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return feature_diff(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query("feature_diff_digest", duck("accepted candidate", f"SELECT category, id // 1000 AS range, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids_sha256 FROM ({DIFF}) GROUP BY ALL"))
def feature_diff_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digests for ranges of 1000 identities, so that no group grows with the release."""
    rows = feature_diff(spark, d).withColumn("range", F.expr("id div 1000"))
    return diff.bucketed_digest(rows, ["category", "range"], "id")


LAYER = "CASE id % 3 WHEN 0 THEN 'roads' WHEN 1 THEN 'water' ELSE 'buildings' END"


@query("layer_comparison", duck("accepted candidate", f"SELECT {LAYER} AS layer, category, count(*) AS n FROM ({DIFF}) GROUP BY ALL"))
def layer_comparison(spark: SparkSession, d: str) -> DataFrame:
    layer = F.expr(LAYER).alias("layer")
    return feature_diff(spark, d).groupBy(layer, "category").agg(F.count("*").alias("n"))


@query("geometry_replacement", duck("accepted candidate", """WITH o AS (SELECT geometry_sha256, count(*) AS n, min(id) AS old_id FROM accepted WHERE id NOT IN (SELECT id FROM candidate) GROUP BY 1),
n AS (SELECT geometry_sha256, count(*) AS n, min(id) AS new_id FROM candidate WHERE id NOT IN (SELECT id FROM accepted) GROUP BY 1)
SELECT old_id, new_id FROM o JOIN n USING (geometry_sha256) WHERE o.n = 1 AND n.n = 1"""))  # fmt: skip
def geometry_replacement(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.replacements(accepted(spark, d), candidate(spark, d), "id")


STATUS = "CASE WHEN id % 31 = 0 THEN 'retired' WHEN id % 29 = 0 THEN 'inactive' ELSE 'active' END"


@query("key_continuation", duck("accepted candidate", f"SELECT id, CASE {STATUS} WHEN 'retired' THEN 'error' WHEN 'inactive' THEN 'reappearance' ELSE 'continuation' END AS action FROM accepted JOIN candidate USING (id)"))
def key_continuation(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.continuations(accepted(spark, d).withColumn("identity_status", F.expr(STATUS)), candidate(spark, d), "id")


LABELLED = "SELECT doc_id, CASE max(quality) WHEN 1 THEN 'residential' ELSE 'commercial' END AS classification FROM labels GROUP BY doc_id"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.max("quality") == 1, "residential").otherwise("commercial")
    return table(spark, d, "labels").groupBy("doc_id").agg(value.alias("classification"))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id")


@query("class_lookup_default", f"SELECT doc_id, coalesce(classification, 'unclassified') AS classification FROM documents LEFT JOIN ({LABELLED}) USING (doc_id)")
def class_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    return history.with_class(_ids(spark, d), _labelled(spark, d), "doc_id")


@query("snapshot_filter", f"SELECT classification, count(*) FILTER (s.doc_id IS NOT NULL) AS rendered, count(*) FILTER (s.doc_id IS NULL) AS not_rendered FROM ({LABELLED}) c LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) s USING (doc_id) GROUP BY 1")
def snapshot_filter(spark: SparkSession, d: str) -> DataFrame:
    return history.snapshot_counts(_labelled(spark, d), _ids(spark, d).where("doc_id % 3 <> 0"), "doc_id")


@query("page_missing_extra", """WITH a AS (SELECT DISTINCT page_id FROM pages WHERE page_id % 9 <> 0), b AS (SELECT DISTINCT page_id FROM pages WHERE page_id % 7 <> 0)
SELECT page_id, 'missing' AS kind FROM a WHERE page_id NOT IN (SELECT page_id FROM b) UNION ALL SELECT page_id, 'extra' FROM b WHERE page_id NOT IN (SELECT page_id FROM a)""")  # fmt: skip
def page_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id")
    return diff.missing_and_extra(pages.where("page_id % 9 <> 0"), pages.where("page_id % 7 <> 0"), ["page_id"])


@query("version_compat", duck("accepted candidate", "SELECT id, geometry_sha256, attributes_sha256 FROM candidate EXCEPT SELECT id, geometry_sha256, attributes_sha256 FROM accepted"))
def version_compat(spark: SparkSession, d: str) -> DataFrame:
    return release.incompatible(candidate(spark, d), accepted(spark, d), ["id", "geometry_sha256", "attributes_sha256"])


# Aggregations.


@query("release_completeness", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_linenumber) AS n_ordinals, min(l_linenumber) AS first_ordinal, max(l_linenumber) AS last_ordinal, count(DISTINCT l_suppkey) AS n_files FROM lineitem GROUP BY 1, 2")
def release_completeness(spark: SparkSession, d: str) -> DataFrame:
    return release.completeness(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber", "l_suppkey")


@query("class_distribution", f"SELECT coalesce(classification, 'unclassified') AS classification, count(*) AS n FROM documents LEFT JOIN ({LABELLED}) USING (doc_id) GROUP BY 1")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return history.class_distribution(_ids(spark, d), _labelled(spark, d), "doc_id")


@query("kind_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("relationship_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def relationship_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("conditional_distinct", "SELECT l_linestatus, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS n FROM lineitem GROUP BY 1")
def conditional_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("n"))


@query("cardinality_check", "SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY 1 HAVING count(*) <> 1 OR min(l_linenumber) <> 1")
def cardinality_check(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"))
    return stats.where("n <> 1 OR first <> 1")


@query("having_anomaly", "SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS status FROM orders GROUP BY 1 HAVING count(*) <> 1 OR max(o_orderstatus) <> 'F'")
def having_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return release.anomalies(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "F")


@query("kind_totals", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
def kind_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").cast("long").alias("total"))


@query("inventory_compare", duck("accepted candidate", "SELECT id, 'added' AS side FROM candidate WHERE id NOT IN (SELECT id FROM accepted) UNION ALL SELECT id, 'removed' FROM accepted WHERE id NOT IN (SELECT id FROM candidate)"))
def inventory_compare(spark: SparkSession, d: str) -> DataFrame:
    return diff.inventory_compare(accepted(spark, d), candidate(spark, d), "id")


@query("status_rollup", """SELECT o_orderpriority, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) WHEN 1 THEN 'up_to_date' WHEN 2 THEN 'new' ELSE 'unexpected' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "up_to_date").when(F.col("o_orderstatus") == "O", "new").otherwise("unexpected")
    return diff.status_rollup(table(spark, d, "orders").select("o_orderpriority", status.alias("status")), ["o_orderpriority"])


@query("quantiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


# The log.


@query("latest_event", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


CHAIN = """WITH l AS (SELECT user_id, event_id, event_type, lag(event_id) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, CASE WHEN event_id % 25 <> 0 THEN before END AS predecessor, CASE WHEN event_id % 10 = 0 THEN 'x' ELSE coalesce(was, 'unclassified') END AS prev,
  CASE WHEN before IS NULL AND event_id % 2 = 0 THEN 'classification' ELSE 'correction' END AS kind FROM l)
SELECT user_id, event_id, 'predecessor' AS rule FROM g WHERE predecessor IS DISTINCT FROM before
UNION ALL SELECT user_id, event_id, 'previous_class' FROM g WHERE prev <> coalesce(was, 'unclassified')
UNION ALL SELECT user_id, event_id, 'first_kind' FROM g WHERE before IS NULL AND kind <> 'classification'
UNION ALL SELECT user_id, event_id, 'no_change' FROM g WHERE prev = event_type"""


@query("chain_audit", CHAIN)
def chain_audit(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    log = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("new_classification"), F.lag("event_id").over(w).alias("b"), F.lag("event_type").over(w).alias("was"))
    log = log.withColumns({
        "predecessor": F.when(F.expr("event_id % 25 <> 0"), F.col("b")), "previous_classification": F.when(F.expr("event_id % 10 = 0"), "x").otherwise(F.coalesce("was", F.lit("unclassified"))),
        "event_kind": F.when(F.expr("b IS NULL AND event_id % 2 = 0"), "classification").otherwise("correction"), "reverses": F.lit(None).cast("long"),
    })
    return history.chain_audit(log.drop("b", "was"), "user_id", "event_id")


@query("current_vs_log", """WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS logged FROM events GROUP BY 1), b AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'x' ELSE logged END AS stored FROM a WHERE user_id % 7 <> 0)
SELECT user_id, logged, stored FROM a FULL JOIN b USING (user_id) WHERE logged IS DISTINCT FROM stored""")  # fmt: skip
def current_vs_log(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("new_classification"))
    stored = history.current_of(log, "user_id", "event_id").where("user_id % 7 <> 0")
    stored = stored.withColumn("classification", F.when(F.expr("user_id % 5 = 0"), "x").otherwise(F.col("classification")))
    return history.current_audit(log, stored, "user_id", "event_id")


FOLD = """WITH RECURSIVE o AS (SELECT user_id, event_id, action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM actions),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS prev, 'unclassified' AS cur, CAST(0 AS BIGINT) AS changes, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS before, CAST(NULL AS VARCHAR) AS kind, false AS changed FROM o
  UNION ALL
  SELECT f.user_id, o.rn, CASE WHEN same THEN f.prev ELSE f.cur END, CASE WHEN same THEN f.cur WHEN o.action = 'undo' THEN f.prev ELSE o.action END,
    f.changes + CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN f.last ELSE o.event_id END, f.last,
    CASE WHEN o.action = 'undo' THEN 'undo' WHEN f.last IS NULL THEN 'classification' ELSE 'correction' END, NOT same
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1, LATERAL (SELECT CASE WHEN o.action = 'undo' THEN f.prev IS NULL ELSE o.action = f.cur END AS same))
"""


@query("class_fold", duck("actions", FOLD + "SELECT user_id, arg_max({'p': prev}, rn).p AS previous, arg_max(cur, rn) AS current, max(changes) AS changes FROM f GROUP BY 1"))
def class_fold(spark: SparkSession, d: str) -> DataFrame:
    return history.fold(actions(spark, d), "user_id", "event_id")


@query("classification_log", duck("actions", FOLD + "SELECT user_id, last AS event_id, prev AS previous_classification, cur AS new_classification, kind AS event_kind, before AS predecessor, CASE WHEN kind = 'undo' THEN before END AS reverses FROM f WHERE changed"))
def classification_log(spark: SparkSession, d: str) -> DataFrame:
    return history.events_of(actions(spark, d), "user_id", "event_id")


STATUS_OF_USER = "CASE user_id % 4 WHEN 0 THEN 'inactive' WHEN 1 THEN 'retired' ELSE 'active' END"


@query("refused_actions", duck("actions", f"SELECT user_id, event_id, action, CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE {STATUS_OF_USER} END AS reason FROM actions WHERE user_id % 7 = 0 OR {STATUS_OF_USER} <> 'active'"))
def refused_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions on identities that aren't active, or that nobody knows."""
    rows = actions(spark, d)
    identities = rows.select("user_id").distinct().where("user_id % 7 <> 0").withColumn("identity_status", F.expr(STATUS_OF_USER))
    return history.accepted_actions(rows, identities, "user_id")[1]


@query("active_fold", duck("actions", FOLD.replace("FROM actions)", f"FROM actions WHERE user_id % 7 <> 0 AND {STATUS_OF_USER} = 'active')") + "SELECT user_id, arg_max({'p': prev}, rn).p AS previous, arg_max(cur, rn) AS current, max(changes) AS changes FROM f GROUP BY 1"))
def active_fold(spark: SparkSession, d: str) -> DataFrame:
    """The state that the accepted actions leave."""
    rows = actions(spark, d)
    identities = rows.select("user_id").distinct().where("user_id % 7 <> 0").withColumn("identity_status", F.expr(STATUS_OF_USER))
    return history.fold(history.accepted_actions(rows, identities, "user_id")[0], "user_id", "event_id")


@query("idempotent_replay", """SELECT event_id, event_type, CAST(event_id * 10 AS BIGINT) AS at, CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS replays, event_id % 40 = 0 AND event_type <> 'x' AS conflict FROM events""")
def idempotent_replay(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") * 10).alias("at"))
    again = log.where("event_id % 20 = 0").select("event_id", F.when(F.expr("event_id % 40 = 0"), "x").otherwise(F.col("event_type")).alias("event_type"), (F.col("at") + 1).alias("at"))
    return history.replay(log.unionByName(again), "event_id", "at", ["event_type"])


@query("stale_writes", """WITH l AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS latest FROM events)
SELECT user_id, event_id, CAST(-1 AS BIGINT) AS expected, latest FROM l WHERE event_id % 9 = 0""")  # fmt: skip
def stale_writes(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    log = table(spark, d, "events").select("user_id", "event_id", before.alias("b"))
    log = log.select("user_id", "event_id", F.when(F.expr("event_id % 9 = 0"), F.lit(-1).cast("long")).otherwise(F.col("b")).alias("expected"))
    return history.stale(log, "user_id", "event_id", "expected")


@query("append_only", "SELECT event_id, event_type FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0")
def append_only(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("event_id", "event_type")
    later = log.where("event_id % 11 <> 0").withColumn("event_type", F.when(F.expr("event_id % 13 = 0"), "x").otherwise(F.col("event_type")))
    return history.append_only_faults(log, later, ["event_id", "event_type"])


@query("visibility_filter", f"SELECT doc_id, coalesce(classification, 'unclassified') AS classification FROM documents LEFT JOIN ({LABELLED}) USING (doc_id) WHERE coalesce(classification, 'unclassified') <> 'commercial'")
def visibility_filter(spark: SparkSession, d: str) -> DataFrame:
    return history.visible(_ids(spark, d), _labelled(spark, d), "doc_id", ["commercial"])


OVERLAY = """SELECT 'quality' AS overlay, coalesce(CASE l.quality WHEN 1 THEN 'residential' ELSE NULL END, 'unclassified') AS classification, count(*) AS n, CAST(sum(d.doc_id) AS BIGINT) AS base
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) GROUP BY ALL
UNION ALL SELECT 'toxic', coalesce(CASE l.toxic WHEN 1 THEN 'commercial' ELSE NULL END, 'unclassified'), count(*), CAST(sum(d.doc_id) AS BIGINT)
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) GROUP BY ALL"""


@query("overlay_independence", OVERLAY)
def overlay_independence(spark: SparkSession, d: str) -> DataFrame:
    """Counts by class under two overlays; the sums of the base table's identities add up to the same for both."""
    out = None
    for overlay, name in (("quality", "residential"), ("toxic", "commercial")):
        current = table(spark, d, "labels").groupBy("doc_id").agg(F.max(overlay).alias("v")).where("v = 1").select("doc_id", F.lit(name).alias("classification"))
        one = history.with_class(_ids(spark, d), current, "doc_id").groupBy("classification").agg(F.count("*").alias("n"), F.sum("doc_id").alias("base")).withColumn("overlay", F.lit(overlay))
        out = one if out is None else out.unionByName(one)
    return out


# Releases.


@query("release_transition", """WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'candidate' ELSE 'rejected' END AS before FROM orders),
c AS (SELECT o_custkey, max(o_orderkey) AS promoted FROM r WHERE before = 'candidate' GROUP BY 1)
SELECT r.o_custkey, r.o_orderkey, r.before, CASE WHEN before = 'accepted' AND promoted IS NOT NULL THEN 'superseded' WHEN before = 'candidate' AND o_orderkey = promoted THEN 'accepted' ELSE before END AS after,
  CASE WHEN before = 'accepted' THEN promoted END AS superseded_by FROM r LEFT JOIN c USING (o_custkey)""")  # fmt: skip
def release_transition(spark: SparkSession, d: str) -> DataFrame:
    lifecycle = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "candidate").otherwise("rejected")
    return release.transition(table(spark, d, "orders").select("o_custkey", "o_orderkey", lifecycle.alias("lifecycle")), "o_custkey", "o_orderkey")


@query("rollback", "SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'candidate' ELSE 'rejected' END AS lifecycle FROM orders")
def rollback(spark: SparkSession, d: str) -> DataFrame:
    return release.rolled_back(release_transition(spark, d), "o_custkey", "o_orderkey")


@query("source_change", """WITH a AS (SELECT s_suppkey, s_suppkey % 7 AS c, s_nationkey AS i, s_suppkey % 5 AS e FROM supplier),
l AS (SELECT s_suppkey, c + CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS c, i + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS i, e + CASE s_suppkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS e FROM a WHERE s_suppkey % 11 <> 0)
SELECT s_suppkey, CASE WHEN l.c IS NULL THEN 'unavailable' WHEN l.e < a.e THEN 'unexpected' WHEN l.c <> a.c OR l.i <> a.i OR l.e > a.e THEN 'new' ELSE 'up_to_date' END AS status FROM a LEFT JOIN l USING (s_suppkey)""")  # fmt: skip
def source_change(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 7 AS object_count", "s_nationkey AS inventory_sha256", "s_suppkey % 5 AS edited_at")
    live = a.where("s_suppkey % 11 <> 0").selectExpr(
        "s_suppkey", "object_count + CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS object_count", "inventory_sha256 + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS inventory_sha256",
        "edited_at + CASE s_suppkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS edited_at",
    )
    return diff.source_change(a, live, "s_suppkey")


@query("violations", """SELECT l_orderkey, l_linenumber, 'quantity' AS rule FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, l_linenumber, 'discount' FROM lineitem WHERE l_discount > 85e-3
UNION ALL SELECT l_orderkey, l_linenumber, 'state' FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'""")  # fmt: skip
def violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.085, "state": (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")}
    return release.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], rules)


@query("duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return release.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("foreign_keys", """SELECT 'orders' AS rule, o_orderkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3)""")  # fmt: skip
def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    custom = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    nation = table(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("s_nationkey"))
    orders = release.without(table(spark, d, "orders"), custom, "o_custkey").select(F.lit("orders").alias("rule"), F.col("o_orderkey").alias("key"))
    return orders.unionByName(release.without(table(spark, d, "supplier"), nation, "s_nationkey").select(F.lit("supplier").alias("rule"), F.col("s_suppkey").alias("key")))


# Sets.


@query("set_common", duck("accepted candidate", "SELECT id FROM accepted INTERSECT SELECT id FROM candidate"))
def set_common(spark: SparkSession, d: str) -> DataFrame:
    return accepted(spark, d).select("id").intersect(candidate(spark, d).select("id"))


@query("set_added", duck("accepted candidate", "SELECT id FROM candidate EXCEPT SELECT id FROM accepted"))
def set_added(spark: SparkSession, d: str) -> DataFrame:
    return candidate(spark, d).select("id").subtract(accepted(spark, d).select("id"))


@query("set_removed", duck("accepted candidate", "SELECT id FROM accepted EXCEPT SELECT id FROM candidate"))
def set_removed(spark: SparkSession, d: str) -> DataFrame:
    return accepted(spark, d).select("id").subtract(candidate(spark, d).select("id"))


@query("set_union_count", duck("accepted candidate", "SELECT count(*) AS n FROM (SELECT id FROM accepted UNION SELECT id FROM candidate)"))
def set_union_count(spark: SparkSession, d: str) -> DataFrame:
    return accepted(spark, d).select("id").union(candidate(spark, d).select("id")).distinct().agg(F.count("*").alias("n"))


@query("layer_union", "SELECT 'part' AS layer, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer")
def layer_union(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, c: table(spark, d, name).select(F.lit(name).alias("layer"), F.col(f"{c}key").alias("id"), F.col(f"{c[:2]}name").alias("name"))
    return one("part", "p_part").unionByName(one("supplier", "s_supp")).unionByName(one("customer", "c_cust"))


@query("distinct_types", duck("features", "SELECT DISTINCT kind, brand FROM features"))
def distinct_types(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("kind", "brand").distinct()


# Scalars and predicates.


@query("deterministic_key", """SELECT c_custkey, 'kcb-' || sha256('{"algorithm":"initial-v1","release_key":"release-' || c_nationkey || '","source_feature_id":"' || c_custkey || '"}') AS project_key FROM customer""")
def deterministic_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", checks.project_key("initial-v1", F.concat(F.lit("release-"), F.col("c_nationkey").cast("string")), "c_custkey").alias("project_key"))


@query("release_keys", "SELECT o_orderkey, 'layer-candidate-' || CASE WHEN o_orderstatus = 'P' THEN 'undated' ELSE strftime(o_orderdate, '%Y%m%d') END || '-' || sha256(CAST(o_orderkey AS VARCHAR))[:12] AS release_key FROM orders")
def release_keys(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", checks.release_key("layer", day, F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("release_key"))


@query("json_fallback", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("first", F.when(F.expr("event_id % 2 = 0"), "{}").otherwise(F.col("props")))
    return rows.select("event_id", checks.first_field("k", "first", "props").alias("k"))


@query("pattern_checks", """SELECT c_custkey, regexp_full_match(replace(lower(c_name), '#', '-') || CASE WHEN c_custkey % 4 = 0 THEN chr(10) ELSE '' END, '[a-z0-9]+(-[a-z0-9]+)*') AS slug,
  regexp_full_match(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN sha256(c_name) || chr(10) ELSE sha256(c_name) END, '[0-9a-f]{64}') AS digest FROM customer""")
def pattern_checks(spark: SparkSession, d: str) -> DataFrame:
    """Some have a newline at their end."""
    digest = F.when(F.expr("c_custkey % 3 = 0"), F.col("c_name")).when(F.expr("c_custkey % 5 = 0"), F.concat(F.sha2("c_name", 256), F.lit("\n"))).otherwise(F.sha2("c_name", 256))
    slug = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.when(F.expr("c_custkey % 4 = 0"), "\n").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", checks.matches(slug, checks.SLUG).alias("slug"), checks.matches(digest, checks.SHA256).alias("digest"))


@query("datetime_checks", "SELECT event_id, event_id % 7 <> 0 AND event_id % 5 <> 0 AS ok FROM events")
def datetime_checks(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.when(F.expr("event_id % 7 = 0"), F.lit("2024-02-30T00:00:00.000Z")).when(F.expr("event_id % 5 = 0"), F.substring(text, 1, 19)).otherwise(text)
    return table(spark, d, "events").select("event_id", checks.is_timestamp(text).alias("ok"))


@query("object_id_checks", "SELECT event_id, CASE WHEN event_id % 3 = 1 AND event_id > 0 THEN NULL ELSE event_id END AS object_id FROM events")
def object_id_checks(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("event_id").cast("string")
    text = F.when(F.expr("event_id % 3 = 1 AND event_id > 0"), F.concat(F.lit("0"), number)).when(F.expr("event_id % 3 = 2"), F.concat(F.lit(" "), number, F.lit(" "))).otherwise(number)
    return table(spark, d, "events").select("event_id", checks.object_id(text).alias("object_id"))
