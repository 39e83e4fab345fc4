"""Queries on event sequences, versions, graphs, violations, sets and texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import graph, intervals, matching, versions
from terrane.plans.survey import table

ORACLE: dict[str, str] = {}


def q23_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites within 60 of one another, transitively."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 6151 % 1000).cast("double").alias("x"), (F.col("s_suppkey") * 3571 % 997).cast("double").alias("y"))
    from terrane.operators import spatial

    other = s.select(F.col("s_suppkey").alias("o"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    d = F.sqrt((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")))
    near = spatial.distance_join(s, other, 60.0, ("x", "y"), ("sx", "sy", "sx", "sy"), d).select("s_suppkey", "o")  # each with itself too
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp())
    return graph.components(near, "s_suppkey", "o")


ORACLE["q23_components"] = """WITH RECURSIVE s AS (SELECT s_suppkey AS k, CAST(s_suppkey * 6151 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 3571 % 997 AS DOUBLE) AS y FROM supplier),
e AS (SELECT a.k AS u, b.k AS v FROM s a JOIN s b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60), r AS (SELECT k AS node, k AS c FROM s UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node) SELECT node, min(c) AS component FROM r GROUP BY node"""


def q29_moving_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return e.select("event_id", F.round(intervals.moving_mean("value", ["user_id"], ["ts", "event_id"], 2, 2), 6).alias("mean5"), F.round(intervals.moving_mean("value", ["user_id"], ["ts", "event_id"], 3, 2), 6).alias("mean6"))


ORACLE["q29_moving_window"] = """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS mean6 FROM events"""


def q30_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of two or more values above 40, by user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    found = intervals.runs(e, ["user_id"], ["ts", "event_id"], F.col("value") > 40, 2)
    return found.select("user_id", "run", "n", "first_ts", "last_ts")


ORACLE["q30_runs"] = """WITH o AS (SELECT *, value > 40 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), k AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, f ORDER BY ts, event_id) AS g FROM o),
r AS (SELECT user_id, g, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(i) AS s FROM k WHERE f GROUP BY user_id, g HAVING count(*) >= 2) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s) AS run, n, first_ts, last_ts FROM r"""


def q31_sessions_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six active days of each user, with the day's events and the state that its last event leaves."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type", "value")
    days = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.round(F.sum("value"), 3).alias("value"))
    w = Window.partitionBy("user_id")
    out = days.withColumn("_r", F.row_number().over(w.orderBy(F.desc("day")))).withColumn("before", F.coalesce(F.lag("state").over(w.orderBy("day")), F.lit("")))
    return out.where("_r <= 6").select("user_id", F.col("day").cast("string").alias("day"), "n", "before", "state", "value")


ORACLE["q31_sessions_state"] = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, arg_max(event_type, (ts, event_id)) AS state, round(sum(value), 3) AS value FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY day), '') AS before FROM d) SELECT user_id, CAST(day AS VARCHAR) AS day, n, before, state, value FROM r WHERE r <= 6"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of orders' row counts: even lines, and all but the last lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    side = lambda f: lines.where(f).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("length"))
    return side("l_linenumber % 2 = 0"), side("l_linenumber < 6 AND l_orderkey % 7 <> 0")


def q32_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return versions.diff(old, new, "l_orderkey", "n", "length", 10.0)


ORACLE["q32_version_diff"] = """WITH a AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS l FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS l FROM lineitem WHERE l_linenumber < 6 AND l_orderkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, coalesce(b.l, 0) - coalesce(a.l, 0) AS length_change,
CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n AND abs(b.l - a.l) <= 10 THEN 'same' WHEN a.n = b.n THEN 'moved' WHEN b.n > a.n THEN 'more' ELSE 'fewer' END AS action FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey"""


def q33_veto_anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines returned and none that wait: kept; with an anti join and a semi join."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    on = lambda f: (lines.where(f).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return orders.join(*on("l_returnflag = 'R'"), "left_semi").join(*on("l_linestatus = 'O' AND l_returnflag = 'N'"), "left_anti")


ORACLE["q33_veto_anti_semi"] = """SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_returnflag = 'N')"""


def q34_export_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that overlap: of each conversation's turns by role the version with most text, the first of equals."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").alias("size"))
    return versions.keep_largest(c, ["conv_id", "role"], "size", "turn").select("conv_id", "role", "turn", "size")


ORACLE["q34_export_merge"] = """WITH r AS (SELECT conv_id, role, turn, CAST(length(text) AS INTEGER) AS size, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS r FROM conversations) SELECT conv_id, role, turn, size FROM r WHERE r = 1"""

_RULES = {"supplier": (("s_acctbal < 0", "negative balance"), ("s_suppkey % 10 = 3", "bad number")), "part": (("p_size > 45", "too large"), ("p_retailprice > 1900", "too dear"), ("p_brand NOT LIKE 'Brand#%'", "bad brand")), "customer": (("c_acctbal < 0", "negative balance"), ("c_mktsegment = ''", "no segment"))}
_KEYS = {"supplier": "s_suppkey", "part": "p_partkey", "customer": "c_custkey"}


def q35_dq_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long table of violations, from all rules over all tables."""
    out = None
    for name, rules in _RULES.items():
        found = versions.violations(table(spark, sf_dir, name), _KEYS[name], rules).withColumn("source", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


ORACLE["q35_dq_attributes"] = " UNION ALL ".join(f"SELECT {_KEYS[n]} AS object, '{what}' AS violation, '{n}' AS source FROM {n} WHERE {rule}" for n, rules in _RULES.items() for rule, what in rules)


def q38_dijkstra_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest ways over a grid with walls, a cell for each part, from four of them to the sites' cells (tested against relaxation)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    side = max(2, int(part.count() ** 0.5))
    cells = part.select(F.floor(F.col("k") / side).alias("r"), (F.col("k") % side).alias("c"))
    wall, core = (F.col("r") % 5 == 3) & (F.col("c") % 7 != 2), F.col("c") % 4 == 0
    edges = graph.grid_edges(cells.withColumn("cost", graph.cost_of(wall, core, F.lit(True))))
    edges = edges.select((F.col("r") * side + F.col("c")).alias("a"), (F.col("r2") * side + F.col("c2")).alias("b"), "w")
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")).distinct()
    sources = sites.where("node % 25 = 1").orderBy("node").limit(4)  # four places to start from are what is asked
    return graph.distance_table(edges, sources, sites, 1500.0).select("src", "dst", F.round("d", 6).alias("d"))


def q39_tsp_2opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tour through each nation's sites (tested against all permutations of small ones)."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 6151 % 1000).cast("double").alias("x"), (F.col("s_suppkey") * 3571 % 997).cast("double").alias("y"))
    return graph.tours(s, "s_nationkey", "s_suppkey", "x", "y").withColumn("leg", F.round("leg", 6))


def q41_json_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties out of JSON, and features back into it."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("event_type").alias("kind"), k.alias("k")).alias("properties")))
    return e.select("event_id", k.alias("k"), feature.alias("feature"))


ORACLE["q41_json_features"] = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"type":"Feature","properties":{"kind":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}}' AS feature FROM events"""


def q42_score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two sides, their scores, accuracy and F1 of an attribute, and one weighted mark."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").when(F.col("l_quantity") > 2, "R")
    marks = matching.macro_f1(lines.withColumn("guess", guess), "l_returnflag", "guess")
    pred, ref = F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 2 == 1
    side = lines.agg(F.count_if(pred).alias("n_pred"), F.count_if(ref).alias("n_ref"), F.sum(F.when(pred, F.col("l_quantity"))).alias("_lp"), F.sum(F.when(ref, F.col("l_quantity"))).alias("_lr"))
    both = side.join(marks)  # one row each
    count, length = S.count_score(F.col("n_pred"), F.col("n_ref"), 0.5), S.count_score(F.col("_lp"), F.col("_lr"), 0.5)
    return both.select("n_pred", "n_ref", F.round(count, 6).alias("count_score"), F.round(length, 6).alias("length_score"), F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), F.round(0.3 * count + 0.2 * length + 0.25 * F.col("accuracy") + 0.25 * F.col("macro_f1"), 5).alias("score"))


ORACLE["q42_score_card"] = """WITH g AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' WHEN l_quantity > 2 THEN 'R' END AS p, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT DISTINCT t AS c FROM g), f AS (SELECT c, (SELECT coalesce(sum(n), 0) FROM g WHERE t = c AND p = c) AS tp, (SELECT coalesce(sum(n), 0) FROM g WHERE t = c) AS tt, (SELECT coalesce(sum(n), 0) FROM g WHERE p = c) AS pp FROM c),
m AS (SELECT sum(tp) / sum(tt) AS accuracy, avg(2 * tp / (tt + pp)) AS macro_f1 FROM f),
s AS (SELECT count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS n_pred, count(CASE WHEN l_linenumber % 2 = 1 THEN 1 END) AS n_ref, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS lp, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS lr FROM lineitem),
k AS (SELECT *, greatest(0, 1 - abs(n_pred - n_ref) / n_ref / 0.5) AS cs, greatest(0, 1 - abs(lp - lr) / lr / 0.5) AS ls FROM s, m)
SELECT n_pred, n_ref, round(CAST(cs AS DOUBLE), 6) AS count_score, round(CAST(ls AS DOUBLE), 6) AS length_score, round(CAST(accuracy AS DOUBLE), 6) AS accuracy, round(CAST(macro_f1 AS DOUBLE), 6) AS macro_f1, round(CAST(0.3 * cs + 0.2 * ls + 0.25 * accuracy + 0.25 * macro_f1 AS DOUBLE), 5) AS score FROM k"""


def q43_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by what they have: union, intersection, differences and duplicates of key sets."""
    keys = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("k"))
    n, s, c = keys("nation", "n_nationkey"), keys("supplier", "s_nationkey"), keys("customer", "c_nationkey")
    named = lambda df, what: df.select(F.lit(what).alias("what"), F.col("k").cast("long").alias("k"))
    parts = (named(n.union(s).union(c).distinct(), "union"), named(s.intersect(c), "both"), named(n.exceptAll(s.distinct()), "no supplier"), named(s.groupBy("k").count().where("count > 4").select("k"), "many"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ORACLE["q43_set_ops"] = """SELECT 'union' AS what, CAST(k AS BIGINT) AS k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'both', k FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer)
UNION ALL SELECT 'no supplier', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'many', s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) > 4"""


def q44_topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred by a capped product of size, price and kind."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    score = F.least(F.col("p_size") / 20, F.lit(1.5)) * F.least(F.col("p_retailprice") / 1500, F.lit(1.0)) * F.when(F.col("p_size") % 3 == 0, 1.2).otherwise(1.0)
    return p.select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(100)


ORACLE["q44_topk_candidates"] = """SELECT p_partkey, round(CAST(least(p_size / 20, 1.5) * least(p_retailprice / 1500, 1.0) * CASE WHEN p_size % 3 = 0 THEN 1.2 ELSE 1.0 END AS DOUBLE), 6) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 100"""


def q45_text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string functions of names, labels and keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    c = F.col
    return p.select(
        "p_partkey", F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"), F.lpad(c("p_partkey").cast("string"), 8, "0").alias("padded"), F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_").alias("safe"), F.upper("p_type").alias("upper"), F.trim(F.regexp_replace("p_name", "\\s+", " ")).alias("spaced"),
        F.md5(F.concat_ws("|", "p_name", "p_brand")).alias("digest"), F.element_at(F.split("p_name", " "), -1).alias("last"), F.translate("p_name", "aeiou", "äëïöü").alias("marked"), F.exists(F.array(F.lit("brass"), F.lit("steel")), lambda k: F.contains(F.lower("p_type"), k)).alias("metal"),
        F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("escaped"), F.startswith("p_brand", F.lit("Brand#1")).alias("first_brand"),
    )


ORACLE["q45_text_scalars"] = """SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS safe, upper(p_type) AS upper, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS spaced, md5(p_name || '|' || p_brand) AS digest,
string_split(p_name, ' ')[-1] AS last, translate(p_name, 'aeiou', 'äëïöü') AS marked, contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel') AS metal, replace(replace(p_name, '&', '&amp;'), '<', '&lt;') AS escaped, starts_with(p_brand, 'Brand#1') AS first_brand FROM part"""

QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}
