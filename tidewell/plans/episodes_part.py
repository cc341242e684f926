"""Queries over episodes, joins, segments and windows. The stand-ins for the engine's entities are named in each function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import blocks, joins, quality, reports, segments
from tidewell.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL twin."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def episode_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as episodes of 8 frames x 8 dimensions; the action is the next vector of the same label."""
    nxt = F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, folder, "embeddings").withColumn("next", nxt).where("next IS NOT NULL")
    at = F.sequence(F.lit(0), F.lit(7))
    rows = rows.select(F.col("vec_id").alias("episode"), F.posexplode(F.transform(at, lambda i: F.struct(F.slice("embedding", i * 8 + 1, F.lit(8)).alias("state"), F.slice("next", i * 8 + 1, F.lit(8)).alias("action")))).alias("frame", "v"))
    return rows.select("episode", "frame", "v.state", "v.action")


_L2 = """
WITH e AS (SELECT vec_id, embedding AS s, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings),
c AS (SELECT vec_id AS episode, p // 8 AS frame, p % 8 AS dim, CAST(s[p + 1] AS DOUBLE) AS s, CAST(a[p + 1] AS DOUBLE) AS a
      FROM e, range(64) r(p) WHERE a IS NOT NULL),
d AS (SELECT episode, dim, least(min(s), min(a)) AS lo, greatest(max(s), max(a)) AS hi, stddev_pop(s) AS ds, stddev_pop(a) AS da, count(*) AS n FROM c GROUP BY ALL),
w AS (SELECT episode, max(n) AS n_frames, bool_and(ds < 1e-3) AS ss, bool_and(da < 1e-3) AS sa FROM d GROUP BY episode),
f AS (SELECT c.episode, frame, sqrt(sum(((s - a) / (hi - lo)) ** 2)) AS g FROM c JOIN d ON c.episode = d.episode AND c.dim = d.dim
      WHERE hi - lo >= 0.05 AND NOT (ds < 1e-3 AND da < 1e-3) GROUP BY ALL),
g AS (SELECT episode, avg(g) AS m FROM f GROUP BY episode),
l2 AS (SELECT w.episode, n_frames, CASE WHEN n_frames < 2 THEN NULL WHEN ss AND sa THEN 0.0 WHEN ss <> sa THEN CAST('inf' AS DOUBLE) ELSE coalesce(m, 0.0) END AS l2_score
       FROM w LEFT JOIN g USING (episode))
"""


@query(_L2 + "SELECT episode, n_frames, round(l2_score, 6) AS l2_score FROM l2")
def l2_score(spark: SparkSession, folder: str) -> DataFrame:
    return quality.l2_scores(episode_frames(spark, folder)).withColumn("l2_score", F.round("l2_score", 6))


@query(_L2 + "SELECT episode, round(l2_score, 6) AS l2_score, CASE WHEN l2_score IS NULL THEN 'no_valid_frames' WHEN l2_score > 1.0 THEN 'l2_above_threshold' END AS reason FROM l2")
def l2_flag(spark: SparkSession, folder: str) -> DataFrame:
    scores = quality.l2_scores(episode_frames(spark, folder))
    return scores.select("episode", F.round("l2_score", 6).alias("l2_score"), quality.l2_reason(F.col("l2_score"), F.lit(1.0)).alias("reason"))


@query(_L2 + """SELECT count(l2_score) AS n, CAST(0 AS BIGINT) AS n_inf, round(avg(l2_score), 6) AS mean, round(median(l2_score), 6) AS median, round(stddev_pop(l2_score), 6) AS std,
 round(min(l2_score), 6) AS min, round(max(l2_score), 6) AS max, round(quantile_cont(l2_score, 0.9), 6) AS p90, round(quantile_cont(l2_score, 0.95), 6) AS p95, round(quantile_cont(l2_score, 0.99), 6) AS p99 FROM l2""")
def l2_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.distribution(quality.l2_scores(episode_frames(spark, folder)), "l2_score")
    return out.select("n", "n_inf", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(_L2.rsplit(",\nf AS", 1)[0] + """ SELECT episode, CAST(frame AS INTEGER) AS frame, CAST(dim AS INTEGER) AS dim, round(CASE WHEN ok THEN (s - lo) / (hi - lo) ELSE s END, 6) AS state, round(CASE WHEN ok THEN (a - lo) / (hi - lo) ELSE a END, 6) AS action
FROM (SELECT c.*, lo, hi, n >= 2 AND hi - lo >= 0.05 AND NOT (ds < 1e-3 AND da < 1e-3) AS ok FROM c JOIN d USING (episode, dim))""")
def normalised_series(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.normalised_series(episode_frames(spark, folder))
    return out.select("episode", "frame", "dim", F.round("state", 6).alias("state"), F.round("action", 6).alias("action"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_returnflag || '/' || l_linestatus AS state FROM lineitem WHERE l_quantity >= 10")
def scan_projection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where("l_quantity >= 10").select("l_orderkey", "l_linenumber", F.round(F.expr("l_extendedprice * (1 - l_discount)"), 4).alias("net"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("state"))


def _order_lengths(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("length"))
    orders = table(spark, folder, "orders")
    return orders.join(n, orders.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.col("o_orderpriority").alias("dataset"), F.coalesce("length", F.lit(0)).alias("length"))


_LIMITS = {"1-URGENT": (3, 1.0), "2-HIGH": (4, 0.5), "3-MEDIUM": (None, None), "4-NOT SPECIFIED": (2, 0.3)}
_LIMITS_SQL = "lim(dataset, min_frames, threshold) AS (VALUES ('1-URGENT', 3, 1.0), ('2-HIGH', 4, 0.5), ('3-MEDIUM', NULL, NULL), ('4-NOT SPECIFIED', 2, 0.3))"
_LENGTHS_SQL = "len AS (SELECT o_orderkey, o_orderpriority AS dataset, count(l_orderkey) AS length FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


@query(f"WITH {_LIMITS_SQL}, {_LENGTHS_SQL} SELECT o_orderkey, dataset, length, CASE WHEN lim.dataset IS NULL THEN 0.2 ELSE threshold END::DOUBLE AS threshold FROM len LEFT JOIN lim USING (dataset) WHERE length < min_frames")
def min_frame_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as episodes, their lines as frames, priorities as datasets."""
    rows = quality.with_limits(_order_lengths(spark, folder), quality.limits_table(spark, _LIMITS))
    return rows.where(quality.too_short(F.col("length"), F.col("min_frames"))).select("o_orderkey", "dataset", "length", "threshold")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, bool_and(trim(text) = '' OR length(text) < 40) AS is_empty FROM conversations GROUP BY conv_id")
def empty_task_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as task texts; those under 40 characters count as blank here, so that both outcomes occur."""
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.collect_list(F.when(F.length("text") < 40, "").otherwise(F.col("text"))).alias("tasks"))
    return rows.select("conv_id", "n_turns", quality.blank_tasks(F.col("tasks")).alias("is_empty"))


def _reasons(spark: SparkSession, folder: str) -> list[DataFrame]:
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "episode_id")
    short = _order_lengths(spark, folder).where("length < 2").select(F.col("o_orderkey").alias("episode_id"), F.lit("frame_too_short").alias("reason"))
    return [orders.where("o_orderstatus = 'P'").select("episode_id", F.lit("corrupted").alias("reason")), short, orders.where("o_totalprice > 300000").select("episode_id", F.lit("l2_above_threshold").alias("reason"))]


_REASONS_SQL = f"""{_LENGTHS_SQL}, r AS (
  SELECT o_orderkey AS episode_id, 0 AS src, 'corrupted' AS reason FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 1, 'frame_too_short' FROM len WHERE length < 2
  UNION ALL SELECT o_orderkey, 2, 'l2_above_threshold' FROM orders WHERE o_totalprice > 300000),
m AS (SELECT episode_id, string_agg(reason, ',' ORDER BY src) AS reasons FROM r GROUP BY episode_id)"""


@query(f"WITH {_REASONS_SQL} SELECT * FROM m")
def reason_merge(spark: SparkSession, folder: str) -> DataFrame:
    return quality.merge_reasons(_reasons(spark, folder)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_REASONS_SQL} SELECT count(*) FILTER (reasons = 'l2_above_threshold') AS only_distance, count(*) FILTER (NOT contains(reasons, 'l2')) AS only_other,
 count(*) FILTER (contains(reasons, 'l2') AND reasons <> 'l2_above_threshold') AS "both", count(*) AS n_flagged FROM m""")
def reason_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return quality.reason_breakdown(quality.merge_reasons(_reasons(spark, folder)), ["l2_above_threshold"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclude_flagged(spark: SparkSession, folder: str) -> DataFrame:
    return joins.without(table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    return joins.resume(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id", F.col("quality") == 1)


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END, n_name, 'unknown') AS task FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey")
def task_lookup_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    dim = table(spark, folder, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("task"))
    facts = table(spark, folder, "customer").withColumn("own", F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment")))
    return joins.lookup(facts, dim, "c_nationkey", "task", inline="own", default="unknown").select("c_custkey", "task")


@query("""WITH one AS (SELECT doc_id, 'label ' || quality AS v FROM labels), two AS (SELECT source, doc_id % 10 AS num, 'near ' || min(doc_id) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT d.doc_id, coalesce(one.v, two.v, 'none') AS matched, CASE WHEN one.v IS NOT NULL THEN 'exact' WHEN two.v IS NOT NULL THEN 'prefix' ELSE 'missing' END AS tier
FROM documents d LEFT JOIN one USING (doc_id) LEFT JOIN two ON d.source = two.source AND d.doc_id % 10 = two.num""")
def cascade_match(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", (F.col("doc_id") % 10).alias("num"))
    exact = table(spark, folder, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("v"))
    near = docs.where("doc_id % 3 = 0").groupBy("source", "num").agg(F.concat(F.lit("near "), F.min("doc_id").cast("string")).alias("v"))
    return joins.cascade(docs, [("exact", exact, ["doc_id"], "v"), ("prefix", near, ["source", "num"], "v")], "none").select("doc_id", "matched", "tier")


@query("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'exact' ELSE 'missing' END AS tier FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY tier")
def match_tiers(spark: SparkSession, folder: str) -> DataFrame:
    exact = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("v"))
    return joins.cascade(table(spark, folder, "documents").select("doc_id"), [("exact", exact, ["doc_id"], "v")], "none").groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'patched ' || l.quality ELSE d.lang END AS value FROM documents d FULL OUTER JOIN (SELECT doc_id + 100 AS doc_id, quality FROM labels) l ON d.doc_id = l.doc_id")
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("value"))
    patch = table(spark, folder, "labels").select((F.col("doc_id") + 100).alias("doc_id"), F.concat(F.lit("patched "), F.col("quality").cast("string")).alias("value"))
    return joins.upsert(base, patch, "doc_id")


@query("""WITH k AS (SELECT r_name AS key, r_regionkey AS pos FROM region UNION ALL SELECT p_brand, 100 + row_number() OVER (ORDER BY p_brand) FROM (SELECT DISTINCT p_brand FROM part)),
n AS (SELECT DISTINCT p_type || '/' || p_brand AS name FROM part)
SELECT name, coalesce(arg_min(key, pos), split_part(name, '/', -1)) AS key FROM n LEFT JOIN k ON ends_with(name, key) OR contains(name, key) GROUP BY name""")
def theta_name_match(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    brands = part.select("p_brand").distinct().select(F.col("p_brand").alias("key"), (F.row_number().over(W.orderBy("p_brand")) + 100).cast("long").alias("pos"))
    keys = table(spark, folder, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("long").alias("pos")).unionByName(brands)
    return joins.match_names(part.select(F.concat_ws("/", "p_type", "p_brand").alias("name")).distinct(), keys)


def label_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of each label as flattened trajectories; they are widened to doubles where they are read."""
    return table(spark, folder, "embeddings").select(F.col("label").alias("grp"), "vec_id", F.col("embedding").alias("traj"))


def label_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of the vectors of a label."""
    rows = table(spark, folder, "embeddings").withColumn("traj", F.col("embedding").cast("array<double>"))
    return joins.pairs_within(rows.select(F.col("label").alias("grp"), "vec_id", "traj"), "grp", "vec_id", ["traj"])


_PAIR_SQL = "p AS (SELECT x.label AS grp, x.vec_id AS a, y.vec_id AS b, CAST(x.embedding AS DOUBLE[]) AS u, CAST(y.embedding AS DOUBLE[]) AS v FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)"


@query(f"WITH {_PAIR_SQL} SELECT grp, a, b, round(list_distance(u, v), 6) AS d FROM p")
def all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.distances(label_vectors(spark, folder), "grp", "vec_id", "traj").withColumn("d", F.round("d", 6))


@query(f"WITH {_PAIR_SQL} SELECT a, b, round(abs(u[1] - v[1]) + abs(u[2] - v[2]), 6) AS d FROM p WHERE u[3] > 0 AND v[4] > 0")
def two_side_sum(spark: SparkSession, folder: str) -> DataFrame:
    pairs = label_pairs(spark, folder)
    side = lambda k, there: pairs.where(there).select("a", "b", F.abs(F.get("traj_a", F.lit(k)) - F.get("traj_b", F.lit(k))).alias("d"))
    # a side is there only for some of the pairs
    return joins.two_sides(side(0, F.get("traj_a", F.lit(2)) > 0), side(1, F.get("traj_b", F.lit(3)) > 0), ["a", "b"]).withColumn("d", F.round("d", 6))


@query(f"WITH {_PAIR_SQL}, d AS (SELECT grp, list_distance(u, v) AS d FROM p) SELECT grp, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d, round(avg(d), 6) AS mean_d, round(stddev_pop(d), 6) AS std_d, count(*) AS n_pairs FROM d GROUP BY grp")
def matrix_stats(spark: SparkSession, folder: str) -> DataFrame:
    out = blocks.distance_stats(label_vectors(spark, folder), "grp", "vec_id", "traj")
    return out.select("grp", *[F.round(c, 6).alias(c) for c in ("min_d", "max_d", "mean_d", "std_d")], "n_pairs")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events),
q AS (SELECT user_id, unnest(range(0, 5)) AS k, min(t) AS lo, max(t) AS hi FROM e GROUP BY user_id),
r AS (SELECT user_id, k, lo + (hi - lo) * k / 4.0 AS want FROM q)
SELECT r.user_id, k, arg_min(event_id, {'d': abs(t - want), 't': t, 'i': event_id}) AS event_id FROM r JOIN e USING (user_id) GROUP BY r.user_id, k""")
def nearest_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Per user the event nearest to five evenly placed times."""
    events = table(spark, folder, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    ends = events.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
    requests = ends.select("user_id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / 4.0).alias("at"), "k")
    found = joins.nearest(requests.select("user_id", "at").distinct(), events, "user_id", "at", "t", "event_id")
    return requests.join(found, ["user_id", "at"]).select("user_id", "k", "event_id")


_RUNS = """WITH x AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
y AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS run FROM x),
s AS (SELECT user_id, run, any_value(event_type) AS event_type, min(event_id) AS "start", max(event_id) AS "end", count(*) AS n FROM y GROUP BY user_id, run)"""


@query(_RUNS + " SELECT * FROM s")
def run_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.runs(table(spark, folder, "events"), "user_id", ["event_id"], "event_type")



def _dictionary(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "events").select("event_type").distinct()
    return kinds.select("event_type", F.when(F.substring("event_type", 1, 1).between("a", "m"), "first half").when(F.length("event_type") > 6, "none").otherwise(F.upper("event_type")).alias("text"))


_STEPS = _RUNS + """, dim AS (SELECT DISTINCT event_type, CASE WHEN event_type[1] BETWEEN 'a' AND 'm' THEN 'first half' WHEN length(event_type) > 6 THEN 'none' ELSE upper(event_type) END AS d FROM events),
st AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY run) - 1 AS INTEGER) AS i, d AS "desc", "start", "end" FROM s JOIN dim USING (event_type) WHERE d <> 'none')"""


@query(_STEPS + " SELECT * FROM st")
def segment_steps(spark: SparkSession, folder: str) -> DataFrame:
    return segments.steps(run_segments(spark, folder), "user_id", _dictionary(spark, folder), "event_type", ["none", "null", ""])


@query(_STEPS + """, z AS (SELECT *, CASE WHEN "desc" IS DISTINCT FROM lag("desc") OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS g FROM st),
v AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY i) - 1 AS j FROM z)
SELECT user_id, CAST(j AS BIGINT) AS i, any_value("desc") AS "desc", min("start") AS "start", max("end") AS "end" FROM v GROUP BY user_id, j""")
def merge_steps(spark: SparkSession, folder: str) -> DataFrame:
    return segments.merge_equal(segment_steps(spark, folder), "user_id")


_GATHER = """WITH b AS (SELECT user_id, event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS f,
 last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
 row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(value) OVER w AS p1, lead(value, 1) OVER w AS n1, lead(value, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, {} AS p1, value AS at, {} AS n1, {} AS n2 FROM b"""


def _gather(spark: SparkSession, folder: str, absolute: bool) -> DataFrame:
    rows = segments.window_gather(table(spark, folder, "events"), "user_id", "event_id", "value", [-1, 0, 1, 2], absolute)
    return rows.select("event_id", *[F.get("window", F.lit(k)).alias(n) for k, n in enumerate(("p1", "at", "n1", "n2"))])


@query(_GATHER.format("CASE WHEN i > 1 THEN p1 ELSE f END", "CASE WHEN i < n THEN n1 ELSE l END", "CASE WHEN i + 1 < n THEN n2 ELSE l END"))
def delta_window_pad(spark: SparkSession, folder: str) -> DataFrame:
    return _gather(spark, folder, True)


@query(_GATHER.format("CASE WHEN i > 1 THEN p1 ELSE 0 END", "CASE WHEN i < n THEN n1 ELSE 0 END", "CASE WHEN i + 1 < n THEN n2 ELSE 0 END"))
def zero_pad(spark: SparkSession, folder: str) -> DataFrame:
    return _gather(spark, folder, False)


@query(f"WITH {_LENGTHS_SQL} SELECT o_orderkey, unnest(range(length)) AS step FROM len WHERE length > 0")
def step_expand(spark: SparkSession, folder: str) -> DataFrame:
    return segments.expand_steps(_order_lengths(spark, folder), "length").select("o_orderkey", "step")


@query(f'WITH {_LENGTHS_SQL} SELECT o_orderkey, CAST(coalesce(sum(length) OVER (PARTITION BY dataset ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM len')
def start_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return segments.start_offsets(_order_lengths(spark, folder), "dataset", "o_orderkey", "length").select("o_orderkey", "offset")


@query("""WITH v AS (SELECT label, vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS e FROM embeddings),
h AS (SELECT vec_id, e, list(e) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS past FROM v),
u AS (SELECT vec_id, e, unnest(past) AS p FROM h),
w AS (SELECT vec_id, p, exp(0.1 * list_dot_product(p, e) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(e, e)) + 1e-7)) AS k FROM u)
SELECT vec_id, round(sum(k * p[1]) / sum(k), 6) AS e0, round(sum(k * p[2]) / sum(k), 6) AS e1, round(sum(k * p[4]) / sum(k), 6) AS e3 FROM w GROUP BY vec_id""")
def sliding_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 4).alias("e"))
    out = segments.ensemble(rows, "label", "vec_id", "e", history=3, alpha=0.1)
    return out.select("vec_id", *[F.round(F.get("ensemble", F.lit(k)), 6).alias(f"e{k}") for k in (0, 1, 3)])


@query("SELECT o_orderpriority AS task, count(*) AS n, min(o_orderkey) AS first_episode, max(o_orderkey) AS last_episode FROM orders GROUP BY ALL")
def group_tasks(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports.group_tasks(table(spark, folder, "orders"), "o_orderpriority", "o_orderkey")
    return rows.select(F.col("o_orderpriority").alias("task"), "n", F.element_at("episodes", 1).alias("first_episode"), F.element_at("episodes", -1).alias("last_episode"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def counters_topn(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_counts(table(spark, folder, "documents"), "source", 5)


@query("SELECT source, arg_min(doc_id, n_chars * 1000000 + doc_id) AS first_id, arg_max(doc_id, n_chars * 1000000 + doc_id) AS last_id FROM documents GROUP BY source")
def first_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("source", "doc_id", F.expr("n_chars * 1000000 + doc_id").alias("o"))
    first = joins.first_wins(rows, ["source"], "o").select("source", F.col("doc_id").alias("first_id"))
    return first.join(joins.last_wins(rows, ["source"], "o").select("source", F.col("doc_id").alias("last_id")), "source")


@query("""SELECT 'union' AS op, doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'intersect', doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'except', doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE quality = 0)""")
def flagged_sets(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    a, b = labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0").select("doc_id")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [df.select(F.lit(k).alias("op"), "doc_id") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
