"""Queries over texts, answers, scores, conversations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import conversations, records, reports, scoring
from tidewell.sources import sinks
from tidewell.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as answers: language as answer type, source as capability, quality as correct."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return rows.select("doc_id", F.col("lang").alias("answer_type"), F.col("source").alias("capability"), F.when(F.col("toxic") == 1, "toxic").alias("error_type"), (F.col("quality") == 1).alias("correct"), "n_chars")


_R = "r AS (SELECT doc_id, lang AS answer_type, source AS capability, CASE WHEN toxic = 1 THEN 'toxic' END AS error_type, quality AS ok, n_chars FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {_R} SELECT CASE WHEN g = 3 THEN 'answer_type' WHEN g = 5 THEN 'capability' WHEN g = 6 THEN 'error_type' ELSE 'overall' END AS dimension,
 CASE WHEN g = 3 THEN a WHEN g = 5 THEN c WHEN g = 6 THEN e ELSE 'all' END AS value, total, correct, round(correct / total, 4) AS accuracy
FROM (SELECT answer_type AS a, capability AS c, coalesce(error_type, 'unknown') AS e, grouping(answer_type, capability, coalesce(error_type, 'unknown')) AS g, count(*) AS total, CAST(sum(ok) AS BIGINT) AS correct
 FROM r GROUP BY GROUPING SETS ((), (answer_type), (capability), (coalesce(error_type, 'unknown'))))""")
def vqa_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return reports.accuracy(_results(spark, folder), ["answer_type", "capability", "error_type"])


@query(f"""WITH {_R}, m AS (SELECT answer_type, doc_id % 3 AS round, avg(ok) * 100 AS acc FROM r GROUP BY ALL)
SELECT answer_type, count(acc) AS n_rounds, round(avg(acc), 4) AS mean, round(stddev_samp(acc), 4) AS std FROM m GROUP BY answer_type""")
def vqa_rounds_meanstd(spark: SparkSession, folder: str) -> DataFrame:
    per = _results(spark, folder).groupBy("answer_type", (F.col("doc_id") % 3).alias("round")).agg((F.avg(F.col("correct").cast("int")) * 100).alias("acc"))
    return reports.rounds(per, ["answer_type"], "acc").select("answer_type", "n_rounds", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(f"WITH {_R} SELECT capability, " + ", ".join(f"round(avg(ok) FILTER (answer_type = '{x}'), 4) AS {x}" for x in ("en", "fr", "de", "es")) + " FROM r GROUP BY capability")
def vqa_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return reports.pivot_accuracy(_results(spark, folder), "capability", "answer_type", ["en", "fr", "de", "es"])


_ANSWERS = """WITH d AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'none' WHEN 2 THEN 'I see two cups' WHEN 3 THEN 'B) cup' WHEN 4 THEN 'Answer: c' WHEN 5 THEN 'it is the cup' WHEN 6 THEN '12 or 13' ELSE 'No, I do not think that it is so' END AS a FROM documents), l AS (SELECT *, lower(a) AS s FROM d)"""


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    forms = ["Yes.", "none", "I see two cups", "B) cup", "Answer: c", "it is the cup", "12 or 13", "No, I do not think that it is so"]
    return table(spark, folder, "documents").select("doc_id", F.get(F.array(*map(F.lit, forms)), (F.col("doc_id") % 8).cast("int")).alias("a"))


@query(_ANSWERS + r""" SELECT doc_id, CASE WHEN s IN ('yes', 'no') THEN s WHEN starts_with(s, 'yes') THEN 'yes' WHEN starts_with(s, 'no') THEN 'no'
 WHEN regexp_matches(s, '\byes\b') AND NOT regexp_matches(s, '\bno\b') THEN 'yes' WHEN regexp_matches(s, '\bno\b') AND NOT regexp_matches(s, '\byes\b') THEN 'no' ELSE s[1:20] END AS parsed FROM l""")
def answer_yes_no(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("doc_id", text.yes_no(F.col("a")).alias("parsed"))


@query(_ANSWERS + r""" SELECT doc_id, CASE WHEN regexp_matches(s, '\d') THEN regexp_extract(s, '\d+') """ + " ".join(f"WHEN contains(s, '{w}') THEN '{n}'" for n, w in enumerate(text.NUMBER_WORDS)) + " ELSE s[1:20] END AS parsed FROM l")
def answer_number(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("doc_id", text.number(F.col("a")).alias("parsed"))


@query(_ANSWERS + r""" SELECT doc_id, CASE WHEN regexp_extract(a, '^\(?([A-Da-d])([).:\s]|$)', 1) <> '' THEN upper(regexp_extract(a, '^\(?([A-Da-d])([).:\s]|$)', 1))
 WHEN regexp_extract(a, '(?i)answer\s*(?:is|:)?\s*\(?([A-D])\b', 1) <> '' THEN upper(regexp_extract(a, '(?i)answer\s*(?:is|:)?\s*\(?([A-D])\b', 1))
 WHEN contains(s, 'plate') THEN 'A' WHEN contains(s, 'cup') THEN 'B' ELSE a[1:20] END AS parsed FROM l""")
def answer_mc(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("doc_id", text.choice(F.col("a"), F.array(F.lit("plate"), F.lit("cup"))).alias("parsed"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as judged facts: an order is a sample, the ship mode of its number a capability, quantity the label."""
    caps = F.array(*map(F.lit, scoring.CAPABILITIES[:4]))
    q = F.col("l_quantity").cast("int") % 10
    label = F.when(q < 5, "match").when(q < 6, "partial").when(q < 7, "contradiction").when(q < 9, "omission").otherwise("hallucination")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.get(caps, F.col("l_linenumber") % 4).alias("capability"), label.alias("label"))


_CAPS = "['" + "','".join(scoring.CAPABILITIES[:4]) + "']"
_C = f"""WITH f AS (SELECT l_orderkey AS sample_id, ({_CAPS})[l_linenumber % 4 + 1] AS capability, CAST(l_quantity AS INTEGER) % 10 AS q FROM lineitem),
c AS (SELECT sample_id, capability, count(*) FILTER (q < 5) AS M, count(*) FILTER (q = 5) AS P, count(*) FILTER (q = 6) AS X, count(*) FILTER (q IN (7, 8)) AS O, count(*) FILTER (q = 9) AS H FROM f GROUP BY ALL),
n AS (SELECT *, M + P + X + O AS G, M + P + X + H AS C, M + P + X AS A FROM c),
k AS (SELECT *, CASE WHEN A <> 0 THEN (M + 0.5 * P) / A END::DOUBLE AS consistency, CASE WHEN G <> 0 THEN (M + 0.5 * P) / G END::DOUBLE AS coverage, CASE WHEN C <> 0 THEN 1 - H / C END::DOUBLE AS ah FROM n),
s AS (SELECT sample_id, coalesce(avg(consistency), 0) AS c, coalesce(avg(coverage), 0) AS v, coalesce(max(ah) FILTER (capability = 'action_sequence'), 1.0) AS a FROM k GROUP BY sample_id),
z AS (SELECT sample_id, round(c, 4) AS consistency_score, round(v, 4) AS weighted_coverage, round(a, 4) AS weighted_anti_hallucination, round((c + v + a) / 3, 4) AS caption_score FROM s)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.ratios(scoring.label_counts(_labels(spark, folder), ["sample_id", "capability"]))


@query(_C + " SELECT sample_id, capability, G, C, M, P, X, O, H, A, round(consistency, 6) AS consistency, round(coverage, 6) AS coverage, round(ah, 6) AS anti_hallucination FROM k")
def capability_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("sample_id", "capability", *"GCMPXOHA", *[F.round(c, 6).alias(c) for c in ("consistency", "coverage", "anti_hallucination")])


@query(_C + " SELECT sample_id, abs(caption_score - round((consistency_score + weighted_coverage + weighted_anti_hallucination) / 3, 4)) < 0.0002 AS adds_up, round(consistency_score, 3) AS c, round(weighted_coverage, 3) AS v, round(weighted_anti_hallucination, 3) AS a FROM z")
def sample_scores(spark: SparkSession, folder: str) -> DataFrame:
    z = scoring.sample_scores(_scored(spark, folder))
    return z.select("sample_id", (F.abs(F.col("caption_score") - F.round(F.expr("(consistency_score + weighted_coverage + weighted_anti_hallucination) / 3"), 4)) < 0.0002).alias("adds_up"), *[F.round(x, 3).alias(n) for x, n in (("consistency_score", "c"), ("weighted_coverage", "v"), ("weighted_anti_hallucination", "a"))])


@query(_C + " SELECT count(*) AS n_samples, round(avg(caption_score), 4) AS caption_score, round(avg(consistency_score), 4) AS consistency_score, round(avg(weighted_coverage), 4) AS weighted_coverage, round(avg(weighted_anti_hallucination), 4) AS weighted_anti_hallucination FROM z")
def summary_macro(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.summary_macro(scoring.sample_scores(_scored(spark, folder)))


@query(_C + """ SELECT capability, round((sum(M) + 0.5 * sum(P)) / sum(C), 4)::DOUBLE AS consistency, round((sum(M) + 0.5 * sum(P)) / sum(G), 4)::DOUBLE AS coverage, round(sum(A) / (sum(A) + sum(H)), 4)::DOUBLE AS anti_hallucination FROM n GROUP BY capability""")
def summary_micro(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.summary_micro(scoring.label_counts(_labels(spark, folder), ["sample_id", "capability"]), ["capability"])


@query(_C + """ SELECT capability, round(avg(consistency), 4) AS consistency, round(avg(coverage), 4) AS coverage, round(avg(ah), 4) AS anti_hallucination,
 """ + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in "GCMPXOH") + " FROM k GROUP BY capability")
def summary_capability(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.summary_by_capability(_scored(spark, folder))


@query(_C + " SELECT count(*) AS n, count(*) FILTER (G = M + P + X + O) AS facts_ok, count(*) FILTER (C = M + P + X + H) AS claims_ok FROM n")
def count_sanity(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.counts_hold(_scored(spark, folder)).agg(F.count("*").alias("n"), F.count_if("facts_ok").alias("facts_ok"), F.count_if("claims_ok").alias("claims_ok"))


@query("""WITH e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), u AS (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'A')
SELECT DISTINCT k, 'unknown' AS fault FROM u WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT k, 'missing' FROM e WHERE k NOT IN (SELECT k FROM u) UNION ALL SELECT k, 'duplicate' FROM u GROUP BY k HAVING count(*) > 1""")
def fact_id_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that aren't pending are expected, lines that weren't returned use them."""
    expected = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    used = table(spark, folder, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("k"))
    return scoring.id_faults(expected, used, ["k"])


@query("""WITH s AS (SELECT doc_id AS sample_id, n_chars % 3 AS f, n_chars % 5 AS c FROM documents), w AS (SELECT *, unnest(['action_sequence', 'quantity']) AS capability FROM s)
SELECT sample_id, capability, CASE WHEN f = 0 THEN 'no_facts' WHEN c = 0 THEN 'all_omitted' ELSE 'judge' END AS how FROM w WHERE NOT (capability = 'quantity' AND sample_id IN (SELECT doc_id FROM labels))""")
def work_list(spark: SparkSession, folder: str) -> DataFrame:
    samples = table(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("n_chars") % 3).alias("n_facts"), (F.col("n_chars") % 5).alias("n_claims"))
    done = table(spark, folder, "labels").select(F.col("doc_id").alias("sample_id"), F.lit("quantity").alias("capability"))
    return scoring.work_list(samples, done, ["action_sequence", "quantity"]).select("sample_id", "capability", "how")


@query("""WITH r AS (SELECT l_orderkey AS sample_id, l_linenumber % 4 AS c, l_quantity > 48 AS e FROM lineitem)
SELECT sample_id, CASE WHEN bool_or(e) THEN 'error' ELSE 'ok' END AS status FROM r GROUP BY sample_id HAVING count(DISTINCT c) = 4""")
def sample_assembly(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") % 4).alias("capability"), (F.col("l_quantity") > 48).alias("error"))
    return scoring.complete_samples(rows, ["a", "b", "c", "d"])


@query(f"WITH {_R} SELECT capability, count(*) FILTER (ok = 1 AND error_type IS NULL) AS correct, count(*) FILTER (error_type IS NULL) AS judged, count(*) FILTER (error_type IS NOT NULL) AS skipped, CASE WHEN count(*) FILTER (error_type IS NULL) > 0 THEN round(100.0 * count(*) FILTER (ok = 1 AND error_type IS NULL) / count(*) FILTER (error_type IS NULL), 2) END::DOUBLE AS accuracy_pct FROM r GROUP BY capability")
def judge_skip_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _results(spark, folder).withColumn("verdict", F.when(F.col("error_type").isNotNull(), "skip").when(F.col("correct"), "correct").otherwise("wrong"))
    return reports.judged(rows, ["capability"])


@query("SELECT round(avg(d / t), 6) AS macro, round(sum(d) / sum(t), 6) AS micro FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS d, count(*) AS t FROM lineitem GROUP BY l_suppkey)")
def success_macro_micro(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("d"), F.lit(1).alias("t"))
    return reports.success_rates(rows, "l_suppkey", "d", "t")


@query("SELECT l_linenumber AS step, count(*) AS n_tasks, round(avg(m), 6) AS mean FROM (SELECT l_linenumber, l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY ALL) GROUP BY l_linenumber")
def checkpoint_mean(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_checkpoint(table(spark, folder, "lineitem"), "l_linenumber", "l_suppkey", "l_discount").withColumnRenamed("l_linenumber", "step")


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS failed, round(avg(o_totalprice), 4) AS mean_elapsed FROM orders GROUP BY ALL")
def status_summary(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "skipped: no data").otherwise("error")
    rows = table(spark, folder, "orders").select("o_orderpriority", status.alias("status"), F.col("o_totalprice").alias("elapsed"))
    return reports.status_summary(rows, ["o_orderpriority"]).withColumn("mean_elapsed", F.round("mean_elapsed", 4))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS clean, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents")
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("clean"), text.words(F.col("text")).alias("n_words"))


@query("SELECT doc_id, split_part(s, '@', -1) AS last_part, CASE WHEN contains(s, '@') THEN s[strpos(s, '@') + 1:] ELSE s END AS after_first FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '@' || source || '@x' WHEN doc_id % 3 = 1 THEN lang || '@' || source ELSE source END AS s FROM documents)")
def at_split(spark: SparkSession, folder: str) -> DataFrame:
    s = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("@", "lang", "source", F.lit("x"))).when(F.col("doc_id") % 3 == 1, F.concat_ws("@", "lang", "source")).otherwise(F.col("source"))
    return table(spark, folder, "documents").select("doc_id", text.after_last_at(s).alias("last_part"), text.after_first_at(s).alias("after_first"))


@query(r"SELECT page_id, CASE WHEN r = '' THEN 'unknown_task' ELSE r END AS name FROM (SELECT page_id, regexp_replace(trim(regexp_replace(replace(url, '/', ' '), '[^\w\s-]', '', 'g')), '\s+', '_', 'g')[1:120] AS r FROM pages)")
def safe_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.safe_name(F.replace("url", F.lit("/"), F.lit(" "))).alias("name"))


@query("SELECT o_orderkey, printf('data/chunk-%03d/episode_%06d.parquet', o_orderkey // 1000, o_orderkey) AS path FROM orders")
def path_template(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", text.episode_path(F.col("o_orderkey"), 1000).alias("path"))


@query("SELECT doc_id, round_even(n_chars / nullif(doc_id % 31, 0), 3)::DOUBLE AS seconds, CASE WHEN doc_id % 5 <> 0 THEN n_chars || 'x' || doc_id END AS resolution FROM documents")
def resolution_duration(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", text.duration(F.col("n_chars"), F.col("doc_id") % 31).alias("seconds"), text.resolution(F.col("n_chars"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id"))).alias("resolution"))


@query(r"SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '(\d+)\.html$', 1), '') AS BIGINT), -1) AS number FROM pages")
def filename_frame(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.coalesce(text.trailing_number(F.col("url"), r"(\d+)\.html$"), F.lit(-1)).alias("number"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pick|place' WHEN 1 THEN 'pick it|drop' WHEN 2 THEN 'plain text' END AS steps FROM documents""")
def steps_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Steps as a JSON list, as a Python literal, as plain text, and as an object, which isn't a list."""
    forms = F.array(F.lit('["pick", "", "place"]'), F.lit("['pick it', 'drop']"), F.lit("plain text"), F.lit('{"a": 1}'))
    return table(spark, folder, "documents").select("doc_id", F.array_join(text.parse_steps(F.get(forms, (F.col("doc_id") % 4).cast("int"))), "|").alias("steps"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events""")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The first balanced object in text around it, then one field."""
    raw = F.concat(F.lit("<think>{no}</think> so: "), "props", F.lit(" and {more"))
    return table(spark, folder, "events").select("event_id", F.get_json_object(text.json_object(raw), "$.k").cast("bigint").alias("k"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 4 < 3 THEN props->>'$.k' END AS BIGINT) AS annotation, CAST(CASE WHEN event_id % 4 IN (0, 2) THEN props->>'$.k' END AS BIGINT) AS judge,
 CAST(CASE WHEN event_id % 4 = 0 THEN props->>'$.k' END AS BIGINT) AS caption, CAST(CASE WHEN event_id % 4 = 0 THEN props->>'$.k' END AS BIGINT) AS answers FROM events""")
def json_variants(spark: SparkSession, folder: str) -> DataFrame:
    """One answer in four forms: fenced; a brace in a string before the object; a brace after it; and an object that is cut short."""
    forms = F.array(
        F.concat(F.lit("<think>{no}</think> so: ```json\n"), "props", F.lit("\n``` done")), F.concat(F.lit('<think>no</think> "{" '), "props"), F.concat(F.lit("<think>no</think> "), "props", F.lit(" }")), F.regexp_replace("props", r"\}\s*$", "")
    )
    rows = table(spark, folder, "events").select("event_id", F.get(forms, (F.col("event_id") % 4).cast("int")).alias("raw"))
    k = {v: F.get_json_object(text.json_answer(F.col("raw"), v), "$.k").cast("bigint").alias(v) for v in ("annotation", "judge", "caption")}
    return rows.select("event_id", *k.values(), F.try_element_at(text.answer_map(F.col("raw")), F.lit("k")).cast("bigint").alias("answers"))


_IDS = "WITH v AS (SELECT vec_id, vec_id // 8 AS batch, list_transform(embedding[1:1 + CAST(vec_id % 7 AS INT)], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ids FROM embeddings)"


def _id_rows(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.transform(F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 7).cast("int")), lambda x: F.floor(256 * x.cast("double")))
    rows = table(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 8").alias("batch"), ids.alias("input_ids"))
    return rows.withColumn("labels", F.transform("input_ids", lambda x: -x))


@query(_IDS + """, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM v), p AS (SELECT vec_id, list_concat(ids, list_transform(range(n - len(ids)), lambda z: 99999))[1:5] AS ids, list_concat(list_transform(ids, lambda x: -x), list_transform(range(n - len(ids)), lambda z: -100))[1:5] AS labels FROM w)
SELECT vec_id, array_to_string(ids, ',') AS ids, array_to_string(labels, ',') AS labels, len(list_filter(ids, lambda x: x <> 99999)) AS n_real FROM p""")
def pad_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.padded(_id_rows(spark, folder), "batch", 5, 99999)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias({"input_ids": "ids"}.get(c, c))
    return rows.select("vec_id", joined("input_ids"), joined("labels"), F.size(F.filter("attention", lambda x: x)).cast("bigint").alias("n_real"))


@query(_IDS + ", c AS (SELECT *, sum(len(ids)) OVER (PARTITION BY batch ORDER BY vec_id) AS upto FROM v) SELECT batch, array_to_string(flatten(list(ids ORDER BY vec_id)), ',') AS ids, '0,' || string_agg(CAST(upto AS VARCHAR), ',' ORDER BY vec_id) AS bounds FROM c GROUP BY batch")
def flat_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.flattened(_id_rows(spark, folder), "batch", "vec_id")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("batch", joined("input_ids").alias("ids"), joined("bounds").alias("bounds"))


@query("""SELECT event_id, from_json(props, '{"k": "BIGINT"}').k AS k FROM events""")
def json_strict(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k BIGINT", {"mode": "FAILFAST"})["k"].alias("k"))


_W = r"CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS BIGINT)"


@query(f"SELECT conv_id, CAST(sum({_W}) AS BIGINT) AS n_words FROM conversations GROUP BY conv_id HAVING sum({_W}) <= 150")
def conv_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.short_enough(table(spark, folder, "conversations"), 150)


@query(f"SELECT conv_id, CAST(sum({_W}) + 128 * (conv_id % 2) AS BIGINT) AS length, CAST(CASE WHEN conv_id % 2 = 1 THEN sum({_W}) ELSE -sum({_W}) END AS BIGINT) AS modality_length FROM conversations GROUP BY conv_id")
def conv_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").withColumn("image", F.col("conv_id") % 2 == 1)
    return conversations.lengths(rows, image="image")


@query("""WITH c AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS n FROM c WHERE k = 1""")
def role_map(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.mapped_turns(table(spark, folder, "conversations")).select("conv_id", "turn", "role", "n")


@query("WITH c AS (SELECT doc_id, doc_id % 8 AS shard, least(n_chars, 2048) AS cut FROM documents), u AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY shard ORDER BY doc_id) AS BIGINT) AS upto FROM c) SELECT doc_id, shard, cut, upto, (upto - 1) // 2048 AS pack FROM u")
def packed_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.packed_lengths(table(spark, folder, "documents"), "n_chars", "doc_id", 8, 2048)
    return rows.select("doc_id", "shard", F.col("cut").cast("bigint").alias("cut"), "upto", "pack")


@query("SELECT source, CAST(min(doc_id) FILTER (lang = 'en') AS BIGINT) AS en_first, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS en_n, min(doc_id) FILTER (lang = 'de') AS de_first, count(*) FILTER (lang = 'de') AS de_n FROM documents GROUP BY source")
def wide_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    out = sinks.wide(rows, "source", "lang", ["en", "de"], ["first", "n"])
    return out.select("source", "en_first", F.coalesce("en_n", F.lit(0)).alias("en_n"), "de_first", F.coalesce("de_n", F.lit(0)).alias("de_n"))


@query("SELECT source AS dataset, count(*) AS n_flagged, CAST(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_reasons FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0 GROUP BY source")
def filter_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").where("toxic = 1 OR quality = 0")
    reasons = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low quality")), lambda x: x.isNotNull())
    out = sinks.report(rows.select(F.col("source").alias("dataset"), F.col("doc_id").alias("episode_id"), reasons.alias("reasons")))
    return out.select("dataset", "n_flagged", F.aggregate(F.map_values("flagged"), F.lit(0).cast("bigint"), lambda t, r: t + F.size(r)).alias("n_reasons"))


@query("SELECT doc_id, length(source || lang) AS n, coalesce(source, '')[1:3] AS source FROM documents")
def csv_preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.length(F.concat("source", "lang")).cast("bigint").alias("n"), "source")
    return sinks.preview(rows, ["source"], [], 3)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'main' WHEN doc_id % 3 = 1 THEN 'left wrist' ELSE 'right' END AS label, CASE WHEN doc_id % 2 = 0 THEN 'cam_high' ELSE 'side' END AS primary_view FROM documents")
def view_rules(spark: SparkSession, folder: str) -> DataFrame:
    names = F.get(F.array(F.lit("front"), F.lit("Wrist_Left"), F.lit("right_cam")), (F.col("doc_id") % 3).cast("int"))
    views = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("top"), F.lit("cam_high"))).otherwise(F.array(F.lit("side"), F.lit("fisheye")))
    return table(spark, folder, "documents").select("doc_id", text.view_label(names, F.col("doc_id") % 3).alias("label"), text.primary_view(views).alias("primary_view"))


@query("SELECT doc_id, sha256(source || '|' || doc_id) AS h FROM documents")
def stable_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2(F.concat_ws("|", "source", F.col("doc_id").cast("string")), 256).alias("h"))


@query("SELECT conv_id, string_agg('(' || (turn + 1) || ') ' || role, ' ' ORDER BY turn) AS shown FROM conversations GROUP BY conv_id")
def numbered_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", text.numbered(F.transform("t", lambda s: s["role"])).alias("shown"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """The batch form of the streaming hourly counts."""
    from tidewell.streaming.flows import hourly

    return hourly(table(spark, folder, "events")).select("event_type", "hour", "n", F.round("total", 4).alias("total"))


@query("""WITH q AS (SELECT DISTINCT l_partkey AS question_id FROM lineitem), a AS (SELECT l_partkey AS question_id, l_linestatus AS model, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS answer FROM lineitem GROUP BY ALL)
SELECT question_id, max(answer) FILTER (model = 'F') AS f, max(answer) FILTER (model = 'O') AS o, max(answer) FILTER (model = 'none') AS none FROM q LEFT JOIN a USING (question_id) GROUP BY question_id""")
def answer_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as questions, line states as models, a line's return flag as the answer; one model has answered nothing."""
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("answer"), F.expr("l_orderkey * 10 + l_linenumber").alias("n"))
    out = reports.answer_matrix(lines.select("question_id").distinct(), lines, ["F", "O", "none"])
    return out.select("question_id", *[F.element_at("answers", m).alias(m.lower()) for m in ("F", "O", "none")])


@query(f"SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN {_W} ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE {_W} END) AS BIGINT) AS completion_tokens, CAST(sum({_W}) AS BIGINT) AS total_tokens FROM conversations GROUP BY conv_id")
def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as stages, their words as tokens; a user's are the prompt, the others have no such count."""
    n, user = text.words(F.col("text")), F.col("role") == "user"
    rows = table(spark, folder, "conversations").select("conv_id", F.when(user, n).alias("prompt_tokens"), F.when(~user, n).alias("completion_tokens"), n.alias("total_tokens"))
    return reports.token_usage(rows, ["conv_id"])


@query(f"WITH {_R} SELECT capability, doc_id, CAST(row_number() OVER (PARTITION BY capability ORDER BY doc_id) AS INTEGER) AS place FROM r WHERE ok = 0 QUALIFY place <= 5")
def first_wrong(spark: SparkSession, folder: str) -> DataFrame:
    return reports.first_wrong(_results(spark, folder), ["capability"], "doc_id").select("capability", "doc_id", "place")


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS sample_id, split_part(url, '/', 3) AS dataset, length(html) / 30.0::DOUBLE AS duration_sec, 30 AS fps, 'none' AS step_source, 0 AS has_raw_steps, 0 AS n_tags FROM pages")
def sample_records(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as samples: their records with what is known of them, the rest by default."""
    record = records.sample_record(sample_id=F.col("page_id").cast("string"), dataset=F.split_part("url", F.lit("/"), F.lit(3)), duration_sec=F.length("html") / 30, fps=F.lit(30))
    rows = table(spark, folder, "pages").select("page_id", record.alias("r"))
    return rows.select("page_id", *[F.col(f"r.{c}").alias(c) for c in ("sample_id", "dataset", "duration_sec", "fps", "step_source", "has_raw_steps")], F.size("r.error_tags").alias("n_tags"))


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, '[' || l_linenumber || '] part ' || l_partkey || chr(10) || 'A. ' || l_linestatus || chr(10) || 'B. ' || l_returnflag AS b FROM lineitem)
SELECT k, string_agg(b, chr(10) || chr(10) ORDER BY n, b) AS prompt FROM b GROUP BY k""")
def question_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as samples, lines as questions with two options."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_linenumber").cast("string").alias("question_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("question"), F.array("l_linestatus", "l_returnflag").alias("options"))
    return records.question_blocks(rows, "k", "l_linenumber")
