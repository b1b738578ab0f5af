"""Retrieval and answer metrics, statistics and dataset gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import scoring
from docweft.operators import statistics as S
from docweft.plans.base import frame, relation, with_ctes
from docweft.plans.q_scalars import sql_tokens
from docweft.plans.registry import query
from docweft.session import table

c = F.col
one = "*"

IR = """SELECT question_id, CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE round(h::DOUBLE / g, 6) END AS recall, CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE round(h::DOUBLE / t, 6) END AS precision, h > 0 AS hit, round(coalesce(1.0::DOUBLE / f, 0), 6) AS reciprocal_rank,
  CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE round(d / list_sum(list_transform(range(1, least(g, 5) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) END AS ndcg FROM (
  SELECT question_id, count(*) FILTER (gold) AS g, count(*) FILTER (rank <= 5) AS t, count(*) FILTER (rank <= 5 AND gold) AS h, min(rank) FILTER (gold) AS f, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= 5 AND gold), 0) AS d FROM ranked GROUP BY 1)"""


@relation("ir", IR, ("ranked",))
def ir(spark, sf):
    return S.ir_metrics(frame("ranked", spark, sf))


for _name, _cols in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("reciprocal_rank", "reciprocal_rank"), ("ndcg_at_k", "ndcg"), ("hit_rate_at_k", "hit")):
    query(_name, with_ctes(("ir",), f"SELECT question_id, {_cols} FROM ir"))(lambda s, f, k=_cols: frame("ir", s, f).select("question_id", k))
query("mrr", with_ctes(("ir",), "SELECT round(avg(reciprocal_rank), 6) AS mrr, count(*)::BIGINT AS questions FROM ir"))(lambda s, f: frame("ir", s, f).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count(one).alias("questions")))
query("gold_intersect", with_ctes(("ranked",), "SELECT question_id, item FROM ranked WHERE rank <= 5 AND gold"))(lambda s, f: frame("ranked", s, f).where("rank <= 5 AND gold").select("question_id", "item"))
query("unique_in_order", with_ctes(("results",), "SELECT question_id, document_id, row_number() OVER (PARTITION BY question_id ORDER BY first, document_id) AS place FROM (SELECT question_id, document_id, min(rid) AS first FROM results GROUP BY 1, 2)"))(
    lambda s, f: frame("results", s, f).groupBy("question_id", "document_id").agg(F.min("rid").alias("first")).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("first", "document_id")).cast("long")).drop("first")
)
query("duplicate_retrieval_rate", with_ctes(("results",), "SELECT question_id, round(sum(dup)::DOUBLE / count(*), 6) AS rate FROM (SELECT question_id, (row_number() OVER (PARTITION BY question_id, document_id % 10 ORDER BY rid) > 1)::INT AS dup FROM results) GROUP BY 1"))(
    lambda s, f: frame("results", s, f).withColumn("dup", (F.row_number().over(Window.partitionBy("question_id", c("document_id") % 10).orderBy("rid")) > 1).cast("int")).groupBy("question_id").agg(F.round(F.sum("dup") / F.count(one), 6).alias("rate"))
)
P, G = sql_tokens("predicted"), sql_tokens("gold")
query("token_f1_multiset", with_ctes(("answers",), f"SELECT example_id, round(CASE WHEN p = 0 AND g = 0 THEN 1.0::DOUBLE WHEN coalesce(o, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * o / (p + g) END, 6) AS f1 FROM (SELECT example_id, len({P}) AS p, len({G}) AS g FROM answers) LEFT JOIN (SELECT example_id, sum(least(a.n, b.n)) AS o FROM (SELECT example_id, t, count(*) AS n FROM (SELECT example_id, UNNEST({P}) AS t FROM answers) GROUP BY 1, 2) a JOIN (SELECT example_id, t, count(*) AS n FROM (SELECT example_id, UNNEST({G}) AS t FROM answers) GROUP BY 1, 2) b USING (example_id, t) GROUP BY 1) USING (example_id)"))(
    lambda s, f: _multiset(frame("answers", s, f))
)


def _multiset(a):
    """Multiset overlap inside the row: for each distinct token the smaller of its two counts."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    w = a.withColumn("p", T.alnum_tokens(c("predicted"))).withColumn("g", T.alnum_tokens(c("gold")))
    w = w.withColumn("o", F.aggregate(F.array_distinct("p"), F.lit(0), lambda s, t: s + F.least(count(c("p"), t), count(c("g"), t))))
    f1 = F.when((F.size("p") == 0) & (F.size("g") == 0), 1.0).when(c("o") == 0, 0.0).otherwise(2.0 * c("o") / (F.size("p") + F.size("g")))
    return w.select("example_id", F.round(f1, 6).alias("f1"))


EQ = "trim(regexp_replace(lower(predicted), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(gold), '\\s+', ' ', 'g'))"
eq = lambda: T.normalize(c("predicted")) == T.normalize(c("gold"))


@relation("judged", f"SELECT *, {EQ} AS em FROM answers", ("answers",))
def judged(spark, sf):
    return frame("answers", spark, sf).withColumn("em", eq())


avg_sql = lambda cond, value="em::INT": f"round(avg({value}) FILTER ({cond}), 6)"
avg_if = lambda cond, value=None: F.round(F.avg(F.when(F.expr(cond), value if value is not None else c("em").cast("int"))), 6)
query("answer_accuracy", with_ctes(("judged",), f"SELECT category, {avg_sql('answerable')} AS value FROM judged GROUP BY 1"))(lambda s, f: frame("judged", s, f).groupBy("category").agg(avg_if("answerable").alias("value")))
query("unsupported_rate", with_ctes(("judged",), "SELECT category, round(avg((NOT abstained AND trim(predicted) <> '')::INT) FILTER (NOT answerable), 6) AS value FROM judged GROUP BY 1"))(lambda s, f: frame("judged", s, f).groupBy("category").agg(avg_if("NOT answerable", (~c("abstained") & (F.trim("predicted") != "")).cast("int")).alias("value")))
query("grounding_rate", with_ctes(("judged",), "SELECT category, round(avg(contains(predicted, gold)::INT) FILTER (NOT abstained), 6) AS value FROM judged GROUP BY 1"))(lambda s, f: frame("judged", s, f).groupBy("category").agg(avg_if("NOT abstained", c("predicted").contains(c("gold")).cast("int")).alias("value")))
query("mean_by_population", with_ctes(("judged",), f"SELECT {avg_sql('answerable')} AS em, {avg_sql('NOT answerable', 'abstained::INT')} AS abstention, {avg_sql('true', 'confidence')} AS confidence, {avg_sql('false', 'confidence')} AS nobody FROM judged"))(
    lambda s, f: frame("judged", s, f).agg(avg_if("answerable").alias("em"), avg_if("NOT answerable", c("abstained").cast("int")).alias("abstention"), avg_if("true", c("confidence")).alias("confidence"), avg_if("false", c("confidence")).alias("nobody"))
)
query("mean_by_category", with_ctes(("judged",), f"SELECT category, {avg_sql('answerable')} AS em, {avg_sql('true', 'confidence')} AS confidence, count(*)::BIGINT AS n FROM judged GROUP BY 1"))(lambda s, f: frame("judged", s, f).groupBy("category").agg(avg_if("answerable").alias("em"), avg_if("true", c("confidence")).alias("confidence"), F.count(one).alias("n")))
query("per_kind", with_ctes(("judged",), f"SELECT category, source, {avg_sql('true')} AS em, count(*)::BIGINT AS n FROM judged GROUP BY 1, 2"))(lambda s, f: frame("judged", s, f).groupBy("category", "source").agg(avg_if("true").alias("em"), F.count(one).alias("n")))
query("per_document", with_ctes(("results",), "SELECT document_id, round(avg(score), 6) AS score, count(*)::BIGINT AS n FROM results GROUP BY 1"))(lambda s, f: frame("results", s, f).groupBy("document_id").agg(F.round(F.avg("score"), 6).alias("score"), F.count(one).alias("n")))
query("denominator_sensitivity", with_ctes(("judged",), "SELECT round(avg(em::INT), 6) AS every, round(avg(em::INT) FILTER (NOT abstained), 6) AS kept, round(round(avg(em::INT) FILTER (NOT abstained), 6) - round(avg(em::INT), 6), 6) AS delta, count(*) FILTER (abstained) AS excluded FROM judged"))(
    lambda s, f: frame("judged", s, f).agg(avg_if("true").alias("every"), avg_if("NOT abstained").alias("kept"), F.count_if("abstained").alias("excluded")).withColumn("delta", F.round(c("kept") - c("every"), 6))
)
CONF = {"abstained": "abstained", "correct": "NOT abstained AND answerable AND em", "incorrect": "NOT abstained AND answerable AND NOT em", "spurious": "NOT abstained AND NOT answerable"}
counts = lambda conds: [F.count_if(F.expr(v)).alias(k) for k, v in conds.items()]
counts_sql = lambda conds: ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in conds.items())
query("abstention_confusion", with_ctes(("judged",), f"SELECT answerable, {counts_sql(CONF)} FROM judged GROUP BY 1"))(lambda s, f: frame("judged", s, f).groupBy("answerable").agg(*counts(CONF)))
query("abstention_score", with_ctes(("judged",), f"SELECT category, {avg_sql('answerable')} AS em, {avg_sql('answerable', 'abstained::INT')} AS false_abstention, {avg_sql('NOT answerable', '(NOT abstained)::INT')} AS spurious, {avg_sql('true', '(NOT abstained)::INT')} AS coverage FROM judged GROUP BY 1"))(
    lambda s, f: frame("judged", s, f).groupBy("category").agg(avg_if("answerable").alias("em"), avg_if("answerable", c("abstained").cast("int")).alias("false_abstention"), avg_if("NOT answerable", (~c("abstained")).cast("int")).alias("spurious"), avg_if("true", (~c("abstained")).cast("int")).alias("coverage"))
)
query("gate_deltas", with_ctes(("results",), "SELECT category, round(avg(score) FILTER (arm = 'O') - avg(score) FILTER (arm = 'F'), 6) AS delta FROM results GROUP BY 1"))(lambda s, f: frame("results", s, f).groupBy("category").agg(F.round(F.avg(F.when(c("arm") == "O", c("score"))) - F.avg(F.when(c("arm") == "F", c("score"))), 6).alias("delta")))
query("metric_delta", with_ctes(("results",), "SELECT question_id, round(avg(score) FILTER (arm = 'O') - avg(score) FILTER (arm = 'F'), 6) AS delta FROM results GROUP BY 1 HAVING count(DISTINCT arm) = 2"))(
    lambda s, f: frame("results", s, f).groupBy("question_id").agg(F.avg(F.when(c("arm") == "O", c("score"))).alias("a"), F.avg(F.when(c("arm") == "F", c("score"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select("question_id", F.round(c("a") - c("b"), 6).alias("delta"))
)
DECIDE = "CASE WHEN delta < -5 THEN 'HARMFUL' WHEN delta > 5 THEN 'PROMISING' ELSE 'NEUTRAL' END"
query("decide", with_ctes(("results",), f"SELECT document_id, {DECIDE} AS decision FROM (SELECT document_id, round(avg(score) FILTER (arm = 'O') - avg(score) FILTER (arm = 'F'), 6) AS delta FROM results GROUP BY 1)"))(
    lambda s, f: frame("results", s, f).groupBy("document_id").agg(F.round(F.avg(F.when(c("arm") == "O", c("score"))) - F.avg(F.when(c("arm") == "F", c("score"))), 6).alias("delta")).select("document_id", F.expr(DECIDE).alias("decision"))
)
query("corpus_summary", with_ctes((), "SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2"))(lambda s, f: table(s, f, "documents").groupBy("lang", "source").agg(F.count(one).alias("n"), F.sum("n_chars").alias("chars")))
query("dataset_stats", with_ctes(("judged",), "SELECT category, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM judged), 6) AS ratio FROM judged GROUP BY 1"))(
    lambda s, f: frame("judged", s, f).groupBy("category").agg(F.count(one).alias("n")).withColumn("ratio", F.round(c("n") / F.sum("n").over(Window.partitionBy()), 6))
)
query("index_readiness", with_ctes(("paths",), "SELECT count(*)::BIGINT AS n, count(*) FILTER (heading <> '') AS with_path, count(*) FILTER (len(string_split(heading, '>')) > 1) AS nested, count(*) FILTER (is_heading) AS headings FROM paths"))(
    lambda s, f: frame("paths", s, f).agg(F.count(one).alias("n"), F.count_if(c("heading") != "").alias("with_path"), F.count_if(F.size(F.split("heading", ">")) > 1).alias("nested"), F.count_if("is_heading").alias("headings"))
)
query("summarize_pipeline", with_ctes(("results",), "SELECT category, round(avg(score), 6) AS mean, quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95 FROM results GROUP BY 1"))(
    lambda s, f: frame("results", s, f).groupBy("category").agg(F.round(F.avg("score"), 6).alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY score)").alias("p95"))
)
query("percentile_nearest", with_ctes(("chunks",), "SELECT topic, quantile_disc(token_count, 0.9) AS p90 FROM chunks GROUP BY 1"))(lambda s, f: frame("chunks", s, f).groupBy("topic").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY token_count)").cast("long").alias("p90")))
query("percentile_linear", with_ctes(("chunks",), "SELECT topic, round(quantile_cont(token_count::DOUBLE, 0.9), 6) AS p90 FROM chunks GROUP BY 1"))(lambda s, f: frame("chunks", s, f).groupBy("topic").agg(F.round(F.expr("percentile(token_count, 0.9)"), 6).alias("p90")))
W = "(p + 3.8416 / (2 * n)) / (1 + 3.8416 / n)", "1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)"
query("wilson_interval", with_ctes(("results",), f"SELECT document_id, round({W[0]} - {W[1]}, 6) AS low, round({W[0]} + {W[1]}, 6) AS high FROM (SELECT document_id, avg(correct::INT) AS p, count(*)::DOUBLE AS n FROM results GROUP BY 1)"))(
    lambda s, f: _wilson(frame("results", s, f).groupBy("document_id").agg(F.count_if("correct").alias("h"), F.count(one).alias("n")))
)


def _wilson(x):
    low, high = S.wilson(c("h"), c("n"))
    return x.select("document_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


RANKS = "rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0::DOUBLE"
query("rank_average", with_ctes(("results",), f"SELECT rid, {RANKS} AS avg_rank FROM results"))(lambda s, f: S.with_average_rank(frame("results", s, f).select("rid", "category", "score"), "score", ["category"]).select("rid", "avg_rank"))
AUC = f"SELECT category, s - p * (p + 1) / 2.0::DOUBLE AS u, p, n FROM (SELECT category, sum(r) FILTER (correct) AS s, count(*) FILTER (correct) AS p, count(*) FILTER (NOT correct) AS n FROM (SELECT category, correct, {RANKS} AS r FROM results) GROUP BY 1)"
query("roc_auc", with_ctes(("results",), f"SELECT category, round(u / (p * n), 6) AS roc_auc FROM ({AUC})"))(lambda s, f: S.auc(frame("results", s, f), "score", "correct", ["category"]).select("category", F.round("roc_auc", 6).alias("roc_auc")))
query("mann_whitney_u", with_ctes(("results",), f"SELECT category, u FROM ({AUC})"))(lambda s, f: S.auc(frame("results", s, f), "score", "correct", ["category"]).select("category", "u"))
query("average_precision", with_ctes(("ranked",), "SELECT question_id, round(avg(hits::DOUBLE / rank) FILTER (gold), 6) AS ap FROM (SELECT *, sum(gold::INT) OVER (PARTITION BY question_id ORDER BY rank) AS hits FROM ranked) GROUP BY 1"))(
    lambda s, f: frame("ranked", s, f).withColumn("hits", F.sum(c("gold").cast("int")).over(Window.partitionBy("question_id").orderBy("rank"))).groupBy("question_id").agg(F.round(F.avg(F.when(c("gold"), c("hits") / c("rank"))), 6).alias("ap"))
)
query("overlap_coefficient", with_ctes(("results",), "SELECT category, round(sum(least(a, b)), 6) AS overlap FROM (SELECT category, bin, count(*) FILTER (correct)::DOUBLE / any_value(p) AS a, count(*) FILTER (NOT correct)::DOUBLE / any_value(n) AS b FROM (SELECT category, correct, least(9, floor((score - 1) / 4.9::DOUBLE))::INT AS bin, count(*) FILTER (correct) OVER (PARTITION BY category) AS p, count(*) FILTER (NOT correct) OVER (PARTITION BY category) AS n FROM results) GROUP BY 1, 2) GROUP BY 1"))(
    lambda s, f: _overlap(frame("results", s, f))
)


def _overlap(r):
    bins = r.withColumn("bin", F.least(F.lit(9), F.floor((c("score") - 1) / 4.9))).groupBy("category", "bin").agg(F.count_if("correct").alias("a"), F.count_if(~c("correct")).alias("b"))
    total = Window.partitionBy("category")
    shares = bins.select("category", (c("a") / F.sum("a").over(total)).alias("a"), (c("b") / F.sum("b").over(total)).alias("b"))
    return shares.groupBy("category").agg(F.round(F.sum(F.least("a", "b")), 6).alias("overlap"))


query("pearson", with_ctes(("results",), "SELECT category, round(corr(score, confidence), 6) AS r FROM results GROUP BY 1"))(lambda s, f: frame("results", s, f).groupBy("category").agg(F.round(F.corr("score", "confidence"), 6).alias("r")))
query("spearman_matrix", with_ctes(("results",), "SELECT category, round(corr(a, b), 6) AS rho FROM (SELECT category, rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY category ORDER BY confidence) + (count(*) OVER (PARTITION BY category, confidence) - 1) / 2.0::DOUBLE AS b FROM results) GROUP BY 1"))(
    lambda s, f: S.spearman(frame("results", s, f), "score", "confidence", ["category"]).select("category", F.round("rho", 6).alias("rho"))
)
query("cohen_d", with_ctes(("results",), "SELECT category, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM (SELECT category, avg(score) FILTER (correct) AS m1, avg(score) FILTER (NOT correct) AS m0, var_samp(score) FILTER (correct) AS v1, var_samp(score) FILTER (NOT correct) AS v0, count(*) FILTER (correct) AS n1, count(*) FILTER (NOT correct) AS n0 FROM results GROUP BY 1)"))(
    lambda s, f: frame("results", s, f).groupBy("category").agg(*[g(F.when(k, c("score"))).alias(a + n) for n, k in (("1", c("correct")), ("0", ~c("correct"))) for a, g in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]).select("category", F.round((c("m1") - c("m0")) / F.sqrt(((c("n1") - 1) * c("v1") + (c("n0") - 1) * c("v0")) / (c("n1") + c("n0") - 2)), 6).alias("d"))
)
query("ks_stat", with_ctes(("results",), "SELECT category, round(max(abs(a - b)), 6) AS ks FROM (SELECT category, sum(p) OVER w / sum(p) OVER t AS a, sum(n) OVER w / sum(n) OVER t AS b FROM (SELECT category, score, count(*) FILTER (correct)::DOUBLE AS p, count(*) FILTER (NOT correct)::DOUBLE AS n FROM results GROUP BY 1, 2) WINDOW w AS (PARTITION BY category ORDER BY score), t AS (PARTITION BY category)) GROUP BY 1"))(
    lambda s, f: frame("results", s, f).groupBy("category", "score").agg(F.count_if("correct").alias("p"), F.count_if(~c("correct")).alias("n")).select("category", *[(F.sum(k).over(Window.partitionBy("category").orderBy("score")) / F.sum(k).over(Window.partitionBy("category"))).alias(k) for k in ("p", "n")]).groupBy("category").agg(F.round(F.max(F.abs(c("p") - c("n"))), 6).alias("ks"))
)
query("quantile_direction", with_ctes(("results",), "SELECT category, round(quantile_cont(score, 0.5) FILTER (correct), 6) AS correct_median, round(quantile_cont(score, 0.5) FILTER (NOT correct), 6) AS wrong_median FROM results GROUP BY 1"))(
    lambda s, f: frame("results", s, f).groupBy("category").agg(F.round(F.percentile(F.when(c("correct"), c("score")), F.lit(0.5)), 6).alias("correct_median"), F.round(F.percentile(F.when(~c("correct"), c("score")), F.lit(0.5)), 6).alias("wrong_median"))
)
query("topk_share", with_ctes(("results",), "SELECT category, round(sum(t) FILTER (r <= 10) / sum(t), 6) AS share FROM (SELECT category, document_id, sum(score) AS t, row_number() OVER (PARTITION BY category ORDER BY sum(score) DESC, document_id) AS r FROM results GROUP BY 1, 2) GROUP BY 1"))(
    lambda s, f: frame("results", s, f).groupBy("category", "document_id").agg(F.sum("score").alias("t")).withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("t"), "document_id"))).groupBy("category").agg(F.round(F.sum(F.when(c("r") <= 10, c("t"))) / F.sum("t"), 6).alias("share"))
)
query("cumulative_curve", with_ctes(("results",), "SELECT category, document_id, round(sum(t) OVER (PARTITION BY category ORDER BY t DESC, document_id) / sum(t) OVER (PARTITION BY category), 6) AS curve FROM (SELECT category, document_id, sum(score) AS t FROM results GROUP BY 1, 2)"))(
    lambda s, f: frame("results", s, f).groupBy("category", "document_id").agg(F.sum("score").alias("t")).select("category", "document_id", F.round(F.sum("t").over(Window.partitionBy("category").orderBy(F.desc("t"), "document_id")) / F.sum("t").over(Window.partitionBy("category")), 6).alias("curve"))
)
query("rrf_threshold", with_ctes((), "SELECT k::INT AS k, top::INT AS top, round((k + 1)::DOUBLE / (2 * k + top + 1), 6) AS weight FROM range(10, 101, 10) a(k), range(1, 11) b(top)"))(
    lambda s, f: s.range(10, 101, 10).select(c("id").cast("int").alias("k")).join(F.broadcast(s.range(1, 11).select(c("id").cast("int").alias("top")))).withColumn("weight", F.round((c("k") + 1) / (2 * c("k") + c("top") + 1), 6))
)
query("rank_abstain_k", with_ctes(("results",), "SELECT category, rid FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, rid) AS r FROM results) WHERE r <= 25"))(lambda s, f: frame("results", s, f).withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "rid"))).where("r <= 25").select("category", "rid"))
query("confidence_separation", with_ctes(("results",), "SELECT category, round(avg(confidence) FILTER (correct), 6) AS right_mean, round(avg(confidence) FILTER (NOT correct), 6) AS wrong_mean, min(confidence) FILTER (correct) AS right_min, max(confidence) FILTER (NOT correct) AS wrong_max FROM results GROUP BY 1"))(
    lambda s, f: frame("results", s, f).groupBy("category").agg(F.round(F.avg(F.when(c("correct"), c("confidence"))), 6).alias("right_mean"), F.round(F.avg(F.when(~c("correct"), c("confidence"))), 6).alias("wrong_mean"), F.min(F.when(c("correct"), c("confidence"))).alias("right_min"), F.max(F.when(~c("correct"), c("confidence"))).alias("wrong_max"))
)
STAGES = ["true", "score >= 5", "score >= 10", "score >= 20", "confidence > 0.02", "confidence > 0.04", "correct", "correct AND answerable"]
query("retrieval_funnel", with_ctes(("results",), "SELECT category, " + ", ".join(f"count(*) FILTER ({' AND '.join(STAGES[: i + 1])}) AS s{i}" for i in range(8)) + " FROM results GROUP BY 1"))(lambda s, f: frame("results", s, f).groupBy("category").agg(*[F.count_if(F.expr(" AND ".join(STAGES[: i + 1]))).alias(f"s{i}") for i in range(8)]))
ARMS = "SELECT question_id, min(CASE WHEN arm = 'O' AND correct THEN rid % 10 END) AS a, min(CASE WHEN arm = 'F' AND correct THEN rid % 10 END) AS b FROM results GROUP BY 1"
EFFECT = "CASE WHEN a IS NOT NULL AND (b IS NULL OR a < b) THEN 'beneficial' WHEN b IS NOT NULL AND (a IS NULL OR a > b) THEN 'harmful' ELSE 'neutral' END"
arms = lambda s, f: frame("results", s, f).groupBy("question_id").agg(*[F.min(F.when((c("arm") == k) & c("correct"), c("rid") % 10)).alias(n) for n, k in (("a", "O"), ("b", "F"))])
query("ranking_effects", with_ctes(("results",), f"SELECT question_id, {EFFECT} AS effect, a - b AS delta FROM ({ARMS})"))(lambda s, f: arms(s, f).select("question_id", F.expr(EFFECT).alias("effect"), (c("a") - c("b")).alias("delta")))
query("ranking_influence", with_ctes(("results",), f"SELECT effect, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean_delta FROM (SELECT {EFFECT} AS effect, a - b AS delta FROM ({ARMS})) GROUP BY 1"))(lambda s, f: arms(s, f).select(F.expr(EFFECT).alias("effect"), (c("a") - c("b")).alias("delta")).groupBy("effect").agg(F.count(one).alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta")))
query("answer_transitions", with_ctes(("results",), "SELECT was, now, count(*)::BIGINT AS n FROM (SELECT question_id, bool_or(correct) FILTER (arm = 'F') AS was, bool_or(correct) FILTER (arm = 'O') AS now FROM results WHERE answerable GROUP BY 1) WHERE was IS NOT NULL AND now IS NOT NULL GROUP BY 1, 2"))(
    lambda s, f: frame("results", s, f).where("answerable").groupBy("question_id").agg(F.bool_or(F.when(c("arm") == "F", c("correct"))).alias("was"), F.bool_or(F.when(c("arm") == "O", c("correct"))).alias("now")).where("was IS NOT NULL AND now IS NOT NULL").groupBy("was", "now").agg(F.count(one).alias("n"))
)
query("failure_distribution", with_ctes(("results",), "SELECT category, count(*) FILTER (NOT correct) AS failures, round(count(*) FILTER (NOT correct)::DOUBLE / count(*), 6) AS rate FROM results GROUP BY 1"))(lambda s, f: frame("results", s, f).groupBy("category").agg(F.count_if(~c("correct")).alias("failures"), F.round(F.count_if(~c("correct")) / F.count(one), 6).alias("rate")))
query("chunk_stats", with_ctes(("chunks",), "SELECT topic, count(*)::BIGINT AS n, min(token_count) AS least, max(token_count) AS most, round(avg(token_count), 6) AS mean, round(median(token_count), 6) AS median, round(count(*) FILTER (token_count > 256)::DOUBLE / count(*), 6) AS over FROM chunks WHERE token_count > 0 GROUP BY 1"))(
    lambda s, f: frame("chunks", s, f).where("token_count > 0").groupBy("topic").agg(F.count(one).alias("n"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 6).alias("mean"), F.round(F.median("token_count"), 6).alias("median"), F.round(F.count_if(c("token_count") > 256) / F.count(one), 6).alias("over"))
)
query("derive_gold_chunks", with_ctes(("lines",), "SELECT b.item_id, count(*)::BIGINT AS gold FROM benchmark b JOIN lines l ON contains(lower(l.content), lower(b.text)) GROUP BY 1"))(
    lambda s, f: scoring.contained(frame("lines", s, f).select(c("chunk_id").alias("text_id"), F.lower("content").alias("text")), table(s, f, "benchmark").select("item_id", F.lower("text").alias("item"))).groupBy("item_id").agg(F.count(one).alias("gold"))
)
query("confirmation_split", with_ctes(("judged",), "SELECT example_id, CASE WHEN (row_number() OVER (PARTITION BY answerable, category ORDER BY example_id) - 1) % 2 = 0 THEN 'held_out' ELSE 'development' END AS part FROM judged"))(
    lambda s, f: frame("judged", s, f).select("example_id", F.when((F.row_number().over(Window.partitionBy("answerable", "category").orderBy("example_id")) - 1) % 2 == 0, "held_out").otherwise("development").alias("part"))
)
BUCKETS = "CASE WHEN NOT abstained AND em THEN 'answered' WHEN NOT abstained AND trim(gold) = '' THEN 'without_claims' WHEN abstained AND answerable THEN 'withheld' WHEN abstained THEN 'gate_abstention' ELSE 'other' END"
query("quality_buckets", with_ctes(("judged",), f"SELECT {BUCKETS} AS bucket, count(*)::BIGINT AS n FROM judged GROUP BY 1"))(lambda s, f: frame("judged", s, f).groupBy(F.expr(BUCKETS).alias("bucket")).agg(F.count(one).alias("n")))
query("verdict_rollup", with_ctes(("judged",), "SELECT category, count(*) FILTER (em) AS supported, round(count(*) FILTER (em)::DOUBLE / count(*), 4) AS citation_accuracy, CASE WHEN count(*) FILTER (em) = count(*) THEN 'VERIFIED' WHEN count(*) FILTER (em) > 0 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS status FROM judged GROUP BY 1"))(
    lambda s, f: frame("judged", s, f).groupBy("category").agg(F.count_if("em").alias("supported"), F.count(one).alias("n")).select("category", "supported", F.round(c("supported") / c("n"), 4).alias("citation_accuracy"), F.when(c("supported") == c("n"), "VERIFIED").when(c("supported") > 0, "PARTIAL").otherwise("UNSUPPORTED").alias("status"))
)
CC = {"tp": "correct AND answerable", "fp": "correct AND NOT answerable", "fn": "NOT correct AND answerable", "tn": "NOT correct AND NOT answerable"}
F1 = "round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1"
query("claim_confusion", with_ctes(("results",), f"SELECT category, tp, fp, fn, tn, {F1} FROM (SELECT category, {counts_sql(CC)} FROM results GROUP BY 1)"))(
    lambda s, f: frame("results", s, f).groupBy("category").agg(*counts(CC)).select("*", F.round(c("tp") / (c("tp") + c("fp")), 6).alias("precision"), F.round(c("tp") / (c("tp") + c("fn")), 6).alias("recall"), F.round(2.0 * c("tp") / (2 * c("tp") + c("fp") + c("fn")), 6).alias("f1"))
)
query("extraction_preservation", with_ctes((), "SELECT lang, round(sum(least(e, x))::DOUBLE / sum(e), 6) AS preserved FROM (SELECT lang, len(string_split(text, chr(10))) AS e, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS x FROM documents) GROUP BY 1"))(
    lambda s, f: table(s, f, "documents").select("lang", F.size(F.split("text", "\n")).alias("e"), F.size(F.filter(F.split("text", "\n"), lambda l: F.trim(l) != "")).alias("x")).groupBy("lang").agg(F.round(F.sum(F.least("e", "x")) / F.sum("e"), 6).alias("preserved"))
)
query("context_utilisation", with_ctes(("chunks",), "SELECT document_id, round(least(1.0::DOUBLE, sum(token_count) / 4000.0::DOUBLE), 6) AS used FROM chunks GROUP BY 1"))(lambda s, f: frame("chunks", s, f).groupBy("document_id").agg(F.round(F.least(F.lit(1.0), F.sum("token_count") / 4000.0), 6).alias("used")))
query("evidence_coverage", with_ctes(("ranked",), "SELECT question_id, count(*) FILTER (gold AND rank <= 3) AS supplied, count(*) FILTER (gold) AS gold FROM ranked GROUP BY 1"))(lambda s, f: frame("ranked", s, f).groupBy("question_id").agg(F.count_if(c("gold") & (c("rank") <= 3)).alias("supplied"), F.count_if("gold").alias("gold")))
query("path_counts", with_ctes(("results",), "SELECT category, arm, count(*)::BIGINT AS n FROM results GROUP BY 1, 2"))(lambda s, f: frame("results", s, f).groupBy("category", "arm").agg(F.count(one).alias("n")))
query("path_agreement", with_ctes(("results",), "SELECT question_id, count(DISTINCT arm) = 2 AS agreed FROM results GROUP BY 1"))(lambda s, f: frame("results", s, f).groupBy("question_id").agg((F.count_distinct("arm") == 2).alias("agreed")))
query("dup_rate", with_ctes((), "SELECT source, round(1 - count(DISTINCT text)::DOUBLE / count(*), 6) AS rate FROM documents GROUP BY 1"))(lambda s, f: table(s, f, "documents").groupBy("source").agg(F.round(1 - F.count_distinct("text") / F.count(one), 6).alias("rate")))

# Dataset gates
FLOORS = "CASE WHEN n >= 300 THEN 'ok' WHEN n >= 120 THEN 'low' ELSE 'missing' END"
query("category_floors", with_ctes((), f"SELECT lang, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct, {FLOORS} AS status FROM (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1)"))(
    lambda s, f: table(s, f, "documents").groupBy("lang").agg(F.count(one).alias("n")).select("lang", "n", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"), F.expr(FLOORS).alias("status"))
)
FIRST5 = "array_to_string(string_split(text, ' ')[1:5], ' ')"
query("category_diversity", with_ctes((), f"SELECT lang, count(DISTINCT {FIRST5}) AS templates, count(DISTINCT substr(text, 1, 80)) AS contexts, count(DISTINCT source) AS sources FROM documents GROUP BY 1"))(
    lambda s, f: table(s, f, "documents").groupBy("lang").agg(F.count_distinct(F.array_join(F.slice(F.split("text", " "), 1, 5), " ")).alias("templates"), F.count_distinct(F.substring("text", 1, 80)).alias("contexts"), F.count_distinct("source").alias("sources"))
)
query("doc_category_matrix", with_ctes((), "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{k}') AS {k}" for k in ("en", "fr", "de", "es")) + " FROM documents GROUP BY 1"))(lambda s, f: table(s, f, "documents").groupBy("source").agg(*[F.count_if(c("lang") == k).alias(k) for k in ("en", "fr", "de", "es")]))
query("exact_dups", with_ctes((), "SELECT sha256(text) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1"))(lambda s, f: table(s, f, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(one).alias("n")).where("n > 1"))


SPLIT = "CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::BIGINT % 10 < 8 THEN 'train' WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::BIGINT % 10 = 8 THEN 'val' ELSE 'test' END"
bucket10 = lambda: F.conv(F.substring(F.sha2(c("doc_id").cast("string"), 256), 1, 4), 16, 10).cast("long") % 10
split = lambda: F.when(bucket10() < 8, "train").when(bucket10() == 8, "val").otherwise("test")
query("doc_splits", with_ctes((), f"SELECT doc_id, {SPLIT} AS part FROM documents"))(lambda s, f: table(s, f, "documents").select("doc_id", split().alias("part")))
query("train_val_split", with_ctes((), f"SELECT part, count(*)::BIGINT AS n FROM (SELECT CASE WHEN {SPLIT} = 'train' THEN 'train' ELSE 'val' END AS part FROM documents) GROUP BY 1"))(lambda s, f: table(s, f, "documents").groupBy(F.when(split() == "train", "train").otherwise("val").alias("part")).agg(F.count(one).alias("n")))
query("cross_split_pair_join", with_ctes((), f"WITH p AS (SELECT doc_id, sha256(text) AS h, {SPLIT} AS part FROM documents) SELECT a.doc_id AS one, b.doc_id AS two FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id AND a.part <> b.part"))(lambda s, f: _cross(table(s, f, "documents").select("doc_id", F.sha2("text", 256).alias("h"), split().alias("part"))))


def _cross(p):
    return p.alias("a").join(p.alias("b"), F.expr("a.h = b.h AND a.doc_id < b.doc_id AND a.part <> b.part")).select(c("a.doc_id").alias("one"), c("b.doc_id").alias("two"))


query("kind_except", with_ctes((), f"SELECT lang, source FROM (SELECT DISTINCT lang, source FROM documents WHERE {SPLIT} <> 'train' EXCEPT SELECT DISTINCT lang, source FROM documents WHERE {SPLIT} = 'train' AND doc_id % 3 = 0)"))(
    lambda s, f: table(s, f, "documents").where(split() != "train").select("lang", "source").subtract(table(s, f, "documents").where((split() == "train") & (c("doc_id") % 3 == 0)).select("lang", "source"))
)
ISSUES = {"short_answer": "length(predicted) < 10", "no_question_mark": "NOT contains(predicted, '?')", "few_words": "len(string_split(predicted, ' ')) < 4", "empty_gold": "gold = ''"}
query("structural_validation", with_ctes(("answers",), "SELECT example_id, concat_ws(',', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in ISSUES.items()) + ") AS issues FROM answers"))(
    lambda s, f: frame("answers", s, f).select("example_id", F.concat_ws(",", F.when(F.length("predicted") < 10, "short_answer"), F.when(~c("predicted").contains("?"), "no_question_mark"), F.when(F.size(F.split("predicted", " ")) < 4, "few_words"), F.when(c("gold") == "", "empty_gold")).alias("issues"))
)
for _name, _by in (("stratified_audit", "category"), ("table_cell_audit", "source"), ("high_risk_audit", "answerable")):
    query(_name, with_ctes(("answers",), f"SELECT {_by}, count(*) FILTER (gold = '') AS empty, count(*) FILTER (length(predicted) < 30) AS short, round(avg((gold <> '')::INT), 6) AS pass_rate FROM answers GROUP BY 1"))(
        lambda s, f, _by=_by: frame("answers", s, f).groupBy(_by).agg(F.count_if(c("gold") == "").alias("empty"), F.count_if(F.length("predicted") < 30).alias("short"), F.round(F.avg((c("gold") != "").cast("int")), 6).alias("pass_rate"))
    )
FIX = "CASE WHEN gold = '' THEN predicted ELSE trim(gold) END"
query("fix_failures", with_ctes(("answers",), f"SELECT example_id, {FIX} AS gold, {FIX} <> gold AS changed FROM answers"))(lambda s, f: frame("answers", s, f).select("example_id", F.expr(FIX).alias("gold"), F.expr(f"{FIX} <> gold").alias("changed")))
query("remediate", with_ctes(("answers",), f"SELECT category, count(*) FILTER ({FIX} <> gold) AS changed FROM answers GROUP BY 1"))(lambda s, f: frame("answers", s, f).groupBy("category").agg(F.count_if(F.expr(f"{FIX} <> gold")).alias("changed")))
LEDGER = "CASE WHEN em AND abstained THEN 'over_abstained' WHEN em THEN 'correct' WHEN abstained THEN 'abstained' WHEN gold = '' THEN 'unanswerable_text' ELSE 'wrong_span' END"
query("error_ledger", with_ctes(("judged",), f"SELECT example_id, {LEDGER} AS cause FROM judged"))(lambda s, f: frame("judged", s, f).select("example_id", F.expr(LEDGER).alias("cause")))
query("blind_review_pack", with_ctes(("answers",), "SELECT sha256('blind' || example_id) AS blind_id, predicted, row_number() OVER (ORDER BY sha256('blind' || example_id)) AS place FROM answers"))(
    lambda s, f: frame("answers", s, f).select(F.sha2(F.concat(F.lit("blind"), c("example_id").cast("string")), 256).alias("blind_id"), "predicted").withColumn("place", F.row_number().over(Window.orderBy("blind_id")).cast("long"))
)
query("dataset_integrity", with_ctes((), "SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (length(text) <> n_chars) AS bad_lengths, count(*) FILTER (text IS NULL) AS no_text FROM documents"))(lambda s, f: table(s, f, "documents").agg(F.count(one).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.length("text") != c("n_chars")).alias("bad_lengths"), F.count_if(c("text").isNull()).alias("no_text")))
query("dataset_hash", with_ctes((), "SELECT source, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1"))(
    lambda s, f: table(s, f, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))).alias("x")).select("source", F.sha2(F.array_join(F.transform("x", lambda y: y["h"]), ","), 256).alias("digest"))
)
