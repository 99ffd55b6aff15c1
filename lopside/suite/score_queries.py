"""Metrics, folds, the knowledge base, ranking, recommendation and tests."""

import math

from pyspark.sql import functions as F

from lopside.functions import metrics, stats
from lopside.functions.draws import uniform, uniform_sql
from lopside.functions.scalars import (
    basename, clean_suffix, estimator_name, euclidean, format_hms, mean_of, min_max_row, parse_hms, report_line, round3, std_of,
    verdict,
)
from lopside.operators.folds import holdout, stratified_folds
from lopside.plans import ranking, recommend
from lopside.session import parallelism
from lopside.sources import kb
from lopside.suite.base import document_points_sql, labelled_documents, query, table


def r3(e):
    return f"(round_even(({e}) * 1000, 0) / 1000)"


# ---- a prediction table derived from the orders -----------------------------------------

def binary_predictions(spark, sf):
    o = table(spark, sf, "orders")
    score = F.round((F.col("o_totalprice") / 550000 + uniform(7, F.col("o_orderkey"))) / 2, 3)
    return o.select(
        (F.col("o_custkey") % 3).alias("run"), (F.col("o_orderkey") % 10).alias("fold"), "o_orderkey",
        F.when(F.col("o_totalprice") > 400000, "1").otherwise("0").alias("y"), score.alias("score"),
        F.when(score >= 0.6, "1").otherwise("0").alias("yhat"),
    )


BIN = f"""preds AS (SELECT o_custkey % 3 AS run, o_orderkey % 10 AS fold, o_orderkey,
  CASE WHEN o_totalprice > 400000 THEN '1' ELSE '0' END AS y,
  round((o_totalprice / 550000 + {uniform_sql(7, 'o_orderkey')}) / 2, 3) AS score FROM orders),
p AS (SELECT *, CASE WHEN score >= 0.6 THEN '1' ELSE '0' END AS yhat FROM preds)"""

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # the levels of the column


def multi_predictions(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    level = F.array(*[F.lit(p) for p in PRIORITIES])
    guess = F.element_at(level, (F.floor(uniform(8, key) * 5) + 1).cast("int"))
    parts = [F.round(uniform(9, key, F.lit(p)) + F.when(F.col("o_orderpriority") == p, 0.4).otherwise(0.0), 3) for p in PRIORITIES]
    return o.select(
        (F.col("o_custkey") % 2).alias("run"), (key % 5).alias("fold"), F.col("o_orderpriority").alias("y"),
        F.when(uniform(10, key) < 0.6, F.col("o_orderpriority")).otherwise(guess).alias("yhat"),
        F.map_from_arrays(level, F.array(*parts)).alias("scores"),
    )


MULTI = f"""p AS (SELECT o_custkey % 2 AS run, o_orderkey % 5 AS fold, o_orderkey, o_orderpriority AS y,
  CASE WHEN {uniform_sql(10, 'o_orderkey')} < 0.6 THEN o_orderpriority
    ELSE {PRIORITIES}[floor({uniform_sql(8, 'o_orderkey')} * 5)::int + 1] END AS yhat FROM orders)"""

CLASSES = """cls AS (SELECT run, fold, label, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
  SELECT run, fold, y AS label, 1 AS support, 0 AS predicted, (y = yhat)::int AS hits FROM p
  UNION ALL SELECT run, fold, yhat, 0, 1, 0 FROM p) GROUP BY 1, 2, 3),
c AS (SELECT *, coalesce(hits / nullif(predicted, 0)::double, 0) AS prec, coalesce(hits / nullif(support, 0)::double, 0) AS rec,
  coalesce(2 * hits / nullif(support + predicted, 0)::double, 0) AS f FROM cls),
s AS (SELECT run, fold, sum(support)::double AS n, sum(hits)::double AS h, sum(support * predicted)::double AS e,
  sum(support * support)::double AS t2, sum(predicted * predicted)::double AS p2,
  avg(rec) FILTER (support > 0) AS balanced_accuracy, avg(prec) AS precision_macro, avg(rec) AS recall_macro,
  avg(f) AS f1_macro, sum(f * support) / sum(support) AS f1_weighted,
  CASE WHEN min(rec) > 0 THEN exp(avg(CASE WHEN rec > 0 THEN ln(rec) END)) ELSE 0 END AS g_all,
  max(rec) FILTER (label = '1') AS sens, max(rec) FILTER (label = '0') AS spec, max(f) FILTER (label = '1') AS f1_pos
  FROM c GROUP BY 1, 2),
m AS (SELECT *, h / n AS accuracy, (h / n - e / (n * n)) / (1 - e / (n * n)) AS cohen_kappa,
  (h * n - e) / (sqrt(n * n - p2) * sqrt(n * n - t2)) AS matthews_corrcoef FROM s)"""


def rounded(df, skip=()):
    out = [F.round(F.col(f.name), 6).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name)
           for f in df.schema.fields]
    return df.select(*out)


BY = ["run", "fold"]


@query("label_scores_binary", f"""
WITH {BIN}, {CLASSES} SELECT run, fold, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
  round(cohen_kappa, 6) AS cohen_kappa, round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
  round(f1_weighted, 6) AS f1_weighted, round(matthews_corrcoef, 6) AS matthews_corrcoef, round(f1_pos, 6) AS f1,
  round(sqrt(sens * spec), 6) AS g_mean FROM m""")
def label_scores_binary(spark, sf):
    return rounded(metrics.label_scores(binary_predictions(spark, sf), BY, "1"))


@query("label_scores_multiclass", f"""
WITH {MULTI}, {CLASSES} SELECT run, fold, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
  round(cohen_kappa, 6) AS cohen_kappa, round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
  round(f1_weighted, 6) AS f1_weighted, round(matthews_corrcoef, 6) AS matthews_corrcoef, round(f1_macro, 6) AS f1,
  round(g_all, 6) AS g_mean FROM m""")
def label_scores_multiclass(spark, sf):
    return rounded(metrics.label_scores(multi_predictions(spark, sf), BY))


@query("class_scores", f"""
WITH {MULTI}, {CLASSES} SELECT run, fold, label, support::bigint AS support, predicted::bigint AS predicted, hits::bigint AS hits,
  round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f, 6) AS f1 FROM c""")
def class_scores(spark, sf):
    return rounded(metrics.class_scores(metrics.confusion(multi_predictions(spark, sf), BY), BY))


@query("confusion_table", f"WITH {MULTI} SELECT run, fold, y, yhat, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, sf):
    return metrics.confusion(multi_predictions(spark, sf), BY)


RANKS = """r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY run, fold, score) - 1) / 2.0 AS rk FROM p
  WINDOW w AS (PARTITION BY run, fold ORDER BY score)),
auc AS (SELECT run, fold, (sum(rk) FILTER (y = '1') - np * (np + 1) / 2.0) / (np * (count(*) - np)) AS roc_auc FROM (
  SELECT *, count(*) FILTER (y = '1') OVER (PARTITION BY run, fold) AS np FROM r) GROUP BY run, fold, np)"""


@query("roc_auc_binary", f"WITH {BIN}, {RANKS} SELECT run, fold, round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc_binary(spark, sf):
    return rounded(metrics.roc_auc(binary_predictions(spark, sf), BY, "1"))


@query("roc_auc_hard_labels", f"""
WITH {BIN}, {CLASSES} SELECT run, fold, round(balanced_accuracy, 6) AS roc_auc FROM m""")
def roc_auc_hard(spark, sf):
    preds = binary_predictions(spark, sf).withColumn("score", F.col("yhat").cast("double"))
    return rounded(metrics.roc_auc(preds, BY, "1"))


OVR = "each AS (" + " UNION ALL ".join(
    f"""SELECT run, fold, '{p}' AS label, CASE WHEN y = '{p}' THEN '1' ELSE '0' END AS y,
  round({uniform_sql(9, 'o_orderkey', f"'{p}'")} + CASE WHEN y = '{p}' THEN 0.4::double ELSE 0.0::double END, 3) AS score FROM p"""
    for p in PRIORITIES) + """),
r AS (SELECT *, rank() OVER (PARTITION BY run, fold, label ORDER BY score)
  + (count(*) OVER (PARTITION BY run, fold, label, score) - 1) / 2.0 AS rk FROM each),
a AS (SELECT run, fold, label, count(*) FILTER (y = '1') AS np, count(*) AS n, sum(rk) FILTER (y = '1') AS s FROM r GROUP BY 1, 2, 3)"""


@query("roc_auc_one_vs_rest", f"""
WITH {MULTI}, {OVR} SELECT run, fold, round(avg((s - np * (np + 1) / 2.0) / (np * (n - np))), 6) AS roc_auc FROM a GROUP BY 1, 2""")
def roc_auc_ovr(spark, sf):
    return rounded(metrics.roc_auc_ovr(multi_predictions(spark, sf), BY))


@query("average_precision", f"""
WITH {BIN}, g AS (SELECT run, fold, score, count(*) FILTER (y = '1') AS pos, count(*) AS n FROM p GROUP BY 1, 2, 3),
u AS (SELECT *, sum(pos) OVER w AS up, sum(n) OVER w AS un FROM g WINDOW w AS (PARTITION BY run, fold ORDER BY score DESC))
SELECT run, fold, round(sum(pos * up / un::double) / sum(pos), 6) AS average_precision FROM u GROUP BY 1, 2""")
def average_precision(spark, sf):
    return rounded(metrics.average_precision(binary_predictions(spark, sf), BY, "1"))


SUMMARY = ", ".join(f"{r3(f'avg({m})')} AS {m}, {r3(f'stddev_pop({m})')} AS {m}_std" for m in metrics.BINARY)


@query("binary_run_summary", f"""
WITH {BIN}, {CLASSES}, {RANKS},
f AS (SELECT m.run, balanced_accuracy, f1_pos AS f1, roc_auc, sqrt(sens * spec) AS g_mean, cohen_kappa FROM m JOIN auc USING (run, fold))
SELECT run, {SUMMARY} FROM f GROUP BY 1""")
def binary_summary(spark, sf):
    folds = metrics.fold_scores(binary_predictions(spark, sf), BY, "binary", "1")
    return metrics.summarise(folds, ["run"], metrics.BINARY)


MORE = ["precision_macro", "recall_macro", "f1_weighted", "matthews_corrcoef"]


@query("multiclass_run_summary", f"""
WITH {MULTI}, {CLASSES}, x AS (SELECT run, {', '.join(f"{r3(f'avg({m})')} AS {m}, {r3(f'stddev_pop({m})')} AS {m}_std" for m in MORE)}
  FROM m GROUP BY 1)
SELECT *, {r3('(((precision_macro + recall_macro) + f1_weighted) + matthews_corrcoef) / 4')} AS final_score FROM x""")
def multiclass_summary(spark, sf):
    folds = metrics.label_scores(multi_predictions(spark, sf), BY)
    out = metrics.summarise(folds, ["run"], MORE)
    return out.withColumn("final_score", round3(metrics.composite("multiclass")))


@query("fold_final_scores", f"""
WITH {BIN}, {CLASSES}, {RANKS},
f AS (SELECT run, fold, [balanced_accuracy, f1_pos, roc_auc, sqrt(sens * spec), cohen_kappa] AS v FROM m JOIN auc USING (run, fold))
SELECT run, fold, {r3('list_avg(v)')} AS final_score, {r3('list_stddev_pop(v)')} AS final_score_std FROM f""")
def fold_final_scores(spark, sf):
    folds = metrics.fold_scores(binary_predictions(spark, sf), BY, "binary", "1")
    cols = [F.col(m) for m in metrics.BINARY]
    return folds.select("run", "fold", round3(mean_of(*cols)).alias("final_score"), round3(std_of(*cols)).alias("final_score_std"))


@query("train_and_test_scores", f"""
WITH {BIN.replace("o_orderkey % 10 AS fold", "(o_orderkey % 4 = 0) AS fold")}, {CLASSES}
SELECT run, fold AS is_test, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM m""")
def train_scores(spark, sf):
    preds = binary_predictions(spark, sf).withColumn("is_test", F.col("o_orderkey") % 4 == 0)
    return rounded(metrics.label_scores(preds, ["run", "is_test"], "1").select("run", "is_test", "accuracy", "balanced_accuracy"))


# ---- folds ------------------------------------------------------------------------------------

def fold_sql(r):
    draw = f"('0x' || substr(md5('42|' || doc_id::varchar || '|{r}'), 1, 8))::bigint"
    return f"""SELECT doc_id, quality, {r} AS repeat,
  ((row_number() OVER (PARTITION BY quality ORDER BY {draw}, doc_id) - 1) % 10)::int AS fold FROM labels"""


@query("stratified_folds", " UNION ALL ".join(fold_sql(r) for r in range(3)))
def folds(spark, sf):
    return stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("fold_numbering", f"""
WITH f AS ({' UNION ALL '.join(fold_sql(r) for r in range(3))})
SELECT repeat * 10 + fold + 1 AS fold_no, quality, count(*) AS n FROM f GROUP BY 1, 2""")
def fold_numbering(spark, sf):
    f = stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")
    return f.groupBy((F.col("repeat") * 10 + F.col("fold") + 1).alias("fold_no"), "quality").agg(F.count(F.lit(1)).alias("n"))


@query("holdout_split", f"SELECT event_id, {uniform_sql(42, 'event_id')} < 0.75 AS is_train FROM events")
def holdout_split(spark, sf):
    return holdout(table(spark, sf, "events").select("event_id"), "event_id")


# ---- a knowledge base derived from the orders ----------------------------------------------------

RESAMPLER_NAMES = ["RandomOverSampler", "SMOTE", "SVMSMOTE", "SMOTETomek", "ADASYN", "NearMiss", "SMOTEENN"]
CLASSIFIER_NAMES = ["LGBMClassifier", "XGBClassifier", "GradientBoostingClassifier", "RandomForestClassifier", "SVC"]


def full_results(spark, sf):
    """One result per order: dataset = customer, combination and scores from the key."""
    key = F.col("o_orderkey")
    names = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(key / step) % len(values) + 1).cast("int"))
    cols = []
    for m in kb.BINARY_METRICS:
        cols.append(F.round(0.4 + 0.6 * uniform(42, key, F.lit(m)), 3).alias(m))
        cols.append(F.round(0.1 * uniform(42, key, F.lit(m + " std")), 3).alias(f"{m} std"))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("customer "), "o_custkey").alias("dataset"), names(RESAMPLER_NAMES, 1).alias("pre processing"),
        names(CLASSIFIER_NAMES, 7).alias("algorithm"), F.round(F.col("o_totalprice") / 10000, 3).alias("time"), *cols,
    )
    return rows.withColumn("final score", kb.stored_score("binary"))


_METRIC_SQL = ",\n  ".join(
    f"""round(0.4 + 0.6 * {uniform_sql(42, 'o_orderkey', f"'{m}'")}, 3) AS "{m}", round(0.1 * {uniform_sql(42, 'o_orderkey', f"'{m} std'")}, 3) AS "{m} std\""""
    for m in kb.BINARY_METRICS)
_SUM = " + ".join(f'"{m}"' for m in kb.BINARY_METRICS)
FULL = f"""full0 AS (SELECT o_orderkey, 'customer ' || o_custkey AS dataset, {RESAMPLER_NAMES}[o_orderkey % 7 + 1] AS "pre processing",
  {CLASSIFIER_NAMES}[o_orderkey // 7 % 5 + 1] AS algorithm, round(o_totalprice / 10000, 3) AS time,
  {_METRIC_SQL} FROM orders),
full_kb AS (SELECT *, {r3(f"({_SUM}) / 5")} AS "final score" FROM full0)"""
_ALL = ", ".join(f'"{c}"' for c in kb.KEYS + kb._with_std(kb.BINARY_METRICS))
KEEP = kb.KEYS + kb._with_std(kb.BINARY_METRICS)


@query("composite_scores", f'WITH {FULL} SELECT o_orderkey, "final score" AS final_score FROM full_kb')
def composite_scores(spark, sf):
    return full_results(spark, sf).select("o_orderkey", F.col("final score").alias("final_score"))


@query("composite_skips_nulls", f"""
WITH {FULL}, h AS (SELECT o_orderkey, [CASE WHEN o_orderkey % 3 <> 0 THEN "balanced accuracy" END,
  CASE WHEN o_orderkey % 5 <> 0 THEN "f1 score" END, CASE WHEN o_orderkey % 15 <> 0 THEN "roc auc" END] AS v FROM full_kb)
SELECT o_orderkey, {r3('list_avg(v)')} AS final_score FROM h""")
def composite_nulls(spark, sf):
    key = F.col("o_orderkey")
    v = [F.when(key % k != 0, F.col(f"`{m}`")) for k, m in ((3, "balanced accuracy"), (5, "f1 score"), (15, "roc auc"))]
    return full_results(spark, sf).select("o_orderkey", round3(mean_of(*v)).alias("final_score"))


BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ({_SUM}) / 5 DESC, o_orderkey) AS r
  FROM {{src}}) WHERE r = 1)"""


_FIVE = ", ".join(f'"{m}"' for m in kb.BINARY_METRICS)


@query("row_score_and_deviation", f"""
WITH {FULL} SELECT o_orderkey, "final score" AS score, {r3(f"list_stddev_pop([{_FIVE}])")} AS deviation FROM full_kb""")
def row_score(spark, sf):
    scored = kb.score_rows(full_results(spark, sf).drop("final score"))
    return scored.select("o_orderkey", F.col("final score").alias("score"), F.col("final score std").alias("deviation"))


@query("best_run_per_dataset", f"""
WITH {FULL}, {BEST.format(src='full_kb')} SELECT dataset, "pre processing", algorithm, "final score" FROM best""")
def best_run(spark, sf):
    return ranking.best_runs(full_results(spark, sf), "binary", "o_orderkey").select("dataset", "pre processing", "algorithm", "final score")


def old_and_new(spark, sf):
    full = full_results(spark, sf)
    old = ranking.best_runs(full.filter("o_orderkey % 2 = 0"), "binary", "o_orderkey").select(*[F.col(f"`{c}`") for c in KEEP])
    new = ranking.best_runs(full.filter("o_orderkey % 2 = 1"), "binary", "o_orderkey").select(*[F.col(f"`{c}`") for c in KEEP])
    return old, new


OLD_NEW = ", ".join([FULL] + [
    BEST.format(src=f"(SELECT * FROM full_kb WHERE o_orderkey % 2 = {i})").replace("best AS", f"{n} AS")
    for i, n in ((0, "old"), (1, "new"))])
MERGED = f"""merged AS (SELECT CASE WHEN o.dataset IS NULL THEN 'insert' WHEN n."final score" > o."final score" THEN 'update' ELSE 'keep' END AS action,
  o, n, o.dataset AS od, n.dataset AS nd FROM old o FULL JOIN new n ON o.dataset = n.dataset)"""


@query("upsert_results", f"""
WITH {OLD_NEW}, {MERGED}
SELECT {_ALL}, action FROM (SELECT unnest(CASE WHEN action = 'keep' THEN o ELSE n END), action FROM merged)""")
def upsert_results(spark, sf):
    old, new = old_and_new(spark, sf)
    return kb.upsert_results(old, new, "binary")


@query("insert_full_results", f"""
WITH {FULL} SELECT {_ALL}, "final score" FROM full_kb WHERE o_orderkey % 2 = 0
UNION ALL SELECT {_ALL}, "final score" FROM full_kb WHERE o_orderkey % 2 = 1
  AND dataset NOT IN (SELECT dataset FROM full_kb WHERE o_orderkey % 2 = 0)""")
def insert_full(spark, sf):
    full = full_results(spark, sf)
    cols = [F.col(f"`{c}`") for c in KEEP + ["final score"]]
    stored = full.filter("o_orderkey % 2 = 0").select(*cols)
    new = full.filter("o_orderkey % 2 = 1").drop("o_orderkey", "final score")
    return kb.insert_full_results(stored, new, "binary")


@query("multiclass_payload", f"""
WITH {FULL} SELECT o_orderkey, {', '.join(f'NULL::double AS "{c}"' for c in kb._with_std(kb.BINARY_METRICS))}, "final score",
  "roc auc" AS "multiclass matthews corrcoef" FROM full_kb""")
def payload(spark, sf):
    full = full_results(spark, sf).withColumn("multiclass matthews corrcoef", F.col("roc auc"))
    return kb.payload(full, "multiclass").drop("dataset", "pre processing", "algorithm", "time")


@query("kb_fixed_layout", f"""
WITH {FULL} SELECT {_ALL}, {', '.join(f'NULL::double AS "{c}"' for c in kb._with_std(kb.MULTICLASS_METRICS))},
  NULL::varchar AS "total elapsed time" FROM full_kb""")
def fixed_layout(spark, sf):
    return kb.with_columns(full_results(spark, sf), kb.RESULT_COLUMNS)


@query("current_row_lookup", f"""
WITH {OLD_NEW} SELECT n.dataset, n."final score" AS now, o."final score" AS was FROM new n LEFT JOIN old o ON o.dataset = n.dataset""")
def lookup(spark, sf):
    old, new = old_and_new(spark, sf)
    old = old.select("dataset", kb.stored_score("binary").alias("was"))
    return new.select("dataset", kb.stored_score("binary").alias("now")).join(old, "dataset", "left")


@query("weak_metric_rows", f"""
WITH {FULL} SELECT o_orderkey FROM full_kb WHERE least({', '.join(f'"{m}"' for m in kb.BINARY_METRICS)}) < 0.5""")
def weak(spark, sf):
    return kb.weak_rows(full_results(spark, sf)).select("o_orderkey")


def _listed(names):
    return ", ".join(f"'{n}'" for n in names)


@query("prune_resamplers", f"""
WITH {FULL} SELECT o_orderkey, "pre processing" FROM full_kb WHERE "pre processing" NOT IN ({_listed(ranking.WEAK_RESAMPLERS)})""")
def prune_resamplers(spark, sf):
    return kb.prune(full_results(spark, sf), "pre processing", ranking.WEAK_RESAMPLERS).select("o_orderkey", "pre processing")


@query("prune_classifiers", f"""
WITH {FULL} SELECT o_orderkey, algorithm FROM full_kb WHERE algorithm NOT IN ({_listed(ranking.WEAK_CLASSIFIERS)})""")
def prune_classifiers(spark, sf):
    return kb.prune(full_results(spark, sf), "algorithm", ranking.WEAK_CLASSIFIERS).select("o_orderkey", "algorithm")


@query("prune_datasets", f"""
WITH {FULL} SELECT dataset, count(*) AS n FROM full_kb WHERE dataset NOT IN ('customer 1', 'customer 2', 'customer 3') GROUP BY 1""")
def prune_datasets(spark, sf):
    return ranking.dataset_counts(kb.prune(full_results(spark, sf), "dataset", ["customer 1", "customer 2", "customer 3"]))


@query("pick_stored_combinations", f"""
WITH {FULL}, {BEST.format(src='full_kb')} SELECT f.o_orderkey FROM full_kb f
WHERE (dataset, "pre processing", algorithm) IN (SELECT (dataset, "pre processing", algorithm) FROM best)""")
def pick_stored(spark, sf):
    full = full_results(spark, sf)
    keys = ["dataset", "pre processing", "algorithm"]
    wanted = ranking.best_runs(full, "binary", "o_orderkey").select(*keys)
    return full.join(wanted, keys, "left_semi").select("o_orderkey")


POSITIONS = f"""pos AS (SELECT *, row_number() OVER (ORDER BY "final score" DESC,
  ('0x' || substr(md5('42|' || o_orderkey::varchar), 1, 8))::bigint, o_orderkey) - 1 AS position FROM full_kb)"""


_NULLS = """(SELECT * REPLACE (CASE WHEN o_orderkey % 11 <> 0 THEN "final score" END AS "final score") FROM full_kb)"""


@query("kb_positions", f"""
WITH {FULL}, {POSITIONS.replace('"final score" DESC', '"final score" DESC NULLS LAST').replace('FROM full_kb', f'FROM {_NULLS}')}
SELECT o_orderkey, position FROM pos""")
def kb_positions(spark, sf):
    full = full_results(spark, sf).withColumn("final score", F.when(F.col("o_orderkey") % 11 != 0, F.col("final score")))
    return ranking.positions(full, "o_orderkey").select("o_orderkey", "position")


@query("rank_sum_resamplers", f"""
WITH {FULL}, {POSITIONS} SELECT "pre processing", sum(position)::bigint AS score FROM pos GROUP BY 1 ORDER BY score""")
def rank_sum_resamplers(spark, sf):
    return ranking.rank_sums(full_results(spark, sf), "pre processing", "o_orderkey").orderBy("score")


@query("rank_sum_classifiers", f"WITH {FULL}, {POSITIONS} SELECT algorithm, sum(position)::bigint AS score FROM pos GROUP BY 1")
def rank_sum_classifiers(spark, sf):
    return ranking.rank_sums(full_results(spark, sf), "algorithm", "o_orderkey")


@query("rank_sum_quartiles", f"""
WITH {FULL}, {POSITIONS}, s AS (SELECT "pre processing", sum(position)::double AS score FROM pos GROUP BY 1)
SELECT quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.75) AS q75 FROM s""")
def rank_sum_quartiles(spark, sf):
    return ranking.score_quantiles(ranking.rank_sums(full_results(spark, sf), "pre processing", "o_orderkey"))


@query("reduced_portfolio", f"""
WITH {FULL}, {POSITIONS}, s AS (SELECT "pre processing" AS p, sum(position)::double AS score FROM pos GROUP BY 1)
SELECT "pre processing", count(*) AS n FROM full_kb WHERE "pre processing" IN (
  SELECT p FROM s WHERE score <= (SELECT quantile_cont(score, 0.75) FROM s)) GROUP BY 1""")
def reduced_portfolio(spark, sf):
    return ranking.reduce_portfolio(full_results(spark, sf), "pre processing", "o_orderkey").groupBy("pre processing").agg(
        F.count(F.lit(1)).alias("n"))


@query("kb_dataset_counts", f"WITH {FULL} SELECT dataset, count(*) AS n FROM full_kb GROUP BY 1")
def kb_dataset_counts(spark, sf):
    return ranking.dataset_counts(full_results(spark, sf))


@query("kb_number_of_datasets", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def kb_number_of_datasets(spark, sf):
    return full_results(spark, sf).agg(F.countDistinct("dataset").alias("n"))


# ---- characteristics: wide rows of customers ---------------------------------------------------------

N_FEATURES = 12


def characteristics(spark, sf):
    """Meta-feature rows per customer; feature 5 has nulls and feature 6 infinities."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    feats = [F.round(uniform(42, key, F.lit(f"f{i}")) * 10 ** (i % 4), 6).alias(f"f{i}") for i in range(N_FEATURES)]
    rows = c.select(
        F.concat(F.lit("customer "), key).alias("dataset"), *feats,
        F.when(key % 9 == 4, "?").otherwise(F.element_at(F.array(*[F.lit(v) for v in RESAMPLER_NAMES]), (key % 7 + 1).cast("int"))).alias("pre processing"),
        F.when(key % 9 == 4, "?").otherwise(F.element_at(F.array(*[F.lit(v) for v in CLASSIFIER_NAMES]), (key % 5 + 1).cast("int"))).alias("algorithm"),
    )
    rows = rows.withColumn("f5", F.when(F.col("f0") > 0.1, F.col("f5")))
    return rows.withColumn("f6", F.when(F.col("f0") < 0.1, float("inf")).otherwise(F.col("f6")))


_FEATS = ", ".join(f"round({uniform_sql(42, 'c_custkey', f"'f{i}'")} * {10 ** (i % 4)}, 6) AS f{i}" for i in range(N_FEATURES))
_USED = [f"f{i}" for i in range(N_FEATURES) if i not in (5, 6)]
CHAR = f"""ch AS (SELECT c_custkey, 'customer ' || c_custkey AS dataset, {_FEATS},
  CASE WHEN c_custkey % 9 = 4 THEN '?' ELSE {RESAMPLER_NAMES}[c_custkey % 7 + 1] END AS "pre processing",
  CASE WHEN c_custkey % 9 = 4 THEN '?' ELSE {CLASSIFIER_NAMES}[c_custkey % 5 + 1] END AS algorithm FROM customer),
sc AS (SELECT dataset, "pre processing", algorithm, ('0x' || substr(md5(dataset), 1, 15))::bigint AS key,
  [(v - list_min(x)) / (list_max(x) - list_min(x)) for v in x] AS x FROM (SELECT *, [{', '.join(_USED)}] AS x FROM ch))"""


@query("row_min_max", f"""
WITH {CHAR} SELECT dataset, round(list_sum(x), 6) AS total, round(list_max(x), 6) AS top FROM sc""")
def row_min_max(spark, sf):
    x = min_max_row(F.array(*_USED))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return characteristics(spark, sf).select("dataset", F.round(total, 6).alias("total"), F.round(F.array_max(x), 6).alias("top"))


@query("kb_complete_features", f"WITH {CHAR} SELECT dataset, {', '.join(_USED)} FROM ch")
def complete_features(spark, sf):
    from lopside.operators.prep import drop_incomplete_columns

    return drop_incomplete_columns(characteristics(spark, sf).drop("pre processing", "algorithm"))


@query("kb_distances", f"""
WITH {CHAR}, q AS (SELECT x AS qx FROM sc WHERE dataset = 'customer 7')
SELECT dataset, "pre processing", algorithm, round(list_distance(x, qx), 6) AS distance FROM sc, q
WHERE dataset <> 'customer 7' AND "pre processing" <> '?'""")
def kb_distances(spark, sf):
    return rounded(recommend.distances_to(characteristics(spark, sf), "customer 7"))


TOP = """d AS (SELECT *, list_distance(x, qx) AS distance FROM sc, q WHERE dataset <> 'customer 7' {cond}),
one AS (SELECT *, row_number() OVER (PARTITION BY "pre processing", algorithm ORDER BY distance, key) AS r FROM d),
top AS (SELECT *, row_number() OVER (ORDER BY distance, key)::int AS rank FROM one WHERE r = 1 ORDER BY distance, key LIMIT 3)"""
ONE_Q = "q AS (SELECT x AS qx FROM sc WHERE dataset = 'customer 7')"


@query("recommend", f"""
WITH {CHAR}, {ONE_Q}, {TOP.format(cond='''AND "pre processing" <> '?' ''')}
SELECT rank, "pre processing", algorithm, dataset, round(distance, 6) AS distance FROM top""")
def recommend_one(spark, sf):
    return rounded(recommend.recommend(characteristics(spark, sf), "customer 7"))


@query("recommend_strict", f"""
WITH {CHAR}, {ONE_Q}, {TOP.format(cond='')}
SELECT rank, "pre processing", algorithm, dataset, round(distance, 6) AS distance FROM top""")
def recommend_strict(spark, sf):
    return rounded(recommend.recommend(characteristics(spark, sf), "customer 7", strict=True))


@query("recommended_pairs", f"""
WITH {CHAR}, {ONE_Q}, {TOP.format(cond='''AND "pre processing" <> '?' ''')} SELECT "pre processing", algorithm FROM top""")
def recommended_pairs(spark, sf):
    return recommend.recommend(characteristics(spark, sf), "customer 7").select("pre processing", "algorithm")


@query("recommendation_report", f"""
WITH {CHAR}, {ONE_Q}, {TOP.format(cond='''AND "pre processing" <> '?' ''')}
SELECT 0 AS rank, rpad('Rank', 7, ' ') || ' ' || rpad('Pre Processing', 25, ' ') || ' ' || rpad('Algorithm', 25, ' ') AS line
UNION ALL SELECT rank, lpad(rank::varchar, 7, ' ') || ' ' || rpad("pre processing", 25, ' ') || ' ' || rpad(algorithm, greatest(25, length(algorithm))::int, ' ') FROM top""")
def recommendation_report(spark, sf):
    return recommend.report(recommend.recommend(characteristics(spark, sf), "customer 7"))


@query("recommend_all_datasets", f"""
WITH {CHAR}, d AS (SELECT a.dataset, b.dataset AS neighbour, b."pre processing", b.algorithm, b.key,
  round(list_distance(a.x, b.x), 9) AS distance FROM sc a JOIN sc b ON a.dataset <> b.dataset AND b."pre processing" <> '?'),
one AS (SELECT *, row_number() OVER (PARTITION BY dataset, "pre processing", algorithm ORDER BY distance, key) AS r FROM d),
top AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY distance, key)::int AS rank FROM one WHERE r = 1)
SELECT dataset, neighbour, "pre processing", algorithm, round(distance, 6) AS distance, rank FROM top WHERE rank <= 3""")
def recommend_all(spark, sf):
    return rounded(recommend.recommend_all(characteristics(spark, sf)))


@query("upsert_characteristics_learned", f"""
WITH {CHAR}, new AS (SELECT * FROM ch WHERE c_custkey % 2 = 0), stored AS (SELECT * FROM ch WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0)
SELECT n.dataset, n.f0 + 1 AS f0, CASE WHEN s.dataset IS NULL OR n.c_custkey % 4 = 0 THEN 'SMOTE' ELSE s."pre processing" END AS "pre processing",
  CASE WHEN s.dataset IS NULL OR n.c_custkey % 4 = 0 THEN 'SVC' ELSE s.algorithm END AS algorithm
FROM new n LEFT JOIN stored s USING (dataset)
UNION ALL SELECT dataset, f0, "pre processing", algorithm FROM stored WHERE dataset NOT IN (SELECT dataset FROM new)""")
def upsert_characteristics(spark, sf):
    ch = characteristics(spark, sf).select("dataset", "f0", "pre processing", "algorithm")
    no = F.substring_index("dataset", " ", -1).cast("int")
    stored, new = ch.filter((no % 2 == 1) | (no % 3 == 0)), ch.filter(no % 2 == 0).select("dataset", (F.col("f0") + 1).alias("f0"))
    best = new.select("dataset", F.lit("SMOTE").alias("pre processing"), F.lit("SVC").alias("algorithm"), (no % 4 == 0).alias("updated"))
    return kb.upsert_characteristics(stored, new, best).select("dataset", "f0", "pre processing", "algorithm")


@query("upsert_characteristics_recommended", f"""
WITH {CHAR}, new AS (SELECT * FROM ch WHERE c_custkey % 2 = 0), stored AS (SELECT * FROM ch WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0)
SELECT dataset, f0 + 1 AS f0, '?' AS "pre processing", '?' AS algorithm FROM new WHERE dataset NOT IN (SELECT dataset FROM stored)
UNION ALL SELECT dataset, f0, "pre processing", algorithm FROM stored""")
def upsert_characteristics_seen(spark, sf):
    ch = characteristics(spark, sf).select("dataset", "f0", "pre processing", "algorithm")
    no = F.substring_index("dataset", " ", -1).cast("int")
    stored, new = ch.filter((no % 2 == 1) | (no % 3 == 0)), ch.filter(no % 2 == 0).select("dataset", (F.col("f0") + 1).alias("f0"))
    return kb.upsert_characteristics(stored, new, None).select("dataset", "f0", "pre processing", "algorithm")


_EACH = [f"f{i}" for i in range(N_FEATURES)]
DATASETS_A_TASK = 50_000


@query("characteristics_wide_row", f"""
WITH {CHAR} SELECT dataset, {', '.join(c for c in _EACH if c not in ('f5', 'f6'))}, CASE WHEN f0 > 0.1 THEN f5 END AS f5,
  CASE WHEN f0 < 0.1 THEN 'infinity'::double ELSE f6 END AS f6 FROM ch""")
def wide_row(spark, sf):
    # datasets are dealt out first, so a task turns a bounded number of them
    ch = characteristics(spark, sf).select("dataset", *_EACH)
    ch = ch.repartition(max(parallelism(spark), math.ceil(ch.count() / DATASETS_A_TASK)), "dataset")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _EACH]))
    long = ch.select("dataset", cells.alias("cell")).select("dataset", "cell.*")
    return long.groupBy("dataset").agg(*[F.first(F.when(F.col("feature") == c, F.col("value")), ignorenulls=True).alias(c) for c in _EACH])


# ---- fold scores of three systems --------------------------------------------------------------------

def fold_results(spark, sf):
    """30 fold scores per nation and system, in steps of 0.01 so that ties occur."""
    nations = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("nation "), "n_nationkey").alias("dataset"))
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("size"))
    apps = F.explode(F.array(*[F.struct(F.lit(a).alias("output app"), F.lit(s).alias("lift")) for a, s in (("LM", 0.04), ("RM", 0.02), ("TPOT", 0.0))]))
    rows = nations.join(per, "n_nationkey").select("*", apps.alias("a")).select("n_nationkey", "dataset", "size", "a.*")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("fold"))
    noise = uniform(11, F.col("n_nationkey"), F.when(F.col("n_nationkey") % 8 == 3, F.lit("x")).otherwise(F.col("output app")), F.col("fold"))
    lift = F.when(F.col("n_nationkey") % 8 == 3, 0.0).otherwise(F.col("lift"))
    score = F.round(0.6 + lift + 0.2 * noise + (F.col("size") % 7) / 100, 2)
    return rows.select("dataset", F.lit("SMOTE").alias("pre processing"), F.lit("SVC").alias("algorithm"), "output app", "fold",
                       score.alias("final score"))


SHT = f"""base AS (SELECT n_nationkey, 'nation ' || n_nationkey AS dataset, count(*) AS size
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
sht AS (SELECT dataset, app AS "output app", fold, round(0.6::double
    + CASE WHEN n_nationkey % 8 = 3 THEN 0.0::double ELSE lift::double END
    + 0.2::double * {uniform_sql(11, 'n_nationkey', "CASE WHEN n_nationkey % 8 = 3 THEN 'x' ELSE app END", 'fold')}
    + (size % 7) / 100::double, 2) AS score
  FROM base, (VALUES ('LM', 0.04), ('RM', 0.02), ('TPOT', 0.0)) a(app, lift), range(1, 31) r(fold))"""
PAIRS = """pr AS (SELECT 'internal' AS test, a.dataset, a.fold, a.score AS a, b.score AS b FROM sht a JOIN sht b USING (dataset, fold)
  WHERE a."output app" = 'LM' AND b."output app" = 'RM'
  UNION ALL SELECT 'external', a.dataset, a.fold, a.score, b.score FROM sht a JOIN sht b USING (dataset, fold)
  WHERE a."output app" = 'RM' AND b."output app" = 'TPOT')"""
WILCOXON = """dd AS (SELECT test, dataset, a - b AS d FROM pr),
rk AS (SELECT *, rank() OVER (PARTITION BY test, dataset ORDER BY abs(d)) + (count(*) OVER (PARTITION BY test, dataset, abs(d)) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY test, dataset, abs(d)) AS t FROM dd WHERE d <> 0),
ws AS (SELECT test, dataset, count(*)::double AS n, coalesce(sum(r) FILTER (d > 0), 0)::double AS wp, coalesce(sum(r) FILTER (d < 0), 0)::double AS wm,
  sum(t * t - 1)::double AS ties FROM rk GROUP BY 1, 2),
z AS (SELECT test, dataset, least(wp, wm) AS statistic,
  (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ws),
pv AS (SELECT *, abs(z) / sqrt(2) AS x FROM z),
er AS (SELECT test, dataset, 1 - 2 / sqrt(pi()) * exp(-x * x) * sum(exp(i * ln(2) + (2 * i + 1) * ln(x)
  - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1)))) AS pvalue FROM pv, range(0, 150) r(i) GROUP BY test, dataset, x)"""


@query("wilcoxon_signed_rank", f"""
WITH {SHT}, {PAIRS}, {WILCOXON}
SELECT k.dataset, k.test AS "test type", statistic, round(z, 6) AS z, round(pvalue, 6) AS pvalue,
  CASE WHEN pvalue IS NULL THEN 'Same distribution' WHEN pvalue > 0.05 THEN 'Same distribution (fail to reject H0)'
    ELSE 'Different distribution (reject H0)' END AS result
FROM (SELECT DISTINCT dataset, test FROM pr) k LEFT JOIN z USING (dataset, test) LEFT JOIN er USING (dataset, test)""")
def wilcoxon(spark, sf):
    return rounded(stats.compare_apps(fold_results(spark, sf)))


@query("paired_fold_scores", f"WITH {SHT}, {PAIRS} SELECT dataset, fold::int AS fold, a, b FROM pr WHERE test = 'internal'")
def paired_scores(spark, sf):
    return stats.paired(fold_results(spark, sf), "LM", "RM")


@query("friedman_test", f"""
WITH {SHT}, rk AS (SELECT *, rank() OVER (PARTITION BY dataset, fold ORDER BY score)
    + (count(*) OVER (PARTITION BY dataset, fold, score) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY dataset, fold, score) AS t FROM sht),
s AS (SELECT dataset, "output app", sum(r)::double AS r, sum(t * t - 1) AS ties FROM rk GROUP BY 1, 2),
f AS (SELECT dataset, 12 / (30 * 3 * 4.0::double) * sum(r * r) - 3 * 30 * 4 AS raw, 1 - sum(ties) / (30 * 3 * 8.0::double) AS share FROM s GROUP BY 1)
SELECT dataset, 30::bigint AS blocks, 3::bigint AS treatments, CASE WHEN share > 0 THEN round(raw / share, 6) END AS statistic,
  CASE WHEN share > 0 THEN round(exp(-raw / share / 2), 6) END AS pvalue FROM f""")
def friedman(spark, sf):
    return rounded(stats.friedman(fold_results(spark, sf), ["dataset"], "fold", "output app", "final score"))


@query("insert_fold_scores", f"""
WITH {SHT} SELECT dataset, "output app", fold::int AS fold, score AS "final score" FROM sht WHERE "output app" <> 'TPOT'
UNION ALL SELECT dataset, "output app", fold::int, score FROM sht WHERE "output app" = 'TPOT'""")
def insert_folds(spark, sf):
    rows = fold_results(spark, sf).select("dataset", "output app", "fold", "final score")
    stored = rows.filter(F.col("output app") != "TPOT")
    again = rows.filter(F.col("output app") != "LM").withColumn(
        "final score", F.when(F.col("output app") == "TPOT", F.col("final score")).otherwise(F.lit(0.0)))
    return kb.insert_absent(stored, again, ["dataset", "output app"])


@query("insert_test_results", f"""
WITH {SHT}, {PAIRS}, t AS (SELECT DISTINCT dataset, test AS "test type" FROM pr)
SELECT *, CASE WHEN "test type" = 'internal' THEN 'stored' ELSE 'new' END AS result FROM t""")
def insert_tests(spark, sf):
    tests = stats.compare_apps(fold_results(spark, sf)).select("dataset", "test type")
    stored = tests.filter(F.col("test type") == "internal").withColumn("result", F.lit("stored"))
    return kb.insert_absent(stored, tests.withColumn("result", F.lit("new")), ["dataset", "test type"])


@query("insert_baseline_results", f"""
WITH {FULL}, {BEST.format(src='full_kb')} SELECT dataset, algorithm, 'stored' AS source FROM best WHERE o_orderkey % 2 = 0
UNION ALL SELECT dataset, algorithm, 'new' FROM best WHERE o_orderkey % 2 = 1""")
def insert_baseline(spark, sf):
    best = ranking.best_runs(full_results(spark, sf), "binary", "o_orderkey").select("dataset", "algorithm", "o_orderkey")
    stored = best.filter("o_orderkey % 2 = 0").select("dataset", "algorithm", F.lit("stored").alias("source"))
    return kb.insert_absent(stored, best.select("dataset", "algorithm", F.lit("new").alias("source")), ["dataset"])


@query("learning_against_baseline", f"""
WITH {SHT}, a AS (SELECT dataset, "output app" AS app, avg(score) AS s FROM sht GROUP BY 1, 2)
SELECT l.dataset, round(l.s, 6) AS learning, round(r.s, 6) AS recommended, round(t.s, 6) AS baseline,
  round(l.s - t.s, 6) AS learning_gain, round(r.s - t.s, 6) AS recommended_gain
FROM a l JOIN a r USING (dataset) JOIN a t USING (dataset) WHERE l.app = 'LM' AND r.app = 'RM' AND t.app = 'TPOT'""")
def learning_against_baseline(spark, sf):
    from lopside.plans.compare import three_way

    means = fold_results(spark, sf).groupBy("dataset", "output app").agg(F.avg("final score").alias("score"))
    pick = lambda app: means.filter(F.col("output app") == app).select("dataset", "score")
    return rounded(three_way(pick("LM"), pick("RM"), pick("TPOT"), "score"))


@query("custom_order", """
SELECT n_nationkey, n_name, row_number() OVER (ORDER BY ((n_nationkey * 7 + 3) % 25))::int AS place FROM nation""")
def custom_order(spark, sf):
    from lopside.plans.compare import ordered_as

    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    order = sorted(range(25), key=lambda k: (k * 7 + 3) % 25)  # a hand-made order of the 25 nations
    return ordered_as(nations, "n_nationkey", order)


# ---- scalars -------------------------------------------------------------------------------------

@query("elapsed_text", """
WITH s AS (SELECT o_orderkey, round_even(o_totalprice, 0)::bigint AS s FROM orders)
SELECT o_orderkey, CASE WHEN s // 86400 = 1 THEN '1 day, ' WHEN s // 86400 > 1 THEN (s // 86400) || ' days, ' ELSE '' END
  || (s % 86400 // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') AS elapsed FROM s""")
def elapsed_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", format_hms(F.col("o_totalprice")).alias("elapsed"))


@query("elapsed_seconds", "SELECT o_orderkey, round_even(o_totalprice, 0)::double AS seconds FROM orders")
def elapsed_seconds(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", parse_hms(format_hms(F.col("o_totalprice"))).alias("seconds"))


@query("file_names", """
SELECT page_id, list_last(string_split(url, '/')) AS base, CASE WHEN regexp_matches(url, '[^/.][^/]*\\.[^./]*$')
  THEN regexp_replace(url, '(\\.[^./]*)$', '_clean\\1') ELSE url || '_clean' END AS clean FROM pages""")
def file_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", basename(F.col("url")).alias("base"), clean_suffix(F.col("url")).alias("clean"))


@query("estimator_names", """
SELECT p_partkey, string_split(p_type || '(size=' || p_size || ')', '(')[1] AS name FROM part""")
def estimator_names(spark, sf):
    text = F.concat("p_type", F.lit("(size="), "p_size", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", estimator_name(text).alias("name"))


@query("report_lines", """
SELECT p_partkey, lpad((p_size)::varchar, 7, ' ') || ' ' || rpad(p_name, greatest(25, length(p_name))::int, ' ') || ' '
  || rpad(p_brand, greatest(25, length(p_brand))::int, ' ') AS line FROM part""")
def report_lines(spark, sf):
    return table(spark, sf, "part").select("p_partkey", report_line(F.col("p_size"), F.col("p_name"), F.col("p_brand")).alias("line"))


@query("verdicts", f"""
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'Same distribution' WHEN {uniform_sql(42, 'event_id')} > 0.05
  THEN 'Same distribution (fail to reject H0)' ELSE 'Different distribution (reject H0)' END AS result FROM events""")
def verdicts(spark, sf):
    p = F.when(F.col("event_id") % 13 != 0, uniform(42, F.col("event_id")))
    return table(spark, sf, "events").select("event_id", verdict(p).alias("result"))


@query("vector_distance", f"""
WITH {document_points_sql()}, c AS (SELECT list(v ORDER BY pos) AS mid FROM (
  SELECT pos, avg(v) AS v FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM pts) GROUP BY 1))
SELECT id, round(list_distance(x, mid), 6) AS distance FROM pts, c""")
def vector_distance(spark, sf):
    p = labelled_documents(spark, sf).points()
    mid = p.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v"))
    centre = [r["v"] for r in mid.orderBy("pos").collect()]  # one number per feature
    there = F.array(*[F.lit(v) for v in centre])
    return p.select("id", F.round(euclidean(F.col("x"), there), 6).alias("distance"))
