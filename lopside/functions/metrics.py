"""Classification scores from a table of predictions.

Predictions carry grouping columns (run, fold, ...), the true label ``y``, the
predicted label ``yhat`` and optionally ``score`` (of the positive class) or
``scores`` (map label -> probability). Everything is computed from one confusion
table, or for curve areas from one row per distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.functions.scalars import mean_of, round3
from lopside.operators.ranks import BUCKET_ROWS, running
from lopside.session import pin

# The score names of a run, by problem type.
BINARY = ["balanced_accuracy", "f1", "roc_auc", "g_mean", "cohen_kappa"]
MULTICLASS = BINARY + ["precision_macro", "recall_macro", "f1_weighted", "matthews_corrcoef"]
# The scores averaged into the composite of a run.
COMPOSITE = {
    "binary": ["balanced_accuracy", "f1", "roc_auc", "g_mean", "cohen_kappa"],
    "multiclass": ["precision_macro", "recall_macro", "f1_weighted", "matthews_corrcoef"],
}


def metric_names(problem_type: str) -> list[str]:
    return MULTICLASS if problem_type == "multiclass" else BINARY


def confusion(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame, by: list[str]) -> DataFrame:
    """Per label seen on either side: hits, support (true rows) and predicted rows."""
    sides = conf.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")).select(*by, "s.*")
    return sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def class_scores(conf: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined."""
    c = per_class(conf, by)
    zero = F.lit(0.0)
    return c.withColumns({
        "precision": F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(zero),
        "recall": F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(zero),
        "f1": F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(zero),
    })


def label_scores(preds: DataFrame, by: list[str], positive: str | None = None) -> DataFrame:
    """One row per group with every score that needs predicted labels only.

    With ``positive``, f1 and g_mean are those of the positive class; without,
    f1 is the macro average and g_mean the geometric mean of all recalls.
    """
    c = class_scores(confusion(preds, by), by)
    support, predicted = F.col("support").cast("double"), F.col("predicted").cast("double")  # products outgrow a bigint
    n, hits = F.sum(support), F.sum("hits").cast("double")
    expected = F.sum(support * predicted)
    true_sq, pred_sq = F.sum(support * support), F.sum(predicted * predicted)
    spread = F.sqrt(F.greatest(n * n - pred_sq, F.lit(0.0))) * F.sqrt(F.greatest(n * n - true_sq, F.lit(0.0)))
    chance = expected / (n * n)
    found = [
        (hits / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.when(chance < 1, (hits / n - chance) / (1 - chance)).otherwise(F.lit(0.0)).alias("cohen_kappa"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        (F.sum(F.col("f1") * support) / n).alias("f1_weighted"),
        F.when(spread > 0, (hits * n - expected) / spread).otherwise(F.lit(0.0)).alias("matthews_corrcoef"),
    ]
    if positive is None:
        logs = F.avg(F.when(F.col("recall") > 0, F.log("recall")))
        found += [
            F.avg("f1").alias("f1"),
            F.when(F.min("recall") > 0, F.exp(logs)).otherwise(F.lit(0.0)).alias("g_mean"),
        ]
    else:
        is_pos = F.col("label") == F.lit(positive)
        sensitivity = F.coalesce(F.max(F.when(is_pos, F.col("recall"))), F.lit(0.0))
        negatives = F.sum(F.when(~is_pos, F.col("support")))
        false_pos = F.sum(F.when(is_pos, F.col("predicted") - F.col("hits")))
        specificity = F.when(negatives > 0, 1 - F.coalesce(false_pos, F.lit(0)) / negatives).otherwise(F.lit(0.0))
        found += [
            F.coalesce(F.max(F.when(is_pos, F.col("f1"))), F.lit(0.0)).alias("f1"),
            F.sqrt(sensitivity * specificity).alias("g_mean"),
        ]
    if by:
        return c.groupBy(*by).agg(*found)
    return c.agg(*found)


def _by_score(preds: DataFrame, by: list[str], positive: Column, measures: list[str], rows: int | None, descending: bool = False) -> DataFrame:
    """One row per score with its hits, misses and running totals; written and counted unless ``rows`` says they are few."""
    hit = F.when(positive, 1).otherwise(0)
    freq = preds.groupBy(*by, "score").agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    if rows is None or rows > BUCKET_ROWS:
        freq = pin(freq)
        rows = freq.count()
    return running(freq, by, "score", measures, rows, descending)


def roc_auc(preds: DataFrame, by: list[str], positive: str, rows: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with one class only."""
    s = _by_score(preds, by, F.col("y") == F.lit(positive), ["neg"], rows)
    below = F.col("neg_upto") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    area = F.when(pairs > 0, won / pairs).alias("roc_auc")
    return s.groupBy(*by).agg(area) if by else s.agg(area)


def average_precision(preds: DataFrame, by: list[str], positive: str, rows: int | None = None) -> DataFrame:
    """Sum over score thresholds of precision times the gain in recall."""
    s = _by_score(preds, by, F.col("y") == F.lit(positive), ["pos", "neg"], rows, descending=True)
    gain = F.sum(F.col("pos").cast("double") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto")))
    area = F.when(F.sum("pos") > 0, gain / F.sum("pos")).alias("average_precision")
    return s.groupBy(*by).agg(area) if by else s.agg(area)


def roc_auc_ovr(preds: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """Mean over classes of the one-vs-rest area, from the ``scores`` map."""
    each = preds.select(*by, "y", F.explode("scores").alias("label", "score"))
    each = each.select(*by, "label", F.when(F.col("y") == F.col("label"), "1").otherwise("0").alias("y"), "score")
    areas = roc_auc(each, [*by, "label"], "1", rows)
    area = F.avg("roc_auc").alias("roc_auc")
    return areas.groupBy(*by).agg(area) if by else areas.agg(area)


def fold_scores(preds: DataFrame, by: list[str], problem_type: str, positive: str | None = None,
                rows: int | None = None) -> DataFrame:
    """One row per group with the scores of the problem type."""
    if problem_type == "multiclass":
        labels, areas = label_scores(preds, by), roc_auc_ovr(preds, by, rows)
    else:
        labels, areas = label_scores(preds, by, positive), roc_auc(preds, by, positive, rows)
    return labels.join(areas, by).select(*by, *metric_names(problem_type))


def summarise(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation over the folds of each run, 3 decimals."""
    return scores.groupBy(*by).agg(
        *[round3(F.avg(m)).alias(m) for m in metrics],
        *[round3(F.stddev_pop(m)).alias(f"{m}_std") for m in metrics],
    )


def composite(problem_type: str) -> Column:
    """Mean of the composite's scores, nulls skipped, unrounded."""
    return mean_of(*[F.col(m) for m in COMPOSITE[problem_type]])
