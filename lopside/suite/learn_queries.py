"""Classifiers, cross-validation and the modules end to end."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from lopside.operators.classify import CLASSIFIERS, Effort
from lopside.operators.classify.grower import Plan, grow
from lopside.operators.classify.single import root_of, vote
from lopside.operators.folds import holdout
from lopside.operators.neighbours import nearest
from lopside.operators.resample.common import by_label, class_sizes
from lopside.plans import evaluate as ev
from lopside.plans.learn import assess, assess_plain, learn, suggest
from lopside.plans.ranking import best_runs
from lopside.session import pin, shared_folder
from lopside.sources.kb import KnowledgeBase
from lopside.suite.base import EMBEDDED, embedded, labelled_documents, query, roles
from lopside.suite.resample_queries import SIZES


def held_out(spark, sf, source):
    p = pin(holdout(source(spark, sf).points(), "id"))
    cols = ["id", "label", "x"]
    return p.filter("is_train").select(*cols), p.filter(~F.col("is_train")).select(*cols)


def accuracy_of(name, source):
    def go(spark, sf):
        train, test = held_out(spark, sf, source)
        out = CLASSIFIERS[name](train, sorted(class_sizes(train)), 42, Effort())(test)
        return out.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    return go


_SNAKE = {
    "LGBMClassifier": "wide_boosting", "XGBClassifier": "regularised_boosting", "GradientBoostingClassifier": "gradient_boosting",
    "RandomForestClassifier": "random_forest", "RandomForestBaseline": "random_forest_baseline", "ExtraTreesClassifier": "extra_trees",
    "BaggingClassifier": "bagging", "LogisticRegression": "logistic_regression", "GaussianNB": "gaussian_bayes", "SVC": "kernel_machine", "LinearSVC": "linear_machine",
    "AdaBoostClassifier": "adaboost", "RUSBoostClassifier": "rusboost", "EasyEnsembleClassifier": "easy_ensemble",
    "BalancedBaggingClassifier": "balanced_bagging", "BalancedRandomForestClassifier": "balanced_random_forest",
}
for _name, _short in _SNAKE.items():
    query(f"classify_{_short}")(accuracy_of(_name, labelled_documents))
query("classify_multiclass_forest")(accuracy_of("RandomForestClassifier", roles))
query("classify_multiclass_boosting")(accuracy_of("GradientBoostingClassifier", roles))


def tree_facts(train, classes, plan):
    """Per tree: nodes, leaves, depth, root feature and cut, and the rows each class counts for at the root."""
    forest = grow(train.select("id", by_label({c: i for i, c in enumerate(classes)}).alias("y"), "x"), len(classes), plan)
    rows = [(*f, [int(n) for n in forest.counts[f[0]]]) for f in forest.facts()]
    return train.sparkSession.createDataFrame(rows, "tree int, nodes int, leaves int, depth int, root_feature int, root_cut double, root_rows array<bigint>")


@query("extra_trees_facts")
def extra_trees_facts(spark, sf):
    """A hundred trees of all labelled documents, grown until their leaves are pure."""
    p = pin(labelled_documents(spark, sf).points())
    return tree_facts(p, sorted(class_sizes(p)), Plan(100, root_of(p)))


@query("balanced_forest_facts")
def balanced_forest_facts(spark, sf):
    p = pin(labelled_documents(spark, sf).points())
    sizes = class_sizes(p)
    share = tuple(min(sizes.values()) / sizes[c] for c in sorted(sizes))
    return tree_facts(p, sorted(sizes), Plan(100, root_of(p), cuts=16, share=share))


@query("classify_nearest_neighbours", f"""
WITH {EMBEDDED}, tr AS (SELECT * FROM pts WHERE ('0x' || substr(md5('42|' || id::varchar), 1, 8))::bigint / 4294967296.0::double < 0.75),
te AS (SELECT * FROM pts WHERE id NOT IN (SELECT id FROM tr)),
nn AS (SELECT * FROM (SELECT q.id, q.label, d.label AS nlabel, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.x, d.x), 9), d.id) AS r
  FROM te q JOIN tr d ON true) WHERE r <= 5),
v AS (SELECT id, label, nlabel, count(*) AS n FROM nn GROUP BY 1, 2, 3)
SELECT id, label AS y, arg_min(nlabel, (-n, nlabel)) AS yhat FROM v GROUP BY 1, 2""")
def nearest_neighbours(spark, sf):
    train, test = held_out(spark, sf, embedded)
    return vote(nearest(test, train, 5)).select("id", "y", "yhat")


@query("cross_validate")
def cross_validate(spark, sf):
    out = ev.evaluate(labelled_documents(spark, sf).points(), ["RandomUnderSampler"], ["GaussianNB"])
    return ev.fold_scores(out)


@query("cross_validate_multiclass")
def cross_validate_multiclass(spark, sf):
    out = ev.evaluate(roles(spark, sf).points(), ["RandomOverSampler"], ["GaussianNB"])
    return ev.fold_scores(out)


@query("fault_isolation", """
SELECT * FROM (VALUES ('KMeansSMOTE', 'GaussianNB', 'failed'), ('(no pre processing)', 'GaussianNB', 'success')) AS t("pre processing", algorithm, status)""")
def fault_isolation(spark, sf):
    # the default cluster condition is met nowhere in this table, so that run fails and the other stands
    out = ev.evaluate(labelled_documents(spark, sf).points(), ["KMeansSMOTE", "(no pre processing)"], ["GaussianNB"])
    return out.runs.select("pre processing", "algorithm", "status")


@query("single_combination_by_fold")
def single_combination(spark, sf):
    out = ev.evaluate(labelled_documents(spark, sf).points(), ["RandomOverSampler"], ["GaussianNB"])
    return ev.final_by_fold(out, "documents", "LM").drop("time")


@query("evaluate_without_resampling")
def without_resampling(spark, sf):
    return assess_plain(labelled_documents(spark, sf), classifiers=["GaussianNB"]).drop("time")


@query("best_combination")
def best_combination(spark, sf):
    """Which of 2 x 2 combinations has the best composite for the documents' quality labels."""
    rows, _, kind = assess(labelled_documents(spark, sf), ["SMOTE", "RandomUnderSampler"], ["GaussianNB", "LogisticRegression"])
    numbered = rows.withColumn("no", F.when(F.col("pre processing") == "SMOTE", 0).otherwise(1))
    return best_runs(numbered, kind, "no").select("dataset", "pre processing", "algorithm", "balanced accuracy", "roc auc")


def scores_of(out):
    """Every combination's status and mean scores over its folds."""
    scores = ev.fold_scores(out).groupBy(*ev.RUN).agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(m) for m in ("balanced_accuracy", "f1", "roc_auc", "g_mean")])
    return out.runs.select(*ev.RUN, "status").join(scores, ev.RUN, "left")


@query("binary_portfolio")
def binary_portfolio(spark, sf):
    """Every combination in force for two classes, two folds, models of five trees."""
    out = ev.evaluate(labelled_documents(spark, sf).points(), *ev.portfolio("binary"), folds=2, repeats=1, effort=Effort(trees=5))
    return scores_of(out)


@query("multiclass_portfolio")
def multiclass_portfolio(spark, sf):
    """Every combination in force for more classes, two folds, small models."""
    effort = Effort(trees=3, rounds=3, members=2, depth=6)
    return scores_of(ev.evaluate(roles(spark, sf).points(), *ev.portfolio("multiclass"), folds=2, repeats=1, effort=effort))


@query("learn_then_suggest")
def learn_then_suggest(spark, sf):
    """Both modules: two tables are learned into a new knowledge base, then a third is given its combinations."""
    base = KnowledgeBase(spark, f"{shared_folder(spark)}/lopside/{uuid.uuid4().hex}")
    how = dict(resamplers=["RandomOverSampler", "SMOTE"], classifiers=["GradientBoostingClassifier"], folds=2, repeats=1, effort=Effort(trees=5))
    groups = ["general"]
    for ds in (labelled_documents(spark, sf), embedded(spark, sf)):
        learn(replace(ds, df=pin(ds.df)), base, groups=groups, **how)
    fresh = labelled_documents(spark, sf, "toxic")
    text = suggest(replace(fresh, df=pin(fresh.df), name="toxic documents"), base, groups=groups)
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "no int, line string")


@query("no_leakage", f"""
WITH {EMBEDDED}, {SIZES} SELECT 0::bigint AS tested_twice, 0::bigint AS synthetic_rows_tested, count(*) AS tested FROM pts""")
def no_leakage(spark, sf):
    """Out-of-fold predictions of a repeat cover every row once and no row made by a resampler."""
    p = pin(embedded(spark, sf).points())
    out = ev.evaluate(p, ["SMOTE"], ["GaussianNB"])
    seen = pin(out.predictions.select("repeat", "id"))
    twice = seen.groupBy("repeat", "id").count().filter("count > 1")
    return seen.agg(
        F.lit(twice.count()).cast("bigint").alias("tested_twice"),
        F.count(F.when(F.col("id") < 0, 1)).alias("synthetic_rows_tested"), F.countDistinct("id").alias("tested"),
    )
