"""Searching a catalogue of datasets (derived from the customers) and loading files."""

import os

from pyspark.sql import functions as F

from lopside.functions.draws import uniform, uniform_sql
from lopside.session import shared_folder
from lopside.sources import catalogue as cat
from lopside.sources import tables
from lopside.suite.base import HOLED, holed_orders, query, table


def _u(tag):
    return uniform(42, F.col("c_custkey"), F.lit(tag))


def _s(tag):
    return uniform_sql(42, "c_custkey", f"'{tag}'")


def catalogue(spark, sf):
    """One dataset per customer; some lack statistics, some have an empty class."""
    key = F.col("c_custkey")
    whole = lambda tag, low, span: (low + F.floor(_u(tag) * span)).cast("bigint")
    return table(spark, sf, "customer").select(
        key.alias("did"), F.col("c_name").alias("name"), F.when(key % 4 == 0, "deactivated").otherwise("active").alias("status"),
        (F.col("c_nationkey") % 8 + 1).cast("bigint").alias("NumberOfClasses"), whole("n", 100, 12000).alias("NumberOfInstances"),
        whole("f", 2, 80).alias("NumberOfFeatures"), F.when(key % 17 != 0, whole("maj", 100, 5000)).alias("MajorityClassSize"),
        whole("min", 0, 400).alias("MinorityClassSize"), F.when(_u("miss") < 0.5, 0).otherwise(whole("mv", 0, 300)).cast("bigint").alias("NumberOfMissingValues"),
    )


CAT = f"""cat AS (SELECT c_custkey AS did, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'deactivated' ELSE 'active' END AS status,
  (c_nationkey % 8 + 1)::bigint AS "NumberOfClasses", (100 + floor({_s('n')} * 12000))::bigint AS "NumberOfInstances",
  (2 + floor({_s('f')} * 80))::bigint AS "NumberOfFeatures",
  CASE WHEN c_custkey % 17 <> 0 THEN (100 + floor({_s('maj')} * 5000))::bigint END AS "MajorityClassSize",
  floor({_s('min')} * 400)::bigint AS "MinorityClassSize",
  CASE WHEN {_s('miss')} < 0.5 THEN 0 ELSE floor({_s('mv')} * 300)::bigint END AS "NumberOfMissingValues" FROM customer),
known AS (SELECT * FROM cat WHERE "MajorityClassSize" IS NOT NULL),
ratio AS (SELECT *, "MajorityClassSize" / "MinorityClassSize"::double AS "ImbalanceRatio" FROM known WHERE "MinorityClassSize" > 0)"""
SHOWN = ", ".join(f'"{c}"' for c in cat.SHOWN)


@query("catalogue_known", f'WITH {CAT} SELECT did, "MajorityClassSize"::double AS size FROM known')
def known(spark, sf):
    return cat.known(catalogue(spark, sf)).select("did", F.col("MajorityClassSize").cast("double").alias("size"))


@query("catalogue_imbalance_ratio", f'WITH {CAT} SELECT did, round("ImbalanceRatio", 6) AS ratio FROM ratio')
def ratio(spark, sf):
    return cat.with_ratio(cat.known(catalogue(spark, sf))).select("did", F.round("ImbalanceRatio", 6).alias("ratio"))


_WHERE = """"NumberOfClasses" BETWEEN 3 AND 50 AND "NumberOfInstances" BETWEEN 500 AND 10000
  AND "NumberOfFeatures" BETWEEN 10 AND 40 AND "ImbalanceRatio" BETWEEN 3.0 AND 100.0"""


@query("catalogue_search", f"""
WITH {CAT} SELECT {SHOWN.replace('"ImbalanceRatio"', 'round("ImbalanceRatio", 6) AS "ImbalanceRatio"')} FROM (
  SELECT * FROM ratio WHERE {_WHERE} AND "NumberOfMissingValues" = 0 ORDER BY "ImbalanceRatio" DESC, did LIMIT 100)""")
def search(spark, sf):
    return cat.search(catalogue(spark, sf)).withColumn("ImbalanceRatio", F.round("ImbalanceRatio", 6))


@query("catalogue_search_missing_allowed", f"""
WITH {CAT} SELECT did FROM (SELECT * FROM ratio WHERE {_WHERE.replace('3.0 AND 100.0', '5.0 AND 60.0')} ORDER BY "ImbalanceRatio" DESC, did LIMIT 40)""")
def search_missing(spark, sf):
    return cat.search(catalogue(spark, sf), allow_missing_values=True, min_imbalance=5.0, max_imbalance=60.0, max_results=40).select("did")


@query("catalogue_binary_candidates", f"""
WITH {CAT} SELECT did FROM cat WHERE status = 'active' AND "NumberOfClasses" = 2 AND "NumberOfInstances" > 200 AND "NumberOfInstances" < 10000
  AND "NumberOfFeatures" < 500 AND "NumberOfMissingValues" > 0""")
def candidates(spark, sf):
    return cat.binary_candidates(catalogue(spark, sf)).select("did")


@query("catalogue_imbalance_band", f"""
WITH {CAT} SELECT did AS id, "ImbalanceRatio" AS "imbalance ratio" FROM ratio WHERE "ImbalanceRatio" > 2 AND "ImbalanceRatio" <= 2.5""")
def band(spark, sf):
    r = cat.with_ratio(cat.known(catalogue(spark, sf)))
    return cat.imbalance_band(r.select(F.col("did").alias("id"), F.col("ImbalanceRatio").alias("imbalance ratio")))


@query("catalogue_imbalance_above", f"""
WITH {CAT} SELECT did AS id, "ImbalanceRatio" AS "imbalance ratio" FROM ratio WHERE "ImbalanceRatio" > 5""")
def above(spark, sf):
    r = cat.with_ratio(cat.known(catalogue(spark, sf)))
    return cat.imbalance_band(r.select(F.col("did").alias("id"), F.col("ImbalanceRatio").alias("imbalance ratio")), 5.0, None)


@query("summary_search", f"""
WITH {CAT}, s AS (SELECT name AS dataset, CASE WHEN did % 3 = 0 THEN 'regression' ELSE 'classification' END AS task, "NumberOfClasses" AS n_classes,
  "NumberOfInstances" AS n_instances, "NumberOfFeatures" AS n_features, {uniform_sql(42, 'did', "'imb'")} AS imbalance FROM cat)
SELECT dataset, n_classes, n_instances, n_features, imbalance FROM s WHERE task = 'classification' AND n_classes BETWEEN 3 AND 100
  AND n_instances BETWEEN 500 AND 20000 AND n_features BETWEEN 5 AND 80 AND imbalance BETWEEN 0.1 AND 1.0 ORDER BY imbalance DESC, dataset LIMIT 100""")
def summary_search(spark, sf):
    s = catalogue(spark, sf).select(
        F.col("name").alias("dataset"), F.when(F.col("did") % 3 == 0, "regression").otherwise("classification").alias("task"),
        F.col("NumberOfClasses").alias("n_classes"), F.col("NumberOfInstances").alias("n_instances"),
        F.col("NumberOfFeatures").alias("n_features"), uniform(42, F.col("did"), F.lit("imb")).alias("imbalance"),
    )
    return cat.search_summaries(s)


def configs(spark, sf):
    """One search configuration per supplier; every ninth is already answered."""
    key = F.col("s_suppkey")
    u = lambda tag: uniform(42, key, F.lit(tag))
    low = lambda tag, a, span: (a + F.floor(u(tag) * span)).cast("bigint")
    return table(spark, sf, "supplier").select(
        key.alias("config_id"), low("c", 1, 5).alias("min_classes"), (low("c", 1, 5) + low("cw", 0, 4)).alias("max_classes"),
        low("i", 100, 4000).alias("min_instances"), (low("i", 100, 4000) + low("iw", 500, 8000)).alias("max_instances"),
        low("f", 2, 30).alias("min_features"), (low("f", 2, 30) + low("fw", 5, 60)).alias("max_features"),
        low("m", 1, 10).cast("double").alias("min_imbalance"), (low("m", 1, 10) + low("mw", 5, 100)).cast("double").alias("max_imbalance"),
        (key % 2 == 0).alias("allow_missing_values"), low("r", 3, 60).alias("max_results"),
        F.when(key % 9 == 0, F.lit(-1).cast("bigint")).alias("Datasets_Found"),
    )


def _c(tag, a, span):
    return f"({a} + floor({uniform_sql(42, 's_suppkey', f"'{tag}'")} * {span}))::bigint"


CONF = f"""conf AS (SELECT s_suppkey AS config_id, {_c('c', 1, 5)} AS c0, {_c('c', 1, 5)} + {_c('cw', 0, 4)} AS c1, {_c('i', 100, 4000)} AS i0,
  {_c('i', 100, 4000)} + {_c('iw', 500, 8000)} AS i1, {_c('f', 2, 30)} AS f0, {_c('f', 2, 30)} + {_c('fw', 5, 60)} AS f1, {_c('m', 1, 10)} AS m0,
  {_c('m', 1, 10)} + {_c('mw', 5, 100)} AS m1, s_suppkey % 2 = 0 AS miss, {_c('r', 3, 60)} AS r, s_suppkey % 9 = 0 AS done FROM supplier)"""


@query("bulk_search_counts", f"""
WITH {CAT}, {CONF} SELECT config_id, CASE WHEN done THEN -1 ELSE least(r, (SELECT count(*) FROM ratio WHERE "NumberOfClasses" BETWEEN c0 AND c1
  AND "NumberOfInstances" BETWEEN i0 AND i1 AND "NumberOfFeatures" BETWEEN f0 AND f1 AND "ImbalanceRatio" BETWEEN m0 AND m1
  AND (miss OR "NumberOfMissingValues" = 0))) END::bigint AS found FROM conf""")
def bulk_search(spark, sf):
    return cat.count_matches(configs(spark, sf), catalogue(spark, sf)).select("config_id", F.col("Datasets_Found").alias("found"))


@query("search_log", f"""
WITH {CONF} SELECT config_id, c0 AS min_classes, CASE WHEN done THEN -1 END::double AS found FROM conf UNION ALL SELECT -5, 3, 17""")
def search_log(spark, sf):
    log = configs(spark, sf).select("config_id", "min_classes", F.col("Datasets_Found").cast("double").alias("Datasets_Found"))
    log = cat.log_search(log, {"config_id": -5, "min_classes": 3}, 17.0)
    return log.withColumnRenamed("Datasets_Found", "found")


# ---- files -----------------------------------------------------------------------------------------

def _scratch(spark):
    """A new folder both driver and executors reach."""
    return f"{shared_folder(spark)}/lopside/{os.urandom(8).hex()}"


@query("read_csv_drop_nulls", f"""
WITH {HOLED} SELECT o_orderkey, price, priority, cust, status FROM holed WHERE price IS NOT NULL AND priority IS NOT NULL AND cust IS NOT NULL""")
def read_csv(spark, sf):
    path = f"{_scratch(spark)}/holed.csv"
    df = holed_orders(spark, sf).drop("nothing")
    na = [F.when(F.col(c).isNull(), "NA").otherwise(F.col(c).cast("string")).alias(c) for c in df.columns]
    df.select(*na).write.csv(path, header=True)
    read = tables.read_csv(spark, path)
    return read.select(F.col("o_orderkey").cast("bigint"), "price", "priority", F.col("cust").cast("double"), "status")


@query("load_in_file_order", f"""
WITH {HOLED} SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::bigint AS row_id, o_orderkey, price, status FROM holed WHERE price IS NOT NULL""")
def load_in_file_order(spark, sf):
    path = f"{_scratch(spark)}/ordered"
    df = holed_orders(spark, sf).select("o_orderkey", "price", "status").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    df.write.csv(path, header=True)
    ds = tables.load(spark, path)
    return ds.df.select("row_id", F.col("o_orderkey").cast("bigint"), "price", "status")


@query("read_summary_table", """
SELECT c_custkey::bigint AS id, c_mktsegment AS segment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance FROM customer""")
def read_summary_table(spark, sf):
    path = f"{_scratch(spark)}/summaries.tsv"
    balance = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("string")).otherwise("n/a")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), balance.alias("balance"))
    rows.write.csv(path, header=True, sep="\t")
    return tables.read_summaries(spark, path).select(F.col("id").cast("bigint"), "segment", "balance")


@query("read_imbalance_file", """
SELECT c_custkey::bigint AS id, c_custkey % 40 / 10.0::double AS "imbalance ratio" FROM customer
WHERE c_custkey % 40 / 10.0 > 2.0 AND c_custkey % 40 / 10.0 <= 2.5""")
def read_imbalance_file(spark, sf):
    path = f"{_scratch(spark)}/ratios.csv"
    ratio = (F.col("c_custkey") % 40 / 10).alias("imbalance ratio")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ratio).write.csv(path, header=True)
    return cat.imbalance_band(tables.read_csv(spark, path).select(F.col("id").cast("bigint"), F.col("imbalance ratio").cast("double")))


@query("folder_of_tables", """
SELECT DISTINCT 'part ' || p_type || '.csv' AS dataset, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'skipped' ELSE 'todo' END AS status FROM part""")
def folder_of_tables(spark, sf):
    folder = _scratch(spark)
    kinds = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().collect()]  # six kinds of part
    for kind in kinds:
        table(spark, sf, "part").filter(F.col("p_type") == kind).write.csv(f"{folder}/files/part {kind}.csv", header=True)
    names = spark.createDataFrame([(n,) for n in tables.list_csv(spark, f"{folder}/files")], "dataset string")
    done = names.filter(F.col("dataset").isin("part PROMO.csv", "part SMALL.csv"))
    return tables.batch_plan(names, done)


@query("read_registered", """
SELECT p_size, p_retailprice, p_brand, p_type AS class, 'parts (id:7)' AS dataset FROM part""")
def read_registered(spark, sf):
    ds = tables.read_registered(spark, f"{sf}/part.parquet", "parts", 7, "p_type", features=["p_size", "p_retailprice", "p_brand"])
    return ds.df.drop(ds.row_id).withColumn("dataset", F.lit(ds.name))


@query("export_clean_table", f"""
WITH {HOLED}, m AS (SELECT median(price) AS price FROM holed)
SELECT o_orderkey::double AS o_orderkey, coalesce(h.price, m.price) AS price, status FROM holed h, m""")
def export_clean(spark, sf):
    df = holed_orders(spark, sf).select("o_orderkey", "price", "status")
    path = tables.export_clean(df, f"{_scratch(spark)}/orders.csv")
    return tables.read_csv(spark, path)


@query("export_by_dataset", "SELECT p_partkey, p_size, p_type AS dataset FROM part")
def export_by_dataset(spark, sf):
    path = f"{_scratch(spark)}/parts"
    tables.export_by_dataset(table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_type").alias("dataset")), path)
    return spark.read.csv(path, header=True, schema="p_partkey bigint, p_size int, dataset string")


@query("batch_plan", """
SELECT p_type AS dataset, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'skipped' ELSE 'todo' END AS status FROM part GROUP BY 1""")
def batch_plan(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_type").alias("dataset")).distinct()
    done = names.filter(F.col("dataset").isin("PROMO", "SMALL"))
    return tables.batch_plan(names, done)


@query("batch_summary", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'skipped' WHEN p_partkey % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM part) GROUP BY 1""")
def batch_summary(spark, sf):
    status = F.when(F.col("p_partkey") % 7 == 0, "skipped").when(F.col("p_partkey") % 5 == 0, "failed").otherwise("success")
    return tables.batch_summary(table(spark, sf, "part").select(F.col("p_partkey").alias("dataset"), status.alias("status")))


@query("files_not_processed", """
SELECT DISTINCT 'customer ' || c_custkey || '.csv' AS dataset FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def not_processed(spark, sf):
    files = table(spark, sf, "customer").select(F.concat(F.lit("customer "), "c_custkey", F.lit(".csv")).alias("dataset"))
    done = table(spark, sf, "orders").select(F.concat(F.lit("customer "), "o_custkey", F.lit(".csv")).alias("dataset"))
    return tables.batch_plan(files, done).filter(F.col("status") == "todo").select("dataset")


@query("union_by_name", """
SELECT c_custkey AS k, c_acctbal AS bal, NULL::varchar AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)
