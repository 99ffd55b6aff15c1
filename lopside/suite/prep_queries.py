"""Loading, cleaning, encoding and class-balance queries."""

from pyspark.sql import functions as F

from lopside.functions.scalars import safe_name
from lopside.operators import prep
from lopside.operators.ranks import hash_rank
from lopside.suite.base import HOLED, LABELLED, ROLES, holed_orders, labelled_documents, query, roles, table


@query("class_counts", f"WITH {LABELLED} SELECT quality::varchar AS label, count(*) AS n FROM labelled GROUP BY 1")
def class_counts(spark, sf):
    return prep.class_counts(labelled_documents(spark, sf).df, "quality")


@query("class_counts_derived", """
SELECT (l_quantity >= 48)::varchar AS label, count(*) AS n FROM lineitem GROUP BY 1""")
def class_counts_derived(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") >= 48).alias("heavy"))
    return prep.class_counts(df, "heavy")


@query("imbalance_ratio", f"""
WITH {LABELLED}, c AS (SELECT quality, count(*) AS n FROM labelled GROUP BY 1)
SELECT round(max(n) / min(n)::double, 3) AS imbalance_ratio FROM c""")
def imbalance_ratio(spark, sf):
    return prep.imbalance_ratio(labelled_documents(spark, sf).df, "quality")


@query("imbalance_ratio_multiclass", f"""
WITH {ROLES}, c AS (SELECT role, count(*) AS n FROM roles GROUP BY 1)
SELECT round(max(n) / min(n)::double, 3) AS imbalance_ratio FROM c""")
def imbalance_ratio_multiclass(spark, sf):
    return prep.imbalance_ratio(roles(spark, sf).df, "role")


@query("features_and_target", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS target FROM customer""")
def features_and_target(spark, sf):
    from lopside.dataset import Dataset

    ds = Dataset.last_column(table(spark, sf, "customer"), "c_custkey", "customer")
    return ds.df.select(ds.row_id, *ds.features, F.col(ds.target).alias("target"))


@query("drop_null_rows", f"""
WITH {HOLED} SELECT o_orderkey, price, priority, cust, status FROM holed
WHERE price IS NOT NULL AND priority IS NOT NULL AND cust IS NOT NULL AND status IS NOT NULL""")
def drop_null_rows(spark, sf):
    return prep.drop_null_rows(holed_orders(spark, sf).drop("nothing"))


@query("drop_empty_columns", f"WITH {HOLED} SELECT o_orderkey, price, priority, cust, status FROM holed")
def drop_empty_columns(spark, sf):
    return prep.drop_empty_columns(holed_orders(spark, sf))


@query("drop_incomplete_columns", """
SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders""")
def drop_incomplete_columns(spark, sf):
    df = holed_orders(spark, sf).select(
        "o_orderkey", "status", "price", "cust",
        F.when(F.col("o_orderkey") % 9 == 0, float("inf")).otherwise(F.lit(1.0)).alias("unbounded"),
    )
    whole = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("whole"))
    return prep.drop_incomplete_columns(df.join(whole, "o_orderkey")).withColumnRenamed("whole", "price")


@query("missing_counts", f"""
WITH {HOLED}, u AS (
  SELECT 'price' AS "column", count(*) FILTER (price IS NULL) AS missing FROM holed
  UNION ALL SELECT 'priority', count(*) FILTER (priority IS NULL) FROM holed
  UNION ALL SELECT 'cust', count(*) FILTER (cust IS NULL) FROM holed
  UNION ALL SELECT 'nothing', count(*) FROM holed
  UNION ALL SELECT 'status', count(*) FILTER (status IS NULL) FROM holed)
SELECT * FROM u WHERE missing > 0""")
def missing_counts(spark, sf):
    return prep.missing_counts(holed_orders(spark, sf))


@query("total_missing", f"""
WITH {HOLED} SELECT (count(*) FILTER (price IS NULL) + count(*) FILTER (priority IS NULL)
  + count(*) FILTER (cust IS NULL) + count(*))::bigint AS total_missing FROM holed""")
def total_missing(spark, sf):
    return prep.total_missing(holed_orders(spark, sf))


@query("column_counts", f"""
WITH {HOLED}
SELECT 'o_orderkey' AS "column", count(o_orderkey) AS n FROM holed
UNION ALL SELECT 'price', count(price) FROM holed UNION ALL SELECT 'priority', count(priority) FROM holed
UNION ALL SELECT 'cust', count(cust) FROM holed UNION ALL SELECT 'nothing', count(nothing) FROM holed
UNION ALL SELECT 'status', count(status) FROM holed""")
def column_counts(spark, sf):
    return prep.column_counts(holed_orders(spark, sf))


@query("impute", f"""
WITH {HOLED}, m AS (SELECT median(price) AS price, median(cust)::double AS cust, median(o_orderkey) FILTER (o_orderkey % 4 <> 0)::double AS odd FROM holed),
f AS (SELECT priority, count(*) AS n FROM holed WHERE priority IS NOT NULL GROUP BY 1 ORDER BY n DESC, priority LIMIT 1)
SELECT o_orderkey::double AS o_orderkey, coalesce(h.price, m.price) AS price, coalesce(h.priority, f.priority) AS priority,
  coalesce(h.cust::double, m.cust) AS cust, status, CASE WHEN o_orderkey % 4 = 0 THEN m.odd ELSE o_orderkey::double END AS odd
FROM holed h, m, f""")
def impute(spark, sf):
    key = F.col("o_orderkey")
    odd = F.when(key % 4 == 0, float("nan")).otherwise(key.cast("double"))
    return prep.impute(holed_orders(spark, sf).withColumn("odd", odd))


@query("one_hot_drop_first", """
SELECT p_partkey, p_size, p_retailprice,
  (p_type = 'LARGE')::int AS "p_type_LARGE", (p_type = 'MEDIUM')::int AS "p_type_MEDIUM",
  (p_type = 'PROMO')::int AS "p_type_PROMO", (p_type = 'SMALL')::int AS "p_type_SMALL",
  (p_type = 'STANDARD')::int AS "p_type_STANDARD"
FROM part""")
def one_hot(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return prep.one_hot(df)


@query("encode_binary_target", """
SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END)::int AS status FROM orders""")
def encode_binary(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status")
    )
    return prep.encode_binary(df, "status")


@query("factorize_target", """
WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY first) - 1)::bigint AS code FROM f)
SELECT o_orderkey, code AS o_orderpriority FROM orders JOIN c USING (o_orderpriority)""")
def factorize(spark, sf):
    return prep.factorize(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@query("safe_names", """
WITH n AS (SELECT p_partkey, ' ' || p_name || ' #' || p_brand AS raw FROM part
  UNION ALL SELECT -1 - p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '--' ELSE p_size || '% of ' || p_type END FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(raw, '[^0-9a-zA-Z_]', '_', 'g'), '_') AS s FROM n),
e AS (SELECT p_partkey, CASE WHEN s = '' THEN 'feature' ELSE s END AS s FROM c)
SELECT p_partkey, CASE WHEN regexp_matches(s, '^[0-9]') THEN 'f_' || s ELSE s END AS name FROM e""")
def safe_names(spark, sf):
    part = table(spark, sf, "part")
    raw = part.select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" #"), "p_brand").alias("raw"))
    odd = part.select(
        (-1 - F.col("p_partkey")).alias("p_partkey"),
        F.when(F.col("p_partkey") % 2 == 0, "--").otherwise(F.concat(F.col("p_size"), F.lit("% of "), F.col("p_type"))).alias("raw"),
    )
    return raw.unionByName(odd).select("p_partkey", safe_name(F.col("raw")).alias("name"))


@query("problem_type", """
SELECT count(DISTINCT role) AS n_classes,
  CASE WHEN count(DISTINCT role) > 2 THEN 'multiclass' ELSE 'binary' END AS problem_type FROM conversations""")
def problem_type(spark, sf):
    return prep.problem_type(roles(spark, sf).df, "role")


@query("target_class_count", "SELECT count(DISTINCT label) AS n_classes FROM embeddings")
def target_class_count(spark, sf):
    return prep.problem_type(table(spark, sf, "embeddings"), "label").select("n_classes")


@query("balanced_weights", f"""
WITH {LABELLED}, c AS (SELECT quality, count(*) AS n FROM labelled GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k FROM c)
SELECT doc_id, round((t.n / (t.k * c.n))::double, 6) AS weight FROM labelled JOIN c USING (quality), t""")
def balanced_weights(spark, sf):
    df = prep.balanced_weights(labelled_documents(spark, sf).df, "quality")
    return df.select("doc_id", F.round("weight", 6).alias("weight"))


@query("deterministic_sample", """
SELECT l_orderkey, n FROM (SELECT o_orderkey AS l_orderkey, count(*) OVER () AS n, o_orderkey FROM orders)
ORDER BY ('0x' || substr(md5('42|' || o_orderkey::varchar), 1, 8))::bigint, o_orderkey LIMIT 100""")
def deterministic_sample(spark, sf):
    orders = table(spark, sf, "orders")
    picked = prep.sample_rows(orders.select("o_orderkey"), "o_orderkey", 100)
    return picked.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(orders.count()).alias("n"))


@query("rank_within_class", f"""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY ('0x' || substr(md5('42|' || o_orderkey::varchar), 1, 8))::bigint, o_orderkey) AS rank FROM orders""")
def rank_within_class(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return hash_rank(df, ["o_orderstatus"], "o_orderkey").select("o_orderkey", "rank")


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pair_correlations", "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS value FROM lineitem"
    for i, a in enumerate(LINE_NUMERIC) for b in LINE_NUMERIC[i + 1:]))
def pair_correlations(spark, sf):
    c = prep.correlations(table(spark, sf, "lineitem"), LINE_NUMERIC)
    return c.withColumn("value", F.round("value", 6))


@query("target_correlation_spread", "WITH v AS (" + "\nUNION ALL ".join(
    f"SELECT abs(corr({c}, (l_quantity >= 48)::int)) AS v FROM lineitem" for c in LINE_NUMERIC)
    + ") SELECT round(min(v), 6) AS corr_min, round(avg(v), 6) AS corr_mean, round(max(v), 6) AS corr_max FROM v")
def target_correlation_spread(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("heavy", (F.col("l_quantity") >= 48).cast("int"))
    s = prep.spread(prep.target_correlations(df, LINE_NUMERIC, "heavy"), "value", "corr")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("categorical_levels", """
SELECT min(n)::double AS levels_min, avg(n) AS levels_mean, max(n)::double AS levels_max FROM (
  SELECT count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT count(DISTINCT p_type) FROM part
  UNION ALL SELECT count(DISTINCT p_name) FROM part)""")
def categorical_levels(spark, sf):
    return prep.spread(prep.distinct_counts(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"]), "n", "levels")


@query("short_profile", """
WITH t AS (SELECT *, (p_size >= 45)::int AS large FROM part),
c AS (SELECT large, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT abs(corr(p_size, large)) AS v FROM t UNION ALL SELECT abs(corr(p_retailprice, large)) FROM t),
l AS (SELECT count(DISTINCT p_brand) AS n FROM t UNION ALL SELECT count(DISTINCT p_type) FROM t)
SELECT (SELECT count(*) FROM t) AS n_rows, 4 AS n_columns, 2 AS n_numeric, 2 AS n_categorical,
  (SELECT round(max(n) / min(n)::double, 3) FROM c) AS imbalance_ratio,
  (SELECT round(min(v), 6) FROM r) AS corr_min, (SELECT round(avg(v), 6) FROM r) AS corr_mean,
  (SELECT round(max(v), 6) FROM r) AS corr_max,
  (SELECT min(n)::double FROM l) AS levels_min, (SELECT avg(n) FROM l) AS levels_mean, (SELECT max(n)::double FROM l) AS levels_max""")
def short_profile(spark, sf):
    df = table(spark, sf, "part").withColumn("large", (F.col("p_size") >= 45).cast("int"))
    p = prep.short_profile(df, ["p_size", "p_retailprice", "p_brand", "p_type"], "large")
    return p.select(*[F.round(c, 6).alias(c) if c.startswith("corr") else F.col(c) for c in p.columns])
