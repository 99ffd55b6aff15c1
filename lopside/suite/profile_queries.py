"""Meta-feature queries."""

from pyspark.sql import functions as F

from lopside.dataset import Dataset
from lopside.operators.profile import complexity, concept, cover, density, itemset, landmarks, statistical, trees
from lopside.operators.profile.scatter import scatter
from lopside.operators.profile.summary import SUMMARIES, as_frame, summarise
from lopside.session import pin
from lopside.suite.base import (
    LABELLED, document_points_sql, embedded, labelled_documents, query, table,
)

def numbers(spark, features, digits=4):
    return as_frame(spark, features).withColumn("value", F.round("value", digits))


def summary_sql(vals, digits=4):
    """From CTE ``vals``(feature, v) the rows feature.summary, value."""
    return f"""mu AS (SELECT feature, avg(v) AS mu FROM {vals} WHERE v IS NOT NULL GROUP BY 1),
mo AS (SELECT feature, any_value(mu) AS mean, count(*)::double AS n, stddev_samp(v) AS sd, avg(pow(v - mu, 2)) AS m2,
  avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4 FROM {vals} JOIN mu USING (feature) WHERE v IS NOT NULL GROUP BY 1),
sh AS (SELECT *, n > 1 AND m2 > 1e-24 * greatest(1, mean * mean) AS shaped, (n - 1) / n AS f FROM mo),
summed AS (SELECT feature || '.mean' AS feature, round(mean, {digits}) AS value FROM sh
  UNION ALL SELECT feature || '.sd', round(sd, {digits}) FROM sh
  UNION ALL SELECT feature || '.kurtosis', CASE WHEN shaped THEN round(m4 / (m2 * m2) * f * f - 3, {digits}) END FROM sh
  UNION ALL SELECT feature || '.skewness', CASE WHEN shaped THEN round(m3 / pow(m2, 1.5) * pow(f, 1.5), {digits}) END FROM sh)"""


# ---- general and statistical: line items, target l_returnflag --------------------------------

LINE = ["quantity", "price", "discount", "tax"]


def lines(spark, sf):
    df = table(spark, sf, "lineitem").select(
        (F.col("l_quantity") / 10).alias("quantity"), (F.col("l_extendedprice") / 10000).alias("price"),
        (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10 + 1).alias("tax"),
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("id"),
    )
    return Dataset(df, [*LINE, "status"], "flag", "id", "lineitem")


LINES = """ln AS (SELECT l_quantity / 10 AS quantity, l_extendedprice / 10000 AS price, l_discount * 10 AS discount, l_tax * 10 + 1 AS tax,
  l_linestatus AS status, l_returnflag AS flag FROM lineitem)"""


@query("general_meta_features", f"""
WITH {LINES}, k AS (SELECT flag, count(*) AS n FROM ln GROUP BY 1), fq AS (SELECT 'freq_class' AS feature, n / sum(n) OVER () AS v FROM k),
{summary_sql('fq')}, t AS (SELECT count(*)::double AS n FROM ln),
b AS (SELECT (count(DISTINCT quantity) = 2)::int + (count(DISTINCT price) = 2)::int + (count(DISTINCT discount) = 2)::int
  + (count(DISTINCT tax) = 2)::int + (count(DISTINCT status) = 2)::int AS bins FROM ln)
SELECT * FROM summed UNION ALL SELECT 'nr_inst', n FROM t UNION ALL SELECT 'nr_attr', 5 UNION ALL SELECT 'nr_class', count(*) FROM k
UNION ALL SELECT 'nr_bin', bins FROM b UNION ALL SELECT 'nr_cat', 1 UNION ALL SELECT 'nr_num', 4
UNION ALL SELECT 'attr_to_inst', round(5 / n, 4) FROM t UNION ALL SELECT 'inst_to_attr', round(n / 5, 4) FROM t
UNION ALL SELECT 'cat_to_num', 0.25 UNION ALL SELECT 'num_to_cat', 4""")
def general(spark, sf):
    return numbers(spark, statistical.general(lines(spark, sf)))


def _column(c):
    return f"""SELECT '{c}' AS c, count(*)::double AS n, avg({c}) AS mean, median({c}) AS median, min({c}) AS min, max({c}) AS max,
  var_samp({c}) AS var, stddev_samp({c}) AS sd, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iq_range, count(DISTINCT {c}) AS levels,
  CASE WHEN min({c}) < 0 THEN NULL WHEN min({c}) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN {c} > 0 THEN {c} END))) END AS g_mean,
  CASE WHEN min({c}) < 0 THEN NULL WHEN min({c}) = 0 THEN 0 ELSE count(*) / sum(CASE WHEN {c} <> 0 THEN 1 / {c} END) END AS h_mean FROM ln"""


def _trimmed(c):
    return f"""SELECT '{c}' AS c, avg(v) AS t_mean FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM ln)
  WHERE r >= floor(0.2 * n) AND r < n - floor(0.2 * n)"""


STATS = f"""st AS ({' UNION ALL '.join(_column(c) for c in LINE)}),
tr AS ({' UNION ALL '.join(_trimmed(c) for c in LINE)}),
md AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, 1.4826 * median(abs({c} - (SELECT median({c}) FROM ln))) AS mad FROM ln" for c in LINE)}),
cm AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, avg(pow({c} - m, 2)) AS m2, avg(pow({c} - m, 3)) AS m3, avg(pow({c} - m, 4)) AS m4 FROM ln, (SELECT avg({c}) AS m FROM ln)" for c in LINE)}),
al AS (SELECT st.*, max - min AS range, t_mean, mad, (n / levels - 1) / (n - 1) AS sparsity,
  m3 / pow(m2, 1.5) * pow((n - 1) / n, 1.5) AS skewness, m4 / (m2 * m2) * pow((n - 1) / n, 2) - 3 AS kurtosis
  FROM st JOIN tr USING (c) JOIN md USING (c) JOIN cm USING (c)),
ps AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {k}::double AS v FROM al" for k in (
    "mean", "median", "min", "max", "range", "var", "sd", "iq_range", "mad", "t_mean", "kurtosis", "skewness", "g_mean", "h_mean", "sparsity")) + ")"


@query("statistical_meta_features", f"WITH {LINES}, {STATS}, {summary_sql('ps')} SELECT * FROM summed")
def per_column(spark, sf):
    found = statistical.per_column(lines(spark, sf).df, LINE)
    return numbers(spark, {k: v for k, v in found.items() if not k.startswith("nr_")})


@query("outlier_and_normal_columns")
def outliers(spark, sf):
    found = statistical.per_column(lines(spark, sf).df, LINE)
    return numbers(spark, {k: v for k, v in found.items() if k.startswith("nr_")})


@query("outlier_columns", f"""
WITH {LINES} SELECT 'nr_outliers' AS feature, ({' + '.join(f'''(SELECT (count(*) > 0)::int FROM ln, (SELECT quantile_cont({c}, 0.25) AS a,
  quantile_cont({c}, 0.75) AS b FROM ln) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))''' for c in LINE)})::double AS value""")
def outlier_columns(spark, sf):
    return numbers(spark, {"nr_outliers": statistical.per_column(lines(spark, sf).df, LINE)["nr_outliers"]})


def line_scatter(spark, sf):
    ds = lines(spark, sf)
    return scatter(pin(Dataset(ds.df, LINE, "flag", "id").points()))


LINE_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1:]]
COVARIANCE = ["cor", "cov", "nr_cor_attr", "gravity"]


def _cholesky(source, matrix, name, keep):
    """CTEs that give the lower triangle l00, l10, l11, ... of ``matrix`` (columns m00, m01, ...), one entry after the other."""
    steps, d = [], len(LINE)
    for j in range(d):
        for i in range(j, d):
            done = " ".join(f"- l{i}{q} * l{j}{q}" for q in range(j))
            e = f"sqrt({matrix}{j}{j} {done})" if i == j else f"({matrix}{j}{i} {done}) / l{j}{j}"
            steps.append(f"{name}{i}{j} AS MATERIALIZED (SELECT *, {e} AS l{i}{j} FROM {source})")
            source = f"{name}{i}{j}"
    return ", ".join(steps) + f", {name} AS MATERIALIZED (SELECT {keep}, {' + '.join(f'2 * ln(l{i}{i})' for i in range(d))} AS logdet FROM {source})"


def _jacobi(sweeps=6):
    """CTEs that turn t(m00, m01, ...) until only its diagonal is left, the eigenvalues."""
    d, steps, source = len(LINE), [], "cv0"
    at = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    for n, (p, q) in enumerate([(p, q) for _ in range(sweeps) for p in range(d) for q in range(p + 1, d)]):
        tan = (f"CASE WHEN {at(p, q)} = 0 THEN 0 WHEN {at(p, p)} = {at(q, q)} THEN 1 ELSE sign(h) / (abs(h) + sqrt(h * h + 1)) END")
        steps.append(f"ja{n} AS MATERIALIZED (SELECT *, ({at(q, q)} - {at(p, p)}) / (2 * CASE WHEN {at(p, q)} = 0 THEN 1 ELSE {at(p, q)} END) AS h FROM {source})")
        steps.append(f"jb{n} AS MATERIALIZED (SELECT *, {tan} AS tn, 1 / sqrt(pow({tan}, 2) + 1) AS co FROM ja{n})")
        new = {at(p, p): f"{at(p, p)} - tn * {at(p, q)}", at(q, q): f"{at(q, q)} + tn * {at(p, q)}", at(p, q): "0.0::double"}
        for r in set(range(d)) - {p, q}:
            new[at(r, p)] = f"co * ({at(r, p)} - tn * {at(r, q)})"
            new[at(r, q)] = f"co * ({at(r, q)} + tn * {at(r, p)})"
        cols = [at(i, j) for i in range(d) for j in range(i, d)]
        steps.append(f"jc{n} AS MATERIALIZED (SELECT {', '.join(f'{new.get(c, c)} AS {c}' for c in cols)} FROM jb{n})")
        source = f"jc{n}"
    return ", ".join(steps) + f", ev AS ({' UNION ALL '.join(f'SELECT m{i}{i} AS e FROM {source}' for i in range(d))})"


_IJ = [(i, j) for i in range(len(LINE)) for j in range(i, len(LINE))]
# Eigenvalues of W^-1 B by Cholesky W = L L': u solves L u = gap for each class, and the two eigenvalues that three classes
# leave follow from the trace of U'U and of its square.
_SOLVE = []
for _i in range(len(LINE)):
    _SOLVE.append(f"so{_i} AS MATERIALIZED (SELECT *, (sqrt(n) * g{_i} {' '.join(f'- l{_i}{_q} * u{_q}' for _q in range(_i))}) / l{_i}{_i} AS u{_i} FROM {'gp' if not _i else f'so{_i - 1}'})")
DISCRIMINANT = f"""ml AS (SELECT flag AS f, count(*)::double AS n, {', '.join(f'avg({c}) AS a{i}' for i, c in enumerate(LINE))} FROM ln GROUP BY 1),
mt AS (SELECT {', '.join(f'avg({c}) AS t{i}' for i, c in enumerate(LINE))} FROM ln),
cv0 AS (SELECT {', '.join(f'covar_samp({LINE[i]}, {LINE[j]}) AS m{i}{j}' for i, j in _IJ)} FROM ln), {_jacobi()},
wk AS MATERIALIZED (SELECT flag, any_value(n) AS n, {', '.join(f'sum(({LINE[i]} - a{i}) * ({LINE[j]} - a{j})) AS w{i}{j}' for i, j in _IJ)} FROM ln JOIN ml ON ml.f = ln.flag GROUP BY 1),
wt AS MATERIALIZED (SELECT sum(n) AS n, {', '.join(f'sum(w{i}{j}) AS w{i}{j}' for i, j in _IJ)} FROM wk),
{_cholesky('wt', 'w', 'ch', ', '.join(f'l{j}{i}' for i, j in _IJ))},
gp AS (SELECT ml.f, ml.n, {', '.join(f'a{i} - t{i} AS g{i}' for i in range(len(LINE)))}, {', '.join(f'l{j}{i}' for i, j in _IJ)} FROM ml, mt, ch),
{', '.join(_SOLVE)},
uu AS (SELECT x.f = y.f AS own, {' + '.join(f'x.u{i} * y.u{i}' for i in range(len(LINE)))} AS v FROM so{len(LINE) - 1} x, so{len(LINE) - 1} y),
tr AS (SELECT sum(v) FILTER (own) AS a, sum(v * v) AS b FROM uu),
la AS MATERIALIZED (SELECT (a + sqrt(greatest(2 * b - a * a, 0))) / 2 AS l1, greatest((a - sqrt(greatest(2 * b - a * a, 0))) / 2, 0) AS l2 FROM tr),
wd AS (SELECT flag, n, {', '.join(f'w{i}{j} / (n - 1) AS v{i}{j}' for i, j in _IJ)} FROM wk), {_cholesky('wd', 'v', 'ck', 'n')},
wp AS (SELECT n - (SELECT count(*) FROM wk) AS dof, {', '.join(f'w{i}{j} / (n - (SELECT count(*) FROM wk)) AS p{i}{j}' for i, j in _IJ)} FROM wt),
{_cholesky('wp', 'p', 'cp', 'dof')},
bx AS (SELECT sum((n - 1) * logdet) AS s, sum(1 / (n - 1)) AS inv, count(*) AS k FROM ck),
mm AS (SELECT (1 - {2 * len(LINE) ** 2 + 3 * len(LINE) - 1} / (6 * {len(LINE) + 1} * (k - 1))::double * (inv - 1 / dof)) * (dof * logdet - s) AS m, dof FROM bx, cp)"""


@query("multivariate_meta_features", f"""
WITH {LINES}, {DISCRIMINANT},
vs AS MATERIALIZED ({' UNION ALL '.join(f"SELECT 'cor' AS feature, abs(corr({a}, {b})) AS v FROM ln UNION ALL SELECT 'cov', abs(covar_samp({a}, {b})) FROM ln" for a, b in LINE_PAIRS)}
  UNION ALL SELECT 'eigenvalues', e FROM ev UNION ALL SELECT 'can_cor', sqrt(l1 / (1 + l1)) FROM la UNION ALL SELECT 'can_cor', sqrt(l2 / (1 + l2)) FROM la),
{summary_sql('vs')},
k AS (SELECT flag, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in LINE)} FROM ln GROUP BY 1),
hi AS (SELECT * FROM k ORDER BY n DESC, flag LIMIT 1), lo AS (SELECT * FROM k ORDER BY n, flag LIMIT 1)
SELECT * FROM summed UNION ALL SELECT 'nr_cor_attr', round(avg((v >= 0.5)::int), 4) FROM vs WHERE feature = 'cor'
UNION ALL SELECT 'gravity', round(sqrt({' + '.join(f'pow(hi.{c} - lo.{c}, 2)' for c in LINE)}), 4) FROM hi, lo
UNION ALL SELECT 'w_lambda', round(1 / ((1 + l1) * (1 + l2)), 4) FROM la UNION ALL SELECT 'p_trace', round(l1 / (1 + l1) + l2 / (1 + l2), 4) FROM la
UNION ALL SELECT 'lh_trace', round(l1 + l2, 4) FROM la UNION ALL SELECT 'roy_root', round(l1, 4) FROM la UNION ALL SELECT 'nr_disc', 2
UNION ALL SELECT 'sd_ratio', round(exp(m / ({len(LINE)} * dof)), 4) FROM mm""")
def multivariate(spark, sf):
    """Covariances, eigenvalues, canonical correlations and what follows from them, of all numeric columns."""
    return numbers(spark, statistical.multivariate(line_scatter(spark, sf)))


@query("discriminant_meta_features")
def discriminant(spark, sf):
    """Eigenvalues, canonical correlations and what follows from them, of all numeric columns."""
    found = statistical.multivariate(line_scatter(spark, sf))
    return numbers(spark, {k: v for k, v in found.items() if k not in COVARIANCE})


# ---- itemsets: parts -----------------------------------------------------------------------------

PART_ITEMS = ["p_brand", "p_type", "size"]


def part_items(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("size"))


ITEMS = """n AS (SELECT count(*)::double AS n FROM part), it AS MATERIALIZED (
  SELECT 0 AS a, p_brand AS v, count(*) AS k FROM part GROUP BY 2 UNION ALL SELECT 1, p_type, count(*) FROM part GROUP BY 2
  UNION ALL SELECT 2, p_size::varchar, count(*) FROM part GROUP BY 2),
lg AS MATERIALIZED (SELECT p_partkey, unnest([0, 1, 2]) AS a, unnest([p_brand, p_type, p_size::varchar]) AS v FROM part),
jt AS MATERIALIZED (SELECT x.a, x.v AS va, y.a AS b, y.v AS vb, count(*) AS k FROM lg x JOIN lg y ON x.p_partkey = y.p_partkey AND x.a < y.a GROUP BY 1, 2, 3, 4),
tw AS (SELECT x.a, x.v AS va, y.a AS b, y.v AS vb, (x.k + y.k - 2 * coalesce(jt.k, 0)) / n AS s
  FROM it x JOIN it y ON x.a < y.a LEFT JOIN jt ON jt.a = x.a AND jt.va = x.v AND jt.b = y.a AND jt.vb = y.v, n)"""


@query("one_itemset", f"WITH {ITEMS} SELECT a, v, round(k / n, 6) AS one_itemset FROM it, n")
def one_itemset(spark, sf):
    return itemset.one_itemset(part_items(spark, sf), PART_ITEMS).withColumn("one_itemset", F.round("one_itemset", 6))


@query("two_itemset", f"WITH {ITEMS} SELECT a, va, b, vb, round(s, 6) AS two_itemset FROM tw")
def two_itemset(spark, sf):
    return itemset.two_itemset(part_items(spark, sf), PART_ITEMS).withColumn("two_itemset", F.round("two_itemset", 6))


@query("itemset_meta_features", f"""
WITH {ITEMS}, iv AS (SELECT 'one_itemset' AS feature, k / n AS v FROM it, n UNION ALL SELECT 'two_itemset', s FROM tw),
{summary_sql('iv', 6)} SELECT * FROM summed""")
def itemset_features(spark, sf):
    return numbers(spark, itemset.itemset(part_items(spark, sf), PART_ITEMS), 6)


# ---- concept and complexity: labelled documents -----------------------------------------------------

def points(spark, sf):
    return pin(labelled_documents(spark, sf).points())


SCALED = f"""{document_points_sql()}, cells AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM pts),
ends AS (SELECT i, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1),
sp AS MATERIALIZED (SELECT id, label, list(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END ORDER BY i) AS x FROM cells JOIN ends USING (i) GROUP BY 1, 2)"""
CONCEPT = f"""{SCALED}, pr AS (SELECT a.id, a.label <> b.label AS odd, round(list_distance(a.x, b.x), 9) AS d FROM sp a JOIN sp b ON a.id <> b.id),
we AS (SELECT *, pow(2, -2 * d / CASE WHEN sqrt(6) - d > 0 THEN sqrt(6) - d ELSE 1e-9 END) AS w, pow(2, -ceil(d)) AS r FROM pr),
cr AS (SELECT id, sum(r) AS cohesiveness, sum(w * odd::int) / sum(w) AS conceptvar, sum(r * odd::int) AS impconceptvar, sum(w * d) / sum(w) AS wg_dist
  FROM we GROUP BY 1)"""


@query("concept_meta_features", f"""
WITH {CONCEPT}, cv AS ({' UNION ALL '.join(f"SELECT '{k}' AS feature, {k} AS v FROM cr" for k in concept.NAMES)}), {summary_sql('cv', 6)}
SELECT * FROM summed""")
def concept_features(spark, sf):
    return numbers(spark, concept.concept(points(spark, sf)), 6)


@query("class_balance_complexity", f"""
WITH {LABELLED}, k AS (SELECT quality, count(*)::double AS n FROM labelled GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS c FROM k)
SELECT 'c1' AS feature, round(-sum(k.n / t.n * ln(k.n / t.n)) / ln(any_value(c)), 6) AS value FROM k, t
UNION ALL SELECT 'c2', round(1 - 1 / ((any_value(c) - 1) / any_value(c)::double * sum(k.n / (t.n - k.n))), 6) FROM k, t""")
def balance(spark, sf):
    found = complexity.from_scatter(scatter(points(spark, sf)))
    return numbers(spark, {k: found[k] for k in ("c1", "c2")}, 6)


@query("fisher_ratios", f"""
WITH {document_points_sql()}, cells AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM pts),
m AS (SELECT i, avg(v) AS mu FROM cells GROUP BY 1), k AS (SELECT label, i, avg(v) AS mc, count(*) AS n FROM cells GROUP BY 1, 2),
w AS (SELECT i, sum(pow(v - mc, 2)) AS w FROM cells JOIN k USING (label, i) GROUP BY 1),
b AS (SELECT i, sum(n * pow(mc - mu, 2)) AS b FROM k JOIN m USING (i) GROUP BY 1),
vs AS (SELECT 'f1' AS feature, 1 / (1 + b / w) AS v FROM w JOIN b USING (i)), {summary_sql('vs', 6)} SELECT * FROM summed""")
def fisher(spark, sf):
    return numbers(spark, {"f1": complexity.from_scatter(scatter(points(spark, sf)))["f1"]}, 6)


@query("directional_fisher_and_dimensions")
def directional(spark, sf):
    found = complexity.from_scatter(line_scatter(spark, sf))
    return numbers(spark, {k: found[k] for k in ("f1v", "t2", "t3", "t4")})


OVERLAP = f"""{document_points_sql()}, cells AS (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM pts),
e AS (SELECT label, i, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1, 2),
o AS (SELECT i, max(lo) AS lo, min(hi) AS hi, max(hi) - min(lo) AS span FROM e GROUP BY 1)"""


@query("overlap_volume", f"""
WITH {OVERLAP} SELECT 'f2' AS feature, round(product(CASE WHEN span > 0 THEN greatest(hi - lo, 0) / span ELSE 0 END), 6) AS value FROM o""")
def overlap_volume(spark, sf):
    return numbers(spark, {"f2": complexity.f2_values(complexity._ends(points(spark, sf)))[0]}, 6)


@query("feature_efficiency", f"""
WITH {OVERLAP}, c AS (SELECT i, count(*) FILTER (v BETWEEN lo AND hi) / count(*)::double AS s FROM cells JOIN o USING (i) GROUP BY 1)
SELECT 'f3' AS feature, round(min(s), 6) AS value FROM c""")
def efficiency(spark, sf):
    p = points(spark, sf)
    return numbers(spark, {"f3": complexity.f3_values(p, complexity._ends(p))[0]}, 6)


def _f4_sql(rounds):
    steps, source = [], "cells"
    for r in range(rounds):
        steps.append(f"""e{r} AS (SELECT label, i, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY 1, 2),
o{r} AS (SELECT i, max(lo) AS lo, min(hi) AS hi, count(*) AS k FROM e{r} GROUP BY 1),
b{r} AS (SELECT i, count(*) FILTER (k = 2 AND v BETWEEN lo AND hi) AS c FROM {source} JOIN o{r} USING (i)
  {f'WHERE i NOT IN ({" UNION ALL ".join(f"SELECT i FROM p{q}" for q in range(r))})' if r else ''} GROUP BY 1),
p{r} AS (SELECT * FROM b{r} ORDER BY c, i LIMIT 1),
s{r} AS MATERIALIZED (SELECT * FROM {source} WHERE id IN (SELECT id FROM {source} JOIN o{r} USING (i) JOIN p{r} USING (i) WHERE k = 2 AND v BETWEEN lo AND hi))""")
        source = f"s{r}"
    return ",\n".join(steps)


@query("collective_feature_efficiency", f"""
WITH {document_points_sql()}, cells AS MATERIALIZED (SELECT id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM pts), {_f4_sql(6)}
SELECT 'f4' AS feature, round((SELECT count(DISTINCT id) FROM s5) / (SELECT count(*) FROM pts)::double, 6) AS value""")
def collective(spark, sf):
    return numbers(spark, {"f4": complexity.f4_values(points(spark, sf))[0]}, 6)


L1 = "round(list_sum([abs(a.x[i] - b.x[i]) for i in range(1, 7)]), 9)"
NEAR = f"""{SCALED}, pr AS MATERIALIZED (SELECT a.id, b.id AS nid, a.label = b.label AS same, {L1} AS d FROM sp a JOIN sp b ON a.id <> b.id),
nn AS (SELECT id, arg_min(same, (d, nid)) AS hit, min(d) FILTER (same) AS own, min(d) FILTER (NOT same) AS other FROM pr GROUP BY 1)"""


@query("neighbour_distance_ratio", f"""
WITH {NEAR}, vs AS (SELECT 'n2' AS feature, own / (own + other) AS v FROM nn WHERE own + other > 0
  UNION ALL SELECT 'n3', (NOT hit)::int FROM nn), {summary_sql('vs', 6)} SELECT * FROM summed
UNION ALL SELECT 'lsc', round(1 - ((SELECT count(*) FROM pr JOIN nn USING (id) WHERE pr.d < nn.other) + (SELECT count(*) FROM nn WHERE other > 0))
  / pow((SELECT count(*) FROM pts), 2), 6)""")
def neighbourhood(spark, sf):
    return numbers(spark, complexity.neighbourhood(points(spark, sf)), 6)


@query("neighbourhood_density", f"""
WITH {NEAR}, al AS (SELECT id, nid, same, d FROM pr UNION ALL SELECT id, id, true, 0 FROM sp),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS r FROM al), n AS (SELECT count(*) AS n FROM sp),
ed AS (SELECT DISTINCT least(id, nid) AS a, greatest(id, nid) AS b FROM rk, n WHERE r <= floor(0.15 * n) AND same AND id <> nid)
SELECT 'density' AS feature, round(1 - 2 * (SELECT count(*) FROM ed) / (n * (n - 1)::double), 6) AS value FROM n""")
def neighbourhood_density(spark, sf):
    return numbers(spark, {"density": density.density(points(spark, sf))}, 6)


@query("hypersphere_cover", f"""
WITH RECURSIVE {NEAR}, en AS MATERIALIZED (SELECT id, arg_min(nid, (d, nid)) AS nid, min(d) AS d FROM pr WHERE NOT same GROUP BY 1),
e AS MATERIALIZED (SELECT x.id, x.nid, x.d, y.nid = x.id AS m FROM en x JOIN en y ON y.id = x.nid),
ch AS (SELECT id, id AS cur, 0.0::double AS s, 1 AS g, false AS done FROM e
  UNION ALL SELECT ch.id, e.nid, s + g * CASE WHEN m THEN d / 2 ELSE d END, -g, m FROM ch JOIN e ON e.id = ch.cur WHERE NOT done),
ra AS MATERIALIZED (SELECT id, round(s, 9) AS r FROM ch WHERE done),
ab AS (SELECT DISTINCT pr.id FROM pr JOIN ra q ON q.id = pr.id JOIN ra w ON w.id = pr.nid
  WHERE (w.r > q.r OR (w.r = q.r AND w.id < q.id)) AND pr.d + q.r <= w.r + 1e-7)
SELECT 't1' AS feature, round(1 - (SELECT count(*) FROM ab) / (SELECT count(*) FROM ra)::double, 6) AS value""")
def hypersphere_cover(spark, sf):
    return numbers(spark, {"t1": cover.cover_share(points(spark, sf))}, 6)


@query("border_share")
def border(spark, sf):
    return numbers(spark, {"n1": complexity.border_share(points(spark, sf))}, 6)


@query("minimum_spanning_tree")
def tree_edges(spark, sf):
    p = embedded(spark, sf).points()
    return complexity.spanning_tree(p.groupBy("x").agg(F.min("id").alias("id")).withColumn("label", F.lit("")))


@query("interpolated_neighbour_error")
def interpolated(spark, sf):
    return numbers(spark, {"n4": complexity.interpolated_error(points(spark, sf))}, 6)


@query("linearity")
def linearity(spark, sf):
    return numbers(spark, complexity.linearity(points(spark, sf)))


# ---- landmarks and trees ------------------------------------------------------------------------------

FOLD = """fd AS (SELECT doc_id AS id, ((row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('42|' || doc_id::varchar || '|0'), 1, 8))::bigint, doc_id) - 1) % 10)::int AS fold FROM labels)"""


@query("one_nearest_neighbour_landmark", f"""
WITH {document_points_sql()}, {FOLD}, q AS (SELECT pts.*, fold FROM pts JOIN fd USING (id)),
nn AS (SELECT a.id, any_value(a.fold) AS fold, any_value(a.label) AS label, arg_min(b.label, (round(list_distance(a.x, b.x), 9), b.id)) AS nlabel
  FROM q a JOIN q b ON a.fold <> b.fold GROUP BY 1),
vs AS (SELECT 'one_nn' AS feature, avg((label = nlabel)::int) AS v FROM nn GROUP BY fold), {summary_sql('vs', 6)} SELECT * FROM summed""")
def one_nn(spark, sf):
    return numbers(spark, {"one_nn": summarise(landmarks.one_nn(points(spark, sf)))}, 6)


@query("landmarks")
def all_landmarks(spark, sf):
    return numbers(spark, landmarks.landmarks(points(spark, sf)))


@query("tree_meta_features")
def tree_features(spark, sf):
    return numbers(spark, trees.tree(points(spark, sf)))
