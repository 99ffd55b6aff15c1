"""Resamplers on labelled documents, embeddings and conversation roles."""

from pyspark.sql import functions as F

from lopside.functions.draws import draw_sql, uniform_sql
from lopside.operators.neighbours import nearest
from lopside.operators.resample import RESAMPLERS
from lopside.operators.resample.common import class_sizes, minority, others
from lopside.operators.resample.over import cluster_smote
from lopside.operators.resample.under import first_store, misjudged, tomek_links
from lopside.session import pin
from lopside.sources.tables import with_row_id
from lopside.suite.base import (
    ALL_LABELS, EMBEDDED, LABELLED, ROLES, all_labels, document_points_sql, embedded, labelled_documents, query, roles, table,
)

DOCS = document_points_sql()
TOXIC = document_points_sql("toxic")

SIZES = """sz AS (SELECT label, count(*) AS n FROM pts GROUP BY 1),
low AS (SELECT label, n FROM sz ORDER BY n, label LIMIT 1),
short0 AS (SELECT label, n, (SELECT max(n) FROM sz) - n AS need FROM sz WHERE n < (SELECT max(n) FROM sz)),
short AS (SELECT *, coalesce(sum(need) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
  FROM short0),
few AS (SELECT p.* FROM pts p JOIN short USING (label))"""

DIST = "round(list_distance(q.x, d.x), 9)"


def knn(name, q, d, k, cond="true"):
    """A CTE: the k nearest rows of ``d`` to each row of ``q``."""
    return f"""{name} AS MATERIALIZED (SELECT * FROM (
  SELECT q.id, q.label, q.x, d.id AS nid, d.label AS nlabel, d.x AS nx, {DIST} AS dist,
    row_number() OVER (PARTITION BY q.id ORDER BY {DIST}, d.id) AS rank
  FROM {q} q JOIN {d} d ON d.id <> q.id AND {cond}) WHERE rank <= {k})"""


SAME = "d.label = q.label"
KEPT = "id, label, false AS is_synthetic, -1::bigint AS src_id, -1::bigint AS nbr_id, x"
REPORT = "SELECT id, label, is_synthetic, src_id, nbr_id, round(list_sum(x), 6) AS x_sum FROM res"


def report(points):
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return points.select(
        "id", "label", "is_synthetic", F.coalesce("src_id", F.lit(-1)).cast("bigint").alias("src_id"),
        F.coalesce("nbr_id", F.lit(-1)).cast("bigint").alias("nbr_id"), F.round(total, 6).alias("x_sum"),
    )


def run(name, source, **kw):
    return lambda spark, sf: report(RESAMPLERS[name](pin(source(spark, sf, **kw).points())))


def subset(*parts):
    """SQL keeping the rows of the CTE ``kept(id)``."""
    return ", ".join(parts) + f", res AS (SELECT {KEPT} FROM pts WHERE id IN (SELECT id FROM kept))\n{REPORT}"


# ---- distance operators on their own -------------------------------------------------

def plain(near):
    return near.select("id", "nid", "nlabel", "dist", F.col("rank").cast("bigint").alias("rank"))


NEAR = "SELECT id, nid, nlabel, dist, rank FROM nn"


@query("knn_join", f"WITH {EMBEDDED}, {knn('nn', 'pts', 'pts', 5)} {NEAR}")
def knn_join(spark, sf):
    p = pin(embedded(spark, sf).points())
    return plain(nearest(p, p, 5))


@query("knn_join_same_class", f"WITH {ALL_LABELS}, {knn('nn', 'pts', 'pts', 3, SAME)} {NEAR}")
def knn_join_same(spark, sf):
    p = pin(all_labels(spark, sf).points())
    return plain(nearest(p, p, 3, "same"))


@query("knn_join_other_class", f"WITH {DOCS}, {knn('nn', 'pts', 'pts', 2, 'd.label <> q.label')} {NEAR}")
def knn_join_other(spark, sf):
    p = pin(labelled_documents(spark, sf).points())
    return plain(nearest(p, p, 2, "other"))


@query("knn_join_manhattan", f"WITH {DOCS}, " + knn("nn", "pts", "pts", 3).replace(
    "list_distance(q.x, d.x)", "list_sum([abs(q.x[i] - d.x[i]) for i in range(1, 7)])") + " " + NEAR)
def knn_join_manhattan(spark, sf):
    p = pin(labelled_documents(spark, sf).points())
    return plain(nearest(p, p, 3, metric="l1"))


@query("knn_join_pivot_cells", f"WITH {ALL_LABELS}, {knn('nn', 'pts', 'pts', 4)} {NEAR}")
def knn_join_cells(spark, sf):
    p = pin(all_labels(spark, sf).points())
    return plain(nearest(p, p, 4, block_rows=64))


@query("tomek_links", f"""
WITH {EMBEDDED}, {knn('nn', 'pts', 'pts', 1)}
SELECT a.id, a.label, a.nid, a.nlabel FROM nn a JOIN nn b ON a.nid = b.id AND b.nid = a.id WHERE a.label <> a.nlabel""")
def links(spark, sf):
    return tomek_links(embedded(spark, sf).points())


# ---- under-sampling and cleaning -------------------------------------------------------

@query("resample_none", f"WITH {DOCS}, kept AS (SELECT id FROM pts), {subset('one AS (SELECT 1)')}")
def none(spark, sf):
    return report(RESAMPLERS["(no pre processing)"](labelled_documents(spark, sf).points()))


UNDER = f"""{SIZES},
ranked AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'id')}, id) AS r FROM pts),
kept AS (SELECT id FROM ranked WHERE r <= (SELECT n FROM low))"""
query("random_under_sampler", f"WITH {DOCS}, {subset(UNDER)}")(run("RandomUnderSampler", labelled_documents))
query("random_under_sampler_multiclass", f"WITH {ROLES}, {subset(UNDER)}")(run("RandomUnderSampler", roles))


@query("balanced_class_counts", f"""
WITH {DOCS}, {UNDER} SELECT label, count(*) AS n FROM pts WHERE id IN (SELECT id FROM kept) GROUP BY 1""")
def balanced_counts(spark, sf):
    under = RESAMPLERS["RandomUnderSampler"](pin(labelled_documents(spark, sf).points()))
    return under.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


NOT_LOW = "q.label <> (SELECT label FROM low)"


def edit_sql(name, source, k, where=NOT_LOW):
    """CTE ``name``: rows of ``source`` that survive one edit with k neighbours."""
    return f"""{knn(name + '_nn', source, source, k, where)},
{name} AS MATERIALIZED (SELECT id, label, x FROM {source}
  WHERE id NOT IN (SELECT id FROM {name}_nn WHERE nlabel <> label))"""


def chain(ks):
    steps, source = [], "pts"
    for i, k in enumerate(ks):
        steps.append(edit_sql(f"e{i}", source, k))
        source = f"e{i}"
    return ", ".join(steps) + f", kept AS (SELECT id FROM {source})"


query("edited_nearest_neighbours", f"WITH {DOCS}, {SIZES}, {subset(chain([3]))}")(
    run("EditedNearestNeighbours", labelled_documents))
query("edited_nearest_neighbours_multiclass", f"WITH {ROLES}, {SIZES}, {subset(chain([3]))}")(
    run("EditedNearestNeighbours", roles))
query("repeated_edited_nearest_neighbours", f"WITH {TOXIC}, {SIZES}, {subset(chain([3] * 12))}")(
    run("RepeatedEditedNearestNeighbours", labelled_documents, target="toxic"))
query("all_knn", f"WITH {DOCS}, {SIZES}, {subset(chain([1, 2, 3]))}")(run("AllKNN", labelled_documents))

NCR = f"""{knn('nn', 'pts', 'pts', 3)},
gone AS (SELECT id FROM nn WHERE nlabel <> label AND label <> (SELECT label FROM low)
  UNION SELECT n.nid FROM nn n JOIN sz ON sz.label = n.nlabel
  WHERE n.nlabel <> n.label AND n.label = (SELECT label FROM low) AND sz.n > 0.5 * (SELECT n FROM low)),
kept AS (SELECT id FROM pts WHERE id NOT IN (SELECT id FROM gone))"""
query("neighbourhood_cleaning_rule", f"WITH {DOCS}, {SIZES}, {subset(NCR)}")(
    run("NeighbourhoodCleaningRule", labelled_documents))
query("neighbourhood_cleaning_rule_multiclass", f"WITH {ROLES}, {SIZES}, {subset(NCR)}")(
    run("NeighbourhoodCleaningRule", roles))


def tomek_sql(source, where="label <> (SELECT label FROM low)"):
    return f"""{knn('tn', source, source, 1)},
gone AS (SELECT a.id FROM tn a JOIN tn b ON a.nid = b.id AND b.nid = a.id WHERE a.label <> a.nlabel AND a.{where}),
kept AS (SELECT id FROM {source} WHERE id NOT IN (SELECT id FROM gone))"""


query("tomek_links_removed", f"WITH {EMBEDDED}, {SIZES}, {subset(tomek_sql('pts'))}")(run("TomekLinks", embedded))
query("tomek_links_removed_documents", f"WITH {DOCS}, {SIZES}, {subset(tomek_sql('pts'))}")(
    run("TomekLinks", labelled_documents))

STORE = f"""store0 AS MATERIALIZED (SELECT p.* FROM pts p WHERE label = (SELECT label FROM low) OR id = (
  SELECT id FROM pts WHERE label <> (SELECT label FROM low) ORDER BY {draw_sql(42, 'id')}, id LIMIT 1))"""


def condense_sql(rounds):
    steps = [STORE]
    for i in range(rounds):
        rest = f"rest{i} AS (SELECT * FROM pts WHERE id NOT IN (SELECT id FROM store{i}))"
        steps += [rest, knn(f"cn{i}", f"rest{i}", f"store{i}", 1),
                  f"""store{i + 1} AS MATERIALIZED (SELECT * FROM store{i} UNION ALL
  SELECT id, label, x FROM cn{i} WHERE nlabel <> label)"""]
    return ", ".join(steps)


@query("condense_one_round", f"""
WITH {DOCS}, {SIZES}, {condense_sql(1)} SELECT id, label FROM cn0 WHERE nlabel <> label""")
def condense_round(spark, sf):
    p = pin(labelled_documents(spark, sf).points())
    sizes = class_sizes(p)
    c = others(sizes)[0]
    store = first_store(p, minority(sizes), c)
    rest = p.filter(F.col("label") == c).join(store.select("id"), "id", "left_anti")
    return misjudged(rest, store).select("id", "label")


query("condensed_nearest_neighbour",
      f"WITH {DOCS}, {SIZES}, {condense_sql(12)}, {subset('kept AS (SELECT id FROM store12)')}")(
    run("CondensedNearestNeighbour", labelled_documents))
query("one_sided_selection", f"WITH {EMBEDDED}, {SIZES}, {condense_sql(1)}, {subset(tomek_sql('store1'))}")(
    run("OneSidedSelection", embedded))

MISS = f"""rest AS (SELECT * FROM pts WHERE label <> (SELECT label FROM low)),
lowest AS (SELECT * FROM pts WHERE label = (SELECT label FROM low)),
{knn('nn', 'rest', 'lowest', 3)},
far AS (SELECT id, label, round(avg(dist), 9) AS dist FROM nn GROUP BY 1, 2),
kept AS (SELECT id FROM lowest UNION ALL SELECT id FROM (
  SELECT id, row_number() OVER (PARTITION BY label ORDER BY dist, id) AS r FROM far) WHERE r <= (SELECT n FROM low))"""
query("near_miss", f"WITH {DOCS}, {SIZES}, {subset(MISS)}")(run("NearMiss", labelled_documents))
query("near_miss_multiclass", f"WITH {ROLES}, {SIZES}, {subset(MISS)}")(run("NearMiss", roles))


# ---- over-sampling ----------------------------------------------------------------------

RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'id')}, id) AS rank FROM few)"
PICKS = f"""picks AS (SELECT label, start + j AS no, floor({uniform_sql(42, 'label', 'j')} * n)::bigint + 1 AS rank,
  floor({uniform_sql(42, 'label', 'j', "'nn'")} * k)::bigint + 1 AS nrank, {uniform_sql(42, 'label', 'j', "'gap'")} AS u
  FROM (SELECT label, start, n, k, unnest(range(need)) AS j FROM short_k))"""
SHORT_K = "short_k AS (SELECT *, least(5, n - 1) AS k FROM short)"
BETWEEN = "[s.x[i] + u * (m.nx[i] - s.x[i]) for i in range(1, len(s.x) + 1)]"
SMOTE = f"""{RANKED}, {SHORT_K}, {PICKS}, {knn('nn', 'few', 'few', 5, SAME)},
fresh AS (SELECT -1 - p.no AS id, p.label, true AS is_synthetic, s.id AS src_id, m.nid AS nbr_id, {BETWEEN} AS x
  FROM picks p JOIN ranked s USING (label, rank) JOIN nn m ON m.id = s.id AND m.rank = p.nrank),
res AS (SELECT {KEPT} FROM pts UNION ALL SELECT * FROM fresh)"""
for _name, _sql, _src in (("smote", DOCS, labelled_documents), ("smote_embeddings", EMBEDDED, embedded),
                          ("smote_multiclass", ROLES, roles)):
    query(_name, f"WITH {_sql}, {SIZES}, {SMOTE}\n{REPORT}")(run("SMOTE", _src))

OVER = f"""{RANKED}, {SHORT_K}, {PICKS},
res AS (SELECT {KEPT} FROM pts UNION ALL
  SELECT -1 - p.no, p.label, true, s.id, -1, s.x FROM picks p JOIN ranked s USING (label, rank))"""
query("random_over_sampler", f"WITH {DOCS}, {SIZES}, {OVER}\n{REPORT}")(run("RandomOverSampler", labelled_documents))
query("random_over_sampler_multiclass", f"WITH {ROLES}, {SIZES}, {OVER}\n{REPORT}")(run("RandomOverSampler", roles))


@query("random_over_sampler_lineitem", """
WITH c AS (SELECT (l_quantity >= 48)::varchar AS label, count(*) AS n FROM lineitem GROUP BY 1)
SELECT label, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS n_synthetic FROM c""")
def over_lineitem(spark, sf):
    # (order, line) repeats in this table, so rows are numbered by their whole content
    df = pin(with_row_id(table(spark, sf, "lineitem"), "id"))
    df = df.select(
        "id", (F.col("l_quantity") >= 48).cast("string").alias("label"),
        F.array("l_extendedprice", "l_discount", "l_tax").alias("x"),
    )
    grown = RESAMPLERS["RandomOverSampler"](df)
    return grown.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_synthetic"), 1)).alias("n_synthetic"))


ADASYN = f"""{SHORT_K}, {knn('an', 'few', 'pts', 5)}, {knn('nn', 'few', 'few', 5, SAME)},
f AS (SELECT id, label, count(*) FILTER (nlabel <> label) AS foreigners FROM an GROUP BY 1, 2),
t AS (SELECT label, sum(foreigners)::double AS t FROM f GROUP BY 1),
g AS (SELECT f.id, f.label, k, round_even(foreigners / t * need::double, 0)::bigint AS g
  FROM f JOIN t USING (label) JOIN short_k USING (label)),
b AS (SELECT *, coalesce(sum(g) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
  FROM g WHERE g > 0),
copies AS (SELECT *, unnest(range(g)) AS j FROM b),
picks AS (SELECT id, label, before + j AS no, floor({uniform_sql(42, 'label', 'id', 'j', "'nn'")} * k)::bigint + 1 AS nrank,
  {uniform_sql(42, 'label', 'id', 'j', "'gap'")} AS u FROM copies),
fresh AS (SELECT -1 - p.no AS id, p.label, true AS is_synthetic, s.id AS src_id, m.nid AS nbr_id, {BETWEEN} AS x
  FROM picks p JOIN few s USING (id) JOIN nn m ON m.id = p.id AND m.rank = p.nrank),
res AS (SELECT {KEPT} FROM pts UNION ALL SELECT * FROM fresh)"""
query("adasyn", f"WITH {DOCS}, {SIZES}, {ADASYN}\n{REPORT}")(run("ADASYN", labelled_documents))
query("adasyn_multiclass", f"WITH {ROLES}, {SIZES}, {ADASYN}\n{REPORT}")(run("ADASYN", roles))

BORDER = f"""{knn('bn', 'few', 'pts', 10)},
f AS (SELECT id, count(*) FILTER (nlabel <> label) AS foreigners, count(*) AS m FROM bn GROUP BY 1),
danger AS (SELECT few.* FROM few JOIN f USING (id) WHERE foreigners * 2 >= m AND foreigners < m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'id')}, id) AS rank FROM danger),
dn AS (SELECT label, count(*) AS n FROM danger GROUP BY 1),
short_k AS (SELECT s.label, s.need, s.start, dn.n, least(5, s.n - 1) AS k FROM short s JOIN dn USING (label)),
{PICKS}, {knn('nn', 'danger', 'few', 5, SAME)},
fresh AS (SELECT -1 - p.no AS id, p.label, true AS is_synthetic, s.id AS src_id, m.nid AS nbr_id, {BETWEEN} AS x
  FROM picks p JOIN ranked s USING (label, rank) JOIN nn m ON m.id = s.id AND m.rank = p.nrank),
res AS (SELECT {KEPT} FROM pts UNION ALL SELECT * FROM fresh)"""
query("borderline_smote", f"WITH {DOCS}, {SIZES}, {BORDER}\n{REPORT}")(run("BorderlineSMOTE", labelled_documents))

CLUSTERED = f"""cl AS (SELECT p.*, CASE d.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS cluster
  FROM pts p JOIN documents d ON d.doc_id = p.id),
mix AS (SELECT cluster, count(*) AS total, count(*) FILTER (label = (SELECT label FROM low)) AS n FROM cl GROUP BY 1),
need AS (SELECT need FROM short),
good AS (SELECT cluster, n FROM mix WHERE n / total::double >= 0.1 AND n > 2),
mine AS (SELECT cl.* FROM cl JOIN good USING (cluster) WHERE label = (SELECT label FROM low)),
md AS (SELECT a.cluster, sum(list_distance(a.x, b.x)) AS s FROM mine a JOIN mine b USING (cluster) GROUP BY 1),
sp AS (SELECT cluster, n, pow(s / (n * n - n), pow(ln(n) / ln(1.6), 1.8) * 0.16) / n AS v FROM md JOIN good USING (cluster)),
wn AS (SELECT cluster::varchar AS label, n, least(2, n - 1) AS k,
  ceil(round((SELECT need FROM need) * v / (SELECT sum(v) FROM sp), 9))::bigint AS need, cluster FROM sp),
short_k AS (SELECT *, coalesce(sum(need) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM wn),
grp AS (SELECT id, cluster::varchar AS label, x FROM mine),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'id')}, id) AS rank FROM grp),
{PICKS}, {knn('nn', 'grp', 'grp', 2, SAME)},
fresh AS (SELECT -1 - p.no AS id, (SELECT label FROM low) AS label, true AS is_synthetic, s.id AS src_id, m.nid AS nbr_id, {BETWEEN} AS x
  FROM picks p JOIN ranked s USING (label, rank) JOIN nn m ON m.id = s.id AND m.rank = p.nrank),
res AS (SELECT {KEPT} FROM pts UNION ALL SELECT * FROM fresh)"""


@query("cluster_smote_given_clusters", f"WITH {DOCS}, {SIZES}, {CLUSTERED}\n{REPORT}")
def cluster_smote_languages(spark, sf):
    docs = table(spark, sf, "documents")
    code = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    clusters = docs.select(F.col("doc_id").alias("id"), code.alias("cluster"))
    return report(cluster_smote(labelled_documents(spark, sf).points(), clusters, balance=0.1))


GROWN = "grown AS MATERIALIZED (SELECT id, label, x, is_synthetic, src_id, nbr_id FROM res)"
AFTER = "SELECT id, label, is_synthetic, src_id, nbr_id, round(list_sum(x), 6) AS x_sum FROM grown WHERE id IN (SELECT id FROM kept)"
query("smote_enn", f"""WITH {DOCS}, {SIZES}, {SMOTE}, {GROWN},
{edit_sql('kept', 'grown', 3, 'true')}
{AFTER}""")(run("SMOTEENN", labelled_documents))
query("smote_tomek", f"""WITH {EMBEDDED}, {SIZES}, {SMOTE}, {GROWN}, {tomek_sql('grown', 'label IS NOT NULL')}
{AFTER}""")(run("SMOTETomek", embedded))


# ---- resamplers built on fitted models: row checks only ------------------------------------

def counts_only(name, source, **kw):
    def go(spark, sf):
        out = RESAMPLERS[name](pin(source(spark, sf, **kw).points()))
        return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_synthetic"), 1)).alias("n_synthetic"))
    return go


@query("kmeans_smote")
def kmeans(spark, sf):
    # the default share threshold finds no cluster in this table; a lower one does
    return report(RESAMPLERS["KMeansSMOTE"](labelled_documents(spark, sf).points(), balance=0.1))


EVEN = f"""WITH {{pts}}, {SIZES} SELECT label, (SELECT max(n) FROM sz) AS n, (SELECT max(n) FROM sz) - n AS n_synthetic FROM sz"""
LEVEL = f"""WITH {{pts}}, {SIZES} SELECT label, (SELECT n FROM low) AS n, {{made}} AS n_synthetic FROM sz"""
query("svm_smote_counts", EVEN.format(pts=DOCS))(counts_only("SVMSMOTE", labelled_documents))
query("cluster_centroids_counts", LEVEL.format(
    pts=EMBEDDED, made="CASE WHEN label = (SELECT label FROM low) THEN 0 ELSE (SELECT n FROM low) END"))(
    counts_only("ClusterCentroids", embedded))
query("instance_hardness_counts", LEVEL.format(pts=DOCS, made="0::bigint"))(
    counts_only("InstanceHardnessThreshold", labelled_documents))
