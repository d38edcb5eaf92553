"""Duplicates, groups, splits, samples, manifests and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import BASE_RATE_PREVALENCES
from sitesift.functions.urls import canonicalize_url
from sitesift.operators import bootstrap as B
from sitesift.operators import groups as G
from sitesift.operators import sampling as P
from sitesift.operators import splits as X
from sitesift.operators.manifests import manifest_hash, ordered_id_hash
from sitesift.operators.ordering import ordered_positions, ranked_positions, seeded_hash
from sitesift.operators.scoring import align_by_id, missing_extra_ids
from sitesift.plans.catalog.inputs import (
    AP_EXPR, AUC_EXPR, ORDER_SQL, canonical_sql, order_scores, ranking_sql, table,
)
from sitesift.plans.catalog.metric_queries import _AT, _METRICS, rounded
from sitesift.plans.catalog.registry import query


# --- duplicates ----------------------------------------------------------------------

# Page rows twice, the second time with a trailing slash and a later position.
_TWICE = f"""twice AS (SELECT page_id AS ord, url FROM pages UNION ALL SELECT page_id + 1000000000, split_part(url, '#', 1) || '#again' FROM pages),
{canonical_sql('twice', 'ord')}"""


def _twice(spark, sf):
    p = table(spark, sf, "pages")
    again = F.concat(F.substring_index("url", "#", 1), F.lit("#again"))
    rows = p.select(F.col("page_id").alias("ord"), "url").unionByName(p.select((F.col("page_id") + 1000000000).alias("ord"), again.alias("url")))
    return rows.withColumn("sample_id", F.sha2(canonicalize_url(F.col("url")), 256))


@query("dedupe_keep_first", f"WITH {_TWICE} SELECT min(ord) AS ord, min_by(url, ord) AS url, sha256(canonical) AS sample_id FROM canon GROUP BY canonical")
def _(spark, sf):
    return G.dedupe_keep_first(_twice(spark, sf), "sample_id", "ord")


@query("label_conflicts", "SELECT md5(text) AS sample_id FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT toxic) > 1 UNION ALL "
       "SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT toxic) > 1")
def _(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    long = rows.select(F.explode(F.array(F.md5("text"), "source")).alias("sample_id"), F.col("toxic").alias("label"))
    return G.label_conflicts(long)


# --- connected groups ----------------------------------------------------------------

_CHAIN = """chain AS (SELECT o_orderkey, 'd' || lpad((o_orderkey // 4)::VARCHAR, 12, '0') AS registrable_domain,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'f' || (o_orderkey // 5) END AS source_family_id FROM orders)"""


def _chain(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("d"), F.lpad(F.floor(key / 4).cast("string"), 12, "0")).alias("registrable_domain"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("f"), F.floor(key / 5).cast("string"))).alias("source_family_id"),
    )


@query("connected_groups", f"""WITH RECURSIVE {_CHAIN},
e AS (SELECT DISTINCT 'domain:' || registrable_domain AS d, CASE WHEN source_family_id = '' THEN 'domain:' || registrable_domain ELSE 'family:' || source_family_id END AS f FROM chain),
dd AS (SELECT DISTINCT a.d AS x, b.d AS y FROM e a JOIN e b USING (f)),
reach(x, y) AS (SELECT x, y FROM dd UNION SELECT r.x, dd.y FROM reach r JOIN dd ON dd.x = r.y),
root AS (SELECT x, min(y) AS "group" FROM reach GROUP BY x)
SELECT o_orderkey, "group" FROM chain JOIN root ON root.x = 'domain:' || registrable_domain""")
def _(spark, sf):
    return G.connected_groups(_chain(spark, sf)).select("o_orderkey", "group")


# Chains of orders are walked one domain at a time, so the groups follow from gaps between neighbours.
@query("component_join", f"""WITH {_CHAIN},
e AS (SELECT DISTINCT registrable_domain AS d, source_family_id AS f FROM chain WHERE source_family_id <> ''),
links AS (SELECT DISTINCT a.d AS d, b.d AS prev FROM e a JOIN e b ON a.f = b.f AND b.d < a.d),
nodes AS (SELECT DISTINCT registrable_domain AS d FROM chain),
cuts AS (SELECT n.d, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.d = n.d) THEN 0 ELSE 1 END AS is_start FROM nodes n),
runs AS (SELECT d, sum(is_start) OVER (ORDER BY d) AS run FROM cuts)
SELECT 'domain:' || min(d) AS root, count(*) AS domains FROM runs GROUP BY run""")
def _(spark, sf):
    chain = _chain(spark, sf)
    edges = chain.select(
        F.concat(F.lit("domain:"), "registrable_domain").alias("a"),
        F.when(F.col("source_family_id") == "", F.concat(F.lit("domain:"), "registrable_domain"))
        .otherwise(F.concat(F.lit("family:"), "source_family_id")).alias("b"),
    )
    nodes = G.connected_components(edges).where(F.startswith("node", F.lit("domain:")))
    return nodes.groupBy("root").agg(F.count(F.lit(1)).alias("domains"))


# --- splits --------------------------------------------------------------------------

_SPLIT = """os AS (SELECT 'o' || o_orderkey AS sample_id, 'c' || o_custkey AS "group", CAST(o_orderstatus = 'F' AS INT) AS label FROM orders),
sg AS (SELECT "group", (sum(label) * 2 > count(*))::INT AS major, floor(log2(count(*)))::INT AS size, md5('42:' || "group") AS h FROM os GROUP BY "group"),
sr AS (SELECT *, row_number() OVER (PARTITION BY major, size ORDER BY h, "group") AS rank FROM sg),
sc AS (SELECT major, size, coalesce(sum(count(*)) OVER (ORDER BY major, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sg GROUP BY major, size),
sf AS (SELECT "group", [2, 3, 4, 1, 0][((rank - 1 + off) % 5 + 1)::INT]::INT AS fold FROM sr JOIN sc USING (major, size)),
split AS (SELECT sample_id, "group", label, fold, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM os JOIN sf USING ("group"))"""


def split_rows(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("sample_id"), F.concat(F.lit("c"), "o_custkey").alias("group"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


@query("grouped_split", f'WITH {_SPLIT} SELECT sample_id, "group", label, fold, split FROM split')
def _(spark, sf):
    return X.grouped_split(split_rows(spark, sf)).select("sample_id", "group", "label", "fold", "split")


_LEAVES = """{n}h AS (SELECT DISTINCT {k} sha256({i}) AS h FROM {s}),
{n}l AS (SELECT {k} substr(h, 1, 4) AS leaf, sha256(string_agg(h, chr(10) ORDER BY h) || chr(10)) AS d FROM {n}h GROUP BY {k} leaf),
{n}b AS (SELECT {k} substr(leaf, 1, 2) AS br, sha256(string_agg(d, chr(10) ORDER BY leaf) || chr(10)) AS d FROM {n}l GROUP BY {k} br),
{n} AS (SELECT {k} sha256(string_agg(d, chr(10) ORDER BY br) || chr(10)) AS manifest FROM {n}b {g})"""


def manifest_sql(name: str, source: str, ident: str = "sample_id", key: str = "") -> str:
    return _LEAVES.format(n=name, s=source, i=ident, k=f"{key}, " if key else "", g=f"GROUP BY {key}" if key else "")


@query("split_summary", f"""WITH {_SPLIT}, {manifest_sql('mf', 'split', key='split')}, c AS (SELECT split, count(*) AS rows, count_if(label = 0)::BIGINT AS benign, count_if(label = 1)::BIGINT AS phishing,
  count(DISTINCT "group") AS groups FROM split GROUP BY split) SELECT * FROM c JOIN mf USING (split)""")
def _(spark, sf):
    return X.split_summary(X.grouped_split(split_rows(spark, sf)))


@query("split_overlap", f"""WITH {_SPLIT}, bad AS (SELECT sample_id, "group", split FROM split UNION ALL
  SELECT sample_id, "group", 'test' FROM split WHERE fold = 3 AND label = 1),
u AS (SELECT 'sample_id' AS kind, sample_id AS v, split FROM bad UNION SELECT 'group', "group", split FROM bad),
pairs AS (SELECT a.kind, a.split || '_' || b.split AS pair, count(*) AS n FROM u a JOIN u b ON a.kind = b.kind AND a.v = b.v
  AND (a.split, b.split) IN (('train', 'validation'), ('train', 'test'), ('validation', 'test')) GROUP BY 1, 2)
SELECT kind, pair, coalesce(n, 0)::BIGINT AS shared, coalesce(n, 0) = 0 AS disjoint
FROM (VALUES ('sample_id'), ('group')) k(kind) CROSS JOIN (VALUES ('train_validation'), ('train_test'), ('validation_test')) p(pair) LEFT JOIN pairs USING (kind, pair)""")
def _(spark, sf):
    rows = X.grouped_split(split_rows(spark, sf)).select("sample_id", "group", "label", "fold", "split")
    leaked = rows.where((F.col("fold") == 3) & (F.col("label") == 1)).withColumn("split", F.lit("test"))
    return X.split_overlap(rows.unionByName(leaked))


@query("official_split", """SELECT 'o' || o_orderkey AS sample_id, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS split FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "validation").otherwise("test").alias("split"),
    )
    return X.official_split(rows)


@query("oof_folds", "SELECT doc_id, toxic AS label, ((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 1) % 3)::INT AS fold FROM labels")
def _(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return X.oof_folds(rows, "doc_id")


@query("epoch_shuffle", "SELECT 'o' || o_orderkey AS sample_id, row_number() OVER (ORDER BY md5('42:1:o' || o_orderkey), o_orderkey) AS rank FROM orders")
def _(spark, sf):
    rows = order_scores(spark, sf).select("sample_id", seeded_hash("42:1", F.col("sample_id")).alias("h"))
    return ranked_positions(rows, "h", "sample_id").select("sample_id", "rank")


# --- manifests -----------------------------------------------------------------------


@query("sample_manifest_hash", f"""WITH {_SPLIT}, {manifest_sql('mf', 'os', key='label')} SELECT label, manifest FROM mf""")
def _(spark, sf):
    return manifest_hash(split_rows(spark, sf), "sample_id", ["label"])


@query("ordered_id_hash", f"""WITH r AS (SELECT 'o' || o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS p FROM orders),
l1 AS (SELECT p // 4096 AS b, sha256(string_agg('{{"id":"' || id || '"}}', chr(10) ORDER BY p) || chr(10)) AS d FROM r GROUP BY 1),
l2 AS (SELECT b // 4096 AS b, sha256(string_agg(d, chr(10) ORDER BY b) || chr(10)) AS d FROM l1 GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY b) || chr(10)) AS order_hash FROM l2""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), (-F.col("o_orderkey")).alias("neg"))
    return ordered_id_hash(ordered_positions(rows, "neg"), "id", "pos")


# --- prevalence samples ----------------------------------------------------------------

_RATES = ", ".join(f"({r}::DOUBLE)" for r in BASE_RATE_PREVALENCES + [0.6])
_SAMPLE = f"""{ORDER_SQL}, sz AS (SELECT count_if(label = 0) AS n0, count_if(label = 1) AS n1 FROM oscored),
q AS (SELECT rate, n0, n1, round_even(rate * n0 / (1 - rate), 0) AS k1 FROM sz, (VALUES {_RATES}) t(rate)),
qq AS (SELECT rate, CASE WHEN k1 <= n1 THEN n0 ELSE least(n0, round_even(n1 * (1 - rate) / rate, 0)) END AS take0, CASE WHEN k1 <= n1 THEN k1 ELSE n1 END AS take1 FROM q),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) AS r FROM oscored),
sample AS (SELECT rate, sample_id, label, score, other FROM rk JOIN qq ON r <= CASE WHEN label = 0 THEN take0 ELSE take1 END)"""


@query("base_rate_sample", f"WITH {_SAMPLE} SELECT rate, sample_id, label FROM sample")
def _(spark, sf):
    rates = BASE_RATE_PREVALENCES + [0.6]
    return P.base_rate_sample(order_scores(spark, sf), rates).select("rate", "sample_id", "label")


@query("base_rate_report", f"""WITH {_SAMPLE}, m AS (SELECT rate, {_AT}, avg((score - label) * (score - label)) AS brier FROM sample GROUP BY rate),
{ranking_sql('sample', 'rate')}, r AS (SELECT rate, round({AP_EXPR}, 9) AS average_precision, round({AUC_EXPR}, 9) AS roc_auc FROM prefix GROUP BY rate),
{manifest_sql('mf', 'sample', key='rate')}, a AS (SELECT rate, {_METRICS}, round(brier, 9) AS brier FROM m)
SELECT rate AS requested_prevalence, round((tp + fn) / (tp + fn + tn + fp), 9) AS actual_prevalence, tp + fn + tn + fp AS total, tn + fp AS benign, fn + tp AS phishing, manifest,
  precision, recall, f1, accuracy, false_positive_rate, brier, average_precision, roc_auc FROM a JOIN r USING (rate) JOIN mf USING (rate)""")
def _(spark, sf):
    return rounded(P.base_rate_report(order_scores(spark, sf), 0.5, BASE_RATE_PREVALENCES + [0.6]))


# --- bootstrap ---------------------------------------------------------------------------


_REPLICATES = 100
_DRAWS = f"""paired AS (SELECT doc_id, toxic AS label, quality * 0.5 + (doc_id % 10) / 20.0 AS left_score, (length(text) % 100) / 100.0 AS right_score FROM labels JOIN documents USING (doc_id)),
pos AS (SELECT *, row_number() OVER (ORDER BY md5('position:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS n FROM paired),
sz AS (SELECT count(*) AS n FROM paired),
ks AS (SELECT b.range AS replicate, k.range AS k FROM range({_REPLICATES}) b, (SELECT unnest(range(0, n)) AS range FROM sz) k),
drawn AS (SELECT replicate, ('0x' || substr(md5('7:' || replicate || ':' || k), 1, 15))::BIGINT % n AS p FROM ks, sz),
sides AS (SELECT replicate, 'left' AS side, label, left_score::DOUBLE AS score FROM drawn JOIN pos USING (p) UNION ALL SELECT replicate, 'right', label, right_score::DOUBLE FROM drawn JOIN pos USING (p)),
{ranking_sql('sides', 'replicate, side')}, ap AS (SELECT replicate, side, {AP_EXPR} AS ap FROM prefix GROUP BY replicate, side),
f AS (SELECT replicate, side, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT replicate, side, {_AT} FROM sides GROUP BY replicate, side)),
diffs AS (SELECT replicate, sum(CASE side WHEN 'left' THEN ap ELSE -ap END) AS ap_diff, sum(CASE side WHEN 'left' THEN f1 ELSE -f1 END) AS f1_diff FROM ap JOIN f USING (replicate, side) GROUP BY replicate),
longd AS (SELECT 'ap_diff' AS metric, ap_diff AS diff FROM diffs UNION ALL SELECT 'f1_diff', f1_diff FROM diffs),
ci AS (SELECT metric, round(quantile_cont(diff, 0.025), 8) AS p2_5, round(quantile_cont(diff, 0.5), 8) AS p50, round(quantile_cont(diff, 0.975), 8) AS p97_5 FROM longd GROUP BY metric)"""


def _paired(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.col("toxic").alias("label"),
        (F.col("quality") * 0.5 + F.pmod("doc_id", F.lit(10)) / 20.0).cast("double").alias("left_score"),
        (F.pmod(F.length("text"), F.lit(100)) / 100.0).cast("double").alias("right_score"),
    )


def _intervals(spark, sf):
    out = B.paired_bootstrap(_paired(spark, sf), 0.5, 0.5, _REPLICATES, seed=7, id_column="doc_id")
    return rounded(out, 8)


@query("paired_bootstrap", f"WITH {_DRAWS} SELECT * FROM ci")
def _(spark, sf):
    return _intervals(spark, sf)


@query("ci_gate", f"WITH {_DRAWS} SELECT *, p2_5 > 0 OR p97_5 < 0 AS claim FROM ci")
def _(spark, sf):
    return B.ci_gate(_intervals(spark, sf))


# --- alignment and id sets ---------------------------------------------------------------

_SIDES = """l AS (SELECT 'd' || doc_id AS sample_id, toxic AS label, quality * 1.0 AS score FROM labels),
r AS (SELECT 'd' || doc_id AS sample_id, (lang = 'en')::INT AS label, n_chars / 100000.0 AS score FROM documents)"""


def _sides(spark, sf):
    left = table(spark, sf, "labels").select(
        F.concat(F.lit("d"), "doc_id").alias("sample_id"), F.col("toxic").alias("label"), F.col("quality").cast("double").alias("score")
    )
    right = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("sample_id"), (F.col("lang") == "en").cast("int").alias("label"), (F.col("n_chars") / 100000.0).alias("score")
    )
    return left, right


@query("align_by_id", f"""WITH {_SIDES} SELECT sample_id, l.label AS left_label, r.label AS label, round(l.score::DOUBLE, 9) AS left_score, round(r.score::DOUBLE, 9) AS right_score,
  CASE WHEN r.label IS NULL THEN 'missing' WHEN l.label IS NULL THEN 'extra' WHEN l.label <> r.label THEN 'label_conflict' ELSE 'ok' END AS status FROM l FULL JOIN r USING (sample_id)""")
def _(spark, sf):
    return align_by_id(*_sides(spark, sf)).withColumns({c: F.round(F.col(c).cast("double"), 9) for c in ("left_score", "right_score")})


@query("missing_extra_ids", "SELECT DISTINCT c_custkey AS id, 'missing' AS side FROM customer ANTI JOIN orders ON o_custkey = c_custkey UNION ALL "
       "SELECT DISTINCT o_custkey, 'extra' FROM orders ANTI JOIN customer ON c_custkey = o_custkey")
def _(spark, sf):
    return missing_extra_ids(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
        table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id",
    )


@query("id_set_difference", "(SELECT p_partkey AS id, 'left' AS side FROM part EXCEPT SELECT l_partkey, 'left' FROM lineitem) UNION ALL "
       "(SELECT l_suppkey, 'right' FROM lineitem EXCEPT SELECT s_nationkey, 'right' FROM supplier)")
def _(spark, sf):
    line = table(spark, sf, "lineitem")
    left = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).subtract(line.select("l_partkey"))
    right = line.select(F.col("l_suppkey").alias("id")).subtract(table(spark, sf, "supplier").select("s_nationkey"))
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))
