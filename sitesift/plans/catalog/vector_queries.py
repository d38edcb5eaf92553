"""Text, hashing, vector and linear scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import (
    BOOLEAN_FEATURES, COUNT_FEATURES, HASH_DIM, NUMERIC_FEATURES, RATIO_FEATURES,
)
from sitesift.functions.hashing import char_ngrams, fnv1a32, hashed_buckets
from sitesift.functions.html import page_title
from sitesift.functions.normalize import fold_text
from sitesift.operators import scoring as S
from sitesift.operators.records import all_features
from sitesift.operators.screening import screen_columns
from sitesift.operators.vectors import sigmoid, transform_numeric, vectorize
from sitesift.operators import metrics as M
from sitesift.plans.catalog.html_queries import TITLE_SQL, page_features_sql
from sitesift.plans.catalog.inputs import (
    LINE_SQL, RICH_SQL, WEIGHTS_SQL, formula_weights, line_scores, rich_pages, spread, table,
)
from sitesift.plans.catalog.registry import query
from sitesift.plans.models import TREE_HASH_DIM


@query("normalize_text", "SELECT doc_id, md5(lower(text)) AS folded FROM documents")
def _(spark, sf):
    return long_documents(spark, sf).select("doc_id", F.md5(fold_text(F.col("text"))).alias("folded"))


_GRAMS = """SELECT page_id, ns || ':' || substr(t, i::INT, n::INT) AS gram
  FROM (SELECT page_id, ns, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM texts, (VALUES (3), (4), (5)) s(n) WHERE length(t) >= n)"""


@query("char_ngrams", f"""WITH texts AS (SELECT page_id, 'url' AS ns, lower(url) AS t FROM pages), g AS ({_GRAMS})
SELECT page_id, gram, count(*) AS n FROM g GROUP BY page_id, gram""")
def _(spark, sf):
    grams = table(spark, sf, "pages").select("page_id", F.explode(char_ngrams("URL", F.col("url"))).alias("gram"))
    return grams.groupBy("page_id", "gram").agg(F.count(F.lit(1)).alias("n"))


def _fnv_sql(expression: str) -> str:
    """FNV-1a over the hex text of the UTF-8 bytes."""
    return f"""list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, length(hex(encode({expression}))) // 2),
      lambda i: ('0x' || substr(hex(encode({expression})), (2 * i + 1)::INT, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"""


@query("fnv1a32", f"WITH RECURSIVE t AS (SELECT DISTINCT text AS x FROM benchmark UNION SELECT url FROM pages) SELECT x, {_fnv_sql('x')} AS hash FROM t")
def _(spark, sf):
    texts = table(spark, sf, "benchmark").select(F.col("text").alias("x")).union(table(spark, sf, "pages").select("url")).distinct()
    return texts.select("x", fnv1a32(F.col("x")).alias("hash"))


_BUCKETS = f"""{TITLE_SQL}, texts AS (SELECT page_id, 'url' AS ns, lower(url) AS t FROM rich UNION ALL SELECT page_id, 'title', lower(title) FROM titles),
grams AS ({_GRAMS}), dg AS (SELECT DISTINCT gram FROM grams), hg AS (SELECT gram, {_fnv_sql('gram')} % {HASH_DIM} AS bucket FROM dg),
buckets AS (SELECT DISTINCT page_id, bucket FROM grams JOIN hg USING (gram))"""


@query("hashed_buckets", f"WITH {RICH_SQL}, {_BUCKETS} SELECT page_id, bucket::INT AS bucket FROM buckets")
def _(spark, sf):
    titled = rich_pages(spark, sf).withColumn("title", page_title(F.col("html")))
    return titled.select("page_id", F.explode(hashed_buckets(F.col("url"), F.col("title"))).alias("bucket"))


@query("screen_columns", f"""WITH {RICH_SQL}, {_BUCKETS}, lab AS (SELECT page_id, starts_with(url, 'http:') AS hit FROM rich),
n AS (SELECT count_if(hit)::DOUBLE AS p, count_if(NOT hit)::DOUBLE AS q FROM lab),
ab AS (SELECT bucket, count_if(hit)::DOUBLE AS a, count_if(NOT hit)::DOUBLE AS b FROM buckets JOIN lab USING (page_id) GROUP BY bucket),
t AS (SELECT bucket, a, b, p - a AS c, q - b AS d FROM ab, n),
x AS (SELECT *, (a + b) * (c + d) * (a + c) * (b + d) AS spread FROM t),
s AS (SELECT bucket, a, b, CASE WHEN spread > 0 THEN (a + b + c + d) * pow(a * d - b * c, 2) / spread ELSE 0.0 END AS chi FROM x)
SELECT bucket::INT AS idx, a::BIGINT AS positive, b::BIGINT AS negative, round(chi, 9) AS chi_square FROM s ORDER BY chi DESC, bucket LIMIT 1024""")
def _(spark, sf):
    titled = rich_pages(spark, sf).withColumn("title", page_title(F.col("html")))
    rows = titled.select(
        F.startswith("url", F.lit("http:")).cast("int").alias("label"),
        hashed_buckets(F.col("url"), F.col("title")).alias("buckets"),
    )
    return screen_columns(rows, TREE_HASH_DIM).withColumn("chi_square", F.round("chi_square", 9))


def _transform_sql(name: str, column: str) -> str:
    if name in COUNT_FEATURES:
        return f"ln(1 + greatest({column}, 0))"
    if name in RATIO_FEATURES:
        return f"least(greatest({column}, 0), 1)"
    return f"CASE WHEN {column} <> 0 THEN 1.0 ELSE 0.0 END"


@query("transform_numeric", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_transform_sql(COUNT_FEATURES[0], '(l_extendedprice - 20000)')}, 9) AS as_count,
  round({_transform_sql(RATIO_FEATURES[0], '(l_quantity / 40 - 0.1)')}, 9) AS as_ratio, {_transform_sql(BOOLEAN_FEATURES[0], 'l_discount')}::DOUBLE AS as_boolean,
  round({_transform_sql(COUNT_FEATURES[0], "coalesce(try_cast(CASE WHEN l_returnflag = 'R' THEN 'x' WHEN l_returnflag = 'A' THEN 'inf' ELSE l_linenumber::VARCHAR END AS INT), 0)")}, 9) AS as_text FROM lineitem""")
def _(spark, sf):
    raw = F.when(F.col("l_returnflag") == "R", "x").when(F.col("l_returnflag") == "A", "inf").otherwise(F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(transform_numeric(COUNT_FEATURES[0], F.col("l_extendedprice") - 20000), 9).alias("as_count"),
        F.round(transform_numeric(RATIO_FEATURES[0], F.col("l_quantity") / 40 - 0.1), 9).alias("as_ratio"),
        transform_numeric(BOOLEAN_FEATURES[0], F.col("l_discount")).alias("as_boolean"),
        F.round(transform_numeric(COUNT_FEATURES[0], raw), 9).alias("as_text"),
    )


_VALUES = ", ".join(f"struct_pack(idx := {HASH_DIM + i}, value := {_transform_sql(n, n)}::DOUBLE)" for i, n in enumerate(NUMERIC_FEATURES))
VECTOR_SQL = f"""{RICH_SQL}, {page_features_sql()}, {_BUCKETS.replace(TITLE_SQL + ', ', '')},
numeric AS (SELECT page_id, unnest([{_VALUES}]) AS e FROM pf),
vec AS (SELECT page_id, bucket AS idx, 1.0::DOUBLE AS value FROM buckets UNION ALL SELECT page_id, e.idx, e.value FROM numeric WHERE e.value <> 0)"""


def page_vectors(spark, sf, key="page_id"):
    return vectorize(all_features(rich_pages(spark, sf)), key)


@query("vectorize", f"WITH {VECTOR_SQL} SELECT page_id, idx::INT AS idx, round(value::FLOAT::DOUBLE, 5) AS value FROM vec")
def _(spark, sf):
    return page_vectors(spark, sf).select("page_id", "idx", F.round(F.col("value").cast("double"), 5).alias("value"))


_SCORE = f"""{VECTOR_SQL}, {WEIGHTS_SQL}, lg AS (SELECT page_id, sum(weight::DOUBLE * value::FLOAT::DOUBLE) - 0.25 AS logit FROM vec JOIN weights USING (idx) GROUP BY page_id)"""


@query("linear_score_join", f"WITH {_SCORE} SELECT page_id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS score FROM lg")
def _(spark, sf):
    scored = S.linear_score_join(page_vectors(spark, sf), formula_weights(spark), -0.25, "page_id")
    return scored.select("page_id", F.round("logit", 6).alias("logit"), F.round("score", 6).alias("score"))


@query("score_linear", f"""WITH {_SCORE} SELECT page_id, starts_with(url, 'http:')::INT AS label, round(1 / (1 + exp(-logit)), 6) AS score, 1 / (1 + exp(-logit)) >= 0.5 AS flagged
FROM lg JOIN pages USING (page_id)""")
def _(spark, sf):
    rows = all_features(rich_pages(spark, sf)).withColumn("label", F.startswith("url", F.lit("http:")).cast("int"))
    scored = S.score_pages(rows, formula_weights(spark), -0.25)
    return scored.select("page_id", "label", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("flagged"))


@query("sigmoid", f"WITH {LINE_SQL} SELECT sample_id, round(1 / (1 + exp(-(fine - 0.5) * 60)), 9) AS p FROM scored")
def _(spark, sf):
    return line_scores(spark, sf).select("sample_id", F.round(sigmoid((F.col("fine") - 0.5) * 60), 9).alias("p"))


# --- windows over long texts -------------------------------------------------------------

_TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
_WINDOWS = f"""tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
win AS (SELECT doc_id, start, t[start + 1:start + 128] AS w FROM (SELECT doc_id, t, unnest(range(0, len(t) - 127, 64)) AS start FROM tok WHERE len(t) >= 128))"""


def tokens():
    return F.filter(F.split("text", r"\s+"), lambda x: x != "")


def long_documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("sliding_windows", f"WITH {_WINDOWS} SELECT doc_id, start, md5(array_to_string(w, ' ')) AS digest FROM win")
def _(spark, sf):
    windows = S.sliding_windows(long_documents(spark, sf), "doc_id", tokens())
    return windows.select("doc_id", F.col("start").cast("long").alias("start"), F.md5(F.array_join("window", " ")).alias("digest"))


@query("window_count_stats", f"""WITH {_WINDOWS}, c AS (SELECT doc_id, count(start) AS windows FROM documents LEFT JOIN win USING (doc_id) GROUP BY doc_id)
SELECT quantile_cont(windows, 0.5)::DOUBLE AS median, round(avg(windows), 6) AS mean, round(quantile_cont(windows, 0.9), 6)::DOUBLE AS p90, max(windows) AS max, sum(windows)::BIGINT AS total FROM c""")
def _(spark, sf):
    counts = S.window_counts(long_documents(spark, sf), "doc_id", tokens())
    out = M.window_count_stats(counts)
    return out.withColumns({"mean": F.round("mean", 6), "p90": F.round("p90", 6)})


_PROB = "(length(array_to_string(w, ' ')) % 1000) / 1000.0"


@query("max_pool", f"""WITH {_WINDOWS}, p AS (SELECT doc_id, max(CAST({_PROB} AS DOUBLE)) AS score FROM win GROUP BY doc_id)
SELECT doc_id, round(coalesce(score, 0.0), 6)::DOUBLE AS score FROM documents LEFT JOIN p USING (doc_id)""")
def _(spark, sf):
    scorer = lambda text: (F.pmod(F.length(text), F.lit(1000)) / 1000.0).cast("double")
    out = S.score_windows(long_documents(spark, sf), "doc_id", tokens(), scorer)
    return out.withColumn("score", F.round("score", 6))

