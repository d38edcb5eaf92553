"""Input tables and the tables the queries derive from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.constants import HASH_DIM, MULTI_SUFFIXES, NUMERIC_FEATURES, SINGLE_SUFFIXES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Use all cores on inputs with fewer files than cores; large inputs are left as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores, key) if len(frame.inputFiles()) < cores else frame


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


# --- pages with forms, metas and links, made from the page's own URL ---------------

HEAD_EXTRA = (
    '<meta name="Viewport" content="width=device-width"><link rel="Shortcut ICON" href="/i.png">'
    '<link rel=\'alternate stylesheet\' href=site.css><meta property="og:description" content=" x ">'
)
BODY_EXTRA = (
    '<FORM method=post action="https://collect.other.org/in"><input type=hidden name=t value="a>b">'
    '<input TYPE="password"><button>Pay</button></FORM><iframe src="//x.test/f"></iframe>'
    '<img src="/a.png" alt=""><a href="https://www.facebook.com/x">f</a><a href="#">e</a>'
    '<a href=" javascript:void(0)">j</a>\n<!-- <a href="/no">bank</a> -->bitcoin wallet\r\n'
)


def rich_html(frame: DataFrame) -> DataFrame:
    """Plain-http pages get a form, frame and links, 'www' ones head elements."""
    html = F.when(
        F.startswith("url", F.lit("http:")),
        F.replace(F.col("html"), F.lit("<footer>"), F.lit(BODY_EXTRA + "<footer>")),
    ).otherwise(F.col("html"))
    return frame.withColumn("html", html).withColumn(
        "html",
        F.when(
            F.contains("url", F.lit("://www.")),
            F.replace(F.col("html"), F.lit("</head>"), F.lit(HEAD_EXTRA + "</head>")),
        ).otherwise(F.col("html")),
    )


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich_html(pages(spark, sf_dir))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


RICH_SQL = f"""rich0 AS (
  SELECT page_id, url, CASE WHEN starts_with(url, 'http:')
    THEN replace(html, '<footer>', replace(replace({quoted(BODY_EXTRA.replace(chr(13), '~R~').replace(chr(10), '~N~') + '<footer>')}, '~R~', chr(13)), '~N~', chr(10)))
    ELSE html END AS html FROM pages),
rich AS (
  SELECT page_id, url, CASE WHEN contains(url, '://www.')
    THEN replace(html, '</head>', {quoted(HEAD_EXTRA + '</head>')}) ELSE html END AS html FROM rich0)"""


# --- raw stream rows ---------------------------------------------------------------


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, date, label): text labels and dates, some missing."""
    return raw_from(rich_pages(spark, sf_dir))


def raw_from(page_rows: DataFrame) -> DataFrame:
    return page_rows.select(
        "page_id", "url", "html",
        F.when(
            ~F.contains("url", F.lit("utm_source")),
            F.concat(F.lit("2024-01-"), F.lpad((F.pmod("page_id", F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("T06:30:00Z")),
        ).alias("date"),
        F.when(F.endswith("url", F.lit("#top")), F.lit(None).cast("string"))
        .when(F.startswith("url", F.lit("http:")), "phish").otherwise(" Benign ").alias("label"),
    )


RAW_SQL = RICH_SQL + """,
raw AS (
  SELECT page_id, url, html,
    CASE WHEN NOT contains(url, 'utm_source') THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || 'T06:30:00Z' END AS date,
    CASE WHEN ends_with(url, '#top') THEN NULL WHEN starts_with(url, 'http:') THEN 'phish' ELSE ' Benign ' END AS label
  FROM rich)"""


# --- URLs with many kinds of suffixes ------------------------------------------------


SEGMENT_SUFFIX = {
    "AUTOMOBILE": "co.uk", "BUILDING": "com", "FURNITURE": "com.au", "MACHINERY": "internal",
}


def shop_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One URL per customer: varied subdomains, suffixes, ports, userinfo and escapes."""
    suffix = F.lit("org")
    for segment, name in SEGMENT_SUFFIX.items():
        suffix = F.when(F.col("c_mktsegment") == segment, name).otherwise(suffix)
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        "c_custkey",
        F.concat(
            F.when(F.col("c_acctbal") < 0, "HTTP://me:pw@").otherwise("https://"),
            F.when(F.col("c_nationkey") < 8, "a.b.").when(F.col("c_nationkey") < 16, "").otherwise("Shop."),
            name, F.lit("."), suffix,
            F.when(F.col("c_acctbal") > 5000, ":0").when(F.col("c_acctbal") > 0, ":8080").otherwise(""),
            F.lit("/p//"), F.when(F.col("c_nationkey") < 12, "?q=%2Fa&b=1").otherwise("#frag"),
        ).alias("url"),
    )


SHOP_SQL = """shop AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'HTTP://me:pw@' ELSE 'https://' END
    || CASE WHEN c_nationkey < 8 THEN 'a.b.' WHEN c_nationkey < 16 THEN '' ELSE 'Shop.' END
    || lower(replace(c_name, '#', '-')) || '.'
    || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'co.uk' WHEN 'BUILDING' THEN 'com'
         WHEN 'FURNITURE' THEN 'com.au' WHEN 'MACHINERY' THEN 'internal' ELSE 'org' END
    || CASE WHEN c_acctbal > 5000 THEN ':0' WHEN c_acctbal > 0 THEN ':8080' ELSE '' END
    || '/p//' || CASE WHEN c_nationkey < 12 THEN '?q=%2Fa&b=1' ELSE '#frag' END AS url
  FROM customer)"""


# --- URL SQL fragments ---------------------------------------------------------------

_PARTS = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"


def canonical_sql(source: str, key: str, name: str = "canon") -> str:
    """CTEs giving (key, url, canonical) for sources without IPv6 hosts or invalid ports."""
    return rf"""{name}0 AS (SELECT {key}, url, CASE WHEN contains(trim(url), '://') THEN trim(url) ELSE '//' || trim(url) END AS f FROM {source}),
{name}1 AS (SELECT {key}, url, lower(regexp_extract(f, {_PARTS}, 1)) AS scheme,
    regexp_replace(regexp_extract(f, {_PARTS}, 2), '^.*@', '') AS hp,
    regexp_extract(f, {_PARTS}, 3) AS path, regexp_extract(f, {_PARTS}, 4) AS q FROM {name}0),
{name}2 AS (SELECT *, lower(regexp_extract(hp, '^[^:]*')) AS host, regexp_extract(hp, ':(.*)$', 1) AS port FROM {name}1),
{name} AS (SELECT {key}, url, host, CASE WHEN host <> '' THEN
    CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END || '//' || host
    || CASE WHEN port <> '' AND port::INT <> 0 THEN ':' || port::INT ELSE '' END
    || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM {name}2)"""


def _sql_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def host_sql(source: str, key: str, name: str = "hosts") -> str:
    """CTEs giving (key, url, scheme, host, labels, suffix, subs, domain), tolerant parser."""
    return rf"""{name}0 AS (SELECT {key}, url, CASE WHEN contains(url, '://') THEN lower(split_part(url, '://', 1)) ELSE '' END AS scheme,
    regexp_replace(regexp_extract(regexp_replace(url, '^(?:[^:]*://|//)', ''), '^[^/?#]*'), '^.*@', '') AS auth FROM {source}),
{name}1 AS (SELECT *, lower(CASE WHEN starts_with(auth, '[') THEN regexp_extract(auth, '^\[([^\]]*)', 1) ELSE regexp_replace(auth, ':[^:]*$', '') END) AS host FROM {name}0),
{name}2 AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels,
    regexp_matches(host, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){{4}}$') AND NOT ends_with(host, '.') AS v4 FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN len(labels) <= 1 OR v4 THEN ''
      WHEN len(labels) > 2 AND (labels[-2] || '.' || labels[-1]) IN {_sql_list(MULTI_SUFFIXES)} THEN labels[-2] || '.' || labels[-1]
      ELSE labels[-1] END AS suffix FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN suffix = '' THEN 0 WHEN contains(suffix, '.') THEN len(labels) - 3
      WHEN suffix IN {_sql_list(SINGLE_SUFFIXES)} THEN len(labels) - 2 ELSE len(labels) - 1 END AS subs FROM {name}3),
{name} AS (SELECT *, CASE WHEN suffix = '' OR subs >= len(labels) - 1 THEN host
      ELSE array_to_string(labels[greatest(1, len(labels) - len(string_split(suffix, '.'))):len(labels)], '.') END AS domain FROM {name}4)"""


# --- score tables --------------------------------------------------------------------


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, score, fine): few distinct scores, and nearly unique ones."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_extendedprice") / 105000).alias("fine"),
    )


LINE_SQL = """scored AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id,
    CAST(l_returnflag = 'R' AS INT) AS label, l_discount * 10 AS score, l_extendedprice / 105000 AS fine
  FROM lineitem)"""


def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, sample_id, label, score): the two score columns as long rows."""
    base = line_scores(spark, sf_dir)
    return base.select(
        "sample_id", "label",
        F.explode(
            F.array(
                F.struct(F.lit("tied").alias("variant"), F.col("score").alias("score")),
                F.struct(F.lit("fine").alias("variant"), F.col("fine").alias("score")),
            )
        ).alias("v"),
    ).select("v.variant", "sample_id", "label", "v.score")


VARIANT_SQL = LINE_SQL + """,
variants AS (SELECT 'tied' AS variant, sample_id, label, score FROM scored
  UNION ALL SELECT 'fine', sample_id, label, fine FROM scored)"""


def order_scores(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(sample_id, label, score, other) with unique ids, and more columns of the orders."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("sample_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") / 600000).alias("score"),
        (F.dayofmonth("o_orderdate") / 31.0).cast("double").alias("other"),
        *more,
    )


ORDER_SQL = """oscored AS (
  SELECT 'o' || o_orderkey AS sample_id, CAST(o_orderstatus = 'F' AS INT) AS label,
    o_totalprice / 600000 AS score, CAST(day(o_orderdate) AS DOUBLE) / 31.0 AS other FROM orders)"""


def ranking_sql(source: str, keys: str = "", score: str = "score") -> str:
    """CTE ``prefix``: running counts by descending score, per key."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""counts AS (SELECT {lead}{score} AS score, sum(label) AS tp, sum(1 - label) AS fp FROM {source} GROUP BY {lead}{score}),
prefix AS (SELECT {lead}score, tp, fp, sum(tp) OVER ({part}ORDER BY score DESC) AS tp_cum,
    sum(fp) OVER ({part}ORDER BY score DESC) AS fp_cum FROM counts)"""


AP_EXPR = "CASE WHEN sum(tp) = 0 THEN 0.0 WHEN sum(fp) = 0 THEN 1.0 ELSE sum(tp * (tp_cum / (tp_cum + fp_cum))) / sum(tp) END"
AUC_EXPR = "CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (tp_cum - tp / 2.0)) / (sum(tp)::DOUBLE * sum(fp)) END"


# --- weights ---------------------------------------------------------------------------


def formula_weights(spark: SparkSession) -> DataFrame:
    """A full-width weights table from a rule."""
    return spark.range(HASH_DIM + len(NUMERIC_FEATURES)).select(
        F.col("id").cast("int").alias("idx"),
        ((F.pmod(F.col("id") * 7919, F.lit(2003)) - 1001) / 10000.0).cast("float").alias("weight"),
    )


WEIGHTS_SQL = f"""weights AS (SELECT range AS idx, CAST(((range * 7919) % 2003 - 1001) / 10000.0 AS FLOAT) AS weight
  FROM range({HASH_DIM + len(NUMERIC_FEATURES)}))"""
