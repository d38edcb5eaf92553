"""URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import URL_FEATURES
from sitesift.functions.urls import (
    add_url_features, authority_host, canonicalize_url, is_ip_literal, registrable_domain,
    strict_host, suffix_info, url_scheme,
)
from sitesift.operators.groups import dedupe_keep_first
from sitesift.operators.suffixes import registrable_domain_psl, suffix_longest_match
from sitesift.plans.catalog.inputs import (
    SHOP_SQL, canonical_sql, host_sql, shop_urls, table,
)
from sitesift.plans.catalog.registry import query


@query("canonicalize_url", f"WITH {canonical_sql('pages', 'page_id')} SELECT page_id, canonical FROM canon")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", canonicalize_url(F.col("url")).alias("canonical"))


@query("canonicalize_shop_url", f"WITH {SHOP_SQL}, {canonical_sql('shop', 'c_custkey')} SELECT c_custkey, canonical FROM canon")
def _(spark, sf):
    return shop_urls(spark, sf).select("c_custkey", canonicalize_url(F.col("url")).alias("canonical"))


@query("sample_id", f"WITH {canonical_sql('pages', 'page_id')} SELECT page_id, sha256(canonical) AS sample_id FROM canon")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.sha2(canonicalize_url(F.col("url")), 256).alias("sample_id")
    )


@query("split_authority", f"WITH {SHOP_SQL}, {host_sql('shop', 'c_custkey')} SELECT c_custkey, scheme, host FROM hosts")
def _(spark, sf):
    return shop_urls(spark, sf).select(
        "c_custkey", url_scheme(F.col("url")).alias("scheme"), authority_host(F.col("url")).alias("host")
    )


@query("is_ip_literal", r"""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([
    concat_ws('.', l_quantity::INT * 6, l_linenumber, l_suppkey, l_partkey),
    concat_ws('.', CASE WHEN l_linenumber = 3 THEN '0' ELSE '' END || l_linenumber, l_linenumber, l_suppkey, l_quantity::INT),
    concat_ws(':', to_hex(l_orderkey), to_hex(l_partkey), '', to_hex(l_suppkey)),
    concat_ws(':', to_hex(l_orderkey), '', l_linenumber || '.' || l_suppkey || '.0.1'),
    concat_ws(':', '2001', to_hex(l_orderkey), to_hex(l_partkey), 'a', 'b', 'c', 'd', to_hex(l_suppkey))]) AS host FROM lineitem),
g AS (SELECT host, count(*) AS n FROM h GROUP BY host),
o AS (SELECT *, string_split(host, '.') AS q, string_split(host, ':') AS c FROM g)
SELECT host, n, CASE
    WHEN NOT contains(host, ':') THEN len(q) = 4 AND len(list_filter(q, lambda x: regexp_full_match(x, '0|[1-9][0-9]{0,2}') AND CAST(x AS BIGINT) <= 255)) = 4
    WHEN contains(host, '.') THEN len(c) = 3 AND regexp_full_match(c[1], '[0-9a-fA-F]{1,4}') AND
      len(list_filter(q, lambda x: regexp_full_match(regexp_replace(x, '^.*:', ''), '0|[1-9][0-9]{0,2}') AND CAST(regexp_replace(x, '^.*:', '') AS BIGINT) <= 255)) = 4
    WHEN contains(host, '::') THEN len(list_filter(c, lambda x: x = '' OR regexp_full_match(x, '[0-9a-fA-F]{1,4}'))) = 4
    ELSE len(list_filter(c, lambda x: regexp_full_match(x, '[0-9a-fA-F]{1,4}'))) = 8 END AS is_ip
FROM o""")
def _(spark, sf):
    line = table(spark, sf, "lineitem")
    qty = F.col("l_quantity").cast("int")
    hexed = lambda c: F.hex(F.col(c))
    hosts = F.array(
        F.concat_ws(".", qty * 6, "l_linenumber", "l_suppkey", "l_partkey"),
        F.concat_ws(
            ".", F.concat(F.when(F.col("l_linenumber") == 3, "0").otherwise(""), F.col("l_linenumber")),
            "l_linenumber", "l_suppkey", qty,
        ),
        F.concat_ws(":", hexed("l_orderkey"), hexed("l_partkey"), F.lit(""), hexed("l_suppkey")),
        F.concat_ws(
            ":", hexed("l_orderkey"), F.lit(""), F.concat_ws(".", "l_linenumber", "l_suppkey", F.lit("0.1"))
        ),
        F.concat_ws(
            ":", F.lit("2001"), hexed("l_orderkey"), hexed("l_partkey"),
            *[F.lit(x) for x in "abcd"], hexed("l_suppkey"),
        ),
    )
    distinct = line.select(F.explode(hosts).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return distinct.withColumn("is_ip", is_ip_literal(F.col("host")))


@query("suffix_subdomains", f"WITH {SHOP_SQL}, {host_sql('shop', 'c_custkey')} SELECT c_custkey, suffix, subs AS subdomains FROM hosts")
def _(spark, sf):
    info = suffix_info(authority_host(F.col("url")))
    return shop_urls(spark, sf).withColumn("i", info).select("c_custkey", "i.suffix", "i.subdomains")


@query("registrable_domain", f"""
WITH {SHOP_SQL}, {host_sql('shop', 'c_custkey')}, {host_sql('pages', 'page_id', 'ph')}
SELECT 'shop' AS source, c_custkey AS id, domain FROM hosts UNION ALL SELECT 'page', page_id, domain FROM ph""")
def _(spark, sf):
    urls = shop_urls(spark, sf).select(F.lit("shop").alias("source"), F.col("c_custkey").alias("id"), "url").unionByName(
        table(spark, sf, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), "url")
    )
    return urls.withColumn("host", authority_host(F.col("url"))).select(
        "source", "id", registrable_domain(F.col("host")).alias("domain")
    )


# A suffix table taken from the data: every label pair or single label that ends a shop host.
SUFFIX_TABLE_SQL = """suffixes AS (
  SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'co.uk' WHEN 'BUILDING' THEN 'com'
    WHEN 'FURNITURE' THEN 'com.au' WHEN 'MACHINERY' THEN 'internal' ELSE 'org' END AS suffix FROM customer
  UNION SELECT DISTINCT 'example.' || t FROM (SELECT unnest(['com', 'net']) AS t FROM nation))"""


def _suffix_table(spark, sf):
    shops = shop_urls(spark, sf).select(
        F.regexp_extract("url", r"\.(co\.uk|com\.au|com|internal|org)(?::|/)", 1).alias("suffix")
    )
    extra = table(spark, sf, "nation").select(
        F.explode(F.array(F.lit("example.com"), F.lit("example.net"))).alias("suffix")
    )
    return shops.union(extra).distinct()


@query("suffix_longest_match", f"""
WITH {SHOP_SQL}, {SUFFIX_TABLE_SQL}, {host_sql('pages', 'page_id', 'ph')}, {host_sql('shop', 'c_custkey')},
allh AS (SELECT 'page' AS source, page_id AS id, host FROM ph UNION ALL SELECT 'shop', c_custkey, host FROM hosts),
m AS (SELECT source, id, max_by(suffix, length(suffix)) AS suffix FROM allh JOIN suffixes ON ends_with(host, '.' || suffix) GROUP BY source, id)
SELECT a.source, a.id, coalesce(m.suffix, '') AS suffix FROM allh a LEFT JOIN m USING (source, id)""")
def _(spark, sf):
    urls = _all_urls(spark, sf).withColumn("host", authority_host(F.col("url")))
    return suffix_longest_match(urls, _suffix_table(spark, sf)).select("source", "id", F.coalesce("suffix", F.lit("")).alias("suffix"))


# The same table with rules that cross: every name below a top-level suffix is one, example.com is not,
# and neither is the first customer's name.
RULE_TABLE_SQL = f"""{SUFFIX_TABLE_SQL}, rules AS (SELECT suffix AS rule FROM suffixes
  UNION SELECT '*.' || suffix FROM suffixes WHERE NOT contains(suffix, '.') UNION SELECT '!example.com' FROM nation
  UNION SELECT '!' || lower(replace(min(c_name), '#', '-')) || '.com' FROM customer WHERE c_mktsegment = 'BUILDING')"""


def _rule_table(spark, sf):
    plain = _suffix_table(spark, sf)
    below = plain.where(~F.contains("suffix", F.lit("."))).select(F.concat(F.lit("*."), "suffix"))
    first = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("!"), F.lower(F.replace(F.min("c_name"), F.lit("#"), F.lit("-"))), F.lit(".com"))
    )
    fixed = table(spark, sf, "nation").select(F.lit("!example.com"))
    return plain.union(below).union(fixed).union(first).distinct()


@query("registrable_domain_rules", f"""
WITH {SHOP_SQL}, {RULE_TABLE_SQL}, {host_sql('pages', 'page_id', 'ph')}, {host_sql('shop', 'c_custkey')},
allh AS (SELECT 'page' AS source, page_id AS id, host FROM ph UNION ALL SELECT 'shop', c_custkey, host FROM hosts),
hit AS (
  SELECT source, id, host, rule AS suffix, 0 AS exception FROM allh JOIN rules ON ends_with(host, '.' || rule)
  UNION ALL SELECT source, id, host, regexp_extract(left(host, length(host) - length(rule) + 1), '[^.]+$') || substr(rule, 2), 0
    FROM allh JOIN rules ON starts_with(rule, '*.') AND regexp_matches(left(host, length(host) - length(rule) + 1), '^.+[.][^.]+$') AND ends_with(host, substr(rule, 2))
  UNION ALL SELECT source, id, host, regexp_replace(rule, '^![^.]+[.]', ''), 1
    FROM allh JOIN rules ON starts_with(rule, '!') AND (host = substr(rule, 2) OR ends_with(host, '.' || substr(rule, 2)))),
m AS (SELECT source, id, any_value(host) AS host, max_by(suffix, exception * 1000 + length(suffix)) AS suffix FROM hit GROUP BY source, id)
SELECT a.source, a.id, CASE WHEN m.suffix IS NULL THEN a.host
  ELSE regexp_extract(left(m.host, length(m.host) - length(m.suffix) - 1), '[^.]*$') || '.' || m.suffix END AS domain
FROM allh a LEFT JOIN m USING (source, id)""")
def _(spark, sf):
    urls = _all_urls(spark, sf).withColumn("host", strict_host(F.col("url")))
    return registrable_domain_psl(urls, _rule_table(spark, sf)).select("source", "id", "domain")


def _all_urls(spark, sf):
    return shop_urls(spark, sf).select(F.lit("shop").alias("source"), F.col("c_custkey").alias("id"), "url").unionByName(
        table(spark, sf, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), "url")
    )


@query("registrable_domain_psl", f"""
WITH {SHOP_SQL}, {SUFFIX_TABLE_SQL}, {host_sql('pages', 'page_id', 'ph')}, {host_sql('shop', 'c_custkey')},
allh AS (SELECT 'page' AS source, page_id AS id, host FROM ph UNION ALL SELECT 'shop', c_custkey, host FROM hosts),
m AS (SELECT source, id, any_value(host) AS host, max_by(suffix, length(suffix)) AS suffix FROM allh JOIN suffixes ON ends_with(host, '.' || suffix) GROUP BY source, id)
SELECT a.source, a.id, CASE WHEN m.suffix IS NULL THEN a.host
  ELSE regexp_extract(left(m.host, length(m.host) - length(m.suffix) - 1), '[^.]*$') || '.' || m.suffix END AS domain
FROM allh a LEFT JOIN m USING (source, id)""")
def _(spark, sf):
    urls = _all_urls(spark, sf).withColumn("host", strict_host(F.col("url")))
    return registrable_domain_psl(urls, _suffix_table(spark, sf)).select("source", "id", "domain")


_COUNT_SQL = r"""length(url) AS url_length, len(regexp_extract_all(url, '\p{L}')) AS letter_count,
    len(regexp_extract_all(url, '\p{N}')) AS digit_count"""


@query("url_char_counts", rf"""
SELECT page_id, {_COUNT_SQL}, length(url) - len(regexp_extract_all(url, '[\p{{L}}\p{{N}}]')) AS special_count FROM pages""")
def _(spark, sf):
    out = add_url_features(table(spark, sf, "pages"))
    return out.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("url_length", "letter_count", "digit_count", "special_count")])


@query("url_marker_counts", rf"""
WITH {SHOP_SQL} SELECT c_custkey, len(regexp_extract_all(url, '%[0-9A-Fa-f]{{2}}')) AS obfuscated_count,
  len(regexp_extract_all(url, '\?')) AS query_count, len(regexp_extract_all(url, '=')) AS equals_count,
  len(regexp_extract_all(url, '&')) AS ampersand_count FROM shop""")
def _(spark, sf):
    out = add_url_features(shop_urls(spark, sf))
    return out.select("c_custkey", *[F.col(c).cast("long").alias(c) for c in ("obfuscated_count", "query_count", "equals_count", "ampersand_count")])


@query("url_ratios", rf"""
WITH {SHOP_SQL}, c AS (SELECT c_custkey, {_COUNT_SQL}, len(regexp_extract_all(url, '%[0-9A-Fa-f]{{2}}')) AS esc FROM shop)
SELECT c_custkey, round(letter_count / url_length, 9) AS letter_ratio, round(digit_count / url_length, 9) AS digit_ratio,
  round(esc / url_length, 9) AS obfuscated_ratio, round((url_length - letter_count - digit_count) / url_length, 9) AS special_ratio FROM c""")
def _(spark, sf):
    out = add_url_features(shop_urls(spark, sf))
    return out.select("c_custkey", *[F.round(c, 9).alias(c) for c in URL_FEATURES if c.endswith("ratio")])


def url_features_sql(source: str, key: str) -> str:
    """CTEs ending in ``uf`` with the 17 features as doubles."""
    return rf"""{host_sql(source, key, 'uh')},
uc AS (SELECT *, length(url) AS n, len(regexp_extract_all(url, '\p{{L}}')) AS le, len(regexp_extract_all(url, '\p{{N}}')) AS di,
  len(regexp_extract_all(url, '%[0-9A-Fa-f]{{2}}')) AS ob FROM uh),
uf AS (SELECT {key}, n::DOUBLE AS url_length, length(host)::DOUBLE AS domain_length, length(suffix)::DOUBLE AS tld_length,
  subs::DOUBLE AS subdomain_count, le::DOUBLE AS letter_count, di::DOUBLE AS digit_count, ob::DOUBLE AS obfuscated_count,
  (n - length(replace(url, '?', '')))::DOUBLE AS query_count, (n - length(replace(url, '=', '')))::DOUBLE AS equals_count,
  (n - length(replace(url, '&', '')))::DOUBLE AS ampersand_count, (n - le - di)::DOUBLE AS special_count,
  le / n AS letter_ratio, di / n AS digit_ratio, ob / n AS obfuscated_ratio, (n - le - di) / n AS special_ratio,
  v4::INT::DOUBLE AS is_domain_ip, (scheme = 'https')::INT::DOUBLE AS is_https FROM uc)"""


def rounded_sql(names, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, 9) AS {n}" for n in names)


@query("url_features", f"WITH {SHOP_SQL}, {url_features_sql('shop', 'c_custkey')} SELECT c_custkey, {rounded_sql(URL_FEATURES)} FROM uf")
def _(spark, sf):
    return add_url_features(shop_urls(spark, sf)).select("c_custkey", *[F.round(c, 9).alias(c) for c in URL_FEATURES])


@query("unique_url_features", f"""
WITH {canonical_sql('pages', 'page_id')}, firsts AS (SELECT min(page_id) AS page_id, sha256(canonical) AS sample_id FROM canon GROUP BY canonical),
{url_features_sql('pages', 'page_id')}
SELECT page_id, sample_id, {rounded_sql(URL_FEATURES)} FROM firsts JOIN uf USING (page_id)""")
def unique_url_features(spark, sf):
    """Canonical, first-seen pages with their URL features."""
    ids = table(spark, sf, "pages").select(
        "page_id", "url", F.sha2(canonicalize_url(F.col("url")), 256).alias("sample_id")
    )
    unique = dedupe_keep_first(ids, "sample_id", "page_id")
    return add_url_features(unique).select("page_id", "sample_id", *[F.round(c, 9).alias(c) for c in URL_FEATURES])

