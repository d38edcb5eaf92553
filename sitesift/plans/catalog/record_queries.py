"""Scan, validation, record and archive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import (
    CSV_DOM_COLUMNS, DOM_FEATURES, MAX_TITLE_CODE_POINTS, MAX_URL_CODE_POINTS, MISSING_FAMILY_IDS,
)
from sitesift.functions.html import add_page_features, html_status, page_title, parse_status
from sitesift.functions.urls import canonicalize_url
from sitesift.operators import archives as A
from sitesift.operators import records as R
from sitesift.operators import validate as V
from sitesift.operators.groups import dedupe_keep_first
from sitesift.plans.catalog.html_queries import CANONICAL_SQL, REJECT_SQL, TITLE_SQL
from sitesift.plans.catalog.inputs import (
    LINE_SQL, RAW_SQL, RICH_SQL, SHOP_SQL, canonical_sql, host_sql, line_scores, pages, quoted,
    raw_rows, rich_pages, shop_urls, table,
)
from sitesift.plans.catalog.registry import query
from sitesift.plans.catalog.url_queries import url_features_sql
from sitesift.plans.training import combined_training
from sitesift.session import shared_folder
from sitesift.sources import archives as Z
from sitesift.sources import files as Y
from sitesift.sources import tables as T


# --- scans -------------------------------------------------------------------------


@query("scan_projected", "SELECT epoch_us(ts) AS micros, event_type AS label FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_type").alias("label"))


@query("limit_scan", f"WITH {RAW_SQL}, l AS (SELECT * FROM raw ORDER BY page_id LIMIT 100) SELECT page_id, url FROM l WHERE {REJECT_SQL} IS NULL")
def _(spark, sf):
    # The cap counts every row read, so it comes before the rejects are dropped.
    return R.limit_scan(raw_rows(spark, sf), "page_id", 100).where(V.reject_reason().isNull()).select("page_id", "url")


@query("sort_timestamps", "SELECT epoch_us(ts) AS micros, event_id FROM events ORDER BY ts, event_id")
def _(spark, sf):
    return table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id").orderBy("micros", "event_id")


# --- labels, dates, rejects ----------------------------------------------------------


@query("normalize_label_inverted", "SELECT doc_id, 1 - toxic AS label FROM labels")
def _(spark, sf):
    raw = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("raw"))
    V.fail_on_values(raw, V.label_inverted(F.col("raw")).isNull(), F.col("raw"), "unknown labels")
    return raw.select("doc_id", V.label_inverted(F.col("raw")).alias("label"))


@query("normalize_label_text", """SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'error' THEN 1 END AS label,
  event_type = 'signup' AS is_blank FROM events""")
def _(spark, sf):
    kind = F.col("event_type")
    raw = F.when(kind == "view", "benign").when(kind == "click", " BENIGN ").when(kind == "error", "Phish").when(kind == "signup", "  ").otherwise("other")
    rows = table(spark, sf, "events").withColumn("raw", raw)
    return rows.select("event_id", V.label_from_text(F.col("raw")).alias("label"), V.blank(F.col("raw")).alias("is_blank"))


@query("normalize_label_dual", """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 1 WHEN quality = 0 AND toxic = 0 THEN 0
  WHEN quality = 0 AND toxic = 1 THEN 1 END AS label FROM labels""")
def _(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    label = F.when((q == 0) & (t == 1), "x").otherwise(q.cast("string"))
    kind = F.when(t == 1, " Phishing").otherwise("benign")
    return table(spark, sf, "labels").select("doc_id", V.label_dual(label, kind).alias("label"))


@query("reject_routing", f"WITH {RAW_SQL} SELECT page_id, {REJECT_SQL} AS reject_reason FROM raw")
def _(spark, sf):
    return raw_rows(spark, sf).select("page_id", V.reject_reason().alias("reject_reason"))


@query("parse_status", rf"""WITH {RICH_SQL}, {TITLE_SQL}, v AS (SELECT page_id, 'full' AS kind, html, title FROM rich JOIN titles USING (page_id)
  UNION ALL SELECT page_id, 'untitled', replace(replace(html, '<title>', '<h2>'), '</title>', '</h2>'), '' FROM rich UNION ALL SELECT page_id, 'blank', CASE WHEN starts_with(url, 'http:') THEN '  ' ELSE html END, CASE WHEN starts_with(url, 'http:') THEN '' ELSE title END FROM rich JOIN titles USING (page_id))
SELECT page_id, kind, CASE WHEN trim(html) = '' THEN 'empty_document' WHEN title = '' THEN 'empty_title' ELSE 'ok' END AS status FROM v""")
def _(spark, sf):
    html = F.col("html")
    untitled = F.replace(F.replace(html, F.lit("<title>"), F.lit("<h2>")), F.lit("</title>"), F.lit("</h2>"))
    variants = F.array(
        F.struct(F.lit("full").alias("kind"), html.alias("h")), F.struct(F.lit("untitled").alias("kind"), untitled.alias("h")),
        F.struct(F.lit("blank").alias("kind"), F.when(F.startswith("url", F.lit("http:")), "  ").otherwise(html).alias("h")),
    )
    rows = rich_pages(spark, sf).select("page_id", F.explode(variants).alias("v")).select("page_id", "v.*")
    staged = rows.withColumn("s", html_status(F.col("h"))).withColumn("t", page_title(F.col("h")))
    return staged.select("page_id", "kind", parse_status(F.col("s"), F.col("t")).alias("status"))


@query("accept_record", f"""WITH {RAW_SQL} SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'blocked' WHEN label IS NULL THEN 'missing_label' WHEN contains(url, '/de/') THEN 'missing_url' END AS drop_reason FROM raw""")
def _(spark, sf):
    rows = raw_rows(spark, sf).select(
        "page_id", F.when(F.contains("url", F.lit("/de/")), " ").otherwise(F.col("url")).alias("url"),
        F.when(F.contains("url", F.lit("/fr/")), " blocked ").alias("reject_reason"),
        V.label_from_text(F.col("label")).alias("label"),
    )
    return V.accept_record(rows).select("page_id", "drop_reason")


@query("temporal_filter", """WITH c AS (SELECT ts AS cutoff FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM events) WHERE r = ceil(0.90 * n))
SELECT 'before' AS keep, event_id FROM events, c WHERE ts < cutoff UNION ALL SELECT 'at_or_after', event_id FROM events, c WHERE ts >= cutoff""")
def _(spark, sf):
    from sitesift.operators.metrics import temporal_cutoff

    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("date"))
    cutoff = temporal_cutoff(events, "date").select("cutoff").scalar()
    sides = [V.temporal_filter(events, "date", cutoff, k).select(F.lit(k).alias("keep"), "event_id") for k in ("before", "at_or_after")]
    return sides[0].unionByName(sides[1])


@query("parse_utc", """SELECT event_id, epoch_us(date_trunc('second', ts)) - CASE WHEN event_type = 'error' THEN 7200000000 ELSE 0 END AS with_offset, epoch_us(date_trunc('day', ts)) AS from_day, NULL::BIGINT AS naive,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || 'Z' AS formatted FROM events""")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    shown = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    zoned = F.concat(shown, F.when(F.col("event_type") == "error", "+02:00").otherwise("Z"))
    return table(spark, sf, "events").select(
        "event_id", F.unix_micros(V.parse_utc(zoned)).alias("with_offset"),
        F.unix_micros(V.parse_utc(F.date_format(ts, "yyyy-MM-dd"))).alias("from_day"),
        F.unix_micros(V.parse_utc(shown)).alias("naive"), V.format_utc(ts).alias("formatted"),
    )


@query("family_sentinel", f"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN ' N/A ' WHEN o_orderstatus = 'P' THEN 'None' WHEN o_orderstatus = 'F' THEN '-1' ELSE ' kit-' || o_custkey || ' ' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN lower(trim(raw)) IN ({', '.join(quoted(m) for m in MISSING_FAMILY_IDS)}) THEN '' ELSE trim(raw) END AS family_id FROM f""")
def _(spark, sf):
    raw = (
        F.when(F.col("o_orderpriority") == "5-LOW", " N/A ").when(F.col("o_orderstatus") == "P", "None")
        .when(F.col("o_orderstatus") == "F", "-1").otherwise(F.concat(F.lit(" kit-"), "o_custkey", F.lit(" ")))
    )
    return table(spark, sf, "orders").select("o_orderkey", V.family_id(raw).alias("family_id"))


@query("prediction_row_checks", """WITH p AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'd0' ELSE 'd' || doc_id END AS sample_id, CASE WHEN lang = 'fr' THEN '2' ELSE '1' END AS label, CASE WHEN lang = 'de' THEN '' ELSE text END AS html FROM documents),
c AS (SELECT CASE WHEN label NOT IN ('0', '1') THEN 'malformed label' WHEN html = '' THEN 'malformed html' END AS problem FROM p)
SELECT problem, count(*) AS rows FROM c WHERE problem IS NOT NULL GROUP BY problem
UNION ALL SELECT 'duplicate sample_id', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM p GROUP BY sample_id HAVING count(*) > 1)""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.when(F.pmod("doc_id", F.lit(10)) == 0, "d0").otherwise(F.concat(F.lit("d"), "doc_id")).alias("sample_id"),
        F.when(F.col("lang") == "fr", "2").otherwise("1").alias("label"), F.when(F.col("lang") == "de", "").otherwise(F.col("text")).alias("html"),
    )
    return V.prediction_row_checks(rows)


@query("score_checks", f"WITH {LINE_SQL} SELECT count(*) AS rows, count_if(label NOT IN (0, 1))::BIGINT AS bad_labels, 0::BIGINT AS bad_scores, count_if(fine * 1.5 > 1 OR fine < 0)::BIGINT AS outside_unit FROM scored")
def _(spark, sf):
    scored = line_scores(spark, sf).select("label", (F.col("fine") * 1.5).alias("score"))
    return V.score_checks(scored, probability=True)


_ALLOWED = ", ".join(quoted(n) for n in DOM_FEATURES[:3])


@query("page_record_checks", f"""WITH {RICH_SQL}, {TITLE_SQL}, r AS (SELECT page_id, CASE WHEN contains(url, '/de/') THEN replace(url, 'http', 'ftp') ELSE url END AS url,
  CASE WHEN contains(url, '/es/') THEN repeat(title, 200) ELSE title END AS title, contains(url, 'ref=x') AS odd_key, ends_with(url, '.html') AS bad_value FROM rich JOIN titles USING (page_id))
SELECT page_id, CASE WHEN length(url) > {MAX_URL_CODE_POINTS} THEN 'url exceeds supported length' WHEN length(title) > {MAX_TITLE_CODE_POINTS} THEN 'title exceeds supported length'
  WHEN NOT regexp_matches(url, '^https?://[^\\s/?#]+') THEN 'url must use http or https' WHEN odd_key THEN 'dom feature is not allowed' WHEN bad_value THEN 'dom feature values must be finite' END AS problem FROM r""")
def _(spark, sf):
    rows = add_page_features(rich_pages(spark, sf)).select(
        "page_id", F.when(F.contains("url", F.lit("/de/")), F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url")).alias("url"),
        F.when(F.contains("url", F.lit("/es/")), F.repeat("title", F.lit(200))).otherwise(F.col("title")).alias("title"),
        F.create_map(
            F.when(F.contains("url", F.lit("ref=x")), "unknown").otherwise(DOM_FEATURES[0]),
            F.when(F.endswith("url", F.lit(".html")), float("inf")).otherwise(F.col(DOM_FEATURES[0])),
            F.lit(DOM_FEATURES[1]), F.col(DOM_FEATURES[1]),
        ).alias("dom"),
    )
    return rows.select("page_id", V.page_record_problem().alias("problem"))


# --- counters --------------------------------------------------------------------------


@query("class_counts", "SELECT count_if(toxic = 0)::BIGINT AS benign, count_if(toxic = 1)::BIGINT AS phishing FROM labels")
def _(spark, sf):
    return R.class_counts(table(spark, sf, "labels"), "toxic")


@query("raw_label_counts", f"WITH {RAW_SQL} SELECT coalesce(label, '<NA>') AS label, count(*) AS n FROM raw GROUP BY 1")
def _(spark, sf):
    return R.raw_label_counts(raw_rows(spark, sf))


_COUNTERS = f"""{CANONICAL_SQL}, counters AS (SELECT 'class' AS kind, label::VARCHAR AS reason, count(*) AS n FROM canonical WHERE reject_reason IS NULL GROUP BY label
  UNION ALL SELECT 'parse', parse_status, count(*) FROM canonical WHERE reject_reason IS NULL GROUP BY parse_status
  UNION ALL SELECT 'reject', reject_reason, count(*) FROM canonical WHERE reject_reason IS NOT NULL GROUP BY reject_reason)"""


@query("reason_counts", f"WITH {_COUNTERS} SELECT kind, reason, n FROM counters")
def _(spark, sf):
    return R.reason_counts(R.canonical_records(raw_rows(spark, sf)))


@query("checkpoint_consistency", f"""WITH {_COUNTERS} SELECT sum(n) FILTER (WHERE kind = 'class')::BIGINT AS accepted, sum(n) FILTER (WHERE kind = 'parse')::BIGINT AS parsed,
  sum(n) FILTER (WHERE kind = 'reject')::BIGINT AS rejected, sum(n) FILTER (WHERE kind <> 'parse') = (SELECT count(*) FROM pages) AS consistent FROM counters""")
def _(spark, sf):
    counts = R.reason_counts(R.canonical_records(raw_rows(spark, sf)))
    processed = table(spark, sf, "pages").agg(F.count(F.lit(1))).scalar()
    return R.counter_consistency(counts, processed)


@query("audit_report", f"""WITH marked AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, url || '#again' FROM pages UNION ALL
  SELECT page_id + 2000000000, ' ' FROM pages WHERE starts_with(url, 'http:')), {canonical_sql('marked', 'page_id')},
f AS (SELECT canonical, min_by(starts_with(url, 'http:')::INT, page_id) AS label FROM canon WHERE canonical IS NOT NULL GROUP BY canonical),
n AS (SELECT count(*) AS raw_rows, count(*) - count(canonical) AS invalid_urls, count(canonical) AS valid FROM canon),
s AS (SELECT any_value(raw_rows) AS raw_rows, any_value(invalid_urls) AS invalid_urls, count(*) AS canonical_rows,
  any_value(valid) - count(*) AS duplicate_rows, count_if(label = 0)::BIGINT AS benign, count_if(label = 1)::BIGINT AS phishing FROM f, n)
UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value""")
def _(spark, sf):
    url, number = F.col("url"), F.col("page_id")
    copies = F.array_compact(F.array(
        F.struct(number.alias("page_id"), url.alias("url")),
        F.struct((number + 1000000000).alias("page_id"), F.concat(url, F.lit("#again")).alias("url")),
        F.when(F.startswith(url, F.lit("http:")), F.struct((number + 2000000000).alias("page_id"), F.lit(" ").alias("url"))),
    ))
    marked = table(spark, sf, "pages").select(F.explode(copies).alias("c")).select(
        "c.*", F.startswith("c.url", F.lit("http:")).cast("int").alias("label")
    )
    return R.audit_report(marked, "page_id")


@query("slice_summary", "SELECT count(*) AS rows, count_if(toxic = 0)::BIGINT AS benign, count_if(toxic = 1)::BIGINT AS phish, round(avg(toxic), 6) AS phish_rate FROM labels")
def _(spark, sf):
    return R.slice_summary(table(spark, sf, "labels"), "toxic")


# --- archives ----------------------------------------------------------------------------

# Members made from pages: some sites repeat a page under a URL with another fragment, some lack a
# member, some metadata is broken.
MEMBER_SQL = f"""made AS (SELECT page_id, 's' || lpad(page_id::VARCHAR, 9, '0') AS site, url, html FROM pages
  UNION ALL SELECT page_id, 'z' || lpad(page_id::VARCHAR, 9, '0'), url || CASE WHEN contains(url, '#') THEN 'b' ELSE '#again' END, html FROM pages WHERE page_id % 5 = 0),
{canonical_sql('made', 'site', 'cs')},
sites AS (SELECT made.*, starts_with(url, 'http:')::INT AS label, canonical FROM made JOIN (SELECT site, canonical FROM cs) USING (site)),
meta AS (SELECT *, CASE WHEN label = 0 THEN CASE WHEN contains(url, '/es/') THEN '  ' ELSE url END WHEN contains(url, '/fr/') THEN '{{''url'': }}'
  ELSE '{{''url'': ''' || url || ''', ''family_id'': ' || CASE WHEN contains(url, '/de/') THEN 'None' ELSE length(url)::VARCHAR END || ', ''brand'': ''b'', ''isotime'': ''t''}}' END AS metadata FROM sites),
st0 AS (SELECT page_id, label, site, NOT ends_with(url, '#top') AS has_info, NOT contains(url, 'utm_source') AS has_html, metadata, html, CASE WHEN label = 1 AND contains(url, '/fr/') THEN 'invalid_metadata'
   WHEN label = 0 AND contains(url, '/es/') THEN 'invalid_url' END AS bad, url, canonical, CASE WHEN label = 1 AND NOT contains(url, '/de/') THEN length(url)::VARCHAR ELSE '' END AS family FROM meta),
st1 AS (SELECT *, CASE WHEN NOT (has_info AND has_html) THEN 'incomplete' ELSE bad END AS state FROM st0),
status AS (SELECT *, CASE WHEN state IS NOT NULL THEN state WHEN row_number() OVER (PARTITION BY label, state, canonical ORDER BY site) = 1 THEN 'accepted' ELSE 'duplicate_url' END AS status FROM st1)"""


def site_members(spark, sf):
    """(label, site, basename, content) from pages."""
    url = F.col("url")

    def site(letter):
        return F.concat(F.lit(letter), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("site")

    again = F.concat(url, F.when(F.contains(url, F.lit("#")), "b").otherwise("#again")).alias("url")
    sites = pages(spark, sf).select("html", F.explode(F.array_compact(F.array(
        F.struct(site("s"), url), F.when(F.pmod("page_id", F.lit(5)) == 0, F.struct(site("z"), again))
    ))).alias("s")).select("s.site", "s.url", "html")
    label = F.startswith(url, F.lit("http:")).cast("int")
    family = F.when(F.contains(url, F.lit("/de/")), "None").otherwise(F.length(url).cast("string"))
    literal = F.concat(F.lit("{'url': '"), url, F.lit("', 'family_id': "), family, F.lit(", 'brand': 'b', 'isotime': 't'}"))
    metadata = F.when(label == 0, F.when(F.contains(url, F.lit("/es/")), "  ").otherwise(url)).otherwise(
        F.when(F.contains(url, F.lit("/fr/")), "{'url': }").otherwise(literal)
    )

    def member(name, content):
        return F.struct(F.lit(name).alias("basename"), content.alias("content"))

    members = F.array_compact(F.array(
        F.when(~F.endswith(url, F.lit("#top")), member("info.txt", metadata)),
        F.when(~F.contains(url, F.lit("utm_source")), member("html.txt", F.col("html"))),
        member("shot.png", F.lit("")),
    ))
    return sites.select(label.alias("label"), "site", F.explode(members).alias("m")).select("label", "site", "m.*")


def member_rows(spark, sf):
    """(label, site, basename, length, metadata) from pages."""
    info = F.when(F.col("basename") == "info.txt", F.col("content"))
    return site_members(spark, sf).select("label", "site", "basename", F.length("content").alias("length"), info.alias("metadata"))


def written_archives(spark, sf):
    """The members of all pages, written as archives; returns the folders of both classes."""
    folder = shared_folder(spark, "archives")
    Z.write_site_archives(site_members(spark, sf), folder)
    return f"{folder}/1", f"{folder}/0"


@query("zip_members", f"WITH {MEMBER_SQL}, m AS (SELECT label, site, 'info.txt' AS basename, metadata AS content FROM status WHERE has_info UNION ALL SELECT label, site, 'html.txt', html FROM status WHERE has_html UNION ALL SELECT label, site, 'shot.png', '' FROM status) SELECT label, site, basename, strlen(content) AS length, sha256(content) AS digest FROM m")
def _(spark, sf):
    phishing, benign = written_archives(spark, sf)
    names = "info.txt,html.txt,shot.png"
    members = Z.read_members(spark, phishing, 1, names).unionByName(Z.read_members(spark, benign, 0, names))
    return members.select("label", "site", "basename", "length", F.sha2("content", 256).alias("digest"))


@query("scan_site_archives", f"""WITH RECURSIVE {MEMBER_SQL}, {TITLE_SQL.replace('FROM rich', 'FROM pages')}, ok AS (SELECT * FROM status WHERE status = 'accepted'), {host_sql('ok', 'site')},
g AS (SELECT ok.*, domain FROM ok JOIN (SELECT site, domain FROM hosts) USING (site)),
e AS (SELECT DISTINCT 'domain:' || domain AS d, CASE WHEN family = '' THEN 'domain:' || domain ELSE 'family:' || family END AS f FROM g),
dd AS (SELECT DISTINCT a.d AS x, b.d AS y FROM e a JOIN e b USING (f)),
reach(x, y) AS (SELECT x, y FROM dd UNION SELECT r.x, dd.y FROM reach r JOIN dd ON dd.x = r.y),
root AS (SELECT x, min(y) AS "group" FROM reach GROUP BY x)
SELECT site AS source_member, label, url, sha256(canonical) AS sample_id, title, domain AS registrable_domain, family AS source_family_id, "group", length(url)::DOUBLE AS dom_url_length
FROM g JOIN titles USING (page_id) JOIN root ON root.x = 'domain:' || domain""")
def _(spark, sf):
    records, _ = Z.load_site_archives(spark, *written_archives(spark, sf))
    return records.select(
        "source_member", "label", "url", "sample_id", "title", "registrable_domain", "source_family_id", "group", "dom_url_length"
    )


@query("pair_members", f"WITH {MEMBER_SQL} SELECT label, site, CASE WHEN has_info THEN length(metadata) END AS info_length, CASE WHEN has_html THEN length(html) END AS html_length FROM status")
def _(spark, sf):
    return A.pair_members(member_rows(spark, sf)).select("label", "site", *[F.col(c).cast("long").alias(c) for c in ("info_length", "html_length")])


@query("pair_turns", """SELECT conv_id, max(length(text)) FILTER (WHERE role = 'user') AS user_length, max(length(text)) FILTER (WHERE role = 'assistant') AS assistant_length FROM conversations GROUP BY conv_id
HAVING user_length IS NOT NULL AND assistant_length IS NOT NULL""")
def _(spark, sf):
    # The same pairing over conversations: the longest user and assistant text of each.
    role = F.col("role")
    sides = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max(F.when(role == "user", F.length("text"))).cast("long").alias("user_length"),
        F.max(F.when(role == "assistant", F.length("text"))).cast("long").alias("assistant_length"),
    )
    return sides.where(F.col("user_length").isNotNull() & F.col("assistant_length").isNotNull())


@query("metadata_parse", f"WITH {MEMBER_SQL} SELECT site, bad IS NULL OR bad <> 'invalid_metadata' AS ok, CASE WHEN bad IS NULL THEN url ELSE '' END AS url, CASE WHEN bad IS NULL THEN family ELSE '' END AS source_family_id FROM status WHERE has_info")
def _(spark, sf):
    info = member_rows(spark, sf).where(F.col("basename") == "info.txt")
    parsed = info.withColumn("m", A.metadata_parse(F.col("label"), F.col("metadata")))
    return parsed.select(
        "site", "m.ok", "m.url", F.when(F.col("m.ok"), V.family_id(F.col("m.family_id"))).otherwise("").alias("source_family_id")
    )


@query("site_status", f"WITH {MEMBER_SQL} SELECT label, site, status FROM status")
def _(spark, sf):
    return A.site_status(A.pair_members(member_rows(spark, sf))).select("label", "site", "status")


_AUDIT = """count_if(status = 'accepted')::BIGINT AS accepted, count_if(has_info AND has_html)::BIGINT AS candidate_pairs, count_if(status = 'duplicate_url')::BIGINT AS duplicate_url,
  count_if(status = 'invalid_metadata')::BIGINT AS invalid_metadata, count_if(status = 'invalid_url')::BIGINT AS invalid_url, count_if(NOT has_html)::BIGINT AS missing_html,
  count_if(NOT has_info)::BIGINT AS missing_info, count(*) AS scanned_directories"""


@query("archive_audit", f"WITH {MEMBER_SQL} SELECT label, {_AUDIT}, false AS scan_capped, count(*) AS sample_directories FROM status GROUP BY label")
def _(spark, sf):
    return A.archive_audit(A.site_status(A.pair_members(member_rows(spark, sf))))


@query("balanced_limit", f"""WITH {MEMBER_SQL}, acc AS (SELECT *, count_if(status = 'accepted') OVER (PARTITION BY label ORDER BY site) - (status = 'accepted')::INT AS before FROM status),
kept AS (SELECT * FROM acc WHERE before < 15), total AS (SELECT label, count(*) AS sample_directories, count_if(status = 'accepted') AS available FROM status GROUP BY label)
SELECT label, {_AUDIT}, available >= 15 AND count(*) < sample_directories AS scan_capped, sample_directories FROM kept JOIN total USING (label) GROUP BY label, sample_directories, available""")
def _(spark, sf):
    every = A.site_status(A.pair_members(member_rows(spark, sf)))
    return A.archive_audit(A.balanced_limit(every, 30), every)


@query("sorted_sites", f"WITH {MEMBER_SQL} SELECT label, site FROM status ORDER BY label DESC, site")
def _(spark, sf):
    return A.sorted_sites(A.pair_members(member_rows(spark, sf))).select("label", "site")


@query("union_archives", f"WITH {MEMBER_SQL} SELECT label, CASE label WHEN 1 THEN 'phishing' ELSE 'benign' END AS source_class, site FROM status WHERE status = 'accepted'")
def _(spark, sf):
    accepted = A.site_status(A.pair_members(member_rows(spark, sf))).where(F.col("status") == "accepted")
    sides = [accepted.where(F.col("label") == n).select("label", F.lit(c).alias("source_class"), "site") for n, c in ((1, "phishing"), (0, "benign"))]
    return sides[0].unionByName(sides[1])


@query("top_member_names", f"""WITH {MEMBER_SQL}, m AS (SELECT label, 'info.txt' AS basename FROM status WHERE has_info UNION ALL SELECT label, 'html.txt' FROM status WHERE has_html UNION ALL SELECT label, 'shot.png' FROM status
  UNION ALL SELECT label, regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '.txt' FROM status),
c AS (SELECT label, basename, count(*) AS files FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY files DESC, basename) AS rank FROM c)
SELECT label, basename, files, rank::INT AS rank FROM r WHERE rank <= 10""")
def _(spark, sf):
    # A fourth member is named after the page's host, so there are more names than the report shows.
    members = site_members(spark, sf).select("label", "site", "basename")
    twice = pages(spark, sf).select("url", F.explode(F.array_repeat(F.lit(1), F.when(F.pmod("page_id", F.lit(5)) == 0, 2).otherwise(1))))
    hosts = twice.select(
        F.startswith("url", F.lit("http:")).cast("int").alias("label"), F.lit("h").alias("site"),
        F.concat(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.lit(".txt")).alias("basename"),
    )
    return A.top_member_names(members.unionByName(hosts), 10)


# --- sinks read back ---------------------------------------------------------------------


@query("freeze_records", f"WITH {CANONICAL_SQL} SELECT sample_id, url, title, date_text AS date, label, parse_status, length(html) AS html_length FROM canonical JOIN (SELECT page_id, html FROM rich) USING (page_id) WHERE reject_reason IS NULL")
def _(spark, sf):
    path = shared_folder(spark, "frozen")
    T.freeze_records(raw_rows(spark, sf), path)
    return T.read_frozen(spark, path).select(
        "sample_id", "url", "title", "date", "label", "parse_status", F.length("html").cast("long").alias("html_length")
    )


@query("write_predictions", f"WITH {LINE_SQL} SELECT sample_id, label, round(fine, 9) AS score, 'm' AS model FROM scored")
def _(spark, sf):
    path = shared_folder(spark, "predictions")
    rows = line_scores(spark, sf).select("sample_id", "label", F.col("fine").alias("score"), F.lit("m").alias("model"), F.lit("c").alias("source_commit"))
    T.write_predictions(rows, path)
    return T.read_predictions(spark, path).select("sample_id", "label", F.round("score", 9).alias("score"), "model")


# Every customer's shop URL as a labelled CSV; the numeric columns come from the customer row.
_CSV_SQL = f"""{SHOP_SQL}, src AS (SELECT c_custkey, url, 'Shop, ' || c_name AS title, (c_acctbal > 0)::INT AS raw, c_nationkey FROM shop JOIN customer USING (c_custkey)),
  {url_features_sql('shop', 'c_custkey')}, {canonical_sql('shop', 'c_custkey')}, {host_sql('shop', 'c_custkey', 'sh')}"""


@query("scan_labelled_csv", f"""WITH {_CSV_SQL} SELECT s.url, s.title, 1 - s.raw AS label, sha256(canonical) AS sample_id, sh.domain AS "group",
  s.c_nationkey::DOUBLE AS dom_image_count, 0.0::DOUBLE AS dom_css_count, uf.url_length AS dom_url_length, round(uf.letter_ratio, 9) AS dom_letter_ratio
  FROM src s JOIN uf USING (c_custkey) JOIN canon USING (c_custkey) JOIN sh USING (c_custkey)""")
def _(spark, sf):
    path = shared_folder(spark, "labelled-csv")
    customers = table(spark, sf, "customer")
    numbers = [
        F.when(F.lit(n == "css_count"), "n/a").otherwise(F.col("c_nationkey").cast("string")).alias(c) for c, n in CSV_DOM_COLUMNS.items()
    ]
    rows = shop_urls(spark, sf).join(customers, "c_custkey").select(
        F.col("url").alias("URL"), F.concat(F.lit("Shop, "), "c_name").alias("Title"),
        (F.col("c_acctbal") > 0).cast("int").alias("label"), *numbers, F.lit("1").alias("URLSimilarityIndex"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    out = T.scan_labelled_csv(spark, path)
    return out.select(
        "url", "title", "label", "sample_id", "group", "dom_image_count", "dom_css_count", "dom_url_length",
        F.round("dom_letter_ratio", 9).alias("dom_letter_ratio"),
    )


@query("records_to_input", f"WITH {CANONICAL_SQL} SELECT sample_id, label::VARCHAR AS label, md5(html) AS digest FROM canonical JOIN (SELECT page_id, html FROM rich) USING (page_id) JOIN (SELECT min(page_id) AS page_id FROM rc GROUP BY canonical) USING (page_id) WHERE reject_reason IS NULL")
def _(spark, sf):
    frozen, path = shared_folder(spark, "frozen"), shared_folder(spark, "input")
    named = raw_rows(spark, sf).withColumn("cid", F.sha2(canonicalize_url(F.col("url")), 256))
    T.freeze_records(dedupe_keep_first(named, "cid", "page_id").drop("cid"), frozen)
    T.records_to_input(T.read_frozen(spark, frozen), path)
    return T.read_scorer_input(spark, path).select("sample_id", "label", F.md5("html").alias("digest"))


@query("write_report", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(spark, sf):
    path = shared_folder(spark, "report")
    summary = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    T.write_report(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query("combined_training", "SELECT doc_id, toxic AS label, 'first' AS source FROM labels UNION ALL SELECT doc_id, (lang = 'en')::INT, 'second' FROM documents")
def _(spark, sf):
    first = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    second = table(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").cast("int").alias("label"))
    return combined_training(first, second)


def html_files(spark, sf):
    """The HTML of all pages as files by class, but for those with a tracking parameter; the folder."""
    folder = shared_folder(spark, "html")
    named = pages(spark, sf).where(~F.contains("url", F.lit("utm_source"))).select(
        F.concat_ws("/", F.startswith("url", F.lit("http:")).cast("int").cast("string"), F.pmod("page_id", F.lit(16)).cast("string"),
                    F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("file"), F.col("html").alias("content"),
    )
    Y.write_files(named, folder)
    return folder


@query("file_manifest", """WITH f AS (SELECT page_id || '.html' AS file, html, hex(encode(html)) AS h, strlen(html) AS bytes FROM pages WHERE NOT contains(url, 'utm_source')),
l AS (SELECT file, any_value(bytes) AS bytes, count(*) AS ranges, list(sha256(unhex(substr(h, 8192 * k + 1, 8192))) ORDER BY k) AS leaves
  FROM (SELECT *, unnest(range(greatest(1, (bytes + 4095) // 4096))) AS k FROM f) GROUP BY file)
SELECT file, bytes, ranges, CASE WHEN ranges = 1 THEN leaves[1] ELSE sha256(array_to_string(leaves, '')) END AS sha256 FROM l""")
def _(spark, sf):
    # Ranges of 4 KB, so that most pages have several.
    return Y.file_manifest(spark, html_files(spark, sf), leaf_bytes=4096)


# Every seventh page stands twice, the second time under another fragment; one row in eleven has no URL.
_SPLIT_CSV = f"""r AS (SELECT 2 * page_id AS ord, page_id, url, html FROM pages UNION ALL SELECT 2 * page_id + 1, page_id, url || CASE WHEN contains(url, '#') THEN 'b' ELSE '#again' END, html FROM pages WHERE page_id % 7 = 0),
k AS (SELECT * FROM r WHERE ord % 11 <> 0 AND NOT contains(url, 'utm_source')), {canonical_sql('k', 'ord', 'kc')},
f AS (SELECT min(ord) AS ord FROM kc GROUP BY canonical), u AS (SELECT k.*, canonical FROM f JOIN k USING (ord) JOIN (SELECT ord, canonical FROM kc) USING (ord))"""


def split_csv(spark, sf):
    """(csv folder, html folder) of all pages, rows in page order."""
    again = F.concat("url", F.when(F.contains("url", F.lit("#")), "b").otherwise("#again")).alias("url")
    number = F.col("page_id")
    rows = pages(spark, sf).select(number, F.explode(F.array_compact(F.array(
        F.struct((number * 2).alias("ord"), F.col("url")),
        F.when(F.pmod(number, F.lit(7)) == 0, F.struct((number * 2 + 1).alias("ord"), again)),
    ))).alias("r")).select("page_id", "r.*")
    label = F.startswith("url", F.lit("http:")).cast("int")
    folder = shared_folder(spark, "split-csv")
    rows.orderBy("ord").select(
        F.concat_ws("/", F.pmod("page_id", F.lit(16)).cast("string"), F.concat(number.cast("string"), F.when(label == 1, ".html").otherwise(""))).alias("file_name"),
        F.when(F.pmod("ord", F.lit(11)) != 0, F.col("url")).otherwise(" ").alias("url"), label.alias("label"),
        F.when(label == 1, "phishing").alias("type"), F.when(F.pmod("page_id", F.lit(3)) == 0, "test").otherwise("train").alias("split"),
    ).write.option("header", True).csv(folder)
    return folder, html_files(spark, sf)


@query("scan_csv_with_html", f"""WITH {_SPLIT_CSV}, {TITLE_SQL.replace('FROM rich', 'FROM pages')}, {host_sql('u', 'ord')}
SELECT u.url, title, starts_with(u.url, 'http:')::INT AS label, sha256(canonical) AS sample_id, domain AS "group", length(u.url)::DOUBLE AS dom_url_length,
  CASE WHEN page_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM u JOIN titles USING (page_id) JOIN (SELECT ord, domain FROM hosts) USING (ord)""")
def _(spark, sf):
    csv, html = split_csv(spark, sf)
    return T.scan_csv_with_html(spark, csv, f"{html}/1", f"{html}/0").select(
        "url", "title", "label", "sample_id", "group", "dom_url_length", "split"
    )


@query("csv_to_html_join", f"""WITH {_SPLIT_CSV} SELECT count(*) AS matched, sum(strlen(html))::BIGINT AS bytes FROM k""")
def _(spark, sf):
    # Names first: what is read are the files of matched rows, byte for byte.
    csv, html = split_csv(spark, sf)
    rows = T.read_csv(spark, csv).where(F.trim("url") != "").select(
        F.concat_ws("/", "label", F.concat(F.regexp_replace("file_name", "[.]html$", ""), F.lit(".html"))).alias("file")
    )
    files = Y.list_files(spark, html).select(F.substr("path", F.lit(len(T.qualified(spark, html)) + 2)).alias("file"), "path", "length")
    read = Y.read_contents(rows.join(files, "file"))
    return read.agg(F.count(F.lit(1)).alias("matched"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))
