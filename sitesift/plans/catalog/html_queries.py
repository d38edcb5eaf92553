"""Page-structure queries over the tag table and page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import (
    BANK_TERMS, COPYRIGHT_TERMS, CRYPTO_TERMS, DOM_FEATURES, EMPTY_REF_SCHEMES, NUMERIC_FEATURES,
    PAY_TERMS, SOCIAL_DOMAINS,
)
from sitesift.functions import html as H
from sitesift.functions.normalize import fold_text
from sitesift.operators.records import all_features, canonical_records
from sitesift.plans.catalog.inputs import (
    RAW_SQL, RICH_SQL, canonical_sql, host_sql, quoted, raw_rows, rich_pages, table,
)
from sitesift.plans.catalog.registry import query
from sitesift.plans.catalog.url_queries import rounded_sql, url_features_sql

# The same scan written for an engine without possessive quantifiers.
_ATTRS = r"""(?:[^>=]+|=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)?)*"""
_RAW = "|".join(
    rf"<{n}(?:[\s/]{_ATTRS})?>.*?(?:</{n}[^>]*>|\z)" for n in ("script", "style", "textarea", "title")
)
_MARKUP = rf"(?is)<!--.*?(?:-->|\z)|{_RAW}|<[a-z]{_ATTRS}>"
_TEXT_RAW = "|".join(
    rf"<{n}(?:[\s/]{_ATTRS})?>(.*?)(?:</{n}[^>]*>|\z)" for n in ("script", "style", "textarea", "title")
)
_TEXT_MARKUP = rf"(?is)<!--.*?(?:-->|\z)|{_TEXT_RAW}|</?[a-z]{_ATTRS}>|<[!?][^>]*>"


def _attr(name: str) -> str:
    """First attribute of that name; NULL when the tag has none."""
    pattern = rf"""(?is)[\s"'']{name}(?:\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+)))?[\s/>"'']"""
    value = " || ".join(f"regexp_extract(st, '{pattern}', {k})" for k in (1, 2, 3))
    return f"CASE WHEN regexp_matches(st, '{pattern}') THEN {value} END AS {name.replace('-', '_')}"


def _unescaped(expression: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        expression = f"replace({expression}, '&{name};', '{char}')"
    return expression


TAGS_SQL = rf"""tok0 AS (SELECT page_id, url, list_filter(regexp_extract_all(html, '{_MARKUP}'), lambda x: NOT starts_with(x, '<!--')) AS toks FROM rich),
tok AS (SELECT page_id, url, unnest(toks) AS t, generate_subscripts(toks, 1) - 1 AS pos FROM tok0),
st AS (SELECT page_id, url, pos, regexp_extract(t, '(?is)^<[a-z]{_ATTRS}>') AS st FROM tok),
tags AS (SELECT page_id, url, pos, lower(regexp_extract(st, '^<([^\s/>]+)', 1)) AS tag,
  {', '.join(_attr(a) for a in ('href', 'src', 'action', 'rel', 'name', 'property', 'content', 'type'))} FROM st)"""

_REF = """CASE WHEN tag IN ('a', 'link') THEN href WHEN tag IN ('script', 'img', 'iframe') THEN src WHEN tag = 'form' THEN action END"""
_EMPTY = " OR ".join(
    ["v = ''", "starts_with(v, '#')"] + [f"starts_with(lower(v), {quoted(s)})" for s in EMPTY_REF_SCHEMES]
)
REFS_SQL = f"""refs0 AS (SELECT page_id, pos, tag, {_REF} AS reference FROM tags WHERE {_REF} IS NOT NULL),
refs1 AS (SELECT *, trim(reference) AS v FROM refs0),
target AS (SELECT DISTINCT v AS url, 0 AS tid FROM refs1 WHERE contains(v, '://') OR starts_with(v, '//')),
{host_sql('target', 'tid', 'th')}, {host_sql('pages', 'page_id', 'bh')},
refs AS (SELECT r.page_id, pos, tag, reference, CASE WHEN {_EMPTY} THEN 'empty'
    WHEN bh.domain <> '' AND (th.url IS NULL OR th.domain = bh.domain) THEN 'self' ELSE 'external' END AS class
  FROM refs1 r JOIN bh ON bh.page_id = r.page_id LEFT JOIN th ON th.url = r.v)"""

_SPACES = r"[\s\x{A0}]"
TEXT_SQL = rf"""vis0 AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)^.*?<body(?:[\s/][^>]*)?>', ''), '{_TEXT_MARKUP}', chr(1) || '\1\2\3\4' || chr(1), 'g') AS cut FROM rich),
vis AS (SELECT page_id, trim(regexp_replace({_unescaped('cut')}, '{_SPACES}*\x01[\s\x{{A0}}\x01]*', ' ', 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS visible FROM vis0)"""
TITLE_SQL = rf"""titles AS (SELECT page_id, trim(regexp_replace({_unescaped(r"regexp_extract(html, '(?is)<title(?:[\s/][^>]*)?>(.*?)</title', 1)")}, '[\s]+', ' ', 'g')) AS title FROM rich)"""


@query("page_tags", f"WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, pos, tag, href, rel, type FROM tags")
def _(spark, sf):
    tags = H.tag_table(rich_pages(spark, sf))
    return tags.select("page_id", "pos", "tag", *[F.try_element_at("attrs", F.lit(a)).alias(a) for a in ("href", "rel", "type")])


@query("html_status", r"""
SELECT page_id, part, CASE WHEN regexp_full_match(h, '\s*') THEN 'empty' WHEN contains(h, chr(0)) THEN 'parse_error' ELSE 'ok' END AS status
FROM (SELECT page_id, 'whole' AS part, html AS h FROM pages UNION ALL
  SELECT page_id, 'query', regexp_extract(url, '\?(.*)$', 1) FROM pages UNION ALL
  SELECT page_id, 'nul', CASE WHEN starts_with(url, 'http:') THEN html || chr(0) ELSE html END FROM pages)""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    html = F.col("html")
    parts = F.array(
        F.struct(F.lit("whole").alias("part"), html.alias("h")),
        F.struct(F.lit("query").alias("part"), F.regexp_extract("url", r"\?(.*)$", 1).alias("h")),
        F.struct(F.lit("nul").alias("part"), F.when(F.startswith("url", F.lit("http:")), F.concat(html, F.lit("\x00"))).otherwise(html).alias("h")),
    )
    return p.select("page_id", F.explode(parts).alias("p")).select("page_id", "p.part", H.html_status(F.col("p.h")).alias("status"))


@query("page_title", f"WITH {RICH_SQL}, {TITLE_SQL} SELECT page_id, title FROM titles")
def _(spark, sf):
    return rich_pages(spark, sf).select("page_id", H.page_title(F.col("html")).alias("title"))


@query("visible_text", f"WITH {RICH_SQL}, {TEXT_SQL} SELECT page_id, visible FROM vis")
def _(spark, sf):
    return rich_pages(spark, sf).select("page_id", H.visible_text(F.col("html")).alias("visible"))


_LINES = r"string_split_regex(replace(h, chr(13) || chr(10), chr(10)), '[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]')"
LINES_SQL = f"""ln0 AS (SELECT id, {_LINES} AS parts FROM linesrc),
ln1 AS (SELECT id, CASE WHEN parts[-1] = '' THEN parts[:len(parts) - 1] ELSE parts END AS parts FROM ln0),
ln AS (SELECT id, len(parts) AS html_line_count, coalesce(list_max(list_transform(parts, lambda x: length(x))), 0) AS largest_line_length FROM ln1)"""


@query("line_stats", f"""WITH {RICH_SQL}, linesrc AS (SELECT 'p' || page_id AS id, html AS h FROM rich UNION ALL SELECT 'd' || doc_id, text FROM documents),
{LINES_SQL} SELECT id, html_line_count, largest_line_length FROM ln""")
def _(spark, sf):
    rows = rich_pages(spark, sf).select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("h")).unionByName(
        table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("h"))
    )
    lines = H.line_lengths(F.col("h"))
    return rows.select("id", lines.alias("l")).select(
        "id", F.size("l").alias("html_line_count"), F.coalesce(F.array_max("l"), F.lit(0)).alias("largest_line_length")
    )


#: Every page with its tags; one row of nulls for a page without any.
PAGE_TAGS = "(SELECT page_id FROM rich) LEFT JOIN tags USING (page_id) GROUP BY page_id"
PAGE_REFS = "(SELECT page_id FROM rich) LEFT JOIN refs USING (page_id) GROUP BY page_id"


def _tag_flags(spark, sf, **tests):
    """One row per page: counts of tag tests, within the row."""
    return H.with_tags(rich_pages(spark, sf)).select(
        "page_id", *[F.size(F.filter("tags", test)).cast("long").alias(name) for name, test in tests.items()]
    )


def _references(spark, sf):
    return H.with_references(rich_pages(spark, sf)).select("page_id", "refs")


@query("element_counts", f"""WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, count_if(tag = 'iframe') AS iframes, count_if(tag = 'img') AS images,
  count_if(tag = 'script') AS scripts FROM {PAGE_TAGS}""")
def _(spark, sf):
    return _tag_flags(
        spark, sf, iframes=lambda t: t["tag"] == "iframe", images=lambda t: t["tag"] == "img",
        scripts=lambda t: t["tag"] == "script",
    )


_STYLE = "tag = 'style' OR (tag = 'link' AND list_contains(string_split_regex(lower(coalesce(rel, '')), '\\s+'), 'stylesheet'))"
_ICON = """tag = 'link' AND (list_contains(string_split_regex(lower(coalesce(rel, '')), '\\s+'), 'icon') OR contains(lower(coalesce(rel, '')), 'shortcut icon')
  OR ends_with(lower(coalesce(href, '')), 'favicon.ico'))"""
_VIEW = "tag = 'meta' AND lower(coalesce(name, '')) = 'viewport'"
_DESC = """tag = 'meta' AND trim(coalesce(content, '')) <> '' AND (lower(coalesce(name, '')) = 'description' OR lower(coalesce(property, '')) IN ('description', 'og:description'))"""
_SOCIAL = "(" + " OR ".join(f"contains(lower(coalesce(href, '')), {quoted(d)})" for d in SOCIAL_DOMAINS) + ")"
_SUBMIT = "(tag = 'input' AND lower(coalesce(type, '')) = 'submit') OR (tag = 'button' AND (type IS NULL OR lower(type) = 'submit'))"


@query("css_count", f"WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, count_if({_STYLE}) AS css_count FROM {PAGE_TAGS}")
def _(spark, sf):
    return _tag_flags(spark, sf, css_count=H.is_stylesheet)


@query("has_favicon", f"WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, count_if({_ICON}) > 0 AS has_favicon FROM {PAGE_TAGS}")
def _(spark, sf):
    return _tag_flags(spark, sf, n=H.is_favicon).select("page_id", (F.col("n") > 0).alias("has_favicon"))


@query("is_responsive", f"WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, count_if({_VIEW}) > 0 AS is_responsive FROM {PAGE_TAGS}")
def _(spark, sf):
    return _tag_flags(spark, sf, n=H.is_viewport).select("page_id", (F.col("n") > 0).alias("is_responsive"))


@query("has_description", f"WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, count_if({_DESC}) > 0 AS has_description FROM {PAGE_TAGS}")
def _(spark, sf):
    return _tag_flags(spark, sf, n=H.is_description).select("page_id", (F.col("n") > 0).alias("has_description"))


@query("has_social", f"WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, count_if({_SOCIAL}) > 0 AS has_social FROM {PAGE_TAGS}")
def _(spark, sf):
    return _tag_flags(spark, sf, n=H.is_social_link).select("page_id", (F.col("n") > 0).alias("has_social"))


@query("form_controls", f"""WITH {RICH_SQL}, {TAGS_SQL} SELECT page_id, count_if({_SUBMIT}) > 0 AS submit,
  count_if(tag = 'input' AND lower(coalesce(type, '')) = 'hidden') > 0 AS hidden,
  count_if(tag = 'input' AND lower(coalesce(type, '')) = 'password') > 0 AS password FROM {PAGE_TAGS}""")
def _(spark, sf):
    flags = _tag_flags(
        spark, sf, submit=H.is_submit, hidden=lambda t: H.is_input(t, "hidden"), password=lambda t: H.is_input(t, "password")
    )
    return flags.select("page_id", *[(F.col(c) > 0).alias(c) for c in ("submit", "hidden", "password")])


@query("page_refs", f"WITH {RICH_SQL}, {TAGS_SQL}, {REFS_SQL} SELECT page_id, pos, tag, reference FROM refs")
def _(spark, sf):
    return H.reference_table(rich_pages(spark, sf)).select("page_id", "pos", "tag", "reference")


@query("classify_refs", f"WITH {RICH_SQL}, {TAGS_SQL}, {REFS_SQL} SELECT page_id, pos, class FROM refs")
def _(spark, sf):
    return H.reference_table(rich_pages(spark, sf)).select("page_id", "pos", "class")


@query("link_summary", f"""WITH {RICH_SQL}, {TAGS_SQL}, {REFS_SQL} SELECT page_id, count_if(class = 'self') AS self_refs,
  count_if(class = 'empty') AS empty_refs, count_if(class = 'external') AS external_refs FROM {PAGE_REFS}""")
def _(spark, sf):
    def counted(kind):
        return F.size(F.filter("refs", lambda r: r["class"] == kind)).cast("long").alias(f"{kind}_refs")

    return _references(spark, sf).select("page_id", *[counted(kind) for kind in ("self", "empty", "external")])


@query("external_form_submit", f"""WITH {RICH_SQL}, {TAGS_SQL}, {REFS_SQL} SELECT page_id,
  count_if(tag = 'form' AND class = 'external') > 0 AS external_form_submit FROM {PAGE_REFS}""")
def _(spark, sf):
    return _references(spark, sf).select(
        "page_id", F.exists("refs", lambda r: r["form"] & (r["class"] == "external")).alias("external_form_submit")
    )


def _mentions(terms, column: str = "x") -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(t)})" for t in terms) + ")"


@query("term_mentions", f"""WITH {RICH_SQL}, {TEXT_SQL}, src AS (SELECT 'p' || page_id AS id, lower(visible) AS x FROM vis UNION ALL SELECT 'd' || doc_id, lower(text) FROM documents)
SELECT id, {_mentions(BANK_TERMS)} AS bank, {_mentions(PAY_TERMS)} AS pay, {_mentions(CRYPTO_TERMS)} AS crypto FROM src""")
def _(spark, sf):
    rows = rich_pages(spark, sf).select(F.concat(F.lit("p"), "page_id").alias("id"), H.visible_text(F.col("html")).alias("x")).unionByName(
        table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("x"))
    )
    folded = rows.withColumn("x", fold_text(F.col("x")))
    return folded.select("id", *[H.mentions(F.col("x"), t).alias(n) for n, t in (("bank", BANK_TERMS), ("pay", PAY_TERMS), ("crypto", CRYPTO_TERMS))])


@query("has_copyright", f"""WITH {RICH_SQL}, {TEXT_SQL}, src AS (SELECT 'p' || page_id AS id, lower(visible) AS x FROM vis UNION ALL SELECT 'd' || doc_id, lower(text) FROM documents)
SELECT id, {_mentions(COPYRIGHT_TERMS)} AS has_copyright FROM src""")
def _(spark, sf):
    rows = rich_pages(spark, sf).select(F.concat(F.lit("p"), "page_id").alias("id"), H.visible_text(F.col("html")).alias("x")).unionByName(
        table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("x"))
    )
    return rows.select("id", H.mentions(fold_text(F.col("x")), COPYRIGHT_TERMS).alias("has_copyright"))


def page_features_sql() -> str:
    """CTEs ending in ``pf``: status, title and the 39 features of every rich page, as doubles."""
    flag = lambda test: f"(count_if({test}) > 0)::INT::DOUBLE"
    return f"""{TAGS_SQL}, {REFS_SQL}, {TEXT_SQL}, {TITLE_SQL}, linesrc AS (SELECT page_id AS id, html AS h FROM rich), {LINES_SQL},
{url_features_sql('pages', 'page_id')},
tagf AS (SELECT page_id, count_if(tag = 'iframe')::DOUBLE AS iframe_count, count_if(tag = 'img')::DOUBLE AS image_count,
  count_if({_STYLE})::DOUBLE AS css_count, count_if(tag = 'script')::DOUBLE AS javascript_count, {flag(_ICON)} AS has_favicon,
  {flag(_VIEW)} AS is_responsive, {flag(_DESC)} AS has_description, {flag(_SOCIAL)} AS has_social, {flag(_SUBMIT)} AS has_submit_button,
  {flag("tag = 'input' AND lower(coalesce(type, '')) = 'hidden'")} AS has_hidden_fields,
  {flag("tag = 'input' AND lower(coalesce(type, '')) = 'password'")} AS has_password_field FROM {PAGE_TAGS}),
reff AS (SELECT page_id, count_if(class = 'self')::DOUBLE AS self_ref_count, count_if(class = 'empty')::DOUBLE AS empty_ref_count,
  count_if(class = 'external')::DOUBLE AS external_ref_count, {flag("tag = 'form' AND class = 'external'")} AS external_form_submit FROM {PAGE_REFS}),
txtf AS (SELECT page_id, {', '.join(f"{_mentions(t, 'lower(visible)')}::INT::DOUBLE AS {n}" for n, t in (('mentions_bank', BANK_TERMS), ('mentions_pay', PAY_TERMS), ('mentions_crypto', CRYPTO_TERMS), ('has_copyright', COPYRIGHT_TERMS)))} FROM vis),
pf AS (SELECT * EXCLUDE (html_line_count, largest_line_length), 'ok' AS status, html_line_count::DOUBLE AS html_line_count, largest_line_length::DOUBLE AS largest_line_length,
  (title <> '')::INT::DOUBLE AS has_title FROM uf JOIN tagf USING (page_id) JOIN reff USING (page_id) JOIN txtf USING (page_id)
  JOIN titles USING (page_id) JOIN (SELECT id AS page_id, html_line_count, largest_line_length FROM ln) USING (page_id))"""


@query("dom_features", f"WITH {RICH_SQL}, {page_features_sql()} SELECT page_id, {', '.join(DOM_FEATURES)} FROM pf")
def _(spark, sf):
    return H.add_page_features(rich_pages(spark, sf)).select("page_id", *DOM_FEATURES)


@query("all_page_features", f"WITH {RICH_SQL}, {page_features_sql()} SELECT page_id, status, title, {rounded_sql(NUMERIC_FEATURES)} FROM pf")
def _(spark, sf):
    out = all_features(rich_pages(spark, sf), prefix="")
    return out.select("page_id", "status", "title", *[F.round(c, 9).alias(c) for c in NUMERIC_FEATURES])


REJECT_SQL = """CASE WHEN coalesce(trim(label), '') = '' THEN 'missing_label' WHEN coalesce(trim(url), '') = '' THEN 'missing_url'
  WHEN coalesce(trim(date), '') = '' THEN 'missing_date' END"""
CANONICAL_SQL = f"""{RAW_SQL}, {page_features_sql()}, {canonical_sql('raw', 'page_id', 'rc')},
rec AS (SELECT r.page_id, {REJECT_SQL.replace('label', 'r.label', 1).replace('(url', '(r.url').replace('(date', '(r.date').replace('trim(url)', 'trim(r.url)').replace('trim(date)', 'trim(r.date)')} AS reject_reason, r.url, r.date, r.label, pf.title, rc.canonical, {', '.join('pf.' + n for n in NUMERIC_FEATURES)}
  FROM raw r JOIN pf ON pf.page_id = r.page_id JOIN rc ON rc.page_id = r.page_id),
canonical AS (SELECT page_id, reject_reason, CASE WHEN reject_reason IS NULL THEN url END AS url, CASE WHEN reject_reason IS NULL THEN title END AS title,
  CASE WHEN reject_reason IS NULL THEN date END AS date_text, CASE WHEN reject_reason IS NULL THEN CASE lower(trim(label)) WHEN 'phish' THEN 1 ELSE 0 END END AS label,
  CASE WHEN reject_reason IS NULL THEN sha256(canonical) END AS sample_id,
  CASE WHEN reject_reason IS NOT NULL THEN 'skipped' WHEN title = '' THEN 'empty_title' ELSE 'ok' END AS parse_status,
  {', '.join(f'CASE WHEN reject_reason IS NULL THEN round({n}, 9) END AS dom_{n}' for n in NUMERIC_FEATURES)} FROM rec)"""


@query("canonical_records", f"WITH {CANONICAL_SQL} SELECT * FROM canonical")
def _(spark, sf):
    out = canonical_records(raw_rows(spark, sf)).drop("date")
    return out.select(
        *[c for c in out.columns if not c.startswith("dom_")],
        *[F.round("dom_" + n, 9).alias("dom_" + n) for n in NUMERIC_FEATURES],
    )
