"""HTML as columns: a tag table, text, and the 22 page-structure features.

There is no parser here. A page is scanned by one left-to-right regular expression whose
alternatives are a comment, a raw-text element with its body, and a tag. Because each match is
consumed whole, markup inside comments, scripts, styles, text areas, titles or quoted attribute
values never yields a tag. Everything stays within the row, so no shuffle is needed and the
same columns work on a stream.

Differences from a tolerant tree parser: tags are not nested or repaired, a tag without an end is
dropped with the rest of the page, and references need their semicolon.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.constants import (
    BANK_TERMS, COPYRIGHT_TERMS, CRYPTO_TERMS, DOM_FEATURES, EMPTY_REF_SCHEMES, PAY_TERMS,
    REFERENCE_ATTRIBUTES, SOCIAL_DOMAINS,
)
from sitesift.functions.columns import built_once
from sitesift.functions.normalize import fold_text
from sitesift.functions.urls import SPACE_CLASS, let, strip, text, url_domain

# Attribute part of a tag. Quotes only matter after an equals sign. Possessive quantifiers keep the
# scan off the call stack. Whatever is opened and never closed is one match up to the end of the
# page: it is not given up and tried again from the next '<', so the scan is linear.
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+"""
COMMENT = r"<!--.*?(?:-->|\z)"
RAW_NAMES = ["script", "style", "textarea", "title"]
TAG = rf"<[a-z]{ATTRS}(?:>|\z)"


def _raw_element(name: str, body: str) -> str:
    return rf"<{name}(?:[\s/]{ATTRS})?+(?:>{body}(?:</{name}[^>]*+(?:>|\z)|\z)|\z)"


RAW_ELEMENT = "|".join(_raw_element(name, ".*?") for name in RAW_NAMES)
MARKUP = rf"(?is){COMMENT}|{RAW_ELEMENT}|{TAG}"
# For text: the same scan, but raw bodies are kept and every other tag or declaration is dropped.
TEXT_RAW = "|".join(_raw_element(name, "(.*?)") for name in RAW_NAMES)
TEXT_MARKUP = rf"(?is){COMMENT}|{TEXT_RAW}|</?[a-z]{ATTRS}(?:>|\z)|<[!?][^>]*+(?:>|\z)"
BODY_START = rf"(?is)^(?:{COMMENT}|{RAW_ELEMENT}|<(?!body[\s/>])|[^<]++)*+<body(?:[\s/]{ATTRS})?+>"
NO_TITLE = "|".join(_raw_element(name, ".*?") for name in RAW_NAMES if name != "title")
TITLE = rf"(?is)^(?:{COMMENT}|{NO_TITLE}|<(?!title[\s/>])|[^<]++)*+<title(?:[\s/]{ATTRS})?+>(.*?)(?:</title[^>]*+(?:>|\z)|\z)"
TITLE_ELEMENT = r"(?is)<title[^>]*+(?:>.*?(?:</title[^>]*+(?:>|\z)|\z)|\z)"
ATTRIBUTE = r"""(?s)[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++))?+"""
REFERENCE = r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*+);"
NAMED = " ".join(f"{name}={chr(code)}" for name, code in {**name2codepoint, "apos": 39}.items())
LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"  # and the line feed


def _character(name: Column) -> Column:
    """The character of a reference without '&' and ';'; null for an unknown name."""
    code = F.when(
        F.rlike(name, F.lit("^#[xX]")), F.conv(F.substr(name, F.lit(3)), 16, 10)
    ).when(F.startswith(name, F.lit("#")), F.substr(name, F.lit(2))).cast("long")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    safe = F.when(valid, code).otherwise(0xFFFD)
    return F.when(
        F.startswith(name, F.lit("#")), F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    ).otherwise(F.try_element_at(F.str_to_map(F.lit(NAMED), F.lit(" "), F.lit("=")), name))


def unescape(value: Column) -> Column:
    """Decode character references once; text without an ampersand is passed through.

    Numbers that are no character give U+FFFD; unknown names stay as they are. The value is bound, as
    it is often a scan of a page, which would be made for each use.
    """
    return let(value, _unescape_bound)


def _unescape_bound(value: Column) -> Column:
    named = F.transform(
        F.split(value, "&"),
        lambda part, i: F.struct(
            part.alias("part"),
            F.when(i > 0, F.regexp_extract(part, REFERENCE, 1)).alias("name"),
        ),
    )
    found = F.transform(
        named, lambda p: F.struct(
            p["part"].alias("part"), p["name"].alias("name"),
            F.when(p["name"] != "", _character(p["name"])).alias("char"),
        ),
    )
    decoded = F.transform(
        found, lambda p: F.when(p["name"].isNull(), p["part"])
        .when(p["char"].isNull(), F.concat(F.lit("&"), p["part"]))
        .otherwise(F.concat(p["char"], F.substr(p["part"], F.length(p["name"]) + 2))),
    )
    return F.when(F.contains(value, F.lit("&")), F.array_join(decoded, "")).otherwise(value)


def html_status(html: Column) -> Column:
    """'empty' for blank, 'parse_error' for a NUL, otherwise 'ok'."""
    return (
        F.when(~F.rlike(text(html), F.lit(rf"[^{SPACE_CLASS}]")), "empty")
        .when(F.contains(html, F.lit("\x00")), "parse_error")
        .otherwise("ok")
    )


def parse_status(status: Column, title: Column) -> Column:
    return (
        F.when(status == "empty", "empty_document")
        .when((status == "ok") & (title == ""), "empty_title")
        .otherwise(status)
    )


# --- tags ------------------------------------------------------------------------


def page_tags(html: Column) -> Column:
    """array<struct<tag, attrs map>> of the start tags in document order."""
    tokens = F.regexp_extract_all(text(html), F.lit(MARKUP), F.lit(0))
    starts = F.transform(
        F.filter(tokens, lambda t: ~F.startswith(t, F.lit("<!--"))),
        lambda t: F.regexp_extract(t, rf"(?is)^{TAG}", 0),
    )
    return F.transform(
        F.filter(starts, lambda t: F.endswith(t, F.lit(">"))),
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"^<([^\s/>]+)", 1)).alias("tag"),
            F.when(F.rlike(t, F.lit(r"^<[^\s/>]+[\s/]*>\z")), _no_attributes())
            .otherwise(_attribute_map(t))
            .alias("attrs"),
        ),
    )


def _no_attributes() -> Column:
    return F.create_map().cast("map<string,string>")


def _attribute_map(start_tag: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(start_tag, r"^<[^\s/>]+", ""), r">\z", "")
    items = F.transform(
        F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(0)),
        lambda item: F.struct(
            F.lower(F.regexp_extract(item, r"^[^\s=]+", 0)).alias("key"),
            unescape(
                F.concat(
                    F.regexp_extract(item, r"""(?s)^[^=]*+=\s*+"([^"]*+)"\z""", 1),
                    F.regexp_extract(item, r"""(?s)^[^=]*+=\s*+'([^']*+)'\z""", 1),
                    F.regexp_extract(item, r"""(?s)^[^=]*+=\s*+([^\s"'].*)\z""", 1),
                )
            ).alias("value"),
        ),
    )
    return let(items, _first_of_each_name)


def _first_of_each_name(items: Column) -> Column:
    """A map in document order; the first of several attributes of one name counts.

    Sorted by name and place, an attribute is first if its neighbour before has another name.
    """
    return F.map_from_entries(F.when(F.size(items) < 2, items).otherwise(_first_in_order(items)))


def _first_in_order(items: Column) -> Column:
    placed = F.array_sort(
        F.transform(items, lambda item, i: F.struct(item["key"].alias("key"), i.alias("at"), item["value"].alias("value")))
    )
    firsts = let(placed, lambda all_: F.filter(
        all_, lambda item, i: (i == 0) | (F.get(all_, i - 1)["key"] != item["key"])
    ))
    ordered = F.array_sort(
        F.transform(firsts, lambda item: F.struct(item["at"].alias("at"), item["key"].alias("key"), item["value"].alias("value")))
    )
    return F.transform(ordered, lambda item: F.struct(item["key"].alias("key"), item["value"].alias("value")))


@built_once
def _tags_of(html: str) -> Column:
    return page_tags(F.col(html))


@built_once
def _reference_columns() -> tuple[Column, Column, Column]:
    return (
        url_domain(text(F.col("url"))), reference_of(F.col("t")),
        classify_reference(F.col("base"), F.col("reference")),
    )


def tag_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Long form: (key, pos, tag, attrs), one row per start tag."""
    return pages.select(key, F.posexplode(_tags_of(html)).alias("pos", "t")).select(
        key, "pos", F.col("t.tag").alias("tag"), F.col("t.attrs").alias("attrs")
    )


def attribute(tag: Column, name: str) -> Column:
    return F.try_element_at(tag["attrs"], F.lit(name))


def lower_attribute(tag: Column, name: str) -> Column:
    return F.lower(F.coalesce(attribute(tag, name), F.lit("")))


def words(value: Column) -> Column:
    return F.split(value, rf"[{SPACE_CLASS}]+")


# --- tests on one tag ------------------------------------------------------------


def is_stylesheet(tag: Column) -> Column:
    return (tag["tag"] == "style") | (
        (tag["tag"] == "link") & F.array_contains(words(lower_attribute(tag, "rel")), "stylesheet")
    )


def is_favicon(tag: Column) -> Column:
    rel = lower_attribute(tag, "rel")
    return (tag["tag"] == "link") & (
        F.array_contains(words(rel), "icon")
        | F.contains(rel, F.lit("shortcut icon"))
        | F.endswith(lower_attribute(tag, "href"), F.lit("favicon.ico"))
    )


def is_viewport(tag: Column) -> Column:
    return (tag["tag"] == "meta") & (lower_attribute(tag, "name") == "viewport")


def is_description(tag: Column) -> Column:
    content = strip(F.coalesce(attribute(tag, "content"), F.lit("")))
    named = lower_attribute(tag, "name") == "description"
    prop = lower_attribute(tag, "property").isin("description", "og:description")
    return (tag["tag"] == "meta") & (content != "") & (named | prop)


def is_social_link(tag: Column) -> Column:
    href = lower_attribute(tag, "href")
    return reduce(lambda a, b: a | b, [F.contains(href, F.lit(d)) for d in SOCIAL_DOMAINS])


def is_submit(tag: Column) -> Column:
    kind = lower_attribute(tag, "type")
    return ((tag["tag"] == "input") & (kind == "submit")) | (
        (tag["tag"] == "button") & (attribute(tag, "type").isNull() | (kind == "submit"))
    )


def is_input(tag: Column, kind: str) -> Column:
    return (tag["tag"] == "input") & (lower_attribute(tag, "type") == kind)


# --- references ------------------------------------------------------------------


def reference_of(tag: Column) -> Column:
    """The target of a link, script, image, frame or form; null for other tags."""
    chosen = None
    for attr in sorted(set(REFERENCE_ATTRIBUTES.values())):
        tags = [name for name, wanted in REFERENCE_ATTRIBUTES.items() if wanted == attr]
        test = tag["tag"].isin(tags)
        value = attribute(tag, attr)
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen


def classify_reference(base_domain: Column, reference: Column) -> Column:
    """'empty', 'self' or 'external'. Relative references resolve to the base host."""
    return let(strip(reference), lambda value: _classify_stripped(base_domain, value))


def _classify_stripped(base_domain: Column, value: Column) -> Column:
    lowered = F.lower(value)
    empty = (value == "") | F.startswith(value, F.lit("#"))
    for scheme in EMPTY_REF_SCHEMES:
        empty = empty | F.startswith(lowered, F.lit(scheme))
    absolute = F.contains(value, F.lit("://")) | F.startswith(value, F.lit("//"))
    same = (base_domain != "") & (~absolute | (url_domain(value) == base_domain))
    return F.when(empty, "empty").when(same, "self").otherwise("external")


def reference_table(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, tag, reference, class) for every reference on every page."""
    base, reference, kind = _reference_columns()
    return (
        pages.select(key, base.alias("base"), F.posexplode(_tags_of("html")).alias("pos", "t"))
        .withColumn("reference", reference)
        .where(F.col("reference").isNotNull())
        .select(key, "pos", F.col("t.tag").alias("tag"), "reference", kind.alias("class"))
    )


@built_once
def _classified_references() -> Column:
    references = F.filter(
        F.transform(
            F.col("tags"),
            lambda t: F.struct((t["tag"] == "form").alias("form"), reference_of(t).alias("reference")),
        ),
        lambda r: r["reference"].isNotNull(),
    )
    return F.transform(
        references,
        lambda r: F.struct(r["form"].alias("form"), classify_reference(F.col("_base"), r["reference"]).alias("class")),
    )


def with_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``tags``, in document order; a page without tags has an empty array."""
    return pages.withColumn("tags", _tags_of(html))


def with_references(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds ``refs``, array<struct<form, class>>; a page without references has an empty array."""
    based = with_tags(pages, html).withColumn("_base", url_domain(text(F.col(url))))
    return based.withColumn("refs", _classified_references()).drop("tags", "_base")


# --- text ------------------------------------------------------------------------


def collapse(value: Column) -> Column:
    return strip(F.regexp_replace(value, rf"[{SPACE_CLASS}]+", " "))


def page_title(html: Column) -> Column:
    """Text of the first title, white space collapsed; empty when there is none."""
    return F.when(
        F.rlike(html, F.lit("(?i)<title")), collapse(unescape(F.regexp_extract(html, TITLE, 1)))
    ).otherwise("")


def _cut_markup(markup: Column) -> Column:
    """Text nodes with a \\x01 mark wherever markup was."""
    return unescape(F.regexp_replace(markup, TEXT_MARKUP, "\x01$1$2$3$4\x01"))


def marked_text(html: Column) -> Column:
    """Marked text of the body; of the whole document if the body holds no text."""
    body = F.when(
        F.rlike(html, F.lit("(?i)<body")), F.regexp_replace(html, BODY_START, "")
    ).otherwise(F.regexp_replace(html, TITLE_ELEMENT, ""))
    has_text = F.lit(rf"[^{SPACE_CLASS}\x01]")
    return let(
        _cut_markup(body), lambda cut: F.when(F.rlike(cut, has_text), cut).otherwise(_cut_markup(html))
    )


def visible_text(html: Column) -> Column:
    """Trimmed text nodes of the body joined by a space."""
    gap = rf"(?<![{SPACE_CLASS}])[{SPACE_CLASS}]*+\x01[{SPACE_CLASS}\x01]*+"
    return strip(F.regexp_replace(marked_text(html), gap, " "))


def mentions(folded: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(folded, F.lit(term)) for term in terms])


def line_lengths(html: Column) -> Column:
    """Code points per line; a break at the very end adds no line."""
    plain = F.replace(html, F.lit("\r\n"), F.lit("\n"))
    for mark in LINE_BREAKS:  # a search for bytes each, far cheaper than one for a class of characters
        plain = F.replace(plain, F.lit(mark), F.lit("\n"))

    def lengths(lines: Column) -> Column:
        trimmed = F.when(
            F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
        ).otherwise(lines)
        return F.transform(trimmed, F.length)

    return let(F.split(plain, "\n"), lengths)


# --- the 22 page features --------------------------------------------------------


@built_once
def _page_stages(url: str, html: str) -> list[dict[str, Column]]:
    """Projections in order; each reads what the ones before it made, so a page is scanned once."""
    page = F.col("_html")
    references = F.filter(
        F.transform(
            F.col("_tags"),
            lambda t: F.struct((t["tag"] == "form").alias("form"), reference_of(t).alias("reference")),
        ),
        lambda r: r["reference"].isNotNull(),
    )
    classified = F.transform(
        references,
        lambda r: F.struct(
            r["form"].alias("form"), classify_reference(F.col("_base"), r["reference"]).alias("class")
        ),
    )
    return [
        {"status": html_status(F.col(html)), "_base": url_domain(text(F.col(url)))},
        {"_html": F.when(F.col("status") == "ok", F.col(html)).otherwise("")},
        {
            "title": page_title(page), "_tags": page_tags(page), "_lines": line_lengths(page),
            # The searched terms hold no white space, so the marks need not be tidied up.
            "_visible": marked_text(page),
        },
        {"_folded": fold_text(F.col("_visible")), "_refs": classified},
    ]


@built_once
def _page_values() -> dict[str, Column]:
    tags, refs, folded = F.col("_tags"), F.col("_refs"), F.col("_folded")

    def tag_count(name: str) -> Column:
        return F.size(F.filter(tags, lambda t: t["tag"] == name))

    def ref_count(kind: str) -> Column:
        return F.size(F.filter(refs, lambda r: r["class"] == kind))

    values = {
        "html_line_count": F.size("_lines"),
        "largest_line_length": F.coalesce(F.array_max("_lines"), F.lit(0)),
        "iframe_count": tag_count("iframe"),
        "image_count": tag_count("img"),
        "css_count": F.size(F.filter(tags, is_stylesheet)),
        "javascript_count": tag_count("script"),
        "self_ref_count": ref_count("self"),
        "empty_ref_count": ref_count("empty"),
        "external_ref_count": ref_count("external"),
        "has_title": F.col("title") != "",
        "has_favicon": F.exists(tags, is_favicon),
        "is_responsive": F.exists(tags, is_viewport),
        "has_description": F.exists(tags, is_description),
        "external_form_submit": F.exists(refs, lambda r: r["form"] & (r["class"] == "external")),
        "has_social": F.exists(tags, is_social_link),
        "has_submit_button": F.exists(tags, is_submit),
        "has_hidden_fields": F.exists(tags, lambda t: is_input(t, "hidden")),
        "has_password_field": F.exists(tags, lambda t: is_input(t, "password")),
        "mentions_bank": mentions(folded, BANK_TERMS),
        "mentions_pay": mentions(folded, PAY_TERMS),
        "mentions_crypto": mentions(folded, CRYPTO_TERMS),
        "has_copyright": mentions(folded, COPYRIGHT_TERMS),
    }
    return {name: values[name].cast("double") for name in DOM_FEATURES}


def add_page_features(
    frame: DataFrame, url: str = "url", html: str = "html", prefix: str = ""
) -> DataFrame:
    """Adds ``status``, ``title`` and the 22 page features; the HTML column is left to the caller.

    Pages that are blank or hold a NUL give zeros.
    """
    for stage in _page_stages(url, html):
        frame = frame.withColumns(stage)
    values = {prefix + name: value for name, value in _page_values().items()}
    return frame.withColumns(values).drop("_html", "_base", "_tags", "_lines", "_visible", "_folded", "_refs")
