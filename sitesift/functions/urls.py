"""URL columns: canonical form, authority, IP literals, suffixes and counts.

Two parsers on purpose. ``canonicalize_url`` is strict (bad ports and missing hosts
give null, which callers route to a reject reason). ``authority_host`` is the tolerant
feature-side parser: it never rejects.

Every function takes and returns columns, so all of it runs inside the scan stage.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.constants import MULTI_SUFFIXES, SINGLE_SUFFIXES, URL_FEATURES
from sitesift.functions.columns import built_once

# Code points that count as white space when text is trimmed or split.
SPACE_CLASS = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
IPV4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
HEX_GROUP = r"[0-9A-Fa-f]{1,4}"
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def text(value: Column) -> Column:
    """Missing text (null or the text of NaN) is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^[{SPACE_CLASS}]++|(?<![{SPACE_CLASS}])[{SPACE_CLASS}]++\z", "")


@lru_cache(maxsize=1)
def _delimiter_lookalikes() -> str:
    """Character class of code points that normalise to a URL delimiter."""
    found = [
        cp for cp in range(0x80, 0x110000)
        if not 0xD800 <= cp <= 0xDFFF and set(unicodedata.normalize("NFKC", chr(cp))) & set("/?#@:")
    ]
    return "[" + "".join(rf"\x{{{cp:X}}}" for cp in found) + "]"


# --- strict canonical form -------------------------------------------------------


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, drop fragment, userinfo, default slash; null if invalid."""
    raw = strip(text(url))
    full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("//"), raw))
    # C0 controls before the URL and line breaks inside it are not part of it.
    full = F.regexp_replace(full, r"^[\x{00}-\x{20}]+|[\t\r\n]", "")
    return F.when(raw == "", F.lit(None).cast("string")).otherwise(let(full, _canonical_from))


def _canonical_from(full: Column) -> Column:
    """The parts are bound step by step, so that each pattern is matched once however often its part is used."""
    names = ("scheme", "netloc", "path", "query")
    parts = F.struct(*[F.regexp_extract(full, URL_PARTS, i + 1).alias(n) for i, n in enumerate(names)])
    return let(parts, lambda found: let(_host_and_port(found["netloc"]), lambda place: _canonical_of(found, place)))


def _host_and_port(netloc: Column) -> Column:
    host_port = F.substring_index(netloc, "@", -1)
    host = F.when(
        F.contains(host_port, F.lit("[")), F.regexp_extract(host_port, r"\[([^\]]*)", 1)
    ).otherwise(F.substring_index(host_port, ":", 1))
    port = F.when(
        F.contains(host_port, F.lit("[")), F.regexp_extract(host_port, r"\][^:]*:(.*)", 1)
    ).otherwise(F.regexp_extract(host_port, r"^[^:]*:(.*)", 1))
    return F.struct(
        host_port.alias("host_port"), host.alias("host"), port.alias("port"),
        # ``length`` of these first: longer digit runs cannot be ports and must not be cast.
        F.regexp_replace(port, "^0+", "").alias("digits"),
    )


def _canonical_of(found: Column, place: Column) -> Column:
    scheme, netloc, path, query = (found[n] for n in ("scheme", "netloc", "path", "query"))
    host_port, host, port, digits = (place[n] for n in ("host_port", "host", "port", "digits"))
    bracketed = F.contains(netloc, F.lit("[")) | F.contains(netloc, F.lit("]"))
    bracket_ok = ~bracketed | (
        F.rlike(host_port, F.lit(r"^\[[^\[\]]*\](?::.*)?\z"))
        & (_is_ipv6(F.substring_index(host, "%", 1)) | F.rlike(host, F.lit(r"^[vV][0-9A-Fa-f]+\..+")))
    )
    port_ok = (port == "") | (
        F.rlike(port, F.lit(r"^[0-9]+\z"))
        & (F.length(digits) <= 5)
        & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535)
    )
    scheme_ok = (scheme == "") | F.rlike(scheme, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*\z"))
    plain = F.octet_length(netloc) == F.length(netloc)  # ASCII alone has no look-alikes
    valid = (
        (host != "") & scheme_ok & port_ok & bracket_ok
        & (plain | ~F.rlike(netloc, F.lit(_delimiter_lookalikes())))
    )
    return F.when(
        valid,
        F.concat(
            F.when(scheme == "", "").otherwise(F.concat(F.lower(scheme), F.lit(":"))),
            F.lit("//"),
            F.lower(host),
            F.when(digits == "", "").otherwise(F.concat(F.lit(":"), digits)),
            F.regexp_replace(path, r"/+\z", ""),
            F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def sample_id(url: Column) -> Column:
    """sha256 hex of the canonical URL; null when the URL is invalid."""
    return F.sha2(canonicalize_url(url), 256)


def strict_host(url: Column) -> Column:
    """Host as the split side sees it (first colon ends an unbracketed host)."""
    raw = text(url)
    full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("//"), raw))
    full = F.regexp_replace(full, r"^[\x{00}-\x{20}]+|[\t\r\n]", "")

    def body(value: Column) -> Column:
        host_port = F.substring_index(F.regexp_extract(value, URL_PARTS, 2), "@", -1)
        return F.lower(
            F.when(
                F.contains(host_port, F.lit("[")), F.regexp_extract(host_port, r"\[([^\]]*)", 1)
            ).otherwise(F.substring_index(host_port, ":", 1))
        )

    return let(full, body)


# --- tolerant authority parser ---------------------------------------------------


def url_scheme(url: Column) -> Column:
    return F.when(
        F.contains(url, F.lit("://")), F.lower(F.substring_index(url, "://", 1))
    ).otherwise("")


def authority_host(url: Column) -> Column:
    """Lower-case host text; empty when there is none."""
    rest = (
        F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
        .when(F.startswith(url, F.lit("//")), F.substr(url, F.lit(3)))
        .otherwise(url)
    )
    authority = F.substring_index(F.regexp_extract(rest, r"^[^/?#]*", 0), "@", -1)
    return let(
        authority,
        lambda a: F.lower(
            F.when(F.startswith(a, F.lit("[")), F.regexp_extract(a, r"^\[([^\]]*)", 1)).otherwise(
                F.regexp_replace(a, r":[^:]*\z", "")
            )
        ),
    )


# --- IP literals -----------------------------------------------------------------


def _is_ipv6(host: Column) -> Column:
    dotted = F.contains(host, F.lit("."))
    tail_ok = F.rlike(host, F.lit(rf":{IPV4}\z"))
    plain = F.when(dotted, F.regexp_replace(host, r":[^:]*\z", ":0:0")).otherwise(host)
    groups = F.regexp_count(plain, F.lit("[0-9A-Fa-f]+"))
    compressed = F.rlike(
        plain, F.lit(rf"^(?:{HEX_GROUP}(?::{HEX_GROUP})*)?::(?:{HEX_GROUP}(?::{HEX_GROUP})*)?\z")
    ) & (groups < 8)
    complete = F.rlike(plain, F.lit(rf"^{HEX_GROUP}(?::{HEX_GROUP}){{7}}\z"))
    # Only the first form holds "::", so one of the two patterns is enough.
    form = F.when(F.contains(plain, F.lit("::")), compressed).otherwise(complete)
    return F.contains(host, F.lit(":")) & (~dotted | tail_ok) & form


def is_ip_literal(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(":")), _is_ipv6(host)).otherwise(F.rlike(host, F.lit(rf"^{IPV4}\z")))


# --- suffixes --------------------------------------------------------------------


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda label: label != "")


def listed(value: Column, names: list[str]) -> Column:
    """Membership in a short list; '/' never occurs in a host."""
    return F.contains(F.lit("/" + "/".join(names) + "/"), F.concat(F.lit("/"), value, F.lit("/")))


def suffix_info(host: Column) -> Column:
    """struct(suffix, subdomains, labels) for a lower-case host."""

    def body(labels: Column) -> Column:
        count = F.size(labels)
        last = F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))
        pair = F.concat_ws(".", F.try_element_at(labels, F.lit(-2)), last)
        multi = (count > 2) & listed(pair, MULTI_SUFFIXES)
        no_suffix = (count <= 1) | is_ip_literal(host)
        return F.struct(
            F.when(no_suffix, F.lit("")).when(multi, pair).otherwise(last).alias("suffix"),
            F.when(no_suffix, F.lit(0))
            .when(multi, count - 3)
            .when(listed(last, SINGLE_SUFFIXES), count - 2)
            .otherwise(count - 1)
            .alias("subdomains"),
            labels.alias("labels"),
        )

    return let(host_labels(host), body)


def registrable_domain(host: Column) -> Column:
    """Suffix plus one label; hosts with an unknown suffix and IP literals stay whole."""

    def body(info: Column) -> Column:
        count = F.size(info["labels"])
        keep = F.when(F.contains(info["suffix"], F.lit(".")), F.lit(3)).otherwise(F.lit(2))
        whole = (info["suffix"] == "") | (info["subdomains"] >= count - 1)
        return F.when(whole, host).otherwise(
            F.array_join(F.slice(info["labels"], -F.least(keep, count), F.least(keep, count)), ".")
        )

    return F.when(host == "", F.lit("")).otherwise(let(suffix_info(host), body))


def url_domain(url: Column) -> Column:
    return let(authority_host(url), registrable_domain)


# --- counts ----------------------------------------------------------------------


@built_once
def _url_parts(url: str) -> tuple[Column, Column]:
    raw = text(F.col(url))
    parts = F.struct(
        raw.alias("raw"),
        authority_host(raw).alias("host"),
        F.length(raw).alias("n"),
        F.regexp_count(raw, F.lit(r"\p{L}")).alias("letters"),
        F.regexp_count(raw, F.lit(r"\p{N}")).alias("digits"),
        F.regexp_count(raw, F.lit("%[0-9A-Fa-f]{2}")).alias("escapes"),
    )
    return parts, suffix_info(F.col("_u.host"))


@built_once
def _url_values() -> dict[str, Column]:
    n, letters, digits = F.col("_u.n"), F.col("_u.letters"), F.col("_u.digits")
    escapes, host = F.col("_u.escapes"), F.col("_u.host")
    special = n - letters - digits
    size = F.greatest(n, F.lit(1))

    def occurrences(mark: str) -> Column:
        return n - F.length(F.replace(F.col("_u.raw"), F.lit(mark), F.lit("")))

    values = {
        "url_length": n,
        "domain_length": F.length(host),
        "tld_length": F.length(F.col("_s.suffix")),
        "subdomain_count": F.col("_s.subdomains"),
        "letter_count": letters,
        "digit_count": digits,
        "obfuscated_count": escapes,
        "query_count": occurrences("?"),
        "equals_count": occurrences("="),
        "ampersand_count": occurrences("&"),
        "special_count": special,
        "letter_ratio": letters / size,
        "digit_ratio": digits / size,
        "obfuscated_ratio": escapes / size,
        "special_ratio": special / size,
        "is_domain_ip": is_ip_literal(host),
        "is_https": url_scheme(F.col("_u.raw")) == "https",
    }
    return {name: values[name].cast("double") for name in URL_FEATURES}


def add_url_features(frame: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """All 17 URL features as doubles, in one narrow pass."""
    parts, suffix = _url_parts(url)
    columns = {prefix + name: value for name, value in _url_values().items()}
    return frame.withColumn("_u", parts).withColumn("_s", suffix).withColumns(columns).drop("_u", "_s")
