"""Hand-written cases for the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagetide.functions import locales as L
from pagetide.functions import ranges as R
from pagetide.functions import traffic as C
from pagetide.functions import values as V


def apply(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("o")).collect()]


def test_truncate_ip(spark):
    ips = ["192.168.1.42", "2001:db8::1", "::1", "::ffff:1.2.3.4", "", None, "unknown", "1.2.3"]
    want = ["192.168.1.0", "2001:db8:::", "::1::", "::ffff:1.2.3.0", "unknown", "unknown", "unknown", "unknown"]
    assert apply(spark, ips, C.truncate_ip) == want
    assert apply(spark, ["2001:db8::1"], lambda c: C.truncate_ip(c, proper_ipv6=True)) == ["2001:db8::"]


def test_ipv4_number(spark):
    assert apply(spark, ["10.0.0.1", "256.1.1.1", "1.2.3", None, "::1", "1.2.3.4.5"], C.ipv4_number) == [
        167772161, None, None, None, None, None]


def test_bots(spark):
    agents = ["", None, "Mozilla Googlebot/2.1", "x GPTBot y", "AcmeCrawler-x/1.0", "curl/8", "Claude-User/1", "Firefox/1"]
    assert apply(spark, agents, C.is_bot) == [False, False, True, True, True, True, True, False]
    assert apply(spark, agents[2:7], C.bot_name) == [
        "Googlebot", "GPTBot (OpenAI)", "AcmeCrawler-x", "Unknown bot", "Claude-User (Anthropic)"]
    assert apply(spark, ["a" * 80 + "bot"], C.bot_name) == ["a" * 64]


def test_bot_marks_cover_every_token():
    for token in C.BOT_TOKENS:
        assert any(mark in token.lower() for mark in C.BOT_MARKS)


def test_device_and_browser(spark):
    agents = ["iPad", "SM-T500 x", "sm-tx", "Nexus  9", "Android 1 Mobile", "", None, "X11", "Windows Phone"]
    assert apply(spark, agents, C.device) == [
        "tablet", "tablet", "desktop", "tablet", "mobile", "unknown", "unknown", "desktop", "mobile"]
    agents = ["Chrome/1 Safari/1 Edg/1", "SamsungBrowser/1 Chrome/1", "OPR/1 Chrome/1", "FxiOS/1", "CriOS/1",
              "Version/1 Safari/1", "Safari/1", ""]
    assert apply(spark, agents, C.browser) == [
        "Edge", "Samsung Internet", "Opera", "Firefox", "Chrome", "Safari", "Other", "Unknown"]


def test_source(spark):
    urls = ["https://netflix.com/a", "http://User:pw@Blog.Example.ORG:8080/p", "http://my_host.example.com/x", "no-scheme",
            "", None, "https://www.www.a.b/", "http://[2001:db8::5]:80/", "HTTPS://WWW.GOOGLE.de", "//a.b/c", "mailto:x@y"]
    assert apply(spark, urls, C.source) == [
        "X", "blog.example.org", "my_host.example.com", "Direct", "Direct", "Direct", "www.a.b", "2001:db8::5", "Google",
        "a.b", "Direct"]


SPECS = ["1-3,5,8-10", "5,1-2,2", " 4 - 6 ", "0", "5-3", "a", "", None, "9", "1,,2"]


def test_page_ranges(spark):
    assert apply(spark, SPECS, R.page_list) == [
        [1, 2, 3, 5, 8, 9, 10], [1, 2, 5], [4, 5, 6], None, None, None, None, None, [9], None]
    assert apply(spark, SPECS, lambda c: R.spec_code(c, client_codes=True)) == [
        None, None, None, "invalid_range_start", "reversed_range", "invalid_page_range", "invalid_option",
        "invalid_option", None, "invalid_page_range"]
    assert apply(spark, SPECS, lambda c: R.spec_code(c, F.lit(5), blank_ok=True)) == [
        "invalid_option", None, "invalid_option", "invalid_option", "invalid_option", "invalid_option", None, None,
        "invalid_option", "invalid_option"]


def test_huge_range_is_never_listed(spark):
    assert apply(spark, ["1-999999999999"], R.selected_count) == [999999999999]
    assert apply(spark, ["3-9,1-4,20"], R.selected_count) == [10]
    assert apply(spark, ["3-9,1-4,20"], lambda c: R.pages_before(R.parsed(c), F.lit(6))) == [5]


def test_labels(spark):
    assert apply(spark, [0, 25, 26, 701, 702, 18277, 18278], V.exhibit_letter, "long") == [
        "A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert apply(spark, [1, 999999, 1000000], lambda c: V.bates_label("B", c), "long") == ["B-000001", "B-999999", "B-1000000"]
    assert apply(spark, ["Ok 1_-", "no#", "", "a\n"], V.label_code) == [None, "invalid_option", "invalid_option", "invalid_option"]


def test_int_option(spark):
    values = ["7", "7.0", "7.5", "true", None, "-1", " 9 "]
    assert apply(spark, values, lambda c: V.int_option(c, 1)[0]) == [7, 7, None, None, None, None, 9]
    assert apply(spark, values[:2], lambda c: V.int_option(c, 1, is_text=F.lit(True))[0]) == [7, None]


def test_strip_and_names(spark):
    assert apply(spark, ["\t a \n", " ", None], V.blank_to_null) == ["a", None, None]
    assert apply(spark, ["a.B.PDF", "noext", "x.verylongextension"], lambda c: V.extension(c, F.lit("image/png"))) == [
        "pdf", "png", "verylongex"]


def test_locales(spark):
    tags = ["en-US", "zh-TW", "zh-HK-x", "zh-CN", "zh", "pt-BR", "de", "", None]
    assert apply(spark, tags, L.match_locale) == ["en", None, None, "zh-cn", None, "pt", None, None, None]
    routes = ["/", "/fr", "/fr/about/", "/tools/merge", "/ur/tools/merge", "/en/about", "/tools", "/fr/merge", "//", "/tools/x"]
    assert apply(spark, routes, lambda c: L.is_known_route(c, ("merge",))) == [
        True, True, True, True, True, False, False, False, True, False]


@pytest.mark.parametrize("text,want", [
    ("{a} {b, plural, one {# x} other {y}} <i>", (["a", "b", "y"], ["i"], ["b:plural"])), ("none", ([], [], []))])
def test_placeholders(spark, text, want):
    got = tuple(apply(spark, [text], f)[0] for f in (L.variables, L.tags, L.plurals))
    assert got == want
