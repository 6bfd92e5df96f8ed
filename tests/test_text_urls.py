"""Rule tables for text and URL functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagesieve.functions.text import byte_length, clean_text, content_signature, load_time_ms
from pagesieve.functions.urls import doc_id, normalize_links, normalize_url, sanitize_id


def values(spark, cases, column):
    """``column`` of "x" for every case, in order."""
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    return [row.y for row in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    cases = {
        "": "",
        None: "",
        "  a  b ": "a b",
        "a  b c": "a b c",
        "\x85x　": "x",
        "line\r\n\tnext\x0bpage\x0c": "line next page",
        "<p>kept</p>": "<p>kept</p>",
    }
    assert values(spark, list(cases), clean_text("x")) == list(cases.values())


def test_signature_is_of_trimmed_raw_text(spark):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    cases = {"testsignature": "testsignature", "  a  B \n": "a  B", "": "", None: "", "A b": "A b", "a b": "a b"}
    assert values(spark, list(cases), content_signature("x")) == [sha(v) for v in cases.values()]


def test_byte_length(spark):
    assert values(spark, ["abc", "äé", "", None], byte_length("x")) == [3, 4, 0, 0]


def test_load_time(spark):
    cases = ["15000000000", "1999999", "999999", "0", "-5000000", str(2**62)]
    expected = [15000, 1, 0, 0, 0, 2**62 // 10**6]
    assert values(spark, cases, load_time_ms(F.col("x").cast("long"))) == expected


URLS = {
    # valid, and what becomes of them
    "HTTP://Example.COM/Path?Q=A#Frag": "http://example.com/Path?Q=A#Frag",
    "//Foo.com/x": "https://foo.com/x",
    "  https://x.y  ": "https://x.y",
    "https://x.y/?utm_source=a&b=c": "https://x.y/?utm_source=a&b=c",
    "https://x.y:443/a/": "https://x.y:443/a/",
    "https://User:Pw@Host.com/": "https://User:Pw@host.com/",
    "http://x.com/a b": "http://x.com/a%20b",
    "http://x.com/für": "http://x.com/f%C3%BCr",
    "http://x.com/a%2Fb": "http://x.com/a%2Fb",
    "http://x.com/a%2Fb c": "http://x.com/a/b%20c",
    "http://x.com/a+b c*d": "http://x.com/a+b%20c%2Ad",
    "http://x.com/?q=é b": "http://x.com/?q=é b",
    "http://x.com/#é": "http://x.com/#%C3%A9",
    "http://x#": "http://x",
    "http://x?#": "http://x?",
    "http://[::1]:80/x": "http://[::1]:80/x",
    "http://É.com/": "http://%C3%A9.com/",
    "http:///p": "http:///p",
    "http://": "http:",
    "/r?u=http://x": "https:///r?u=http://x",
    "javascript:open('http://X')": "javascript:open('http://X')",
    # invalid
    "": None,
    "   ": None,
    None: None,
    "/about": None,
    "mailto:a@b": None,
    "example.com/x": None,
    "://x": None,
    "1http://x": None,
    "http://x.com/%zz": None,
    "http://x.com/%2": None,
    "http://[bad": None,
    "http://a b/": None,
    "http://x:8a/": None,
    "http://x/\x01": None,
}


def test_normalize_url(spark):
    got = values(spark, list(URLS), normalize_url("x"))
    assert dict(zip(URLS, got)) == URLS


def test_normalize_url_twice_is_once(spark):
    valid = [v for v in URLS.values() if v and v != "http:"]
    assert values(spark, valid, normalize_url("x")) == valid


def test_long_urls_need_no_stack(spark):
    n = 200_000
    cases = ["http://" + "é" * n, "http://" + "A" * n + "_/ x", "http://h/" + "ü" * 1000, "http://" + "a:" * n, "http://h/" + "%41" * n]
    got = values(spark, cases, normalize_url("x"))
    assert got[0] == "http://" + "%C3%A9" * n and got[1] == "http://" + "a" * n + "_/%20x"
    assert got[2] == "http://h/" + "%C3%BC" * 1000 and got[3] is None and got[4] == cases[4]


def test_normalize_links_keeps_order_and_repeats(spark):
    df = spark.createDataFrame(
        [(["//B.com/x", "/about", "HTTP://a.com", "//B.com/x"],), (["/only", "mailto:x"],), ([],), (None,)], "xs array<string>"
    )
    got = [row.y for row in df.select(normalize_links("xs").alias("y")).collect()]
    assert got == [["https://b.com/x", "http://a.com", "https://b.com/x"], None, None, None]


def test_sanitize_id(spark):
    cases = {
        "http://example.com/page1": "example.com_page1",
        "https://example.com/page2": "example.com_page2",
        "HTTP://x.y/z": "HTTP___x.y_z",
        "https://a.b/?q=1&r=2#f g": "a.b__q_1_r_2_f_g",
        "https://a.b/r?u=http://c.d": "a.b_r_u_c.d",
        "aé%b~c": "abc",
        "x" * 150: "x" * 100,
        "hhttp://ttp://x": "http___x",  # one pass only
    }
    assert values(spark, list(cases), sanitize_id("x")) == list(cases.values())


@pytest.mark.parametrize(
    ("url", "canonical", "expected"),
    [
        ("http://example.com/page1", "", "example.com_page1"),
        ("http://example.com/page1", "  ", "example.com_page1"),
        ("http://example.com/page1", None, "example.com_page1"),
        ("https://example.com/page2", "https://example.com/c", "example.com_c"),
        ("https://x", " https://y ", "_y_"),
    ],
)
def test_doc_id(spark, url, canonical, expected):
    df = spark.createDataFrame([(url, canonical)], "u string, c string")
    assert df.select(doc_id("u", "c").alias("y")).first().y == expected
