import pytest
from pyspark.sql import functions as F

from graphloom.functions import html, robots, urls
from graphloom.functions import terms as t


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given", "wanted"), [
    ("HTTP://WWW.Example.COM", "http://www.example.com/"),
    ("http://a.cz:80/x", "http://a.cz/x"),
    ("https://a.cz:443/x", "https://a.cz:443/x"),
    ("http://me:pw@a.cz:81/x#top", "http://a.cz:81/x"),
    ("a.cz/x", "http://a.cz/x"),
    ("http://a.cz/%7Eme/%2f%41", "http://a.cz/~me/%2FA"),
    ("http://a.cz/a/./b/../c//d", "http://a.cz/a/c/d"),
    ("http://a.cz/b/..", "http://a.cz/"),
    ("http://a.cz/a/b/..", "http://a.cz/a/"),
    ("http://a.cz/../x", "http://a.cz/../x"),
    ("http://a.cz/?b=1&a=2", "http://a.cz/?a=2&b=1"),
    ("http://a.cz/?a;b=2", "http://a.cz/?a=;b=2"),
    ("http://a.cz/?b=1&amp;a=2", "http://a.cz/?a=2&b=1"),
    ("http://a.cz/?utm_source=x&PHPsession=1&a=1", "http://a.cz/?a=1"),
    ("http://a.cz/?utm_source=x", "http://a.cz/"),
    ("http://a.cz/?a=1&a=1&a=0", "http://a.cz/?a=0&a=1"),
    ("http://a.cz/?a1=0&a=1", "http://a.cz/?a=1&a1=0"),
    ("http://a.cz/?flag", "http://a.cz/?flag"),
    ("http://a.cz/?q=a b", "http://a.cz/?q=a+b"),
    ("http://a.cz/a b", None),
    ("http://a.cz/%zz", None),
    ("http:///x", None),
    ("", None),
    (None, None),
])
def test_normalize(spark, given, wanted):
    assert one(spark, urls.normalize, given) == wanted


def test_normalize_twice_is_once(spark):
    rows = spark.createDataFrame([(u,) for u in ("http://A.cz/x/../y?b=2&a=1", "https://b.org:8080//z/?k=%C3%A9", "c.net")], "u string")
    once = urls.normalize(F.col("u"))
    assert rows.select(once.alias("n")).where(urls.normalize(F.col("n")) != F.col("n")).count() == 0


@pytest.mark.parametrize(("base", "ref", "wanted"), [
    ("http://a.cz/x/y?z=1", "?p=2", "http://a.cz/x/?p=2"), ("http://a.cz/x/y", "z", "http://a.cz/x/z"), ("http://a.cz/x/y", "/z", "http://a.cz/z"),
    ("http://a.cz", "z", "http://a.cz/z"), ("http://a.cz/x", "https://b.cz/", "https://b.cz/"), ("http://a.cz/x", "//b.cz/q", "http://b.cz/q"), ("http://a.cz/x#k", "#top", "http://a.cz/x#top"),
])
def test_resolve(spark, base, ref, wanted):
    row = spark.createDataFrame([(base, ref)], "b string, r string").select(urls.resolve(F.col("b"), F.col("r")).alias("y")).first()
    assert row.y == wanted


def test_parts(spark):
    assert one(spark, urls.full_host, "https://me@A.cz:81/P?q#f") == "http://me@A.cz:81/"
    assert one(spark, urls.file, "https://A.cz:81/P?q#f") == "/P?q"
    assert one(spark, lambda x: urls.join_host(F.lit("http://a.cz/"), x), "/p") == "http://a.cz/p"
    assert one(spark, lambda x: urls.equal_hosts(x, F.lit("http://A.CZ/other")), "http://a.cz:80/x")
    assert not one(spark, lambda x: urls.equal_hosts(x, F.lit("http://a.cz/other"), full=True), "http://a.cz/x")
    assert one(spark, lambda x: urls.equal_hosts(x, F.lit("http://a.cz:80/x"), full=True), "http://a.cz/x#y")


ROBOTS = """# all
User-agent: *
Disallow: /private
Allow: /private/open
Crawl-delay: 0.5
Disallow: /*/secret # star
nonsense

User-agent: Me/1.0
Disallow: /mine
Crawl-delay: junk
User-agent: *
Disallow: /late
Allow: /mine/yours
"""


@pytest.mark.parametrize(("agent", "path", "wanted"), [
    ("X", "/private/x", False), ("X", "/private/open/x", True), ("X", "/a/secret/b", False), ("X", "/secret", True), ("X", "private", False), ("X", "/late", False),
    ("Me/1.0", "/private/x", True), ("Me/1.0", "/mine/x", False), ("Me/1.0", "/mine/yours", True), ("Me/1.0", "/late", True),
])
def test_robots(spark, agent, path, wanted):
    df = spark.createDataFrame([(ROBOTS, path)], "r string, p string").select(robots.policy(F.col("r"), agent).alias("policy"), "p")
    assert df.select(robots.allows(F.col("p"), F.col("policy")).alias("y")).first().y == wanted


def test_robots_delay_and_missing(spark):
    df = spark.createDataFrame([(ROBOTS,), (None,)], "r string").select(robots.policy(F.col("r"), "X").alias("policy"))
    assert sorted(r.y for r in df.select(robots.delay_ms(F.col("policy")).alias("y")).collect()) == [0, 500]
    assert [r.y for r in df.select(F.col("policy.allow_all").alias("y")).collect()] == [False, True]


PAGE = '<html lang=en><head><base href="/b/"><title>T &amp; t</title><script>var a="<a href=no>";</script></head><body><!-- <a href="no"> --><p>one<p>two<br><ul><li>x<li>y</ul><a class=q href=\'z?a=1&amp;b=2\'>k</a><a\nhref="/w">l</a><a href=bare>m</a></body>'


def test_tidy_is_well_formed_and_queried(spark):
    df = spark.createDataFrame([(PAGE,)], "h string").select(html.tidy(F.col("h")).alias("x"))
    row = df.select(
        html.query_text(F.col("x"), "//title").alias("title"), html.query_text_nodes(F.col("x"), "//a/@href").alias("hrefs"), html.query_text_nodes(F.col("x"), "//li/text()").alias("li"),
        html.query_text(F.col("x"), "//a[@class='q']/@href").alias("q"), html.query_text(F.col("x"), "//h1").alias("none"), html.query_text_nodes(F.col("x"), "//script").alias("script"),
    ).first()
    assert (row.title, row.hrefs, row.li, row.q, row.none, row.script) == ("T & t", ["z?a=1&b=2", "/w", "bare"], ["x", "y"], "z?a=1&b=2", None, [])


def test_hrefs_base_charset(spark):
    row = spark.createDataFrame([(PAGE,)], "h string").select(html.hrefs(F.col("h")).alias("a"), html.base_href(F.col("h")).alias("b"), html.charset(F.col("h")).alias("c")).first()
    assert row.a == ["z?a=1&amp;b=2", "/w", "bare"] and row.b == "/b/" and row.c == "UTF-8"
    assert one(spark, html.charset, '<meta http-equiv="Content-Type" content="text/html; charset=iso-8859-2">') == "ISO-8859-2"
    assert one(spark, lambda x: html.charset(x, F.lit("text/html; charset=utf-16")), '<meta charset="x">') == "UTF-16"


def test_bad_html_never_fails():
    for page in (None, "", "<", "</p></p>", "<a<b>", "<p a=1 a:b=2 \x00>x\x01</p>", "&#0;&bogus;<div/><br/>", "<li>" * 50):
        html.ET.fromstring(html.ET.tostring(html.tree(page)))


def test_distinct_keeps_explicit(spark):
    rows = [("s", "uri", "p", "1", "literal", None, None, True), ("s", "uri", "p", "1", "literal", None, None, False), ("s", "uri", "p", "1", "literal", t.XSD + "int", None, True)]
    got = {(r.o_dt, r.inferred) for r in t.distinct(spark.createDataFrame(rows, t.SCHEMA)).collect()}
    assert got == {(None, False), (t.XSD + "int", True)}
