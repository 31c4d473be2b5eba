import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import codec, text, urls
from quarry.functions.text import porter_stem


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if not isinstance(values[n], list) else 'array<bigint>'}" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("is", "is")])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_words(spark):
    assert one(spark, text.words(F.col("t")), t="The car was in the U.S. car-wash.") == ["the", "car", "was", "in", "the", "u.s", "car", "wash"]
    assert one(spark, text.words(F.col("t")), t=None) == []
    assert one(spark, text.analyse_query(F.col("t"), ["the"]), t="The a cat") == ["cat"]
    assert one(spark, text.analyse_news(F.col("t"), ["the"], {"cats": "cat"}), t="The 'Cats', well-known - U.S. end.") == ["cat", "well-known", "u.s", "end"]
    assert one(spark, text.analyse_page(F.col("t"), ["the"]), t="The hopping cats2 cats") == ["hop", "cat"]
    assert one(spark, text.clean_mail(F.col("t")), t="<b>Win!</b>  $5 <style>x</style>now") == "Win 5 now"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=20, unique=True))
def test_codec_round_trip(spark, ids):
    back = one(spark, codec.from_gaps(codec.vbyte_decode(codec.vbyte_encode(codec.gaps(F.col("v"))))), v=ids)
    assert back == sorted(ids)
    size = one(spark, codec.vbyte_size(F.col("v")), v=ids)
    assert size == sum(max(1, -(-x.bit_length() // 7)) for x in ids)


@pytest.mark.parametrize("url,want", [("HTTP://WWW.Example.com:80//a//b/?q=1#f", "http://example.com/a/b?q=1"), ("https://example.com:8443/", "https://example.com:8443"), ("https://example.com:443/x", "https://example.com/x")])
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


@pytest.mark.parametrize("url,want", [("http://web.archive.org/web/2020/http://a.org/x/?y", "http://a.org/x"), ("http://a.org:8080/x//y/", "http://a.org:8080/x/y"), ("https://A.org:443/#z", "https://A.org")])
def test_canonical_plain(spark, url, want):
    assert one(spark, urls.canonical_plain(F.col("u")), u=url) == want


@pytest.mark.parametrize("link,want", [("c", "http://h/a/c"), ("/c", "http://h/c"), ("//g/c", "http://g/c"), ("?q", "http://h/a/b?q"), ("#f", "http://h/a/b?x#f"), ("../c", "http://h/c"), ("./c", "http://h/a/c"), ("../../../c", "http://h/c"), ("mailto:x", "mailto:x"), ("", "http://h/a/b?x")])
def test_resolve(spark, link, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b="http://h/a/b?x", l=link) == want


@pytest.mark.parametrize("link,want", [("../../../../../x", "http://h/x"), ("../" * 10 + "x", "http://h/x"), ("../../x/./y/../z?a=../b#../c", "http://h/a/b/c/x/z?a=../b#../c"), ("..", "http://h/a/b/c/d/"), (".", "http://h/a/b/c/d/e/"), ("../..", "http://h/a/b/c/"), ("f.g/..h/...", "http://h/a/b/c/d/e/f.g/..h/...")])
def test_dot_segments(spark, link, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b="http://h/a/b/c/d/e/", l=link) == want


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><script>x<y</script></head><body><header>h</header><p>One  two\n three</p><a class=k href='/u'>L<b>1</b></a></body></html>"
    assert one(spark, urls.title(F.col("h")), h=page) == "A & B"
    assert one(spark, urls.title(F.col("h")), h="<p>") == "No title"
    assert "One two three" in one(spark, urls.html_text(F.col("h")), h=page)
    assert one(spark, urls.html_strings(F.col("h")), h=page).startswith("A & B One")
    assert one(spark, urls.html_strings(F.col("h")), h="<p>x") is None
    assert [tuple(x) for x in one(spark, urls.links(F.col("h")), h=page)] == [("/u", "L1")]
    assert one(spark, urls.meta_keywords(F.col("h")), h='<meta name="keywords" content="A, b">') == ["a", "b"]
    assert one(spark, urls.url_keywords(F.col("u")), u="http://h/wiki/Cold_War_(film-one)") == ["Cold", "War", "film", "one"]
    assert one(spark, urls.path_keywords(F.col("u")), u="http://h/a_b/C%20d/") == ["a b", "c d"]


def test_frontier(spark):
    score = urls.frontier_score(F.lit(3), F.lit(2), F.lit(True), F.lit("marx.org"), {"www.marx.org": 10})
    assert one(spark, score, u="x") == 6 + 6 + 50 + 10
    assert one(spark, urls.frontier_priority(F.lit(True), F.lit(2), F.lit(1), F.lit(4)), u="x") == 1 - 2 - 4 - 10000
    assert one(spark, urls.keyword_matches(F.col("u"), ["split", "split", "war"]), u="a split") == 2


def test_codes_of_long_and_odd_arrays(spark):
    """A list of 300,000 values, which the square of its length would not let end; empty and missing ones; ten-byte values."""
    x = spark.createDataFrame([(1, None), (2, []), (3, [7]), (4, [2**62, 3, 2**40]), (5, [-5, 4])], "n int, v array<bigint>")
    x = x.unionByName(spark.range(1).select(F.lit(6).alias("n"), F.sequence(F.lit(3_000_000), F.lit(3), F.lit(-10)).cast("array<bigint>").alias("v")))
    code = codec.vbyte_encode(codec.gaps(F.col("v")))
    got = {r.n: r for r in x.select("n", codec.gaps(F.col("v")).alias("g"), code.alias("c"), codec.from_gaps(codec.vbyte_decode(code)).alias("back"), codec.vbyte_size(codec.gaps(F.col("v"))).alias("s")).collect()}
    assert got[1].g is None and got[1].c is None and got[1].back == []
    assert (got[2].g, got[2].c, got[2].back) == ([], "", []) and (got[3].c, got[3].back) == ("87", [7])
    assert got[4].back == [3, 2**40, 2**62] and got[5].back == [-5, 4] and got[5].g == [-5, 9]
    assert len(got[6].back) == 300_000 and got[6].back == sorted(got[6].back) and got[6].back[0] == 10 and got[6].back[-1] == 3_000_000
    assert all(r.s == len(r.c) // 2 for r in got.values() if r.c is not None)
