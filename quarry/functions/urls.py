"""URLs and HTML as Column expressions: canonical forms, links, text, titles, keywords and crawl priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def domain(url: Column) -> Column:
    """Host and port as they stand; empty where there is none."""
    return F.regexp_extract(url, _URL, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def is_valid(url: Column) -> Column:
    """Scheme and host are there."""
    return F.coalesce((scheme(url) != "") & (domain(url) != ""), F.lit(False))


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"https?://", "")


def _default_port(scheme_: Column, host: Column) -> Column:
    return F.when(scheme_ == "http", F.regexp_replace(host, ":80$", "")).when(scheme_ == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no leading www., no default port, single slashes, none at the end; query kept."""
    s = scheme(url)
    host = _default_port(s, F.regexp_replace(F.lower(domain(url)), r"^www\.", ""))
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/$", ""), ";[^/]*$", "")
    query = F.regexp_extract(url, _URL, 4)
    return F.concat(s, F.lit("://"), host, p, F.when(query == "?", "").otherwise(query))


def canonical_plain(url: Column) -> Column:
    """Archive copies stand for their originals; no default port, query, fragment or slash at the end; host case kept."""
    archived = F.regexp_extract(url, r"^https?://web\.archive\.org/web/(?:[0-9]+[a-z_]*/)?(.+)$", 1)
    original = F.when(archived == "", url).when(archived.rlike("^https?:"), F.regexp_replace(archived, "^(https?):/+", "$1://")).otherwise(F.concat(F.lit("http://"), archived))
    s = scheme(original)
    p = F.regexp_replace(F.regexp_replace(path(original), "//", "/"), "/+$", "")
    return F.concat(s, F.lit("://"), _default_port(s, domain(original)), p)


def resolve(base: Column, link: Column) -> Column:
    """A link as an absolute URL (RFC 3986: schemes, //host, /path, ?query, #fragment, relative paths, dot segments)."""
    root = F.concat(scheme(base), F.lit("://"), domain(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    no_fragment = F.regexp_replace(base, "#.*$", "")
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .when(link.startswith("#"), F.concat(no_fragment, link))
        .when(link == "", no_fragment)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
    return F.when(joined.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]*\.") & joined.rlike(r"/\.\.?(?:[/?#]|$)"), _without_dots(joined)).otherwise(joined)


def _without_dots(url: Column) -> Column:
    """Dot segments taken out of the path, however many; query and fragment stay."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    segments = F.split(F.substring(path(url), 2, 1 << 30), "/")
    last = F.element_at(segments, -1)
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(part(1), F.lit("://"), part(2), F.lit("/"), F.array_join(kept, "/"), part(4), part(5))


#: Anchors with a quoted href: (tag, href, text).
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def links(html: Column) -> Column:
    """array<struct<href, anchor>> of the anchors in a page, in order."""
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    return F.arrays_zip(F.transform(hrefs, unescape).alias("href"), F.transform(texts, lambda t: squeeze(unescape(strip_tags(t)))).alias("anchor"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<[^>]*>", "")


#: Named characters that HTML text is read with; others stay as they are.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _visible(html: Column, dropped: str) -> Column:
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in dropped.split():
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return html


def html_text(html: Column) -> Column:
    """Text without scripts and styles; lines and double spaces part it, and the parts are joined by one space."""
    plain = unescape(strip_tags(_visible(html, "script style")))
    parts = F.transform(F.split(plain, r"[\r\n]|  "), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def html_strings(html: Column) -> Column:
    """The stripped strings between tags, without scripts, styles and headers, joined by one space; null without a title."""
    parts = F.transform(F.split(_visible(html, "script style header"), r"(?s)<[^>]*>"), lambda x: F.regexp_replace(unescape(x), r"^\s+|\s+$", ""))
    return F.when(F.regexp_extract(html, r"(?is)(<title\b)", 1) != "", F.array_join(F.filter(parts, lambda x: x != ""), " "))


def title(html: Column, missing: str | None = "No title") -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title\s*>"), F.lit(1))
    return F.coalesce(squeeze(unescape(F.get(found, 0))), F.lit(missing))


def meta_keywords(html: Column) -> Column:
    """Lower-case parts of the keywords meta tag; none where there is no such tag."""
    content = F.regexp_extract(html, r"""(?is)<meta\s[^>]*name\s*=\s*["']keywords["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    return F.filter(F.transform(F.split(content, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def title_keywords(html: Column) -> Column:
    return F.filter(F.split(F.lower(title(html, "")), r"\s+"), lambda x: x != "")


def url_keywords(url: Column) -> Column:
    """Words of the last path part: split at _, - and spaces; words in parentheses follow those before them."""
    last = F.element_at(F.split(F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), "/"), -1)
    inside = F.regexp_extract(last, r"\(([^)(]*)\)", 1)
    whole = F.concat(F.regexp_extract(last, r"^([^(]*)", 1), F.lit(" "), inside)
    return F.filter(F.split(F.translate(whole, "_-", "  "), " +"), lambda x: x != "")


def path_keywords(url: Column) -> Column:
    """Every path part, underscores as spaces, lower case."""
    parts = F.split(path(url), "/")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(F.replace(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))))


def listed(text: Column, patterns: list[str]) -> Column:
    """True where the text holds any of the literal patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.contains(p)
    return F.coalesce(out, F.lit(False))


def keyword_matches(text: Column, keywords: list[str]) -> Column:
    """How many keywords (each entry counts, case matters) the text holds."""
    return sum((F.coalesce(text.contains(k), F.lit(False)).cast("int") for k in keywords), F.lit(0))


def relevance(url: Column, anchor: Column, keywords: list[str]) -> Column:
    """How many keywords URL or anchor hold, in any case of letters."""
    either = lambda k: F.coalesce(F.lower(url).contains(k) | F.lower(anchor).contains(k), F.lit(False))
    return sum((either(k).cast("int") for k in keywords), F.lit(0))


def frontier_score(in_links: Column, keywords: Column, is_seed: Column, host: Column, bonus: dict[str, int]) -> Column:
    """2 x in-links + 3 x keyword matches + 50 for seeds + the host's bonus (hosts compared without www.). Higher first."""
    extra = F.lit(0)
    for name, n in bonus.items():
        extra = F.when(F.regexp_replace(host, r"^www\.", "") == name.removeprefix("www."), n).otherwise(extra)
    return in_links * 2 + keywords * 3 + F.when(is_seed, 50).otherwise(0) + extra


def frontier_priority(is_seed: Column, relevance_: Column, wave: Column, in_links: Column) -> Column:
    """Lower first: wave - relevance - in-links, seeds 10000 less."""
    return wave - relevance_ - in_links - F.when(is_seed, 10000).otherwise(0)
