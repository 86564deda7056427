"""Column functions over HTML, URLs and numbers; all stay in the JVM."""

from __future__ import annotations

import re
from functools import cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def kept(make):
    """``make``, its columns kept for each connection to Spark: building a large one takes thousands of calls."""

    @cache
    def of(gateway, *args):
        return make(*args)

    return wraps(make)(lambda *args: of(SparkContext._active_spark_context._gateway, *args))


def once(df: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    """``keep`` and the ``made`` columns, each worked out once a row.

    A generator over a one-element array: the optimiser merges plain
    projections, which would repeat costly expressions for every later use.
    """
    cells = F.array(F.struct(*[c.alias(n) for n, c in made.items()]))
    return df.select(*keep, F.inline(cells))


def without_blocks(html: Column) -> Column:
    """HTML without script, style and noscript blocks and comments."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def unescaped(text: Column) -> Column:
    """Common named entities as characters; the ampersand comes last so nothing is unescaped twice."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def visible_text(clean: Column) -> Column:
    """Text between the tags; ``clean`` has no blocks."""
    return unescaped(F.regexp_replace(clean, r"<[^>]*>", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("int")


def title(html: Column) -> Column:
    return collapsed(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>/]")).cast("int")


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1)


def tag_texts(clean: Column, tag: str) -> Column:
    """Texts of all elements of a tag, blank ones dropped; ``clean`` has no blocks."""
    found = F.regexp_extract_all(clean, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: collapsed(unescaped(F.regexp_replace(x, r"<[^>]*>", " ")))), lambda x: x != "")


def links(clean: Column) -> Column:
    """array<struct(href, anchor)> in document order; ``clean`` has no blocks."""
    pattern = r'(?is)<a\b[^>]*?\shref="([^"]*)"[^>]*>(.*?)</a\s*>'
    hrefs = F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
    anchors = F.transform(F.regexp_extract_all(clean, F.lit(pattern), F.lit(2)), lambda x: collapsed(unescaped(F.regexp_replace(x, r"<[^>]*>", " "))))
    return F.zip_with(F.transform(hrefs, unescaped), anchors, lambda h, a: F.struct(h.alias("href"), a.alias("anchor")))


def netloc(url: Column) -> Column:
    """Lower-cased host with its port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def normal_url(url: Column) -> Column:
    """Lower-cased scheme and host, path with default /, query kept, fragment dropped."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), netloc(url), F.when(rest == "", "/").otherwise(rest), query)


def meta_content(html: Column, name: str) -> Column:
    """Content of the last meta element of a name or property; empty if there is none."""
    found = F.regexp_extract_all(html, F.lit(rf"""(?is)<meta\s[^>]*?(?:name|property)="{re.escape(name)}"[^>]*?\scontent="([^"]*)\""""), F.lit(1))
    return F.trim(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))


def mixed_content(html: Column) -> Column:
    """How many scripts, images and links load from plain http."""
    return F.regexp_count(html, F.lit(r"""(?is)<(?:(?:script|style|noscript|img)\b[^>]*?\ssrc|link\b[^>]*?\shref)="http://""")).cast("int")


def without_dots(path: Column) -> Column:
    """A path whose . and .. segments are resolved; .. above the root is dropped."""
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")
    back = lambda a: F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    kept = F.aggregate(segments, none, lambda a, s: F.when(s == ".", a).when(s == "..", back(a)).otherwise(F.concat(a, F.array(s))))
    open_end = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), open_end)).otherwise(path)


def joined_url(base: Column, href: Column) -> Column:
    """href resolved against base, dot segments included, fragment dropped."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    h = F.regexp_replace(href, "#.*$", "")
    folder = F.when(h.startswith("/"), "").when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("?"), F.concat(root, path, h))
        .otherwise(F.concat(root, without_dots(F.concat(folder, F.regexp_replace(h, r"\?.*$", ""))), F.regexp_extract(h, r"(\?.*)$", 1)))
    )


def internal_in_lint(host: Column, href: Column) -> Column:
    """File-mode link class: anything that isn't absolute http counts as internal."""
    absolute = F.lower(href).rlike(r"^https?://")
    return ~absolute | ((host != "") & (netloc(href) == host))


def slug(text: Column, limit: int = 48) -> Column:
    cleaned = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(cleaned, "^-+|-+$", ""), 1, limit)


def domain_key(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(domain)), r"[^A-Za-z0-9.-]", "_")


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def total_occurrences(text: Column, phrases) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + occurrences(text, p)
    return out


def phrase_count(text: Column, phrases) -> Column:
    """Occurrences of all phrases together, in one pass; a phrase that begins a longer one counts beside it. No phrase may overlap itself."""
    longest_first = sorted(phrases, key=lambda p: (-len(p), p))
    first = "".join(sorted({re.escape(p[0]) for p in phrases}))
    found = F.regexp_extract_all(text, F.lit(f"(?=[{first}])(?=({'|'.join(map(re.escape, longest_first))}))"), F.lit(1))
    more = {p: sum(p.startswith(q) for q in phrases) for p in phrases}
    out = F.size(found)
    for p, n in more.items():
        if n > 1:
            out = out + (n - 1) * F.size(F.filter(found, lambda x: x == F.lit(p)))
    return out


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def names_of(mapping: dict) -> Column:
    pairs = [v for k, x in mapping.items() for v in (F.lit(k), F.lit(x))]
    return F.create_map(*pairs)
