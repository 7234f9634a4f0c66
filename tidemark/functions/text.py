"""String Column builders of the feed: cleaning, URLs, ids, numbers, formats."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that feeds use most, for the SQL that states the same result; ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
# What marks a page or an entry as visual.
VISUAL_TAGS = ("img", "figure", "table", "svg", "picture", "canvas")
CHART_WORDS = ("chart", "figure", "exhibit", "graph", "table", "heatmap", "infographic")
NOT_CONTENT_IMAGES = ("logo", "icon", "avatar", "sprite")


#: All named references that end in a semicolon, from the standard library's table.
NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}


def unescape(s: Column) -> Column:
    """Character references decoded, each once: by number, or by name as far as there is one."""
    parts = F.regexp_extract_all(s, F.lit(r"(?s)(&#?[0-9A-Za-z]+;|&|[^&]+)"), F.lit(1))
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def point(digits: Column, base: int) -> Column:
        # beyond the last code point, and halves of a pair, stay as they are
        n = F.conv(digits, base, 10).cast("long")
        ok = (F.length(digits) <= 8) & n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(x: Column) -> Column:
        body = F.substring(x, 2, 1_000_000).substr(F.lit(1), F.length(x) - 2)
        decimal, hexadecimal = F.regexp_extract(x, r"^&#([0-9]+);$", 1), F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        number = F.when(decimal != "", point(decimal, 10)).when(hexadecimal != "", point(hexadecimal, 16))
        return F.when(x.startswith("&") & x.endswith(";") & (F.length(x) > 2), F.coalesce(number, F.try_element_at(names, body), x)).otherwise(x)

    return F.when(s.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(s)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[\s ]+", " "))


def clean_text(s: Column, limit: int = 0) -> Column:
    """Without tags, entities decoded, white space collapsed, an ellipsis after ``limit`` characters."""
    out = collapse(unescape(F.regexp_replace(F.coalesce(s, F.lit("")), "<[^>]+>", "")))
    return F.when(F.length(out) > limit, F.concat(F.left(out, F.lit(limit)), F.lit("…"))).otherwise(out) if limit else out


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no query, fragment or trailing slash."""
    u = F.trim(url)
    head = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    path = F.regexp_extract(F.substr(u, F.length(head) + 1), "^[^?#]*", 0)
    return F.concat(F.lower(head), F.regexp_replace(path, "/+$", ""))


def item_id(link: Column, title: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the normalised link, or of the title in lower case where there is none."""
    key = F.coalesce(F.nullif(normalize_url(link), F.lit("")), F.lower(F.trim(title)), F.lit(""))
    return F.substring(F.sha1(key), 1, 16)


def first_present(*columns: Column) -> Column:
    """First value that isn't null or empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def first_number(*columns: Column) -> Column:
    """First value that reads as a number, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit("")).try_cast("double") for c in columns], F.lit(0.0))


def market_cap(s: Column) -> Column:
    """'$1,234' as 1234.0; null for what is no number."""
    return F.translate(s, "$,", "").try_cast("double")


def percent(x: Column) -> Column:
    """'+1.5%'; 'n/a' where missing. Rounded as printf does: the exact value of the double, ties to the even digit.

    ``format_string`` rounds the shortest decimal that reads as the double, halves up. Digits of a number
    beyond the 17th are zeros.
    """
    y = x.cast("double") * 100
    number = F.translate(F.format_number(y, 1), ",", "")
    text = F.when(F.isnan(y), "nan").when(y == float("inf"), "inf").when(y == float("-inf"), "-inf").otherwise(number)
    return F.when(x.isNull(), "n/a").otherwise(F.concat(F.when(text.startswith("-"), "").otherwise("+"), text, F.lit("%")))


def has_visual(html: Column) -> Column:
    return F.coalesce(F.lower(html).rlike("<(" + "|".join(VISUAL_TAGS) + r")[\s/>]"), F.lit(False))


def article_body(html: Column) -> Column:
    """What lies inside of ``article``, else ``main``, else all."""
    inner = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}[\s>](.*?)</{tag}>", 1)
    return F.coalesce(F.nullif(inner("article"), F.lit("")), F.nullif(inner("main"), F.lit("")), html)


def page_is_visual(html: Column, chart_words: tuple[str, ...] = CHART_WORDS, head: int = 4000) -> Column:
    """A content image, a figure, table or drawing in the body, or a chart word in the head of its text."""
    body = article_body(html)
    images = F.regexp_extract_all(body, F.lit(r"(?is)(<img[\s/][^>]*>|<img>)"), 1)
    content = F.exists(images, lambda i: ~F.lower(i).rlike("|".join(NOT_CONTENT_IMAGES)))
    words = F.left(collapse(unescape(F.regexp_replace(body, "<[^>]+>", " "))), F.lit(head)).rlike(r"(?i)\b(" + "|".join(chart_words) + r")\b")
    return F.coalesce(content | F.lower(body).rlike(r"<(figure|table|svg)[\s/>]") | words, F.lit(False))
