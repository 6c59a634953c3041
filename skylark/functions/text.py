"""Text, HTML and URL functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import COMPANIES, PROJECTS, TECHNOLOGIES

#: The entities that are decoded, in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def has_any(text: Column, keywords: Sequence[str], lowered: bool = False) -> Column:
    """Whether the lower-cased text contains any keyword, as a substring. ``lowered``: the text is lower-case already,
    so each test is a plain search; else one pattern is used, for the text is then lower-cased once."""
    if not lowered:
        pattern = "|".join(re.escape(k.lower()) for k in keywords) or "(?!)"
        return F.coalesce(F.rlike(F.lower(text), F.lit(pattern)), F.lit(False))
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k.lower()))
    return F.coalesce(out, F.lit(False))


def hit_count(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the lower-cased text contains. A sum of plain tests, not a lambda: a text that is itself
    an expression is then evaluated once for a row."""
    low, out = F.lower(text), F.lit(0)
    for k in keywords:
        out = out + F.when(F.contains(low, F.lit(k)), 1).otherwise(0)
    return out


def replace_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode_entities(text: Column) -> Column:
    return replace_all(text, ENTITIES)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column, limit: int = 500) -> Column:
    """Tags go without a space in their place; entities are decoded; the first ``limit`` characters stay."""
    return F.substring(decode_entities(F.regexp_replace(html, r"<[^>]*>", "")), 1, limit)


def page_title(html: Column, limit: int = 200) -> Column:
    """og:title in either attribute order, else <title>, else empty."""
    n = "{1,%d}" % limit
    found = [
        F.regexp_extract(html, rf"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']{n})["']""", 1),
        F.regexp_extract(html, rf"""(?i)<meta[^>]+content=["']([^"']{n})["'][^>]+property=["']og:title["']""", 1),
        F.regexp_extract(html, rf"(?i)<title[^>]*>([^<]{n})</title>", 1),
    ]
    return F.trim(F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit("")))


def page_text(html: Column, limit: int = 1500) -> Column:
    """The first <main>, else <article>, else everything, as plain text."""
    main = F.when(html.rlike(r"(?is)<main[^>]*>.*?</main>"), F.regexp_extract(html, r"(?is)<main[^>]*>(.*?)</main>", 1))
    article = F.when(html.rlike(r"(?is)<article[^>]*>.*?</article>"), F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1))
    source = F.coalesce(main, article, html)
    for tag in ("script", "style"):
        source = F.regexp_replace(source, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.substring(squeeze(decode_entities(F.regexp_replace(source, r"<[^>]+>", " "))), 1, limit)


def url_path(url: Column) -> Column:
    """The path of an absolute URL; null for anything else."""
    ok = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")
    return F.when(ok, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))


def _segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda x: x != "")


def url_category(url: Column) -> Column:
    """First path segment, or article."""
    return F.coalesce(F.get(_segments(url), F.lit(0)), F.lit("article"))


def url_title(url: Column) -> Column:
    """Last path segment with spaces for hyphens and words capitalised; an invalid URL stays as it is."""
    slug = F.coalesce(F.try_element_at(_segments(url), F.lit(-1)), F.lit(""))
    words = F.transform(F.split(F.replace(slug, F.lit("-"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.when(url_path(url).isNull(), url).otherwise(F.array_join(words, " "))


def has_path_prefix(url: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(url_path(url), F.lit(p))
    return F.coalesce(out, F.lit(False))


def escape_xml(text: Column) -> Column:
    return replace_all(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def escape_cell(text: Column) -> Column:
    """For a cell of a markdown table."""
    return replace_all(text, (("|", "\\|"), ("\n", "<br>")))


def truncated(text: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def neutralize_refs(text: Column) -> Column:
    """A zero-width space breaks repository links and mentions, so that quoting them notifies nobody."""
    text = F.regexp_replace(text, r"https://github\.com/([\w.-]+)/", "https://github.com/​$1/")
    return F.regexp_replace(text, r"@([A-Za-z0-9])", "@​$1")


def extract_keywords(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more, CJK runs included, in order of appearance."""
    clean = F.regexp_replace(F.lower(text), r"[^\w一-鿿㐀-䶿\s-]", " ")
    return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) >= 2))


def entity_type(name: Column, companies: Sequence[str] = COMPANIES, technologies: Sequence[str] = TECHNOLOGIES, projects: Sequence[str] = PROJECTS) -> Column:
    """company (the name itself), else technology, else project (a word within it), else topic_tag."""
    low = F.lower(name)
    return F.when(low.isin(*companies), "company").when(has_any(low, technologies, True), "technology").when(has_any(low, projects, True), "project").otherwise("topic_tag")


def fenced_json(text: Column) -> Column:
    """The body of a ```json fence, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def sanitize_summary(text: Column, heading: str, meta: Sequence[str]) -> Column:
    """From the expected section heading on; without one, from the first line that no meta pattern matches."""
    clean = F.trim(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    at = F.regexp_instr(clean, F.lit(heading))
    lines = F.split(clean, "\n")
    is_meta = lambda line: F.lit(False) | line.rlike("|".join(f"(?:{m})" for m in meta))
    first = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, line: F.struct((s["n"] + F.when(s["on"] & is_meta(line), 1).otherwise(0)).alias("n"), (s["on"] & is_meta(line)).alias("on")))["n"]
    rest = F.array_join(F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0))), "\n")
    return F.trim(F.when(at > 0, clean.substr(at, F.length(clean))).otherwise(rest))
