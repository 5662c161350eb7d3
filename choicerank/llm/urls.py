"""URL rules whose block decisions follow redirects and canonical links.

Pages name other addresses of themselves: a canonical link, a refresh redirect, outside comments and elements whose
content is no markup. Links are resolved against the page's url by the rules of RFC 3986 (``base`` elements are not read).
These edges, between whole urls without fragments and dot segments, make classes of equivalent urls. A page's own rule
decides first. A page without one is allowed if any url of its class is explicitly allowed, else blocked if one is
blocked, else allowed.

Everything is DataFrame expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import Work
from choicerank.llm.components import components

#: verdict, host, beginning of the path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

Rule = tuple[str, str, str]

# Patterns of tags, links and character references; the SQL of the query uses the same ones, so none looks ahead or back.
NO_MARKUP = "(?is)<!--.*?(?:-->|\\z)" + "".join(
    rf"|<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "textarea", "title", "template", "xmp", "iframe"))
TAG = r"(?is)<(?:link|meta)\s[^>]*>"
IS_ALIAS = (r"""(?is)^<link\s(?:.*\s)?rel\s*=\s*(?:["'](?:[^"'>]*\s)?)?canonical(?:["'\s/>]|$)"""
            r"""|^<meta\s(?:.*\s)?http-equiv\s*=\s*["']?\s*refresh\b""")
HREF = r"""(?is)^<link\s(?:.*?\s)?href\s*=\s*["']?\s*([^"'\s>]*)"""
REFRESH = r"""(?is)^<meta\s(?:.*?\s)?content\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?\s*([^"'\s>]*)"""
#: Named character references of the marks that urls are made of.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "period": ".", "quest": "?",
         "num": "#", "equals": "=", "percnt": "%"}
PIECE = rf"&#[xX]0*[0-9a-fA-F]{{1,6}};?|&#0*[0-9]{{1,7}};?|&(?:{'|'.join(NAMED)});|[^&]+|&"


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule, at: Column, way: Column) -> Column:
    _, name, start = rule
    return ((at == name) | at.endswith(f".{name}")) & way.startswith(start)


def matched(at: Column, way: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; nulls where none does. Of equally long ones the first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = _fits(rule, at, way)
        text = F.when(fits, rule[1] + rule[2]).otherwise(text)
        verdict = F.when(fits, rule[0]).otherwise(verdict)
    return text, verdict


def _decoded(link: Column) -> Column:
    """With numeric and ``NAMED`` character references decoded, once."""
    def piece(part: Column) -> Column:
        code = F.when(part.rlike("^&#[xX]"), F.conv(F.regexp_extract(part, "([0-9a-fA-F]+);?$", 1), 16, 10)).when(
            part.startswith("&#"), F.regexp_extract(part, "([0-9]+)", 1)).cast("bigint")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, mark in NAMED.items():
            out = out.when(part == f"&{name};", mark)
        return out.otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(link, F.lit(PIECE), F.lit(0)), piece), "")


def _absolute(link: Column, base: Column) -> Column:
    """A link as a whole url, dot segments still in it; null for the page itself and for schemes without a host."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?):", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), F.lit(None))
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link.startswith("?"), F.concat(page, link))
            .otherwise(F.concat(folder, F.when(folder == site, "/").otherwise(""), link)))


def _without_dots(way: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    def step(done: Column, segment: Column) -> Column:
        return (F.when(segment == ".", done).when(segment == "..", F.regexp_replace(done, "(?s)/[^/]*$", ""))
                .otherwise(F.concat(done, F.lit("/"), segment)))

    parts = F.split(F.substring(way, 2, 1 << 30), "/")
    end = F.when(way.rlike(r"/\.\.?\z"), "/").otherwise("")
    return F.when(way.contains("/."), F.concat(F.aggregate(parts, F.lit(""), step), end)).otherwise(way)


def plain(url: Column) -> Column:
    """A url without its fragment and dot segments, A-Z of scheme and host lower-cased; null where it has no ``://``."""
    start = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    question = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(
        F.translate(start, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _without_dots(path(url)), question))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url``, ``target``: canonical links and refresh redirects of pages, as plain whole urls."""
    # The filter spares most pages the removal of comments.
    rows = pages.filter(F.col(url).contains("://") & F.col(html).rlike("(?i)canonical|refresh"))
    markup = F.regexp_replace(F.col(html), NO_MARKUP, " ")
    tags = F.filter(F.regexp_extract_all(markup, F.lit(TAG), F.lit(0)), lambda tag: tag.rlike(IS_ALIAS))
    found = rows.select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    link = F.when(F.col("tag").rlike("(?i)^<link"), F.regexp_extract("tag", HREF, 1)).otherwise(
        F.regexp_extract("tag", REFRESH, 1))
    # Generators, so that each step is worked out once for all expressions that use it.
    found = found.filter(link != "").select("url", F.explode(F.array(_decoded(link))).alias("link"))
    found = found.select("url", F.explode(F.array(_absolute(F.col("link"), F.col("url")))).alias("link"))
    return (found.select(plain(F.col("url")).alias("url"), plain(F.col("link")).alias("target"))
            .filter("target is not null and url != target").distinct())


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url",
          html: str = "html") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (of the page's own url, else null), ``verdict``.

    Null urls and urls without ``://`` have empty hosts and paths, no rule and no class: they are allowed. Every row is
    judged, repeated ones each; other columns are not read. Null html has no links.
    """
    work = Work(pages.sparkSession)
    links = work.store(alias_links(pages, url, html), "links")
    rows = pages.select(F.col(key), F.col(url).alias("u"))
    rows = rows.withColumns({"host": host(F.col("u")), "path": path(F.col("u"))})
    text, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "own": verdict, "plain": plain(F.col("u"))})
    groups = components(links, work, "classes", "url", "target")
    name = F.col("node")
    decided = groups.withColumn("said", matched(host(name), path(name), rules)[1])
    # Stars: every url points at its class's smallest one, which speaks for itself.
    heads = groups.select(F.col("component").alias("node"), "component").distinct()
    decided = decided.union(heads.withColumn("said", matched(host(name), path(name), rules)[1]))
    classes = decided.groupBy("component").agg(
        F.bool_or(F.col("said") == "allow").alias("allowed"), F.bool_or(F.col("said") == "block").alias("blocked"))
    members = groups.union(heads).join(classes, "component").select(
        F.col("node").alias("plain"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("inherited"))
    # Only urls of some class are looked up; a very common url meets one row.
    judged = rows.join(members, "plain", "left")
    return judged.select(key, "host", "path", "rule",
                         F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"))
