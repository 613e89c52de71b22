"""Operator 6: line dedup by site-relative frequency, with DataFrame functions only.

A page's lines are what stands between block tags, without scripts, styles,
comments and other tags, trimmed, empty ones left out. A line goes from a page
when the share of its host's pages that hold it is over ``RATIO`` and two pages
hold it at least. Each row counts as a page, repeated rows too; a line counts
once in a page. Lines are told apart by 128-bit hashes.

Pages without a host keep all their lines. Null or empty pages have no lines.
Null and repeated ids pass through; empty tables give empty results; extra
columns are ignored. Pages of any length take time in proportion to it, also
where tags, comments or scripts are not closed.

A line that is boilerplate stands on more than RATIO of its host's pages, so a
host has at most (lines per page / RATIO) of them, whatever its size. They go
to the pages in buckets by hash, so that a line is looked up in one step: by a
broadcast where there are few hosts and the bytes of their lines are few, else
the largest hosts within that bound by a broadcast and the others by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matched, save, small

RATIO = 0.3
MIN_HELD = 2
#: Hosts whose boilerplate may be broadcast.
BROADCAST_HOSTS = 10_000

# What is cut out, what ends a line, what else is a tag, and how entities read.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCKS = r"(?i)</?(?:html|head|body|title|p|br|hr|li|ul|ol|dl|dt|dd|div|h[1-6]|nav|header|footer|main|section|article|aside|table|tr|td|th|form|pre|blockquote)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


# What opens and what closes the parts that are cut out, and characters that no text should have.
OPENERS = ((r"<(?=!--)", r"(?s)^.*-->"), (r"(?i)<(?=script\b)", r"(?is)^.*</script\s*>"), (r"(?i)<(?=style\b)", r"(?is)^.*</style\s*>"))
HIDDEN_BEGINS = r"(?i)<!--|<script\b|<style\b"
#: Places where something is opened that may each cost a search to the end of the page.
FEW_OPENED = 32
STAND_INS = ("\ufdd0", "\ufdd1", "\ufdd2")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _masked(text: Column, opener: str, closed: str, free: Column) -> Column:
    """``text`` with ``free`` in place of the < of what is opened behind the last place where it could be closed."""

    def of(text: Column) -> Column:
        def behind(head: Column) -> Column:
            return F.concat(head, F.regexp_replace(F.substr(text, F.length(head) + 1), F.lit(opener), free))

        return F.when(F.regexp_like(text, F.lit(opener)), _let(F.regexp_extract(text, closed, 0), behind)).otherwise(text)

    return _let(text, of)


def _without_hidden(text: Column) -> Column:
    """``text`` without what HIDDEN says. Where much is opened, what is never closed is masked first, so few searches run to the end in vain; the result is the same."""

    def cut(text: Column, free: Column) -> Column:
        for opener, closed in OPENERS:
            text = _masked(text, opener, closed, free)
        return F.replace(F.regexp_replace(text, HIDDEN, ""), free, F.lit("<"))

    def of(text: Column) -> Column:
        free = F.lit(STAND_INS[-1])
        for c in STAND_INS[:-1]:
            free = F.when(~F.contains(text, F.lit(c)), F.lit(c)).otherwise(free)
        many = F.regexp_count(text, F.lit(HIDDEN_BEGINS)) > FEW_OPENED
        return F.when(many, _let(free, lambda c: cut(text, c))).otherwise(F.regexp_replace(text, HIDDEN, ""))

    return _let(text, of)


def _tags_replaced(text: Column, pattern: str, by: str) -> Column:
    """``text`` with what ``pattern`` says, which ends in >, replaced; it is not looked for behind the last >, where every search would run to the end in vain."""

    def of(text: Column) -> Column:
        def apart(tail: Column) -> Column:
            return F.concat(F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - F.length(tail)), pattern, by), tail)

        return _let(F.substring_index(text, ">", -1), apart)

    return _let(text, of)


def lines(html: Column) -> Column:
    text = _without_hidden(F.coalesce(html, F.lit("")))
    text = _tags_replaced(F.translate(text, "\t\r\x0b\x0c", "    "), BLOCKS, "\n")
    text = _tags_replaced(text, TAGS, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(prepared: DataFrame, hosts: DataFrame, ratio: float = RATIO) -> DataFrame:
    """host, line: hashes of the lines that are boilerplate there; ``prepared`` has host and lines, ``hosts`` host and host_pages."""
    held = prepared.filter("host != ''").select("host", F.explode(F.transform(F.array_distinct("lines"), _hash)).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") >= MIN_HELD).join(small(hosts, hosts.count()), "host").filter(F.col("n") > ratio * F.col("host_pages")).select("host", "line")


def _bucket(line: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(line), n.cast("long")).cast("int")


def by_bucket(common: DataFrame) -> DataFrame:
    """host, buckets: as many as the host has lines, each with the lines whose hash falls there."""
    sizes = common.groupBy("host").agg(F.count("*").alias("n"))
    filled = common.join(sizes, "host").select("host", _bucket(F.col("line"), F.col("n")).alias("bucket"), "line")
    every = sizes.select("host", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("bucket"), F.lit(None).cast("binary").alias("line"))
    each = filled.unionByName(every).groupBy("host", "bucket").agg(F.collect_list("line").alias("held"))
    return each.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("bucket", "held"))).alias("buckets")).select("host", F.col("buckets.held").alias("buckets"))


def line_dedup(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO) -> DataFrame:
    """key, host, host_pages, n_lines, n_dropped, text (lines that stay, joined by newlines)."""
    # pages are taken apart once; the lines are read twice
    prepared = save(pages.select(F.col(key).alias("id"), host(F.col(url)).alias("host"), lines(F.col(html)).alias("lines")), "lines")
    hosts = save(prepared.groupBy("host").agg(F.count("*").alias("host_pages")), "hosts")
    common = save(boilerplate(prepared.select("host", "lines"), hosts, ratio), "boilerplate")
    known = save(hosts.join(by_bucket(common), "host", "left"), "buckets")
    held = F.coalesce(F.aggregate("buckets", F.lit(0).cast("long"), lambda n, x: n + 16 + 40 * F.size(x)), F.lit(0).cast("long"))
    found = matched(prepared, known, "host", "host_pages", "left", BROADCAST_HOSTS, held)

    def stays(line: Column) -> Column:
        h = _hash(line)
        return ~F.array_contains(F.element_at("buckets", _bucket(h, F.size("buckets")) + 1), h)

    kept = F.when(F.col("buckets").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    found = found.select("id", "host", "host_pages", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return found.select(F.col("id").alias(key), "host", "host_pages", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _sql_lines() -> str:
    text = f"regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g')"
    text = f"regexp_replace(translate({text}, chr(9) || chr(13) || chr(11) || chr(12), '    '), '{BLOCKS}', chr(10), 'g')"
    text = f"regexp_replace({text}, '{TAGS}', '', 'g')"
    for entity, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity, char.replace("'", "''"))
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


ORACLE = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host, {_sql_lines()} AS lines FROM pages),
h AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
e AS (SELECT r, page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
c AS (SELECT host, line FROM (SELECT DISTINCT r, host, line FROM e WHERE host <> '') JOIN h USING (host) GROUP BY host, line, host_pages
  HAVING count(*) > {RATIO} * host_pages AND count(*) >= {MIN_HELD}),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM e ANTI JOIN c USING (host, line) GROUP BY r)
SELECT page_id, host, host_pages, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_dropped, length(coalesce(text, '')) AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256
FROM p JOIN h USING (host) LEFT JOIN k USING (r)
"""
