"""URL filters with redirect equivalence, in DataFrame operations only.

Rules judge a url by host suffix and path prefix; the longest wins. Pages that redirect (meta refresh) or name a
canonical url are aliases of the target: connected components over these edges carry block decisions to every url of the
component that no rule judges. An explicit allow anywhere in the component takes precedence over its blocks, and a
rule on the url itself over both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .common import Scratch
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Rules = list[tuple[str, str, str]]  # (verdict, host, path)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Of equal rules with different verdicts, allow.
    ``rules`` is a list held by the plan: some thousands at most."""

    def longest(h: Column, p: Column) -> Column:
        out = F.lit(None).cast("struct<rule:string,verdict:string>")
        for verdict, of, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
            fits = ((h == of) | h.endswith(f".{of}")) & p.startswith(begin)
            out = F.when(fits, F.struct(F.lit(of + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
        return out

    return bound(host, lambda h: bound(path, lambda p: longest(h, p)))


def node_of(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case: what links and pages meet by. Null without a host."""
    rest = bound(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), lambda x: F.when(x == "", F.lit("/")).otherwise(x))
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    return bound(host_of(url), lambda host: F.when(host != "", F.concat(scheme, F.lit("://"), host, rest)))


def _without_dots(path: Column) -> Column:
    """A path that starts with /, less its segments . and .. and what the latter take back."""
    up = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
    kept = lambda parts: F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", up(out)).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    # a last segment of dots names a folder
    folder = lambda parts, k: F.element_at(parts, -1).isin(".", "..") & (F.size(k) > 0)
    shown = lambda parts: bound(kept(parts), lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(folder(parts, k), F.lit("/")).otherwise(F.lit(""))))
    return bound(F.slice(F.split(path, "/"), 2, 1 << 30), shown)


def _relative(own: Column, rest: Column, path: Column, query: Column) -> Column:
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    by_path = _without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)))
    return F.when(own == "", F.concat(path, F.when(rest.startswith("?"), rest).otherwise(F.concat(query, rest)))).otherwise(F.concat(by_path, rest))


def resolved(to: Column, url: Column) -> Column:
    """The url that a reference names on the page ``url``: absolute, or relative to its scheme, host, folder or path. Each step
    is bound: a reference is taken apart once, however often its parts are named."""
    site, query = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    full = bound(F.regexp_extract(to, r"(?s)^([^?#]*)", 1), lambda own: bound(path_of(url), lambda path: _relative(own, rest, path, query)))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), to))
        .otherwise(F.concat(site, full))
    )


def links(pages: DataFrame) -> DataFrame:
    """(source, target) of each meta refresh and canonical link, as nodes. Targets are decoded (&amp; and its numbers) and
    resolved against the page's url, or against its first ``base``."""
    html = F.coalesce("html", F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = lambda t: t.rlike(r"""(?is)^<link\b.*?\brel\s*=\s*(?:"[^"]*(?<![^\s"])canonical(?![^\s"])|'[^']*(?<![^\s'])canonical(?![^\s'])|canonical(?![^\s>/]))""")
    refresh = lambda t: t.rlike(r"""(?is)^<meta\b.*?\bhttp-equiv\s*=\s*["']?\s*refresh\b""")
    href = lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    goes = lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>;]+(?:;[^"'\s>;]+)*)""", 1)
    target = lambda t: F.when(canonical(t), href(t)).when(refresh(t), goes(t)).otherwise(F.lit(""))
    base = F.regexp_extract(html, r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    plain = lambda c: F.regexp_replace(c, "(?i)&(?:amp|#38|#x26);", "&")

    def edges(url: Column) -> Column:
        edge = lambda source, at, t: bound(target(t), lambda to: F.when(to != "", F.struct(source.alias("source"), bound(resolved(plain(to), at), node_of).alias("target"))))
        kept = lambda e: e["target"].isNotNull() & (e["source"] != e["target"])
        of = lambda source, at: F.filter(F.transform(tags, lambda t: edge(source, at, t)), kept)
        at = bound(base, lambda b: F.when(b != "", resolved(plain(b), url)).otherwise(url))
        return bound(node_of(url), lambda source: bound(at, lambda a: F.when(source.isNotNull(), of(source, a))))

    return pages.where(html.rlike("(?i)canonical|http-equiv")).select(F.explode(bound(F.col("url"), edges)).alias("e")).select("e.source", "e.target")


def judge(pages: DataFrame, rules: Rules, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url_host, url_path, rule, verdict) as columns page_id, host, path, rule, verdict for each row of ``pages``
    (page_id, url, html). A null url or one without :// has empty host and path, fits no rule, has no aliases and is
    allowed. Null html has no links. Repeated rows are judged alike; other columns are not read; no rows give none."""
    scratch = scratch or Scratch(pages.sparkSession)
    edges = scratch.save(links(pages).distinct(), "links")
    comps = connected_components(edges, scratch)
    ruled = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    verdicts = comps.groupBy("component").agg(F.max(ruled == "allow").alias("allowed"), F.max(ruled == "block").alias("blocked"))
    blocked = comps.join(verdicts.where("blocked AND NOT coalesce(allowed, false)").select("component"), "component").select("node")
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("__node"))
    own = own.withColumn("__own", rule_of(F.col("host"), F.col("path"), rules))
    # pages without a node would all meet in one task; what stands in for it is no url
    own = own.withColumn("__node", F.coalesce("__node", F.concat(F.lit(" "), F.xxhash64("page_id").cast("string"))))
    held = own.join(blocked.select(F.col("node").alias("__alias")).distinct(), F.col("__node") == F.col("__alias"), "left")
    verdict = F.coalesce(F.col("__own.verdict"), F.when(F.col("__alias").isNotNull(), F.lit("block")), F.lit("allow"))
    return held.select("page_id", "host", "path", F.col("__own.rule").alias("rule"), verdict.alias("verdict"))


