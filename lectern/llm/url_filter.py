"""URL filters whose decisions spread over redirects and canonical links."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column_of, records, ship, slices, tidied
from lectern.llm.components import connected_components
from lectern.llm.markup import RAW, attributes, tags

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = pa.schema([("url", pa.string()), ("base", pa.string()), ("href", pa.string())])
#: What a refresh names behind its seconds.
TURN = re.compile(r"""[^;,]*[;,]\s*url\s*=\s*["']?\s*([^"']*)""", re.I | re.S)
#: A page without scripts is one that a crawler sees, so what stands in noscript counts.
SILENT = RAW - {"noscript"}


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question or number sign; A-Z lowered; '' if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its "." and ".." segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") | (F.size(kept) == 1), "/").otherwise(""))
    return F.when(path.contains("/."), whole).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL without scheme, fragment and dot segments, the name under which its links meet."""
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(without_dots(path)), query))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (action, host, path) that fits, as a struct of rule and action; else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules are
    part of the expression, so a list of over a thousand is refused.
    """
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def references(html: str) -> tuple[str | None, list[str]]:
    """The base that a page names, if any, and the canonical links and refresh redirects it holds, as written."""
    base, found = None, []
    for name, rest in tags(html, SILENT):
        if name == "base" and base is None:
            base = attributes(rest).get("href")
        elif name == "link" and "canonical" in (a := attributes(rest)).get("rel", "").lower().split():
            found.append(a.get("href", ""))
        elif name == "meta" and (a := attributes(rest)).get("http-equiv", "").strip().lower() == "refresh" and (m := TURN.match(a.get("content", ""))):
            found.append(m[1])
    clean = lambda r: re.sub(r"[\t\n\f\r]", "", r).strip(" ")
    return None if base is None else clean(base), [c for r in found if (c := clean(r))]


def resolved(href: Column, url: Column) -> Column:
    """The absolute URL that a reference on a page means; null where that is no URL with a host.

    A scheme counts at the start only, so ``/go?u=http://x/`` is a path of the page's host.
    """
    origin, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, F.regexp_replace(path, r"[^/]*$", ""), href))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of the canonical links and refresh redirects in ``pages`` (url, html), as nodes.

    References are resolved against the base that a page names, else its url.
    """

    @tidied
    def read(batches):
        for batch in batches:
            for rows, texts in slices(batch, "html", 4_000_000):
                made = [(u, base, h) for u, t in zip(column_of(rows, "url").to_pylist(), texts, strict=True) for base, found in [references(t)] for h in found]
                yield records([[m[k] for m in made] for k in range(3)], FOUND)

    url = F.col("url")
    marked = pages.where(url.isNotNull() & F.col("html").isNotNull() & F.col("html").rlike(r"(?i)<link\b|http-equiv")).select("url", "html")
    found = marked.mapInArrow(read, "url string, base string, href string")
    base = F.coalesce(F.when(F.col("base") != "", resolved(F.col("base"), url)), url)
    edges = found.select(node_of(url).alias("src"), node_of(resolved(F.col("href"), base)).alias("dst"))
    return edges.where("src is not null and dst is not null and src <> dst").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Verdicts on the urls of ``pages`` (page_id, url, html).

    Returns page_id, host, path, rule, verdict, component. A url that a rule names has the
    rule's verdict, so an explicit allow is never overruled. Any other is blocked if what it
    is equivalent to - whatever redirects and canonical links join it to, in any number of
    steps, crawled or not - holds a url that a rule blocks, and allowed else. Null urls and
    urls without :// have an empty host and path and are allowed; a null html has no link;
    repeated rows stay; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    ship(pages.sparkSession)
    edges = link_edges(pages.select("url", "html"))
    labelled = connected_components(edges)
    as_url = F.concat(F.lit("http://"), F.col("node"))
    own = rule_for(host_of(as_url), path_of(as_url), rules)
    seen = labelled.withColumn("blocked", F.coalesce(own["action"] == "block", F.lit(False)))
    bad = seen.groupBy("component").agg(F.max("blocked").alias("blocked"))
    spread = seen.select("node", "component").join(bad, "component")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    # a url without a node goes under one of many keys that no node has, as nodes do not begin with a slash
    rows = rows.withColumn("node", F.coalesce("node", F.concat(F.lit("/"), F.pmod(F.xxhash64("page_id"), F.lit(4096)).cast("string"))))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules)).join(spread, "node", "left")
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", method).alias("verdict"), "component")
