"""URL filters: explicit host and path rules, and block decisions that spread over redirects and canonical links.

Pages that redirect to one another or name one another as canonical are aliases. Aliases
form the connected components of a graph over normalised URLs; a component with a blocked
page and no explicitly allowed one is blocked as a whole. A page's own rule always wins.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import spread_join, staged
from larkspur.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    """allow or block a host with its subdomains, for paths that start with path."""

    action: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

# What is no markup, and the elements and attributes that name an alias.
_ASIDE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_ELEMENT = r"(?is)<(?:link|meta|base)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TARGET = r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"']*)"
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_ASCII)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path and query: what stays of a URL without scheme and fragment; null without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def ruling(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, action) of the longest fitting rule, null if none fits; of equal rules the first counts."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules: keep them in a table and join on host suffixes")
    fits = [
        F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(len(str(r))).alias("n"), F.lit(-i).alias("i"), F.lit(str(r)).alias("rule"), F.lit(r.action).alias("action")))
        for i, r in enumerate(rules)
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,i:int,rule:string,action:string>")


_aside, _element, _target = (re.compile(x) for x in (_ASIDE, _ELEMENT, _TARGET))
_attribute = {n: re.compile(rf"(?i)[\s\"'/]{n}{_VALUE}") for n in ("rel", "href", "http-equiv", "content")}


def _value(element: str, name: str) -> str:
    m = _attribute[name].search(element)
    return entities.unescape(m[1] or m[2] or m[3] or "").strip() if m else ""


def alias_targets(url: str | None, page: str | None) -> list[str]:
    """Absolute URLs that a page names as its canonical form or sends its readers to, all of them, in order.

    References are decoded; targets are resolved against the page's base element, else its url.
    Comments and scripts don't count.
    """
    if not page or not url or "://" not in url:
        return []
    base, out = url, []
    for m in _element.finditer(_aside.sub("", page)):
        kind = m[0][1:5].lower()
        if kind == "base":
            base = _resolved(url, _value(m[0], "href")) if base == url else base
            continue
        if kind == "link":
            to = _value(m[0], "href") if "canonical" in _value(m[0], "rel").lower().split() else ""
        else:
            found = _target.match(_value(m[0], "content")) if _value(m[0], "http-equiv").lower() == "refresh" else None
            to = found[1].strip() if found else ""
        if to:
            out.append(_resolved(base, to))
    return [x for x in out if "://" in x]


def _resolved(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:  # no URL
        return ""


def alias_edges(pages: DataFrame, redirects: DataFrame | None, *, url_col: str, html_col: str) -> DataFrame:
    """(a, b) as nodes: canonical links, refresh redirects and, if given, rows of redirects(from_url, to_url)."""
    named = pages.where(F.col(f"`{html_col}`").rlike("(?i)canonical|refresh")).select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches):
        for b in batches:
            pairs = [(u, t) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in alias_targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], type=pa.string()), pa.array([t for _, t in pairs], type=pa.string())], names=["url", "target"])

    edges = named.mapInArrow(run, "url string, target string").select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    return edges.where("a is not null and b is not null and a <> b").distinct()


def judge_urls(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and by (rule, alias or default).

    Null urls and urls without `://` have an empty host and path, no rule and no aliases. Rows
    that repeat a url share its node. A component with an allow rule on any member is never blocked.
    Null and empty html names no alias; an empty table gives an empty result; other columns do not matter.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("r", ruling(F.col("host"), F.col("path"), rules))
    edges = staged(alias_edges(pages, redirects, url_col=url_col, html_col=html_col), "aliases")
    own = rows.select("page_id", "host", "path", "node", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
    if edges.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"), F.when(F.col("action").isNotNull(), "rule").otherwise("default").alias("by"))
    # decisions are made on nodes; a component, and a url that many rows repeat, may hold any share of the rows
    parts = staged(connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    linked = parts.withColumn("host", F.regexp_extract("node", r"^[^/?#]*", 0)).withColumn("path", F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1))
    linked = linked.withColumn("action", ruling(F.col("host"), F.col("path"), rules)["action"])
    verdicts = linked.groupBy("component").agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"), F.count("*").alias("nodes"))
    spread = verdicts.select("component", F.when(F.coalesce("allowed", F.lit(False)), F.lit("allow")).when(F.coalesce("blocked", F.lit(False)), F.lit("block")).alias("shared"), "nodes").where("shared is not null")
    known = spread_join(parts, staged(spread, "verdicts"), "component", "nodes").select("node", "shared")
    own = staged(own, "judged")
    known = staged(known.join(own.groupBy("node").agg(F.count("*").alias("rows")), "node"), "known")
    joined = spread_join(own, known, "node", "rows", how="left")
    by = F.when(F.col("action").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("default")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("action", "shared", F.lit(default)).alias("verdict"), by.alias("by"))


def rule_sql(host: str, path: str, rules: tuple[Rule, ...] = RULES, what: str = "rule") -> str:
    """The same ruling as a SQL CASE expression over column names host and path."""
    ordered = sorted(enumerate(rules), key=lambda x: (-len(str(x[1])), x[0]))
    lines = [f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{str(r) if what == 'rule' else r.action}'" for _, r in ordered]
    return reduce(lambda a, b: f"{a} {b}", ["CASE", *lines, "END"])
