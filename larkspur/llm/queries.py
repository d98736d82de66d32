"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, html_blocks, langid, license_scan, mixing, pii, quality, simhash, toxicity, url_rules
from larkspur.llm.common import fold, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold() != 0))
    got = toxicity.score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extraction_report(read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = langid.train(docs.where(fold() != 0))
    got = langid.identify(docs.select("doc_id", "text"), filters)
    return got.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_html_text, op3_decontamination, op4_simhash, op5_url_rules, op6_licenses, op7_mixing, op8_quality, op9_language, op10_personal_data)
}

_NODE = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
_HOST = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _attribute(name: str) -> str:
    """The value of an element's attribute, with the references decoded that a URL is likely to hold."""
    raw = " || ".join(f"""regexp_extract(e, {_quoted(rf"(?i)[\s\"'/]{name}{url_rules._VALUE}")}, {i})""" for i in (1, 2, 3))
    return f"trim(replace(replace(replace({raw}, '&#38;', '&'), '&#x26;', '&'), '&amp;', '&'))"


#: Resolved against the page's url: an absolute target, one without scheme, a path from the root, a query, a path from the page's folder.
_PATH = "CASE WHEN starts_with(target, '/') THEN regexp_extract(target, '^[^?#]*') WHEN regexp_matches(target, '^[?#]') THEN path ELSE regexp_extract(path, '^.*/') || regexp_extract(target, '^[^?#]*') END"
_TIDY = "list_reduce(list_filter(string_split({0}, '/')[2:], lambda x: x <> '.'), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, '') || CASE WHEN regexp_matches({0}, '/[.][.]?$') THEN '/' ELSE '' END"

#: Aliases are followed over at most all edges; rules come first, then what a component shares. Base elements and rarer references are left to the tests.
ORACLE_SQL: dict[str, str] = {
    "op5_url_rules": f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html, {_HOST.format("coalesce(url, '')")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (SELECT page_id, host, path, html, CASE WHEN contains(url, '://') THEN host || {_NODE.format("url")} END AS node,
             {url_rules.rule_sql("host", "path")} AS rule, {url_rules.rule_sql("host", "path", what="action")} AS action FROM p),
elements AS (
  SELECT host, path, node, unnest(regexp_extract_all(regexp_replace(html, {_quoted(url_rules._ASIDE)}, '', 'g'), {_quoted(url_rules._ELEMENT)})) AS e
  FROM r WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
found AS (
  SELECT host, path, node, {_attribute("href")} AS target FROM elements
  WHERE lower(e[2:5]) = 'link' AND list_contains(regexp_split_to_array(lower({_attribute("rel")}), '\\s+'), 'canonical')
  UNION ALL
  SELECT host, path, node, trim(regexp_extract({_attribute("content")}, {_quoted(url_rules._TARGET)}, 1)) FROM elements
  WHERE lower(e[2:5]) = 'meta' AND lower({_attribute("http-equiv")}) = 'refresh'),
absolute AS (
  SELECT node AS a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                         WHEN starts_with(target, '//') THEN 'http:' || target
                         ELSE 'http://' || host || CASE WHEN regexp_matches(target, '^#') THEN {_NODE.format("'x://' || node")} WHEN regexp_matches(target, '^[?]') THEN path || target
                              ELSE {_TIDY.format(f"({_PATH})")} || regexp_extract(target, '[?#].*$') END END AS target
  FROM found WHERE target <> ''),
linked AS (SELECT a, {_HOST.format("target")} || {_NODE.format("target")} AS b FROM absolute WHERE target IS NOT NULL),
edges AS (SELECT a, b FROM linked WHERE a <> b UNION SELECT b, a FROM linked WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other),
judged AS (SELECT node, regexp_extract(other, '^[^/?#]*') AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
shared AS (
  SELECT node, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS shared
  FROM (SELECT node, {url_rules.rule_sql("host", "path", what="action")} AS action FROM judged) GROUP BY node)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.action, shared.shared, 'allow') AS verdict,
       CASE WHEN r.action IS NOT NULL THEN 'rule' WHEN shared.shared IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM r LEFT JOIN shared ON shared.node = r.node""",
}
