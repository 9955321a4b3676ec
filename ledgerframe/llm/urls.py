"""URL rules that also hold for a page's aliases: addresses that redirect to it or name it as canonical, and the other way round.

Aliases are the connected components of the redirect and canonical-link edges found in the pages. A page that a rule fits keeps
that verdict. Any other page is allowed if an alias is explicitly allowed, else blocked if an alias is blocked, else allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, action: str, name: str) -> Rule:
        host, slash, path = name.partition("/")
        return cls(action, host, slash + path)


RULES = (Rule.of("block", "net/"), Rule.of("allow", "example.net/en/"), Rule.of("block", "example.com/de/"), Rule.of("allow", "org/fr/"))


def _after(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule's name, or null. Of equally long rules an allowing one comes first."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.action == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def _node(url: Column) -> Column:
    """An address without scheme and fragment: what aliases are compared by."""
    rest = _after(url)
    return F.concat(host_of(url), F.regexp_replace(F.regexp_replace(rest, "^[^/?#]*", ""), "#[\\s\\S]*$", ""))


def alias_edges(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): addresses of pages and what they redirect to (http-equiv refresh) or name as canonical (link rel).

    Each step is written: the next one names its columns many times, and the optimiser would nest the expressions.
    """
    tags = F.regexp_extract_all("html", F.lit("(?i)<(?:link|meta)\\b[^>]*>"), F.lit(0))
    tags = pages.where(F.lower("html").rlike("canonical|refresh")).select("url", F.explode(tags).alias("tag"))
    low = F.lower("tag")
    canonical = low.rlike("^<link") & low.rlike("\\brel\\s*=\\s*[\"']?canonical\\b")
    refresh = low.rlike("^<meta") & low.rlike("http-equiv\\s*=\\s*[\"']?refresh\\b")
    target = F.when(canonical, F.regexp_extract("tag", "(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)).when(refresh, F.regexp_extract("tag", "(?i)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)", 1))
    found = scratch.write(tags.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _node(F.col("url")).alias("u"), target.alias("target")), "targets")
    found = found.where("target <> '' and u is not null")
    target, base = F.col("target"), F.concat(F.lit("http://"), F.col("host"))
    absolute = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("#"), F.lit(None))
        .otherwise(F.concat(base, F.regexp_replace("path", "[^/]*$", ""), target))
    )
    found = scratch.write(found.select("u", absolute.alias("to")), "absolute")
    return scratch.write(found.select("u", _node(F.col("to")).alias("v")), "edges")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    host and path are empty for a null url or one without ``://``; no rule fits these and they have no alias. A null html has no
    edges, very long pages are read whole. Rows that repeat stand for themselves. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    pages = pages.select("page_id", "url", "html")
    scratch = Scratch(pages.sparkSession, "urls")
    edges = alias_edges(pages, scratch)
    actions = {r.name: r.action for r in rules}
    parts = connected_components(edges, scratch).toDF("node", "component")
    # an address's own rule, of pages and of addresses known from links alone
    address = F.concat(F.lit("http://"), F.col("node"))
    own = scratch.write(parts.select("component", host_of(address).alias("host"), path_of(address).alias("path")), "aliases")
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allows, blocks = ([n for n, a in actions.items() if a == x] for x in ("allow", "block"))
    has = lambda names: F.max(F.coalesce(F.col("rule").isin(names), F.lit(False)))
    inherited = own.groupBy("component").agg(has(allows).alias("allowed"), has(blocks).alias("blocked"))
    inherited = parts.join(inherited.where("blocked and not allowed").select("component"), "component").select("node", F.lit("block").alias("alias"))
    # written: the rules name host and path many times, and the optimiser would parse the address anew for each
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _node(F.col("url")).alias("node"))
    rows = scratch.write(rows, "parsed")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(inherited, "node", "left")
    verdict = F.when(F.col("rule").isin(allows), "allow").when(F.col("rule").isin(blocks), "block").otherwise(F.coalesce("alias", F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


_TAIL = "substr(url, strpos(url, '://') + 3)"
#: The same verdicts in DuckDB.
ORACLE = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN {_TAIL} END AS rest FROM pages),
q AS (SELECT page_id, html, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
n AS (SELECT *, host || regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '(?s)#.*$', '') AS node FROM q),
t AS (SELECT host, path, node, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM n WHERE regexp_matches(lower(html), 'canonical|refresh') AND node IS NOT NULL),
g AS (SELECT host, path, node, CASE WHEN regexp_matches(lower(tag), '^<link') AND regexp_matches(lower(tag), '\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(lower(tag), '^<meta') AND regexp_matches(lower(tag), 'http-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS target FROM t),
a AS (SELECT node AS u, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN 'http://' || host || target
  WHEN starts_with(target, '#') THEN NULL ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || target END AS url FROM g WHERE target <> ''),
b AS (SELECT u, {_TAIL} AS rest FROM a WHERE url IS NOT NULL),
e AS (SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') || regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '(?s)#.*$', '') AS v FROM b),
s AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
r AS (SELECT u, u AS v FROM s UNION SELECT r.u, s.v FROM r JOIN s ON s.u = r.v),
k AS (SELECT u, v, regexp_extract(v, '^[^/?#]*') AS host, regexp_extract(v, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
w AS (SELECT *, FALSE AS page FROM (SELECT u AS key, host, path FROM k) UNION ALL SELECT CAST(page_id AS VARCHAR), host, path, TRUE FROM n),
m AS (SELECT key, page, CASE WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM w),
i AS (SELECT key FROM m WHERE NOT page GROUP BY key HAVING bool_or(rule IN ('net/', 'example.com/de/')) AND NOT bool_or(coalesce(rule IN ('example.net/en/', 'org/fr/'), FALSE)))
SELECT n.page_id, n.host, n.path, m.rule, CASE WHEN m.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN m.rule IS NOT NULL OR n.node IN (SELECT key FROM i) THEN 'block' ELSE 'allow' END AS verdict
FROM n JOIN (SELECT DISTINCT key, rule FROM m WHERE page) m ON m.key = CAST(n.page_id AS VARCHAR)
"""
