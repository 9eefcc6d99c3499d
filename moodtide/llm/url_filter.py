r"""op8: url rules, and block decisions that follow redirects and canonical links.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's; the
longest host, then the longest path wins, and an allow before a block of the same length. A url that no rule fits takes
the verdict of its aliases: urls form a graph whose edges are a page's canonical links and refresh redirects, all of them; in a
connected component with an explicit allow all others are allowed, else with a block they are blocked. What
has neither is allowed. Urls are nodes by host, path and query: scheme and fragment don't count.

Only DataFrame functions run. Rules are a literal list of the caller's (their number is bounded by it). Null urls and urls without ``://`` have an empty
host and path, fit no rule, and are nodes of no edge. A null html has no link. Links without a scheme are taken
relative to the page's host. Repeated pages are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common

#: Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), F.coalesce(query, F.lit(""))))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule (host and path) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ranked = sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r[2] == "allow"))
    for h, p, v in ranked:  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


#: Patterns of one tag's text, each of which is read once from its start; SQL takes the same.
_CANONICAL, _HREF = r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH, _CONTENT, _URL = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\bcontent\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"']+)", r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)"


def links(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) between the nodes of pages(url, html).

    A page is cut at each ``<``, and a tag ends at the first ``>`` or ``<``: patterns see one tag at a time, so that work is linear in the page.
    """
    tags = F.filter(F.split("html", "<", -1), lambda x: F.lower(F.substring(x, 1, 4)).isin("link", "meta"))
    tag = pages.select("url", F.explode(F.transform(tags, lambda x: F.substring_index(x, ">", 1))).alias("tag"))
    href = F.regexp_extract("tag", _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("tag", _CONTENT, 1), _URL, 1)
    kind = F.when(F.col("tag").rlike(r"(?i)^link\b") & F.col("tag").rlike(_CANONICAL), href).when(F.col("tag").rlike(r"(?i)^meta\b") & F.col("tag").rlike(_REFRESH), refresh)
    out = tag.select("url", kind.alias("to")).where("to <> ''")
    to = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    to = F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(scheme, to)).otherwise(F.concat(scheme, F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1), to))
    return out.select(node_of(F.col("url")).alias("src"), node_of(to).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def url_verdicts(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of pages(page_id, url, html); edges (src, dst) of a crawl's redirects may be added."""
    found = links(pages)
    if edges is not None:
        found = found.union(edges.select(node_of(F.col("src")), node_of(F.col("dst"))).where("src IS NOT NULL AND dst IS NOT NULL")).distinct()
    component = common.connected_components(found, python=False)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = base.select("page_id", "host", "path", node_of(F.col("url")).alias("node"), name.alias("rule"), verdict.alias("own"))
    # aliases that are pages of no row here have decisions too: a node's host and path are its own
    url = F.concat(F.lit("x://"), F.col("node"))
    of_node = component.select("component", rule_for(host_of(url), path_of(url), rules)[1].alias("v"))
    # a page of an allowed component stays allowed: 'allow' sorts before 'block'
    decided = of_node.where("v IS NOT NULL").groupBy("component").agg(F.min("v").alias("alias"))
    alias = component.join(decided, "component").select("node", "alias")
    # pages without a node have keys of their own, so that they don't meet in one task
    judged = judged.withColumn("node", F.coalesce("node", F.concat(F.lit("\x00"), F.col("page_id").cast("string"))))
    return judged.join(alias, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"))


def op8_redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(common.table(spark, sf_dir, "pages"))


_HOST = "translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node_sql(u: str) -> str:
    h, p = _HOST.format(u), _PATH.format(u)
    return f"CASE WHEN {h} <> '' THEN {h} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1), '') END"


def _rule_sql(h: str, p: str, what: str) -> str:
    ranked = sorted(RULES, key=lambda r: (len(r[0]), len(r[1]), r[2] == "allow"), reverse=True)
    return "CASE " + " ".join(f"WHEN ({h} = '{a}' OR ends_with({h}, '.{a}')) AND starts_with({p}, '{b}') THEN '{a + b if what == 'rule' else v}'" for a, b, v in ranked) + " END"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TO = "replace(t, '&amp;', '&')"
_BASE = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)"
ORACLE = f"""
WITH RECURSIVE tags AS (SELECT url, split_part(x, '>', 1) AS tag FROM (SELECT url, unnest(string_split(html, '<')) AS x FROM pages) WHERE lower(substr(x, 1, 4)) IN ('link', 'meta')),
found AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)^link\\b') AND regexp_matches(tag, {_sql(_CANONICAL)}) THEN regexp_extract(tag, {_sql(_HREF)}, 1)
  WHEN regexp_matches(tag, '(?i)^meta\\b') AND regexp_matches(tag, {_sql(_REFRESH)}) THEN regexp_extract(regexp_extract(tag, {_sql(_CONTENT)}, 1), {_sql(_URL)}, 1) END AS t FROM tags),
targets AS (SELECT url, {_TO} AS t FROM found WHERE coalesce(t, '') <> ''),
full_targets AS (SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN {_BASE} || t ELSE {_BASE} || regexp_extract({_PATH.format('url')}, '(?s)^(.*/)', 1) || t END AS t FROM targets),
e AS (SELECT {_node_sql('url')} AS x, {_node_sql('t')} AS y FROM full_targets),
b AS (SELECT x, y FROM e WHERE x IS NOT NULL AND y IS NOT NULL UNION SELECT y, x FROM e WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT x AS node, x AS o FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.o),
alias AS (SELECT node, min({_rule_sql(_HOST.format("('x://' || o)"), _PATH.format("('x://' || o)"), 'verdict')}) AS v FROM r GROUP BY 1),
j AS (SELECT page_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_node_sql('url')} AS node FROM pages)
SELECT page_id, host, path, {_rule_sql('host', 'path', 'rule')} AS rule, coalesce({_rule_sql('host', 'path', 'verdict')}, v, 'allow') AS verdict FROM j LEFT JOIN alias USING (node)
"""
