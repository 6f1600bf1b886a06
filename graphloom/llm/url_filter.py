"""URL filter with redirect equivalence: block decisions spread over redirect and canonical links.

A page is judged by the longest rule that fits it. Where none fits, the page takes
the decision of its alias class: pages joined by redirects and canonical links are
found as connected components, and a block on any member blocks its unruled aliases,
unless some member is explicitly allowed. Everything here is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, shield, table
from .components import connected_components

#: (verdict, rule); a rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_TAG = r"(?i)<(?:link|meta)[\s/][^>]*>"
#: Character references that are decoded, the ampersand last.
_ENTITIES = (("&(?:quot|#0*34|#[xX]0*22);", '"'), ("&(?:apos|#0*39|#[xX]0*27);", "'"), ("&(?:#0*47|#[xX]0*2[fF]);", "/"), ("&(?:#0*58|#[xX]0*3[aA]);", ":"), ("&(?:lt|#0*60|#[xX]0*3[cC]);", "<"), ("&(?:gt|#0*62|#[xX]0*3[eE]);", ">"), ("&(?:amp|#0*38|#[xX]0*26);", "&"))


def _attribute(name: str) -> str:
    """Matches an attribute of a whole tag; its value is in group 1, 2 or 3, by its quotes."""
    return rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


_REFRESH_URL = r"""(?is)url\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.when(F.locate("://", url) > 0, ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://`` or for null."""
    return F.when(F.locate("://", url) > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.locate("://", url) + 3, F.length(url))


def canonical_url(url: Column) -> Column:
    """The node of a URL in the link graph: host, path and query, without scheme or fragment."""
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The index of the longest rule that fits (ties: the first listed), or null."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1]))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        at, _, rest = rules[i][1].partition("/")
        out = F.when(((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}"), F.lit(i)).otherwise(out)
    return out


def _first_group(text: Column, pattern: str) -> Column:
    """The one of three groups that isn't empty, or an empty string."""
    return F.concat(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])


def link_targets(html: Column) -> Column:
    """Array of the targets that a page names: of canonical links and of refreshing metas, as they stand there, references decoded.

    Attributes are read in any order and quoting, from whole tags outside comments; a rel of
    several words counts. A page may name several; null and empty targets are left out.
    """

    def target(tag: Column) -> Column:
        rel = _first_group(tag, _attribute("rel"))
        link = F.when(rel.rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"), _first_group(tag, _attribute("href")))
        meta = F.when(_first_group(tag, _attribute("http-equiv")).rlike(r"(?i)^\s*refresh\s*$"), _first_group(_first_group(tag, _attribute("content")), _REFRESH_URL))
        out = F.trim(F.coalesce(F.when(tag.rlike(r"(?i)^<link"), link).otherwise(meta), F.lit("")))
        for pattern, sign in _ENTITIES:
            out = F.regexp_replace(out, pattern, sign)
        return out

    tags = F.regexp_extract_all(F.regexp_replace(html, _COMMENT, " "), F.lit(_TAG), F.lit(0))
    return F.filter(F.transform(tags, target), lambda x: x != "")


def resolved(target: Column, base: Column) -> Column:
    """The absolute URL of a link target on the page ``base``; null for schemes without a host, such as mailto."""
    path = path_of(base)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    site = F.concat(F.lit("http://"), host_of(base))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(site, folder, target))
    )


def without_dots(node: Column) -> Column:
    """A URL node without the steps ``.`` and ``..`` in its path."""
    host, path, query = (F.regexp_extract(node, rf"(?s)^{p}", 1) for p in (r"([^/?#]*)", r"[^/?#]*([^?#]*)", r"[^?#]*(.*)$"))
    steps = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    ends = F.element_at(F.split(path, "/"), -1).isin(".", "..")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, step: F.when(step == ".", done).when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, step)))
    plain = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(ends & (F.size(walked) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(host, plain, query)).otherwise(node)


def _target_node(target: Column, base: Column) -> Column:
    """Each step's result is named in many places of the next one, so it is evaluated once."""
    return let(target, lambda t: let(resolved(t, base), lambda u: let(canonical_url(u), without_dots)))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of every page whose HTML names canonical URLs or redirect targets, both as URL nodes.

    Links to the page itself, and those of pages without a host, make no edge.
    """
    # tags are looked for only where a link can be, also by the filter that Spark derives from the explode
    some = F.when(F.col(html).rlike(r"(?i)canonical|refresh"), F.col(html))
    out = pages.select(F.col(url).alias("_base"), F.explode(link_targets(some)).alias("_to"))
    out = out.select(canonical_url(F.col("_base")).alias("src"), _target_node(F.col("_to"), F.col("_base")).alias("dst"))
    return out.where("src is not null and dst is not null and src != dst").distinct()


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (text or null) and verdict.

    edges: (src, dst) URL nodes as ``link_edges`` makes them; None: no aliases. Output
    columns replace input columns of the same name. Pages may repeat: each row is judged.
    Null URLs and URLs without a host have an empty host and path, no rule and no alias,
    and get ``default``. An alias class with an explicit allow and a block leaves its
    unruled members allowed; a page's own rule always stands. Empty input gives no rows.
    """
    texts = F.array(*[F.lit(r) for _, r in rules]) if rules else F.array(F.lit(None).cast("string"))
    says = F.array(*[F.lit(v) for v, _ in rules]) if rules else F.array(F.lit(None).cast("string"))
    out, restored = shield(pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]), url)
    out = out.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("_i", rule_for(F.col("host"), F.col("path"), rules))
    out = out.withColumns({"rule": F.get(texts, F.col("_i")), "_own": F.get(says, F.col("_i"))})
    if edges is None:
        return out.select(*restored, "host", "path", "rule", F.coalesce("_own", F.lit(default)).alias("verdict"))
    classes = connected_components(edges, "src", "dst")
    # only linked URLs carry decisions across; one row per class comes out of the partial aggregate
    node = canonical_url(F.col(url))
    hosts = classes.withColumns({"_h": F.regexp_extract("node", r"^([^/?#]*)", 1), "_p": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)})
    ruled = hosts.withColumn("_v", F.get(says, rule_for(F.col("_h"), F.col("_p"), rules)))
    decided = ruled.groupBy("component").agg(F.max(F.col("_v") == "allow").alias("_allow"), F.max(F.col("_v") == "block").alias("_block"))
    spread = F.when(F.coalesce("_allow", F.lit(False)), F.lit("allow")).when(F.coalesce("_block", F.lit(False)), F.lit("block"))
    aliases = classes.join(decided, "component").select(F.col("node").alias("_node"), spread.alias("_alias"))
    out = out.withColumn("_node", node).join(aliases, "_node", "left")
    return out.select(*restored, "host", "path", "rule", F.coalesce("_own", "_alias", F.lit(default)).alias("verdict"))


def op10_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, RULES, link_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, html, strpos(url, '://') > 0 AS known,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM cut
), tags AS (
  SELECT url, host, path, tail, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', ' ', 'g'), '(?i)<(?:link|meta)[\s/][^>]*>')) AS tag
  FROM (SELECT part.*, pages.url FROM part JOIN pages USING (page_id)) WHERE known
), named_targets AS (
  SELECT url, host, path, tail, CASE WHEN regexp_matches(tag, '(?i)^<link') THEN
      CASE WHEN regexp_matches((regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)), '(?i)(?:^|\s)canonical(?:\s|$)') THEN (regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)) END
    WHEN regexp_matches((regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)), '(?i)^\s*refresh\s*$') THEN (regexp_extract((regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)), '(?is)url\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"'']+))', 1) || regexp_extract((regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)), '(?is)url\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"'']+))', 2) || regexp_extract((regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)), '(?is)url\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"'']+))', 3)) END AS raw
  FROM tags
), targets AS (
  SELECT url, host, path, tail, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw, ' '), '&(?:quot|#0*34|#[xX]0*22);', '"', 'g'), '&(?:apos|#0*39|#[xX]0*27);', '''', 'g'), '&(?:#0*47|#[xX]0*2[fF]);', '/', 'g'), '&(?:#0*58|#[xX]0*3[aA]);', ':', 'g'), '&(?:lt|#0*60|#[xX]0*3[cC]);', '<', 'g'), '&(?:gt|#0*62|#[xX]0*3[eE]);', '>', 'g'), '&(?:amp|#0*38|#[xX]0*26);', '&', 'g') AS t FROM named_targets WHERE raw <> ''
), absolute AS (
  SELECT host || tail AS src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '/') THEN 'http://' || host || t
    WHEN starts_with(t, '?') THEN 'http://' || host || path || t
    WHEN starts_with(t, '#') THEN url
    ELSE 'http://' || host || CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || t END AS u
  FROM targets WHERE t <> ''
), cut_target AS (
  SELECT src, substr(u, strpos(u, '://') + 3) AS r FROM absolute WHERE strpos(u, '://') > 0
), dotted AS (
  SELECT src, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS p, regexp_extract(r, '(?s)^[^?#]*(\?[^#]*)', 1) AS q FROM cut_target
), undotted AS (
  SELECT src, h, q, CASE WHEN regexp_matches(p, '/\.\.?$') THEN p || '/' ELSE p END AS p, 0 AS n FROM dotted
  UNION ALL
  SELECT src, h, q, CASE WHEN contains(p, '/./') THEN replace(p, '/./', '/') WHEN starts_with(p, '/../') THEN substr(p, 4) ELSE regexp_replace(p, '/[^/]*/\.\./', '/') END, n + 1
  FROM undotted WHERE contains(p, '/./') OR contains(p, '/../')
), edge AS (
  SELECT DISTINCT src, h || p || q AS dst FROM undotted WHERE NOT (contains(p, '/./') OR contains(p, '/../')) AND src <> h || p || q
), both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
reach AS (SELECT src AS node, src AS other FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'), ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')) t(says, h, p, rule)),
named AS (SELECT DISTINCT node, regexp_extract(node, '^([^/?#]*)', 1) AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
node_rule AS (SELECT node, arg_max(says, length(rule)) AS says FROM named JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY node),
alias AS (SELECT r.node, CASE WHEN bool_or(says = 'allow') THEN 'allow' WHEN bool_or(says = 'block') THEN 'block' END AS says FROM reach r JOIN node_rule n ON r.other = n.node GROUP BY r.node),
own AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM part JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT part.page_id, part.host, part.path, own.rule, coalesce(own.says, alias.says, 'allow') AS verdict
FROM part LEFT JOIN own USING (page_id) LEFT JOIN alias ON alias.node = part.host || part.tail AND part.known
"""

QUERIES = {"op10_redirect_equivalence": op10_redirect_equivalence}
ORACLES = {"op10_redirect_equivalence": _SQL}
