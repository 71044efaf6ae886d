"""URL filter by redirect equivalence.

Every url has a canonical spelling (scheme, fragment, `utm_` parameters, dot segments and trailing slashes dropped; host
in lower case); urls of one spelling are aliases. Edges between spellings come from each `<link rel=canonical>` and
`<meta http-equiv=refresh>` that a page declares, relative targets resolved against the page, and from a table of
redirects. Connected components of this graph are groups of aliases. A url that a rule fits has the rule's verdict.
Another takes its group's: allow if any alias is allowed by a rule, else block if any is blocked by one, else allow.
Rules read the host and path of whole urls, never of spellings: a url inside another's query is no alias of it.
DataFrame functions only.

Null or repeated urls, null html and null ids are kept: a url that is null or has no `://` has an empty host and path,
no alias and the verdict allow. Every input row gives one row; further input columns are not read, an empty table gives
an empty result, and texts of any length are searched whole. Of fitting rules of one length an allowing one wins. Link
targets of other schemes without `//` (mailto:, data:) and pure fragments are no aliases. A spelling that many pages
share is combined before it is shuffled, or split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, table

#: (verdict, host, path) in no order: the longest fitting rule wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """The path with its `.` and `..` segments resolved."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def canonical_key(url: Column) -> Column:
    """host, path and query of the canonical spelling; null without `://`."""
    rest = F.regexp_replace(after_scheme(url), r"(?s)#.*", "")
    path = F.regexp_replace(without_dots(F.regexp_extract(rest, r"\A[^/?]*([^?]*)", 1)), r"/+\z", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"(?s)\?(.*)", 1), r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def declared_links(html: Column, url: Column) -> Column:
    """Targets of the canonical links and refreshes that the page declares, made absolute."""
    tags = lambda name, needed: F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(needed))
    href = F.transform(tags("link", r"(?i)\brel\s*=\s*[\"']?canonical\b"), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    fresh = F.transform(tags("meta", r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), lambda t: F.regexp_extract(t, r"(?i)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    here = F.concat(F.lit("http://"), host_of(url))
    folder = F.when(path_of(url) == "", F.lit("/")).otherwise(F.regexp_extract(path_of(url), r"(?s)\A(.*/)", 1))

    def absolute(t: Column) -> Column:
        return (
            F.when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:|\A#|\A\z"), F.lit(None))
            .when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(t.startswith("/"), F.concat(here, t))
            .when(t.startswith("?"), F.concat(here, path_of(url), t))
            .otherwise(F.concat(here, folder, t))
        )

    links = F.filter(F.transform(F.concat(href, fresh), absolute), lambda t: t.isNotNull())
    return F.when(html.rlike("(?i)canonical|refresh"), F.array_distinct(links))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, allows, rule, verdict) of the longest fitting rule, or null. `rules` is a hand-written Python list."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(v == "allow").alias("allows"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,allows:boolean,rule:string,verdict:string>")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) for each row of `pages` (page_id, url, html).

    redirects: optional (src, dst) urls. component: the smallest spelling of the url's aliases, null where it has none.
    """
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_key(F.col("url")).alias("key"), declared_links(F.col("html"), F.col("url")).alias("links"))
    base = materialise(base.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)), "url-pages")
    pairs = base.where("key is not null and links is not null").select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    if redirects is not None:
        pairs = pairs.union(redirects.select("src", "dst").where(F.instr("src", "://") > 0).where(F.instr("dst", "://") > 0))
    pairs = materialise(pairs.distinct(), "url-links")
    groups = connected_components(pairs.select(canonical_key(F.col("src")).alias("src"), canonical_key(F.col("dst")).alias("dst")))
    groups = materialise(groups.select(F.col("node").alias("key"), "component"), "url-groups")
    # what rules say of urls, also of those that are only ends of links; allow comes before block
    ends = pairs.select(F.col("src").alias("url")).union(pairs.select("dst"))
    said = base.select("key", F.col("own.verdict").alias("v")).union(ends.select(canonical_key(F.col("url")), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]))
    said = said.where("key is not null and v is not null").groupBy("key").agg(F.min("v").alias("v"))
    said = materialise(said.join(groups.hint("merge"), "key", "left"), "url-said")
    spread = said.where("component is not null").groupBy("component").agg(F.min("v").alias("v"))
    decided = groups.join(spread.hint("merge"), "component", "left").select("key", "component", "v").union(said.where("component is null").select("key", F.col("key").alias("component"), "v"))
    out = base.drop("links").join(decided.hint("merge"), "key", "left")
    return out.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "v", F.lit("allow")).alias("verdict"), F.coalesce("component", "key").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL of query(): urls are cut by position instead of by pattern, groups are closed by a recursive table."""
    ranked = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0]))
    fits = lambda h, p: f"('.' || host LIKE '%.{h}' AND starts_with(path, '{p}'))"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(v, h, p)}'" for v, h, p in ranked) + " END"
    return f"""
WITH RECURSIVE tags AS (
  SELECT url, html, list_filter(regexp_extract_all(html, '(?i)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')) AS links,
    list_filter(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')) AS metas
  FROM pages WHERE instr(url, '://') > 0),
raw AS (
  SELECT url, unnest(list_concat(list_transform(links, lambda t: regexp_extract(t, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(metas, lambda t: regexp_extract(t, '(?i)\\bcontent\\s*=\\s*["'']?\\s*[0-9.]*\\s*[;,]\\s*url\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) AS t FROM tags),
cut AS (SELECT u.url, substr(u.url, instr(u.url, '://') + 3) AS rest, u.t FROM raw u),
page AS (SELECT *, split_part(split_part(rest, '#', 1), '?', 1) AS hp FROM cut),
links AS (
  SELECT url AS src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR t = '' OR t[1] = '#' THEN NULL
    WHEN starts_with(t, '//') THEN 'http:' || t WHEN t[1] = '/' THEN 'http://' || split_part(hp, '/', 1) || t
    WHEN t[1] = '?' THEN 'http://' || hp || t
    ELSE 'http://' || CASE WHEN instr(hp, '/') = 0 THEN hp || '/' ELSE hp[: length(hp) - instr(reverse(hp), '/') + 1] END || t END AS dst
  FROM page),
urls AS (SELECT DISTINCT url FROM pages WHERE instr(url, '://') > 0 UNION SELECT dst FROM links WHERE dst IS NOT NULL),
parts AS (
  SELECT url, split_part(substr(url, instr(url, '://') + 3), '#', 1) AS rest FROM urls),
named AS (
  SELECT url, translate(split_part(split_part(rest, '?', 1), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(split_part(rest, '?', 1), length(split_part(split_part(rest, '?', 1), '/', 1)) + 1) AS path,
    CASE WHEN instr(rest, '?') > 0 THEN substr(rest, instr(rest, '?') + 1) ELSE '' END AS q FROM parts),
keyed AS (
  SELECT url, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS own,
    host || rtrim(CASE WHEN regexp_matches(path, '(^|/)[.][.]?(/|$)') THEN array_to_string(list_reduce(list_transform(string_split(path, '/'), lambda x: [x]),
      lambda acc, s: CASE WHEN s[1] = '.' THEN acc WHEN s[1] = '..' THEN acc[: greatest(len(acc) - 1, 1)] ELSE list_concat(acc, s) END), '/') ELSE path END, '/') AS stem,
    regexp_replace(regexp_replace(q, '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q FROM named),
spelled AS (SELECT url, host, path, rule, own, stem || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM keyed),
sym AS (SELECT a.key AS a, b.key AS b FROM links l JOIN spelled a ON a.url = l.src JOIN spelled b ON b.url = l.dst
  UNION SELECT b.key, a.key FROM links l JOIN spelled a ON a.url = l.src JOIN spelled b ON b.url = l.dst UNION SELECT key, key FROM spelled),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
decided AS (SELECT r.a AS key, min(s.own) AS v FROM reach r JOIN spelled s ON s.key = r.b GROUP BY 1)
SELECT p.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, s.rule AS rule, coalesce(s.own, d.v, 'allow') AS verdict
FROM pages p LEFT JOIN spelled s ON p.url = s.url LEFT JOIN decided d ON d.key = s.key
"""
