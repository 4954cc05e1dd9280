"""URL filtering with redirect equivalence.

URLs joined by redirects (``meta refresh``) or canonical links are aliases.
Distributed connected components over those edges spread block decisions: a
URL without a rule of its own is blocked when an alias is blocked by rule,
unless an alias is explicitly allowed.  A URL's own rule always decides.

Rules are a table ``(action, host, path)``.  A rule meets URLs through an
equi-join on host suffixes, so a list of any length works without broadcast of
unknown size; the longest fitting rule wins (equal lengths: allow first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from koine.llm.tables import table
from koine.operators.components import components
from koine.sources.scratch import written

#: Rules of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_REL = r"""(?<![\w-])rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))"""
CANONICAL = rf"""(?is)<link\b(?=[^>]*{_REL})[^>]*(?<![\w-])href\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b)[^>]*(?<![\w-])content\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?\s*([^"'\s>]+)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url_col: str, host: str = "host", path: str = "path") -> DataFrame:
    """Adds host and path of a URL; both are empty without ``://`` or for null."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    lower = F.translate(raw, UPPER, LOWER)
    return df.withColumn(host, F.coalesce(lower, F.lit(""))).withColumn(
        path, F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2), F.lit(""))
    )


def resource(url: Column) -> Column:
    """A URL without scheme and fragment, A-Z of the host in lower case: the node of the alias graph."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1))
    host = F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)
    return F.concat(F.translate(host, UPPER, LOWER), F.substr(rest, F.length(host) + 1))


def without_dots(url: Column) -> Column:
    """An absolute URL with the segments ``.`` and ``..`` of its path resolved."""
    head, path, tail = (F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    parts = F.split(F.substr(path, F.lit(2)), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    # a dot segment at the end leaves its slash
    closed = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(head, F.lit("/"), F.array_join(kept, "/"), closed, tail)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), resolved).otherwise(url)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)`` alias edges that the pages declare: all canonical links and meta refreshes outside comments."""
    html = F.regexp_replace(html_col, COMMENT, "")
    marked = pages.where(F.lower(html_col).rlike("canonical|http-equiv") & F.col(url_col).contains("://"))
    found = F.array_union(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (CANONICAL, REFRESH)])
    each = marked.select(F.col(url_col).alias("_url"), F.explode(found).alias("_to")).where("_to <> ''")
    origin = F.regexp_extract("_url", r"^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract("_url", r"^(.*?:)//", 1)
    folder = F.regexp_extract("_url", r"^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    target = (
        F.when(F.col("_to").contains("://"), F.col("_to"))
        .when(F.col("_to").startswith("//"), F.concat(scheme, F.col("_to")))
        .when(F.col("_to").startswith("/"), F.concat(origin, F.col("_to")))
        .otherwise(F.concat(folder, F.when(~folder.endswith("/"), F.lit("/")).otherwise(F.lit("")), F.col("_to")))
    )
    plain = F.regexp_replace(target, "&(?:amp|#38|#[xX]26);", "&")
    return each.select(F.col("_url").alias("from_url"), without_dots(plain).alias("to_url"))


def judge(urls: DataFrame, rules: DataFrame, key: str, host: str = "host", path: str = "path") -> DataFrame:
    """``(key, rule, action)`` of the longest rule fitting each URL; URLs that no
    rule fits have no row.  Keys must be unique."""
    parts = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = urls.where(F.col(host) != "").select(F.col(key), F.col(path).alias("_path"), F.explode(suffixes).alias("_host"))
    r = rules.where("host is not null and path is not null and action in ('allow', 'block')").select(
        F.translate("host", UPPER, LOWER).alias("_host"), F.col("path").alias("_rule_path"), "action"
    )
    hit = each.join(r, "_host").where(F.col("_path").startswith(F.col("_rule_path")))
    rule = F.concat("_host", "_rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("allow"), rule.alias("rule"), "action"))
    return hit.groupBy(key).agg(best.alias("b")).select(key, F.col("b.rule").alias("rule"), F.col("b.action").alias("action"))


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_root`` for every row of ``pages``.

    ``edges`` (``from_url, to_url``) adds redirects known from elsewhere to
    those in the pages' html.  Null or malformed URLs have empty parts, no rule
    and no aliases and are allowed; null html declares nothing.  Rows with equal
    ids or URLs are judged alike, each once; of rules of one length that fit, an
    allowing one wins.  Whole html is searched, however long, in the task that
    reads it.  Further columns of ``pages`` are ignored, whatever their names; an
    empty table gives an empty result, no rules leave every verdict to aliases.
    """
    known = links(pages, url_col, html_col)
    if edges is not None:
        known = known.unionByName(edges.select("from_url", "to_url"))
    pairs = written(known.select("from_url", "to_url", resource(F.col("from_url")).alias("a"), resource(F.col("to_url")).alias("b")).where("a is not null and b is not null"), "links")
    urls = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")), "_url")
    # one judgement per distinct (host, path), not per page
    places = urls.select("host", "path").distinct().withColumn("_place", F.concat_ws("\u0000", "host", "path"))
    own = judge(places, rules, "_place").withColumnRenamed("action", "_own")
    out = urls.withColumn("_place", F.concat_ws("\u0000", "host", "path")).join(own, "_place", "left")
    if pairs.limit(1).count() == 0:
        decided = out.withColumn("_spread", F.lit(None).cast("string")).withColumn("alias_root", F.lit(None).cast("string"))
    else:
        nodes = components(pairs)
        ends = pairs.select(F.col("from_url").alias("_u"), F.col("a").alias("node")).unionByName(pairs.select(F.col("to_url").alias("_u"), F.col("b").alias("node"))).distinct()
        ends = with_parts(ends, "_u").withColumn("_place", F.concat_ws("\u0000", "host", "path"))
        acts = judge(ends.select("host", "path", "_place").distinct(), rules, "_place").select("_place", "action")
        spread = (
            ends.join(acts, "_place").join(nodes, "node").groupBy("root").agg(F.min("action").alias("_spread"))
        )  # 'allow' < 'block': an explicit allow takes precedence
        by_node = nodes.join(spread, "root", "left").select(F.col("node").alias("_node"), "_spread", F.col("root").alias("alias_root"))
        decided = out.withColumn("_node", resource(F.col("_url"))).join(by_node, "_node", "left")
    verdict = F.coalesce("_own", "_spread", F.lit("allow"))
    return decided.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


#: The registered tables declare no redirects, so only rules decide there; the
#: spread over aliases is tested against a brute-force version.
ORACLE = r"""
WITH r(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS k, page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
b AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
      FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN b USING (k)
"""
