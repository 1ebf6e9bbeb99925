"""URL filters [native]: fixed rules, and a path-template tree judged by smoothed labelled purity, by DataFrame functions alone.

1. A segment of a path is literal for its host and position if at least ``support`` URLs and ``percent`` of those that reach the
   position have it; every other segment is a wildcard ``*``. A trailing run of wildcards is one. What is left is the URL's template.
2. The templates of a host are the paths of a tree, whose nodes count URLs, URLs that end there, and labelled and good ones.
3. Branches of one node whose good share and share of ends don't differ beyond Hoeffding's bound are merged: in the order of
   good shares, a branch joins the one before it if both shares are within ``bound`` * (1/sqrt(n) + 1/sqrt(m)). Unlabelled
   branches stay alone.
4. From the corpus's share of good labels down to the template's last node, purity = (good + ``strength`` * purity above) /
   (labelled + ``strength``), where a node counts the labels that the next node doesn't, so that each label counts once. A template below ``least`` is rejected: few labels move little, so a host or branch needs proof.

Pages are counted before each shuffle; a host has at most 100 / ``percent`` literals a position, so the lists that are gathered
by host or node are bounded whatever the number of its pages. Pages meet their host's literals and their template's verdict by joins that
Spark can split at a hot host.

Defined results: a null URL or one without ``://`` has empty host and path, and the empty template; a segment that is itself ``*`` is a wildcard;
empty segments are skipped. Labels are rows of ``labels`` with the page's id: good means quality 1 and not toxic, rows with nulls
say nothing, and an id with several is good if all its rows are. Repeated pages and pages without an id each keep their row and count each time (a null id
has no label). Without labels nothing but rules blocks. Paths of any length are read whole. Empty tables give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialise

# The contract's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SUPPORT, PERCENT = 5, 5  #: URLs and share of a position's URLs that make a segment literal
STRENGTH, LEAST = 10.0, 0.5  #: labels that the purity above counts for; purity below which a template is rejected
BOUND = 1.3581015157406195  #: sqrt(ln(2 / 0.05) / 2)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, of equal ones the least, and its action; null without one."""
    rule = action = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def literals(urls: DataFrame, support: int = SUPPORT, percent: int = PERCENT) -> DataFrame:
    """(host, known): the literal segments of each host's positions, as ``position/segment``."""
    each = urls.select("host", F.posexplode(segments(F.col("path"))).alias("at", "segment"))
    counted = each.groupBy("host", "at", "segment").agg(F.count("*").alias("n"))
    total = counted.groupBy("host", "at").agg(F.sum("n").alias("total"))
    common = counted.filter(F.col("n") >= support).join(total, ["host", "at"]).filter((F.col("n") * 100 >= F.col("total") * percent) & (F.col("segment") != "*"))
    return common.groupBy("host").agg(F.collect_list(F.concat_ws("/", "at", "segment")).alias("known"))


def template(path: Column, known: Column) -> Column:
    """The segments of a path with wildcards for all that aren't known, a trailing run of them as one."""
    known = F.coalesce(known, F.array().cast("array<string>"))
    own = F.transform(segments(path), lambda s, k: F.when(F.array_contains(known, F.concat_ws("/", k, s)), s).otherwise("*"))
    last = lambda t: F.coalesce(F.array_max(F.transform(t, lambda s, k: F.when(s == "*", 0).otherwise(k + 1))), F.lit(0))
    cut = lambda t: F.concat(F.slice(t, 1, last(t)), F.when(F.size(t) > last(t), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")))
    return F.transform(F.array(own), cut)[0]  # one lambda argument binds the segments


def labelled(labels: DataFrame) -> DataFrame:
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = labels.filter("quality is not null and toxic is not null")
    return labels.select(F.col("doc_id").cast("long").alias("page_id"), good.alias("good")).filter("page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))


def tagged(pages: DataFrame, labels: DataFrame, rules=RULES, support: int = SUPPORT, percent: int = PERCENT) -> DataFrame:
    """Per page: page_id, host, path, rule, action, template (segments), good (null: no label)."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    own = own.join(literals(own, support, percent), "host", "left").withColumn("template", template(F.col("path"), F.col("known")))
    rule, action = matched(F.col("host"), F.col("path"), rules)
    # labels grow with the pages: merged in at every size
    own = own.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), "template")
    return own.join(labelled(labels).hint("merge"), "page_id", "left")


def steps(templates: DataFrame) -> DataFrame:
    """Each template with its nodes, from the root on."""
    k = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.array_join(F.slice("template", F.lit(1), i), "/"))).alias("depth", "node")
    return templates.select("*", k)


def branches(templates: DataFrame, bound: float = BOUND) -> DataFrame:
    """(host, node, labelled, good): the counts of each node with those of the branches it is merged with."""
    above = F.when(F.col("depth") > 0, F.array_join(F.slice("template", F.lit(1), F.col("depth") - 1), "/"))
    own = steps(templates).withColumn("above", above)
    own = own.groupBy("host", "above", "node").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"),
        F.sum(F.when(F.col("depth") == F.size("template"), F.col("n")).otherwise(0)).alias("ends"))
    own = own.withColumn("p", F.when(F.col("labelled") > 0, F.col("good") / F.col("labelled"))).withColumn("e", F.col("ends") / F.col("n"))
    order = W.partitionBy("host", "above").orderBy(F.col("labelled") == 0, "p", "node")
    before = lambda c: F.lag(c).over(order)
    apart = lambda x, n: F.abs(F.col(x) - before(x)) > bound * (1 / F.sqrt(F.col(n)) + 1 / F.sqrt(before(n)))
    new = F.when((F.col("labelled") == 0) | before("n").isNull() | apart("p", "labelled") | apart("e", "n"), 1).otherwise(0)
    runs = own.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    whole = W.partitionBy("host", "above", "run")
    return runs.select("host", "node", F.sum("labelled").over(whole).alias("labelled"), F.sum("good").over(whole).alias("good"))


def purities(tags: DataFrame, bound: float = BOUND, strength: float = STRENGTH) -> DataFrame:
    """(host, template, purity) of every template of ``tags``."""
    templates = tags.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    all_labels = templates.agg(F.sum("labelled").alias("n"), F.sum("good").alias("good")).first()  # one row
    prior = all_labels.good / all_labels.n if all_labels.n else 1.0
    nodes = branches(templates, bound).select("host", "node", F.col("labelled").alias("l"), F.col("good").alias("g"))
    path = steps(templates.select("host", "template")).join(nodes, ["host", "node"])
    path = path.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "l", "g"))).alias("path"))
    rest = lambda x, k, c: x[c] - F.coalesce(F.get("path", k + 1)[c], F.lit(0))
    path = path.withColumn("path", F.transform("path", lambda x, k: F.struct(rest(x, k, "l").alias("l"), rest(x, k, "g").alias("g"))))
    down = F.aggregate("path", F.lit(float(prior)), lambda p, x: (x["g"] + F.lit(strength) * p) / (x["l"] + F.lit(strength)))
    return path.select("host", "template", F.round(down, 9).alias("purity"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, support: int = SUPPORT, percent: int = PERCENT, bound: float = BOUND, strength: float = STRENGTH, least: float = LEAST) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block), template and its purity."""
    tags = materialise(tagged(pages, labels, rules, support, percent))
    judged = tags.join(purities(tags, bound, strength), ["host", "template"])
    verdict = F.coalesce("action", F.when(F.col("purity") < least, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.array_join("template", "/").alias("template"), "purity")


def query(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS own, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM cut
), located AS (
  SELECT row_number() OVER () AS r, page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^?#]*') AS path FROM split
), ruled AS MATERIALIZED (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM located
), each AS (
  SELECT r, host, unnest(segs) AS segment, unnest(range(len(segs))) AS pos FROM ruled
), counted AS (
  SELECT host, pos, segment, count(*) AS n FROM each GROUP BY ALL
), common AS (
  SELECT host, pos, segment FROM counted JOIN (SELECT host, pos, sum(n) AS total FROM counted GROUP BY ALL) USING (host, pos)
  WHERE n >= 5 AND n * 100 >= total * 5 AND segment <> '*'
), marked AS (
  SELECT r, pos, coalesce(c.segment, '*') AS segment, c.segment IS NOT NULL AS lit FROM each LEFT JOIN common c USING (host, pos, segment)
), ends AS (
  SELECT r, max(CASE WHEN lit THEN pos + 1 ELSE 0 END) AS last FROM marked GROUP BY r
), wild AS (
  SELECT r, list(segment ORDER BY pos) AS t FROM marked JOIN ends USING (r) WHERE pos <= last GROUP BY r
), known AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
  WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), tags AS MATERIALIZED (
  SELECT r, page_id, host, path, rule, coalesce(t, []) AS t, good FROM ruled LEFT JOIN wild USING (r) LEFT JOIN known USING (page_id)
), templates AS MATERIALIZED (
  SELECT host, t, count(*) AS n, count(good) AS labelled, coalesce(sum(good), 0) AS good FROM tags GROUP BY host, t
), steps AS MATERIALIZED (
  SELECT host, t, n, labelled, good, unnest(range(len(t) + 1)) AS depth FROM templates
), nodes AS (
  SELECT host, CASE WHEN depth > 0 THEN array_to_string(t[1:depth - 1], '/') END AS above, array_to_string(t[1:depth], '/') AS node,
    sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good, sum(CASE WHEN depth = len(t) THEN n ELSE 0 END) AS ends FROM steps GROUP BY ALL
), shares AS (
  SELECT *, CASE WHEN labelled > 0 THEN good::DOUBLE / labelled END AS p, ends::DOUBLE / n AS e FROM nodes
), lagged AS (
  SELECT *, lag(p) OVER o AS bp, lag(e) OVER o AS be, lag(n) OVER o AS bn, lag(labelled) OVER o AS bl FROM shares
  WINDOW o AS (PARTITION BY host, above ORDER BY labelled = 0, p NULLS FIRST, node)
), fresh AS (
  SELECT *, CASE WHEN labelled = 0 OR bn IS NULL OR abs(p - bp) > 1.3581015157406195 * (1 / sqrt(labelled) + 1 / sqrt(bl))
    OR abs(e - be) > 1.3581015157406195 * (1 / sqrt(n) + 1 / sqrt(bn)) THEN 1 ELSE 0 END AS new FROM lagged
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY host, above ORDER BY labelled = 0, p NULLS FIRST, node) AS run FROM fresh
), merged AS MATERIALIZED (
  SELECT host, node, sum(labelled) OVER w AS l, sum(good) OVER w AS g FROM runs WINDOW w AS (PARTITION BY host, above, run)
), paths AS MATERIALIZED (
  SELECT host, t, depth, l - coalesce(lead(l) OVER o, 0) AS l, g - coalesce(lead(g) OVER o, 0) AS g
  FROM steps s JOIN merged m USING (host) WHERE m.node = array_to_string(t[1:depth], '/') WINDOW o AS (PARTITION BY host, t ORDER BY depth)
), walk AS (
  SELECT host, t, -1::BIGINT AS depth, (SELECT coalesce(sum(good)::DOUBLE / nullif(sum(labelled), 0), 1.0) FROM templates) AS p FROM templates
  UNION ALL
  SELECT k.host, k.t, m.depth, (m.g::DOUBLE + 10.0::DOUBLE * k.p) / (m.l::DOUBLE + 10.0::DOUBLE)
  FROM walk k JOIN paths m ON m.host = k.host AND m.t = k.t AND m.depth = k.depth + 1
), pure AS (
  SELECT host, t, round(p, 9) AS purity FROM walk WHERE depth = len(t)
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END END AS verdict,
  array_to_string(t, '/') AS template, purity
FROM tags JOIN pure USING (host, t)
"""
