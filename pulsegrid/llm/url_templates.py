"""URL filters: explicit host and path rules, then a tree of path templates learned for each host.

Level by level, a path segment stays literal only where it is frequent under its parent and the
parent has few distinct ones; all others become a wildcard.  Literal siblings whose labels and whose
share of ending paths don't differ statistically from their siblings' pool are merged.  A template blocks
when its smoothed share of blocked labels is above one half.  Only DataFrame functions are used.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Levels of the tree where a depth is asked for; what lies deeper is one wildcard then.
DEPTH = 4
#: A parent with at least KIDS distinct segments, more than one in SPREAD of its paths, is variable; a literal needs SEEN paths.
KIDS, SPREAD, SEEN = 8, 5, 5
#: Square of the normal deviate beyond which branches differ.
DEVIATE2 = 3.84
#: Blocked share and weight that a template has before its labels, and labels it needs.
PRIOR, WEIGHT, LABELS = 0.25, 4.0, 3
#: Parts over which the pages of one branch are dealt when they meet its decision.
PARTS = 16

Rules = tuple[tuple[str, str], ...]  # (verdict, "host/path")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits; null without one.  A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked last, so it is outermost
        own, slash, prefix = r.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _similar(a: str, n: str, pool_a: str, pool_n: str) -> Column:
    """Whether a of n doesn't differ from the pool's share: a one-sample test of proportions, multiplied out."""
    a, n, p, m = (F.col(x).cast("double") for x in (a, n, pool_a, pool_n))
    return F.pow(a * m - p * n, 2) <= DEVIATE2 * n * p * (m - p)


def templates(urls: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """Adds ``template`` to rows ``(host, path, label, ...)``; label is 1 (block), 0 (allow) or null.

    Without a ``depth`` all levels are learned, as long as some branch has the paths for a literal.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    nodes = urls.withColumn("segments", segments).withColumn("template", F.lit(""))
    nodes = nodes.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int"))
    nodes = materialise(nodes, "urls")
    deepest = nodes.agg(F.max(F.size("segments"))).first()[0] or 0
    done = []
    for level in range(deepest if depth is None else min(deepest, depth)):
        here = nodes.withColumn("segment", F.get("segments", F.lit(level)))
        ends = (F.size("segments") == level + 1).cast("long")
        child = here.where("segment is not null").groupBy("host", "template", "segment").agg(
            F.count("*").alias("n"), F.sum(ends).alias("e"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("b"), F.count("label").alias("l"))
        child = materialise(child, "branches")
        if level >= DEPTH and (child.groupBy("host", "template").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) < SEEN:
            # Branches only get smaller, so no literal can follow on any level.
            nodes = nodes.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.size("segments") - level)))
            break
        parent = child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("paths"))
        parent = parent.where(~((F.col("kids") >= KIDS) & (SPREAD * F.col("kids") >= F.col("paths")))).select("host", "template")
        literal = child.where(F.col("n") >= SEEN).join(parent, ["host", "template"]).withColumn("labelled", F.col("l") > 0)
        pool = literal.groupBy("host", "template", "labelled").agg(*[F.sum(c).alias("p" + c) for c in "nebl"])
        same = _similar("e", "n", "pe", "pn") & (~F.col("labelled") | _similar("b", "l", "pb", "pl"))
        token = F.when(same, F.when(F.col("labelled"), "{l}").otherwise("{u}")).otherwise(F.col("segment"))
        chosen = literal.join(pool, ["host", "template", "labelled"]).select("host", "template", "segment", token.alias("token"))
        chosen = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        after = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("token", F.lit("*"))))
        nodes = here.join(chosen, ["host", "template", "segment", "part"], "left").withColumn("template", after).select(*nodes.columns)
        nodes = materialise(nodes, "level")
        # Paths that end here are not written again.
        done.append(nodes.where(F.size("segments") <= level + 1))
        nodes = nodes.where(F.size("segments") > level + 1)
    nodes = functools.reduce(DataFrame.unionByName, done, nodes)
    if depth is not None:
        nodes = nodes.withColumn("template", F.when(F.size("segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    return nodes.drop("segments")


def judge(urls: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url", label: Column | None = None, depth: int | None = DEPTH) -> DataFrame:
    """``(id, host, path, rule, verdict, template, block_share)`` of every row.

    ``label`` (1 block, 0 allow, null unknown) is an expression over the input's columns; without it
    the verdicts of the rules are the labels.  ``depth`` None learns the tree to its leaves.  Null or malformed URLs have empty host and path and
    no rule; they are allowed.  Null ids and repeated rows stay; no row gives no row.
    """
    host, path = split_url(F.col(url_col))
    own = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (F.lit(None) if label is None else label).cast("int").alias("given"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("ruled", verdict)
    by_rule = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))
    own = own.withColumn("label", F.coalesce("given", by_rule)).drop("given")
    tree = templates(own, depth)
    share = (F.coalesce(F.sum("label"), F.lit(0)) + WEIGHT * PRIOR) / (F.count("label") + WEIGHT)
    pure = tree.groupBy("host", "template").agg(share.alias("block_share"), F.count("label").alias("labels"))
    pure = pure.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    out = tree.join(pure, ["host", "template", "part"])
    learned = F.when((F.col("labels") >= LABELS) & (F.col("block_share") > 0.5), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "block_share")


def judge_sql(rules: Rules, page_table: str = "pages", depth: int = DEPTH) -> str:
    """The same as DuckDB SQL, for comparison."""
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s + p}') THEN " for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])) for h, s, p in [r.partition("/")]]
    ordered = sorted(rules, key=lambda x: (-len(x[1]), x[1]))
    rule = "CASE " + " ".join(f + f"'{r}'" for f, (_, r) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f + f"'{v}'" for f, (v, _) in zip(fits, ordered, strict=True)) + " END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = [f"""WITH rest AS (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM {page_table}),
cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM cut),
level0 AS (SELECT page_id, host, path, rule, ruled, CASE WHEN ruled IS NOT NULL THEN (ruled = 'block')::INT END AS label, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS template FROM ruled)"""]
    similar = lambda a, n, p, m: f"pow({a}::DOUBLE * {m} - {p}::DOUBLE * {n}, 2) <= {DEVIATE2} * {n}::DOUBLE * {p} * ({m} - {p})"
    for k in range(depth):
        out.append(f"""child{k} AS (SELECT host, template, segments[{k + 1}] AS segment, count(*) AS n, sum((len(segments) = {k + 1})::INT) AS e, coalesce(sum(label), 0) AS b, count(label) AS l FROM level{k} WHERE len(segments) > {k} GROUP BY ALL),
parent{k} AS (SELECT host, template FROM child{k} GROUP BY ALL HAVING NOT (count(*) >= {KIDS} AND {SPREAD} * count(*) >= sum(n))),
literal{k} AS (SELECT c.*, l > 0 AS labelled FROM child{k} c JOIN parent{k} USING (host, template) WHERE n >= {SEEN}),
pool{k} AS (SELECT host, template, labelled, sum(n) AS pn, sum(e) AS pe, sum(b) AS pb, sum(l) AS pl FROM literal{k} GROUP BY ALL),
chosen{k} AS (SELECT host, template, segment, CASE WHEN {similar("e", "n", "pe", "pn")} AND (NOT labelled OR {similar("b", "l", "pb", "pl")}) THEN CASE WHEN labelled THEN '{{l}}' ELSE '{{u}}' END ELSE segment END AS token FROM literal{k} JOIN pool{k} USING (host, template, labelled)),
level{k + 1} AS (SELECT page_id, v.host, path, rule, ruled, label, segments, CASE WHEN len(segments) <= {k} THEN v.template ELSE v.template || '/' || coalesce(token, '*') END AS template
  FROM level{k} v LEFT JOIN chosen{k} c ON v.host = c.host AND v.template = c.template AND segments[{k + 1}] = c.segment)""")
    out.append(f"""tree AS (SELECT * REPLACE (CASE WHEN len(segments) > {depth} THEN template || '/**' ELSE template END AS template) FROM level{depth}),
pure AS (SELECT host, template, (coalesce(sum(label), 0) + {WEIGHT * PRIOR}) / (count(label) + {WEIGHT}) AS block_share, count(label) AS labels FROM tree GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN labels >= {LABELS} AND block_share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, block_share::DOUBLE AS block_share
FROM tree JOIN pure USING (host, template)""")
    return ",\n".join(out)
