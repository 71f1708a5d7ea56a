"""URL filters: listed rules first, then a tree of path templates for each host.

Everything runs as DataFrame functions. Rules label the URLs that they fit; the tree carries those
labels to the others:

* A segment of a host's paths stays as it is if it is frequent at its place; else it becomes a wildcard.
* Branches of one node whose URLs are labelled and end alike (a chi-squared test) are one branch.
* A merged template is rejected if its labels, smoothed, are pure enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import query, table
from sparktab.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 95 % point of the chi-squared distribution with 5 degrees of freedom (fixed value).
ALIKE = 11.0705


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query (fixed values).
RULES = [
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, or nulls. Of equally long ones the longer host wins."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def segments(path: Column, depth: int) -> Column:
    """The first ``depth`` segments; one ``**`` stands for what lies below them."""
    every = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(path, 2, 1 << 30), "/"))
    return F.when(F.size(every) > depth, F.concat(F.slice(every, 1, depth), F.array(F.lit("**")))).otherwise(every)


def constants(rows: DataFrame, least_count: int, least_part: int) -> DataFrame:
    """(host, held): ``place/segment`` of the segments that stay, at most ``least_part`` for each place of a host."""
    parts = rows.select("host", F.posexplode("segs").alias("place", "seg"))
    counts = parts.groupBy("host", "place", "seg").agg(F.count("*").alias("n"))
    totals = parts.groupBy("host", "place").agg(F.count("*").alias("total"))
    held = (
        counts.where((F.col("n") >= least_count) & ~F.col("seg").isin("*", "**"))
        .join(totals, ["host", "place"])
        .where(F.col("n") * least_part >= F.col("total"))
    )
    return held.groupBy("host").agg(F.collect_list(F.concat_ws("/", "place", "seg")).alias("held"))


def with_template(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows with ``template``: their path with a ``*`` for each segment that doesn't stay."""
    known = F.coalesce("held", F.array().cast("array<string>"))
    part = F.transform(
        "segs",
        lambda s, i: F.concat(
            F.lit("/"),
            F.when((s == "**") | F.array_contains(known, F.concat_ws("/", i.cast("string"), s)), s).otherwise(F.lit("*")),
        ),
    )
    return rows.join(held, "host", "left").withColumn("template", F.array_join(part, "")).drop("held", "segs")


def merged_branches(nodes: DataFrame) -> DataFrame:
    """(host, parent, child, leader) for nodes (host, parent, child, cells).

    The children of a node, largest first, join the first group that they are like, else they begin
    one. A node has few children: one for each frequent segment and the wildcards.
    """
    cell = "struct<leader:string,members:array<string>,cells:array<bigint>,n:bigint>"
    kids = nodes.withColumn("n", F.expr("aggregate(cells, 0L, (s, c) -> s + c)")).groupBy("host", "parent").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "child", "cells", "n"))).alias("kids")
    )
    gap = "double(a) * double(x.n) - double(b) * double(g.n)"
    apart = f"""
        aggregate(zip_with(g.cells, x.cells, (a, b) -> CASE WHEN a + b > 0 THEN ({gap}) * ({gap}) / double(a + b) ELSE 0D END),
            0D, (s, v) -> s + v) / (double(x.n) * double(g.n))"""
    fold = f"""
        aggregate(kids, cast(array() AS array<{cell}>), (groups, x) -> element_at(transform(
          array(array_position(transform(groups, g -> {apart} <= {ALIKE}D), true)), spot -> CASE WHEN spot = 0
            THEN concat(groups, array(cast(struct(x.child, array(x.child), x.cells, x.n) AS {cell})))
            ELSE transform(groups, (g, i) -> CASE WHEN i + 1 = spot
              THEN cast(struct(g.leader, concat(g.members, array(x.child)), zip_with(g.cells, x.cells, (a, b) -> a + b), g.n + x.n) AS {cell})
              ELSE g END) END), 1))"""
    groups = kids.select("host", "parent", F.explode(F.expr(fold)).alias("g"))
    return groups.select("host", "parent", F.col("g.leader").alias("leader"), F.explode("g.members").alias("child"))


def judged_templates(stats: DataFrame, prior: int, reject: int) -> DataFrame:
    """(host, template, n_labelled, n_blocked, rejected) for stats (host, template, blocked, allowed, free).

    A template is rejected if (blocked + prior / 2) / (labelled + prior) reaches ``reject`` percent over its merged branches.
    """
    steps = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substr(template, 2)"), "/"))
    paths = stats.withColumn("steps", steps)
    walk = paths.select(
        "host", "template", "blocked", "allowed", "free", F.posexplode("steps").alias("i", "child"),
        F.size("steps").alias("deep"), "steps",
    ).withColumn("parent", F.expr("array_join(slice(steps, 1, i), '/')")).withColumn("parent", F.concat_ws(":", "i", "parent"))
    last = F.col("i") + 1 == F.col("deep")
    cells = [F.sum(F.when(end, F.col(c)).otherwise(0)) for end in (last, ~last) for c in ("blocked", "allowed", "free")]
    nodes = walk.groupBy("host", "parent", "child").agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    leaders = merged_branches(nodes.select("host", "parent", "child", F.array(*[f"c{i}" for i in range(6)]).alias("cells")))
    named = (
        walk.join(leaders, ["host", "parent", "child"])
        .groupBy("host", "template")
        .agg(F.expr("array_join(transform(sort_array(collect_list(struct(i, leader))), s -> s.leader), '/')").alias("merged"))
    )
    kept = stats.join(named, ["host", "template"], "left").withColumn("merged", F.coalesce(F.concat(F.lit("/"), "merged"), F.lit("")))
    sums = kept.groupBy("host", "merged").agg(F.sum("blocked").alias("n_blocked"), F.sum(F.col("blocked") + F.col("allowed")).alias("n_labelled"))
    rejected = 100 * (2 * F.col("n_blocked") + prior) >= 2 * reject * (F.col("n_labelled") + prior)
    return kept.join(sums, ["host", "merged"]).select("host", "template", "n_labelled", "n_blocked", rejected.alias("rejected"))


def judge_urls(
    df: DataFrame, id_col: str, url_col: str, rules: list[Rule],
    depth: int = 12, least_count: int = 5, least_part: int = 100, prior: int = 4, reject: int = 75,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, n_labelled, n_blocked), one row for each row of ``df``.

    Where a rule fits, its verdict holds. All others are judged by their template: a segment stays if
    at least ``least_count`` URLs and one in ``least_part`` of those with a segment there have it; templates
    are ``depth`` segments deep, with ``**`` for what is below. ``prior`` is the weight of an even prior
    and ``reject`` the percentage of smoothed purity from which a template is blocked, so a template without
    labels is allowed. ``rules`` is a short list and becomes part of the plan.

    A null URL, or one without ``://``, has empty host and path; all such rows share one template without
    labels. Null ids and repeated rows are kept as they are; only the two named columns are read, so the
    names of others don't matter; an empty table gives no rows. Long URLs are read whole.

    Each host's frequent segments and templates are few; they are counted map-side, and joined to the rows
    by host and by template, where adaptive execution broadcasts them if measured small and splits a hot host if not.
    """
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), segments(F.col("path"), depth).alias("segs"))
    held = materialize(constants(rows, least_count, least_part), "segments")
    shaped = with_template(rows, held)
    is_ = lambda c: F.sum(c.cast("long"))
    stats = shaped.groupBy("host", "template").agg(
        is_(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("blocked"),
        is_(F.coalesce(F.col("verdict") == "allow", F.lit(False))).alias("allowed"),
        is_(F.col("verdict").isNull()).alias("free"),
    )
    judged = materialize(judged_templates(materialize(stats, "templates"), prior, reject), "judged")
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return shaped.join(judged, ["host", "template"], "left").select(
        "id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "n_labelled", "n_blocked"
    )


@query(
    "op13_urls",
    """
    WITH RECURSIVE u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
    v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said,
        CASE WHEN path = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(substr(path, 2), '/') END AS whole, row_number() OVER () AS id FROM r),
    g AS (SELECT *, CASE WHEN len(whole) > 12 THEN list_append(whole[1:12], '**') ELSE whole END AS segs FROM v),
    e AS (SELECT id, host, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM g),
    c AS (SELECT host, i, seg, count(*) AS n FROM e GROUP BY ALL),
    k AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, i) AS total FROM c) WHERE n >= 5 AND n * 100 >= total AND seg NOT IN ('*', '**')),
    t AS (SELECT e.id, list(CASE WHEN e.seg = '**' OR k.seg IS NOT NULL THEN e.seg ELSE '*' END ORDER BY e.i) AS steps
        FROM e LEFT JOIN k ON e.host = k.host AND e.i = k.i AND e.seg = k.seg GROUP BY e.id),
    w AS (SELECT g.*, coalesce(t.steps, CAST([] AS VARCHAR[])) AS steps FROM g LEFT JOIN t USING (id)),
    s AS (SELECT host, steps, count(*) FILTER (said = 'block') AS blocked, count(*) FILTER (said = 'allow') AS allowed,
        count(*) FILTER (said IS NULL) AS free FROM w GROUP BY ALL),
    x AS (SELECT host, steps, steps[:i - 1] AS parent, steps[i] AS child, i, i = len(steps) AS last, blocked, allowed, free
        FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM s)),
    nodes AS (SELECT host, parent, child, [CAST(coalesce(sum(blocked) FILTER (last), 0) AS BIGINT), CAST(coalesce(sum(allowed) FILTER (last), 0) AS BIGINT),
        CAST(coalesce(sum(free) FILTER (last), 0) AS BIGINT), CAST(coalesce(sum(blocked) FILTER (NOT last), 0) AS BIGINT),
        CAST(coalesce(sum(allowed) FILTER (NOT last), 0) AS BIGINT), CAST(coalesce(sum(free) FILTER (NOT last), 0) AS BIGINT)] AS cells FROM x GROUP BY ALL),
    kids AS (SELECT host, parent, list({'child': child, 'cells': cells, 'n': list_sum(cells)} ORDER BY list_sum(cells) DESC, child) AS kids FROM nodes GROUP BY ALL),
    f AS (SELECT host, parent, kids, 1 AS step, [{'leader': kids[1].child, 'members': [kids[1].child], 'cells': kids[1].cells}] AS groups FROM kids
        UNION ALL SELECT host, parent, kids, step + 1, CASE WHEN spot IS NULL
            THEN list_append(groups, {'leader': y.child, 'members': [y.child], 'cells': y.cells})
            ELSE list_transform(groups, lambda p, i: CASE WHEN i = spot
                THEN {'leader': p.leader, 'members': list_append(p.members, y.child), 'cells': list_transform(list_zip(p.cells, y.cells), lambda z: z[1] + z[2])}
                ELSE p END) END
        FROM (SELECT *, list_position(list_transform(groups, lambda p: list_sum(list_transform(list_zip(p.cells, y.cells), lambda z:
                CASE WHEN z[1] + z[2] > 0 THEN (CAST(z[1] AS DOUBLE) * CAST(y.n AS DOUBLE) - CAST(z[2] AS DOUBLE) * CAST(list_sum(p.cells) AS DOUBLE))
                  * (CAST(z[1] AS DOUBLE) * CAST(y.n AS DOUBLE) - CAST(z[2] AS DOUBLE) * CAST(list_sum(p.cells) AS DOUBLE)) / CAST(z[1] + z[2] AS DOUBLE)
                ELSE 0.0 END)) / (CAST(y.n AS DOUBLE) * CAST(list_sum(p.cells) AS DOUBLE)) <= 11.0705), true) AS spot
            FROM (SELECT *, kids[step + 1] AS y FROM f WHERE step < len(kids)))),
    l AS (SELECT host, parent, p.leader AS leader, unnest(p.members) AS child
        FROM (SELECT host, parent, unnest(groups) AS p FROM f WHERE step = len(kids))),
    m AS (SELECT x.host, x.steps, list(l.leader ORDER BY x.i) AS merged FROM x JOIN l ON x.host = l.host AND x.parent = l.parent AND x.child = l.child GROUP BY ALL),
    q AS (SELECT s.*, coalesce(m.merged, CAST([] AS VARCHAR[])) AS merged FROM s LEFT JOIN m ON s.host = m.host AND s.steps = m.steps),
    j AS (SELECT host, steps, CAST(sum(blocked) OVER p AS BIGINT) AS n_blocked, CAST(sum(blocked + allowed) OVER p AS BIGINT) AS n_labelled
        FROM q WINDOW p AS (PARTITION BY host, merged))
    SELECT w.page_id, w.host, w.path, w.rule,
      coalesce(w.said, CASE WHEN 100 * (2 * j.n_blocked + 4) >= 150 * (j.n_labelled + 4) THEN 'block' ELSE 'allow' END) AS verdict,
      CASE WHEN len(w.steps) = 0 THEN '' ELSE '/' || array_to_string(w.steps, '/') END AS template, j.n_labelled, j.n_blocked
    FROM w JOIN j ON w.host = j.host AND w.steps = j.steps""",
)
def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", RULES).withColumnRenamed("id", "page_id")
