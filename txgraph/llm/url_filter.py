"""Operator 3, URL filters: path rules, then trust and distrust along the host graph.

Every url is judged by the longest rule that fits it. Urls that no rule fits get the
verdict of their host, from two personalised PageRanks over host edges: trust starts at
hosts with pages that a rule allows and flows along links; distrust starts at hosts with
pages that a rule blocks and flows against links (who links to bad hosts is suspect). A
host is blocked where ``den`` times its distrust exceeds ``num`` times its trust.

Host edges are the absolute and protocol-relative links in the pages, counted per pair of
hosts, and one edge each way between a page's host and its nearest parent domain (of two
labels or more) that is a page's host itself, as the hosts of one site vouch for each other.
A suffix under which strangers register (``co.uk``) has no pages and so connects nobody; one
that has pages is kept out by naming it in ``suffixes``.

Ranks are pushed until they settle: what arrives at a host adds to its rank and waits there;
a host passes ``damping_pct`` per cent of what waits on, by weight, whenever that is more than
``1/SETTLED`` of its rank. Rounds end when no host has that much left, so no flow between
hosts is off by more than that share, however long its way. Ranks are integers, ``UNIT`` per seed
page with divisions rounded down: the result does not depend on the order of summation, what
waits dwindles to nothing, and a page's mass ends where it is thinner than ``1/UNIT``.

DataFrame functions only. Every round is a written table, ranks meet the written edges by
plain joins that Spark plans from their sizes (a hub's edges are dealt by the adaptive skew
split); the driver learns one number a round, of hosts that have mass to pass on.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule
and is allowed; null html has no links; every row gives a row, repeated rows and null ids
included; an empty table gives no rows; texts of any length are read whole. Only the three
named columns are read, others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgraph.llm.common import cut, lower_ascii
from txgraph.operators.skew import heavy_keys, split_join
from txgraph.operators.written import write

UNIT = 100_000_000
# A host passes on what waits there when it exceeds this part of its rank.
SETTLED = 1000
#: (verdict, host, start of the path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_HREF = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as the rules see them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return lower_ascii(raw), path


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long rules a
    blocking one wins."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1]))
    rule = verdict = None
    for v, h, p in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)) if verdict is None else F.when(fits, F.lit(v)).otherwise(verdict)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def kin_edges(hosts: DataFrame, suffixes=()) -> DataFrame:
    """(a, b): each host beside its nearest parent domain among the hosts, of two labels or more."""
    parts = F.split("host", r"\.")
    above = (hosts.withColumn("parts", parts).filter(F.size("parts") > 2)
             .select(F.col("host").alias("a"), F.posexplode(F.transform(
                 F.sequence(F.lit(2), F.size("parts") - 1),
                 lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))).alias("up", "b"))
             .filter(~F.col("b").isin(*suffixes) if suffixes else F.lit(True)))
    return (above.join(hosts.select(F.col("host").alias("b")), "b")
            .groupBy("a").agg(F.min_by("b", "up").alias("b")))


def host_edges(pages: DataFrame, suffixes=()) -> DataFrame:
    """(src, dst, w) between different hosts, from (host, html)."""
    links = (pages.select(F.col("host").alias("src"),
                          F.explode(F.array_distinct(F.transform(
                              F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)),
                              lower_ascii))).alias("dst"))
             .filter((F.col("src") != "") & (F.col("dst") != F.col("src")))
             .groupBy("src", "dst").agg(F.count("*").alias("w")))
    hosts = cut(pages.select("host").filter(F.col("host") != "").distinct(), "host-names")
    kin = cut(kin_edges(hosts, suffixes), "host-kin")
    one = F.lit(1).cast("bigint").alias("w")
    return (links.unionByName(kin.select(F.col("a").alias("src"), F.col("b").alias("dst"), one))
            .unionByName(kin.select(F.col("b").alias("src"), F.col("a").alias("dst"), one))
            .groupBy("src", "dst").agg(F.sum("w").alias("w")))


def propagate(edges: DataFrame, seeds: DataFrame, damping_pct: int) -> DataFrame:
    """(host, trust, distrust) when settled, from written edges and seeds (host, trust, distrust)."""
    flow = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"),
                         F.col("dst").alias("b"), "w")
            .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"),
                                      F.col("src").alias("b"), "w"))
            .withColumn("node", F.concat_ws("|", "kind", "a")))
    flow = cut(flow.join(cut(flow.groupBy("node").agg(F.sum("w").alias("out")), "host-out"), "node")
               .select("node", F.concat_ws("|", "kind", "b").alias("to"), "w", "out"), "host-flow")
    active = F.expr(f"waits > rank div {SETTLED}")
    start = (seeds.select(F.explode(F.array(
                 F.struct(F.concat_ws("|", F.lit("trust"), "host").alias("node"), F.col("trust").alias("rank")),
                 F.struct(F.concat_ws("|", F.lit("distrust"), "host").alias("node"),
                          F.col("distrust").alias("rank")))).alias("s"))
             .select("s.node", "s.rank", F.col("s.rank").alias("waits")).filter(F.col("rank") > 0))
    state, left = write(start, count=active)
    while left:
        moved = (flow.join(state.filter(active).select("node", "waits"), "node").select(
            F.col("to").alias("node"),
            F.expr(f"(cast(waits as decimal(20,0)) * cast(w as decimal(15,0)) * {damping_pct}) "
                   "div (cast(out as decimal(15,0)) * 100)").alias("rank"))
            .filter(F.col("rank") > 0).withColumn("waits", F.col("rank")))
        kept = state.select("node", "rank", F.when(active, F.lit(0).cast("bigint"))
                            .otherwise(F.col("waits")).alias("waits"))
        state, left = write(kept.unionByName(moved).groupBy("node").agg(
            F.sum("rank").alias("rank"), F.sum("waits").alias("waits")), count=active)
    cols = F.split("node", r"\|", 2)
    return (state.select(cols[0].alias("kind"), cols[1].alias("host"), "rank")
            .groupBy("host").agg(
                F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0)).alias("trust"),
                F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0)).alias("distrust")))


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", damping_pct: int = 85,
               num: int = 1, den: int = 1, suffixes=()) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row."""
    host, path = url_parts(F.col(url_col).cast("string"))
    src = pages.select(F.col(id_col), host.alias("host"), path.alias("path"),
                       F.col(html_col).cast("string").alias("html"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = (src.drop("html").withColumn("rule", rule).withColumn("ruled", verdict))
    seeds = cut(judged.filter(F.col("host") != "").groupBy("host").agg(
        F.count("*").alias("n"),
        (F.count(F.when(F.col("ruled") == "allow", 1)) * UNIT).alias("trust"),
        (F.count(F.when(F.col("ruled") == "block", 1)) * UNIT).alias("distrust")), "host-pages")
    ranks = propagate(cut(host_edges(src, suffixes), "host-edges"), seeds, damping_pct)
    hot = heavy_keys(seeds, "host", "n")
    out = split_join(judged, cut(ranks, "host-verdicts"), "host", hot, how="left")
    zero = F.lit(0).cast("bigint")
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    own = F.when(distrust * den > trust * num, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", "rule",
                      F.coalesce("ruled", own).alias("verdict"),
                      trust.alias("trust"), distrust.alias("distrust"))


def oracle(damping_pct: int = 85, rules=RULES) -> str:
    """DuckDB SQL of the query, its rounds as a recursive query."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1]))
    fits = [(v, h, p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')")
            for v, h, p in order]
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return f"""
WITH RECURSIVE a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0
                  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS MATERIALIZED (
  SELECT page_id, html, {low("raw")} AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
j AS MATERIALIZED (
  SELECT page_id, host, path,
    CASE {" ".join(f"WHEN {c} THEN '{h}{q}'" for v, h, q, c in fits)} END AS rule,
    CASE {" ".join(f"WHEN {c} THEN '{v}'" for v, h, q, c in fits)} END AS ruled FROM p),
links AS MATERIALIZED (
  SELECT src, dst, count(*) AS w FROM (
    SELECT host AS src, unnest(list_distinct([{low("x")} FOR x IN
      regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s<>]+)', 1)])) AS dst
    FROM p) WHERE src <> '' AND src <> dst GROUP BY ALL),
names AS MATERIALIZED (SELECT DISTINCT host, string_split(host, '.') AS x FROM p WHERE host <> ''),
up AS MATERIALIZED (
  SELECT a, arg_min(b, i) AS b
  FROM (SELECT host AS a, i, array_to_string(x[i:], '.') AS b
        FROM (SELECT host, x, unnest(range(2, len(x))) AS i FROM names WHERE len(x) > 2))
  WHERE b IN (SELECT host FROM names) GROUP BY a),
edges AS MATERIALIZED (
  SELECT src, dst, sum(w)::HUGEINT AS w FROM (
    SELECT * FROM links UNION ALL SELECT a, b, 1 FROM up UNION ALL SELECT b, a, 1 FROM up)
  WHERE src <> dst GROUP BY ALL),
flow0 AS (SELECT 'trust' AS kind, src AS a, dst AS b, w FROM edges
          UNION ALL SELECT 'distrust', dst, src, w FROM edges),
flow AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY kind, a)::HUGEINT AS o FROM flow0),
r AS (
  SELECT 0 AS k, CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host,
         (count(*) * {UNIT})::HUGEINT AS n, (count(*) * {UNIT})::HUGEINT AS waits
  FROM j WHERE host <> '' AND ruled IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT k + 1 AS k, kind, host, sum(n)::HUGEINT, sum(waits)::HUGEINT FROM (
    SELECT k, kind, host, n, CASE WHEN waits > n // {SETTLED} THEN 0 ELSE waits END AS waits FROM r
    UNION ALL
    SELECT k, f.kind, f.b, m, m FROM (
      SELECT r.k, f.kind, f.b, (r.waits * f.w * {damping_pct}) // (f.o * 100) AS m
      FROM r JOIN flow f ON f.kind = r.kind AND f.a = r.host WHERE r.waits > r.n // {SETTLED}) f
    WHERE m > 0)
  WHERE EXISTS (SELECT 1 FROM r WHERE waits > n // {SETTLED})
  GROUP BY ALL),
v AS (SELECT host, coalesce(sum(n) FILTER (kind = 'trust'), 0) AS t,
             coalesce(sum(n) FILTER (kind = 'distrust'), 0) AS d
      FROM r WHERE k = (SELECT max(k) FROM r) GROUP BY host)
SELECT page_id, j.host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(d, 0) > coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(t, 0)::BIGINT AS trust, coalesce(d, 0)::BIGINT AS distrust
FROM j LEFT JOIN v ON v.host = j.host
"""
