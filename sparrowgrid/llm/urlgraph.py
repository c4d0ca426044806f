"""URL rules, and a verdict by link-graph propagation where no rule fits.

Pages that a rule decides make their hosts seeds: a host's trust seed is the share
of its pages that rules allow, its distrust seed the share that rules block. Trust
runs along links (personalised PageRank: a host passes its trust on in equal parts
to all hosts that it links to, whether they have pages here or not), distrust runs
against them (a host that links to distrusted hosts takes part of theirs). Values
are personalised PageRank over (1 - damping), times the sum of the seeds: on this
scale a host that no link reaches has its own seed share, and what links bring is
added. Both propagations run until no value changes by over ``tolerance``.

A host is blocked if its distrust is at least ``threshold`` and greater than its
trust; a page without a rule gets its host's verdict. Everything is DataFrame
operations; host edges are summed before they are shuffled, so a host with a third
of all pages is no large group.

Edge cases: a null url, or one without "://", has an empty host and path and no
rule; an empty host is neither seed nor node, and such pages are allowed. As nodes,
hosts stand without user info and port. Links to the own host do not count.
Repeated rows are judged alike and count as pages. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import durable

#: The rules of the query (verdict, host and path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
DAMPING, TOLERANCE, ROUNDS, THRESHOLD = 0.85, 1e-6, 120, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link's host; one tag is looked at once, up to the next angle bracket, so time is in proportion to the page.
LINK = r"""<a(?:rea)?\s[^<>]*href\s*=\s*(?:["']\s*)?(?:https?:)?//([^/?#"'\s<>]+)"""
#: User info and port, which no node's name holds.
BESIDE_HOST = r"^[^@]*@|:\d*$"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does. ``rules``: a list short enough for one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def node_of(host: Column) -> Column:
    return F.regexp_replace(F.translate(host, UPPER, LOWER), BESIDE_HOST, "")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different nodes, of pages with node and html."""
    found = pages.where("node <> '' and html is not null").select(F.col("node").alias("src"), F.explode(F.regexp_extract_all("html", F.lit("(?i)" + LINK), 1)).alias("dst"))
    return found.select("src", node_of(F.col("dst")).alias("dst")).where("src <> dst and dst <> ''").distinct()


def propagate(seeds: DataFrame, shares: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``seeds`` (node, seed) and ``shares`` (src, dst, share: of what src has, both seeds' nodes) -> (node, value), until no value changes by over ``tolerance``."""
    value = seeds.select("node", F.col("seed").alias("value"))
    checked = value
    for k in range(rounds):
        came = value.join(shares, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(damping * F.col("value") * F.col("share")).alias("came"))
        value = seeds.join(came, F.col("node") == F.col("dst"), "left").select("node", (F.col("seed") + F.coalesce("came", F.lit(0.0))).alias("value"))
        if k % 4 == 0:  # the lineage is cut and the change measured every fourth round
            value = durable(value)
            change = value.join(checked.withColumnRenamed("value", "before"), "node").agg(F.max(F.abs(F.col("value") - F.col("before")))).first()[0]
            if change is None or change <= tolerance:
                break
            checked = value
    return value


def host_values(marked: DataFrame) -> DataFrame:
    """``marked`` (node, html, by_rule) -> (node, trust, distrust) of every node with a page."""
    share = lambda what: (F.count(F.when(F.col("by_rule") == what, 1)) / F.count("*")).alias(what)
    nodes = durable(marked.where("node <> ''").groupBy("node").agg(share("allow"), share("block")))
    links = durable(host_links(marked))
    known = nodes.select(F.col("node").alias("dst"))
    ahead = durable(links.join(links.groupBy("src").agg((1 / F.count("*")).alias("share")), "src").join(known, "dst", "left_semi").select("src", "dst", "share"))
    back = durable(ahead.join(ahead.groupBy("dst").agg((1 / F.count("*")).alias("part")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("part").alias("share")))
    trust = propagate(nodes.select("node", F.col("allow").alias("seed")), ahead)
    distrust = propagate(nodes.select("node", F.col("block").alias("seed")), back)
    return trust.withColumnRenamed("value", "trust").join(distrust.withColumnRenamed("value", "distrust"), "node")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, most_bytes: int = 32 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    host, path = parts(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    marked = split.select("page_id", "host", "path", "html", node_of(F.col("host")).alias("node"), rule.alias("rule"), verdict.alias("by_rule"))
    bad = durable(host_values(marked).where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("node", F.lit("block").alias("by_host")))
    size = bad.agg(F.coalesce(F.sum(F.octet_length("node") + 24), F.lit(0))).first()[0]
    # Few blocked hosts go to all pages, which then need no shuffle; more meet them by host, where adaptive execution splits a large one.
    out = marked.join(F.broadcast(bad) if size <= most_bytes else bad, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every row of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    order = sorted(RULES, key=lambda r: -len(r[1]))

    def case(value: int) -> str:
        whens = "".join(
            f" WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}') THEN '{r[value]}'" for r in order for own, _, rest in [r[1].partition("/")]
        )
        return f"CASE{whens} END"

    rounds, most = [], 80  # 0.85 ** 80 of a value is left out
    for name, seed, link in (("t", "trust", "w"), ("d", "distrust", "b")):
        rounds.append(f"{name}0 AS MATERIALIZED (SELECT node, {seed} AS v FROM hosts)")
        rounds += [
            f"{name}{k + 1} AS MATERIALIZED (SELECT h.node, h.{seed} + coalesce(sum(p.v * e.share), 0) AS v FROM hosts h"
            f" LEFT JOIN {link} e ON e.dst = h.node LEFT JOIN {name}{k} p ON p.node = e.src GROUP BY h.node, h.{seed})"
            for k in range(most)
        ]
    pattern = LINK.replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS MATERIALIZED (SELECT page_id, host, regexp_replace(host, '{BESIDE_HOST}', '', 'g') AS node, path, html, {case(1)} AS rule, {case(0)} AS by_rule FROM s),
hosts AS MATERIALIZED (SELECT node, count(*) FILTER (by_rule = 'allow') / count(*) AS trust, count(*) FILTER (by_rule = 'block') / count(*) AS distrust
  FROM m WHERE node <> '' GROUP BY node),
l AS MATERIALIZED (SELECT DISTINCT src, dst FROM (
  SELECT node AS src, regexp_replace(translate(unnest(regexp_extract_all(html, '{pattern}', 1, 'i')), '{UPPER}', '{LOWER}'), '{BESIDE_HOST}', '', 'g') AS dst FROM m WHERE node <> '')
  WHERE src <> dst AND dst <> ''),
w AS MATERIALIZED (SELECT * FROM (SELECT src, dst, {DAMPING} / count(*) OVER (PARTITION BY src) AS share FROM l) WHERE dst IN (SELECT node FROM hosts)),
b AS MATERIALIZED (SELECT dst AS src, src AS dst, {DAMPING} / count(*) OVER (PARTITION BY dst) AS share FROM w),
{", ".join(rounds)},
bad AS (SELECT node FROM t{most} JOIN d{most} USING (node) WHERE d{most}.v >= {THRESHOLD} AND d{most}.v > t{most}.v)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""


ORACLE = _oracle()
