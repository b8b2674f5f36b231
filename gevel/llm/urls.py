"""URL verdicts: rules first, else trust and distrust spread over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import forget, keep_table

#: (host, path start, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules become one expression; a longer list belongs in a table of its own.
MOST_RULES = 500
#: Share of links followed.
DAMPING = 0.85
#: What all scores may still be off by when the rounds end at the latest; scores sum up to one, so doubles hold no less.
FINEST = 1e-15
#: Share of a host's pages that an allow or block rule must cover to make it a seed.
SEED_SHARE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of absolute and protocol-relative links.
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(host: Column) -> Column:
    """The name a host has among links: without user and port."""
    return F.regexp_replace(host, r"^[^@]*@|:\d*$", "")


def ruled(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, what) -> Column:
    """``what(rule)`` of the longest rule that fits host and path, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; one expression takes {MOST_RULES}")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        found = F.when(fits, F.lit(what(rule))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, n): links from pages of host a to another host b, hosts without user and port."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    found = pages.select(node_of(host_of(F.col("url"))).alias("a"), F.explode(targets).alias("target"))
    name = F.translate(node_of(F.col("target")), _UPPER, _LOWER)
    return (
        found.select("a", name.alias("b"))
        .where("a <> '' and b <> '' and a <> b")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def spread_trust(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust) from (host, good, bad) seeds and (a, b, n) links.

    Trust follows links from good seeds; distrust goes against them, from bad seeds to
    those who link there. Both are personalised PageRank; what reaches a host without
    links on returns to the seeds. Each round is written, the one before removed.

    What a round moves, times 0.85 / 0.15, bounds what all later ones can. Rounds end
    when no further host was reached and no host's trust and distrust are so near to
    each other that the rest could turn them, or at ``FINEST``, after some 240 rounds,
    where only hosts are left whose scores are equal as far as doubles tell.
    """
    spark = hosts.sparkSession
    ends = links.select(F.col("a").alias("host")).unionByName(links.select(F.col("b").alias("host"))).distinct()
    nodes = ends.join(hosts, "host", "full").select(
        "host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")
    )
    out = links.groupBy(F.col("a").alias("host")).agg(F.sum("n").alias("out"))
    back = links.groupBy(F.col("b").alias("host")).agg(F.sum("n").alias("back"))
    nodes, _ = keep_table(nodes.join(out, "host", "left").join(back, "host", "left"), "hosts")
    links, _ = keep_table(links, "host-links")
    good, bad = nodes.agg(F.sum("good"), F.sum("bad")).first()

    def seed(name: str, total: float | None) -> Column:
        return F.col(name) / F.lit(total) if total else F.lit(0.0)

    seeds = nodes.select("*", seed("good", good).alias("t0"), seed("bad", bad).alias("b0"))
    state, path = keep_table(seeds.withColumns({"trust": F.col("t0"), "distrust": F.col("b0")}), "trust")
    some = (F.col("trust") > 0) | (F.col("distrust") > 0)

    def told(state: DataFrame, moved: Column):
        """What all scores moved together, hosts reached, and what has no link to go on by, forwards and back."""
        lost = [F.sum(F.when(F.col(x).isNull(), F.col(s))) for x, s in (("out", "trust"), ("back", "distrust"))]
        return state.agg(
            F.coalesce(F.sum(moved), F.lit(0.0)), F.count_if(some), *[F.coalesce(x, F.lit(0.0)) for x in lost]
        ).first()

    _, reached, *lost = told(state, F.lit(0.0))
    while True:
        zero = F.lit(0.0)
        on = state.join(links, F.col("host") == F.col("a")).select(
            F.col("b").alias("to"), (F.col("trust") * F.col("n") / F.col("out")).alias("t"), zero.alias("d")
        )
        against = state.join(links, F.col("host") == F.col("b")).select(
            F.col("a").alias("to"), zero.alias("t"), (F.col("distrust") * F.col("n") / F.col("back")).alias("d")
        )
        gained = on.unionByName(against).groupBy("to").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        both = state.join(gained, F.col("host") == F.col("to"), "left")
        trust = (1 - DAMPING) * F.col("t0") + DAMPING * (F.coalesce("t", zero) + lost[0] * F.col("t0"))
        distrust = (1 - DAMPING) * F.col("b0") + DAMPING * (F.coalesce("d", zero) + lost[1] * F.col("b0"))
        moved = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        columns = ["host", "good", "bad", "out", "back", "t0", "b0"]
        state, newer = keep_table(
            both.select(*columns, trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved")), "trust"
        )
        forget(spark, path)
        path = newer
        change, n, *lost = told(state, F.col("moved"))
        rest = change * DAMPING / (1 - DAMPING)
        near = some & (F.abs(F.col("trust") - F.col("distrust")) <= rest)
        if rest <= FINEST or (n == reached and state.where(near).isEmpty()):
            break
        reached = n
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages``.

    The longest rule that fits decides. Else the host does: it is blocked if its distrust
    is above its trust. Seeds are hosts of whose pages at least ``SEED_SHARE`` are allowed
    (good) or blocked (bad) by rules, weighted by that share.

    Null url or one without ``://``: empty host and path, no rule, allowed. A host that
    neither kind of seed reaches is allowed. Null html: no links. Repeated rows are kept
    and count twice. Of equally long rules the last by name wins. Hosts that differ in
    user or port alone are one among links, and share its scores. Very long urls and texts
    are read whole; other columns are ignored. No rows: no rows.
    """
    host, path = F.col("host"), F.col("path")
    plain = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = plain.withColumns(
        {
            "rule": ruled(rules, host, path, lambda r: r[0] + r[1]),
            "by_rule": ruled(rules, host, path, lambda r: r[2]),
        }
    )
    rows, _ = keep_table(rows.withColumn("node", node_of(host)), "pages")

    def share(verdict: str) -> Column:
        part = F.count(F.when(F.col("by_rule") == verdict, 1)) / F.count(F.lit(1))
        return F.when(part >= SEED_SHARE, part).otherwise(F.lit(0.0))

    nodes = rows.where("node <> ''").groupBy(F.col("node").alias("host"))
    hosts = nodes.agg(share("allow").alias("good"), share("block").alias("bad"))
    scores = spread_trust(hosts, host_links(pages)).withColumnRenamed("host", "h")
    verdict = F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(scores, F.col("node") == F.col("h"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", verdict).alias("verdict"), "trust", "distrust"
    )


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")
