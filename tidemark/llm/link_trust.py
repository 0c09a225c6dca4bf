"""Operator 4: URL filter by rules and link-graph propagation between hosts.

Rules decide the pages they fit. For the rest, trust flows along host links from hosts with
allowed pages (personalised PageRank) and distrust flows against the links from hosts with
blocked pages: whoever links to a blocked host becomes suspect. A host is a seed by the share of
its ruled pages that are allowed (blocked), whatever their number, so a large site weighs no more
than a small one. The mass of hosts that the flow cannot leave returns to the seeds: the scores
keep the sum of their seeds. A host whose distrust exceeds its trust is blocked. DataFrame
functions only.

Edge cases: a null url, or one without ``://``, has an empty host and path and is allowed; an
empty path fits no rule; hosts without any evidence, or with equal trust and distrust, are allowed;
links without a host, to the own host or in a null html make no edge, nor does a tag that is not
closed before the next ``<``; repeated pages count as often as they occur; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

DAMPING = 0.85
TOLERANCE = 1e-4  # relative change of a host's trust or distrust in the last round
DISTRUST_FACTOR = 1.0  # blocked if distrust > factor * trust
CLEARLY = 1 + 1e-9  # sums of doubles that differ by less are a tie
# possessive, and never past a '<': the time is linear in the page
LINK = r"""(?i)<a\s(?:[^<>]*?\s)??href\s*+=\s*+["']?+\s*+([^"'\s<>]++)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add ``rule`` (the longest that fits, else null) and ``said`` (its verdict, else null)."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        rule, said = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return pages.withColumn("rule", rule).withColumn("said", said)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links between different hosts; ``share`` of the links of src, and
    ``back`` of the links to dst."""
    links = F.filter(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: x.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    target = F.regexp_extract(F.col("link"), "//([^/?#]*)", 1)
    pairs = (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
        .select("src", _lower(target).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    out = pairs.groupBy("src").agg(F.sum("n").alias("n_out"))
    into = pairs.groupBy("dst").agg(F.sum("n").alias("n_in"))
    return pairs.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("n") / F.col("n_out")).alias("share"), (F.col("n") / F.col("n_in")).alias("back")
    )


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allowed, blocked); rounds are written tables.

    Values only grow from round to round and what is still to come shrinks by ``DAMPING``, so the
    rounds end: when no host is newly reached and none changes by more than ``TOLERANCE`` of its
    own value. The mass of other hosts has no part in that."""
    base = seeds.select(
        "host", ((1 - DAMPING) * F.col("allowed")).alias("trust"), ((1 - DAMPING) * F.col("blocked")).alias("distrust")
    )
    state = base = cut(base)
    edges = cut(edges)
    if edges.isEmpty():
        return state
    while True:
        given = state.join(edges, F.col("host") == F.col("src")).select(
            F.col("dst").alias("host"), (DAMPING * F.col("trust") * F.col("share")).alias("trust"), F.lit(0.0).alias("distrust")
        )
        blamed = state.join(edges, F.col("host") == F.col("dst")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (DAMPING * F.col("distrust") * F.col("back")).alias("distrust")
        )
        after = cut(
            base.unionByName(given).unionByName(blamed).groupBy("host").agg(
                F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")
            )
        )
        old = state.select("host", F.col("trust").alias("_t"), F.col("distrust").alias("_d"))
        # a value that was 0 and is not changes by its whole
        change = lambda new, was: F.when(F.col(new) > 0, 1 - F.coalesce(was, F.lit(0.0)) / F.col(new)).otherwise(0.0)
        gap = after.join(old, "host", "left").agg(
            F.max(F.greatest(change("trust", "_t"), change("distrust", "_d")))
        ).first()[0]
        state = after
        if not gap or gap <= TOLERANCE:
            return state


def conserve(scores: DataFrame, seeds: DataFrame) -> DataFrame:
    """Scores scaled to the sum of their seeds, which is what returning the mass of hosts without
    further links to the seeds in every round leads to: the flow is linear in its source."""
    # two rows of two numbers
    had = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    has = scores.agg(F.sum("trust"), F.sum("distrust")).first()
    trust, distrust = (a / b if b else 0.0 for a, b in zip(had, has))
    return scores.select("host", (F.col("trust") * trust).alias("trust"), (F.col("distrust") * distrust).alias("distrust"))


def filter_pages(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = apply_rules(located, rules)
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    seeds = judged.filter("said IS NOT NULL").groupBy("host").agg(
        share("allow").alias("allowed"), share("block").alias("blocked")
    )
    seeds = cut(seeds)
    scores = conserve(propagate(seeds, host_edges(pages.select("url", "html"))), seeds)
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    found = F.when(distrust > DISTRUST_FACTOR * CLEARLY * trust, "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", found).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
