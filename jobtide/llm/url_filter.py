"""URL verdicts: path rules, then trust and distrust carried over links between hosts.

The longest rule that fits a URL decides it. All other URLs take the verdict of
their host. A host's seeds are the shares of its URLs that rules allow and
block. Trust flows forward along links (personalised PageRank from the
trusted shares), distrust flows backward (to hosts that link to blocked ones). A host is blocked
when its distrust reaches ``threshold`` and exceeds its trust. Both scores are
scaled so that a host without links keeps its own shares. Distrust is handed to the hosts that link to a bad one in proportion
to their part of the links *to it*: whoever alone links to a blocked host takes on nearly all of its distrust, however
many other links it has.

Links are counted for each pair of hosts before anything is joined, and the
iterations move one row for each host and pair; each wave is written. Host tables
grow with the web, so they are joined, never broadcast.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, fits no rule
and is allowed, as empty hosts take no part in the graph; a null html has no links; a repeated page is judged
and counted again; an empty table gives an empty result; links to a page's own host,
relative ones included, carry nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def longest_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of the rules that fit, or null; of equally long ones the first by name."""
    found = F.lit(None).cast("string")
    for rule in sorted(sorted(set(rules), reverse=True), key=len):
        h, p = split_rule(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst, n)``: how many links lead from one host to another."""
    link = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("link")
    found = pages.select(host_of(F.col(url)).alias("src"), link)
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return found.select("src", host_of(absolute).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy(
        "src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float, least: float = 1e-9, cut: int = 8) -> DataFrame:
    """``(host, score)``: seed shares plus what comes over the links.

    score = seed + damping * sum over incoming links of score(src) * n / all links of src

    The seeds travel as waves: a wave is what the one before it hands on, and the score is the sum of all. It ends when no
    host is handed ``least`` or more, far below what verdicts are rounded to.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    share = store(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "host-share")
    wave = seeds.where("seed > 0").select("host", F.col("seed").alias("score"))
    total = [wave]
    while not share.isEmpty():
        wave = wave.join(share, F.col("host") == F.col("src")).groupBy("dst").agg((F.sum(F.col("score") * F.col("share")) * damping).alias("score"))
        wave = store(wave.select(F.col("dst").alias("host"), "score"), "host-wave")
        if (wave.agg(F.max("score")).first()[0] or 0) < least:
            break
        total.append(wave)
        if len(total) > cut:
            total = [store(summed(total), "host-score")]
    return seeds.select("host").join(summed(total), "host", "left").select("host", F.coalesce("score", F.lit(0.0)).alias("score"))


def summed(waves: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, waves).groupBy("host").agg(F.sum("score").alias("score"))


def judge_urls(
    pages: DataFrame, allow: Sequence[str], block: Sequence[str], damping: float = 0.85,
    threshold: float = 0.5, key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for each row of ``pages``.

    Scores have six digits; they are null where the host is empty.
    """
    if set(allow) & set(block):
        raise ValueError("a rule cannot allow and block")
    judged = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("rule", longest_rule(F.col("host"), F.col("path"), [*allow, *block]))
    judged = judged.withColumn("said", F.when(F.col("rule").isin(list(block)), "block").when(F.col("rule").isNotNull(), "allow"))
    links = store(host_links(pages, url, html), "host-links")
    share = lambda word: F.avg(F.when(F.col("said") == word, 1.0).otherwise(0.0))
    own = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    away = links.select(F.col("dst").alias("host")).distinct().join(own, "host", "left_anti").select(
        "host", F.lit(0.0).alias("allowed"), F.lit(0.0).alias("blocked"))
    hosts = store(own.unionByName(away), "hosts")
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), links, damping)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), back, damping)
    scored = trust.select("host", F.round("score", 6).alias("trust")).join(
        distrust.select("host", F.round("score", 6).alias("distrust")), "host")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return judged.join(scored, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(bad, "block"), F.lit("allow")).alias("verdict"), "trust", "distrust")
