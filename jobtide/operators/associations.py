"""Skill baskets: co-occurrence, frequent sets, association rules."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import dims
from jobtide.functions.text import normalize_skills
from jobtide.operators.columns import IMPACT_SKILL_ORDER, chosen_skills
from jobtide.operators.market import SKILLS
from jobtide.session import broadcast_if_small, cut_lineage, stored

#: Candidates of one size that are counted level by level; where there are more, trees are grown (FP-growth).
MAX_CANDIDATES = 200_000

#: Baskets that a task compares at once.
CHUNK = 2_000


def baskets(postings: DataFrame, keep: Sequence[str] = (), skills: DataFrame | None = None, by: Sequence[str] = (), skills_col: str = SKILLS) -> DataFrame:
    """Non-empty baskets of normalised skills, limited to ``skills`` if given.

    ``skills`` (``by`` columns and ``skill_name``) is a short list, such as the
    top twenty of a role; it bounds the length of a basket.
    """
    columns = list(dict.fromkeys([*by, *keep]))
    rows = postings.select(*columns, normalize_skills(F.col(skills_col)).alias("basket"))
    if skills is not None:
        allowed = F.collect_set("skill_name").alias("_allowed")
        if by:
            rows = rows.join(broadcast_if_small(skills.groupBy(*by).agg(allowed)), list(by))
        else:
            rows = rows.withColumn("_allowed", skills.agg(allowed).scalar())
        rows = rows.withColumn("basket", F.array_intersect("basket", "_allowed")).drop("_allowed")
    return rows.where(F.size("basket") > 0)


def _pairs(basket: Column) -> Column:
    """All (a, b) with a before b of one short sorted list."""
    after = lambda a, i: F.transform(F.slice(basket, i + 2, F.size(basket)), lambda b: F.struct(a.alias("src"), b.alias("dst")))
    return F.flatten(F.transform(basket, after))


def cooccurrence_edges(postings: DataFrame, skills: DataFrame, by: Sequence[str] = (), skills_col: str = SKILLS) -> DataFrame:
    """(by, src, dst, weight): postings that list both skills, src < dst.

    Pairs are formed inside a row and only among the listed skills, then counted
    with partial sums before the shuffle.
    """
    rows = baskets(postings, (), skills, by, skills_col)
    pairs = rows.select(*by, F.inline(_pairs(F.array_sort("basket"))))
    return pairs.groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def cooccurrence_counts(postings: DataFrame, skills: DataFrame, by: Sequence[str] = (), skills_col: str = SKILLS) -> DataFrame:
    """The symmetric table of pair counts; absent pairs and the diagonal are zero."""
    edges = cooccurrence_edges(postings, skills, by, skills_col)
    return edges.union(edges.select(*by, "dst", "src", "weight"))


def skill_pairs(postings: DataFrame, skills: DataFrame, id_col: str = "job_url", skills_col: str = SKILLS) -> DataFrame:
    """(id, src, dst): the pairs of listed skills of each posting."""
    rows = baskets(postings, [id_col], skills, (), skills_col)
    return rows.select(id_col, F.inline(_pairs(F.array_sort("basket"))))


def _frequent_sets(rows: DataFrame, least: int) -> list[tuple[tuple[str, ...], int]] | None:
    """The sets of items in at least ``least`` baskets, with their counts; None if there are too many candidates.

    Level by level (Apriori): a set can only be frequent if all its parts are. Items are numbered and a set of size k is
    the number of a frequent set of k - 1 and a later item, so in each basket the frequent sets are lengthened by its later items.
    A task returns a count for each candidate; a level is one pass over the baskets as short lists of numbers.
    """
    items = rows.select(F.explode("basket").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    most = int((2 * MAX_CANDIDATES) ** 0.5)  # items with so many pairs
    found = items.limit(most + 1).collect()
    if len(found) > most:
        return None
    known = sorted((r["item"], r["n"]) for r in found)
    names, size = [i for i, _ in known], max(1, len(known))

    # The baskets as sorted lists of the numbers of their frequent items, of which a set needs two.
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            slots = pc.index_in(flat, value_set=pa.array(names, flat.type))
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[slots.is_valid().to_numpy(zero_copy_only=False)]
            cells = np.unique(row * size + slots.drop_null().to_numpy())
            ends = np.concatenate([[0], np.cumsum(np.bincount(cells // size, minlength=len(lists)))])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((cells % size).astype(np.int32)))], names=["b"])

    encoded = rows.select("basket").mapInArrow(numbered, "b array<int>")
    baskets_ = stored(encoded.where(F.size("b") > 1), "baskets")

    def counted(levels: list[np.ndarray]) -> dict[int, int]:
        """Baskets of each candidate: the last of ``levels``, keys (number of the shorter set, item) in order."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(levels[-1]), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    lists = batch.column(0).slice(at, CHUNK)
                    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    ends = np.repeat(np.cumsum(sizes), sizes)  # by position
                    place, held = np.arange(len(flat)), flat
                    for keys in levels:
                        later = ends[place] - place - 1
                        first = np.repeat(np.cumsum(later) - later, later)
                        next_ = np.repeat(place + 1, later) + np.arange(later.sum()) - first
                        key = np.repeat(held, later) * size + flat[next_]
                        index = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        hit = keys[index] == key
                        place, held = next_[hit], index[hit]
                    total += np.bincount(held, minlength=len(total))
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], names=["id", "n"])

        partial = baskets_.mapInArrow(count, "id long, n long")
        return {r["id"]: r["n"] for r in partial.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}

    out = [((i,), n) for i, n in known]
    sets, levels = [(n,) for n in range(len(names))], []
    while sets:
        # Candidates: two frequent sets that differ in their last item, of which all parts are frequent.
        number, by_head = {s: n for n, s in enumerate(sets)}, {}
        for s in sets:
            by_head.setdefault(s[:-1], []).append(s[-1])
        longer = []
        for head, lasts in by_head.items():
            for a, b in combinations(sorted(lasts), 2):
                if all((*head[:i], *head[i + 1 :], a, b) in number for i in range(len(head))):
                    longer.append((*head, a, b))
            if len(longer) > MAX_CANDIDATES:
                return None
        if not longer:
            break
        keyed = sorted((number[s[:-1]] * size + s[-1], s) for s in longer)
        counts = counted([*levels, np.array([k for k, _ in keyed], dtype=np.int64)])
        kept = [(k, s, counts[n]) for n, (k, s) in enumerate(keyed) if n in counts]
        out += [(tuple(names[i] for i in s), n) for _, s, n in kept]
        levels.append(np.array([k for k, _, _ in kept], dtype=np.int64))
        sets = [s for _, s, _ in kept]
    return out


def frequent_skill_sets(postings: DataFrame, min_support: float = 0.05, skills: DataFrame | None = None, skills_col: str | None = None) -> DataFrame:
    """(items, freq, n_baskets, support): skill sets in at least that share of the non-empty baskets."""
    postings, skills_col = chosen_skills(postings, skills_col, IMPACT_SKILL_ORDER)
    # The miner passes over its baskets several times; derive them once.
    rows = stored(baskets(postings, (), skills, (), skills_col), "baskets")
    n = rows.count()
    total = F.lit(n).cast("long")
    found = _frequent_sets(rows, max(1, math.ceil(min_support * n)))
    if found is None:
        sets = FPGrowth(itemsCol="basket", minSupport=min_support).fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    else:
        sets = rows.sparkSession.createDataFrame([(list(s), c) for s, c in found], "items array<string>, freq long")
    # Rules read the sets three times, and mining is the costly part.
    return cut_lineage(sets.withColumn("n_baskets", total).withColumn("support", F.col("freq") / F.col("n_baskets")))


def association_rules(itemsets: DataFrame, min_lift: float = 1.0, max_consequent: int | None = None) -> DataFrame:
    """Every split of a frequent set into antecedent and consequent, with its measures.

    The parts of a frequent set are frequent too, so their supports come from
    two equi-joins of the itemsets with themselves.
    """
    sets = itemsets.select("items", "support")
    pairs = sets.where(F.size("items") >= 2)
    if max_consequent == 1:  # one split for each item
        parts = pairs.withColumn("_one", F.explode("items")).select(
            "items", "support", F.array_remove("items", F.col("_one")).alias("antecedents"), F.array("_one").alias("consequents"))
    else:
        masks = F.expr("sequence(1L, shiftleft(1L, size(items)) - 2)")
        parts = (
            pairs.withColumn("_mask", F.explode(masks))
            .withColumn("antecedents", F.expr("filter(items, (x, i) -> getbit(_mask, i) = 1)"))
            .withColumn("consequents", F.array_except("items", "antecedents"))
        )
        if max_consequent is not None:
            parts = parts.where(F.size("consequents") <= max_consequent)
    side = lambda name: sets.select(F.col("items").alias(name), F.col("support").alias(f"{name}_support"))
    rules = parts.join(side("antecedents"), "antecedents").join(side("consequents"), "consequents")
    supp, a, c = F.col("support"), F.col("antecedents_support"), F.col("consequents_support")
    confidence = supp / a
    return (
        rules.select(
            "antecedents", "consequents", supp.alias("support"), confidence.alias("confidence"),
            (supp / (a * c)).alias("lift"), (supp - a * c).alias("leverage"),
            F.when(confidence < 1, (1 - c) / (1 - confidence)).otherwise(F.lit(float("inf"))).alias("conviction"),
        )
        .where(F.col("lift") >= min_lift)
    )


def top_rules(rules: DataFrame, n: int = 150) -> DataFrame:
    """The rules of the highest lift; ties by confidence, then by their items."""
    return rules.orderBy(F.round("lift", 9).desc(), F.round("confidence", 9).desc(), "antecedents", "consequents").limit(n)


def strategic_rules(rules: DataFrame, role: str | None = None, n: int = 10) -> DataFrame:
    """Short, confident rules whose single consequent says more than the role's own words."""
    words = set(dims.GENERIC_ROLE_WORDS)
    if role:
        words |= {role.lower(), *role.lower().split()}
    kept = rules.where(
        (F.size("antecedents") <= 2) & (F.size("consequents") == 1) & (F.col("confidence") >= 0.25)
        & ~F.lower(F.get("consequents", 0)).isin(sorted(words))
    )
    return top_rules(kept, n)


def insight_rows(rules: DataFrame) -> DataFrame:
    """Rules as text: what one has, what one likely needs, how sure, how strong."""
    return rules.select(
        F.array_join("antecedents", ", ").alias("if_you_have"),
        F.array_join("consequents", ", ").alias("you_likely_need"),
        F.format_string("%.1f%%", F.bround(F.col("confidence") * 100, 1)).alias("probability"),
        F.format_string("%.2fx", F.bround("lift", 2)).alias("market_strength"),
    )


def rules_to_edges(rules: DataFrame, n: int = 150, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): undirected edges of the top rules, weighted by the highest lift."""
    pairs = (
        top_rules(rules, n)
        .select("lift", F.explode("antecedents").alias("a"), "consequents")
        .select("lift", "a", F.explode("consequents").alias("b"))
    )
    if nodes is not None:
        for side in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(side)).distinct(), side, "left_semi")
    return pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("lift").alias("weight"))
