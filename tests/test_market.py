import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobtide.functions import stats
from jobtide.operators import associations as assoc
from jobtide.operators import filters, graph, market

JOB = "job_url string, job_title string, company string, location array<string>, experience_min double, salary_mid double, skills_list array<string>, cluster_id int"


def jobs(spark, rows):
    return spark.createDataFrame(rows, JOB)


def simple(spark, n=4):
    return jobs(spark, [
        (f"u{i}", "Data Analyst", f"c{i}", ["Pune"], float(i + 1), 10.0 + i, ["X"] if i < 2 else (["y"] if i == 2 else None), i % 2) for i in range(n)])


def test_frequency_counts_postings_without_skills(spark):
    got = {r["skill_name"]: (r["count"], r["percentage"]) for r in market.skill_frequency(simple(spark)).collect()}
    assert got == {"X": (2, 50.0), "Y": (1, 25.0)}


def test_frequency_keeps_null_groups(spark):
    df = simple(spark).withColumn("g", F.lit(None).cast("string"))
    assert market.skill_frequency(df, ["g"]).count() == 2


def test_impact_against_direct_means(spark):
    rows = [(f"u{i}", "t", "c", ["P"], 1.0, float(5 + (i * 7) % 11), ["A"] if i % 3 else ["A", "B"], 1) for i in range(30)]
    rows += [(f"v{i}", "t", "c", ["P"], 1.0, 3.0 + i, ["C"], 1) for i in range(2)]
    got = {r["skill"]: r for r in market.skill_salary_impact(jobs(spark, rows), positive_only=False).collect()}
    assert set(got) == {"B"}  # C has two postings, A leaves only two without
    having = [r[5] for r in rows if "B" in r[6]]
    rest = [r[5] for r in rows if "B" not in r[6]]
    mean = lambda v: sum(v) / len(v)
    var = lambda v: sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1)
    t = (mean(having) - mean(rest)) / math.sqrt(var(having) / len(having) + var(rest) / len(rest))
    assert got["B"]["t"] == pytest.approx(t)
    assert 0 < got["B"]["p_value"] <= 1


def test_student_tail():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert stats.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_benchmark_without_match_is_zero(spark):
    asked = spark.createDataFrame([("pilot", None), ("analyst", "PUNE")], "role string, location string")
    got = {r["role"]: (r["median"], r["count"]) for r in market.salary_benchmark(simple(spark), asked).collect()}
    assert got == {"pilot": (0.0, 0), "analyst": (11.5, 4)}


def test_alignment(spark):
    people = spark.createDataFrame([("a", "analyst", 0), ("b", "analyst", 3), ("c", "analyst", 9)], "profile_id string, target_role string, years_experience int")
    got = {r["profile_id"]: r["status"] for r in market.experience_alignment(people, simple(spark)).collect()}
    assert got == {"a": "Under-qualified", "b": "Perfectly Matched", "c": "Over-qualified"}


def test_entry_experience_uses_ten_smallest(spark):
    rows = [(f"u{i}", "x analyst", "c", [], float(i // 8), None, None, 1) for i in range(40)]
    roles = spark.createDataFrame([("analyst",)], "role string")
    assert market.entry_experience(jobs(spark, rows), roles).first()["entry_experience"] == pytest.approx(0.2)


def test_contained_phrases_is_exact(spark):
    texts = spark.createDataFrame([(1, "Senior Data Scientist jobs"), (2, "hr"), (3, "none")], "id int, t string")
    names = spark.createDataFrame([("data scientist",), ("scientist",), ("HR",), ("ent",), ("scientists",)], "role string")
    got = {(r["id"], r["phrase"]) for r in filters.contained_phrases(texts, "id", "t", names, "role").collect()}
    assert got == {(1, "data scientist"), (1, "scientist"), (1, "ent"), (2, "hr")}


def baskets(spark):
    return jobs(spark, [(f"u{i}", "t", "c", [], 1.0, 1.0, s, 1) for i, s in enumerate([["a", "b", "c"], ["a", "b"], ["a", "c"], ["b"]])])


def test_rules(spark):
    rules = assoc.association_rules(assoc.frequent_skill_sets(baskets(spark), 0.25))
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in rules.collect()}
    rule = got[("A",), ("C",)]
    assert (rule["support"], rule["confidence"], rule["lift"]) == (0.5, pytest.approx(2 / 3), pytest.approx(4 / 3))
    assert all(r["support"] <= r["confidence"] + 1e-12 for r in got.values())
    for (a, c), r in got.items():
        if (c, a) in got:
            assert got[c, a]["lift"] == pytest.approx(r["lift"])


def test_cooccurrence_is_symmetric(spark):
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "skill_name string")
    got = {(r["src"], r["dst"]): r["weight"] for r in assoc.cooccurrence_counts(baskets(spark), names).collect()}
    assert got == {("A", "B"): 2, ("B", "A"): 2, ("A", "C"): 2, ("C", "A"): 2, ("B", "C"): 1, ("C", "B"): 1}


def test_centrality(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    got = {r["node"]: round(r["centrality"], 6) for r in graph.degree_centrality(edges, nodes).collect()}
    assert got == {"a": 0.666667, "b": 0.333333, "c": 0.333333, "d": 0.0}


def slow_labels(nodes, links, rounds):
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    label = {n: n for n in nodes}
    for _ in range(rounds):
        votes = {n: Counter(label[x] for x in near[n]) for n in nodes}
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    return {n: min(x for x in nodes if label[x] == label[n]) for n in nodes}


def test_communities_are_label_propagation(spark):
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    graphs = {"g": (list("abcdefz"), links)}
    rnd = random.Random(2)
    for i in range(4):
        names = [f"n{j}" for j in range(rnd.randrange(2, 14))]
        pairs = [(a, b) for a in names for b in names if a < b]
        graphs[f"r{i}"] = (names, rnd.sample(pairs, min(len(pairs), rnd.randrange(1, 16))))
    edges = spark.createDataFrame([(g, *e) for g, (_, some) in graphs.items() for e in some], "g string, src string, dst string")
    nodes = spark.createDataFrame([(g, n) for g, (some, _) in graphs.items() for n in some], "g string, node string")
    for rounds in (2, 7):
        labels = graph.communities(edges, nodes, ["g"], rounds)
        got = {(r["g"], r["node"]): r["community"] for r in labels.collect()}
        assert got == {(g, n): c for g, (some, pairs) in graphs.items() for n, c in slow_labels(some, pairs, rounds).items()}
    assert {n: c for (g, n), c in got.items() if g == "g"} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d"), "z": "z"}
    quality = {r["g"]: r["modularity"] for r in graph.modularity(edges, labels, ["g"]).collect()}
    assert quality["g"] == pytest.approx(6 / 7 - 0.5)


def test_growth_and_the_skill_column(spark, tmp_path):
    rows = [("2024-03-%02d" % d, s) for d, s in [(1, ["sql"]), (2, ["sql", "go"]), (3, ["java"]), (8, ["go"]), (9, ["go", "sql"]), (10, ["rust", None])]]
    jobs = spark.createDataFrame([(i, d, s, None) for i, (d, s) in enumerate(rows)], "id int, scraped_date string, skills_extracted array<string>, skills_list array<string>")
    path = str(tmp_path / "daily")
    for day in ("2024-03-0", "2024-03-1", "2024-03-0"):  # one day again
        market.store_daily_skills(jobs.where(F.col("scraped_date").startswith(day)), path)
    got = {r.skill_name: (r.n_now, r.n_before, r.growth_rate and round(r.growth_rate, 6)) for r in
           market.skill_growth(spark.read.parquet(path), F.lit("2024-03-10").cast("date"), 5).collect()}
    assert got == {"Rust": (1, 0, None), "Go": (2, 1, 100.0), "Sql": (1, 2, -50.0)}
    paid = jobs.withColumns({"salary_mid": F.lit(3.0), "job_title": F.lit("x")})
    one = {(r.skill_name, r["count"]) for r in market.skill_frequency(paid).collect()}
    assert one == {(r.skill_name, r["count"]) for r in market.skill_frequency(paid.drop("skills_list").withColumnRenamed("skills_extracted", "skills_list")).collect()}
    assert ("Sql", 3) in one
