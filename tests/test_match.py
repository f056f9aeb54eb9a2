import csv
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import service_queries  # noqa: F401
from catalog.registry import QUERIES
from jobtide.operators import associations, classify, index, match, retrieval, routing, salary, transition, vector_index
from jobtide.operators.cells import in_cells
from jobtide.plans import build
from jobtide.sources.postings import read_raw_postings
from jobtide.streaming import crawl, ingest

JOB = "job_url string, job_title string, location array<string>, experience_min double, skills_list array<string>, education_extracted array<string>"
USER = "profile_id string, target_role string, years_experience int, education array<string>, skills array<string>, locations array<string>"


def people_and_jobs(spark):
    rnd = random.Random(3)
    pick = lambda pool, n: rnd.sample(pool, n)
    skills = [f"s{i}" for i in range(9)]
    cities = ["Pune", "Delhi", "Goa"]
    jobs = [(f"u{i:03d}", rnd.choice(["Data Analyst", "Data Engineer"]), pick(cities, rnd.randint(1, 2)), float(rnd.randint(0, 9)),
             pick(skills, rnd.randint(0, 4)), rnd.choice([[], ["MBA"], ["PhD"]])) for i in range(120)]
    users = [(f"p{i}", rnd.choice(["analyst", "engineer", "data"]), rnd.randint(0, 9), rnd.choice([["PGDM"], ["PhD"], ["X"]]),
              pick(skills, 3), rnd.choice([[], ["pune"], ["Delhi", "Goa"]])) for i in range(25)]
    return spark.createDataFrame(users, USER), spark.createDataFrame(jobs, JOB)


def brute(users, jobs, k):
    pairs = users.crossJoin(jobs.withColumnsRenamed({"location": "at"})).where(
        F.lower("job_title").contains(F.col("target_role")) & (F.col("experience_min") <= F.col("years_experience") + 3))
    low = lambda c: F.transform(c, F.lower)
    pairs = pairs.where((F.size("locations") == 0) | F.arrays_overlap(low("locations"), low("at")))
    score = match.match_score(F.col("skills"), F.col("years_experience"), F.col("education"), F.col("skills_list"), F.col("experience_min"), F.col("education_extracted"))
    out = {}
    for r in pairs.select("profile_id", "job_url", F.round(score, 9).alias("s")).collect():
        out.setdefault(r["profile_id"], []).append((-r["s"], r["job_url"]))
    return {p: sorted(v)[:k] for p, v in out.items()}, {p: len(v) for p, v in out.items()}


@pytest.mark.parametrize("k", [1, 5, 40])
def test_match_equals_brute_force(spark, k):
    users, jobs = people_and_jobs(spark)
    want, counts = brute(users, jobs, k)
    got = {}
    for r in match.match_profiles(users, jobs, k=k).orderBy("profile_id", "rank").collect():
        got.setdefault(r["profile_id"], []).append((-r["match_score"], r["job_url"]))
    assert got == want
    seen = {r["profile_id"]: r["n_matches"] for r in match.count_matches(users, jobs).collect()}
    assert {p: n for p, n in seen.items() if n} == counts
    parts = match.match_parts(match.match_profiles(users, jobs, k=k), users, jobs).collect()
    assert all(abs(r.match_score - r.skill_points - r.experience_points - r.education_points) < 1e-6 for r in parts)


def test_single_scores(spark):
    one = spark.range(1)
    none = F.array().cast("array<string>")
    score = lambda years, need, required=none, own=none: one.select(
        match.match_score(own, F.lit(years), own, none, F.lit(float(need)), required)).first()[0]
    assert score(2, 2) == 70
    assert score(0, 4) == 10
    assert score(9, 0) == 50
    assert score(2, 2, F.array(F.lit("MBA")), F.array(F.lit("PGDM"))) == 70
    assert score(2, 2, F.array(F.lit("M.Tech/M.E")), F.array(F.lit("PGDM"))) == 60


def test_synonyms(spark):
    words = spark.createDataFrame([("AI ",), ("Artificial Intelligence",)], "s string")
    assert words.select(transition.normalize_skill(F.col("s")).alias("n")).distinct().count() == 1
    assert words.select(transition.normalize_skill(F.col("s"), compat=True).alias("n")).distinct().count() == 2


def test_transition_model_separates(spark):
    rnd = np.random.default_rng(1)
    rows = [(float(a), float(g), 1.0, 1.0, 10.0, 1) for a, g in zip(rnd.uniform(0.6, 1, 200), rnd.uniform(-3, 1, 200))]
    rows += [(float(a), float(g), 1.0, 1.0, 10.0, 0) for a, g in zip(rnd.uniform(0, 0.4, 200), rnd.uniform(3, 9, 200))]
    data = spark.createDataFrame(rows, "skill_ratio double, exp_gap double, loc_match double, edu_match double, difficulty double, label int")
    model = transition.train_transition(data)
    assert model.auc > 0.99
    weights = {r["feature"]: r["weight"] for r in transition.feature_weights(spark, model).collect()}
    assert weights["skill_ratio"] > 0 > weights["exp_gap"] and weights["loc_match"] == pytest.approx(0)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_index(spark, tmp_path, metric):
    rnd = np.random.default_rng(8)
    middle = rnd.normal(size=(12, 8)) * 4
    rows = [(i, [float(np.float32(x)) for x in middle[i % 12] + rnd.normal(size=8)], i % 3) for i in range(600)]
    rows += [(1000, None, 0), (1001, rows[5][1], 0), (1002, rows[5][1], 0)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("away", F.lit("clash")).drop("away")
    queries = corpus.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    true = retrieval.vector_topk(queries, corpus, 5, metric=metric)
    index = vector_index.build_index(corpus, str(tmp_path / "index"), lists=20, rows=200, metric=metric)
    assert spark.read.parquet(index.path).count() == 602 and len(index.centroids) == 20
    want = sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in true.collect())
    assert len(want) == 30 * 5  # the query without a vector finds nothing
    for probes, block in ((1, 7), (4, 2000)):
        got = vector_index.search(queries, index, 5, probes=probes, exact=True, block_rows=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got) == want
    hits = vector_index.recall(vector_index.search(queries, index, 5, probes=6), true).agg(F.sum("n_found") / F.sum("n_true")).first()[0]
    assert hits >= 0.9
    nothing = vector_index.build_index(corpus.limit(0), str(tmp_path / "nothing"))
    assert vector_index.search(queries, nothing, 5).count() == 0 and vector_index.search(queries.limit(0), index, 5, exact=True).count() == 0


@pytest.mark.parametrize("matched", [[], ["label"]])
def test_nearest_equals_brute_force(spark, matched):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=6)], i % 3) for i in range(90)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    queries = corpus.withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieval.vector_topk(queries, corpus, 4, match_on=matched, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    m = np.array([r[1] for r in rows])
    for q, _, label in rows:
        d = np.round(((m - m[q]) ** 2).sum(axis=1), 6)
        order = [i for i in np.lexsort((np.arange(90), d)) if not matched or i % 3 == label]
        assert got[q] == order[:4]


@pytest.mark.parametrize("matched", [[], ["label"]])
def test_many_queries_stay_off_the_driver(spark, matched, monkeypatch):
    corpus = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"), (F.col("id") % 3).alias("label"))
    gathered, kind = [], type(corpus)
    collect = kind.collect

    def counted(df):
        rows = collect(df)
        gathered.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    hits = retrieval.vector_topk(corpus.withColumnRenamed("vec_id", "query_id"), corpus, 2, match_on=matched, block_rows=16)
    assert sum(gathered) <= 17
    monkeypatch.undo()
    assert hits.groupBy("query_id").count().where("count = 2").count() == 200


def test_rows_of_one_id_keep_classes_of_their_own(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (None, "gamma"), (None, "alpha"), (2, None)], "doc_id long, text string")
    kinds = spark.createDataFrame([(0, "a", "alpha beta"), (1, "g", "gamma delta")], "cluster_id int, cluster_label string, text string")
    got = classify.classify_by_prototype(docs, kinds, stop=[]).collect()
    assert {(r["doc_id"], r["text"], r["cluster_id"]) for r in got} == {
        (1, "alpha beta", 0), (1, "gamma delta", 1), (None, "gamma", 1), (None, "alpha", 0), (2, None, 0)}
    assert len(got) == 5


def test_classification_prefers_shared_terms(spark):
    docs = spark.createDataFrame([(1, "spark kafka etl pipeline"), (2, "payroll and recruitment"), (3, "zzz")], "doc_id int, text string")
    got = {r["doc_id"]: r["cluster_id"] for r in classify.classify_by_prototype(docs, classify.cluster_prototypes(spark)).collect()}
    assert got == {1: 4, 2: 16, 3: 0}


def test_intents_and_roles(spark):
    asked = spark.createDataFrame([(1, "what skills raise my pay"), (2, "senior data scientist jobs in Pune"), (3, "How do I become a tide watcher in Goa?")], "question_id int, text string")
    roles = spark.createDataFrame([("data scientist",), ("scientist",)], "role string")
    got = {r["question_id"]: (r["role"], r["location"], r["intent"]) for r in routing.route_questions(asked, roles).collect()}
    assert got[1][2] == "skills"
    assert got[2] == ("data scientist", "pune", "general")
    assert got[3] == ("tide watcher", None, "career_path")


def test_history_crosses_blocks(spark):
    turns = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(40)], "conv_id int, turn int, role string, text string")
    got = {r["turn"]: [h["turn"] for h in r["history"]] for r in routing.history_window(turns, block=16).collect()}
    assert got == {t: list(range(max(0, t - 10), t)) for t in range(40)}


def test_quota_takes_whole_pages(spark):
    pages = spark.createDataFrame([("r", "g", p, 30) for p in (1, 2, 3)], "role string, location_group string, page int, n_new int")
    assert sorted(r["page"] for r in crawl.quota_per_pair(pages).collect()) == [1, 2]


def test_positions_are_dense(spark):
    docs = spark.createDataFrame([(f"d{i}", "f" if i % 3 else "g") for i in range(50)], "doc_id string, source_file string")
    got = {}
    for r in index.batch_documents(docs, 10).collect():
        got.setdefault(r["source_file"], []).append(r["position"])
    assert {k: sorted(v) for k, v in got.items()} == {"f": list(range(33)), "g": list(range(17))}


def test_upsert_is_idempotent(spark, tmp_path):
    rows = [("u1", "t", "c", ["A"], "f1", 1), ("u2", "t", "c", ["B"], "f1", 2)]
    batch = spark.createDataFrame(rows, "job_url string, job_title string, company string, location array<string>, source_file string, row_no bigint")
    path = str(tmp_path / "table")
    assert ingest.upsert_batch(batch, path) == 1
    later = batch.withColumn("location", F.array(F.lit("C"))).withColumns({"source_file": F.lit("f0"), "job_title": F.lit("later")})
    for _ in range(2):  # a replay, as after a lost or new checkpoint
        ingest.upsert_batch(later, path)
    got = {r["job_url"]: (r["location"], r["job_title"]) for r in ingest.read_version(spark, path).collect()}
    assert got == {"u1": (["A", "C"], "t"), "u2": (["B", "C"], "t")}
    assert {r["job_url"]: r["location"] for r in ingest.read_version(spark, path, 1).collect()} == {"u1": ["A"], "u2": ["B"]}
    one = spark.createDataFrame([("u9", "t", "c", ["Z"], "f3", 1)], batch.schema)
    version = ingest.upsert_batch(one, path)
    held = ingest.manifest(spark, path, version)
    assert [v for v in held.values()].count(version) == 1 and ingest.upsert_batch(one.limit(0), path) == version


LANDED = ["job_url", "job_title", "company", "location", "job_description", "scraped_date"]


def test_stream_takes_what_the_batch_reader_takes(spark, tmp_path):
    """Three layouts, quoted line breaks, a field of 200,000 characters, an empty file, a replay and a late file."""
    landing = tmp_path / "landing"
    landing.mkdir()
    rows = [{"job_url": f"https://x/{i}?q=1", "job_title": f"Data, \"Analyst\" {i}", "company": "Comp\nany", "location": "Pune",
             "job_description": "word " * (40_000 if i == 3 else 3), "scraped_date": "2024-01-0%d" % (i % 9 + 1)} for i in range(12)]

    def land(name, columns, some):
        with open(landing / name, "w", newline="") as f:
            out = csv.DictWriter(f, columns, extrasaction="ignore")
            out.writeheader()
            out.writerows(some)

    land("a.csv", LANDED, rows[:5])
    land("b.csv", LANDED[::-1], rows[3:9])
    (landing / "empty.csv").write_text("")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    run = lambda: ingest.ingest_stream(ingest.landed_files(spark, str(landing), 1), table, checkpoint).awaitTermination()
    run()
    run()
    land("c.csv", LANDED[2:] + LANDED[:2], rows[7:])
    run()
    got = spark.read.parquet(table)
    want = ingest.clean_rows(read_raw_postings(spark, str(landing)))
    assert sorted(r.job_url for r in got.collect()) == sorted(r.job_url for r in want.select("job_url").distinct().collect())
    assert got.count() == 12 and got.agg(F.max(F.length("job_description"))).first()[0] == 199_999
    assert {r.company for r in got.collect()} == {"Comp any"}
    assert spark.read.parquet(f"{table}/_files").count() == 3
    number = spark.read.parquet(f"{table}/_files").where("path LIKE '%c.csv'").first().batch
    ingest.ingest_batch(ingest.clean_rows(read_raw_postings(spark, str(landing / "c.csv"))), table, number)  # a replay
    assert spark.read.parquet(table).count() == 12
    base = str(tmp_path / "versions")
    ingest.upsert_stream(ingest.landed_files(spark, str(landing)), base, str(tmp_path / "c2")).awaitTermination()
    assert ingest.read_version(spark, base).count() == 12


def test_crawl_folds_once_however_often_it_runs(spark):
    none = spark.createDataFrame([], crawl.STATE)
    pages = [("a", "g", p, 5, 1) for p in (1, 2, 3)] + [("b", "g", 1, 9, 4), ("b", "g", 2, 9, 4), ("b", "g", 3, 9, 4)]
    pages += [("c", "g", 1, 3, 2), ("c", "g", 2, 0, 0), ("c", "g", 3, 7, 7), ("d", "g", 1, 1, 1), ("d", "g", 4, 1, 1)]
    pages = spark.createDataFrame(pages, "role string, location_group string, page int, n_cards long, n_new long")
    whole = crawl.fold_pages(none, pages, quota=6, max_pages=4)
    got = {r.role: (r.page, r.n_new, r.status) for r in whole.collect()}
    assert got == {"a": (3, 3, "open"), "b": (2, 8, "quota"), "c": (2, 2, "dry"), "d": (4, 2, "page limit")}
    state = none
    for upto in (1, 2, 2, 3, 3, 4):
        state = crawl.fold_pages(state, pages.where(F.col("page") <= upto), quota=6, max_pages=4).checkpoint()
    assert {r.role: (r.page, r.n_new, r.status) for r in state.collect()} == got
    roles, done = spark.createDataFrame([(x,) for x in "abcdef"], "role string"), spark.createDataFrame([("f", "g")], "role string, location_group string")
    blocks = crawl.low_yield(pages, 3)
    plan = lambda s: sorted((r.role, r.page) for r in crawl.crawl_frontier(roles, done, s, {"g": ["G"]}, blocks, max_pages=20).collect())
    assert plan(whole) == [("a", 4), ("e", 1)]  # three new postings in the first block: no second one
    blocks = crawl.low_yield(pages, 3, threshold=4)
    assert plan(whole) == [("a", 4), ("a", 5), ("a", 6), ("e", 1)]
    more = pages.unionByName(pages.limit(1).selectExpr("'a' role", "'g' location_group", "6 page", "5L n_cards", "0L n_new"))
    blocks = crawl.low_yield(more, 3, threshold=4)
    assert plan(crawl.fold_pages(whole, more, quota=6, max_pages=20)) == [("a", 7), ("d", 5), ("e", 1)][:1] + [("e", 1)]


def test_a_build_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    raw, base = tmp_path / "raw", str(tmp_path / "base")
    raw.mkdir()

    def land(name, ids):
        with open(raw / name, "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(LANDED)
            out.writerows([f"https://x/{i}", f"Job {i}", "C", "Pune", f"needs sql and word{i % 3} text", "2024-01-01"] for i in ids)

    dictionary = spark.createDataFrame([("sql",)], "skill string")
    prototypes = spark.createDataFrame([(0, "A", "sql text"), (1, "B", "word1 word2")], "cluster_id int, cluster_label string, text string")
    run = lambda: build.full_build(spark, str(raw), base, dictionary, prototypes, stop=[])
    urls = lambda part, key="job_url": sorted(r[0] for r in build.read_build(spark, base, part).select(key).collect())
    land("a.csv", range(6))
    assert build.read_build(spark, base, "cleaned") is None and run().first()["new_records"] == 6
    first = [f"https://x/{i}" for i in range(6)]
    land("b.csv", range(4, 9))
    for broken in ("cluster_table", "commit"):
        with monkeypatch.context() as m:
            m.setattr(build, broken, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                run()
        assert urls("cleaned") == urls("clustered") == urls("index", "doc_id") == first
    assert run().first()["new_records"] == 3 and not run().first()["should_update"]
    assert urls("cleaned") == urls("clustered") == urls("index", "doc_id") == [f"https://x/{i}" for i in range(9)]
    assert {"pca_x", "pca_y"} <= set(build.read_build(spark, base, "clustered").columns)


def test_scan_holds_few_distances_at_once(spark, monkeypatch):
    draw = random.Random(5)
    vectors = [[float(draw.randint(0, 3)) for _ in range(3)] for _ in range(90)]
    corpus = spark.createDataFrame([(n, n % 2, v) for n, v in enumerate(vectors)], "vec_id long, kind int, embedding array<double>").coalesce(1)
    queries = corpus.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    for matched in ([], ["kind"]):
        whole = retrieval.vector_topk(queries, corpus, 4, match_on=matched).collect()
        with monkeypatch.context() as patch:
            patch.setattr(retrieval, "MAX_DISTANCES", 63)  # seven rows of nine queries
            assert sorted(retrieval.vector_topk(queries, corpus, 4, match_on=matched).collect()) == sorted(whole)
        for q in range(0, 90, 10):
            near = sorted((sum((a - b) ** 2 for a, b in zip(vectors[q], v)), n) for n, v in enumerate(vectors) if not matched or n % 2 == q % 2)
            assert sorted((r["distance"], r["vec_id"]) for r in whole if r["query_id"] == q) == near[:4]


def test_salary_forest_does_not_depend_on_how_rows_are_dealt(spark):
    rows = [(f"u{i}", float(i % 7) if i % 11 else None, 5.0 + i % 7 + 2 * (i % 4) + (i % 3) / 10, ["A", "B", "C"][: 1 + i % 3], f"Cluster {i % 4}") for i in range(400)]
    jobs = spark.createDataFrame(rows, "job_url string, experience_min double, salary_mid double, skills_list array<string>, cluster_label string")
    people = spark.createDataFrame([("a", 1, ["A"], "Cluster 1"), ("b", 6, ["A", "B"], "Cluster 3"), ("c", None, None, "new")],
                                   "profile_id string, years_experience int, skills array<string>, cluster_label string")
    found = []
    for dealt in (jobs.coalesce(1), jobs.repartition(7, "job_url")):
        model = salary.train_salary_model(dealt, trees=6)
        assert len(model.trees) == 6 and abs(model.importances().sum() - 1) < 1e-9
        found.append({r["profile_id"]: r["predicted_salary"] for r in salary.predict_salary(people, model).collect()})
    assert found[0] == found[1]
    assert abs(found[0]["a"] - 8.1) < 1 and abs(found[0]["b"] - 17.1) < 1 and 5 <= found[0]["c"] <= 18


def test_match_of_postings_that_tie_with_the_last_one(spark):
    # Lists hold more ties than k, URLs rise against the order of skills, and some skills are in no profile.
    jobs = [(f"u{(i * 37) % 90:02d}", "Data Analyst", ["Pune", "Goa"][i % 2 :], float(i % 2), ["a", "b", "c", "x"][i % 3 : i % 3 + 1 + i % 2], ["PhD"] * (i % 5 == 0)) for i in range(90)]
    users = [("p", "analyst", 1, ["PhD"], ["A", "b"], ["pune", "goa"]), ("q", "analyst", 0, [], ["c", "zz"], []), ("r", "analyst", 9, [], [], ["goa"])]
    people, posts = spark.createDataFrame(users, USER), spark.createDataFrame(jobs, JOB)
    want, _ = brute(people, posts, 4)
    got = {}
    for r in match.match_profiles(people, posts, k=4).orderBy("profile_id", "rank").collect():
        got.setdefault(r["profile_id"], []).append((-r["match_score"], r["job_url"]))
    assert got == want


def test_keywords_read_the_classes_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(1, 0, "spark joins"), (2, 0, "spark spark"), (3, 1, "cake oven")], "doc_id long, cluster_id int, text string")
    protos = spark.createDataFrame([(0, "spark"), (1, "cake"), (2, "lone")], "cluster_id int, text string")
    found = classify.cluster_keywords(rows.mapInArrow(seen, rows.schema), protos, stop=[], n=1).collect()
    assert sorted((r["cluster_id"], r["term"]) for r in found) == [(0, "spark"), (1, "cake oven"), (2, "no_data")]
    assert read.value == 3


def test_nearest_rows_in_slices(monkeypatch):
    draw = np.random.default_rng(4)
    q, d = draw.integers(0, 4, (30, 3)).astype(float), draw.integers(0, 4, (80, 3)).astype(float)
    d[7] = np.nan
    ids = draw.permutation(80)
    monkeypatch.setattr(retrieval, "MAX_DISTANCES", 100)
    got = retrieval.nearest_rows(np.arange(30), q, ids, d, 5, "l2", "query_id", "vec_id")
    for n in range(30):
        near = sorted((((q[n] - v) ** 2).sum(), i) for i, v in zip(ids, d) if not np.isnan(v).any())[:5]
        mine = got[got.query_id == n]
        assert list(zip(mine.distance, mine.vec_id)) == near
    assert len(retrieval.nearest_rows(np.arange(0), q[:0], ids, d, 5, "l2", "query_id", "vec_id")) == 0


def test_cells_of_large_sides_grow(spark):
    rows = spark.range(1200)
    copies = lambda **kw: [t.count() for t in in_cells(rows, rows.withColumnRenamed("id", "other"), [], "id", "other", 10, **kw)[:2]]
    assert copies() == [1200 * 120] * 2
    assert copies(pieces=8, most_rows=1000) == [1200 * 8] * 2
    assert copies(pieces=8, most_rows=100) == [1200 * 12] * 2


ASKED = ["r1_vector_topk", "r1_vector_topk_cells", "r2_vector_topk_filtered", "r3_retrieve_with_sources", "w5_rank_sources"]


@pytest.mark.parametrize("name", ASKED)
def test_every_vector_is_asked(spark, tmp_path, name):
    rows = [(i, [float(i % 7), float(i // 7)], i % 2) for i in range(1, 40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["query_id"] for r in QUERIES[name](spark, str(tmp_path)).select("query_id").collect()} == set(range(1, 40))


def test_vocabulary_of_frequent_words(spark, monkeypatch):
    draw = random.Random(2)
    texts = [" ".join(draw.choices(["aa", "bb", "cc", "dd", "ee", "ff"], [9, 7, 5, 2, 1, 1], k=draw.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    tf, seen = {}, {}
    for text in texts:
        words = [w for w in text.split() if w != "dd"]
        own = [*words, *map(" ".join, zip(words, words[1:]))]
        for t in own:
            tf[t] = tf.get(t, 0) + 1
        for t in set(own):
            seen[t] = seen.get(t, 0) + 1
    for size in (3, 5, 500):  # as many words as features or fewer
        best = sorted(tf, key=lambda t: (-tf[t], t))[:size]
        want = {t: pytest.approx(np.log(62 / (1 + seen[t])) + 1) for t in best}
        for most in (10_000, 2):
            monkeypatch.setattr(classify, "MAX_WORDS", most)
            assert {r["term"]: r["idf"] for r in classify.vocabulary(df, size, ["dd"]).collect()} == want
    made = classify._frequent_pairs(classify.terms(F.col("text"), ["dd"], False), ["aa", "bb"])
    pairs = {p for r in df.select(made.alias("p")).collect() for p in r["p"]}
    assert pairs == {f"{a} {b}" for a in ("aa", "bb") for b in ("aa", "bb")}


def test_rows_are_classified_where_they_are(spark, monkeypatch):
    draw = random.Random(6)
    text = lambda: " ".join(draw.choices([f"w{i:02d}" for i in range(30)], k=draw.randint(0, 9)))
    docs = spark.createDataFrame([(i // 2 if i % 9 else None, text(), i) for i in range(80)], "doc_id int, text string, n int")
    kinds = spark.createDataFrame([(i, f"K{i}", text() + " w00") for i in range(7)], "cluster_id int, cluster_label string, text string")
    inside = classify.classify_by_prototype(docs, kinds, stop=[])
    assert "hashpartitioning" not in inside._jdf.queryExecution().executedPlan().toString()  # no row is shuffled
    compared = classify.similarities(docs, kinds, stop=[]).collect()
    found = inside.collect()
    assert sorted(r["n"] for r in found) == list(range(80))
    monkeypatch.setattr(classify, "MAX_PROTOTYPES", 3)
    joined = classify.classify_by_prototype(docs, kinds, stop=[])
    assert joined.columns == inside.columns and sorted(joined.collect(), key=lambda r: r["n"]) == sorted(found, key=lambda r: r["n"])
    assert sorted(classify.similarities(docs, kinds, stop=[]).collect()) == sorted(compared)


def test_points_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "cc"), (2, "aa aa"), (None, "bb"), (None, None), (3, "")], "doc_id int, text string")
    got = classify.tfidf_pca(docs, stop=[]).collect()
    at = lambda i: {(round(r["pca_x"], 9), round(r["pca_y"], 9)) for r in got if r["doc_id"] == i}
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "None", "None"]
    assert len(at(1)) == 1 and at(None) == at(3) and len(at(1) | at(2) | at(3)) == 3


def test_frequent_sets_equal_brute_force(spark, monkeypatch):
    draw = random.Random(9)
    pool = ["É", "Aa", "B", "Cc", "D", "Ee", "Z"]
    lists = [draw.sample(pool, min(len(pool), draw.choice([0, 1, 2, 3, 5, 7]))) for _ in range(150)] + [["Aa", "B", "Cc", "D"]] * 12 + [None]
    jobs = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "job_url int, skills_list array<string>")
    filled = [frozenset(x) for x in lists if x]
    want = {}
    for size in range(1, 8):
        for items in combinations(sorted(pool), size):
            n = sum(set(items) <= x for x in filled)
            if n >= 0.1 * len(filled):
                want[items] = (n, len(filled))
    assert max(map(len, want)) >= 4
    read = lambda: {tuple(r["items"]): (r["freq"], r["n_baskets"]) for r in associations.frequent_skill_sets(jobs, 0.1).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(associations, "FPGrowth", None)  # no trees for few candidates
        patch.setattr(associations, "CHUNK", 20)
        assert read() == want
        assert associations.frequent_skill_sets(jobs.limit(0), 0.1).count() == 0
    monkeypatch.setattr(associations, "MAX_CANDIDATES", 9)
    assert read() == want
