import datetime as dt
import glob
import time

from pyspark.sql import functions as F

from catalog import service_queries
from jobtide.functions import text as tx
from jobtide.operators import clean, skills
from jobtide.session import DROP_SHUFFLES, cut_lineage
from jobtide.sources import dictionary as dic
from jobtide.sources import postings as src


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    assert values(spark, ["<b>C++</b> Dev\n (R&D)", None, "é–à  x"], tx.clean_text) == ["C Dev R&D", "", "éà x"]


def test_locations(spark):
    rows = [["Navi Mumbai"], ["Delhi/NCR"], None, ["Bengaluru", "Bangalore"], ["Mumbai, Pune"], ["pune"]]
    got = values(spark, rows, tx.standard_location, "array<string>")
    assert got == [["Mumbai"], ["Delhi/ncr"], ["Other"], ["Bangalore"], ["Mumbai"], ["Pune"]]


def test_text_lists(spark):
    assert values(spark, ["['a', 'b']", "Pune", None], tx.text_list) == [["a", "b"], ["Pune"], None]


def test_experience(spark):
    got = values(spark, ["2-5 years", "5+ years", "N/A", None], tx.experience_range)
    assert [(r["min"], r["max"]) for r in got] == [(2, 5), (5, 7), (0, 0), (0, 0)]


def test_salary(spark):
    rows = ["15-25 Lacs PA", "500,000 - 800,000", "15 LPA", "Not Disclosed", "not disclosed", "", None]
    got = values(spark, rows, tx.salary_range)
    assert [(r["min"], r["max"]) for r in got] == [(15, 25), (5, 8), (15, 15)] + [(None, None)] * 4


def test_level(spark):
    rows = [1.9, 2.0, 5.0, 10.0, None]
    assert values(spark, rows, tx.experience_level, "double") == ["Entry Level", "Mid Level", "Senior Level", "Lead/Principal", "Lead/Principal"]


def test_normalized_skills(spark):
    got = values(spark, ["['AWS', 'a/b testing', 'aws ']", "node.js, master's"], lambda c: tx.normalize_skills(tx.skill_text_list(c)))
    assert got == [["A/B Testing", "Aws"], ["Master'S", "Node.Js"]]


def test_education(spark):
    rows = ["To be considered", "B.E. or MBA", "Bachelors, ph.d"]
    assert values(spark, rows, tx.education) == [[], ["B.Tech/B.E", "MBA"], ["Bachelor's", "PhD"]]
    assert values(spark, rows[:1], lambda c: tx.education(c, compat=True)) == [["B.Tech/B.E"]]


def docs(spark):
    return spark.createDataFrame(
        [(1, "SQL and SAS, machine learning"), (2, "Machine\nLearning, c++ javascript"), (3, ""), (4, "Java; R & a/b testing")],
        "doc_id int, text string")


EXPECTED = {1: ["Machine Learning", "SQL"], 2: ["C++", "JavaScript"], 3: [], 4: ["A/B Testing", "Java"]}


def test_skills_in_rows_and_by_join(spark):
    extra = spark.createDataFrame([("C++ x",), ("SAS",)], "skill string")
    words = dic.skill_dictionary(dic.builtin_skills(spark), extra)
    wanted = {k: [s for s in v if s != "C++"] for k, v in EXPECTED.items()}
    rows = skills.extract_skills(docs(spark), words, "doc_id", "text").collect()
    assert {r["doc_id"]: r["skills_extracted"] for r in rows} == wanted
    pairs = {(r["doc_id"], r["skill"]) for r in skills.match_dictionary(docs(spark), words, "doc_id", "text").collect()}
    assert pairs == {(k, s) for k, v in wanted.items() for s in v}


def test_skill_without_word_edges(spark):
    words = spark.createDataFrame([("F# x.",), (".Net core",)], "skill string")
    texts = spark.createDataFrame([(1, "asp.Net Core and F# x.y")], "doc_id int, text string")
    assert skills.extract_skills(texts, words, "doc_id", "text").first()["skills_extracted"] == [".Net core", "F# x."]
    assert skills.match_dictionary(texts, words, "doc_id", "text").count() == 2


def test_dictionary_spellings(spark):
    master = spark.createDataFrame([("Java Programming",), ("SEO tools",)], "skill string")
    names = [r["skill"] for r in dic.skill_dictionary(master.limit(0), None, master).collect()]
    assert names == ["Java Programming", "SEO tools", "Java", "SEO"]


MERGE = "job_url string, job_title string, company string, location array<string>, source_file string, row_no bigint"


def test_merge_takes_first_filled_and_unites_locations(spark):
    rows = [("u", None, "c", ["B"], "f1", 1), ("u", "t2", "d", ["A"], "f1", 2), ("", "x", "y", ["C"], "f1", 3), (None, "z", "y", ["D"], "f1", 4)]
    df = spark.createDataFrame(rows, MERGE)
    got = {(r["job_url"], r["job_title"], r["company"], tuple(r["location"])) for r in clean.merge_duplicates(df).collect()}
    assert got == {("u", "t2", "c", ("A", "B")), ("", "x", "y", ("C",)), ("", "z", "y", ("D",))}
    assert clean.merge_duplicates(df, compat=True).count() == 2


def test_merge_ignores_row_order_and_partitions(spark):
    rows = [(f"u{i % 7}", f"t{i}", "c", [f"L{i % 3}"], f"f{i % 2}", i) for i in range(200)]
    df = spark.createDataFrame(rows, MERGE)
    a = sorted(map(str, clean.merge_duplicates(df.repartition(1)).collect()))
    assert a == sorted(map(str, clean.merge_duplicates(df.orderBy(F.rand(1)).repartition(9)).collect()))


def test_cleaning_job_on_sample(spark):
    rows = [
        ("Product Manager", "Flipkart", "Bengaluru", "2-5 years", "15-25 Lacs PA", "Looking for Python and SQL skills.", "2026-02-11 12:00:00"),
        ("Data Analyst II", "Amazon", "Gurgaon", "5+ years", "Not Disclosed", "Need Tableau and Stakeholder Management.", "2026-01-11 12:05:00"),
    ]
    raw = spark.createDataFrame(rows, "job_title string, company string, location string, experience_required string, salary string, job_description string, scraped_date string")
    raw = raw.withColumn("job_url", F.concat(F.lit("u"), "company"))
    raw = raw.withColumns({"source_file": F.lit("f"), "row_no": F.lit(1)})
    now = F.lit(dt.datetime(2026, 2, 12))
    got = clean.clean_postings(raw, dic.builtin_skills(spark), now).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["location"], row["experience_min"], row["salary_mid"], row["skills_extracted"], row["num_skills"]) == (["Bangalore"], 2.0, 20.0, ["Python", "SQL"], 2)


def test_resume_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("MBA, Python")
    (tmp_path / "b.txt").write_text("")
    facts = src.resume_facts(src.read_resumes(spark, str(tmp_path)), dic.builtin_skills(spark)).collect()
    assert [(r["skills"], r["education"], r["char_count"]) for r in facts] == [(["Python"], ["MBA"], 11)]


def test_raw_files_bind_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('job_title,company,job_url,experience_required,extra\nDev,"A, Inc.",u1,1-2,x\n"Two\nlines",B,u2,,\n')
    (tmp_path / "b.csv").write_text("﻿job_url,salary,job_title\nu3,5 LPA,Ops\n")
    (tmp_path / "c.csv").write_text("experience_required,job_title,source_file,row_no,job_url\n3+ years,QA,old.csv,7,\n")
    (tmp_path / "d.csv").write_text("")
    rows = {r["job_title"]: r for r in src.read_raw_postings(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Dev", "Two\nlines", "Ops", "QA"}
    dev, ops, qa = rows["Dev"], rows["Ops"], rows["QA"]
    assert (dev["company"], dev["experience_required"], dev["job_url"], dev["source_file"], dev["salary"], dev["extra"]) == ("A, Inc.", "1-2", "u1", "a.csv", None, "x")
    assert (ops["job_url"], ops["salary"], ops["source_file"]) == ("u3", "5 LPA", "b.csv") and (qa["source_file"], qa["row_no"]) == ("old.csv", 7)
    assert dev["row_no"] < rows["Two\nlines"]["row_no"]


def test_postings_without_url_keep_their_identity(spark):
    rows = [(None, "Dev", "A", ["x"], "Python here"), ("", "Ops", "B", ["y"], "Java here"), ("u?a=1", "QA", "C", None, "SQL"), ("u", "QA2", "C", ["z"], "")]
    raw = spark.createDataFrame(rows, "job_url string, job_title string, company string, location array<string>, job_description string")
    raw = raw.withColumn("scraped_date", F.current_timestamp()).withColumns({"experience_required": F.lit("1"), "salary": F.lit("")})
    got = {r["job_title"]: r for r in clean.clean_postings(raw, dic.builtin_skills(spark)).collect()}
    assert len(got) == 3 and len({r["job_id"] for r in got.values()}) == 3
    assert got["Dev"]["skills_extracted"] == ["Python"] and got["Ops"]["skills_extracted"] == ["Java"]


def test_both_ways_of_extraction_agree(spark, monkeypatch):
    rows = [(None, "python C++"), (None, "java"), ("u", "C++ and +++"), ("u", "a+++b"), (None, None)]
    texts = spark.createDataFrame(rows, "job_url string, text string")
    words = spark.createDataFrame([("python",), ("java",), ("C++ and",), ("+++",), ("and",)], "skill string")
    both = []
    for bound in (5000, 2):
        monkeypatch.setattr(skills, "MAX_LITERAL_SKILLS", bound)
        both.append(sorted((str(r["text"]), r["skills_extracted"]) for r in skills.extract_skills(texts, words, "job_url", "text").collect()))
    assert both[0] == both[1] and dict(both[0])["java"] == ["java"]


def test_first_is_never_random(spark):
    rows = [("u", f"t{i}", "c", ["A"], None, None) for i in range(40)]
    df = spark.createDataFrame(rows, MERGE)
    seen = {clean.merge_duplicates(df.orderBy(F.rand(n)).repartition(n)).first()["job_title"] for n in range(1, 6)}
    assert len(seen) == 1


def test_append_twice_adds_nothing(spark, tmp_path):
    rows = [("v1", "t", "c"), ("v1", "t", "c"), ("v1?x=2", "t9", "c"), (None, "a", "b"), (None, "a", "b"), (None, "z", "b")]
    batch = spark.createDataFrame(rows, "job_url string, job_title string, company string")
    for _ in range(2):
        src.append_processed(batch, str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_second_append_sorts_out_new_rows_only(spark, tmp_path, monkeypatch):
    batch = spark.createDataFrame([(f"v{n % 5}", f"t{n}", "c") for n in range(20)], "job_url string, job_title string, company string")
    seen, whole = [], clean.drop_duplicate_urls
    monkeypatch.setattr(clean, "drop_duplicate_urls", lambda df, *a, **k: (seen.append(df.count()), whole(df, *a, **k))[1])
    src.append_processed(batch.where("job_url < 'v3'"), str(tmp_path / "t"))
    src.append_processed(batch, str(tmp_path / "t"))
    assert seen == [12, 8]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_first_row_with_fewer_columns_is_the_same_row(spark):
    rows = [(f"v{n % 4}", f"t{n}", "f", 1, n * 7 % 5) for n in range(40)]
    df = spark.createDataFrame(rows, "job_url string, job_title string, source_file string, row_no long, extra int")
    whole = clean.drop_duplicate_urls(df).select("job_url", "job_title")
    kept = clean.drop_duplicate_urls(df, keep=["job_url", "job_title"])
    assert kept.columns == ["job_url", "job_title"]
    assert sorted(kept.collect()) == sorted(whole.collect())


def test_texts_are_landed_as_files_by_the_tasks(spark, tmp_path):
    from catalog.tables import land_texts

    rows = [(1, "a\nb"), (2, None), (3, "x"), (3, "x"), (4, "")]
    land_texts(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/texts")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in src.read_resumes(spark, f"{tmp_path}/texts").collect()}
    assert got == {"doc_id=1.txt": "a\nb\n", "doc_id=2.txt": "\n", "doc_id=3.txt": "x\nx\n", "doc_id=4.txt": "\n"}
    assert not list(tmp_path.rglob("*.crc"))  # no file went through Hadoop's local file system


def test_raw_postings_meet_their_orders_last(spark, tmp_path):
    from catalog.tables import raw_postings

    tables = {
        "nation": ([(0, "PERU")], "n_nationkey int, n_name string"),
        "supplier": ([(7, 0)], "s_suppkey long, s_nationkey int"),
        "part": ([(3, "blue anvil")], "p_partkey long, p_name string"),
        "customer": ([(5, "C5", 0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": ([(1, 5), (2, 9)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(1, n, 3, 7, 6.0, "A", "2024-01-01") for n in (1, 2)] + [(2, 1, 3, 7, 6.0, "A", "2024-01-01"), (1, 3, 4, 7, 6.0, "A", "2024-01-01")],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    raw = raw_postings(spark, str(tmp_path))
    got = sorted((r["job_url"], r["company"], r["location"], r["skills_list"]) for r in raw.collect())
    assert got == [(f"https://jobs.example/1?src={n}", "C5", ["Bengaluru"], ["blue anvil"]) for n in (1, 2)]
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join " in line)
    assert "l_orderkey" in last and "o_orderkey" in last


def test_merging_sorts_by_a_hash_of_the_key(spark):
    rows = [("u", "", 1), ("u", "a", 2), ("v", None, 1), (None, "t", 1), ("", "t", 2)]
    df = spark.createDataFrame(rows, "job_url string, job_title string, row_no int").withColumn("company", F.lit("c"))
    merged = clean.merge_duplicates(df)
    assert sorted((r["job_url"], r["job_title"] or "", r["row_no"]) for r in merged.collect()) == [("", "t", 1), ("u", "a", 1), ("v", "", 1)]
    assert "xxhash64(_key" in merged._jdf.queryExecution().optimizedPlan().toString()


def test_title_case_of_single_words(spark):
    rows = ["FOO", "foo,", "a/b testing", "k8s", "ßa", "İx", "(foo)", "x-ray", "foo bar", "ab 1.", "", "ⓐb", None]
    got = values(spark, rows, tx.title_case)
    assert got == ["Foo", "Foo,", "A/B Testing", "K8S", "Ssa", "İX", "(Foo)", "X-Ray", "Foo Bar", "Ab 1.", "", "ⒶB", None]


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        return {str(b) for b in (lambda found: [found.apply(i) for i in range(found.size())])(blocks.getAllBlocks()) if str(b).startswith("shuffle")}

    setting = spark.conf.get(DROP_SHUFFLES)
    rows = spark.range(5000).withColumn("k", F.xxhash64("id") % 97).groupBy("k").agg(F.sum("id").alias("s"))
    before = left()
    kept = cut_lineage(rows)
    src.write_processed(rows, str(tmp_path / "table"))
    for _ in range(50):  # files go in the background
        if left() <= before:
            break
        time.sleep(0.2)
    assert left() <= before
    assert sorted(kept.collect()) == sorted(rows.collect()) == sorted(spark.read.parquet(str(tmp_path / "table")).collect())
    assert spark.conf.get(DROP_SHUFFLES) == setting
    assert left() - before  # of the frame that was run without


def test_landed_files_are_compressed(spark, tmp_path, monkeypatch):
    rows = [(f"https://x/{i}?src={i}", f"Title {i}", "Firm", "1-2 yrs", "5 LPA", "Long, \"quoted\"\ntext", "2024-01-01 00:00:00", "portal", "f.csv", i, 1, "C", ["Pune"], ["A", "B"])
            for i in range(9)]
    kinds = ("job_url string, job_title string, company string, experience_required string, salary string, job_description string, scraped_date string, "
             "source string, source_file string, row_no long, cluster_id int, cluster_label string, location array<string>, skills_list array<string>")
    monkeypatch.setattr(service_queries, "raw_postings", lambda spark, sf: spark.createDataFrame(rows, kinds))
    path = service_queries._landed(spark, "")
    files = [f for f in glob.glob(f"{path.removeprefix('file://')}/part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    back = src.read_raw_postings(spark, path).collect()
    assert sorted((r["job_url"], r["job_description"], r["location"]) for r in back) == sorted((r[0], r[5], r[-2]) for r in rows)
