"""Sources, index, retrieval, routing, streaming and composed queries."""

from pyspark.sql import functions as F

from catalog.clean_queries import DICTIONARY_SQL, HITS_SQL, _sql_education, phrase_dictionary
from catalog.market_queries import ALIGN_SQL, P, REQUESTS, REQUESTS_SQL, ROLES, ROLES_SQL, requests, roles
from catalog.match_queries import GAP_SQL, STOP, TOKENS_SQL
from catalog.registry import query
from catalog.tables import POSTINGS_SQL, PROFILES_SQL, RAW_SQL, full_postings, land_texts, postings, profiles, raw_postings, stored_postings, sql_city, sql_clean, sql_title, table
from jobtide import dims
from jobtide.functions import text as tx
from jobtide.operators import clean, filters, index, market, retrieval, routing, vector_index
from jobtide.operators.locations import known_roles
from jobtide.plans import build, reports
from jobtide.session import cut_lineage, dropped_shuffles, scratch_path
from jobtide.sources import dictionary as dic
from jobtide.sources import pages as pg
from jobtide.sources import postings as src
from jobtide.sources import state as st
from jobtide.streaming import crawl, ingest

# ------------------------------------------------------------------- sources


def _landed(spark, sf):
    """Raw postings as CSV files of three layouts: other orders, and columns left out."""
    path = scratch_path(spark, "raw")
    rows = src.lists_as_text(raw_postings(spark, sf).drop("cluster_id", "cluster_label"))
    layouts = [rows.columns, rows.columns[::-1], sorted(set(rows.columns) - {"salary", "source"})]
    for n, names in enumerate(layouts):
        part = rows.where(F.expr(f"CAST(split(job_url, '=')[1] AS INT) % 3 = {n}"))
        with dropped_shuffles(spark):
            part.select(names).write.csv(f"{path}/layout{n}", header=True, escape='"', compression="gzip")
    return f"{path}/layout*"


@query("s1_read_raw_postings", f"""WITH {RAW_SQL}, laid AS (SELECT *, CAST(split_part(job_url, '=', 2) AS INTEGER) % 3 AS layout FROM raw)
  SELECT job_url, source_file, row_no, job_title, company, experience_required, CASE WHEN layout < 2 THEN salary END AS salary,
  city_text AS location, p_name AS skills FROM laid""")
def s1(spark, sf):
    raw = src.read_raw_postings(spark, _landed(spark, sf))
    lists = [F.array_join("location", "|").alias("location"), F.array_join("skills_list", "|").alias("skills")]
    return raw.select("job_url", "source_file", "row_no", "job_title", "company", "experience_required", "salary", *lists)


_STORED = "SELECT job_url, job_title, salary_mid, array_to_string(location, '|') AS location FROM postings"


def _stored(df):
    return df.select("job_url", "job_title", "salary_mid", F.array_join("location", "|").alias("location"))


@query("s2_read_processed_postings", f"{P} {_STORED}")
def s2(spark, sf):
    base = scratch_path(spark, "processed")
    src.lists_as_text(postings(spark, sf)).write.parquet(f"{base}/cleaned")
    return _stored(src.read_processed(spark, f"{base}/clustered", f"{base}/cleaned"))


@query("s3_write_processed", f"{P} {_STORED}")
def s3(spark, sf):
    path = scratch_path(spark, "written")
    src.write_processed(postings(spark, sf).withColumn("scraped_month", F.date_format("scraped_date", "yyyy-MM")), path, "scraped_month")
    return _stored(spark.read.parquet(path))


@query("s4_append_processed", f"{P} {_STORED}")
def s4(spark, sf):
    path = scratch_path(spark, "appended")
    jobs = stored_postings(spark, sf)
    src.append_processed(jobs.where("experience_min < 5"), path)
    src.append_processed(jobs, path)
    return _stored(spark.read.parquet(path))


_BUILTIN = ", ".join(f"'{s}'" for g in dims.SKILL_CATEGORIES.values() for s in g)


@query("s5_read_skill_dictionary", f"""SELECT skill, CAST(length(skill) AS INTEGER) AS length FROM (
  SELECT unnest([{_BUILTIN}]) AS skill UNION SELECT p_name FROM part
  UNION SELECT p_type || ' Tools' FROM part UNION SELECT p_type FROM part)""")
def s5(spark, sf):
    part = table(spark, sf, "part")
    out = dic.skill_dictionary(
        dic.builtin_skills(spark), part.select(F.col("p_name").alias("skill")), part.select(F.concat("p_type", F.lit(" Tools")).alias("skill")))
    return out.withColumn("length", F.length("skill"))


@query("s6_read_write_state", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS role, event_type AS location_group FROM events")
def s6(spark, sf):
    path = scratch_path(spark, "state")
    pairs = st.split_pairs(table(spark, sf, "events").select(F.concat_ws("|", "user_id", "event_type").alias("pair")))
    st.append_state(pairs.where("location_group < 'm'"), path)
    st.append_state(pairs, path)
    return st.read_state(spark, path)


@query("s7_read_resumes_text", f"""WITH {HITS_SQL} SELECT d.doc_id, CAST(length(text) + 1 AS INTEGER) AS char_count, {_sql_education('text')} AS education,
    coalesce(string_agg(skill, '|' ORDER BY skill), '') AS skills
  FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id WHERE length(text) > 0 GROUP BY d.doc_id, text""")
def s7(spark, sf):
    path = scratch_path(spark, "resumes")  # one file for each text; the writer ends it with a line break
    land_texts(table(spark, sf, "documents"), path)
    resumes = src.read_resumes(spark, path).withColumn("doc_id", F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("long"))
    out = src.resume_facts(resumes, phrase_dictionary(spark, sf), "doc_id")
    return out.select("doc_id", "char_count", F.array_join("education", "|").alias("education"), F.array_join("skills", "|").alias("skills"))


LINKS = r'<li><a href="([^"]*)">'
LINK_SQL = r"""links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages)"""


@query("s8_extract_postings_from_pages", f"""WITH {LINK_SQL}
  SELECT page_id, href AS job_url, substr(href, 2) || '; Lead' AS job_title, 'Not Disclosed' AS salary FROM links""")
def s8(spark, sf):
    # Each page gets a script that holds its links as the postings of a page state.
    job = lambda h: F.struct(F.concat(F.substring(h, 2, 1 << 30), F.lit("; Lead")).alias("title"), h.alias("jdURL"))
    jobs = F.transform(F.regexp_extract_all("html", F.lit(LINKS), 1), job)
    state = F.to_json(F.struct(F.struct(F.struct(jobs.alias("jobTuple")).alias("details")).alias("searchPageState")))
    script = F.concat(F.lit("<script>window._initialState = "), state, F.lit(";\n</script>"))
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.col("html"), script).alias("html"))
    return pg.postings_in_state(pages).select("page_id", "job_url", "job_title", "salary")


@query("s9_extract_cards_from_pages", rf"""WITH cards AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)(<li>.*?</li>)', 1)) AS card FROM pages)
  SELECT page_id, CASE WHEN card LIKE '%<a %' THEN trim(regexp_replace(regexp_replace(regexp_extract(card, '(?s)<a[^>]*>(.*?)</a>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) ELSE 'N/A' END AS job_title,
    'N/A' AS company, 'https://board.example' || regexp_extract(card, 'href="([^"]*)"', 1) AS job_url, 'Not Disclosed' AS salary FROM cards""")
def s9(spark, sf):
    fields = {"job_title": r"(?s)<a[^>]*>(.*?)</a>", "company": r"(?s)<em>(.*?)</em>", "job_url": r'href="([^"]*)"'}
    out = pg.postings_in_cards(table(spark, sf, "pages").drop("url"), r"(?s)(<li>.*?</li>)", fields, base_url="https://board.example")
    return out.select("page_id", "job_title", "company", "job_url", "salary")


@query("s10_describe_sources", f"""WITH {RAW_SQL}, d AS (SELECT source_file, experience_required IS NOT NULL AND source_file <> 'crawl_7.csv' AS is_new,
      salary <> 'Not Disclosed' OR source_file IN ('crawl_1.csv', 'crawl_2.csv') AS added FROM raw),
  c AS (SELECT source_file, count(*) AS n_docs, count(*) FILTER (is_new) AS n_new, count(*) FILTER (is_new AND added) AS n_indexed FROM d GROUP BY 1)
  SELECT *, CASE WHEN n_new = 0 THEN 'Already Processed or Empty' WHEN n_new = n_indexed THEN 'Full' ELSE 'Partial (' || n_indexed || '/' || n_new || ' new jobs)' END AS status FROM c""")
def s10(spark, sf):
    docs = raw_postings(spark, sf).select(
        F.concat_ws("#", "job_url", "row_no").alias("job_url"), "source_file", "salary",
        F.expr("experience_required IS NOT NULL AND source_file <> 'crawl_7.csv'").alias("is_new"))
    added = docs.where("salary <> 'Not Disclosed' OR source_file IN ('crawl_1.csv', 'crawl_2.csv')")
    return src.describe_sources(docs, added)


# --------------------------------------------------------------- joins, index

CLUSTERED_SQL = f"""{P}, refs AS (SELECT job_title, company, arg_min(cluster_id, job_url) AS c FROM postings WHERE scraped_date < TIMESTAMP '2000-01-01' GROUP BY 1, 2),
  attached AS (SELECT p.*, coalesce(c, -1) AS attached_id FROM postings p LEFT JOIN refs USING (job_title, company))"""


def _attached(spark, sf):
    jobs = postings(spark, sf)
    return index.attach_cluster(jobs, jobs.where("scraped_date < TIMESTAMP '2000-01-01'"))


@query("j1_attach_cluster", f"{CLUSTERED_SQL} SELECT job_url, attached_id AS cluster_id FROM attached")
def j1(spark, sf):
    return _attached(spark, sf).select("job_url", "cluster_id")


@query("j2_anti_join_existing", f"""{P}, {RAW_SQL.replace('raw AS', 'again AS')} SELECT job_url, source_file, row_no FROM again
  WHERE split_part(job_url, '?', 1) NOT IN (SELECT job_url FROM postings WHERE experience_min >= 4)""")
def j2(spark, sf):
    known = postings(spark, sf).where("experience_min >= 4")
    return index.anti_join_existing(raw_postings(spark, sf), known).select("job_url", "source_file", "row_no")


@query("j3_frontier_anti_join", """SELECT role, location_group FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS role FROM events),
    (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS location_group)
  EXCEPT SELECT DISTINCT CAST(user_id AS VARCHAR), event_type FROM events""")
def j3(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("role"), F.col("event_type").alias("location_group"))
    return crawl.frontier(events, ["click", "view", "purchase", "refund"], events.distinct())


DOCS_SQL = f"""{P}, docs AS (SELECT job_url AS doc_id, source_file, 'Job Title: ' || job_title || chr(10) || 'Company: ' || company || chr(10) || 'Description: ' || job_description || chr(10) || 'Skills: ' || array_to_string(raw_skills, ', ') AS text,
    array_to_string(location, ', ') AS location, experience_level, experience_min, coalesce(CAST(salary_mid AS VARCHAR), 'N/A') AS salary, cluster_id FROM postings)"""


@query("p14_build_index_documents", DOCS_SQL + " SELECT doc_id, text, location, experience_level, salary, cluster_id, source_file FROM docs")
def p14(spark, sf):
    m = lambda c: F.col(f"metadata.{c}").alias(c)
    return index.index_documents(full_postings(spark, sf)).select("doc_id", "text", *[m(c) for c in ("location", "experience_level", "salary", "cluster_id", "source_file")])


BATCH_SQL = """SELECT doc_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY substr(md5(doc_id), 1, 3), doc_id) - 1 AS position,
    CAST(floor(position / 10) AS BIGINT) AS batch_id FROM docs"""


@query("p16_batch_id", f"{DOCS_SQL} {BATCH_SQL}")
def p16(spark, sf):
    docs = postings(spark, sf).select(F.col("job_url").alias("doc_id"), "source_file")
    return index.batch_documents(docs).select("doc_id", "source_file", "position", "batch_id")


@query("i3_incremental_index", f"""{DOCS_SQL}, parts AS (SELECT *, CASE WHEN experience_min < 4 THEN 0 ELSE 1 END AS run FROM docs),
  placed AS (SELECT *, row_number() OVER (PARTITION BY source_file, run ORDER BY substr(md5(doc_id), 1, 3), doc_id) - 1 AS position FROM parts),
  firsts AS (SELECT source_file, max(CAST(floor(position / 10) AS BIGINT)) + 1 AS used FROM placed WHERE run = 0 GROUP BY 1)
  SELECT doc_id, text, CAST(floor(position / 10) AS BIGINT) + CASE WHEN run = 1 THEN coalesce(used, 0) ELSE 0 END AS batch_id
  FROM placed LEFT JOIN firsts USING (source_file)""")
def i3(spark, sf):
    path = scratch_path(spark, "index")
    jobs = stored_postings(spark, sf, full_postings)
    again = jobs.withColumn("job_url", F.concat("job_url", F.lit("?x=2")))  # the same postings once more, later in the file
    index.append_index(index.incremental_index(jobs.where("experience_min < 4"), path), path)
    index.append_index(index.incremental_index(jobs.union(again.withColumn("row_no", F.lit(2**62))), path), path)
    return spark.read.parquet(path).select("doc_id", "text", "batch_id")


@query("i6_rebuild_index_full", f"""{CLUSTERED_SQL}, firsts AS (SELECT url, {sql_clean('job_title')} AS job_title, {sql_clean('company')} AS company,
    {sql_clean('job_description')} AS job_description, p_name, source_file FROM numbered WHERE rn = 1)
  SELECT url AS doc_id, 'Job Title: ' || f.job_title || chr(10) || 'Company: ' || f.company || chr(10) || 'Description: ' || f.job_description
    || chr(10) || 'Skills: ' || p_name AS text, coalesce(c, -1) AS cluster_id, source_file FROM firsts f LEFT JOIN refs USING (job_title, company)""")
def i6(spark, sf):
    raw = clean.clean_text_columns(raw_postings(spark, sf)).withColumn("skills_text", F.array_join("skills_list", ", "))
    clusters = postings(spark, sf).where("scraped_date < TIMESTAMP '2000-01-01'")
    docs = index.rebuild_index(raw, clusters)
    return docs.select("doc_id", "text", F.col("metadata.cluster_id").alias("cluster_id"), F.col("metadata.source_file").alias("source_file"))


# ----------------------------------------------------------------- retrieval


# Searches take every vector as a query, against all vectors; the index is asked every hundredth.
HUNDREDTH = "vec_id % 100 = 0"


def _vectors(spark, sf, asked="true"):
    corpus = table(spark, sf, "embeddings")
    return corpus.where(asked).select(F.col("vec_id").alias("query_id"), "embedding", "label"), corpus


KNN_SQL = """pairs AS (SELECT q.vec_id AS query_id, d.vec_id, q.label = d.label AS same_label,
    round(pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 2), 6) AS distance FROM embeddings q, embeddings d)"""
KNN_SOME_SQL = f"{KNN_SQL[:-1]} WHERE q.{HUNDREDTH})"


def _hits_sql(k, where="true", knn=KNN_SQL):
    return f"""WITH {knn}, hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
    FROM pairs WHERE {where} QUALIFY rank <= {k})"""


@query("r1_vector_topk", _hits_sql(8) + " SELECT * FROM hits")
def r1(spark, sf):
    return retrieval.vector_topk(*_vectors(spark, sf), k=8)


@query("r1_vector_topk_cells", _hits_sql(5) + " SELECT * FROM hits")
def r1_cells(spark, sf):
    queries, corpus = _vectors(spark, sf)
    everything = F.lit("all").alias("kind")
    return retrieval.vector_topk(queries.select("*", everything), corpus.select("*", everything), k=5, match_on=["kind"], block_rows=300)


@query("r1_vector_index_topk", _hits_sql(8, knn=KNN_SOME_SQL) + " SELECT * FROM hits")
def r1_index(spark, sf):
    queries, corpus = _vectors(spark, sf, HUNDREDTH)
    index = vector_index.build_index(corpus.drop("label"), scratch_path(spark, "vectors"))
    return vector_index.search(queries, index, k=8, exact=True)


# An approximate search: what it misses depends on the centroids, so SQL cannot say it.
@query("r1_vector_index_recall")
def r1_recall(spark, sf):
    queries, corpus = _vectors(spark, sf, HUNDREDTH)
    index = vector_index.build_index(corpus.drop("label"), scratch_path(spark, "vectors"))
    return vector_index.recall(vector_index.search(queries, index, k=8, probes=8), retrieval.vector_topk(queries, corpus, k=8))


@query("r2_vector_topk_filtered", _hits_sql(1, "same_label AND query_id <> vec_id") + " SELECT query_id, vec_id, distance FROM hits")
def r2(spark, sf):
    queries, corpus = _vectors(spark, sf)
    hits = retrieval.vector_topk(queries, corpus, k=2, match_on=["label"]).where("query_id <> vec_id")
    return market.top_n(hits.drop("rank"), ["query_id"], [F.col("distance"), F.col("vec_id")], 1).select("query_id", "vec_id", "distance")


# Document metadata of a vector: postings and guides, some sharing a URL.
def _metadata(corpus):
    return corpus.select(
        "vec_id", F.expr("CASE WHEN label % 3 = 0 THEN 'career_guide' ELSE 'job_posting' END").alias("source"),
        F.expr("concat('Role ', label)").alias("job_title"), F.expr("concat('Company ', vec_id % 9)").alias("company"),
        F.expr("CASE WHEN label % 3 = 0 THEN '' ELSE concat('https://jobs.example/', label, '/', vec_id % 4) END").alias("job_url"),
        F.expr("concat('Guide ', label)").alias("title"))


SOURCES_SQL = _hits_sql(8) + """, m AS (SELECT query_id, rank, label % 3 = 0 AS is_guide, CASE WHEN label % 3 = 0 THEN 'Guide ' || label ELSE 'https://jobs.example/' || label || '/' || (vec_id % 4) END AS key,
    CASE WHEN label % 3 = 0 THEN '- 📖 Guide: **Guide ' || label || '**' ELSE '- **[Role ' || label || ' at Company ' || (vec_id % 9) || '](https://jobs.example/' || label || '/' || (vec_id % 4) || ')**' END AS line
    FROM hits JOIN embeddings USING (vec_id)),
  firsts AS (SELECT query_id, key, min(rank) AS rank, arg_min(line, rank) AS line FROM m GROUP BY 1, 2)
  SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS sources FROM firsts GROUP BY 1"""


@query("r3_retrieve_with_sources", SOURCES_SQL)
def r3(spark, sf):
    queries, corpus = _vectors(spark, sf)
    return retrieval.retrieve_with_sources(queries, corpus.drop("label"), _metadata(corpus))


@query("w5_rank_sources", SOURCES_SQL)
def w5(spark, sf):
    queries, corpus = _vectors(spark, sf)
    return retrieval.rank_sources(retrieval.vector_topk(queries, corpus, 8).join(_metadata(corpus), "vec_id"))


@query("r4_profile_query", f"""WITH {PROFILES_SQL} SELECT profile_id, 'Career path from ' || "current_role" || ' to ' || target_role || ' for someone with ' || years_experience
  || ' years of experience. Key skills needed and transition strategy.' AS query FROM profiles""")
def r4(spark, sf):
    return retrieval.profile_query(profiles(spark, sf))


# ------------------------------------------------------------------- routing

# Every user turn, some with a question about a role appended.
_ROLE = ("concat(CASE conv_id % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'furniture' WHEN 2 THEN 'household' WHEN 3 THEN 'machinery' ELSE 'automobile' END, ' ', "
         "CASE turn % 4 WHEN 0 THEN 'analyst' WHEN 2 THEN 'engineer' ELSE 'manager' END)")
_CITY = "CASE conv_id % 6 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Bangalore' WHEN 2 THEN 'Kolkata' WHEN 3 THEN 'Pune' WHEN 4 THEN 'Delhi' ELSE 'the north' END"
QUESTION = (f"concat(text, ' ', CASE conv_id % 7 WHEN 0 THEN 'How do I become a tide watcher in Pune?' WHEN 1 THEN concat('Which skills for ', {_ROLE}, ' in ', {_CITY}, '?') "
            f"WHEN 2 THEN concat('What salary do ', {_ROLE}, ' jobs offer in ', {_CITY}, '?') WHEN 3 THEN concat('Career path to ', {_ROLE}, '?') "
            f"WHEN 4 THEN concat('What is the CTC of a ', {_ROLE}) WHEN 5 THEN concat('Interview questions for ', {_ROLE}) ELSE '' END)")
QUESTIONS_SQL = f"questions AS (SELECT conv_id * 1000 + turn AS question_id, {QUESTION} AS text FROM conversations WHERE role = 'user')"


def questions(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'")
    return turns.select(F.expr("conv_id * 1000 + turn").alias("question_id"), F.expr(QUESTION).alias("text"))


def _intent_sql(intents):
    arms = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{name}'" for name, words in intents)
    return f"CASE {arms} ELSE 'general' END"


CITY_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{c}') THEN '{c}'" for c in dims.QUESTION_CITIES) + " END"


@query("q1_detect_intent_v1", f"WITH {QUESTIONS_SQL} SELECT question_id, {_intent_sql(dims.MARKET_INTENTS)} AS intent FROM questions")
def q1(spark, sf):
    return questions(spark, sf).select("question_id", routing.detect_intent(F.col("text")).alias("intent"))


@query("q2_detect_intent_v2", f"WITH {QUESTIONS_SQL} SELECT question_id, {_intent_sql(dims.CHAT_INTENTS)} AS intent FROM questions")
def q2(spark, sf):
    return questions(spark, sf).select("question_id", routing.detect_intent(F.col("text"), dims.CHAT_INTENTS).alias("intent"))


@query("j6_detect_location", f"WITH {QUESTIONS_SQL} SELECT question_id, {CITY_SQL} AS location FROM questions")
def j6(spark, sf):
    return questions(spark, sf).select("question_id", routing.detect_location(F.col("text")).alias("location"))


# Known roles: posting titles, the base roles, and phrases of the benchmark texts.
KNOWN_SQL = f"""{P}, {DICTIONARY_SQL}, {QUESTIONS_SQL}, known AS (SELECT lower(job_title) AS role FROM postings UNION SELECT unnest({dims.BASE_ROLES}) UNION SELECT lower(skill) FROM dictionary WHERE skill LIKE '% %'),
  named AS (SELECT question_id, role FROM questions JOIN known ON contains(lower(text), role) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY length(role) DESC, role) = 1)"""


def _known_roles(spark, sf):
    phrases = phrase_dictionary(spark, sf).where("skill LIKE '% %'").select(F.lower("skill").alias("role"))
    return known_roles(postings(spark, sf), phrases)


@query("j5_detect_role", f"{KNOWN_SQL} SELECT * FROM named")
def j5(spark, sf):
    return routing.detect_role(questions(spark, sf), _known_roles(spark, sf))


def _pattern_sql(pattern):
    name = f"trim(regexp_extract(lower(text), '{pattern}', 1), ' ' || chr(9) || chr(10) || chr(12) || chr(13))"
    return f"CASE WHEN {name} <> '' AND len(string_split_regex({name}, '\\s+')) <= 4 THEN {name} END"


PATTERN_SQL = "coalesce(" + ", ".join(_pattern_sql(p) for p in dims.ROLE_PATTERNS) + ")"


@query("q3_extract_role_pattern", f"WITH {QUESTIONS_SQL} SELECT question_id, {PATTERN_SQL} AS role FROM questions")
def q3(spark, sf):
    return questions(spark, sf).select("question_id", routing.role_from_patterns(F.col("text")).alias("role"))


ROUTED_SQL = f"""{KNOWN_SQL}, routed AS (SELECT question_id, text, coalesce(n.role, {PATTERN_SQL}) AS role, {CITY_SQL} AS location, {_intent_sql(dims.MARKET_INTENTS)} AS intent
  FROM questions LEFT JOIN named n USING (question_id))"""


@query("q4_route_questions", f"{ROUTED_SQL} SELECT question_id, role, location, intent FROM routed")
def q4(spark, sf):
    return routing.route_questions(questions(spark, sf), _known_roles(spark, sf)).drop("text")


# Insights use the posting titles and base roles only.
INSIGHT_SQL = f"""{P}, {QUESTIONS_SQL}, known AS (SELECT lower(job_title) AS role FROM postings UNION SELECT unnest({dims.BASE_ROLES})),
  named AS (SELECT question_id, role FROM questions JOIN known ON contains(lower(text), role) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY length(role) DESC, role) = 1),
  routed AS (SELECT question_id, text, coalesce(n.role, {PATTERN_SQL}) AS role, {CITY_SQL} AS location, {_intent_sql(dims.MARKET_INTENTS)} AS intent FROM questions LEFT JOIN named n USING (question_id)),
  asked AS (SELECT DISTINCT role, location FROM routed WHERE role IS NOT NULL),
  counted AS (SELECT a.role, a.location, (SELECT count(*) FROM postings p WHERE contains(lower(job_title), a.role)) AS n_role,
      (SELECT count(*) FROM postings p WHERE contains(lower(job_title), a.role) AND len([x for x in p.location if contains(lower(x), a.location)]) > 0) AS n_local FROM asked a),
  slices AS (SELECT role, location, CASE WHEN location IS NOT NULL AND n_local >= 15 THEN location END AS effective, CASE WHEN location IS NOT NULL AND n_local >= 15 THEN n_local ELSE n_role END AS n, n_role, n_local FROM counted),
  tagged AS (SELECT s.role, s.effective, p.* FROM (SELECT DISTINCT role, effective FROM slices) s JOIN postings p ON contains(lower(job_title), s.role)
      AND (effective IS NULL OR len([x for x in p.location if contains(lower(x), s.effective)]) > 0)),
  f AS (SELECT role, effective, skill, count(*) AS c FROM (SELECT role, effective, unnest(skills) AS skill FROM tagged) GROUP BY 1, 2, 3),
  sizes AS (SELECT role, effective, count(*) AS total FROM tagged GROUP BY 1, 2),
  lines AS (SELECT f.role, f.effective, '- **' || skill || '**: ' || printf('%.1f', c / total * 100) || '% frequency' AS line, row_number() OVER (PARTITION BY f.role, f.effective ORDER BY c DESC, skill) AS rank
    FROM f JOIN sizes z ON f.role = z.role AND f.effective IS NOT DISTINCT FROM z.effective QUALIFY rank <= 10),
  lists AS (SELECT role, effective, string_agg(line, chr(10) ORDER BY rank) AS skill_list FROM lines GROUP BY 1, 2),
  pay AS (SELECT a.role, a.location, median(salary_mid) AS md, min(salary_mid) AS lo, max(salary_mid) AS hi, sum(salary_mid) / count(*) AS mn, count(*) AS k FROM asked a JOIN postings p
      ON contains(lower(job_title), a.role) AND (a.location IS NULL OR list_contains([lower(x) for x in p.location], a.location)) WHERE salary_mid IS NOT NULL GROUP BY 1, 2),
  modal AS (SELECT role, effective, cluster_id FROM (SELECT role, effective, cluster_id, count(*) AS c FROM tagged GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY role, effective ORDER BY c DESC, cluster_id) = 1),
  csal AS (SELECT cluster_id, sum(salary_mid) / count(salary_mid) AS salary FROM postings GROUP BY 1),
  cskill AS (SELECT cluster_id, string_agg(v, ', ' ORDER BY c DESC, v) AS names FROM (SELECT cluster_id, v, count(*) AS c FROM (SELECT cluster_id, unnest(skills) AS v FROM postings) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, v) <= 5) GROUP BY 1),
  cfirm AS (SELECT cluster_id, string_agg(v, ', ' ORDER BY c DESC, v) AS firms FROM (SELECT cluster_id, company AS v, count(*) AS c FROM postings GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, v) <= 3) GROUP BY 1),
  joined AS (SELECT r.*, s.effective, coalesce(s.n, 0) AS n, skill_list, md, lo, hi, mn, coalesce(k, 0) AS k, names, firms, salary, n_role, n_local,
      {sql_title('r.role')} AS role_title, CASE WHEN r.location IS NULL THEN '' WHEN s.effective IS NOT NULL THEN ' in ''' || {sql_title('r.location')} || '''' ELSE ' (Global/India context used due to limited data in ''' || {sql_title('r.location')} || ''')' END AS place
    FROM routed r LEFT JOIN slices s ON r.role = s.role AND r.location IS NOT DISTINCT FROM s.location
    LEFT JOIN lists l ON r.role = l.role AND s.effective IS NOT DISTINCT FROM l.effective
    LEFT JOIN pay p ON r.role = p.role AND r.location IS NOT DISTINCT FROM p.location
    LEFT JOIN modal m ON r.role = m.role AND s.effective IS NOT DISTINCT FROM m.effective
    LEFT JOIN csal USING (cluster_id) LEFT JOIN cskill USING (cluster_id) LEFT JOIN cfirm USING (cluster_id)),
  insights AS (SELECT question_id, text, role, location, intent, n_role, n_local, coalesce(CASE
      WHEN role IS NULL THEN NULL
      WHEN intent = 'skills' THEN '### 📊 ML Skills Analysis for ''' || role_title || '''' || place || chr(10) || 'Analysis based on ' || n || ' fresh (last 14 days) job postings matching this role and location:' || chr(10) || skill_list || chr(10)
      WHEN intent = 'salary' AND k > 0 THEN '### 💰 Salary Market Statistics for ''' || role_title || '''' || place || chr(10) || 'Based on **' || k || '** fresh job postings (last 14 days):' || chr(10) || '- **Median Salary**: ₹' || round_even(md, 2)
        || ' LPA' || chr(10) || '- **Market Range**: ₹' || round_even(lo, 2) || ' - ₹' || round_even(hi, 2) || ' LPA' || chr(10) || '- **Mean Average**: ₹' || round_even(mn, 2) || ' LPA' || chr(10)
      WHEN intent = 'salary' THEN 'Insufficient salary data to provide specific statistics for ''' || role || '''' || place || '.'
      WHEN intent = 'career_path' THEN '### 🚀 Career Insights for ''' || role_title || '''' || place || chr(10) || 'Analysis of ' || n || ' fresh postings within this cluster context:' || chr(10) || '- **Key Skills**: ' || names || chr(10)
        || '- **Top Hiring Companies**: ' || firms || chr(10) || '- **Avg Cluster Salary**: ₹' || round_even(salary, 2) || ' LPA' || chr(10) END, '{routing.LOW_VOLUME}') AS insight FROM joined)"""


def _routed(spark, sf, jobs):
    return routing.route_questions(questions(spark, sf), known_roles(jobs))


@query("q5_ml_insight_text", f"{INSIGHT_SQL} SELECT question_id, intent, insight FROM insights")
def q5(spark, sf):
    jobs = stored_postings(spark, sf)
    return routing.insight_text(_routed(spark, sf, jobs), jobs).select("question_id", "intent", "insight")


CHAT_SQL = INSIGHT_SQL.split(",\n  asked AS")[0].replace(_intent_sql(dims.MARKET_INTENTS), _intent_sql(dims.CHAT_INTENTS)) + """,
  matching AS (SELECT a.role, p.skills, p.salary_mid FROM (SELECT DISTINCT role FROM routed WHERE role IS NOT NULL) a JOIN postings p ON contains(lower(job_title), a.role)),
  names AS (SELECT role, string_agg(skill, ', ' ORDER BY rank) AS names FROM (SELECT role, skill, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, skill) AS rank
    FROM (SELECT role, unnest(skills) AS skill FROM matching) GROUP BY role, skill QUALIFY rank <= 8) GROUP BY 1),
  paid AS (SELECT role, sum(salary_mid) / count(salary_mid) AS pay FROM matching GROUP BY 1)
  SELECT question_id, intent, coalesce(CASE WHEN intent = 'skills' AND names IS NOT NULL THEN 'ML INSIGHTS: Top skills for ' || role || ': ' || names || '. '
    WHEN intent = 'salary' AND pay IS NOT NULL THEN 'ML INSIGHTS: Average salary for ' || role || ' is ' || printf('%.2f', round_even(pay, 2)) || ' LPA. ' END, '') AS insight
  FROM routed LEFT JOIN names USING (role) LEFT JOIN paid USING (role)"""


@query("q5_chat_insight", CHAT_SQL)
def q5_chat(spark, sf):
    jobs = stored_postings(spark, sf)
    routed = _routed(spark, sf, jobs).withColumn("intent", routing.detect_intent(F.col("text"), dims.CHAT_INTENTS))
    return routing.chat_insight(routed, jobs).select("question_id", "intent", "insight")


FOLLOW_ROWS = ", ".join(f"('{i}', {n}, '{t.replace(chr(39), chr(39) * 2)}')" for i, ts in dims.FOLLOW_UPS.items() for n, t in enumerate(ts, 1))


@query("q6_follow_up_questions", f"""{ROUTED_SQL.replace(_intent_sql(dims.MARKET_INTENTS), _intent_sql(dims.CHAT_INTENTS))}, t AS (SELECT * FROM (VALUES {FOLLOW_ROWS}) v(intent, position, template))
  SELECT question_id, CAST(position AS INTEGER) AS position, replace(template, '{{role}}', coalesce(role, 'this role')) AS follow_up FROM routed JOIN t USING (intent)""")
def q6(spark, sf):
    routed = routing.route_questions(questions(spark, sf), _known_roles(spark, sf), intents=dims.CHAT_INTENTS)
    return routing.follow_up_questions(routed)


PROMPT_SQL = """'ML Analysis Results:' || chr(10) || insight || chr(10) || chr(10) || 'Dynamic Career Guide Knowledge:' || chr(10) || chr(10) || chr(10) || 'User Question: ' || text || chr(10) || chr(10)
  || 'Instruction: Based on the quantitative ML analysis, the dynamically generated career guide, and real job examples, answer the user''s question.'"""


@query("q7_augment_query", f"{INSIGHT_SQL} SELECT question_id, {PROMPT_SQL} AS prompt FROM insights")
def q7(spark, sf):
    jobs = stored_postings(spark, sf)
    answered = routing.insight_text(_routed(spark, sf, jobs), jobs)
    return routing.augment_query(answered).select("question_id", "prompt")


@query("e5_answer_context", f"""{INSIGHT_SQL} SELECT question_id, intent, role, location, {PROMPT_SQL} AS prompt,
  role IS NOT NULL AND (n_role < 15 OR (location IS NOT NULL AND n_local < 15)) AS needs_scrape FROM insights""")
def e5(spark, sf):
    jobs = stored_postings(spark, sf)
    out = build.answer_context(questions(spark, sf), known_roles(jobs), jobs)
    return out.select("question_id", "intent", "role", "location", "prompt", "needs_scrape")


@query("w3_history_window", """SELECT c.conv_id, c.turn, coalesce(string_agg(h.role || ':' || coalesce(h.text, ''), '|' ORDER BY h.turn), '') AS history
  FROM conversations c LEFT JOIN conversations h ON h.conv_id = c.conv_id AND h.turn BETWEEN c.turn - 10 AND c.turn - 1 GROUP BY 1, 2""")
def w3(spark, sf):
    turns = routing.history_window(table(spark, sf, "conversations"))
    shown = F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), F.coalesce(h["text"], F.lit(""))))
    return turns.select("conv_id", "turn", F.array_join(shown, "|").alias("history"))


# --------------------------------------------------------- crawl and streaming


def _pages(spark, sf):
    return table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("role"), F.col("event_type").alias("location_group"), F.dayofmonth("ts").alias("page")
    ).agg(F.count(F.lit(1)).alias("n_new"))


@query("w4_quota_per_pair", """WITH pages_seen AS (SELECT CAST(user_id AS VARCHAR) AS role, event_type AS location_group, CAST(day(ts) AS INTEGER) AS page, count(*) AS n_new FROM events GROUP BY 1, 2, 3),
  run AS (SELECT *, CAST(coalesce(sum(n_new) OVER (PARTITION BY role, location_group ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_before FROM pages_seen WHERE page <= 20)
  SELECT * FROM run WHERE new_before < 5""")
def w4(spark, sf):
    return crawl.quota_per_pair(_pages(spark, sf), quota=5)


@query("w6_low_yield_expand", """WITH placed AS (SELECT CAST(user_id AS VARCHAR) AS role, event_type AS location_group, CAST(day(ts) AS INTEGER) AS page, value, min(CAST(day(ts) AS INTEGER)) OVER (PARTITION BY user_id, event_type) AS start_page FROM events)
  SELECT role, location_group, start_page, count(*) AS n_cards, count(*) FILTER (value > 20) AS n_new,
    CAST(CASE WHEN count(*) FILTER (value > 20) < 3 THEN start_page + 2 ELSE 0 END AS INTEGER) AS next_start FROM placed WHERE page < start_page + 2 GROUP BY 1, 2, 3""")
def w6(spark, sf):
    seen = table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("role"), F.col("event_type").alias("location_group"), F.dayofmonth("ts").alias("page")
    ).agg(F.count(F.lit(1)).alias("n_cards"), F.count_if(F.col("value") > 20).alias("n_new"))
    return crawl.low_yield(seen, 2).fillna(0, ["next_start"])


@query("p15_slug_url", f"""{P} SELECT DISTINCT job_title, 'https://example.org/' || replace(lower(job_title), ' ', '-') || '-jobs-in-new-delhi-3' AS url FROM postings""")
def p15(spark, sf):
    titles = postings(spark, sf).select("job_title").distinct()
    return titles.select("job_title", crawl.search_url(F.col("job_title"), F.lit("New Delhi"), F.lit(3), "https://example.org").alias("url"))


SEEN_SQL = """seen AS (SELECT CAST(user_id AS VARCHAR) AS role, event_type AS location_group, CAST(day(ts) AS INTEGER) AS page, count(*) AS n_cards, count(*) FILTER (value > 10) AS n_new FROM events GROUP BY 1, 2, 3),
  run AS (SELECT *, coalesce(sum(n_new) OVER (PARTITION BY role, location_group ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM seen WHERE page <= 29),
  state AS (SELECT role, location_group, max(page) AS page, CAST(sum(n_new) AS BIGINT) AS n_new, CASE WHEN sum(n_new) >= 6 THEN 'quota' WHEN max(page) >= 29 THEN 'page limit' ELSE 'open' END AS status FROM run WHERE ahead < 6 GROUP BY 1, 2)"""


def _crawled(spark, sf):
    """(yields by page, state of every pair): the state is folded in two runs, the second of which sees all pages again."""
    pages = table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("role"), F.col("event_type").alias("location_group"), F.dayofmonth("ts").alias("page")
    ).agg(F.count(F.lit(1)).alias("n_cards"), F.count_if(F.col("value") > 10).alias("n_new"))
    pages = cut_lineage(pages)
    state = cut_lineage(crawl.fold_pages(spark.createDataFrame([], crawl.STATE), pages.where("page <= 12"), quota=6, max_pages=29))
    return pages, crawl.fold_pages(state, pages, quota=6, max_pages=29)


@query("w4_crawl_state", f"WITH {SEEN_SQL} SELECT * FROM state")
def w4_state(spark, sf):
    return _crawled(spark, sf)[1]


@query("i4_plan_crawl_frontier", f"""WITH {SEEN_SQL},
  blocks AS (SELECT role, location_group, start_page, start_page + 2 AS next_start FROM (SELECT *, min(page) OVER (PARTITION BY role, location_group) AS start_page FROM seen)
    WHERE page < start_page + 2 GROUP BY 1, 2, 3 HAVING sum(n_new) < 3),
  open AS (SELECT r.role, g AS location_group, coalesce(page, 0) AS page, CASE WHEN page = next_start - 1 THEN 2 * next_start - start_page - 1 ELSE coalesce(page, 0) + 1 END AS upto
    FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS role FROM events) r CROSS JOIN (SELECT unnest(['click', 'error', 'refund']) AS g)
    LEFT JOIN state s ON s.role = r.role AND s.location_group = g LEFT JOIN blocks b ON b.role = r.role AND b.location_group = g
    WHERE NOT (g = 'error' AND CAST(r.role AS BIGINT) % 2 = 0) AND coalesce(status, 'open') = 'open'),
  going AS (SELECT *, unnest(range(page + 1, least(upto, 29) + 1)) AS next_page FROM open)
  SELECT role, location_group, CAST(next_page AS INTEGER) AS page, place AS location, 'https://example.org/' || role || '-jobs-in-' || replace(lower(place), ' ', '-') || '-' || next_page AS url
  FROM going JOIN (VALUES ('click', 'Click City'), ('click', 'Klick'), ('error', 'Error'), ('refund', 'Refund')) v(g, place) ON g = location_group""")
def i4(spark, sf):
    events = table(spark, sf, "events")
    users = events.select(F.col("user_id").cast("string").alias("role"))
    done = users.where("CAST(role AS BIGINT) % 2 = 0").select("role", F.lit("error").alias("location_group")).distinct()
    groups = {"click": ["Click City", "Klick"], "error": ["Error"], "refund": ["Refund"]}
    pages, state = _crawled(spark, sf)
    planned = crawl.crawl_frontier(users, done, state, groups, crawl.low_yield(pages, 2), max_pages=29)
    return planned.select("role", "location_group", "page", "location", "url")


def _landed_layouts(spark, sf):
    """Folders with events as raw postings, landed three times, with other query parts and in other column orders."""
    events = table(spark, sf, "events")
    row = lambda v: events.select(
        F.concat(F.lit("https://jobs.example/e/"), "event_id", F.lit(f"?v={v}")).alias("job_url"),
        F.concat(F.lit("<i>"), "event_type", F.lit("</i>")).alias("job_title"), F.concat(F.lit("User #"), "user_id").alias("company"),
        F.lit("Bengaluru").alias("location"), F.expr("concat(user_id % 9, '-', user_id % 9 + 2, ' yrs')").alias("experience_required"),
        F.lit("Not Disclosed").alias("salary"), F.col("ts").cast("timestamp").alias("scraped_date"))
    path = scratch_path(spark, "landing")
    for v in (1, 2, 3):
        row(v).select(_EVENT_COLUMNS[v - 1 :] + _EVENT_COLUMNS[: v - 1]).write.csv(
            f"{path}/{v}", header=True, escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return [f"{path}/{v}" for v in (1, 2, 3)]


def _landed_events(spark, sf):
    return _landed_layouts(spark, sf)[0].rsplit("/", 1)[0] + "/*"


_EVENT_COLUMNS = ["job_url", "job_title", "company", "location", "experience_required", "salary", "scraped_date"]
EVENTS_SQL = """SELECT 'https://jobs.example/e/' || event_id AS job_url, event_type AS job_title, 'User ' || user_id AS company, 'Bangalore' AS location,
  CAST(user_id % 9 AS DOUBLE) AS experience_min, CAST(ts AS TIMESTAMP) AS scraped_date FROM events"""


def _event_rows(df):
    return df.select("job_url", "job_title", "company", F.array_join("location", "|").alias("location"), "experience_min", "scraped_date")


@query("i1_stream_ingest_postings", EVENTS_SQL + " WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def i1(spark, sf):
    base = scratch_path(spark, "ingest")
    files = ingest.landed_files(spark, _landed_events(spark, sf))
    ingest.ingest_stream(files, f"{base}/table", f"{base}/checkpoint", F.lit("2024-01-31").cast("timestamp")).awaitTermination()
    return _event_rows(spark.read.parquet(f"{base}/table"))


@query("i2_upsert_clean_table", f"""{P} SELECT job_url, job_title, company, array_to_string(location, '|') AS location FROM postings""")
def i2(spark, sf):
    base = scratch_path(spark, "upsert")
    cleaned = clean.standardize_locations(clean.clean_text_columns(raw_postings(spark, sf))).withColumn("job_url", tx.canonical_url(F.col("job_url")))
    cleaned = cleaned.select("job_url", "job_title", "company", "location", "source_file", "row_no")
    for part in ("source_file < 'crawl_4.csv'", "source_file >= 'crawl_4.csv'", "source_file > 'crawl_5.csv'"):
        ingest.upsert_batch(cleaned.where(part), base)
    return ingest.read_version(spark, base).select("job_url", "job_title", "company", F.array_join("location", "|").alias("location"))


@query("i2_upsert_stream", EVENTS_SQL)
def i2_stream(spark, sf):
    base = scratch_path(spark, "upserts")
    # One layout after the other: three versions.
    for layout in sorted(_landed_layouts(spark, sf)):
        ingest.upsert_stream(ingest.landed_files(spark, layout), base, f"{base}/checkpoint-{layout[-1]}").awaitTermination()
    return _event_rows(ingest.read_version(spark, base))


# ---------------------------------------------------------------- composed jobs


def _prototypes(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("cluster_id"), F.concat(F.lit("Item "), "item_id").alias("cluster_label"), "text")


def _part_names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("skill")).distinct()


LABELLED_SQL = (
    TOKENS_SQL.replace("SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', item_id, text FROM benchmark",
                       "SELECT 'd' AS kind, job_url AS id, job_description AS text FROM postings UNION ALL SELECT 'p', CAST(item_id AS VARCHAR), text FROM benchmark")
    .replace("p.id AS cluster_id", "CAST(p.id AS BIGINT) AS cluster_id")
    .replace("SELECT d.doc_id, coalesce(cluster_id,", "SELECT d.job_url, d.salary_mid, coalesce(best.cluster_id,")
    .replace("FROM documents d LEFT JOIN best USING (doc_id)", "FROM postings d LEFT JOIN best ON best.doc_id = d.job_url")
)


@query("e2_process_raw", f"""{P}, {LABELLED_SQL} SELECT kind, name, count(*) AS n, quantile_cont(salary_mid, 0.25) AS p25, median(salary_mid) AS p50, quantile_cont(salary_mid, 0.75) AS p75
  FROM (SELECT 'global' AS kind, 'all' AS name, salary_mid FROM postings UNION ALL SELECT 'experience', experience_level, salary_mid FROM postings
    UNION ALL SELECT 'cluster', 'Item ' || cluster_id, salary_mid FROM classified) WHERE salary_mid IS NOT NULL GROUP BY 1, 2""")
def e2(spark, sf):
    base = scratch_path(spark, "process")
    trends = build.process_raw(spark, _landed_e2(spark, sf), f"{base}/cleaned", f"{base}/clustered", _part_names(spark, sf), _prototypes(spark, sf), stop=STOP)
    return trends.select("kind", "name", "n", "p25", "p50", "p75")


def _landed_e2(spark, sf):
    path = scratch_path(spark, "landing")
    rows = raw_postings(spark, sf).drop("cluster_id", "cluster_label")
    with dropped_shuffles(spark):
        src.lists_as_text(rows).write.csv(path, header=True, escape='"', compression="gzip")
    return path


@query("e3_full_build", f"""{P} SELECT count(*) AS total, count(*) AS new_records, CAST(0 AS BIGINT) AS previous_total, count(*) AS difference, true AS should_update, count(*) AS indexed FROM postings""")
def e3(spark, sf):
    base = scratch_path(spark, "build")
    change = build.full_build(spark, _landed_e2(spark, sf), base, _part_names(spark, sf), _prototypes(spark, sf), None, stop=STOP)
    docs = build.read_build(spark, base, "index").agg(F.count(F.lit(1)).alias("n"))
    return change.withColumn("indexed", docs.scalar())


@query("e3_full_build_contents", f"""{DOCS_SQL.replace("docs AS", "indexed AS")}, {LABELLED_SQL}, first_skill AS (SELECT url AS job_url, p_name FROM numbered WHERE rn = 1)
  SELECT 'cleaned' AS part, job_url, job_title AS value FROM postings
  UNION ALL SELECT 'clustered', job_url, 'Item ' || cluster_id FROM classified
  UNION ALL SELECT 'index', job_url, 'Job Title: ' || job_title || chr(10) || 'Company: ' || company || chr(10) || 'Description: ' || job_description
    || chr(10) || 'Skills: ' || p_name FROM postings JOIN first_skill USING (job_url)""")
def e3_contents(spark, sf):
    base, landed = scratch_path(spark, "build"), _landed_e2(spark, sf)
    for _ in range(2):  # the second build finds nothing new
        build.full_build(spark, landed, base, _part_names(spark, sf), _prototypes(spark, sf), None, stop=STOP)
    part = lambda name, key, value: build.read_build(spark, base, name).select(F.lit(name).alias("part"), F.col(key).alias("job_url"), F.col(value).alias("value"))
    return part("cleaned", "job_url", "job_title").union(part("clustered", "job_url", "cluster_label")).union(part("index", "doc_id", "text"))


DASHBOARD_SQL = f"""{P}, {REQUESTS_SQL},
  tagged AS (SELECT r.role, r.wanted, p.* FROM (SELECT DISTINCT role, wanted FROM requests WHERE role IS NOT NULL) r JOIN postings p ON contains(lower(job_title), r.role)
    AND (r.wanted IS NULL OR len([x for x in p.location if contains(lower(x), r.wanted)]) > 0)),
  sizes AS (SELECT role, wanted, count(*) AS total FROM tagged GROUP BY 1, 2),
  used AS (SELECT role, wanted, skill, count(*) AS c, count(salary_mid) AS n1, avg(salary_mid) AS m1 FROM (SELECT role, wanted, salary_mid, unnest(skills) AS skill FROM tagged) GROUP BY 1, 2, 3),
  top20 AS (SELECT u.*, c / total * 100 AS pct, row_number() OVER (PARTITION BY u.role, u.wanted ORDER BY c DESC, skill) AS rank
    FROM used u JOIN sizes z ON z.role = u.role AND z.wanted IS NOT DISTINCT FROM u.wanted QUALIFY rank <= 20),
  pay AS (SELECT role, wanted, count(salary_mid) AS n, sum(salary_mid) AS s FROM tagged GROUP BY 1, 2),
  premium AS (SELECT t.role, t.wanted, skill, m1 - (s - m1 * n1) / (n - n1) AS premium FROM top20 t JOIN pay p ON p.role = t.role AND p.wanted IS NOT DISTINCT FROM t.wanted WHERE n1 >= 3 AND n - n1 >= 3),
  box AS (SELECT role, wanted, count(*) AS n, avg(salary_mid) AS mean, quantile_cont(salary_mid, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM tagged WHERE salary_mid IS NOT NULL GROUP BY 1, 2),
  levels AS (SELECT role, wanted, experience_level, quantile_cont(salary_mid, [0.25, 0.5, 0.75]) AS q FROM tagged WHERE salary_mid IS NOT NULL GROUP BY 1, 2, 3),
  parts AS (
    SELECT role, wanted, 'top_skills' AS section, rank, skill AS name, pct AS value FROM top20 WHERE rank <= 10
    UNION ALL SELECT role, wanted, 'emerging_skills', rank, skill, pct FROM top20 WHERE rank <= 15
    UNION ALL SELECT role, wanted, 'employers', row_number() OVER (PARTITION BY role, wanted ORDER BY count(*) DESC, company) AS r, company, count(*) FROM tagged WHERE company IS NOT NULL GROUP BY role, wanted, company QUALIFY r <= 10
    UNION ALL SELECT role, wanted, 'clusters', row_number() OVER (PARTITION BY role, wanted ORDER BY count(*) DESC, cluster_label), cluster_label, count(*) FROM tagged
      WHERE NOT regexp_matches(cluster_label, '(?i)error|000') GROUP BY role, wanted, cluster_label
    UNION ALL SELECT role, wanted, 'salary', i, ['n', 'mean', 'min', 'q1', 'median', 'q3', 'max'][i], [n, mean, q[1], q[2], q[3], q[4], q[5]][i] FROM box, range(1, 8) x(i)
    UNION ALL SELECT role, wanted, 'premiums', row_number() OVER (PARTITION BY role, wanted ORDER BY premium DESC, skill) AS r, skill, premium FROM premium WHERE premium > 0 QUALIFY r <= 10
    UNION ALL SELECT role, wanted, 'salary ' || experience_level, i, ['q1', 'median', 'q3'][i], q[i] FROM levels, range(1, 4) x(i))
  SELECT role, wanted AS location, section, CAST(rank AS INTEGER) AS rank, name, round(CAST(value AS DOUBLE), 6) AS value FROM parts"""


@query("e4_market_dashboard", DASHBOARD_SQL)
def e4(spark, sf):
    out = reports.market_dashboard(stored_postings(spark, sf), requests(spark))
    return out.withColumn("value", F.round("value", 6))


@query("e6_profile_report", f"""{GAP_SQL}, {ALIGN_SQL},
  score AS (SELECT profile_id, role, count(*) FILTER (matched) / count(*) * 100 AS score FROM gap GROUP BY 1, 2)
  SELECT p.profile_id, role, score, CASE WHEN years_experience < p25 THEN 'Under-qualified' WHEN years_experience > p75 + 2 THEN 'Over-qualified' ELSE 'Perfectly Matched' END AS status
  FROM profiles p JOIN score USING (profile_id) JOIN q USING (role)""")
def e6(spark, sf):
    return reports.profile_report(profiles(spark, sf), stored_postings(spark, sf)).select("profile_id", "role", "score", "status")
