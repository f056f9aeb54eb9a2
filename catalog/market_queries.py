"""Filters, market statistics, windows, top-k and set queries."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import CITY, POSTINGS_SQL, RAW_SQL, TARGET_ROLE, PROFILES_SQL, postings, profiles, raw_postings, stored_postings, table
from jobtide import dims
from jobtide.operators import clean, filters, locations, market
from jobtide.session import scratch_path

P = f"WITH {POSTINGS_SQL}"
ROLES = ["analyst", "building eng", "furniture manager", "household", "machinery designer", "automobile", "data scientist"]
ROLES_SQL = f"roles AS (SELECT unnest({ROLES}) AS role)"
PR = f"{P}, {ROLES_SQL}, tagged AS (SELECT r.role, p.* FROM postings p JOIN roles r ON contains(lower(job_title), role))"


def roles(spark):
    return spark.createDataFrame([(r,) for r in ROLES], "role string")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("l1_filter_role", f"{P} SELECT job_url, job_title FROM postings WHERE contains(lower(job_title), 'building analyst')")
def l1(spark, sf):
    return postings(spark, sf).where(filters.role_matches(F.col("job_title"), "Building Analyst")).select("job_url", "job_title")


@query("l2_filter_location_exact", f"{P} SELECT job_url FROM postings WHERE list_contains(location, 'Mumbai')")
def l2(spark, sf):
    return postings(spark, sf).where(filters.location_is(F.col("location"), "Mumbai")).select("job_url")


@query("l3_filter_location_any_substring", f"{P} SELECT job_url FROM postings WHERE len([x for x in location if contains(lower(x), 'nation_1')]) > 0")
def l3(spark, sf):
    return postings(spark, sf).where(filters.location_like(F.col("location"), "NATION_1")).select("job_url")


@query("l4_filter_location_prefs", f"{P} SELECT job_url FROM postings WHERE list_has_any([lower(x) for x in location], ['pune', 'remote'])")
def l4(spark, sf):
    wanted = F.array(F.lit("PUNE"), F.lit("remote"))
    return postings(spark, sf).where(filters.location_preferred(F.col("location"), wanted)).select("job_url")


@query("l6_filter_experience_cap", f"{P} SELECT job_url, experience_min FROM postings WHERE experience_min <= 5")
def l6(spark, sf):
    return postings(spark, sf).where(filters.experience_within(F.col("experience_min"), F.lit(2))).select("job_url", "experience_min")


@query("l7_drop_garbage_clusters", f"{P} SELECT job_url, cluster_label FROM postings WHERE NOT regexp_matches(lower(cluster_label), 'error|000')")
def l7(spark, sf):
    return postings(spark, sf).where(filters.is_real_cluster(F.col("cluster_label"))).select("job_url", "cluster_label")


REQUESTS = [("analyst", "mumbai"), ("building eng", None), ("machinery designer", "nation_9"), ("data scientist", "pune"), (None, "pune"), ("automobile", "atlantis")]
REQUESTS_SQL = "requests AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in REQUESTS) + ") v(role, wanted))"


def requests(spark):
    return spark.createDataFrame(REQUESTS, "role string, location string")


@query("l8_check_sufficiency", f"""{P}, {REQUESTS_SQL}, c AS (
  SELECT role, wanted, (SELECT count(*) FROM postings WHERE contains(lower(job_title), role)) AS n_role,
    (SELECT count(*) FROM postings WHERE contains(lower(job_title), role) AND len([x for x in location if contains(lower(x), wanted)]) > 0) AS n_local
  FROM requests)
  SELECT role, wanted AS location,
    CASE WHEN role IS NULL THEN true WHEN n_role < 15 THEN false WHEN wanted IS NOT NULL AND n_local < 15 THEN false ELSE true END AS is_sufficient,
    CASE WHEN role IS NULL THEN 'No specific role detected.'
      WHEN n_role < 15 THEN 'Low data for ''' || role || ''' (' || n_role || ' found, need 15)'
      WHEN wanted IS NOT NULL AND n_local < 15 THEN 'Low data for ''' || role || ''' in ''' || wanted || ''' (' || n_local || ' found, need 15)'
      ELSE 'Sufficient data available.' || n_role || ' matches for role, ' || CASE WHEN wanted IS NULL THEN 'N/A' ELSE CAST(n_local AS VARCHAR) END || ' matches for location.' END AS reason
  FROM c""")
def l8(spark, sf):
    out = filters.check_sufficiency(requests(spark), postings(spark, sf))
    return out.select("role", "location", "is_sufficient", "reason")


@query("l9_drop_missing", f"{P} SELECT job_url, salary_mid FROM postings WHERE salary_mid IS NOT NULL AND len(skills) > 0")
def l9(spark, sf):
    return filters.drop_missing(postings(spark, sf), "salary_mid", "skills_list").select("job_url", "salary_mid")


def _frequency_sql(source, by):
    keys = "".join(f"{k}, " for k in by)
    on = " AND ".join(f"s.{k} = t.{k}" for k in by) or "true"
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {''.join(f's.{k}, ' for k in by)} skill_name, s.n AS "count", avg_salary, s.n / t.n * 100 AS percentage
  FROM (SELECT {keys} skill_name, count(*) AS n, sum(salary_mid) / nullif(count(salary_mid), 0) AS avg_salary
    FROM (SELECT {keys} salary_mid, unnest(skills) AS skill_name FROM {source}) GROUP BY {keys} skill_name) s
  JOIN (SELECT {keys} count(*) AS n FROM {source} {group}) t ON {on}"""


@query("g4_skill_frequency", f"{PR} {_frequency_sql('tagged', ['role'])}")
def g4(spark, sf):
    return market.skill_frequency(postings(spark, sf), roles=roles(spark))


@query("g4_skill_frequency_all", f"{P} {_frequency_sql('postings', [])}")
def g4_all(spark, sf):
    return market.skill_frequency(postings(spark, sf))


@query("g4_skill_frequency_by_cluster", f"{P} {_frequency_sql('postings', ['cluster_id'])}")
def g4_cluster(spark, sf):
    return market.skill_frequency(postings(spark, sf), by=["cluster_id"])


@query("t1_topk_skills", f"""{PR}, f AS ({_frequency_sql('tagged', ['role'])})
  SELECT role, skill_name, "count", avg_salary, percentage FROM f
  QUALIFY row_number() OVER (PARTITION BY role ORDER BY "count" DESC, skill_name) <= 10""")
def t1(spark, sf):
    frequency = market.skill_frequency(postings(spark, sf), roles=roles(spark))
    return market.top_skills(frequency, 10, ["role"]).drop("rank")


# Counts by day are stored in two runs, the second of which writes its own days only.
@query("g5_skill_growth", f"""{P}, days AS (SELECT CAST(scraped_date AS DATE) AS day, skills FROM postings WHERE scraped_date IS NOT NULL),
  last AS (SELECT max(day) AS as_of FROM days),
  dated AS (SELECT CASE WHEN as_of - day BETWEEN 0 AND 59 THEN 'now' ELSE 'before' END AS w, skills FROM days, last WHERE as_of - day BETWEEN 0 AND 119),
  totals AS (SELECT count(*) FILTER (w = 'now') AS t_now, count(*) FILTER (w = 'before') AS t_before FROM dated),
  counted AS (SELECT skill_name, count(*) FILTER (w = 'now') AS n_now, count(*) FILTER (w = 'before') AS n_before FROM (SELECT w, unnest(skills) AS skill_name FROM dated) GROUP BY 1)
  SELECT skill_name, n_now, n_before, round(n_now / t_now * 100, 9) AS share_now, round(n_before / t_before * 100, 9) AS share_before,
    round(CASE WHEN n_before > 0 THEN (n_now / t_now) / (n_before / t_before) * 100 - 100 END, 6) AS growth_rate FROM counted, totals WHERE n_now > 0""")
def g5_growth(spark, sf):
    jobs, path = stored_postings(spark, sf), scratch_path(spark, "daily-skills")
    as_of = F.lit(jobs.agg(F.max(F.to_date("scraped_date"))).first()[0])
    age = F.datediff(as_of, F.to_date("scraped_date"))
    market.store_daily_skills(jobs.where(age.between(30, 119)), path)  # what a daily job would have written
    market.store_daily_skills(jobs.where(age.between(0, 29)), path)
    out = market.skill_growth(spark.read.parquet(path), as_of, 60, None)
    return out.withColumns({"growth_rate": F.round("growth_rate", 6), "share_now": F.round("share_now", 9), "share_before": F.round("share_before", 9)})


@query("g5_emerging_skills", f"""{P}, f AS ({_frequency_sql('postings', [])})
  SELECT skill_name, "count", avg_salary, percentage, percentage AS growth_rate FROM f ORDER BY "count" DESC, skill_name LIMIT 15""")
def g5(spark, sf):
    return market.emerging_skills(postings(spark, sf))


IMPACT_SQL = """paid AS (SELECT * FROM postings WHERE salary_mid IS NOT NULL),
names AS (SELECT DISTINCT unnest(skills) AS skill FROM paid),
pairs AS (SELECT n.skill, p.salary_mid, list_contains(p.skills, n.skill) AS has FROM names n CROSS JOIN paid p),
moments AS (SELECT skill, count(*) FILTER (has) AS n1, count(*) FILTER (NOT has) AS n2,
    avg(salary_mid) FILTER (has) AS m1, avg(salary_mid) FILTER (NOT has) AS m2,
    var_samp(salary_mid) FILTER (has) AS v1, var_samp(salary_mid) FILTER (NOT has) AS v2 FROM pairs GROUP BY skill),
impact AS (SELECT skill, round(m1, 6) AS avg_salary_with, round(m2, 6) AS avg_salary_without, round(m1 - m2, 6) AS premium,
    round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
    round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df, n1 AS "count"
  FROM moments WHERE n1 >= 3 AND n2 >= 3 AND m1 > m2)"""


def _impact(spark, sf):
    out = market.skill_salary_impact(postings(spark, sf))
    return out.select("skill", *r6("avg_salary_with", "avg_salary_without", "premium", "t"), F.round("df", 4).alias("df"), "count")


@query("g6_skill_salary_impact", f"{P}, {IMPACT_SQL} SELECT * FROM impact")
def g6(spark, sf):
    return _impact(spark, sf)


# The two-sided tail of Student's t by the midpoint rule; s = t + v / (1 - v) carries it to 0 < v < 1.
@query("g6_skill_salary_impact_pvalue", f"""{P}, {IMPACT_SQL},
  tests AS (SELECT skill, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
    pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM moments WHERE n1 >= 3 AND n2 >= 3 AND m1 > m2),
  nodes AS (SELECT (i + 0.5) / 20000.0 AS v FROM range(20000) x(i)),
  tails AS (SELECT skill, any_value(t) AS t, any_value(df) AS df,
    2 * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(any_value(df) * pi()) / 20000
      * sum(pow(1 + pow(t + v / (1 - v), 2) / df, -(df + 1) / 2) / pow(1 - v, 2)) AS p FROM tests, nodes GROUP BY 1)
  SELECT skill, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p_value FROM tails""")
def g6_p(spark, sf):
    out = market.skill_salary_impact(postings(spark, sf))
    return out.select("skill", *r6("t", "p_value"), F.round("df", 4).alias("df"))


@query("t3_topk_premiums", f"{P}, {IMPACT_SQL} SELECT skill, premium FROM impact ORDER BY premium DESC, skill LIMIT 10")
def t3(spark, sf):
    return market.top_premiums(_impact(spark, sf), 10).select("skill", "premium")


def _quartile_sql(kind, name, extra=""):
    return f"""SELECT '{kind}' AS kind, {name} AS name, count(*) AS n, sum(salary_mid) / count(*) AS mean,
    quantile_cont(salary_mid, 0.25) AS p25, quantile_cont(salary_mid, 0.5) AS p50, quantile_cont(salary_mid, 0.75) AS p75
    FROM postings WHERE salary_mid IS NOT NULL GROUP BY 1, 2"""


@query("g7_salary_trends", f"""{P} {_quartile_sql('global', "'all'")} UNION ALL {_quartile_sql('cluster', 'cluster_label')}
  UNION ALL {_quartile_sql('experience', 'experience_level')}""")
def g7(spark, sf):
    return market.salary_trends(postings(spark, sf))


@query("g8_salary_benchmark", f"""{P}, {REQUESTS_SQL}, hits AS (
    SELECT r.role, r.wanted, salary_mid FROM requests r JOIN postings ON contains(lower(job_title), r.role)
      AND (wanted IS NULL OR list_contains([lower(x) for x in location], wanted)) WHERE salary_mid IS NOT NULL),
  stats AS (SELECT role, wanted, median(salary_mid) AS median, sum(salary_mid) / count(*) AS mean, min(salary_mid) AS lo, max(salary_mid) AS hi, count(*) AS n
    FROM hits GROUP BY 1, 2)
  SELECT r.role, r.wanted AS location, coalesce(median, 0) AS median, coalesce(mean, 0) AS mean, coalesce(lo, 0) AS min, coalesce(hi, 0) AS max, coalesce(n, 0) AS "count"
  FROM requests r LEFT JOIN stats s ON r.role = s.role AND r.wanted IS NOT DISTINCT FROM s.wanted""")
def g8(spark, sf):
    return market.salary_benchmark(postings(spark, sf), requests(spark))


def _top_list_sql(kind, expr, n):
    return f"""(SELECT cluster_id, string_agg(v, '|' ORDER BY n DESC, v) AS top_{kind} FROM (
      SELECT cluster_id, v, count(*) AS n FROM (SELECT cluster_id, {expr} AS v FROM postings) GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, v) <= {n}) GROUP BY 1)"""


@query("g9_cluster_profile", f"""{P} SELECT cluster_id, "count", avg_salary, top_companys, top_locations, top_skills
  FROM (SELECT cluster_id, count(*) AS "count", sum(salary_mid) / count(salary_mid) AS avg_salary FROM postings GROUP BY 1)
  JOIN {_top_list_sql('companys', 'company', 5)} USING (cluster_id)
  JOIN {_top_list_sql('locations', 'unnest(location)', 5)} USING (cluster_id)
  JOIN {_top_list_sql('skills', 'unnest(skills)', 10)} USING (cluster_id)""")
def g9(spark, sf):
    out = market.cluster_profile(postings(spark, sf))
    tops = [F.array_join(c, "|").alias(c) for c in ("top_companys", "top_locations", "top_skills")]
    return out.select("cluster_id", "count", "avg_salary", *tops)


@query("w1_topn_per_group", f"""{P} SELECT cluster_id, company, count(*) AS "count",
    CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, company) AS INTEGER) AS rank
  FROM postings GROUP BY 1, 2 QUALIFY rank <= 5""")
def w1(spark, sf):
    return market.value_counts(postings(spark, sf), "company", 5, ["cluster_id"])


ALIGN_SQL = f"""targets AS (SELECT DISTINCT target_role AS role FROM profiles),
  hits AS (SELECT role, experience_min FROM targets JOIN postings ON contains(lower(job_title), role)),
  q AS (SELECT role, quantile_cont(experience_min, 0.25) AS p25, quantile_cont(experience_min, 0.5) AS p50, quantile_cont(experience_min, 0.75) AS p75 FROM hits GROUP BY 1),
  volume AS (SELECT role, experience_min, count(*) AS n FROM hits GROUP BY 1, 2),
  years AS (SELECT DISTINCT target_role AS role, years_experience FROM profiles),
  reach AS (SELECT role, years_experience, sum(CASE WHEN experience_min <= years_experience + 1 THEN n ELSE 0 END) / sum(n) * 100 AS pct
    FROM years JOIN volume USING (role) GROUP BY 1, 2)"""


@query("g10_experience_alignment", f"""{P}, {PROFILES_SQL}, {ALIGN_SQL}
  SELECT profile_id, role, p.years_experience, p25 AS market_p25, p50 AS market_p50, p75 AS market_p75,
    CASE WHEN p.years_experience < p25 THEN 'Under-qualified' WHEN p.years_experience > p75 + 2 THEN 'Over-qualified' ELSE 'Perfectly Matched' END AS status,
    CAST(pct AS DOUBLE) AS accessible_pct
  FROM profiles p JOIN q ON target_role = role JOIN reach USING (role, years_experience)""")
def g10(spark, sf):
    return market.experience_alignment(profiles(spark, sf), postings(spark, sf)).drop("message")


@query("g10_experience_histogram", f'{P} SELECT experience_level, experience_min, count(*) AS "count" FROM postings GROUP BY 1, 2')
def g10_hist(spark, sf):
    return market.experience_histogram(postings(spark, sf), ["experience_level"])


@query("g11_value_counts_topn", f'{P} SELECT company, count(*) AS "count" FROM postings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def g11(spark, sf):
    return market.value_counts(postings(spark, sf), "company", 10)


@query("g12_salary_distribution", f"""{P} SELECT experience_level, count(*) AS n, sum(salary_mid) / count(*) AS mean, min(salary_mid) AS min,
    quantile_cont(salary_mid, 0.25) AS q1, median(salary_mid) AS median, quantile_cont(salary_mid, 0.75) AS q3, max(salary_mid) AS max,
    q1 - (q3 - q1) * 1.5 AS lower_fence, q3 + (q3 - q1) * 1.5 AS upper_fence
  FROM postings WHERE salary_mid IS NOT NULL GROUP BY 1""")
def g12(spark, sf):
    return market.salary_distribution(postings(spark, sf), ["experience_level"])


@query("g12_salary_distribution_orders", """SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 3) AS q1,
    round(median(o_totalprice), 3) AS median, round(quantile_cont(o_totalprice, 0.75), 3) AS q3, max(o_totalprice) AS max
  FROM orders GROUP BY 1""")
def g12_orders(spark, sf):
    orders = table(spark, sf, "orders").withColumn("salary_mid", F.col("o_totalprice"))
    return market.salary_distribution(orders, ["o_orderpriority"]).select(
        "o_orderpriority", "n", "min", *[F.round(c, 3).alias(c) for c in ("q1", "median", "q3")], "max")


@query("g13_entry_experience", f"""{PR} SELECT role, sum(experience_min) / count(*) AS entry_experience FROM (
    SELECT role, experience_min FROM tagged QUALIFY row_number() OVER (PARTITION BY role ORDER BY experience_min) <= 10) GROUP BY 1""")
def g13(spark, sf):
    return market.entry_experience(postings(spark, sf), roles(spark))


@query("g14_modal_cluster", f"""{PR} SELECT role, cluster_id FROM (SELECT role, cluster_id, count(*) AS n FROM tagged GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, cluster_id) = 1""")
def g14(spark, sf):
    return market.modal_cluster(postings(spark, sf), roles(spark))


@query("g15_avg_role_salary", f"{PR} SELECT role, sum(salary_mid) / count(salary_mid) AS avg_salary FROM tagged GROUP BY 1")
def g15(spark, sf):
    return market.role_salary(postings(spark, sf), roles(spark))


@query("g17_top_skills_report", f"""{PR}, {IMPACT_SQL}, f AS ({_frequency_sql('tagged', ['role'])})
  SELECT role, 'top_skills' AS section, CAST(row_number() OVER (PARTITION BY role ORDER BY "count" DESC, skill_name) AS INTEGER) AS rank, skill_name AS skill, round(percentage, 6) AS value
  FROM f QUALIFY rank <= 10
  UNION ALL SELECT * FROM (SELECT 'all', 'salary_premiums', CAST(row_number() OVER (ORDER BY premium DESC, skill) AS INTEGER) AS r, skill, premium FROM impact) WHERE r <= 5""")
def g17(spark, sf):
    out = market.skills_report(postings(spark, sf), roles(spark))
    return out.select("role", "section", "rank", "skill", F.round("value", 6).alias("value"))


# Yesterday's table: the postings scraped before 2000.
@query("g18_new_record_count", f"""{P} SELECT count(*) AS total, count(*) FILTER (scraped_date >= TIMESTAMP '2000-01-01') AS new_records,
    count(*) FILTER (scraped_date < TIMESTAMP '2000-01-01') AS previous_total,
    count(*) FILTER (scraped_date >= TIMESTAMP '2000-01-01') AS difference, new_records > 0 AS should_update FROM postings""")
def g18(spark, sf):
    now = postings(spark, sf).select("job_url", "scraped_date")
    return market.record_change(now, now.where("scraped_date < TIMESTAMP '2000-01-01'"))


@query("w2_first_per_key", f"""{PR} SELECT role, job_url, company FROM tagged
  QUALIFY row_number() OVER (PARTITION BY role ORDER BY job_url) = 1""")
def w2(spark, sf):
    tagged = filters.by_role(postings(spark, sf), roles(spark))
    return clean.drop_duplicate_urls(tagged, "role", ["job_url"]).select("role", "job_url", "company")


@query("t5_known_roles_sorted", f"""{P}, known AS (SELECT lower(job_title) AS role FROM postings UNION SELECT unnest({dims.BASE_ROLES}))
  SELECT role, CAST(length(role) AS INTEGER) AS length FROM known""")
def t5(spark, sf):
    return locations.sort_roles(locations.known_roles(postings(spark, sf))).withColumn("length", F.length("role"))


@query("u1_known_roles", f"""{P} SELECT lower(job_title) AS role FROM postings UNION SELECT unnest({dims.BASE_ROLES})
  UNION SELECT lower(c_mktsegment) FROM customer""")
def u1(spark, sf):
    saved = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("role"))
    return locations.known_roles(postings(spark, sf), saved)


@query("u2_all_locations", f"{P} SELECT trim(unnest(location)) AS location FROM postings UNION SELECT unnest({dims.COMMON_LOCATIONS})")
def u2(spark, sf):
    return locations.all_locations(postings(spark, sf))


@query("u3_role_locations", f"{PR} SELECT DISTINCT role, unnest(location) AS location FROM tagged")
def u3(spark, sf):
    return locations.role_locations(postings(spark, sf), roles(spark))


@query("u4_save_discovered", f"""SELECT DISTINCT lower(c_mktsegment) AS role FROM customer UNION SELECT unnest({dims.BASE_ROLES})""")
def u4(spark, sf):
    known = spark.createDataFrame([(r,) for r in dims.BASE_ROLES], "role string")
    found = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("role"))
    return locations.add_roles(known, found)


@query("u5_merge_profile_skills", f"""WITH {PROFILES_SQL}, names AS (SELECT list(DISTINCT p_name) AS known FROM part WHERE p_name NOT LIKE 'red%')
  SELECT profile_id, array_to_string(list_sort(list_intersect(list_distinct(list_concat(skills, ['blue anvil', 'welding'])), known)), '|') AS skills FROM profiles, names""")
def u5(spark, sf):
    known = table(spark, sf, "part").select(F.col("p_name").alias("skill")).where("p_name NOT LIKE 'red%'")
    resume = profiles(spark, sf).withColumn("resume_skills", F.array(F.lit("blue anvil"), F.lit("welding")))
    out = locations.merge_profile_skills(resume, known)
    return out.select("profile_id", F.array_join("skills", "|").alias("skills"))
