"""Association, graph, matching and model queries."""

from pyspark.sql import functions as F

from catalog.market_queries import P, PR, ROLES, ROLES_SQL, _frequency_sql, roles
from catalog.registry import query
from catalog.tables import POSTINGS_SQL, PROFILES_SQL, postings, profiles, stored_postings, table
from jobtide import dims
from jobtide.operators import associations as assoc
from jobtide.session import cut_lineage
from jobtide.operators import classify, filters, graph, market, match, salary, transition

TOP20_SQL = f"""top20 AS (SELECT role, skill_name FROM ({_frequency_sql('tagged', ['role'])})
  QUALIFY row_number() OVER (PARTITION BY role ORDER BY "count" DESC, skill_name) <= 20)"""
EDGES_SQL = f"""{PR}, {TOP20_SQL},
  listed AS (SELECT t.role, job_url, skill_name FROM (SELECT role, job_url, unnest(skills) AS skill_name FROM tagged) t JOIN top20 USING (role, skill_name)),
  edges AS (SELECT a.role, a.skill_name AS src, b.skill_name AS dst, count(*) AS weight FROM listed a
    JOIN listed b ON a.role = b.role AND a.job_url = b.job_url AND a.skill_name < b.skill_name GROUP BY 1, 2, 3)"""


def _tagged(spark, sf):
    jobs = stored_postings(spark, sf)
    tagged = filters.by_role(jobs, roles(spark))
    top = market.top_skills(market.skill_frequency(jobs, roles=roles(spark)), 20, ["role"]).select("role", "skill_name")
    return tagged, cut_lineage(top)


@query("j8_skill_pairs", f"""{P}, listed AS (SELECT job_url, unnest(skills) AS s FROM postings)
  SELECT a.job_url, a.s AS src, b.s AS dst FROM listed a JOIN listed b ON a.job_url = b.job_url AND a.s < b.s""")
def j8(spark, sf):
    names = table(spark, sf, "part").select(match.F.initcap("p_name").alias("skill_name")).distinct()
    return assoc.skill_pairs(postings(spark, sf), names)


@query("g16_cooccurrence_counts", EDGES_SQL + " SELECT * FROM edges UNION ALL SELECT role, dst, src, weight FROM edges")
def g16(spark, sf):
    tagged, top = _tagged(spark, sf)
    return assoc.cooccurrence_counts(tagged, top, ["role"])


@query("a4_cooccurrence_edges", EDGES_SQL + " SELECT * FROM edges")
def a4(spark, sf):
    tagged, top = _tagged(spark, sf)
    return assoc.cooccurrence_edges(tagged, top, ["role"])


def _graph(spark, sf):
    # Only pairs that occur more often than by the flat average make an edge here,
    # so that the graphs are not complete.
    tagged, top = _tagged(spark, sf)
    edges = assoc.cooccurrence_edges(tagged, top, ["role"])
    mean = edges.groupBy("role").agg(F.avg("weight").alias("mean"))
    return edges.join(mean, "role").where("weight > mean").drop("mean"), top.withColumnRenamed("skill_name", "node")


CENTRAL_SQL = EDGES_SQL + """, strong AS (SELECT e.* FROM edges e JOIN (SELECT role, avg(weight) AS mean FROM edges GROUP BY 1) USING (role) WHERE weight > mean),
  ends AS (SELECT role, src AS node FROM strong UNION ALL SELECT role, dst FROM strong),
  central AS (SELECT t.role, t.skill_name AS node, coalesce(d, 0) AS degree, coalesce(d, 0) / (n - 1) AS centrality
    FROM top20 t LEFT JOIN (SELECT role, node, count(*) AS d FROM ends GROUP BY 1, 2) x ON t.role = x.role AND t.skill_name = x.node
    JOIN (SELECT role, count(*) AS n FROM top20 GROUP BY 1) c ON t.role = c.role)"""


@query("a5_degree_centrality", CENTRAL_SQL + " SELECT * FROM central")
def a5(spark, sf):
    return graph.degree_centrality(*_graph(spark, sf), ["role"])


def _rounds_sql(rounds=10):
    """Label propagation, a step for each round."""
    steps = ["links AS MATERIALIZED (SELECT role, src AS node, dst AS other FROM strong UNION SELECT role, dst, src FROM strong)",
             "l0 AS MATERIALIZED (SELECT role, skill_name AS node, skill_name AS label FROM top20)"]
    for i in range(rounds):
        steps.append(f"""l{i + 1} AS MATERIALIZED (SELECT role, node, label FROM (
          SELECT role, node, label, count(*) AS n FROM (SELECT k.role, k.node, l.label FROM links k JOIN l{i} l ON k.role = l.role AND k.other = l.node UNION ALL SELECT role, node, label FROM l{i}) GROUP BY 1, 2, 3)
          QUALIFY row_number() OVER (PARTITION BY role, node ORDER BY n DESC, label) = 1)""")
    return ",\n  ".join(steps) + f""",
  labelled AS (SELECT role, node, min(node) OVER (PARTITION BY role, label) AS community FROM l{rounds}),
  ends_in AS (SELECT s.role, a.community AS ca, b.community AS cb FROM strong s JOIN labelled a ON a.role = s.role AND a.node = src JOIN labelled b ON b.role = s.role AND b.node = dst),
  mass AS (SELECT role, community, count(*) AS d FROM (SELECT role, ca AS community FROM ends_in UNION ALL SELECT role, cb FROM ends_in) GROUP BY 1, 2),
  quality AS (SELECT role, inside / m - dd / (4 * m * m) AS modularity FROM (SELECT role, count(*) AS m, count(*) FILTER (ca = cb) AS inside FROM ends_in GROUP BY 1)
    JOIN (SELECT role, sum(d * d) AS dd FROM mass GROUP BY 1) USING (role))"""


LABELS_SQL = CENTRAL_SQL + ", " + _rounds_sql()


@query("a6_skill_communities", LABELS_SQL + " SELECT role, node, community, round(modularity, 9) AS modularity FROM labelled LEFT JOIN quality USING (role)")
def a6(spark, sf):
    edges, nodes = _graph(spark, sf)
    edges, nodes = cut_lineage(edges), cut_lineage(nodes)
    labels = cut_lineage(graph.communities(edges, nodes, ["role"]))
    quality = graph.modularity(edges, labels, ["role"]).withColumn("modularity", F.round("modularity", 9))
    return labels.join(quality, "role", "left")


@query("a7_community_breakdown", LABELS_SQL + """ SELECT role, community, size, CAST(rank AS INTEGER) AS rank, node, centrality FROM (
    SELECT *, count(*) OVER (PARTITION BY role, community) AS size, row_number() OVER (PARTITION BY role, community ORDER BY centrality DESC, node) AS rank
    FROM labelled JOIN central USING (role, node)) WHERE rank <= 8""")
def a7(spark, sf):
    edges, nodes = _graph(spark, sf)
    edges, nodes = cut_lineage(edges), cut_lineage(nodes)
    return graph.community_breakdown(graph.degree_centrality(edges, nodes, ["role"]), graph.communities(edges, nodes, ["role"]), ["role"])


SUPPORT = 0.003
SETS_SQL = f"""{P}, listed AS (SELECT job_url, unnest(skills) AS s FROM postings), n AS (SELECT count(DISTINCT job_url) AS n FROM listed),
  sets AS (
    SELECT [s] AS items, count(*) AS freq FROM listed GROUP BY 1
    UNION ALL SELECT [a.s, b.s], count(*) FROM listed a JOIN listed b ON a.job_url = b.job_url AND a.s < b.s GROUP BY 1
    UNION ALL SELECT [a.s, b.s, c.s], count(*) FROM listed a JOIN listed b ON a.job_url = b.job_url AND a.s < b.s
      JOIN listed c ON b.job_url = c.job_url AND b.s < c.s GROUP BY 1),
  frequent AS (SELECT items, freq, n AS n_baskets, freq / n AS support FROM sets, n WHERE freq / n >= {SUPPORT}),
  rules AS (
    SELECT a.items AS antecedents, c.items AS consequents, s.support, s.support / a.support AS confidence,
      s.support / (a.support * c.support) AS lift, s.support - a.support * c.support AS leverage,
      (1 - c.support) / (1 - s.support / a.support) AS conviction
    FROM frequent s JOIN frequent a ON len(list_intersect(a.items, s.items)) = len(a.items) AND len(a.items) < len(s.items)
    JOIN frequent c ON len(c.items) = len(s.items) - len(a.items) AND list_sort(list_concat(a.items, c.items)) = s.items
    WHERE len(s.items) > 1 AND s.support / (a.support * c.support) >= 1.0),
  ranked AS (SELECT * FROM rules ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, antecedents, consequents LIMIT 150)"""


def _sets(spark, sf):
    return assoc.frequent_skill_sets(postings(spark, sf), SUPPORT)


def _rule_columns(rules):
    numbers = ["support", "confidence", "lift", "leverage", "conviction"]
    return rules.select(F.array_join("antecedents", "|").alias("antecedents"), F.array_join("consequents", "|").alias("consequents"),
                        *[F.round(c, 9).alias(c) for c in numbers])


RULE_SELECT = """SELECT array_to_string(antecedents, '|') AS antecedents, array_to_string(consequents, '|') AS consequents,
  round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift, round(leverage, 9) AS leverage, round(conviction, 9) AS conviction"""


@query("a1_frequent_skill_sets", SETS_SQL + " SELECT array_to_string(items, '|') AS items, freq, n_baskets, support FROM frequent")
def a1(spark, sf):
    return _sets(spark, sf).withColumn("items", F.array_join("items", "|"))


@query("a2_association_rules", f"{SETS_SQL} {RULE_SELECT} FROM rules")
def a2(spark, sf):
    return _rule_columns(assoc.association_rules(_sets(spark, sf)))


@query("t4_topk_rules", f"{SETS_SQL} {RULE_SELECT} FROM ranked")
def t4(spark, sf):
    return _rule_columns(assoc.top_rules(assoc.association_rules(_sets(spark, sf))))


@query("a3_rules_to_edges", SETS_SQL + """ SELECT least(a, b) AS src, greatest(a, b) AS dst, round(max(lift), 9) AS weight
  FROM (SELECT lift, a, unnest(consequents) AS b FROM (SELECT lift, unnest(antecedents) AS a, consequents FROM ranked)) GROUP BY 1, 2""")
def a3(spark, sf):
    edges = assoc.rules_to_edges(assoc.association_rules(_sets(spark, sf)))
    return edges.withColumn("weight", F.round("weight", 9))


# In the stand-in data confidences stay below the 0.25 a strategic rule needs, so
# rules come from bundles of brand, type and size class of the parts of an order.
def _bundles(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    sizes = F.expr("concat('Size ', CAST(p_size % 3 AS INT))")
    items = line.join(part, F.expr("l_partkey = p_partkey")).select("l_orderkey", F.explode(F.array(F.col("p_type"), sizes)).alias("s"))
    return items.groupBy("l_orderkey").agg(F.collect_set("s").alias("skills_list"))


BUNDLE_SQL = """WITH listed AS (SELECT DISTINCT l_orderkey AS k, upper(s[1]) || lower(s[2:]) AS s FROM (
    SELECT l_orderkey, unnest([p_type, 'Size ' || (p_size % 3)]) AS s FROM lineitem JOIN part ON l_partkey = p_partkey)),
  n AS (SELECT count(DISTINCT k) AS n FROM listed),
  one AS (SELECT s, count(*) / any_value(n) AS p FROM listed, n GROUP BY s),
  two AS (SELECT a.s AS a, b.s AS b, NULL AS c, count(*) / any_value(n) AS p FROM listed a JOIN listed b ON a.k = b.k AND a.s < b.s, n GROUP BY 1, 2),
  three AS (SELECT a.s AS a, b.s AS b, c.s AS c, count(*) / any_value(n) AS p FROM listed a JOIN listed b ON a.k = b.k AND a.s < b.s JOIN listed c ON b.k = c.k AND b.s < c.s, n GROUP BY 1, 2, 3),
  splits AS (SELECT [a] AS ant, b AS con, p FROM two UNION ALL SELECT [b], a, p FROM two
    UNION ALL SELECT [a, b], c, p FROM three UNION ALL SELECT [a, c], b, p FROM three UNION ALL SELECT [b, c], a, p FROM three),
  antecedent AS (SELECT [s] AS ant, p FROM one UNION ALL SELECT [a, b], p FROM two),
  rules AS (SELECT s.ant, s.con, s.p / x.p AS confidence, s.p / (x.p * y.p) AS lift FROM splits s JOIN antecedent x ON s.ant = x.ant JOIN one y ON s.con = y.s
    WHERE s.p >= 0.05 AND s.p / (x.p * y.p) >= 1.0 AND s.p / x.p >= 0.25 AND lower(s.con) NOT IN ('economy')),
  strategic AS (SELECT * FROM rules ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, ant, [con] LIMIT 10)"""


def _strategic(spark, sf):
    rules = assoc.association_rules(assoc.frequent_skill_sets(_bundles(spark, sf), 0.05), max_consequent=1)
    return assoc.strategic_rules(rules, "Economy")


@query("l10_filter_strategic_rules", BUNDLE_SQL + """ SELECT array_to_string(ant, '|') AS antecedents, con AS consequent, round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM strategic""")
def l10(spark, sf):
    return _strategic(spark, sf).select(F.array_join("antecedents", "|").alias("antecedents"), F.get("consequents", 0).alias("consequent"),
                                        F.round("confidence", 9).alias("confidence"), F.round("lift", 9).alias("lift"))


@query("a8_insight_rows", BUNDLE_SQL + """ SELECT array_to_string(ant, ', ') AS if_you_have, con AS you_likely_need,
  printf('%.1f%%', confidence * 100) AS probability, printf('%.2fx', lift) AS market_strength FROM strategic""")
def a8(spark, sf):
    return assoc.insight_rows(_strategic(spark, sf))


@query("e8_association_report")
def e8(spark, sf):
    from jobtide.plans.reports import association_report

    return association_report(stored_postings(spark, sf), "building", min_support=0.01)


# ------------------------------------------------------------------ matching

NEEDS = "CASE cluster_id % 4 WHEN 1 THEN {0}'Bachelor''s'{1} WHEN 2 THEN {0}'MBA', 'PhD'{1} WHEN 3 THEN {0}'M.Tech/M.E'{1} ELSE {2} END"


def _jobs(spark, sf):
    jobs = stored_postings(spark, sf)
    needs = F.expr(NEEDS.format("array(", ")", "CAST(array() AS array<string>)"))
    return jobs.withColumn("education_extracted", needs)


COVERS_SQL = "list_distinct(list_concat(own, [need for need in ['phd', 'master''s', 'mba', 'b.tech/b.e', 'bachelor''s'] if list_has_any(own, CASE need " + " ".join(
    f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN [{', '.join(chr(39) + a.replace(chr(39), chr(39) * 2) + chr(39) for a in v)}]" for k, v in dims.EDUCATION_COVERS.items()) + " END)]))"
SCORED_SQL = f"""{P}, {PROFILES_SQL},
  users AS (SELECT profile_id, target_role, years_experience AS years, [lower(s) for s in skills] AS us, [lower(x) for x in locations] AS places, {COVERS_SQL} AS covers
    FROM (SELECT *, [lower(e) for e in education] AS own FROM profiles)),
  jobs AS (SELECT *, [lower(e) for e in needs] AS needs_low, [lower(s) for s in skills] AS js, [lower(x) for x in location] AS cities
    FROM (SELECT *, {NEEDS.format('[', ']', '[]')} AS needs FROM postings)),
  scored AS (SELECT profile_id, job_url, job_title, company, skills, us,
      (len(list_intersect(us, js)) / len(js)) * 30 AS skill_points,
      CASE WHEN years >= experience_min THEN 60 - least((years - experience_min) * 4, 20) ELSE greatest(0, 60 - (experience_min - years) * 15) END AS experience_points,
      CASE WHEN len(needs) = 0 OR list_has_any(needs_low, covers) THEN 10 ELSE 0 END AS education_points,
      round(skill_points + experience_points + education_points, 9) AS match_score
    FROM users JOIN jobs ON contains(lower(job_title), target_role) AND experience_min <= years + 3 AND list_has_any(places, cities)),
  best AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY match_score DESC, job_url) AS INTEGER) AS rank FROM scored QUALIFY rank <= 15)"""


@query("j7_profile_posting_match", SCORED_SQL + """ SELECT p.profile_id, count(job_url) AS n_matches FROM profiles p LEFT JOIN scored USING (profile_id) GROUP BY 1""")
def j7(spark, sf):
    return match.count_matches(profiles(spark, sf), _jobs(spark, sf))


@query("m1_match_score", SCORED_SQL + """ SELECT profile_id, rank, job_url, match_score, round(skill_points, 9) AS skill_points,
    CAST(experience_points AS DOUBLE) AS experience_points, CAST(education_points AS DOUBLE) AS education_points FROM best""")
def m1(spark, sf):
    people, jobs = cut_lineage(profiles(spark, sf)), _jobs(spark, sf)
    return match.match_parts(match.match_profiles(people, jobs), people, jobs)


@query("t2_topk_matches", SCORED_SQL + " SELECT profile_id, rank, job_url, match_score FROM best")
def t2(spark, sf):
    return match.match_profiles(profiles(spark, sf), _jobs(spark, sf)).select("profile_id", "rank", "job_url", "match_score")


EXPLAIN_SQL = SCORED_SQL + """ SELECT profile_id, rank, job_url, job_title, company, match_score,
    array_to_string([lower(s) for s in skills if list_contains(us, lower(s))], '|') AS matched_skills,
    array_to_string([lower(s) for s in skills if NOT list_contains(us, lower(s))][1:8], '|') AS missing_skills,
    CASE WHEN match_score > 70 THEN 'high' WHEN match_score > 40 THEN 'medium' ELSE 'low' END AS band FROM best"""


def _explained(out):
    return out.withColumns({c: F.array_join(c, "|") for c in ("matched_skills", "missing_skills")})


@query("m2_match_explain", EXPLAIN_SQL)
def m2(spark, sf):
    people, jobs = cut_lineage(profiles(spark, sf)), _jobs(spark, sf)
    return _explained(match.match_explain(match.match_profiles(people, jobs), people, jobs))


@query("e7_job_matches", EXPLAIN_SQL)
def e7(spark, sf):
    from jobtide.plans.reports import job_matches

    return _explained(job_matches(profiles(spark, sf), _jobs(spark, sf)))


GAP_SQL = f"""{P}, {PROFILES_SQL}, roles AS (SELECT DISTINCT target_role AS role FROM profiles),
  tagged AS (SELECT r.role, p.* FROM postings p JOIN roles r ON contains(lower(job_title), role)),
  f AS ({_frequency_sql('tagged', ['role'])}),
  market AS (SELECT *, CAST(row_number() OVER (PARTITION BY role ORDER BY "count" DESC, skill_name) AS INTEGER) AS rank FROM f QUALIFY rank <= 20),
  gap AS (SELECT profile_id, role, rank, skill_name AS skill, percentage, list_contains([lower(s) for s in skills], lower(skill_name)) AS matched
    FROM profiles JOIN market ON target_role = role)"""


@query("j9_gap_join", GAP_SQL + " SELECT * FROM gap")
def j9(spark, sf):
    return match.skill_gap(profiles(spark, sf), postings(spark, sf))


@query("m3_gap_score", GAP_SQL + """ SELECT profile_id, role, count(*) FILTER (matched) / count(*) * 100 AS score,
    coalesce(string_agg(skill, '|' ORDER BY rank) FILTER (matched), '') AS matched, coalesce(string_agg(skill, '|' ORDER BY rank) FILTER (NOT matched), '') AS missing
  FROM gap GROUP BY 1, 2""")
def m3(spark, sf):
    out = match.gap_score(match.skill_gap(profiles(spark, sf), postings(spark, sf)))
    return out.withColumns({c: F.array_join(c, "|") for c in ("matched", "missing")})


@query("m4_career_gap_plan", GAP_SQL + """ SELECT profile_id, role, coalesce(string_agg(skill, '|' ORDER BY rank) FILTER (matched), '') AS have,
    array_to_string((list(skill ORDER BY rank) FILTER (NOT matched))[1:5], '|') AS critical_gaps, count(*) FILTER (NOT matched) AS n_missing,
    CAST(greatest(2.0, n_missing * 1.5) AS DOUBLE) AS months_from, CAST(greatest(2.0, n_missing * 1.5) + 3 AS DOUBLE) AS months_to
  FROM gap WHERE rank <= 15 GROUP BY 1, 2""")
def m4(spark, sf):
    plan = match.career_gap_plan(match.skill_gap(profiles(spark, sf), postings(spark, sf), 15))
    return plan.withColumns({c: F.array_join(c, "|") for c in ("have", "critical_gaps")})


@query("m5_education_match", f"""WITH {PROFILES_SQL}, u AS (SELECT profile_id, {COVERS_SQL} AS covers FROM (SELECT *, [lower(e) for e in education] AS own FROM profiles)),
  needs AS (SELECT unnest(['none', 'phd', 'master''s', 'mba', 'b.tech/b.e', 'm.tech/m.e', 'bachelor''s']) AS need)
  SELECT profile_id, need, CASE WHEN need = 'none' OR list_contains(covers, need) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS edu_match FROM u, needs""")
def m5(spark, sf):
    needs = ["none", "phd", "master's", "mba", "b.tech/b.e", "m.tech/m.e", "bachelor's"]
    pairs = profiles(spark, sf).withColumn("need", F.explode(F.array(*[F.lit(n) for n in needs])))
    required = F.when(F.col("need") != "none", F.array("need")).otherwise(F.array().cast("array<string>"))
    return pairs.select("profile_id", "need", match.education_match(F.col("education"), required).alias("edu_match"))


@query("m6_synonym_normalize", f"""WITH w AS (SELECT DISTINCT lower(trim(p_name)) AS skill FROM part UNION SELECT unnest({sorted(dims.CANONICAL_SYNONYMS)}))
  SELECT skill, CASE skill {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.CANONICAL_SYNONYMS.items())} ELSE skill END AS normal FROM w""")
def m6(spark, sf):
    extra = spark.createDataFrame([(k,) for k in dims.CANONICAL_SYNONYMS], "skill string")
    names = table(spark, sf, "part").select(F.lower(F.trim("p_name")).alias("skill")).union(extra).distinct()
    return names.select("skill", transition.normalize_skill(F.col("skill")).alias("normal"))


REP_SQL = f"""{PR}, f AS ({_frequency_sql('tagged', ['role'])}),
  market AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY "count" DESC, skill_name) AS rank FROM f QUALIFY rank <= 20),
  lists AS (SELECT role, list(skill_name ORDER BY rank) AS names, list(percentage ORDER BY rank) AS pcts FROM market GROUP BY 1),
  entry AS (SELECT role, sum(experience_min) / count(*) AS experience_min FROM (
    SELECT role, experience_min FROM tagged QUALIFY row_number() OVER (PARTITION BY role ORDER BY experience_min) <= 10) GROUP BY 1),
  firsts AS (SELECT role, arg_min(location, job_url) AS location FROM tagged GROUP BY 1),
  rep AS (SELECT * FROM firsts JOIN lists USING (role) JOIN entry USING (role))"""


@query("m7_representative_job", REP_SQL + " SELECT role, array_to_string(names, '|') AS skills, experience_min, array_to_string(location, '|') AS location FROM rep")
def m7(spark, sf):
    out = transition.representative_jobs(stored_postings(spark, sf), roles(spark))
    return out.select("role", F.array_join(F.col("skills.skill"), "|").alias("skills"), "experience_min", F.array_join("location", "|").alias("location"))


@query("m8_transition_features", REP_SQL + f""", {PROFILES_SQL}, u AS (SELECT profile_id, years_experience, [lower(s) for s in skills] AS us, [lower(x) for x in locations] AS places FROM profiles)
  SELECT profile_id, role, round(list_sum([CASE WHEN list_contains(us, lower(names[i])) THEN pcts[i] ELSE 0 END for i in range(1, len(names) + 1)]) / list_sum(pcts), 9) AS skill_ratio,
    experience_min - years_experience AS exp_gap, CASE WHEN list_has_any([lower(x) for x in location], places) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS loc_match,
    1.0::DOUBLE AS edu_match, CAST(len(names) AS DOUBLE) AS difficulty FROM u, rep""")
def m8(spark, sf):
    people = transition.with_roles(profiles(spark, sf), ROLES)
    out = transition.transition_features(people, transition.representative_jobs(stored_postings(spark, sf), roles(spark)))
    return out.drop("missing").withColumn("skill_ratio", F.round("skill_ratio", 9))


DOC_FEATURES = ["n_chars", "n_words", "n_lines", "mean_word", "upper_share"]


def _labelled(spark, sf):
    words = F.size(F.split("text", r"\s+"))
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"), (F.length("text") / words).alias("mean_word"),
        (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("upper_share"))
    return docs.join(table(spark, sf, "labels"), "doc_id").withColumn("label", F.col("quality"))


@query("m9_transition_probabilities")
def m9_rows(spark, sf):
    return transition.train_transition(_labelled(spark, sf), DOC_FEATURES).probability(_labelled(spark, sf)).select("doc_id", "label", "probability")


@query("m11_feature_weights_learnt")
def m11_rows(spark, sf):
    return transition.feature_weights(spark, transition.train_transition(_labelled(spark, sf), DOC_FEATURES))


@query("m14_predicted_salaries")
def m14_rows(spark, sf):
    people = profiles(spark, sf).withColumn("cluster_label", F.concat(F.lit("Cluster "), F.substring("profile_id", 2, 20).cast("long") % 20))
    return salary.predict_salary(people, salary.train_salary_model(postings(spark, sf), trees=100)).select("profile_id", "cluster_label", "predicted_salary")


@query("c4_coordinates")
def c4_rows(spark, sf):
    return classify.tfidf_pca(table(spark, sf, "documents").select("doc_id", "text"))


@query("m9_transition_train", "SELECT doc_id, quality AS label, true AS is_probability, true AS better_than_chance FROM documents JOIN labels USING (doc_id)")
def m9(spark, sf):
    model = transition.train_transition(_labelled(spark, sf), DOC_FEATURES)
    p = F.col("probability")
    return model.probability(_labelled(spark, sf)).select(
        "doc_id", "label", p.between(0, 1).alias("is_probability"), F.lit(0.5 < model.auc <= 1).alias("better_than_chance"))


_FLAT_SQL = "SELECT unnest(['intercept', " + ", ".join(f"'{f}'" for f in DOC_FEATURES) + "]) AS feature"


@query("m11_feature_weights", f"WITH f AS ({_FLAT_SQL}) SELECT feature, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS n, true AS optimal, true AS listed FROM f")
def m11(spark, sf):
    rows = _labelled(spark, sf)
    model = transition.train_transition(rows, DOC_FEATURES)
    listed = transition.feature_weights(spark, model).select("feature", F.col("weight").isNotNull().alias("listed"))
    slopes = transition.loss_slopes(model, rows).withColumn("n", rows.agg(F.count(F.lit(1))).scalar())
    return slopes.join(listed, "feature", "left").select(
        "feature", "n", (F.abs("slope") < 1e-4).alias("optimal"), (F.coalesce("listed", F.col("feature") == "intercept")).alias("listed"))


# A model held as a table: position, feature, mean, deviation, weight.
HELD = [(0, "skill_ratio", 0.4, 0.3, 1.5), (1, "exp_gap", 0.0, 4.0, -1.0), (2, "loc_match", 0.5, 0.5, 0.4),
        (3, "edu_match", 0.8, 0.4, 0.3), (4, "difficulty", 15.0, 5.0, -0.2), (5, None, None, None, 0.1)]
_Z = "0.1 + " + " + ".join(f"({w}) * (({f} - {m}) / {d})" for _, f, m, d, w in HELD[:-1])
SCORE_SQL = REP_SQL + f""", {PROFILES_SQL}, u AS (SELECT profile_id, years_experience, [lower(s) for s in skills] AS us, [lower(x) for x in locations] AS places FROM profiles),
  feats AS (SELECT profile_id, role, list_sum([CASE WHEN list_contains(us, lower(names[i])) THEN pcts[i] ELSE 0 END for i in range(1, len(names) + 1)]) / list_sum(pcts) AS skill_ratio,
    experience_min - years_experience AS exp_gap, CASE WHEN list_has_any([lower(x) for x in location], places) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS loc_match,
    1.0::DOUBLE AS edu_match, CAST(len(names) AS DOUBLE) AS difficulty, [n for n in names if NOT list_contains(us, lower(n))] AS missing FROM u, rep),
  scored AS (SELECT *, CAST(1 / (1 + exp(-({_Z}))) AS DOUBLE) AS p FROM feats)"""


def _held_model(spark):
    return transition.held_model(spark.createDataFrame(HELD, "position int, feature string, mean double, deviation double, weight double"))


@query("m10_transition_score", SCORE_SQL + """ SELECT profile_id, role, round_even(p * 100, 1) AS probability,
    CASE WHEN p > 0.75 THEN 'High' WHEN p > 0.4 THEN 'Moderate' ELSE 'Low' END AS confidence,
    printf('%.1f%%', round_even(skill_ratio * 100, 1)) AS skill_match, printf('%.1f years', round_even(exp_gap, 1)) AS experience_fit,
    CASE WHEN loc_match > 0.5 THEN 'Yes' ELSE 'No' END AS location_alignment, 'High' AS education_compatibility,
    CASE WHEN difficulty > 12 THEN 'High' WHEN difficulty > 6 THEN 'Medium' ELSE 'Normal' END AS role_complexity,
    array_to_string(missing[1:8], '|') AS missing_skills,
    CASE WHEN p > 0.8 THEN '🚀 High success potential! You are a strong candidate.'
      WHEN p > 0.5 THEN '💡 Moderate potential. Consider learning: ' || array_to_string(missing[1:3], ', ') || '.'
      ELSE '⚠️ Difficult transition. Focus on skill building or lower experience roles.' END AS recommendation FROM scored""")
def m10(spark, sf):
    people = transition.with_roles(profiles(spark, sf), ROLES)
    rows = transition.transition_features(people, cut_lineage(transition.representative_jobs(stored_postings(spark, sf), roles(spark))))
    return transition.transition_score(rows, _held_model(spark)).withColumn("missing_skills", F.array_join("missing_skills", "|"))


@query("m12_transition_matrix", SCORE_SQL + " SELECT profile_id, role, round_even(p * 100, 1) AS probability FROM scored")
def m12(spark, sf):
    return transition.transition_matrix(profiles(spark, sf), stored_postings(spark, sf), _held_model(spark), ROLES)


@query("m13_salary_model_train", f"""{P}, n AS (SELECT count(DISTINCT cluster_label) AS labels FROM postings WHERE salary_mid IS NOT NULL)
  SELECT CAST(unnest(range(0, labels + 3)) AS INTEGER) AS input, 100 AS trees, true AS is_share, true AS shares_sum_to_one FROM n""")
def m13(spark, sf):
    model = salary.train_salary_model(postings(spark, sf), trees=100)
    shares = model.importances()
    rows = [(n, len(model.trees), bool(0 <= w <= 1), bool(abs(shares.sum() - 1) < 1e-6)) for n, w in enumerate(shares)]
    return spark.createDataFrame(rows, "input int, trees int, is_share boolean, shares_sum_to_one boolean")


# The forest must explain salaries it has seen better than their mean does; SQL gives the mean's error.
@query("m13_salary_model_error", f"""{P} SELECT cluster_label, count(*) AS n, round(var_pop(salary_mid) , 6) AS mean_error, true AS better_than_the_mean
  FROM postings WHERE salary_mid IS NOT NULL AND cluster_label IS NOT NULL GROUP BY 1""")
def m13_error(spark, sf):
    jobs = stored_postings(spark, sf).where("salary_mid IS NOT NULL AND cluster_label IS NOT NULL")
    model = salary.train_salary_model(jobs, trees=20)
    seen = jobs.select("cluster_label", "salary_mid", F.col("experience_min").alias("years_experience"), F.col("skills_list").alias("skills"))
    found = salary.predict_salary(seen, model)
    error = F.avg(F.pow(F.col("predicted_salary") - F.col("salary_mid"), 2))
    return found.groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.var_pop("salary_mid"), 6).alias("mean_error"), (error < F.var_pop("salary_mid")).alias("better_than_the_mean"))


@query("m14_salary_predict", f"""WITH {PROFILES_SQL} SELECT profile_id, 'Cluster ' || (CAST(substr(profile_id, 2) AS BIGINT) % 20) AS cluster_label,
    true AS inside_the_range FROM profiles""")
def m14(spark, sf):
    jobs = stored_postings(spark, sf)
    model = salary.train_salary_model(jobs, trees=100)
    people = profiles(spark, sf).withColumn("cluster_label", F.concat(F.lit("Cluster "), F.substring("profile_id", 2, 20).cast("long") % 20))
    seen = jobs.agg(F.struct(F.min("salary_mid").alias("low"), F.max("salary_mid").alias("high")).alias("s")).scalar()
    out = salary.predict_salary(people, model).withColumn("_seen", seen)
    inside = F.col("predicted_salary").between(F.col("_seen.low") - 0.01, F.col("_seen.high") + 0.01)
    return out.select("profile_id", "cluster_label", inside.alias("inside_the_range"))


# ------------------------------------------------------------ classification

STOP = ["the", "and", "of", "der", "die", "la", "el", "les"]
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


def _prototypes(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("cluster_id"), F.concat(F.lit("Item "), "item_id").alias("cluster_label"), "text")


TOKENS_SQL = f"""texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', item_id, text FROM benchmark),
  words AS (SELECT kind, id, [w for w in regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1) if w NOT IN {STOP_SQL}] AS ws FROM texts),
  toks AS (SELECT kind, id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) AS term FROM words),
  tf AS (SELECT kind, id, term, count(*) AS n FROM toks GROUP BY 1, 2, 3),
  vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 2000),
  raw_w AS (SELECT kind, id, term, n * idf AS w FROM tf JOIN vocab USING (term)),
  unit AS (SELECT kind, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS w FROM raw_w),
  sim AS (SELECT d.id AS doc_id, p.id AS cluster_id, round(sum(d.w * p.w), 9) AS similarity FROM unit d JOIN unit p ON d.term = p.term AND d.kind = 'd' AND p.kind = 'p' GROUP BY 1, 2),
  best AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, cluster_id) = 1),
  classified AS (SELECT d.doc_id, coalesce(cluster_id, (SELECT min(item_id) FROM benchmark)) AS cluster_id, coalesce(similarity, 0.0) AS similarity FROM documents d LEFT JOIN best USING (doc_id))"""


def _classified(spark, sf, **kw):
    return classify.classify_by_prototype(table(spark, sf, "documents").select("doc_id", "text"), _prototypes(spark, sf), stop=STOP, **kw)


@query("c1_classify_by_prototype", f"WITH {TOKENS_SQL} SELECT doc_id, cluster_id, 'Item ' || cluster_id AS cluster_label, similarity FROM classified")
def c1(spark, sf):
    return _classified(spark, sf).select("doc_id", "cluster_id", "cluster_label", "similarity")


@query("c2_stop_words", f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS word FROM documents)
  SELECT word, count(*) AS n FROM w WHERE word NOT IN {STOP_SQL} GROUP BY 1""")
def c2(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(classify.terms(F.col("text"), STOP, bigrams=False)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("c3_cluster_keywords", f"""WITH {TOKENS_SQL},
  means AS (SELECT cluster_id, term, round(sum(w) / any_value(size), 9) AS weight FROM unit JOIN classified ON kind = 'd' AND id = doc_id
    JOIN (SELECT cluster_id, count(*) AS size FROM classified GROUP BY 1) USING (cluster_id) GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rank FROM means QUALIFY rank <= 10)
  SELECT item_id AS cluster_id, CAST(coalesce(rank, 1) AS INTEGER) AS rank, coalesce(term, 'no_data') AS term, coalesce(weight, 0.0) AS weight FROM benchmark LEFT JOIN ranked ON item_id = cluster_id""")
def c3(spark, sf):
    # Classes and keywords have one vocabulary, that of all documents and prototypes.
    vocab = classify.vocabulary(table(spark, sf, "documents").select("text").union(_prototypes(spark, sf).select("text")), 2000, STOP)
    return classify.cluster_keywords(_classified(spark, sf, vocab=vocab), _prototypes(spark, sf), stop=STOP, vocab=vocab)


@query("j10_classify_cross", f"WITH {TOKENS_SQL} SELECT doc_id, cluster_id, similarity FROM sim")
def j10(spark, sf):
    docs, protos = table(spark, sf, "documents").select("doc_id", "text"), _prototypes(spark, sf)
    return classify.similarities(docs, protos, stop=STOP)


@query("c4_tfidf_pca_2d", "SELECT doc_id, true AS finite, true AS centred, true AS uncorrelated, true AS ordered FROM documents")
def c4(spark, sf):
    points = cut_lineage(classify.tfidf_pca(table(spark, sf, "documents").select("doc_id", "text")))
    facts = points.agg(
        (F.greatest(F.abs(F.avg("pca_x")), F.abs(F.avg("pca_y"))) < 1e-9).alias("centred"),
        (F.abs(F.covar_pop("pca_x", "pca_y")) < 1e-9).alias("uncorrelated"),
        (F.var_pop("pca_x") >= F.var_pop("pca_y")).alias("ordered"))
    finite = ~(F.isnan("pca_x") | F.isnan("pca_y") | F.col("pca_x").isNull())
    return points.select("doc_id", finite.alias("finite")).crossJoin(F.broadcast(facts))  # one row
