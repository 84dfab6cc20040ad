"""What the findings of round 3 name, on small tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from postforge.operators import lifecycle, pages, tracker


def test_opening_of_a_page_is_one_line(spark):
    html = "<p>ab</p>" * 1100 + "<p>See our open roles</p>"
    r = spark.createDataFrame([(html, "https://x.example/a")], "html string, url string").select(pages.route(F.col("html"), F.col("url")).alias("r")).first()["r"]
    assert (r["route"], r["confidence"]) == ("HTML_FALLBACK", 0.22)


def test_evidence_is_weighed_in_doubles(spark):
    m = spark.createDataFrame([(Decimal("0.55"), "COMPANY_HTML", False)], "source_reliability decimal(2,2), source_type string, is_full_snapshot boolean")
    m = m.withColumns({c: F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") for c in ("last_seen_at", "removed_at")})
    now = F.lit("2001-01-01 01:00:00").cast("timestamp_ntz")
    assert m.select(lifecycle.active_evidence(m, now), lifecycle.removal_evidence(m, now)).first() == (0.55 * 55 * 1.0, 0.55 * 22 * 1.0)


def test_resumes_are_chosen_once_per_user_and_role(spark):
    jobs = spark.createDataFrame([(1, 1, "SWE"), (2, 1, None), (3, 2, "Sales"), (4, 1, "Nurse")], "id long, user_id long, role_family string")
    resumes = spark.createDataFrame([(9, 1, "swe", False), (8, 1, "swe", True), (7, 1, None, False), (6, 1, "", True)], "id long, user_id long, target string, is_default boolean")
    out = tracker.recommended_resume(jobs, resumes)
    assert {r["id"]: r["resume_id"] for r in out.collect()} == {1: 8, 2: 6, 3: None, 4: 6}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # what is joined was reduced first


def test_a_fingerprint_of_the_beginning_is_that_of_the_whole(spark):
    from postforge.functions import text

    word = lambda i: "word" + "".join(chr(97 + int(x)) for x in str(i))
    many = " ".join(map(word, range(900)))
    texts = [many, " ".join(["same"] * 700) + " " + many, "< " + many + " > tail" + many, many.replace(" ", "\n"), "short text here", None]
    whole = lambda c: F.array_join(F.slice(F.array_distinct(text.content_words(c)), 1, 24), "-")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.description_fingerprint(F.col("t")).alias("a"), whole(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
    long = spark.range(1).select(text.description_fingerprint(F.concat(F.lit(many + " "), F.repeat(F.lit("more and more words "), 2_000))).alias("a"))
    assert long.first()["a"] == "-".join(map(word, range(24)))


def test_dear_rows_are_spread(spark):
    from postforge.bindings import view

    parts = view(spark, "/root/testdata/sf0.001", "canonical", "id", dear=True).rdd.glom().map(len).collect()
    assert len(parts) > 4 and sum(parts) == 200 and max(parts) < 100


def test_sections_of_a_resume_are_worked_out_once(spark):
    from postforge.operators import resume

    t = "\n".join(["Skills", *[f"Tool{i}, tool {i}" for i in range(60)], "Summary", "me"])
    s = resume.sections(F.col("t"))
    out = spark.createDataFrame([(t,)] * 20, "t string").select(resume.skills(s["skills"]).alias("k"), s["summary"].alias("m")).collect()
    assert {(len(r["k"]), r["m"]) for r in out} == {(60, "me")}


def test_the_closest_of_classes_is_the_closest_of_pairs(spark):
    from pyspark.sql import Window

    from postforge.operators import matching
    from postforge.plans.queries import _keyed

    rows = "CAST(id AS LONG) AS id, CASE id % 3 WHEN 0 THEN 'Data Analyst' WHEN 1 THEN 'Senior Data Analyst II' ELSE 'Data Quality Analyst' END AS title, 'acme' AS company, 'acme' AS company_key, IF(id % 2 = 0, 'Bern', 'Bonn') AS location, 'many words about the office and further words' AS description, 'SWE' AS role_family, IF(id % 5 = 0, 'US', NULL) AS region, 'REMOTE' AS work_mode, CAST(NULL AS STRING) AS apply_url, IF(id % 11 = 0, NULL, timestampadd(HOUR, CAST((id * {n}) % 4000 AS INT), TIMESTAMP_NTZ'2001-01-01 00:00:00')) AS posted_at"
    known, new = (_keyed(spark.sql(f"SELECT {rows.format(n=n)} FROM range({a}, {b})")).withColumn("arrival", (F.col("id") * 37) % 1009) for a, b, n in ((0, 150, 7919), (1000, 1060, 131)))
    first = Window.partitionBy("new_id").orderBy(F.desc("score"), "known_id")
    pairs = matching.score_pairs(known, new, 45).withColumn("n", F.row_number().over(first)).where("n = 1")
    got = {(r["new_id"], r["known_id"], r["score"]) for r in matching.closest(known, new).collect()}
    assert got == {(r["new_id"], r["known_id"], r["score"]) for r in pairs.collect()} and got
    at = {r["id"]: r["arrival"] for r in known.collect()}
    best = {}
    for r in matching.score_pairs(known, known, 45).collect():
        if at[r["known_id"]] < at[r["new_id"]]:
            best[r["new_id"]] = min(best.get(r["new_id"], (0,)), (-r["score"], at[r["known_id"]], r["known_id"]))
    got = {r["new_id"]: (-r["score"], r["order"], r["known_id"]) for r in matching.closest(known, known, order="arrival", earlier=True).collect()}
    assert got == best
