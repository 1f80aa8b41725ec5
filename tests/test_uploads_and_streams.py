"""Uploads through typing to profiles, storage, and streams against batch results."""

import random

from pyspark.sql import functions as F

from rollcall.operators import attempts, columns, intake, truth
from rollcall.sources import store, uploads
from rollcall.streaming import jobs

CSV = '''Contact Name,email_address,Company,Job Title,Deal Stage,Internal Notes,LinkedIn Profile,Tags,record_id
Vera Castell,vera@globex.example,Globex,Engineer,won,"Met twice. Likes boats,
and trains.",www.linkedin.com/in/vera,a;b,r1
,,,,,,,,r2
Otto Brand,otto@initech.example,,Chef,lost,Short,,c,r3
'''


def upload(spark, tmp_path):
    (tmp_path / "u.csv").write_text(CSV, encoding="utf-8")
    return uploads.with_positions(uploads.read_csv(spark, str(tmp_path / "u.csv")))


def test_csv_to_profiles(spark, tmp_path):
    df = upload(spark, tmp_path)
    mappings = columns.detect_columns(df, "source_row")
    assert [(m.source_column, m.field_type) for m in mappings] == [
        ("Contact Name", "identity_name"), ("email_address", "identity_email"), ("Company", "identity_org"), ("Job Title", "identity_title"),
        ("Deal Stage", "metadata"), ("Internal Notes", "content"), ("LinkedIn Profile", "identity_linkedin"), ("Tags", "metadata"), ("record_id", "ignore")]
    profiles = intake.drop_junk(intake.rows_to_profiles(df, mappings)).orderBy("source_row").collect()
    assert [p.name for p in profiles] == ["Vera Castell", "Otto Brand"]
    assert profiles[0].linkedin_url == "https://www.linkedin.com/in/vera" and profiles[0].linkedin_url_source == "user"
    assert profiles[0].content_fields[0].key == "internal_notes" and "trains" in profiles[0].content_fields[0].value


def test_lying_column_names(spark):
    df = spark.createDataFrame([(i, "Yes", "none", "Ana Sol", "x@y.example") for i in range(4)], ["n", "On LinkedIn?", "Email ok", "Speakers", "Where"])
    kinds = {m.source_column: m.field_type for m in columns.detect_columns(df, "n")}
    assert kinds == {"On LinkedIn?": "identity_name", "Email ok": "metadata", "Speakers": "metadata", "Where": "identity_email"}


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "u.json").write_text('[{"a": 1, "b": null, "c": ["x", "y"]}, {"a": "z", "b": "w", "c": []}]')
    assert [tuple(r) for r in uploads.read_json(spark, str(tmp_path / "u.json")).collect()] == [("1", "", '["x","y"]'), ("z", "w", "[]")]
    lines = spark.createDataFrame([('v,"q, r"',)], "value STRING")
    assert tuple(uploads.parse_csv_lines(lines, ["a", "b"]).first()) == ("v", "q, r")


def test_ground_truth_and_source_columns(spark, tmp_path):
    head = "profile_id,uploaded_name,email,true_linkedin_url,true_website_url,true_twitter_url,true_is_hidden,notes\n"
    (tmp_path / "g.csv").write_text(head + "p1,N,e,https://www.LinkedIn.com/in/A/?x=1,,,Yes,\n ,N,e,,,,no,\n")
    rows = uploads.read_ground_truth(spark, str(tmp_path / "g.csv")).collect()
    assert len(rows) == 1 and rows[0].true_linkedin_url == "https://www.linkedin.com/in/a/" and rows[0].true_is_hidden
    df = spark.createDataFrame([("Ana", "Sol", "Globex", "a@b.example")], ["First Name", "Surname", "Employer", "E-mail"])
    assert uploads.source_rows(df).select("name", "organization", "email").first()[:] == ("Ana Sol", "Globex", "a@b.example")


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "profiles")
    df = spark.createDataFrame([("1", "d1", "a1", "Ana", "odd"), ("2", "d2", "a2", "Bo", "enriched")], "id STRING, dataset_id STRING, account_id STRING, name STRING, enrichment_status STRING")
    store.save_profiles(df.withColumns({"email": F.lit(""), "linkedin_url": F.lit(""), "organization": F.lit("")}), path)
    loaded = store.load_profiles(spark, path, "a1")
    row = loaded.collect()
    assert len(row) == 1 and row[0].enrichment_status == "pending" and len(row[0].person_id) == 12
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(account_id" in plan


def test_sample_is_spread(spark):
    df = spark.createDataFrame([(str(i), "n", f"u{i}@{'gmail.com' if i % 3 else 'uni.edu'}", "", "t", "", "pending") for i in range(300)],
                               "id STRING, name STRING, email STRING, organization STRING, title STRING, linkedin_url STRING, enrichment_status STRING")
    picked = truth.stratified_sample(df, 20)
    counts = {r.cohort: r["count"] for r in picked.groupBy("cohort").count().collect()}
    assert counts == {"personal+noorg": 10, "edu+noorg": 10}
    assert {r.id for r in picked.collect()} == {r.id for r in truth.stratified_sample(df, 20).collect()}


def test_ingest_keeps_the_newest_version(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    mappings = [columns.FieldMapping("name", "identity_name", "name", (), 0.9)]
    schema = "source_row LONG, name STRING"
    for names in (["Ana", "Bo", ""], ["Ana Sol"]):
        spark.createDataFrame(list(enumerate(names)), schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = jobs.read_files(spark, str(folder), schema)
        jobs.run_to_end(jobs.write_batches(jobs.ingest(stream, mappings), table, state))
    rows = jobs.current_rows(spark.read.parquet(table), "source_row").orderBy("source_row").collect()
    assert [r.name for r in rows] == ["Ana Sol", "Bo"]


def fold(events):
    held = []
    for pid, rating in events:
        if rating == "yes":
            continue
        held = [h for h in held if h[0] != pid]
        if rating == "strong_yes":
            if len(held) < 10:
                held.append((pid, 95))
            continue
        if len(held) >= 10:
            low = [h for h in held if h[1] <= 20]
            if low:
                held.remove(low[0])
        held.append((pid, 5))
    return held


def test_exemplars_equal_a_plain_fold(spark, tmp_path):
    rng = random.Random(9)
    events = [(i, rng.choice("xy"), f"p{rng.randrange(25)}", rng.choice(["strong_yes", "yes", "no", "strong_no"]), "") for i in range(400)]
    schema = "event_id LONG, search_id STRING, profile_id STRING, rating STRING, reason STRING"
    folder, table, state = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")
    for part in (events[:150], events[150:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_files(spark, folder, schema)
        jobs.run_to_end(jobs.write_batches(jobs.live_exemplars(stream), table, state))
    rows = jobs.newest_exemplars(spark.read.parquet(table)).collect()
    for key in "xy":
        got = [(r.profile_id, r.score) for r in sorted(rows, key=lambda r: r.place) if r.search_id == key]
        assert got == fold([(p, r) for _, s, p, r, _ in events if s == key])


def test_live_attempts_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["Trying LinkedIn: https://l/in/z", "  Verify name: MATCH ({x}, strength=strong)", "  Verify org: MATCH (x)", "  Verify result: ACCEPTED (score=5, checks=1)",
             "  Verify result: REJECTED (score=1, checks=0)", "  Verify name: MISMATCH (x)"]
    lines = [("hot" if i % 3 == 0 else f"p{i % 7}", i, rng.choice(kinds), 1000 + i) for i in range(600)]
    schema = "profile_id STRING, pos LONG, line STRING, sec LONG"
    folder, table, state = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_files(spark, folder, schema).withColumn("ts", F.timestamp_seconds("sec"))
        jobs.run_to_end(jobs.write_attempts(stream, table, state, chunk=16))
        return {(r.profile_id, r.attempt_no): r for r in jobs.current_attempts(spark.read.parquet(table)).collect()}

    # Each micro-batch ends somewhere inside attempts; some bring no line that tells anything.
    for part in (lines[:250], lines[250:253], [("p1", 253, "  Searching", 1253)], lines[254:600]):
        got = run(part)
    batch = attempts.parse_attempts(spark.createDataFrame([x[:3] for x in lines if x[1] != 253], "profile_id STRING, pos LONG, line STRING"), 16)
    want = {(r.profile_id, r.attempt_no): (r.url, r.name_strength, r.stored_decision, r.org_match, r.org_mismatch) for r in batch.collect()}
    assert {k: (r.url, r.name_strength, r.stored_decision, r.org_match, r.org_mismatch) for k, r in got.items()} == want
    assert {r.ended_by for r in got.values()} == {"line", "next", "open"}
    # A micro-batch that was written but not committed is run again.
    for name in ("3", ".3.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    later = run([("late", 700, kinds[0], 1600 + 7200)])
    assert {k: r for k, r in later.items() if k[0] != "late" and r.ended_by != "idle"} == {k: r for k, r in got.items() if r.ended_by != "open"}
    assert {r.ended_by for k, r in later.items() if got.get(k) and got[k].ended_by == "open"} == {"idle"}
    assert later["late", 1].ended_by == "open"
