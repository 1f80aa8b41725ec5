"""Queries that run a stream over the given files to its end and read what it wrote."""

import uuid

from pyspark.sql import functions as F

from rollcall.functions.emails import email_key
from rollcall.operators.columns import FieldMapping
from rollcall.plans.deduplication import _BOTH
from rollcall.plans.registry import query
from rollcall.plans.reporting import _MARKED
from rollcall.plans.views import VIEWS
from rollcall.session import checkpoint_dir
from rollcall.streaming import jobs


def _stream(src, table, per_trigger=1000):
    """A given table as a stream of files."""
    schema = src.table(table).schema
    return jobs.read_files(src.spark, src.folder, schema, pattern=f"{table}.parquet", per_trigger=per_trigger)


def _log(src):
    """The log view over the event stream; its text has no join or window and so runs on a stream."""
    _stream(src, "events").createOrReplaceTempView("live_events")
    return src.spark.sql(VIEWS["log_lines"].replace("FROM events", "FROM live_events").replace("AS line", "AS line, cast(ts AS timestamp) AS ts"))


def _places(src):
    base = f"{checkpoint_dir(src.spark)}/rollcall-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/state"


@query("stream_hourly_rates", """
SELECT cast(date_trunc('hour', ts) AS timestamp) AS window_start, count(*) AS lines, count(*) FILTER (contains(line, 'Search (')) AS searches, count(*) FILTER (contains(line, 'Trying LinkedIn:')) AS vendor_calls, count(*) FILTER (contains(line, 'Verify result: ACCEPTED')) AS accepted,
 count(*) FILTER (contains(line, 'Verify result: REJECTED')) AS rejected, round(count(*) FILTER (contains(line, 'Search (')) * 0.006::double + count(*) FILTER (contains(line, 'Trying LinkedIn:')) * 0.0168::double, 6) AS cost FROM log_lines JOIN events ON event_id = pos GROUP BY 1""")
def stream_hourly_rates(src):
    table, state = _places(src)
    jobs.run_to_end(jobs.write_changed(jobs.hourly_rates(_log(src)), table, state))
    return jobs.current_rows(src.spark.read.parquet(table), "window_start").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_progress", "SELECT o_orderstatus AS enrichment_status, count(*) AS n FROM orders GROUP BY 1")
def stream_progress(src):
    table, state = _places(src)
    orders = _stream(src, "orders").withColumnRenamed("o_orderstatus", "enrichment_status")
    jobs.run_to_end(jobs.write_latest(jobs.progress(orders), table, state))
    return jobs.read_newest(src.spark, table)


@query("stream_attempts", f"""WITH {_MARKED}
, seen AS (SELECT fl.profile_id, attempt_no, max(ts) AS seen FROM fl JOIN events ON event_id = pos WHERE cb = oc AND (contains(line, 'Trying LinkedIn:') OR contains(line, 'Verify ') OR contains(line, 'API returned no data')) GROUP BY 1, 2)
SELECT profile_id, cast(attempt_no AS bigint) AS attempt_no, url, name_strength, org_match, org_mismatch, stored_decision,
 CASE WHEN closing IS NOT NULL THEN 'line' WHEN attempt_no < newest THEN 'next' WHEN seen <= (SELECT max(seen) FROM seen) - INTERVAL 30 MINUTE THEN 'idle' ELSE 'open' END AS ended_by FROM attempts JOIN seen USING (profile_id, attempt_no)""")
def stream_attempts(src):
    table, state = _places(src)
    jobs.run_to_end(jobs.write_attempts(_log(src), table, state))
    return jobs.current_attempts(src.spark.read.parquet(table))


def _live_people(src):
    """The people view over the customers as a stream, joined with the other tables as they are."""
    _stream(src, "customer").createOrReplaceTempView("live_customer")
    for name in ("nation", "part"):
        src.table(name).createOrReplaceTempView(f"fixed_{name}")
    view = VIEWS["people"].replace("FROM customer", "FROM live_customer").replace("JOIN nation", "JOIN fixed_nation").replace("JOIN part", "JOIN fixed_part")
    return src.spark.sql(view)


_KNOWN = _BOTH + """
SELECT n.id AS new_id, ei.id AS existing_id, 'email' AS match_type FROM n JOIN ei ON n.ek = ei.ek UNION ALL SELECT n.id, ui.id, 'linkedin' FROM n JOIN ui ON n.uk = ui.uk"""


@query("stream_known_matches", _KNOWN)
def stream_known_matches(src):
    table, state = _places(src)
    jobs.run_to_end(jobs.write_known_matches(_live_people(src), lambda: src("known_people"), table, state))
    return src.spark.read.parquet(table).drop("batch")


@query("stream_phases", """
SELECT source_row, trim(lower(email)) AS email_key, CASE WHEN email = '' THEN 'failed' ELSE 'enriched' END AS enrichment_status FROM people WHERE enrichment_status = 'pending'""")
def stream_phases(src):
    folder, _ = _places(src)
    steps = [
        ("landed", lambda rows: rows.where("enrichment_status = 'pending'")),
        ("keyed", lambda rows: rows.withColumn("email_key", email_key(F.col("email")))),
        ("settled", lambda rows: rows.withColumn("enrichment_status", F.when(F.col("email_key") == "", "failed").otherwise("enriched")))]
    return jobs.chained(steps, _live_people(src), folder).select("source_row", "email_key", "enrichment_status")


@query("stream_ingest", """
SELECT c_custkey AS source_row, c_name AS name, c_mktsegment AS organization, 'pending' AS enrichment_status FROM customer""")
def stream_ingest(src):
    table, state = _places(src)
    mappings = [FieldMapping("c_name", "identity_name", "name", (), 0.9), FieldMapping("c_mktsegment", "identity_org", "org", (), 0.9)]
    rows = jobs.ingest(_stream(src, "customer"), mappings, "c_custkey")
    jobs.run_to_end(jobs.write_batches(rows, table, state))
    return jobs.current_rows(src.spark.read.parquet(table), "source_row").select("source_row", "name", "organization", "enrichment_status")


# The list as it changes from offer to offer: a fold over a search's offers in event order.
_HELD = "list_filter(held, lambda x: x.p <> offer[1].p)"
_LOW = f"coalesce(list_position(list_transform({_HELD}, lambda x: x.s <= 20), true), 0)"


@query("stream_exemplars", f"""
WITH o AS (SELECT search_id, event_id, [{{'p': profile_id, 's': CASE rating WHEN 'strong_yes' THEN 95 ELSE 5 END, 'r': CASE WHEN trim(reason) <> '' THEN trim(reason) WHEN rating = 'strong_yes' THEN 'Marked as excellent' ELSE 'Rejected without reason' END}}] AS offer
  FROM feedback WHERE rating IN ('strong_yes', 'no', 'strong_no')),
f AS (SELECT search_id, list_reduce(list_prepend(list_filter(any_value(offer), lambda x: false), list(offer ORDER BY event_id)), lambda held, offer:
  CASE WHEN len({_HELD}) < 10 THEN list_concat({_HELD}, offer) WHEN offer[1].s > 20 THEN {_HELD}
   WHEN {_LOW} > 0 THEN list_concat(list_concat(({_HELD})[:{_LOW} - 1], ({_HELD})[{_LOW} + 1:]), offer) ELSE list_concat({_HELD}, offer) END) AS held FROM o GROUP BY search_id)
SELECT search_id, held[i].p AS profile_id, held[i].s AS score, held[i].r AS reason, cast(i - 1 AS integer) AS place FROM f, range(1, 40) n(i) WHERE i <= len(held)""")
def stream_exemplars(src):
    table, state = _places(src)
    _stream(src, "events").createOrReplaceTempView("live_events")
    rows = src.spark.sql(VIEWS["feedback"].replace("FROM events", "FROM live_events"))
    jobs.run_to_end(jobs.write_batches(jobs.live_exemplars(rows), table, state))
    return jobs.newest_exemplars(src.spark.read.parquet(table))
