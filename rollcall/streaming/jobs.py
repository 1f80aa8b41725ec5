"""Structured Streaming forms of ingest, log sessions, feedback and progress.

Every sink is idempotent: a micro-batch overwrites its own partition, so a restarted
query neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollcall.functions.emails import email_key
from rollcall.functions.fixed_values import MAX_EXEMPLARS, SEARCH_PRICE, VENDOR_PRICE
from rollcall.functions.urls import dedup_url_key
from rollcall.operators.attempts import telling, with_attempt_numbers
from rollcall.operators.columns import FieldMapping
from rollcall.operators.feedback import exemplar_offers
from rollcall.operators.intake import drop_junk, rows_to_profiles
from rollcall.operators.keyed import last_per_key


def read_files(spark: SparkSession, folder: str, schema, form: str = "parquet", pattern: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if form == "csv":
        reader = reader.options(header=True, escape='"')
    return reader.load(folder)


def write_batches(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each micro-batch into its own partition ``batch`` of a Parquet table, all that is there now."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def write_latest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """The whole aggregate after each micro-batch, written beside the last one and never over it."""
    return write_batches(stream, table, checkpoint, "complete")


def write_changed(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """The groups that each micro-batch has changed; :func:`current_rows` reads the newest of each."""
    return write_batches(stream, table, checkpoint, "update")


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def read_newest(spark: SparkSession, table: str) -> DataFrame:
    """Rows of the last micro-batch written by :func:`write_latest`."""
    rows = spark.read.parquet(table)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == newest).drop("batch")


# --- ingest -------------------------------------------------------------------------------------
def ingest(stream: DataFrame, mappings: Sequence[FieldMapping], position: str = "source_row") -> DataFrame:
    """Upload rows of a stream as profiles, junk rows dropped."""
    return drop_junk(rows_to_profiles(stream, mappings, position))


def current_rows(table: DataFrame, key: str) -> DataFrame:
    """Newest version per key of a table that :func:`write_batches` appends to."""
    return last_per_key(table, [key], ["batch"]).drop("batch")


def phase(stream: DataFrame, step: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """One resumable phase: a step over the stream into its own table, resumed by checkpoint."""
    return write_batches(step(stream), table, checkpoint)


def progress(stream: DataFrame, column: str = "enrichment_status") -> DataFrame:
    """Running count per status."""
    return stream.groupBy(column).agg(F.count("*").alias("n"))


def known_matches(stream: DataFrame, known: DataFrame, key: str, stamp: str | None = None, delay: str = "1 hour") -> DataFrame:
    """New rows that equal a known person on e-mail or URL, by a stream-static join.

    ``key`` is email or linkedin_url. With ``stamp`` repeated deliveries of a row within
    ``delay`` are dropped first.
    """
    form = {"email": email_key, "linkedin_url": dedup_url_key}[key]
    rows = stream
    if stamp:
        rows = rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(["id"])
    index = last_per_key(known.withColumn("_key", form(F.col(key))).where("_key <> ''"), ["_key"], ["dataset_id", "pos", "id"], ["id"])
    return rows.withColumn("_key", form(F.col(key))).join(index.withColumnRenamed("id", "existing_id"), "_key").select(
        F.col("id").alias("new_id"), "existing_id")


def write_known_matches(stream: DataFrame, known: Callable[[], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Matches of each micro-batch by e-mail and by URL: new_id, existing_id and match_type, into its own partition.

    ``known`` reads the known people and is called for every micro-batch, so people stored
    since the stream began are found. A new row that both keys lead to one person has both rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        people = known()
        found = [known_matches(batch, people, key).withColumn("match_type", F.lit(kind))
                 for key, kind in (("email", "email"), ("linkedin_url", "linkedin"))]
        found[0].unionByName(found[1]).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def chained(steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], source: DataFrame, folder: str) -> DataFrame:
    """Phases that hand rows on through their tables, each with its own progress; gives the last table's rows.

    A phase takes what the one before has written since it last ran. Run again after a crash,
    or after more input came, every phase goes on where it stopped: rows that are through are
    not worked on again, and none is lost.
    """
    spark = source.sparkSession
    for name, step in steps:
        table = f"{folder}/{name}"
        run_to_end(phase(source, step, table, f"{folder}/state-{name}"))
        rows = spark.read.parquet(table).drop("batch")
        # Partitions that another phase has yet to write are new files to the next.
        source = read_files(spark, f"{table}/batch=*", rows.schema)
    return rows


# --- windows --------------------------------------------------------------------------------------
def hourly_rates(log: DataFrame, stamp: str = "ts", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Searches, vendor calls, outcomes and cost per time window of a live log.

    Written in update mode (:func:`write_changed`), a micro-batch gives the windows it has
    changed, and a window leaves the state once the watermark is past it. Lines more than
    ``delay`` behind the newest are too late and not counted.
    """
    says = lambda needle: F.count_if(F.contains("line", F.lit(needle)))
    grouped = log.withWatermark(stamp, delay).groupBy(F.window(stamp, width).alias("w")).agg(
        F.count("*").alias("lines"), says("Search (").alias("searches"), says("Trying LinkedIn:").alias("vendor_calls"),
        says("Verify result: ACCEPTED").alias("accepted"), says("Verify result: REJECTED").alias("rejected"))
    cost = F.col("searches") * SEARCH_PRICE + F.col("vendor_calls") * VENDOR_PRICE
    return grouped.select(F.col("w.start").alias("window_start"), "lines", "searches", "vendor_calls", "accepted", "rejected",
                          F.round(cost, 6).alias("cost"))


def _in_order(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """What one micro-batch brings for a key, sorted; its size is bounded by ``per_trigger``."""
    parts = [b for b in batches if len(b)]
    if parts:
        yield pd.concat(parts).sort_values(column)


# --- sessions ---------------------------------------------------------------------------------------
_HELD = """profile_id STRING, attempt_no LONG, pos LONG, url STRING, strength STRUCT<pos: LONG, name: STRING>, org_match BOOLEAN,
 org_mismatch BOOLEAN, name_reject BOOLEAN, closing STRING, last_seen TIMESTAMP, newest LONG"""


def attempt_fragments(lines: DataFrame, stamp: str = "ts", chunk: int = 65536) -> DataFrame:
    """What a run of log lines says about each attempt, a row per profile and attempt, counted from the run's start.

    Attempt 0 is one that was open before the run: its lines up to the first closing one.
    ``opened`` is how many attempts the run opens for the profile. Everything is an aggregate
    over slices of positions, so a profile with a large share of the lines is no single task.
    """
    says = lambda needle: F.bool_or(F.contains("line", F.lit(needle)))
    numbered = with_attempt_numbers(lines.where(telling()), chunk)
    parts = numbered.groupBy("profile_id", "attempt_no", "closed_before").agg(
        F.min("pos").alias("pos"), F.max("url").alias("url"),
        F.max(F.when(F.col("strength").isNotNull(), F.struct("pos", F.col("strength").alias("name")))).alias("strength"),
        says("Verify org: MATCH").alias("org_match"), says("Verify org: MISMATCH").alias("org_mismatch"),
        (says("Verify name: MISMATCH") | says("WEAK-MATCH REJECTED")).alias("name_reject"),
        F.max("closing").alias("closing"), F.max(stamp).alias("last_seen"), F.max("attempt_no_total").alias("opened"))
    before = (F.col("attempt_no") == 0) & (F.col("closed_before") == 0)
    return parts.where(F.col("url").isNotNull() | before).drop("closed_before")


def merged_fragments(parts: DataFrame) -> DataFrame:
    """Fragments of one attempt as one; any grouping of them gives the same."""
    return parts.groupBy("profile_id", "attempt_no").agg(
        F.min("pos").alias("pos"), *[F.max(c).alias(c) for c in ("url", "strength")],
        *[F.bool_or(c).alias(c) for c in ("org_match", "org_mismatch", "name_reject")],
        *[F.max(c).alias(c) for c in ("closing", "last_seen", "newest")])


def write_attempts(log: DataFrame, table: str, checkpoint: str, stamp: str = "ts", chunk: int = 65536) -> StreamingQuery:
    """The attempts that each micro-batch opens, goes on with or replaces; :func:`current_attempts` reads them.

    A micro-batch is reduced to fragments, which meet the newest attempt of their profile, one
    row per profile kept beside the checkpoint. A batch reads the rows that the one before
    left and writes its own, so a batch that is run again gives the same; older ones are not
    read any more. Later micro-batches bring later lines; inside one the order is ``pos``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, f"{checkpoint}-held/batch="
        held = spark.read.schema(_HELD).parquet(f"{place}{batch_id - 1}") if batch_id else spark.createDataFrame([], _HELD)
        found = attempt_fragments(batch, stamp, chunk).persist()
        base = held.select("profile_id", F.col("attempt_no").alias("base"))
        number = F.coalesce("base", F.lit(0))
        brought = found.join(base, "profile_id", "left").withColumns({
            "attempt_no": F.col("attempt_no") + number, "newest": number + F.col("opened")}).drop("base", "opened")
        more = found.groupBy("profile_id").agg(F.max("opened").alias("opened"))
        going_on = held.where(F.col("closing").isNull()).join(more, "profile_id").withColumn(
            "newest", F.col("attempt_no") + F.col("opened")).drop("opened")
        # Lines of attempt 0 without an open attempt before them belong to none.
        changed = merged_fragments(brought.unionByName(going_on)).where(F.col("url").isNotNull())
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        changed = spark.read.schema(_HELD).parquet(f"{table}/batch={batch_id}")
        both = held.withColumn("turn", F.lit(0)).unionByName(changed.withColumn("turn", F.lit(1)))
        last_per_key(both, ["profile_id"], ["attempt_no", "turn"]).drop("turn").write.mode("overwrite").parquet(f"{place}{batch_id}")
        found.unpersist()

    return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current_attempts(table: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Every attempt of the log so far, open ones included, from what :func:`write_attempts` wrote.

    ``ended_by`` is line, next, idle (no telling line for so long before the newest one of
    all) or open. The decision of an open attempt is the one it would have if nothing more came.
    """
    rows = last_per_key(table, ["profile_id", "attempt_no"], ["batch"])
    clock = table.agg(F.max("last_seen")).first()[0]
    open_, newest = F.col("closing").isNull(), F.col("attempt_no") == F.col("newest")
    silent = F.col("last_seen") <= F.lit(clock).cast("timestamp") - F.expr(f"INTERVAL {idle}")
    decision = F.coalesce("closing", F.when(F.col("name_reject"), "rejected").when(newest, "no_data").otherwise("unknown"))
    return rows.select(
        "profile_id", "attempt_no", "url", F.coalesce("strength.name", F.lit("none")).alias("name_strength"), "org_match", "org_mismatch",
        decision.alias("stored_decision"),
        F.when(~open_, "line").when(~newest, "next").when(silent, "idle").otherwise("open").alias("ended_by"))


# --- feedback -----------------------------------------------------------------------------------------
EXEMPLAR_SCHEMA = "search_id STRING, profile_id STRING, score INT, reason STRING, place INT, version LONG"


def live_exemplars(feedback: DataFrame) -> DataFrame:
    """Exemplar list of every search after each micro-batch, newest version per search.

    The state is the list itself (about ten entries). Offers are applied in event order: a
    profile's newer offer replaces its older one; a rejection makes room by dropping the
    oldest rejection; an endorsement is added only while there is room.
    """
    offers = exemplar_offers(feedback).select("search_id", "event_id", "profile_id", "score", "reason")

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, scores, reasons = state.get if state.exists else (0, [], [], [])
        held = list(zip(ids, scores, reasons))
        for batch in _in_order(batches, "event_id"):
            for offer in batch.itertuples(index=False):
                held = [h for h in held if h[0] != offer.profile_id]
                full = len(held) >= MAX_EXEMPLARS
                if offer.score > 20:
                    if not full:
                        held.append((offer.profile_id, int(offer.score), offer.reason))
                    continue
                if full:
                    low = next((h for h in held if h[1] <= 20), None)
                    if low is not None:
                        held.remove(low)
                held.append((offer.profile_id, int(offer.score), offer.reason))
        version += 1
        state.update((version, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held]))
        yield pd.DataFrame(
            [(key[0], h[0], h[1], h[2], i, version) for i, h in enumerate(held)],
            columns=["search_id", "profile_id", "score", "reason", "place", "version"])

    return offers.groupBy("search_id").applyInPandasWithState(
        step, EXEMPLAR_SCHEMA, "version LONG, ids ARRAY<STRING>, scores ARRAY<INT>, reasons ARRAY<STRING>", "append",
        GroupStateTimeout.NoTimeout)


def newest_exemplars(rows: DataFrame) -> DataFrame:
    """Current list per search from the versions :func:`live_exemplars` has written."""
    newest = rows.groupBy("search_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["search_id", "version"], "left_semi").select("search_id", "profile_id", "score", "reason", "place")
