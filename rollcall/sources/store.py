"""Datasets, profiles and searches as tables: save, load, upsert, delete, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.text import first_filled, text
from rollcall.operators.dedup import with_person_id
from rollcall.operators.keyed import last_per_key

def _profile_schema() -> T.StructType:
    words, entries = T.StringType(), T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
    nested = {
        "source_row": T.LongType(), "other_links": T.ArrayType(words), "content_fields": entries, "metadata": entries,
        "fetched_content": T.MapType(words, words), "field_summaries": T.MapType(words, words),
        "enrichment_log": T.ArrayType(words), "verification_decisions": T.ArrayType(words), "created_at": T.TimestampType()}
    names = [
        "id", "dataset_id", "account_id", "source_row", "name", "email", "linkedin_url", "linkedin_url_source", "organization",
        "title", "phone", "twitter_url", "website_url", "resume_url", "other_links", "enriched_organization", "enriched_title",
        "content_fields", "metadata", "fetched_content", "linkedin_enriched", "field_summaries", "profile_card", "photo_path",
        "enrichment_status", "enrichment_version", "enrichment_log", "verification_decisions", "person_id", "source_dataset",
        "created_at"]
    return T.StructType([T.StructField(n, nested.get(n, words)) for n in names])


PROFILE_SCHEMA = _profile_schema()
# Columns an upsert leaves as stored when the new row brings nothing for them.
OPTIONAL = ["enrichment_version", "enriched_organization", "enriched_title", "person_id", "linkedin_url_source", "photo_path"]
OWNERSHIP = ["dataset_id", "account_id"]


def conform(df: DataFrame, schema: T.StructType = PROFILE_SCHEMA) -> DataFrame:
    """Rows of any generation in the current shape.

    Unknown columns go, absent ones get defaults, JSON text is parsed where a nested column
    is expected, and a status outside the known four becomes pending.
    """
    def cell(field: T.StructField):
        if field.name not in df.columns:
            return (F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(None)).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return text(value.cast("string")).alias(field.name)
        if isinstance(df.schema[field.name].dataType, T.StringType) and not isinstance(field.dataType, T.AtomicType):
            return F.from_json(value, field.dataType).alias(field.name)
        return value.cast(field.dataType).alias(field.name)

    shaped = df.select(*[cell(f) for f in schema.fields])
    if "enrichment_status" not in schema.names:
        return shaped
    status = F.col("enrichment_status")
    return shaped.withColumn("enrichment_status", F.when(status.isin("pending", "enriched", "failed", "skipped"), status).otherwise("pending"))


def save_profiles(df: DataFrame, path: str, mode: str = "append") -> None:
    """Profiles as Parquet, laid out by owner and dataset so that scans prune to them."""
    conform(with_person_id(df)).write.mode(mode).partitionBy("account_id", "dataset_id").parquet(path)


def load_profiles(spark: SparkSession, path: str, account_id: str, dataset_id: str | None = None) -> DataFrame:
    """Profiles of one account; rows of other owners are never read."""
    raw = spark.read.option("mergeSchema", "true").parquet(path).where(F.col("account_id") == account_id)
    return conform(raw if dataset_id is None else raw.where(F.col("dataset_id") == dataset_id))


def _read_all(spark: SparkSession, folder: str) -> DataFrame:
    shape = T.StructType([*PROFILE_SCHEMA.fields, T.StructField("_rejected", T.StringType())])
    return spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").json(folder)


def load_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every dataset of a folder of JSON files; records that cannot be read are in :func:`load_rejects`."""
    return conform(_read_all(spark, folder).where(F.col("_rejected").isNull()).drop("_rejected"))


def load_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the folder that cannot be read as profiles: raw text, file, and the id as far as it was read."""
    rows = _read_all(spark, folder).select("id", "_rejected", F.col("_metadata.file_path").alias("file"))
    return rows.where(F.col("_rejected").isNotNull()).select("id", "file", F.col("_rejected").alias("record"))


def in_account(df: DataFrame, account_id: str) -> DataFrame:
    return df.where(F.col("account_id") == account_id)


def union_datasets(*parts: DataFrame) -> DataFrame:
    """Datasets of different generations as one."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def upsert(stored: DataFrame, changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Stored rows overlaid with the newest change per key; new keys are added.

    Empty optional columns of a change keep what was stored.
    """
    columns = stored.columns
    kept = [c for c in columns if c != key]
    newest = last_per_key(changes, [key], [version], [c for c in kept if c in changes.columns])
    marked = newest.select(key, F.struct(*[c for c in newest.columns if c != key]).alias("_new"))
    joined = stored.select(key, F.struct(*kept).alias("_old")).join(marked, key, "full_outer")
    fresh = F.col("_new").isNotNull()

    def cell(name: str):
        if name not in newest.columns:
            return F.col(f"_old.{name}").alias(name)
        new = F.col(f"_new.{name}")
        if name in OPTIONAL:
            return F.when(fresh, first_filled(new, F.col(f"_old.{name}"))).otherwise(F.col(f"_old.{name}")).alias(name)
        return F.when(fresh, new).otherwise(F.col(f"_old.{name}")).alias(name)

    return joined.select(key, *[cell(c) for c in kept])


def update(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Keyed update from a change table; ownership columns and unknown keys stay untouched."""
    touched = [c for c in changes.columns if c in stored.columns and c not in (key, *OWNERSHIP)]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in touched], F.lit(True).alias("_hit"))
    joined = stored.join(renamed, key, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in touched else F.col(c) for c in stored.columns])


def edit_metadata(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keyed edits in which a null means unchanged."""
    touched = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in touched])
    return stored.join(renamed, key, "left").select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in touched else F.col(c) for c in stored.columns])


def append_chunk(stored: DataFrame, chunk: DataFrame) -> DataFrame:
    """Adds rows to a dataset; their source_row continues after the stored ones."""
    last = stored.groupBy("dataset_id").agg((F.max("source_row") + 1).alias("_from"))
    moved = chunk.join(last, "dataset_id", "left").withColumn(
        "source_row", F.col("source_row") + F.coalesce("_from", F.lit(0))).drop("_from")
    return stored.unionByName(moved, allowMissingColumns=True)


def delete_datasets(datasets: DataFrame, profiles: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the listed datasets."""
    gone = ids.select("dataset_id").distinct()
    return datasets.join(gone, "dataset_id", "left_anti"), profiles.join(gone, "dataset_id", "left_anti")


def catalogue(datasets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Datasets with their profile counts, newest first."""
    counts = profiles.groupBy("dataset_id").agg(F.count("*").alias("profile_count"))
    return datasets.join(counts, "dataset_id", "left").withColumn(
        "profile_count", F.coalesce("profile_count", F.lit(0))).orderBy(F.desc("created_at"), "dataset_id")


def look_up(profiles: DataFrame, ids: DataFrame, account_id: str) -> DataFrame:
    return in_account(profiles, account_id).join(ids.select("id").distinct(), "id", "left_semi")


def with_related_counts(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Left rows with how many right rows they own, zero where none."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def replace_all(stored: DataFrame, fresh: DataFrame, owner: str = "account_id") -> DataFrame:
    """Every owner present in ``fresh`` has its rows replaced as a whole."""
    return stored.join(fresh.select(owner).distinct(), owner, "left_anti").unionByName(fresh, allowMissingColumns=True)


def edit_set(members: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Set of (key columns) after adding and then removing members."""
    keys = members.columns
    return members.unionByName(add.select(*keys)).distinct().join(remove.select(*keys).distinct(), keys, "left_anti")


def import_searches(definitions: DataFrame, batch: str) -> DataFrame:
    """Stored search definitions under new ids. ``definitions``: body (JSON), origin."""
    schema = "name STRING, query STRING, clarification_context STRING, search_rules ARRAY<STRING>"
    parsed = definitions.select("origin", F.from_json("body", schema).alias("d"))
    new_id = F.left(F.md5(F.concat_ws("|", F.lit(batch), F.col("origin"), text(F.col("d.name")), text(F.col("d.query")))), F.lit(8))
    return parsed.select(new_id.alias("search_id"), "d.*")


def search_rows(searches: DataFrame, scores: DataFrame | None = None, feedback: DataFrame | None = None) -> DataFrame:
    """Searches with or without their score counts and feedback counts."""
    out = searches
    if scores is not None:
        out = with_related_counts(out, scores, "search_id", "n_scores")
    if feedback is not None:
        times = feedback.groupBy("search_id").agg(F.count("*").alias("n_feedback"), F.max("created_at").alias("last_feedback"))
        out = out.join(times, "search_id", "left").withColumn("n_feedback", F.coalesce("n_feedback", F.lit(0)))
    return out


