"""Write-back and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import text
from rollcall.operators.keyed import BATCH_DIGITS, number_batches

LONGEST_CELL = 100_000


def outbox(profiles: DataFrame, run_time: Column, prefix: str = "RC_", batch_size: int = 10, hex_digits: int = BATCH_DIGITS) -> DataFrame:
    """Rows to send back to a record source in small batches: five prefixed columns.

    ``profiles`` has record_id, linkedin_url, vendor_text, profile_card,
    enrichment_status. Rows without a record id are not sent.
    """
    sent = profiles.where(text("record_id") != "")
    value = lambda c: F.nullif(F.left(text(c), F.lit(LONGEST_CELL)), F.lit(""))
    rows = sent.select(
        "record_id", F.nullif(text("linkedin_url"), F.lit("")).alias(f"{prefix}LinkedIn_URL"),
        value("vendor_text").alias(f"{prefix}LinkedIn_Enriched"), value("profile_card").alias(f"{prefix}Profile_Card"),
        F.col("enrichment_status").alias(f"{prefix}Enrichment_Status"), run_time.alias(f"{prefix}Last_Enriched"))
    return number_batches(rows, "record_id", batch_size, hex_digits)


def outbox_counts(profiles: DataFrame) -> DataFrame:
    has = text("record_id") != ""
    return profiles.agg(F.count_if(has).alias("to_send"), F.count_if(~has).alias("skipped"))


def label_sheet(sample: DataFrame) -> DataFrame:
    """Sample rows with blank columns for a person to fill in."""
    blanks = ["true_linkedin_url", "true_website_url", "true_twitter_url", "true_is_hidden", "notes"]
    return sample.select(
        F.col("id").alias("profile_id"), F.col("name").alias("uploaded_name"), "email", "organization", "title",
        F.col("linkedin_url").alias("current_linkedin_url"), F.col("enrichment_status").alias("current_enrichment_status"),
        *[F.lit("").alias(b) for b in blanks])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(report: DataFrame, path: str, form: str = "json") -> None:
    """Reports as JSON or Parquet tables."""
    report.write.mode("overwrite").format(form).save(path)
