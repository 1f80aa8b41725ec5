"""From typed upload rows to profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import first_filled, strip_controls, text, trim_all
from rollcall.functions.urls import linkedin_link, twitter_link
from rollcall.operators.columns import FieldMapping

# Kinds that fill one column; later columns of a kind overwrite earlier ones.
_SINGLE = {
    "identity_email": "email", "identity_linkedin": "linkedin_url", "identity_org": "organization", "identity_title": "title",
    "identity_phone": "phone", "link_twitter": "twitter_url", "link_website": "website_url", "link_resume": "resume_url",
    "linkedin_text": "vendor_text",
}


def _cell(mapping: FieldMapping) -> Column:
    value = strip_controls(trim_all(F.col(f"`{mapping.source_column}`").cast("string")))
    if mapping.field_type == "link_twitter":
        return twitter_link(value)
    return linkedin_link(value) if mapping.field_type == "identity_linkedin" else value


def _join_names(parts: list[Column]) -> Column:
    """Name columns merged in order: contained parts are dropped, the longer one kept."""
    def add(name: Column, part: Column) -> Column:
        a, b = F.lower(name), F.lower(part)
        held = F.contains(a, b) | F.contains(b, a)
        return (
            F.when(part == "", name).when(name == "", part)
            .when(held, F.when(F.length(part) > F.length(name), part).otherwise(name))
            .otherwise(F.concat(name, F.lit(" "), part))
        )

    return F.aggregate(F.array(*parts), F.lit(""), add) if parts else F.lit("")


def rows_to_profiles(upload: DataFrame, mappings: Sequence[FieldMapping], position: str = "source_row") -> DataFrame:
    """One profile per row. Content and metadata are arrays of (key, value) in column order."""
    of = lambda kind: [m for m in mappings if m.field_type == kind]

    def entries(kind: str) -> Column:
        cells = [F.struct(F.lit(m.target_name).alias("key"), _cell(m).alias("value")) for m in of(kind)]
        full = F.array(*cells) if cells else F.array().cast("array<struct<key:string,value:string>>")
        return F.filter(full, lambda e: e["value"] != "")

    singles = {target: first_filled(*[_cell(m) for m in reversed(of(kind))]) if of(kind) else F.lit("") for kind, target in _SINGLE.items()}
    links = [_cell(m) for m in of("link_other")]
    other = F.filter(F.array(*links), lambda u: u != "") if links else F.array().cast("array<string>")
    profiles = upload.select(
        F.col(position).alias("source_row"), _join_names([_cell(m) for m in of("identity_name")]).alias("name"),
        *[c.alias(t) for t, c in singles.items()], other.alias("other_links"),
        entries("content").alias("content_fields"), entries("metadata").alias("metadata"))
    return profiles.withColumns({
        "linkedin_url_source": F.when(F.col("linkedin_url") != "", "user").otherwise(""),
        "enrichment_status": F.when(F.col("vendor_text") != "", "enriched").otherwise("pending")})


def has_substance(content: Column | None = None) -> Column:
    """A row worth keeping: any identity, or any content that is not blank."""
    known = (text("name") != "") | (text("email") != "") | (text("linkedin_url") != "")
    if content is None:
        return known
    return known | F.exists(content, lambda e: trim_all(e["value"]) != "")


def drop_junk(profiles: DataFrame) -> DataFrame:
    return profiles.where(has_substance(F.col("content_fields")))


def junk_count(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count("*").alias("rows"), F.count_if(~has_substance(F.col("content_fields"))).alias("skipped_rows"))


def content_field_names(profiles: DataFrame) -> DataFrame:
    """Distinct searchable field names."""
    return profiles.select(F.explode("content_fields").alias("e")).groupBy(F.col("e.key").alias("field_name")).agg(
        F.count("*").alias("n_profiles"))
