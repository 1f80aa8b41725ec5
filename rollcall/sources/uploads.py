"""Readers of uploads and landed responses. Every value is a string on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.fixed_values import FIELD_PRIORITY
from rollcall.functions.text import first_filled, text, trim_all
from rollcall.functions.urls import truth_url_key
from rollcall.operators.keyed import first_per_key

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "inferSchema": False, "encoding": "UTF-8"}


def _strings(df: DataFrame) -> DataFrame:
    """Every column as text: nested values as JSON, missing values as the empty string."""
    def cell(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        value = F.to_json(F.col(f"`{field.name}`")) if nested else F.col(f"`{field.name}`").cast("string")
        return text(value).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """CSV upload with a header row.

    Cells with line breaks need ``multi_line``, which reads a file in one task; for very
    large single files without such cells switch it off and Spark splits them.
    """
    return _strings(spark.read.options(**{**CSV_OPTIONS, "multiLine": multi_line}).csv(path))


def read_json(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """JSON upload: a list of objects, or one object taken as a list of one."""
    return _strings(spark.read.options(multiLine=multi_line, primitivesAsString=True).json(path))


def parse_csv_lines(lines: DataFrame, columns: list[str], column: str = "value") -> DataFrame:
    """CSV rows held as text, one record per row of ``lines``, without the header."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    parsed = lines.select(F.from_csv(F.col(column), schema, {"quote": '"', "escape": '"'}).alias("r"))
    return _strings(parsed.select("r.*"))


def with_positions(df: DataFrame, name: str = "source_row") -> DataFrame:
    """Adds an increasing row number that follows file order; numbers may have gaps."""
    return df.withColumn(name, F.monotonically_increasing_id())


def explode_records(pages: DataFrame) -> DataFrame:
    """Rows of a paged record source: page_no, record_no, record_id and the fields as entries.

    ``pages``: page_no, body (JSON with ``records``). List values are joined with a comma
    and null becomes empty; the order of fields in a record is kept.
    """
    schema = "records ARRAY<STRUCT<id: STRING, fields: MAP<STRING, STRING>>>"
    records = pages.select("page_no", F.posexplode(F.from_json("body", schema)["records"]).alias("record_no", "r"))

    def shown(value: Column) -> Column:
        items = F.from_json(value, "ARRAY<STRING>")
        return F.when(F.startswith(text(value), F.lit("[")), F.array_join(items, ", ")).otherwise(text(value))

    fields = F.transform(F.map_entries("r.fields"), lambda e: F.struct(e["key"].alias("key"), shown(e["value"]).alias("value")))
    return records.select("page_no", "record_no", F.col("r.id").alias("record_id"), fields.alias("fields"))


def record_columns(records: DataFrame) -> DataFrame:
    """Union of the field names, in the order they were first seen."""
    cells = records.select("page_no", "record_no", F.posexplode("fields").alias("field_no", "f"))
    return cells.groupBy(F.col("f.key").alias("column")).agg(
        F.min(F.struct("page_no", "record_no", "field_no")).alias("seen"), F.count("*").alias("filled")).select(
        "column", "filled", F.col("seen.page_no").alias("first_page"), F.col("seen.record_no").alias("first_record"))


def pivot_records(records: DataFrame, columns: list[str]) -> DataFrame:
    """Flat rows with the chosen fields as columns and the record id kept for write-back."""
    as_map = F.map_from_entries("fields")
    return records.select(
        F.col("record_id").alias("_record_id"), *[text(F.try_element_at(as_map, F.lit(c))).alias(c) for c in columns])


def preview(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first few rows by ``order``, for the user to look at."""
    return df.orderBy(*order).limit(rows)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Hand-labelled CSV: blank ids dropped, URLs in comparable form, the hidden flag typed."""
    raw = read_csv(spark, path)
    urls = ["true_linkedin_url", "true_website_url", "true_twitter_url"]
    return raw.where(trim_all(F.col("profile_id")) != "").select(
        trim_all(F.col("profile_id")).alias("profile_id"), "uploaded_name", "email",
        *[truth_url_key(F.col(u)).alias(u) for u in urls],
        F.lower(trim_all(F.col("true_is_hidden"))).isin("true", "1", "yes").alias("true_is_hidden"), "notes")


def pick_source_columns(columns: list[str]) -> dict[str, str | None]:
    """Which header holds what, by substring, the first header winning.

    A header list is tiny; only names are looked at here.
    """
    # Header fragments per target, in order of preference.
    wanted = {
        "email": ("email", "e-mail", "emailaddress"), "name": ("full name", "name", "fullname"),
        "first": ("first name", "firstname"), "last": ("last name", "lastname", "surname"),
        "organization": ("organization", "company", "employer"), "title": ("title", "position", "role"),
    }
    lowered = {c: c.strip().lower() for c in columns}
    return {
        target: next((c for part in parts for c in columns if part in lowered[c]), None) for target, parts in wanted.items()
    }


def source_rows(upload: DataFrame) -> DataFrame:
    """Identity columns of an original upload, found by header: pos, email, name, organization, title."""
    picked = pick_source_columns(upload.columns)
    cell = lambda key: trim_all(F.col(f"`{picked[key]}`")) if picked[key] else F.lit("")
    joined = F.trim(F.concat_ws(" ", cell("first"), cell("last")))
    exact = picked["name"] not in (picked["first"], picked["last"])
    numbered = upload if "pos" in upload.columns else with_positions(upload, "pos")
    return numbered.select(
        "pos", cell("email").alias("email"), first_filled(cell("name") if exact else F.lit(""), joined).alias("name"),
        cell("organization").alias("organization"), cell("title").alias("title"))


def index_source_rows(rows: DataFrame, key: Column) -> DataFrame:
    """First source row of every non-empty key."""
    keyed = rows.withColumn("source_key", key).where("source_key <> ''")
    return first_per_key(keyed, ["source_key"], ["pos"], ["organization", "title"])


def corpus_text(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Legacy corpus: labelled text of the content fields, the telling ones first."""
    used = [f for f in (fields or FIELD_PRIORITY) if f in df.columns]
    parts = [F.when(trim_all(F.col(f)) != "", F.concat(F.lit(f"{f}:\n"), trim_all(F.col(f)))) for f in used]
    return df.withColumn("raw_text", F.concat_ws("\n\n", *parts))


def coalesce_columns(df: DataFrame, plan: dict[str, list[str]]) -> DataFrame:
    """First non-empty of several source columns per target; lists joined with ``; ``."""
    def value(name: str) -> Column:
        is_list = isinstance(df.schema[name].dataType, T.ArrayType)
        return F.array_join(F.filter(F.col(name), lambda v: text(v) != ""), "; ") if is_list else text(F.col(name))

    return df.select(*[
        first_filled(*[value(c) for c in names if c in df.columns]).alias(target) for target, names in plan.items()])
