"""Model responses: parsing, normalising and validating, with a list of error codes instead of exceptions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse, strip


def parse(raw: Column) -> Column:
    """The response as a variant; null if it is not JSON."""
    return F.try_parse_json(raw)


def _kind(value: Column, path: str) -> Column:
    """Type of a field: STRING, BIGINT, ARRAY<...>, ...; VOID if missing or null."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))


def text_field(value: Column, name: str) -> Column:
    """A field if it is a string, else null."""
    return F.when(_kind(value, f"$.{name}") == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def last_day_of_month(created: Column) -> Column:
    """Stripped; YYYY-MM becomes the month's last day; other values stay."""
    clean = strip(created)
    month = F.try_to_date(F.concat(clean, F.lit("-01")), "yyyy-MM-dd")
    partial = clean.rlike("^[0-9]{4}-[0-9]{2}$") & ~clean.startswith("0000") & month.isNotNull()
    return F.when(partial, F.date_format(F.last_day(month), "yyyy-MM-dd")).otherwise(clean)


def fields(rows: DataFrame, raw_col: str = "raw", normalize: bool = False) -> DataFrame:
    """rows with response_, a struct of what the response holds: parsed once, so that checks only read columns.

    normalize: bring created into its form before anything judges it.
    """
    value = F.col("response_value_")
    tags = F.try_variant_get(value, "$.tags", "array<variant>")
    texts = F.transform(tags, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    found = F.struct(
        F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)).alias("is_object"),
        *(text_field(value, n).alias(n) for n in ("title", "document_type", "correspondent")),
        (last_day_of_month(text_field(value, "created")) if normalize else text_field(value, "created")).alias("created"),
        F.when(_kind(value, "$.tags").startswith("ARRAY"), texts).alias("tags"),
    )
    return rows.withColumn("response_value_", parse(F.col(raw_col))).withColumn("response_", found).drop("response_value_")


def with_errors(rows: DataFrame, key: list[str], document_types: DataFrame, correspondents: DataFrame, content_tags: DataFrame, max_tags: int, raw_col: str = "raw", normalize: bool = False) -> DataFrame:
    """rows with the struct response_ and errors; see judged. The responses are parsed for tags and for the rest: store
    what fields gives and take judged where that costs too much."""
    return judged(fields(rows, raw_col, normalize), key, document_types, correspondents, content_tags, max_tags)


def judged(parsed: DataFrame, key: list[str], document_types: DataFrame, correspondents: DataFrame, content_tags: DataFrame, max_tags: int) -> DataFrame:
    """parsed (with the struct response_ of fields) with errors: error codes in the order of the fields, empty if the response is valid.

    key names a row. The dimensions have a column name; names are checked by joins, tags one by one, so that the
    work grows with the rows and not with rows times names. Rows that repeat with their key are checked as one.
    """
    known = lambda df, name: df.filter(F.col("name").isNotNull()).select(F.col("name").alias(name)).distinct().withColumn(f"is_{name}", F.lit(True))
    r = F.col("response_")
    tags = parsed.filter(F.size(r["tags"]) > 0).select(*key, F.explode(r["tags"]).alias("tag_"))
    strange = tags.join(known(content_tags, "known_tag"), F.col("tag_") == F.col("known_tag"), "left").filter("is_known_tag IS NULL")
    strange = strange.select(*(F.col(k).alias(f"{k}_") for k in key)).distinct().withColumn("strange_tags", F.lit(True))
    joined = parsed.join(known(document_types, "known_type"), r["document_type"] == F.col("known_type"), "left")
    joined = joined.join(known(correspondents, "known_sender"), r["correspondent"] == F.col("known_sender"), "left")
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key]
    joined = joined.join(strange, functools.reduce(lambda a, b: a & b, on), "left")
    created, day = r["created"], F.try_to_date(r["created"], "yyyy-MM-dd")
    dated = created.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    allowed = lambda name, found: F.coalesce((r[name] == "") | F.col(found), F.lit(False))
    errors = F.array(
        F.when(F.coalesce(F.length(strip(r["title"])), F.lit(0)) == 0, "title_missing"),
        F.when(~allowed("document_type", "is_known_type"), "document_type_invalid"),
        F.when(~allowed("correspondent", "is_known_sender"), "correspondent_invalid"),
        F.when(r["tags"].isNull(), "tags_not_a_list"),
        F.when(F.size(r["tags"]) > max_tags, "tags_too_many"),
        F.when(F.col("strange_tags"), "tags_unknown"),
        F.when(created.isNull(), "created_not_a_string"),
        F.when((created != "") & ~dated, "created_format"),
        F.when(dated & (day.isNull() | created.startswith("0000")), "created_not_a_date"),
    )
    verdict = F.when(~r["is_object"], F.array(F.lit("not_an_object"))).otherwise(F.filter(errors, lambda e: e.isNotNull()))
    return joined.select(*parsed.columns, verdict.alias("errors"))


def correspondent_errors(raw: Column) -> Column:
    """The first error of a correspondent response, as a list of at most one code."""
    value = parse(raw)
    object_ = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(F.when(object_, raw))
    who = text_field(value, "correspondent")
    code = F.when(~object_, "not_an_object").when(F.coalesce(F.array_sort(keys) != F.array(F.lit("correspondent")), F.lit(True)), "fields").when(who.isNull(), "not_a_string").when(F.length(collapse(who)) > 255, "too_long")
    return F.filter(F.array(code), lambda e: e.isNotNull())
