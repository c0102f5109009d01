"""Names and ids: the dimensions of a taxonomy, lookups both ways, routing of free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text


def names(dimension: DataFrame, name_col: str) -> DataFrame:
    """One row with the sorted distinct names; for dimensions, which are small."""
    return dimension.filter(F.col(name_col).isNotNull()).agg(F.array_sort(F.collect_set(name_col)).alias("names"))


def content_tags(tags: DataFrame, technical: list[str], name_col: str = "name") -> DataFrame:
    """Tags that do not steer the workflow (exact names)."""
    return tags.filter(~F.col(name_col).isin(technical))


def resolve_ids(rows: DataFrame, dimension: DataFrame, name_col: str, out: str = "resolved_id") -> DataFrame:
    """rows with the id of the name, null for an empty name, and error where the name is gone.

    dimension: id and name; of equal names the smallest id counts.
    """
    first = dimension.groupBy(F.col("name").alias("name_")).agg(F.min("id").alias("id_"))
    joined = rows.join(first, rows[name_col] == F.col("name_"), "left")
    error = F.when(F.coalesce(F.col(name_col), F.lit("")) == "", None).when(F.col("id_").isNull(), "name_gone")
    return joined.select(*rows.columns, F.when(F.coalesce(F.col(name_col), F.lit("")) != "", F.col("id_")).alias(out), error.alias("error"))


def names_in_order(lists: DataFrame, dimension: DataFrame, key: list[str], ids_col: str = "ids", refreshed: DataFrame | None = None) -> DataFrame:
    """key and names of each id list, in its order and with its repetitions; unknown ids are left out.

    refreshed: the dimension as it is now. A list with an id that dimension lacks is looked up there as a whole, once;
    only these lists meet it. Null ids are no ids.
    """
    pairs = lambda df: df.groupBy("id").agg(F.max("name").alias("name"))

    def named(rows: DataFrame, names: DataFrame) -> DataFrame:
        items = rows.select(*key, F.posexplode(ids_col).alias("at_", "id")).filter("id IS NOT NULL").join(pairs(names), "id", "left")
        found = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at_", "name"))))
        return items.groupBy(*key).agg(F.transform(found, lambda s: s["name"]).alias("names"), F.max(F.col("name").isNull()).alias("missed_"))

    first = named(lists, dimension)
    none = F.array().cast("array<string>")
    if refreshed is None:
        return lists.select(*key).join(first, key, "left").select(*key, F.coalesce("names", none).alias("names"))
    again = named(lists.join(first.filter("missed_").select(*key), key, "left_semi"), refreshed)
    both = lists.select(*key).join(first, key, "left").join(again.select(*key, F.col("names").alias("now_")), key, "left")
    return both.select(*key, F.coalesce(F.when(F.col("missed_"), F.col("now_")).otherwise(F.col("names")), none).alias("names"))


def route_candidates(rows: DataFrame, correspondents: DataFrame, candidate_col: str = "candidate") -> DataFrame:
    """rows with candidate_kind, matched_existing and pending.

    A candidate equal to a correspondent up to case and white space is applied under the correspondent's
    spelling (of several the last one); only a new name stays pending.
    """
    known = correspondents.filter(text.collapse(F.col("name")) != "").groupBy(text.name_key(F.col("name")).alias("key_")).agg(F.max("name").alias("canonical_"))
    clean = text.collapse(F.col(candidate_col))
    joined = rows.withColumn("clean_", clean).withColumn("key_", text.name_key(F.col(candidate_col))).join(known, "key_", "left")
    kind = F.when(F.col("clean_") == "", "none").when(F.col("canonical_").isNotNull(), "existing").otherwise("new")
    return joined.select(*rows.columns, kind.alias("candidate_kind"), F.when(F.col("clean_") != "", F.col("canonical_")).alias("matched_existing"), F.when(kind == "new", F.col("clean_")).otherwise("").alias("pending"))


def candidate_types(rows: DataFrame, correspondents: DataFrame, candidate_col: str = "candidate") -> DataFrame:
    """rows with candidate_type: empty, existing or new, by the exact name."""
    known = correspondents.select(F.col("name").alias("known_")).distinct()
    kind = F.when(F.coalesce(F.col(candidate_col), F.lit("")) == "", "empty").when(F.col("known_").isNotNull(), "existing").otherwise("new")
    return rows.join(known, rows[candidate_col] == F.col("known_"), "left").select(*rows.columns, kind.alias("candidate_type"))


def first_spellings(rows: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """Of names equal up to case the first spelling, in the order of order_col."""
    return rows.groupBy(text.fold_case(F.col(name_col)).alias("key_")).agg(F.min(F.struct(order_col, name_col)).alias("f_")).select(f"f_.{order_col}", f"f_.{name_col}")


def missing_names(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required names that are absent: neither present themselves nor before a colon of a present name.

    Each present name gives way to all its beginnings before a colon, so one anti-join settles it.
    """
    r = required.select(F.col("name").alias("required_name"))
    parts = F.split("name", ":")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":"))
    p = present.filter(F.col("name").isNotNull()).select(F.explode(beginnings).alias("present_name")).distinct()
    return r.join(p, F.col("required_name") == F.col("present_name"), "left_anti").distinct()


def equal_spellings(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Names that occur in several spellings up to case, which a list of steering tags must not hold."""
    key = text.fold_case(F.trim(name_col))
    return names.groupBy(key.alias("name_key")).agg(F.count_distinct(name_col).alias("n_spellings")).filter("n_spellings > 1")
