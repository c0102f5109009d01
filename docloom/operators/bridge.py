"""Suggestions for chat requests: the user's prompt, the document it names, the merged answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text


def last_user_messages(messages: DataFrame) -> DataFrame:
    """conv_id and the text of its last user turn, empty if there is none."""
    user = (F.col("role") == "user") & F.col("text").isNotNull()
    return messages.groupBy("conv_id").agg(F.coalesce(F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))), F.lit("")).alias("prompt"))


def document_identity(prompt: Column, marker: str, filename_mark: str, content_mark: str) -> Column:
    """struct(filename, content) that a prompt names; null if it has another shape.

    The file name stands between filename_mark and content_mark, the content after the first colon from content_mark on.
    """
    f, c = F.locate(filename_mark, prompt), F.locate(content_mark, prompt)
    colon = F.locate(":", F.substr(prompt, c))
    name = text.strip(F.substr(prompt, f + len(filename_mark), c - f - len(filename_mark)))
    content = text.strip(F.substr(prompt, c + colon))
    fits = F.contains(prompt, F.lit(marker)) & (f > 0) & (c > f) & (colon > 0)
    return F.when(fits, F.struct(F.when(c - f > len(filename_mark), name).otherwise("").alias("filename"), content.alias("content")))


def merge_candidate(suggested: Column, candidate: Column, correspondent: Column) -> Column:
    """Suggested correspondents with the candidate appended, unless the document has one or it is suggested already."""
    clean = text.collapse(candidate)
    there = F.exists(suggested, lambda s: text.fold_case(s) == text.fold_case(clean))
    return F.when((clean != "") & correspondent.isNull() & ~there, F.array_append(suggested, clean)).otherwise(suggested)


def chat_response(content: Column, model: str) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"), F.lit(True).alias("done")))


def named_suggestions(documents: DataFrame, suggestions: DataFrame, dimensions: DataFrame, key: str, kinds: list[str], plain: tuple[str, ...] = ()) -> DataFrame:
    """key, an empty title and, of each kind, the names of the suggested ids in their order; unknown ids are left out.
    plain: lists that are taken as they are, such as dates.

    suggestions: key and a list of ids a kind. dimensions: kind, id and name of all kinds together, so that one join
    and one grouping serve them all. A document without suggestions has empty lists.
    """
    tagged = lambda k: F.transform(k, lambda i, at: F.struct(F.lit(k).alias("kind"), at.alias("at_"), i.cast("long").alias("id")))
    lists = F.concat(*(F.coalesce(tagged(k), F.array().cast("array<struct<kind:string,at_:int,id:bigint>>")) for k in kinds))
    items = suggestions.select(key, F.inline(lists)).join(dimensions.select("kind", F.col("id").cast("long").alias("id"), "name"), ["kind", "id"])
    place = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at_", "name"))))
    named = items.groupBy(key).agg(*(F.transform(place(k), lambda x: x["name"]).alias(k) for k in kinds))
    out = documents.select(key).join(named, key, "left")
    if plain:
        out = out.join(suggestions.select(key, *plain), key, "left")
    return out.select(key, F.lit("").alias("title"), *(F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in [*kinds, *plain]))
