"""Configurations as rows: a table of rules gives error codes, and versions are rows of a history table."""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between attempts, and the longest side of an image, where the setting can't be used. Fixed values.
DEFAULT_DELAYS, DEFAULT_SIDE = (15, 60, 300, 600), 3000
#: Bounds of those settings. Fixed values.
MOST_DELAYS, DELAY_RANGE, SIDE_RANGE = 10, (1, 86_400), (2000, 4000)


class Rule(NamedTuple):
    """What a setting must be: whole (from low to high), text (not blank), url, or delays (a list of whole numbers)."""

    path: str
    kind: str
    low: int = 0
    high: int = 0


#: The settings of the workflow and what holds for them.
RULES = (
    Rule("url", "url"),
    Rule("queue_tag", "text"),
    Rule("poll_seconds", "whole", 1, 86_400),
    Rule("max_side_pixels", "whole", *SIDE_RANGE),
    Rule("retry_delays", "delays", *DELAY_RANGE),
)


def _value(config: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(config, f"$.{path}", kind)


def _whole(config: Column, path: str) -> Column:
    """The setting as a whole number; null if it is anything else, such as true or 3.5."""
    exact = F.schema_of_variant(_value(config, path, "variant")) == "BIGINT"
    return F.when(exact, _value(config, path, "long"))


def _holds(config: Column, rule: Rule) -> Column:
    text = _value(config, rule.path, "string")
    is_text = F.schema_of_variant(_value(config, rule.path, "variant")) == "STRING"
    items = _value(config, rule.path, "array<variant>")
    fits = lambda v: (F.schema_of_variant(v) == "BIGINT") & F.try_variant_get(v, "$", "long").between(rule.low, rule.high)
    test = {
        "whole": lambda: _whole(config, rule.path).between(rule.low, rule.high),
        "text": lambda: is_text & text.rlike(r"\S"),
        "url": lambda: is_text & text.rlike(r"(?i)^\s*https?://[^/\s?#]+"),
        "delays": lambda: (F.size(items) <= MOST_DELAYS) & F.forall(items, lambda v: F.coalesce(fits(v), F.lit(False))),
    }[rule.kind]()
    return F.coalesce(test, F.lit(False))


def config_errors(config: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The paths of the settings that break their rule, in the order of rules. config: a variant; missing settings break it too."""
    return F.filter(F.array(*(F.when(~_holds(config, r), r.path) for r in rules)), lambda e: e.isNotNull())


def unknown_keys(config_json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that are not allowed, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(config_json), F.array(*(F.lit(k) for k in allowed))))


def lenient_delays(config: Column, path: str = "retry_delays") -> Column:
    """The first ten delays; any bad one among them, or no list, gives the default list; an empty list stays."""
    items = F.slice(_value(config, path, "array<variant>"), 1, MOST_DELAYS)
    numbers = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "int")))
    good = F.forall(numbers, lambda n: F.coalesce(n.between(*DELAY_RANGE), F.lit(False)))
    return F.when(good, numbers).otherwise(F.array(*(F.lit(d) for d in DEFAULT_DELAYS)))


def lenient_side(config: Column, path: str = "max_side_pixels") -> Column:
    """The longest side, also if it is written as text; anything else gives the default."""
    text = F.when(F.schema_of_variant(_value(config, path, "variant")) != "BOOLEAN", _value(config, path, "string"))
    number = F.when(text.rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim(text).try_cast("int"))
    return F.when(number.between(*SIDE_RANGE), number).otherwise(DEFAULT_SIDE)


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(config: dict, without: tuple[str, ...] = ()) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in config.items() if k not in without}).encode()).hexdigest()


def save(history: DataFrame, configs: DataFrame, source: str = "save") -> DataFrame:
    """history (section, version, config, source) with a new version of each section in configs (section, config)."""
    now = history.groupBy("section").agg(F.max("version").alias("now_"))
    new = configs.join(now, "section", "left").select("section", (F.coalesce("now_", F.lit(0)) + 1).cast("long").alias("version"), "config", F.lit(source).alias("source"))
    return history.select("section", "version", "config", "source").union(new)


def restore(history: DataFrame, wanted: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """history after the wanted (section, version) are saved anew with their allowed keys, and the wanted rows that
    don't exist or can't be read."""
    readable = history.filter(F.try_parse_json("config").isNotNull())
    old = wanted.join(readable, ["section", "version"])
    kept = F.to_json(F.map_filter(F.from_json("config", "map<string,variant>"), lambda k, _: k.isin(*allowed)))
    return save(history, old.select("section", kept.alias("config")), "restore"), wanted.join(readable, ["section", "version"], "left_anti")


def listed(history: DataFrame) -> DataFrame:
    """The history of each section, newest first (place 1), with an error where a configuration can't be read."""
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("version")))
    return history.select("section", "version", "source", place.alias("place"), F.when(F.try_parse_json("config").isNull(), "unreadable").alias("error"))


def models(sections: DataFrame, model_col: str, default: str) -> DataFrame:
    """The distinct models (model) that configurations name; the default one if none does."""
    named = sections.select(F.trim(model_col).alias("model")).filter("model <> ''").distinct()
    fallback = sections.sparkSession.createDataFrame([(default,)], "model string")
    return named.union(fallback.join(named.limit(1).select(F.lit(True).alias("named_")), F.col("named_"), "left_anti"))
