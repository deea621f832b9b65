"""Ordered arguments folded into one record per entity, each field by its own rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_pair, pair_key, pair_value
from .spread import durable, running_total

LAST, ADD, PUT, SET = "last", "add", "put", "set"
APPEND, APPEND_WORDS, APPEND_SETS = "append", "append_words", "append_sets"
APPENDING = (APPEND, APPEND_WORDS, APPEND_SETS)

# The fields of a run record and the rule each is folded by.
RUN_FIELDS = {
    "image_version": LAST,
    "node_roles": APPEND_SETS,
    "envs": PUT,
    "envs_core": PUT,
    "envs_agent": PUT,
    "args": APPEND,
    "args_core": APPEND,
    "args_agent": APPEND,
    "image": LAST,
    "log_level": LAST,
    "nr_of_containers": LAST,
    "nr_of_instances": LAST,
    "ports": ADD,
    "features": APPEND_WORDS,
    "no_default_features": SET,
}


def _rule(fields: Mapping[str, str], field: Column) -> Column:
    """Rule of a field; null for a field that is not listed."""
    rule = F.lit(None).cast("string")
    for name, value in fields.items():
        rule = F.when(field == name, F.lit(value)).otherwise(rule)
    return rule


def _order(seq: Sequence[str]) -> Column:
    return F.col(seq[0]) if len(seq) == 1 else F.struct(*seq)


def pair_errors(args: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Arguments for a map field that do not read as ``key=value``; the fold leaves them out."""
    return args.filter((_rule(fields, F.col("field")) == PUT) & ~is_pair(F.col("value")))


def fold_settings(args: DataFrame, entity: str, seq: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """The fold as rows ``(entity, field, rule, pos, key, value)``.

    ``args`` has ``entity``, the columns ``seq`` that order them in total, ``field`` and ``value``.

    - last: the value given last
    - set: ``true`` if given at all
    - add: each distinct value, once
    - put: for each key of ``key=value``, the value given last
    - append: every value, with its position (the words or the set of words of a value are
      told apart in :func:`fold_records`)

    All rules but append are one aggregate of constant size, told apart by what they group by.
    Positions are taken in slices where an entity has very many values.
    """
    ruled = args.withColumn("rule", _rule(fields, F.col("field")))
    key = (
        F.when(F.col("rule") == ADD, F.col("value"))
        .when(F.col("rule") == PUT, pair_key(F.col("value")))
    )
    value = F.when(F.col("rule") == PUT, pair_value(F.col("value"))).when(
        F.col("rule") == SET, F.lit("true")
    ).otherwise(F.col("value"))
    reduced = (
        ruled.filter(~F.col("rule").isin(*APPENDING))
        .filter((F.col("rule") != PUT) | is_pair(F.col("value")))
        .select(entity, "field", "rule", key.alias("key"), value.alias("value"), _order(seq).alias("_seq"))
        .groupBy(entity, "field", "rule", "key")
        .agg(F.max_by("value", "_seq").alias("value"))
        .select(entity, "field", "rule", F.lit(None).cast("long").alias("pos"), "key", "value")
    )
    appended = running_total(
        ruled.filter(F.col("rule").isin(*APPENDING)).select(entity, *seq, "field", "rule", "value"),
        [entity, "field"],
        seq,
        "pos",
    ).select(entity, "field", "rule", "pos", F.lit(None).cast("string").alias("key"), "value")
    return reduced.unionByName(appended)


def fold_records(folded: DataFrame, entity: str, fields: Mapping[str, str]) -> DataFrame:
    """The record of each entity as one header row and a row for each item of its lists, sets and maps.

    ``(entity, field, pos, key, value, words)`` and a column for each field that holds one value.
    In the header ``field`` is null, and a field never given is null, or false if it is a flag. In
    the other rows those columns are null; lists stay in order, sets and maps are in order of their
    keys, and ``words`` are those of a value, or their sorted set, where the field's rule says so.
    The form is the same for any number of items. The folded rows are written down, as they are
    read more than once.
    """
    folded = durable(folded)
    members = F.col("rule").isin(ADD, PUT)
    placed = running_total(folded.filter(members).drop("pos"), [entity, "field"], ["key"], "pos")
    listed = folded.filter(F.col("rule").isin(*APPENDING)).unionByName(placed.select(*folded.columns))
    words = F.split("value", " ")
    told = (
        F.when(F.col("rule") == APPEND_WORDS, words)
        .when(F.col("rule") == APPEND_SETS, F.array_sort(F.array_distinct(words)))
    )
    items = listed.select(entity, "field", "pos", "key", "value", told.alias("words"))

    def of(name: str) -> Column:
        return F.col("field") == name

    single = {
        LAST: lambda n: F.max(F.when(of(n), F.col("value"))),
        SET: lambda n: F.coalesce(F.bool_or(of(n)), F.lit(False)),
    }
    columns = [single[rule](name).alias(name) for name, rule in fields.items() if rule in single]
    headers = folded.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"), *columns).drop("_rows")
    return items.unionByName(headers, allowMissingColumns=True)
