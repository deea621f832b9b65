"""Settings across scopes: the nearest scope that defines a setting supplies it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CHECK_SETTINGS
from .spread import durable, prefixed

NON_QUALIFYING = tuple(CHECK_SETTINGS)
# Scopes that the message about a circle names.
CIRCLE_NAMES = 100
# Up to so many setting names, the values that a scope has are one row; with more they are a row each.
ROW_NAMES = 64


def inherited_settings(settings: DataFrame, scopes: DataFrame) -> DataFrame:
    """``(start, key, value, supplier)``: all that holds in each scope that others delegate to.

    ``settings`` is ``(scope, key, value)`` with one value for a key of a scope, ``scopes`` is ``(scope,
    parent, is_config)``; a root has a null parent, and so has a scope whose parent is not listed. The
    scopes that others delegate to are few beside those that none does, and only they are walked.

    Each scope points at another above it, and has for each key the nearest value from below there on. In
    a round it takes over what the scope it points at has and it has not, and that one's pointer, so what
    it looks over doubles. A chain of any depth takes the logarithm of it in rounds; pairs of scopes are never
    listed. With up to ``ROW_NAMES`` keys each round writes a row per scope that is not at its root yet, with its
    values; with more, a row per scope and a row per scope and key that it has by then. A scope that still points at one after as many steps as there are scopes is in a circle, or below one.
    """
    used = scopes.select(F.col("parent").alias("_parent")).filter(F.col("_parent").isNotNull()).distinct()
    inner = scopes.join(used, F.col("scope") == F.col("_parent"), "left_semi")
    names = sorted((r[0] for r in settings.select("key").distinct().limit(ROW_NAMES + 1).collect()), key=lambda n: (n is not None, n or ""))
    if len(names) <= ROW_NAMES:
        return _inherited_rows(settings, inner, names)
    # A row is a scope's pointer or a value that it has.
    own = settings.join(inner.select("scope", "is_config"), "scope").select(
        "scope", F.lit(False).alias("_pointer"), "key", "value", F.when(F.col("is_config"), F.col("scope")).alias("supplier")
    )
    pointers = inner.select("scope", F.lit(True).alias("_pointer"), F.col("parent").alias("above"))
    state, steps = durable(pointers.unionByName(own, allowMissingColumns=True)), 1
    while True:
        at = state.filter("_pointer").agg(F.count(F.lit(1)), F.count("above")).first()
        if not at[1]:
            return state.filter("NOT _pointer").select(F.col("scope").alias("start"), "key", "value", "supplier")
        if steps > at[0]:
            raise _circle(state.filter("_pointer AND above IS NOT NULL"))
        up = prefixed(state, state.columns, "_u_")
        pointing = state.filter("_pointer AND above IS NOT NULL").select("scope", "above")
        taken = pointing.join(up, F.col("above") == F.col("_u_scope")).select(
            "scope", *[F.col(f"_u_{c}").alias(c) for c in ("_pointer", "key", "value", "supplier")], F.col("_u_above").alias("above"), F.lit(True).alias("_taken")
        )
        # Pointers are replaced by those taken over, also by none; of values the scope's own stay.
        stays = F.struct(F.when(F.col("_pointer"), ~F.col("_taken")).otherwise(F.col("_taken")))
        both = state.withColumn("_taken", F.lit(False)).unionByName(taken)
        # A parent that is not listed is as none.
        chosen = both.groupBy("scope", "_pointer", "key").agg(F.min_by(F.struct("value", "supplier", "above", "_taken"), stays).alias("s"))
        above = F.when(F.col("s._taken"), F.col("s.above"))
        state = durable(chosen.select("scope", "_pointer", "key", "s.value", "s.supplier", above.alias("above")))
        steps *= 2


def _circle(scopes: DataFrame) -> ValueError:
    names = ", ".join(str(r["scope"]) for r in scopes.select("scope").distinct().orderBy("scope").limit(CIRCLE_NAMES).collect())
    return ValueError(f"scopes delegate in a circle: {names}")


def _inherited_rows(settings: DataFrame, inner: DataFrame, names: list[str | None]) -> DataFrame:
    """:func:`inherited_settings` where names are few: a row is a scope, its pointer, and its value for each of ``names``, if any.

    A round is one join, of the scopes that still point at one with those they point at; the others are left as they are.
    """
    own = settings.join(inner.select("scope", "is_config"), "scope").select(
        "scope", "key", F.struct("value", F.when(F.col("is_config"), F.col("scope")).alias("supplier")).alias("v")
    )
    each = [F.max(F.when(F.col("key").eqNullSafe(F.lit(n)), F.col("v"))) for n in names]
    values = F.array(*each) if names else F.array().cast("array<struct<value:string,supplier:string>>")
    values = own.groupBy(F.col("scope").alias("_of")).agg(values.alias("values"))
    # A scope that is listed twice is one row.
    pointers = inner.groupBy("scope").agg(F.max("parent").alias("above"))
    nothing = F.array_repeat(F.lit(None).cast(values.schema["values"].dataType.elementType), len(names))
    state = pointers.join(values, F.col("scope") == F.col("_of"), "left").select("scope", "above", F.coalesce("values", nothing).alias("values"))
    latest, ended, steps = durable(state), None, 1
    count = latest.count()
    while True:
        ends, pending = latest.filter(F.col("above").isNull()), latest.filter(F.col("above").isNotNull())
        ended = ends if ended is None else ended.unionByName(ends)
        if pending.isEmpty():
            break
        if steps > count:
            raise _circle(pending)
        known = ended.unionByName(pending)
        up = prefixed(known, known.columns, "_u_")
        nearest = F.zip_with("values", F.coalesce("_u_values", nothing), lambda own, other: F.coalesce(own, other))
        # A parent that is not listed is as none.
        taken = pending.join(up, F.col("above") == F.col("_u_scope"), "left")
        latest = durable(taken.select("scope", F.col("_u_above").alias("above"), nearest.alias("values")))
        steps *= 2
    state = ended
    listed = F.transform("values", lambda v, i: F.struct(F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), i + 1).alias("key"), v.alias("v")))
    if not names:
        return state.select(F.col("scope").alias("start"), *[F.lit(None).cast("string").alias(c) for c in ("key", "value", "supplier")]).limit(0)
    found = state.select(F.col("scope").alias("start"), F.inline(F.filter(listed, lambda x: x["v"].isNotNull())))
    return found.select("start", "key", "v.value", "v.supplier")


def resolve_settings(settings: DataFrame, scopes: DataFrame) -> DataFrame:
    """``(target, key, value, scope)``: the value from the nearest defining scope, and that scope.

    ``settings`` is ``(scope, key, value)``; of two values for one key in one scope the one with the
    larger ``seq`` counts, if there is such a column, then the larger value. ``scope`` is null in the result where
    the supplier is no configuration but the project itself.

    What a scope that others delegate to resolves to is found first. Any other scope takes its
    own settings, else what its parent resolved to, so it is joined with one row per key and not
    with a chain. The choice is an aggregate of constant size, partly before the shuffle.
    """
    latest = ["seq", "value"] if "seq" in settings.columns else ["value"]
    settings = settings.groupBy("scope", "key").agg(F.max_by("value", F.struct(*latest)).alias("value"))
    above = inherited_settings(settings, scopes)
    own = settings.join(scopes.select("scope", "is_config"), "scope").select(
        F.col("scope").alias("target"), "key", "value", F.when(F.col("is_config"), F.col("scope")).alias("supplier"), F.lit(0).alias("distance")
    )
    inherited = (
        scopes.select(F.col("scope").alias("target"), F.col("parent").alias("start"))
        .join(above, "start")
        .select("target", "key", "value", "supplier", F.lit(1).alias("distance"))
    )
    near = F.min_by(F.struct("value", "supplier"), F.col("distance"))
    chosen = own.unionByName(inherited).groupBy("target", "key").agg(near.alias("s"))
    return chosen.select("target", "key", "s.value", F.col("s.supplier").alias("scope"))


def overlay_delta(
    resolved: DataFrame, full: bool, non_qualifying: tuple[str, ...] = NON_QUALIFYING
) -> DataFrame:
    """Settings to emit per target: all of them, or only those a configuration supplies.

    A value inherited from a parent configuration counts as supplied. A target for which no
    qualifying setting is supplied emits nothing. Rows per target are its distinct setting names.
    """
    if full:
        return resolved
    supplied = resolved.filter(F.col("scope").isNotNull())
    qualifies = F.bool_or(~F.col("key").isin(*non_qualifying)).over(Window.partitionBy("target"))
    return supplied.withColumn("_any", qualifies).filter("_any").drop("_any")
