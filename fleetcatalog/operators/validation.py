"""Rules every bundle must keep."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import version_rank
from ..functions.fixed import LAST_VERSION_WITHOUT_ACLS, TARGET_VERSIONS
from ..store import remove, shared_folder

RULES = ("version", "endpoint", "memory")


def violations(bundles: DataFrame, endpoints: DataFrame) -> DataFrame:
    """All broken rules: ``(bundle, rule, label, message)``.

    version: access rules are on, but the target version has none yet. endpoint: an endpoint
    declares both rules and services; an empty list is declared, a null is not. memory: below
    the bundle's minimum. The endpoint rule reads the declared endpoints, so pass those and not
    what overrides them: overrides are never checked. Rows are checked where they lie, without
    a shuffle.
    """
    gate = F.col("enable_acls") & (
        version_rank(F.col("target_version")) <= TARGET_VERSIONS.index(LAST_VERSION_WITHOUT_ACLS)
    )
    low = F.col("memory") < F.col("min_memory")
    mib = [F.shiftright(F.col(c), 20).cast("string") for c in ("memory", "min_memory")]

    def broken(when: Column, rule: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), message.alias("message")))

    checks = F.array(
        broken(
            gate,
            "version",
            F.concat(F.lit("access rules are enabled, but target version "), "target_version", F.lit(" has none")),
        ),
        broken(low, "memory", F.concat(F.lit("memory of "), mib[0], F.lit(" MiB is below the minimum of "), mib[1], F.lit(" MiB"))),
    )
    of_bundles = bundles.select(
        F.col("name").alias("bundle"), F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")
    ).select("bundle", "c.rule", F.lit(None).cast("string").alias("label"), "c.message")
    of_endpoints = endpoints.filter(F.col("acls").isNotNull() & F.col("services").isNotNull()).select(
        "bundle",
        F.lit("endpoint").alias("rule"),
        "label",
        F.concat(F.lit("endpoint '"), "label", F.lit("' declares both rules and services")).alias("message"),
    )
    return of_bundles.unionByName(of_endpoints)


def rule_order(rule: Column) -> Column:
    """Order in which the failures of a bundle are told."""
    return F.array_position(F.array(*[F.lit(r) for r in RULES]), rule)


def valid_bundles(bundles: DataFrame, report: DataFrame) -> DataFrame:
    """Bundles without any violation."""
    failed = report.select(F.col("bundle").alias("name")).distinct()
    return bundles.join(failed, "name", "left_anti")


class InvalidBundles(ValueError):
    """Some bundles break a rule; ``place`` is the table of all violations."""

    def __init__(self, message: str, place: str) -> None:
        super().__init__(message)
        self.place = place


def require_valid(report: DataFrame, path: str | None = None) -> None:
    """Fails once if the report has rows, telling how many break each rule and where all of them are.

    All violations are written as a table to ``path``, those of a bundle together and in order of rule and label;
    without a path, to the shared folder, where they stay. They are counted in what was written, so the report is
    evaluated once. Without any violation nothing is left at the path.
    """
    place = path or f"{shared_folder(report.sparkSession)}/violations-{uuid.uuid4().hex}"
    ordered = report.withColumn("rank", rule_order(F.col("rule"))).repartition("bundle").sortWithinPartitions("bundle", "rank", "label")
    ordered.drop("rank").write.parquet(place)
    written = report.sparkSession.read.schema(report.schema).parquet(place)
    counts = {r["rule"]: r["count"] for r in written.groupBy("rule").count().collect()}
    if not counts:
        remove(report.sparkSession, place)
        return
    lines = [f"{counts[r]} x {r}" for r in RULES if r in counts]
    raise InvalidBundles("\n".join(["bundle settings are not valid", *lines, f"all of them: {place}"]), place)
