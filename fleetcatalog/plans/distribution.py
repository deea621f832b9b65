"""From scoped settings and endpoints to checked manifests with their digests."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import artifact_name
from ..operators.manifest import bundle_names, manifest_digests, manifest_emit, resource_normalize, version_defaults
from ..operators.overlay import overlay_delta, resolve_settings
from ..operators.overrides import override_per_entity
from ..operators.routes import route_rules
from ..operators.validation import valid_bundles, violations
from ..store import durable


class Distribution(NamedTuple):
    report: DataFrame
    bad_rules: DataFrame
    manifests: DataFrame
    artifacts: DataFrame


def apply_settings(bundles: DataFrame, settings: DataFrame, scopes: DataFrame) -> DataFrame:
    """``bundles`` with the settings resolved for each bundle's scope put over its own fields.

    ``bundles`` has a ``scope`` column; ``settings`` values are texts, cast to the field's type, those of
    lists, maps and structs JSON. Settings under names that are no column of ``bundles`` are ignored.
    """
    types = {c: t for c, t in bundles.dtypes if c not in ("name", "scope")}
    resolved = overlay_delta(resolve_settings(settings, scopes), full=True)
    wide = resolved.groupBy(F.col("target").alias("_target")).agg(
        *[F.max(F.when(F.col("key") == c, F.col("value"))).alias("_s_" + c) for c in types]
    )
    joined = bundles.join(wide, F.col("scope") == F.col("_target"), "left")

    def given(c: str) -> Column:
        text = F.col("_s_" + c)
        return F.from_json(text, types[c]) if types[c].startswith(("array", "map", "struct")) else text.cast(types[c])

    return joined.select(*[F.coalesce(given(c), F.col(c)).alias(c) if c in types else F.col(c) for c in bundles.columns])


def distribute(
    bundles: DataFrame,
    endpoints: DataFrame,
    override: DataFrame,
    override_defined: DataFrame,
) -> Distribution:
    """Checks bundles, then emits the manifest of each valid one and names it by digest.

    The declared endpoints are checked, the overriding ones are emitted.
    """
    complete = resource_normalize(bundle_names(version_defaults(bundles)))
    report = violations(complete, endpoints)
    used = override_per_entity(endpoints, override, override_defined, "bundle")
    bad_rules = route_rules(used).filter(F.col("error").isNotNull())
    sound = valid_bundles(complete, report).join(
        bad_rules.select(F.col("bundle").alias("name")).distinct(), "name", "left_anti"
    )
    # Read for the headers, for the names of endpoints and for the packages; then for rows, tree and digests.
    sound = durable(sound)
    manifests = durable(manifest_emit(sound, used))
    packages = sound.select(F.col("name").alias("bundle"), "package")
    artifacts = manifest_digests(manifests).join(packages, "bundle").select(
        "bundle", "digest", artifact_name(F.concat("package", F.lit(".json")), F.col("digest")).alias("artifact")
    )
    return Distribution(report, bad_rules, manifests, artifacts)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Writes the rows of all manifests as a table in order of bundle and label, the header first."""
    order = ["bundle", "label"]
    manifests.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
