"""Ordered plan for installing all bundles of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config_present, env_name, name_or_path

FIXED_ROWS = "name string, bundle_name string"


def install_plan(projects: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Rows to load and run, in order: ``(phase, ord, name, source, config_file, id_env)``.

    A project counts if it has both a bundle and a configuration; its configuration file is
    attached if it has generated text or a source folder. ``fixed`` rows (``ord, name,
    bundle_name``) come first. The order is the project order, by a range-partitioned sort.
    """
    def shaped(df: DataFrame, phase: int, source, config) -> DataFrame:
        return df.select(
            F.lit(phase).alias("phase"),
            F.col("ord").cast("long").alias("ord"),
            "name",
            source.alias("source"),
            config.alias("config_file"),
            F.concat(env_name(F.col("name")), F.lit("_BUNDLE_ID")).alias("id_env"),
        )

    kept = projects.filter(F.col("has_bundle") & F.col("has_configuration"))
    with_config = config_present(F.col("config_text"), F.col("config_dir_exists"))
    plan = shaped(
        kept,
        1,
        name_or_path(F.lit(None).cast("string"), F.col("bundle_file")),
        F.when(with_config, F.col("config_file")),
    )
    if fixed is not None:
        first = shaped(
            fixed, 0, name_or_path(F.col("bundle_name"), F.lit(None).cast("string")), F.lit(None).cast("string")
        )
        plan = first.unionByName(plan)
    return plan.orderBy("phase", "ord")
