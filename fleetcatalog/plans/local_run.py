"""Arguments for a local run: folded by field, with the ports of all services put in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import RUN_FIELDS, fold_settings
from ..operators.overrides import override_global
from ..operators.ports import exposed_ports


def run_settings(args: DataFrame, base: DataFrame, override: DataFrame) -> DataFrame:
    """Folded rows per run, with the exposed ports of the run's endpoints added to ``ports``.

    ``args`` is ``(entity, seq, field, value)``, one entity per run; endpoint rows have ``entity``
    and ``services``. The ports are put in as arguments, so that the fold itself removes repeats.
    """
    used = override_global(base, override, within="entity")
    uris = used.select("entity", F.explode("services").alias("uri"))
    added = exposed_ports(uris, "uri", keys=["entity"]).select(
        "entity",
        F.lit(0).cast(args.schema["seq"].dataType).alias("seq"),
        F.lit("ports").alias("field"),
        F.col("port").cast("string").alias("value"),
    )
    return fold_settings(args.unionByName(added), "entity", ["seq"], RUN_FIELDS)
