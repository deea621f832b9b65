"""Ports that services expose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uri_port


def uri_ports(uris: DataFrame, uri: str) -> DataFrame:
    """``uris`` plus ``port`` (-1 for none) and ``error`` for a URI whose port cannot be read."""
    return uris.withColumn("port", uri_port(F.col(uri))).withColumn(
        "error", F.when(F.col("port").isNull(), F.concat(F.lit("no port in "), F.coalesce(uri, F.lit("null"))))
    )


def exposed_ports(
    uris: DataFrame,
    uri: str,
    given: DataFrame | None = None,
    strict: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Distinct ``(keys, port)``, ports zero and up, over all URIs and the ports ``given`` by hand.

    A URI that cannot be read adds nothing, or fails the job if ``strict``. Repeats go before
    the shuffle, which moves at most one row per port and input partition.
    """
    port = F.col("port")
    if strict:
        port = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("int")).otherwise(port)
    ports = uri_ports(uris, uri).select(*keys, port.alias("port")).filter(F.col("port") >= 0)
    if given is not None:
        ports = ports.union(given.select(*keys, F.col("port").cast("int")))
    return ports.distinct()
