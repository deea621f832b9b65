"""Ports of service URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uri_port(uri: Column) -> Column:
    """Port of a service URI: -1 when it names a host but no port, null when it cannot be read.

    Without a host (``http://:9000``) the authority after its first character is the port.
    """
    host = F.try_parse_url(uri, F.lit("HOST"))
    authority = F.try_parse_url(uri, F.lit("AUTHORITY"))
    tail = F.substr(authority, F.lit(2))
    whole = F.when(tail.rlike(r"^[+-]?[0-9]+\z"), tail.try_cast("int"))
    digits = F.regexp_extract(authority, r":([0-9]+)\z", 1)
    return F.when(host.isNull(), whole).otherwise(
        F.when(digits == "", F.lit(-1)).otherwise(digits.try_cast("int"))
    )
