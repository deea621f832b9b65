"""Listing of files below folders."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import durable

LISTING = "root string, rel_path string, is_dir boolean, length long"
BATCH = 10_000


def _lister():
    """The listing of folders, as a function that tasks can run without this package installed."""
    from pyarrow import fs

    def entries(system, folder: str) -> Iterator[tuple[str, bool, int | None]]:
        if isinstance(system, fs.LocalFileSystem):
            # One entry at a time: a folder may hold any number of files.
            with os.scandir(folder) as found:
                for entry in found:
                    # A link to nothing is listed as a file without a length.
                    size = entry.stat().st_size if entry.is_file() else None
                    yield entry.name, entry.is_dir(), size
        else:
            for entry in system.get_file_info(fs.FileSelector(folder)):
                yield entry.base_name, entry.type == fs.FileType.Directory, entry.size

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, folder in zip(batch["root"], batch["rel_path"], strict=True):
                system, top = fs.FileSystem.from_uri(root)
                found = entries(system, f"{top.rstrip('/')}/{folder}")
                lead = f"{folder}/" if folder else ""
                while some := list(islice(found, BATCH)):
                    yield pd.DataFrame(
                        {
                            "root": root,
                            "rel_path": [lead + name for name, _, _ in some],
                            "is_dir": [is_dir for _, is_dir, _ in some],
                            "length": pd.array([size for _, _, size in some], dtype="Int64"),
                        }
                    )

    return children


def tree_scan(spark: SparkSession, roots: Sequence[str], pattern: str = "*") -> DataFrame:
    """Files at any depth below ``roots``, folders given as URIs or local paths: ``(root, rel_path, length)``.

    One distributed listing per level of depth. The file sources of Spark leave out names that
    begin with ``.`` or ``_``; this does not. ``pattern`` is a glob on the file name.
    """
    level = spark.createDataFrame([(root, "") for root in roots], "root string, rel_path string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    while True:
        listed = durable(level.repartition(tasks, "root", "rel_path").mapInPandas(_lister(), LISTING))
        found.append(listed.filter(~F.col("is_dir")).select("root", "rel_path", "length"))
        level = listed.filter("is_dir").select("root", "rel_path")
        if level.isEmpty():
            break
    files = found[0]
    for deeper in found[1:]:
        files = files.unionByName(deeper)
    if pattern == "*":
        return files
    return files.filter(F.regexp_extract("rel_path", r"([^/]*)\z", 1).rlike(fnmatch.translate(pattern)))
