"""Manifests written as files: one document for each bundle, named by its digest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, groupby
from json.encoder import encode_basestring

from pyarrow import RecordBatch, fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Endpoints that are written to a file at once.
AT_ONCE = 1000

# Folder below the target in which tasks write before their files get their names.
UNFINISHED = "_unfinished"


@dataclass
class Written(WriterCommitMessage):
    """What a task has finished: names of files, and where they are until the commit."""

    folder: str
    names: list[str]


def _head(document: str, bundle: str) -> tuple[str, str]:
    """A header's JSON up to where the endpoints of the bundle's own component go, and what comes after them."""
    header = json.loads(document)
    components = header.pop("components")
    own = components.pop(bundle, {})
    fields = [f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False, separators=(',', ':'))}" for k, v in header.items()]
    others = [f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False, separators=(',', ':'))}" for k, v in components.items()]
    inner = "".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False, separators=(',', ':'))}," for k, v in own.items())
    name = json.dumps(bundle, ensure_ascii=False)
    return "{" + "".join(f"{x}," for x in fields) + '"components":{' + "".join(f"{x}," for x in others) + f'{name}:{{{inner}"endpoints":{{', "}}}}"


class ManifestWriter(DataSourceWriter):
    """Each task writes its bundles one after the other, some endpoints at once, to a folder of its own; the driver gives the files their names.

    A name has the digest in it, so a task that is run again, or a job, writes the same files, and a file
    that is there already is the same.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        return self._write((r["artifact"], r["bundle"], r["label"], r["document"]) for r in rows)

    def _write(self, rows: Iterator[tuple[str, str, str | None, str]]) -> Written:
        store, base = self._place()
        folder, names = f"{base}/{UNFINISHED}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for (artifact, bundle), parts in groupby(rows, key=lambda r: r[:2]):
            _, _, label, document = next(parts)
            if label is not None:
                raise ValueError(f"{bundle} has no header, or its rows are not in order")
            head, tail = _head(document, bundle)
            with store.open_output_stream(f"{folder}/{artifact}") as out:
                out.write(head.encode())
                comma = ""
                for some in batched((f"{encode_basestring(label)}:{document}" for _, _, label, document in parts), AT_ONCE):
                    out.write((comma + ",".join(some)).encode())
                    comma = ","
                out.write(tail.encode())
            names.append(artifact)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._place()
        for done in messages:
            for name in done.names if done else []:
                store.move(f"{done.folder}/{name}", f"{base}/{name}")
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{UNFINISHED}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{UNFINISHED}")


class BatchWriter(ManifestWriter, DataSourceArrowWriter):
    """The same from Arrow batches, without a ``Row`` for each endpoint."""

    def write(self, batches: Iterator[RecordBatch]) -> Written:
        columns = ("artifact", "bundle", "label", "document")
        return self._write(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))


class ManifestFiles(DataSource):
    """``df.write.format("manifest-files")``; the rows are those that :func:`write_documents` puts in order."""

    @classmethod
    def name(cls) -> str:
        return "manifest-files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(self.options["path"])


def write_documents(manifests: DataFrame, artifacts: DataFrame, path: str) -> None:
    """Writes the manifest of each bundle as one JSON file below ``path``, named by its ``artifact``.

    ``manifests`` is ``(bundle, label, document)``, ``artifacts`` is ``(bundle, artifact)``. A bundle is one task's, as it is
    one file, but is never held: its endpoints pass in order of their labels.
    """
    named = manifests.join(artifacts.select("bundle", "artifact"), "bundle").select("bundle", "artifact", "label", "document")
    ordered = named.repartitionByRange("bundle").sortWithinPartitions("bundle", F.col("label").asc_nulls_first())
    manifests.sparkSession.dataSource.register(ManifestFiles)
    ordered.write.format("manifest-files").mode("append").option("path", path).save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(bundle, label, document)`` of the files that :func:`write_documents` wrote, without their headers.

    A file is a row until its endpoints are taken out of it, by JSON type, so numbers stay as they are written.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = files.select(F.parse_json("value").alias("v")).select(F.variant_get("v", "$.name", "string").alias("bundle"), "v")
    components = F.try_variant_get("v", "$.components", "map<string,variant>")
    endpoints = F.try_variant_get(F.try_element_at(components, F.col("bundle")), "$.endpoints", "map<string,variant>")
    return parsed.select("bundle", F.explode(endpoints).alias("label", "endpoint")).select("bundle", "label", F.to_json("endpoint").alias("document"))
