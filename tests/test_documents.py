import json
import os

import pytest
from fixtures import BASIC, BUNDLE, ENDPOINT, bundle
from pyarrow import RecordBatch
from pyspark.sql import Row

from fleetcatalog.operators.manifest import bundle_names, manifest_digests, manifest_emit, resource_normalize
from fleetcatalog.sources.documents import UNFINISHED, ManifestFiles, ManifestWriter, read_documents, write_documents


@pytest.fixture
def made(spark):
    bundles = spark.createDataFrame([bundle("basic", checks=["x"]), bundle("none"), bundle('a "b" é')], BUNDLE)
    manifests = manifest_emit(resource_normalize(bundle_names(bundles)), spark.createDataFrame(BASIC, ENDPOINT)).cache()
    artifacts = manifest_digests(manifests).selectExpr("bundle", "concat(digest, '.json') AS artifact")
    return manifests, artifacts


def test_one_file_for_each_bundle(spark, made, tmp_path):
    manifests, artifacts = made
    path = str(tmp_path / "out")
    for _ in range(2):  # the second time changes nothing
        write_documents(manifests, artifacts, path)
        assert sorted(os.listdir(path)) == sorted(r.artifact for r in artifacts.collect())
    rows = manifests.collect()
    for r in artifacts.collect():
        with open(f"{path}/{r.artifact}") as file:
            got = json.load(file)
        header = json.loads(next(x.document for x in rows if x.bundle == r.bundle and x.label is None))
        endpoints = got["components"][r.bundle].pop("endpoints")
        assert got == header
        assert endpoints == {x.label: json.loads(x.document) for x in rows if x.bundle == r.bundle and x.label is not None}
    back = {(r.bundle, r.label): json.loads(r.document) for r in read_documents(spark, path).collect()}
    assert back == {(x.bundle, x.label): json.loads(x.document) for x in rows if x.label is not None}


def part(label, document="{}", bundle="b"):
    return Row(bundle=bundle, artifact=f"{bundle}.json", label=label, document=document)


def test_a_task_that_fails_once(tmp_path):
    """What it left is not seen, and its second run's files are whole."""
    writer, header = ManifestWriter(str(tmp_path)), part(None, '{"name":"b","components":{"b":{}}}')

    def broken():
        yield header
        yield part("one")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    assert os.listdir(tmp_path) == [UNFINISHED]
    done = writer.write(iter([header, part("one"), part("two", "[1]")]))
    writer.commit([done, None])
    assert os.listdir(tmp_path) == ["b.json"]
    assert json.loads((tmp_path / "b.json").read_text()) == {"name": "b", "components": {"b": {"endpoints": {"one": {}, "two": [1]}}}}
    writer.write(iter([header]))
    writer.abort([None])
    assert os.listdir(tmp_path) == ["b.json"]


def test_rows_without_a_header(tmp_path):
    with pytest.raises(ValueError, match="no header"):
        ManifestWriter(str(tmp_path)).write(iter([part("one")]))


def test_batches_are_written_without_rows(tmp_path):
    """Bundles that go on from one batch into the next, and more endpoints than are written at once."""
    parts = [part(None, '{"name":"b","components":{"b":{}}}'), *[part(f'l"{i}', str(i)) for i in range(2500)], part(None, '{"name":"c","components":{"c":{}}}', "c"), part("x", "1", "c")]
    batches = [RecordBatch.from_pylist([r.asDict() for r in parts[k : k + 700]]) for k in range(0, len(parts), 700)]
    writer = ManifestFiles({"path": str(tmp_path)}).writer(None, False)
    writer.commit([writer.write(iter(batches))])
    assert json.loads((tmp_path / "b.json").read_text()) == {"name": "b", "components": {"b": {"endpoints": {f'l"{i}': i for i in range(2500)}}}}
    assert json.loads((tmp_path / "c.json").read_text())["components"]["c"]["endpoints"] == {"x": 1}
