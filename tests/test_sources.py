import hashlib

from fixtures import rows

from fleetcatalog.operators.contents import file_catalog, file_digests
from fleetcatalog.sources.reports import report_counts, report_names
from fleetcatalog.sources.texts import read_texts
from fleetcatalog.sources.tree import tree_scan


def write(root, *names, text=""):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def names(df):
    return sorted(r.rel_path for r in df.collect())


def test_one_folder(spark, tmp_path):
    write(tmp_path, "bundle.conf", "runtime-config.sh")
    assert names(tree_scan(spark, [str(tmp_path)])) == ["bundle.conf", "runtime-config.sh"]


def test_sub_folders(spark, tmp_path):
    files = ["bundle.conf", "conf/logback.xml", "logs/application.log", "logs/system.log", "runtime-config.sh"]
    write(tmp_path, *files)
    (tmp_path / "empty").mkdir()
    assert names(tree_scan(spark, [str(tmp_path)])) == files


def test_names_the_file_sources_leave_out(spark, tmp_path):
    files = [".env", "_b/f.txt", "a/.h/x y%.txt", "a/b/c %41/d/é.log"]
    write(tmp_path, *files)
    assert names(tree_scan(spark, [str(tmp_path)])) == files
    digests = file_digests(tree_scan(spark, [str(tmp_path)])).collect()
    assert {r.digest for r in digests} == {hashlib.sha256(b"").hexdigest()} and len(digests) == 4
    assert names(tree_scan(spark, [f"file://{tmp_path}"], "*.txt")) == ["_b/f.txt", "a/.h/x y%.txt"]


def test_link_to_nothing(spark, tmp_path):
    write(tmp_path, "a", text="x")
    (tmp_path / "lost").symlink_to(tmp_path / "nowhere")
    assert rows(tree_scan(spark, [str(tmp_path)]).select("rel_path", "length")) == [("a", 1), ("lost", None)]


def test_several_roots(spark, tmp_path):
    write(tmp_path, "one/a", "two/a", "three/a")
    listed = tree_scan(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert sorted((r.root.rsplit("/", 1)[1], r.rel_path) for r in listed.collect()) == [("one", "a"), ("two", "a")]


def test_file_digests(spark, tmp_path):
    write(tmp_path, "a.txt", "b/c.tar.gz", text="same")
    write(tmp_path, "d.txt", "_e", text="")
    (tmp_path / "big.bin").write_bytes(b"0123456789abcdef" * 200_000)
    digests = file_digests(tree_scan(spark, [str(tmp_path)]))
    got = {r.rel_path: (r.digest, r.length, r.artifact) for r in digests.collect()}
    same = hashlib.sha256(b"same").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    big = hashlib.sha256(b"0123456789abcdef" * 200_000).hexdigest()
    assert got == {
        "a.txt": (same, 4, f"a-{same}.txt"),
        "b/c.tar.gz": (same, 4, f"c.tar-{same}.gz"),
        "d.txt": (empty, 0, f"d-{empty}.txt"),
        "_e": (empty, 0, f"_e-{empty}"),
        "big.bin": (big, 3_200_000, f"big-{big}.bin"),
    }
    assert rows(file_catalog(digests)) == sorted([(same, 2, "a.txt"), (empty, 2, "_e"), (big, 1, "big.bin")])


REPORT = "\n".join(
    ["ID NAME VER #REP #STR #RUN ROLES"]
    + ["abc visualizer v2 1 0 1 web", "only", "  lead word v1 1 0 0", "def visualizer v2 1 0 0 web", "tail   "]
    + [f"i{n} name{n} v1 {n} 0 0" for n in range(7)]
)


def test_report_names(spark):
    df = spark.createDataFrame(
        [("a", REPORT), ("failed", None), ("header", "ID NAME"), ("crlf", "H\r\nx y\r\nz w\rp q")],
        "source string, text string",
    )
    # Ten lines are read: name5 and name6 are beyond them.
    expected = [("a", n) for n in ["visualizer", "lead", "name0", "name1", "name2", "name3", "name4"]]
    expected += [("crlf", n) for n in "ywq"]
    assert rows(report_names(df, "source", "text")) == sorted(expected)


def test_report_counts(spark):
    df = spark.createDataFrame([("a", REPORT)], "source string, text string")
    got = {(r.id, r.name): (r.replicated, r.starting, r.running) for r in report_counts(df, "source", "text").collect()}
    assert got["abc", "visualizer"] == (1, 0, 1)
    assert got["def", "visualizer"] == (1, 0, 0)
    # Every line counts, however many there are and however they end.
    assert [got[f"i{n}", f"name{n}"] for n in range(7)] == [(n, 0, 0) for n in range(7)]
    assert len(got) == 10
    for end in ("\n", "\r", "\r\n"):
        text = end.join(["ID NAME", *[f"i{n} n{n} v1 {n} 0 0" for n in range(1001)]])
        df = spark.createDataFrame([("a", text)], "source string, text string")
        found = report_counts(df, "source", "text").collect()
        assert sorted(r.replicated for r in found) == list(range(1001))


def test_read_texts(spark, tmp_path):
    write(tmp_path, "a/one.json", "two.json", text="[\n]")
    write(tmp_path, "three.txt")
    got = {r.source.rsplit("/", 1)[1]: r.text for r in read_texts(spark, str(tmp_path), "*.json").collect()}
    assert got == {"one.json": "[\n]", "two.json": "[\n]"}
