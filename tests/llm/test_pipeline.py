import random

from conftest_llm import DATA, DOCS, EXTRA, ODD
from pyspark.sql import functions as F
from test_decontaminate import plain as contaminated
from test_exact_dedup import plain as exact
from test_near_dedup import classes
from test_packing import whole

import __spark_entry__
import corpus_pipeline
from fleetcatalog.llm import packing, queries, quality
from fleetcatalog.llm.store import held_out, release


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_against_plain_versions(spark):
    """Every stage on all that the one before it kept."""
    docs = queries.read(spark, DATA, "documents")
    labels = queries.read(spark, DATA, "labels")
    items = [tuple(r) for r in queries.read(spark, DATA, "benchmark").select("item_id", "text").collect()]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], DATA))
        assert len(steps) == 6 or steps[-1].columns == docs.columns
    trees = quality.train(docs, labels, lambda i: ~held_out(i, 4, 2))
    good = {r.doc_id for r in quality.score(docs, trees).where(F.col("score") >= 0.7).collect()}
    one, two, three, four = map(rows_of, steps[1:5])
    assert sorted(k for k, _ in one) == sorted(good)
    assert sorted(k for k, _ in two) == sorted(r[0] for r in exact(one) if r[3])
    least = {}
    for (key, _), group in zip(two, classes(two), strict=True):
        least[group] = min(least.get(group, key), key)
    assert sorted(k for k, _ in three) == sorted(least.values())
    assert sorted(k for k, _ in four) == sorted(r[0] for r in contaminated(three, items) if not r[5])
    lengths = {r.doc_id: r.n_tokens for r in packing.token_counts(steps[4]).collect()}
    assert set(lengths) == {k for k, _ in four}
    whole(steps[5].collect(), lengths, packing.SIZES)
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "length").collect())) == sorted(map(str, steps[5].select("doc_id", "piece", "length").collect()))


def test_odd_rows_and_other_columns(spark):
    pick = random.Random(1)
    text = " ".join(f"w{pick.randrange(50)}" for _ in range(100))
    rows = [(i, t, "en", None, 1) for i, t in [*ODD, (20, text), (21, text), (22, text + " end")]]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(7) for n in EXTRA})
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, DATA)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= 40


def test_registered(spark):
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in names if name.startswith("op") and name[2].isdigit()}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names


def test_written_tables_can_be_removed(spark):
    queries.op2_exact_dedup(spark, DATA).count()
    assert release(spark) > 0 and release(spark) == 0
