import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import DATA  # noqa: E402

from fleetcatalog.llm import queries  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """In place of the folder that a cluster names in spark.checkpoint.dir."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs(spark):
    return queries.read(spark, DATA, "documents")
