from __future__ import annotations

import contextlib
import io
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("themeweave-tests")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from themeweave.runtime import ship_package

    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_docs(spark):
    """The smallest corpus as plain rows, in document order."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [(r.doc_id, r.text, r.lang) for r in table.orderBy("doc_id").collect()]
