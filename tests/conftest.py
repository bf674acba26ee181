import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(
    p for p in (str(ROOT), os.environ.get("PYTHONPATH")) if p
)

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        # compiling the stages of hundreds of tiny plans would take most of the time
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """edges and layout(s) from plain Python data."""

    def build(positions, pairs, trials=(0,)):
        edges = spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")
        rows = [(t, k, float(x), float(y)) for t in trials for k, (x, y) in positions.items()]
        layout = spark.createDataFrame(rows, "trial int, id string, x double, y double")
        return edges, layout

    return build


@pytest.fixture(scope="session")
def make_many(make, spark):
    """Several graphs at once: graph i is trial i and has vertices of its own."""

    def build(graphs):
        pairs = [(f"{i}.{s}", f"{i}.{d}") for i, g in enumerate(graphs) for s, d in g[1]]
        rows = [
            (i, f"{i}.{k}", float(x), float(y))
            for i, g in enumerate(graphs)
            for k, (x, y) in g[0].items()
        ]
        edges, _ = make({"unused": (0, 0)}, pairs)
        return edges, spark.createDataFrame(rows, "trial int, id string, x double, y double")

    return build


def by_trial(df):
    return [row[-1] for row in sorted(df.collect(), key=lambda r: r.trial)]


def value(df):
    """The last column of a one-row result."""
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0][-1]
