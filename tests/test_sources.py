import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lucidgraph.functions.geometry import segments_intersect
from lucidgraph.operators.layout import force_layouts, random_layout
from lucidgraph.operators.messages import aggregate_messages, dangling_edges
from lucidgraph.operators.progress import trial_progress
from lucidgraph.operators.search import best_trial, composite_score, evaluate_trials, sweep
from lucidgraph.sources import (
    TRIALS,
    edges_from_table,
    read_edge_list,
    read_layout,
    read_trials,
    vertices_of,
    write_layout,
    write_trials,
)
from lucidgraph.streaming import stream_trials


def test_edge_list(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("0 14\n\n  2\t10  weight\nlonely\n7   16\n")
    edges = read_edge_list(spark, str(tmp_path / "edges.txt"))
    assert sorted(map(tuple, edges.collect())) == [("0", "14"), ("2", "10"), ("7", "16")]
    assert {r.id for r in vertices_of(edges).collect()} == {"0", "14", "2", "10", "7", "16"}


def test_edges_from_table(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 3)], "a int, b int")
    assert list(map(tuple, edges_from_table(df, "a", "b").collect())) == [("1", "2")]


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_layout_roundtrip(spark, make, tmp_path, format):
    _, layout = make({"a": (0.1, 2), "b": (-3, 1e-9)}, [], trials=(0, 4))
    path = str(tmp_path / "layout")
    write_layout(layout, path, format)
    assert sorted(read_layout(spark, path, format).collect()) == sorted(layout.collect())
    with pytest.raises(AnalysisException):
        write_layout(layout, path, format)


def test_trials_append_and_missing_history(spark, tmp_path):
    path = str(tmp_path / "trials")
    assert read_trials(spark, path).collect() == []
    for trial in (1, 0):
        row = (trial, 1.5, 2.0, 3, 0.1, 4, 0.2, 1.0 / (trial + 1))
        write_trials(spark.createDataFrame([row], TRIALS), path)
    assert sorted(r.trial for r in read_trials(spark, path).collect()) == [0, 1]
    assert best_trial(read_trials(spark, path)).head().trial == 1


def test_stream_follows_the_history(spark, tmp_path):
    path, name = str(tmp_path / "trials"), "followed"
    scores = [None, 0.9, 0.2, 0.2, 1.4]
    for trial, score in enumerate(scores):
        write_trials(spark.createDataFrame([(trial, 1.0, 1.0, 1, 0.0, 1, 0.0, score)], TRIALS), path)
    query = (
        stream_trials(spark, path, files_per_trigger=1)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert tuple(spark.table(name).head()) == (5, 0.2, 2)


def test_random_layout_ignores_partitioning(spark):
    ids = spark.range(200).select(F.col("id").cast("string").alias("id"))
    layouts = [sorted(random_layout(ids.repartition(n)).collect()) for n in (1, 7)]
    assert layouts[0] == layouts[1]


def test_aggregate_messages(spark):
    vertices = spark.createDataFrame([("a", 1), ("b", 2), ("c", 5), ("x", 9)], "id string, n int")
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    out = aggregate_messages(
        vertices, edges, [F.sum("msg").alias("n")], to_src=F.col("dst_n"), to_dst=F.col("src_n")
    )
    assert {r.id: r.n for r in out.collect()} == {"a": 7, "b": 1, "c": 1}


def test_dangling_edges(make):
    edges, layout = make({"a": (0, 0), "b": (1, 1)}, [("a", "b"), ("a", "z"), ("y", "b")])
    assert {tuple(r) for r in dangling_edges(edges, layout).collect()} == {("a", "z"), ("y", "b")}


@pytest.mark.parametrize(
    "segments, touching, proper",
    [
        ((0, 0, 2, 2, 0, 2, 2, 0), True, True),
        ((0, 0, 1, 1, 1, 1, 2, 0), True, False),
        ((0, 0, 4, 0, 1, 0, 2, 0), True, False),
        ((0, 0, 1, 0, 2, 0, 3, 0), False, False),
        ((0, 0, 2, 0, 1, 0, 1, 5), True, False),
        ((0, 0, 2, 0, 3, -1, 3, 1), False, False),
        ((1, 1, 1, 1, 0, 0, 2, 2), True, False),
    ],
)
def test_segments_intersect(spark, segments, touching, proper):
    names = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
    df = spark.createDataFrame([tuple(map(float, segments))], names)
    ends = [(F.col(names[i]), F.col(names[i + 1])) for i in range(0, 8, 2)]
    row = df.select(
        segments_intersect(*ends).alias("touching"),
        segments_intersect(*ends, proper=True).alias("proper"),
    ).head()
    assert (row.touching, row.proper) == (touching, proper)


def test_composite_score(spark):
    df = spark.createDataFrame([(30, 5, 10, 10), (3, 5, 0, 10)], "nc int, ec int, nc0 int, ec0 int")
    columns = [F.col(c) for c in df.columns]
    plain = [r[0] for r in df.select(composite_score(*columns)).collect()]
    capped = [r[0] for r in df.select(composite_score(*columns, capped=True)).collect()]
    assert plain == [3.5, None] and capped == [1.5, None]


def test_trials_in_one_job_equal_trials_alone(spark, make):
    positions = {str(i): (0, 0) for i in range(12)}
    edges, _ = make(positions, [(str(i), str((i * 5 + 1) % 12)) for i in range(12)])
    vertices = vertices_of(edges)
    together = force_layouts(vertices, edges, [(0, 10.0, 50.0), (1, 3.0, 1.0)], 2)
    alone = force_layouts(vertices, edges, [(1, 3.0, 1.0)], 2)
    a = {r.id: (r.x, r.y) for r in together.where("trial = 1").collect()}
    b = {r.id: (r.x, r.y) for r in alone.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)

    trials = spark.createDataFrame([(0, 10.0, 50.0), (1, 3.0, 1.0)], "trial int, c double, t double")
    rows = evaluate_trials(vertices, edges, trials, iterations=2, g=1.0).collect()
    assert [f.name for f in TRIALS] == rows[0].__fields__ and len(rows) == 2


def test_sweep_narrows_down(spark, make):
    edges, _ = make({}, [(str(i), str((i * 7 + 3) % 20)) for i in range(20)])
    history = sweep(vertices_of(edges), edges, rounds=2, per_round=3, keep=2, iterations=1, g=1.0)
    rows = history.collect()
    assert sorted(r.trial for r in rows) == list(range(6))
    assert all(1.0 <= r.c <= 20.0 and 0.1 <= r.t <= 100.0 for r in rows)


def test_trial_progress(spark):
    lines = [
        "##NewIteration:6##",
        "##LayoutGen##:  90%|...",
        "##NewIteration:7##",
        "itr",
        "##LayoutGen##:  30%|...",
        "##LayoutGen##:  40%|... 4/10 [00:02<00:03]",
    ]
    def at(n):
        log = spark.createDataFrame(list(enumerate(lines[:n])), "line_no long, line string")
        return tuple(trial_progress(log).head())

    assert at(6) == (7, "layout", 14, 40)
    assert at(3) == (7, "preparing", 14, None)
    lines.append("##ComputeEdgeCrossing##")
    assert at(7) == (7, "edge crossing", 14, 40)
