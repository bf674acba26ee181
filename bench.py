"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Graphs are placed before the clock starts, so that a number is the time of the
operator.  ``strips_g1`` and the like on the small ``sample`` graph repeat the
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lucidgraph.operators import angles, crossing, lengths, occlusion, search  # noqa: E402
from lucidgraph.operators import exact_crossing as exact  # noqa: E402
from lucidgraph.operators import layout as layouts  # noqa: E402
from lucidgraph.session import materialize  # noqa: E402
from lucidgraph.sources import edges_from_table, samples, vertices_of  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sample_edges(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_linenumber = 1")
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_orderkey % 10 = 0")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return edges_from_table(
        joined,
        F.concat(F.lit("c"), F.col("o_custkey")),
        F.concat(F.lit("s"), F.col("l_suppkey")),
    )


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "10g")
        .config("spark.sql.shuffle.partitions", str(4 * int(CPUS)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    graphs = {
        "sample": sample_edges(spark, FOLDER),
        "trade": samples.trade_edges(spark, FOLDER),
        "purchases": samples.purchase_edges(spark, FOLDER),
        "geography": samples.geography_edges(spark, FOLDER),
    }
    edges = {name: materialize(df) for name, df in graphs.items()}
    vertices = {name: materialize(vertices_of(df)) for name, df in edges.items()}
    placed = {
        name: materialize(layouts.random_layout(df, 100.0)) for name, df in vertices.items()
    }

    def on(graph, operator, **options):
        return lambda: operator(placed[graph], edges[graph], **options)

    def trials(count, first=0):
        ids = spark.range(first, first + count).select(F.col("id").alias("trial"))
        return search.evaluate_trials(
            vertices["sample"], edges["sample"], search.trial_candidates(ids), iterations=1, g=1.0
        )

    queries = {
        "sample_occlusion_cells": lambda: occlusion.node_occlusion_grid(placed["sample"], 1.0),
        "sample_occlusion_pairs": lambda: occlusion.node_occlusion(placed["sample"], 1.0),
        "sample_strips_g1": on("sample", crossing.edge_crossing_strips, g=1.0),
        "sample_strips_g1_bitwise": on("sample", crossing.edge_crossing_strips, g=1.0, plan="bitwise"),
        "sample_angle_g1": on("sample", crossing.edge_crossing_angle),
        "sample_exact_crossing": on("sample", exact.edge_crossing_exact),
        "trials_1": lambda: trials(1),
        "trials_8": lambda: trials(8),
        "occlusion_cells": lambda: occlusion.node_occlusion_grid(placed["purchases"], 1.0),
        "occlusion_pairs": lambda: occlusion.node_occlusion(placed["purchases"], 1.0),
        "disc_cells": lambda: occlusion.disc_cells(placed["purchases"], 1.0),
        "strips_g1": on("trade", crossing.edge_crossing_strips, g=1.0),
        "angle_g1": on("trade", crossing.edge_crossing_angle),
        "minimum_angle": on("trade", angles.minimum_angle),
        "edge_length_variation": on("trade", lengths.edge_length_variation),
        "exact_crossing_geography": on("geography", exact.edge_crossing_exact),
        "exact_crossing_trade": on("trade", exact.edge_crossing_exact, proper=True),
        "repulsion_purchases": lambda: layouts.repulsive_forces(placed["purchases"], 3.0),
        "layout_step": lambda: layouts.layout_step(placed["geography"], edges["geography"], 3.0, 100.0),
    }
    only = sys.argv[1:]
    seconds = {}
    queries["sample_angle_g1"]().collect()  # starts the Python workers
    for name, build in queries.items():
        if only and name not in only:
            continue
        begin = time.monotonic()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(FOLDER).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
