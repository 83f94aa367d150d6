"""Times the headline queries once warmed up; prints one JSON line."""

import json
import os
import time

from pyspark.sql import functions as F

from trendloom.catalog import QUERIES
from trendloom.session import build_session
from trendloom.sources.fixtures import table

HEADLINE = "topic_year_shares backtest_eval sensitivity_sweep popularity title_ngram_cube merge_keep_first heatmap_top15 canonical_counts".split()


def control(spark, d):
    """The same work in every round, by which machines can be compared; not part of the total."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in ["control", *HEADLINE]:
        run = control if name == "control" else QUERIES[name]
        runs = []
        for _ in range(3):
            t = time.perf_counter()
            run(spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(sorted(runs[1:])[0], 3)
    control_time = times.pop("control")
    print(json.dumps({"metric": "total seconds of the headline queries, best of two after one warm-up", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "control": control_time, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
