"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the no-op sink in full. One untimed run warms the JVM up, then the median
of three is reported. Line and path rates are work done by a query over its time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linecensus.operators import lines as lines_op  # noqa: E402
from linecensus.operators import stats  # noqa: E402
from linecensus.operators.detect import detect_language  # noqa: E402
from linecensus.plans.analyze import analyze_tree  # noqa: E402
from linecensus.plans.queries import queries  # noqa: E402
from linecensus.session import posix_path, scratch_path  # noqa: E402
from linecensus.sinks.tree_files import write_tree  # noqa: E402
from linecensus.sources import tables  # noqa: E402

HEADLINE = (
    "detect_language_counts", "fast_stats", "file_stats", "language_stats", "grand_total_rollup",
    "classify_lines_corpus", "language_stats_html", "ignore_rules", "exclude_globs",
    "cache_probe", "cache_upsert", "report_json",
)
RUNS = 3


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def tree_runs(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """A first run over a file tree, and a re-run after 1 % of its files changed."""
    root, cache = posix_path(scratch_path(spark, "bench")), scratch_path(spark, "bench-cache")
    write_tree(tables.corpus(spark, sf_dir), root)
    changed = tables.corpus(spark, sf_dir).filter("hash(path) % 100 = 0")

    def run():
        analyze_tree(spark, root, cache_dir=cache).languages.collect()

    times = {"tree_first_run": timed(run)}
    write_tree(changed.selectExpr("path", "concat(content, '\\nx\\n') AS content"), root)
    times["tree_rerun_1pct_changed"] = timed(run)
    return times


# The tables are small next to the fixed cost of a Spark job, so the line rate is also taken on this
# many copies of the corpus, with its sentences on lines of their own (about 80 bytes per line).
COPIES = 20


def sustained(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Lines per second of two operators over a larger corpus, written once."""
    path = scratch_path(spark, "bench-corpus")
    (
        tables.corpus(spark, sf_dir)
        .withColumn("content", F.regexp_replace("content", r"\. ", ".\n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
        .select(F.concat("copy", F.lit("/"), "path").alias("path"), "content",
                F.octet_length("content").cast("bigint").alias("size"))
        .write.parquet(path)
    )
    files = detect_language(spark.read.parquet(path))
    lines = lines_op.fast_stats(files).agg(F.sum("lines")).first()[0]
    rates = {"lines": lines}
    for name in ("fast_stats", "file_stats"):

        def run(operator=getattr(lines_op, name)):
            # Built anew each time: collecting one DataFrame again reuses its finished stages.
            counted = detect_language(spark.read.parquet(path))
            stats.language_stats(operator(counted)).collect()

        run()
        median = statistics.median(timed(run) for _ in range(RUNS))
        rates[f"{name}_lines_per_sec"] = round(lines / median)
    return rates


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linecensus-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="linecensus-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def run(name):
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = statistics.median(timed(lambda: run(name)) for _ in range(RUNS))
    totals = registered["language_stats"](spark, sf_dir).selectExpr("sum(lines)", "sum(bytes)").first()
    paths = tables.event_paths(spark, sf_dir).count()
    times.update(tree_runs(spark, sf_dir))
    rates = sustained(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "lines": totals[0],
                "lines_per_sec": {
                    name: round(totals[0] / times[name])
                    for name in ("fast_stats", "file_stats", "language_stats", "classify_lines_corpus")
                },
                "sustained": rates,
                "paths_per_sec": round(paths / times["detect_language_counts"]),
                "bytes_per_sec": round(totals[1] / times["language_stats"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
