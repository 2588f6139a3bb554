"""Headline timings: prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)

The visit cohort is built and written once (timed as cohort_build); the other queries read it and report
the median of three runs after a warm-up. `rows_per_second` is the calculate_all rate, the one figure the
single-process tool this is measured against prints for its own batch run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

import numpy as np

# Python workers import the package too, from wherever this is started.
ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

from glucoframe.operators.calculate import calculate_long, calculate_wide, to_long
from glucoframe.operators.catalog import INDEX_IDS
from glucoframe.operators import correlation, density, descriptives, tally, transforms
from glucoframe.operators.transforms import Transform
from glucoframe.operators.weight import cohort_weight
from glucoframe.plans.registry import flagship
from glucoframe.plans.source import PreparedSource, Source
from glucoframe.session import discard_scratch, local_session
from glucoframe.sources.results import write_csv

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def machine_speed() -> float:
    """Seconds of a fixed piece of work on one core, so that rounds on slower machines can be compared."""
    numbers = np.random.default_rng(1).random(2_000_000)
    taken = []
    for _ in range(3):
        started = time.perf_counter()
        for _ in range(3):
            np.sort(numbers)
            sum(k * k for k in range(300_000))
        taken.append(time.perf_counter() - started)
    return min(taken)


def main() -> None:
    probe = machine_speed()
    spark = local_session(CPUS, "bench", spark__sql__shuffle__partitions=CPUS)
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cohort_path = f"{scratch}/cohort.parquet"

    started = time.perf_counter()
    Source(spark, FOLDER).cohort().repartition(int(CPUS)).write.parquet(cohort_path)
    timings = {"cohort_build": time.perf_counter() - started}

    src = PreparedSource(spark, FOLDER, cohort_path)
    rows = src.cohort().count()
    values_path = f"{scratch}/values.parquet"
    calculate_wide(src.cohort(), keep=["visit_id", "sex"]).write.parquet(values_path)
    values = spark.read.parquet(values_path)
    some = ["homa_ir", "quicki", "matsuda_3pt", "tg_hdl", "lap", "glucagon_auc", "mcauley", "stumvoll_mod"]

    def long(ids):
        return to_long(values, ids, ["visit_id", "sex"])

    written = iter(range(1000))
    work = {
        "calculate_all": lambda: consume(calculate_wide(src.cohort(), keep=["visit_id"], status_columns=True)),
        # as the other tool's batch run: cohort weight, inverse orientation, status columns, CSV written
        "calculate_to_csv": lambda: write_csv(
            calculate_wide(
                src.cohort(), keep=["visit_id"], status_columns=True, orientation="sensitivity",
                weight=cohort_weight(src.cohort()),
            ),
            f"{scratch}/results-{next(written)}.csv",
        ),
        "cohort_weight": lambda: cohort_weight(src.cohort()),
        "status_counts": lambda: consume(
            tally.status_counts(tally.status_long(calculate_wide(src.cohort(), keep=[], status_columns=True)))
        ),
        "top_reasons": lambda: consume(
            tally.top_reasons(tally.reason_counts(src.cohort()))
        ),
        "index_means_by_sex": lambda: consume(flagship(src)),
        "describe_all": lambda: consume(descriptives.describe(long(INDEX_IDS), rows)),
        "z_by_sex_all": lambda: consume(transforms.transform_results(values, Transform("z", "sex"), key="visit_id")),
        "rint_by_sex_all": lambda: consume(
            transforms.transform_results(values, Transform("rint", "sex"), key="visit_id")
        ),
        "pearson_matrix_all": lambda: consume(correlation.pearson_matrix(values, INDEX_IDS)),
        "spearman_matrix_8": lambda: consume(correlation.spearman_matrix(values, some)),
        "spearman_matrix_all": lambda: consume(correlation.spearman_matrix(values, INDEX_IDS)),
        "density_by_sex_8": lambda: consume(density.group_densities(long(some))),
        "histogram_by_sex_8": lambda: consume(density.histogram_by_sex(long(some), least=10, most=60)),
    }
    for name, run in work.items():
        run()
        taken = []
        for _ in range(3):
            started = time.perf_counter()
            run()
            taken.append(time.perf_counter() - started)
        timings[name] = statistics.median(taken)
    discard_scratch(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in timings.items()}, "sf": os.path.basename(FOLDER.rstrip("/")),
        "visits": rows, "rows_per_second": round(rows / timings["calculate_all"]), "cpus": int(CPUS),
        "probe_seconds": round(probe, 3),
    }))


if __name__ == "__main__":
    main()
