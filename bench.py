"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  Each query runs once
to warm up and then twice; the faster run counts.  Rows are fetched, so nothing
is left out by the optimizer.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallyfield.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["dd_auto_periodic", "ddrppi_auto", "ddsmu_auto", "wp_box", "xi_box", "ddrppi_mocks", "ddsmu_mocks", "ddtheta_mocks", "vpf_box", "landy_szalay"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name in HEADLINE:
        runs = []
        for i in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).collect()
            if i:
                runs.append(time.perf_counter() - began)
        taken[name] = round(min(runs), 3)
    spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": sf}))


if __name__ == "__main__":
    main()
