"""Times the early-rally study on as many stocks and years as a published run of it: 518 symbols of 2,500 made-up bars. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def main(symbols: int = 518, days: int = 2500) -> None:
    from pyspark.sql import SparkSession

    from barloom.operators import events as E
    from barloom.operators import stats as S
    from barloom.sources import bars as B
    from barloom.sources import synthetic as Y

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", 4 * int(cpus))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = os.path.join(os.environ.get("BENCH_TMP", "/tmp"), f"barloom-bars-{symbols}-{days}-{os.getpid()}")
    Y.random_walk(spark, symbols, days, start="2014-01-01").write.mode("overwrite").parquet(path)
    bars = spark.read.parquet(path)
    began = time.perf_counter()
    events = E.rally_events(bars, B.benchmark(bars), E.WINDOW_RULES, [5, 10, 20])
    rows = S.verdicts(S.by_period(E.narrow(events, [5, 10, 20], ["rule", "symbol", "date", "year"]), ["rule"], "2018-01-01")).collect()
    took = time.perf_counter() - began
    print(json.dumps({"metric": "early_rally_study", "value": round(took, 3), "unit": "sec", "symbols": symbols, "bars": symbols * days, "rules": len(rows), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
