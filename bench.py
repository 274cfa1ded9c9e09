"""Headline queries, timed: one JSON line for the driver.

BENCH_SF_DIR: the tables; BENCH_CPUS: local threads. Every query runs whole into
a sink that takes all rows and keeps none; one warm-up run, then the median of
BENCH_RUNS (3). ns_per_record has, for the line formats, the time per line, with
planning and compiling; ns_per_further_record has it without: the difference
between these tables and those of a tenth of their size, if they lie beside them.
"""

import json
import os
import statistics
import sys
import time

from lumenloom.plans import registry
from lumenloom.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
LINES = [
    "shape_klog", "shape_nginx", "shape_redis", "shape_postgres", "shape_sentry", "shape_logrus", "shape_uvicorn", "shape_cisco", "shape_syslog", "shape_cloudtrail", "shape_calico", "shape_clickhouse", "shape_collector", "shape_coredns", "shape_cron",
    "shape_gcpjson", "shape_gocd", "shape_influx", "shape_k8s", "shape_kaudit", "shape_litellm", "shape_lldpd", "shape_logfmt", "shape_mongod", "shape_mosquitto", "shape_oauth2proxy", "shape_pino", "shape_rabbitmq", "shape_smartd", "shape_ssmagent",
    "shape_stallcheck", "shape_tracing", "parse_k8sevent", "parse_tightvnc", "journald",
]
HEADLINE = ["windowhist_rate", "windowhist_histogram", "windowhist_last", "flow_table", "drop_summary", "recombined", "map_points", "sum_processes", "asset_lookup", "shape_all", *LINES]
SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}


def timed(spark, name: str, sf: str, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return statistics.median(times[1:])


def main(names: list[str]) -> None:
    spark = session(f"local[{CPUS}]", int(CPUS), spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    took = {name: round(timed(spark, name, SF, RUNS), 4) for name in names}
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")), "records": n}
    out["ns_per_record"] = {k: round(v / n * 1e9) for k, v in took.items() if k in LINES}
    base, _, own = SF.rstrip("/").rpartition("/")
    small = f"{base}/{SMALLER.get(own)}"
    if os.path.isdir(small):
        fewer = spark.read.parquet(f"{small}/events.parquet").count()
        out["ns_per_further_record"] = {k: round(max(0.0, took[k] - timed(spark, k, small, 1)) / (n - fewer) * 1e9) for k in took if k in LINES}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
