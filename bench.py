"""Time the headline queries; prints one JSON line.

Each query is planned and run into a sink that discards its rows: once to warm up, then ``BENCH_RUNS``
times, of which the best counts. With ``BENCH_DUCKDB=1`` the checking SQL is timed on DuckDB as well.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from cohortspan.operators import pheno, scores, series, views
from cohortspan.operators import queries as q
from cohortspan.plans.define import AS_OF
from cohortspan.plans.registry import oracle_sql, queries
from cohortspan.session import build_session, scratch
from cohortspan.sources.star import survey_tables
from cohortspan.tables import scan_tables, write_tables

HEADLINE = [
    "v_user_latest_measurements",
    "q01_list_users",
    "q02_user_profile",
    "q03b_bio_age_latest",
    "q05_range_comparison",
    "q06_trend",
    "q08_session_details",
    "q11_age_distribution",
    "q12_measurement_summary",
    "q035_phenotypic_age",
    "q035_hd_age",
    "q035_calculate",
    "etl_measurements",
    "upsert_measurements",
    "q04_ingest",
    "range_bands",
    "session_ordinal",
    "dq_foreign_keys",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in wanted:
        once(name)
        seconds[name] = round(min(once(name) for _ in range(runs)), 3)
    stored = stored_table_seconds(spark, folder, runs)
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "stored_tables": stored,
    }
    if os.environ.get("BENCH_DUCKDB") == "1":
        report["duckdb"] = duckdb_seconds(folder, wanted, int(cpus), runs)
    spark.stop()
    print(json.dumps(report))


def stored_table_seconds(spark, folder: str, runs: int) -> dict[str, float]:
    """Operators on the base tables themselves, once these are written, without deriving them."""
    source = scratch(spark, "bench-tables")
    start = time.perf_counter()
    write_tables(survey_tables(spark, folder), source)
    seconds = {"write_tables": round(time.perf_counter() - start, 3)}
    t = scan_tables(spark, source)
    operators = {
        "latest_measurements": lambda: views.latest_measurements(t),
        "range_comparison": lambda: q.range_comparison(t),
        "phenotypic_age": lambda: pheno.phenotypic_age(t, AS_OF),
        "hd_fit_and_age": lambda: scores.calculate(t, AS_OF, "Homeostatic Dysregulation"),
        "trend": lambda: q.trend(t, AS_OF, within="4 years"),
        "one_user": lambda: q.user_profile(t, AS_OF).where("userId = 7"),
        "session_ordinal": lambda: series.session_ordinal(t),
    }
    for name, make in operators.items():
        best = float("inf")
        for _ in range(runs + 1):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    seconds["latest_rows_per_sec"] = round(t.measurements.count() / seconds["latest_measurements"])
    return seconds


def duckdb_seconds(folder: str, names: list[str], cpus: int, runs: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = {cpus}")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    checks = oracle_sql()

    def once(sql: str) -> float:
        start = time.perf_counter()
        con.execute(sql).fetchall()
        return time.perf_counter() - start

    return {name: round(min(once(checks[name]) for _ in range(runs + 1)), 3) for name in names if name in checks}


if __name__ == "__main__":
    main()
