"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from dossierflow.session import local_session  # noqa: E402

# query -> table whose rows are the unit of its throughput
HEADLINE = {
    "document_wide": "documents",
    "statement_runs": "orders",
    "resume_result": "documents",
    "results_rows": "documents",
    "spans_long": "documents",
    "parse_html": "pages",
    "parse_elements": "documents",
    "categorize": "documents",
    "categorize_by_join": "documents",
    "extract_statements": "orders",
    "deidentify_statements": "orders",
    "ingest_manifest": "documents",
    "landed_content": "documents",
    "status_fold": "events",
    "status_topk": "events",
    "stage_counts": "events",
    "results_json_by_stage": "events",
    "stuck_sessions": "events",
    "stream_ingest": "documents",
}


#: tables whose rows hold texts; on a cluster they come in many row groups
WIDE = ("documents", "pages")


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - started


def dealt_out(spark, sf_dir: str, files: int) -> str:
    """A folder with the same tables, those of WIDE in several files: the given ones are a single
    row group each, which only one task can read."""
    folder = tempfile.mkdtemp(prefix="dossierflow-bench-")
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        if table in WIDE:
            spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{sf_dir}/{name}", f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    # so that small files stay tasks of their own
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}
    many = dealt_out(spark, sf_dir, cpus)
    seconds, single, rate = {}, {}, {}
    for name, table in HEADLINE.items():
        # the first run loads and compiles, the second is the query
        timed(spark, name, many)
        seconds[name] = round(timed(spark, name, many), 3)
        if table in WIDE:
            single[name] = round(timed(spark, name, sf_dir), 3)
        rate[name] = round(rows[table] / seconds[name], 1)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rate, "one_row_group": single,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
