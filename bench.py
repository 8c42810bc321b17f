"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gridloom.catalog import REGISTERED
from gridloom.session import local_session

HEADLINES = (
    "list_page", "list_desc_nulls", "search", "search_count", "restricted_delete",
    "customers_page", "written_import", "link_facts", "derive_entity", "row_failures",
    "profile_lineitem", "profile_orders", "samples", "overlaps", "normalize_distinct",
    "clean_number", "clean_date", "clean_integer", "infer_types", "batch_patch",
    "grid_to_rows", "workbook_cells",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    # A first run of each query compiles it; the second is what is measured.
    seconds = {}
    for name in HEADLINES:
        query, _ = REGISTERED[name]
        for _ in range(2):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
