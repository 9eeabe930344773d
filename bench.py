"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridlens import queries as explorer
from gridlens.session import session

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["f_in", "f_multi_and", "f_contains", "f_text_date_month", "p_extract", "o_page", "o_topk", "a_count", "a_values", "a_values_year", "a_stats", "g_rows", "g_rows_cols", "g_three_levels", "g_wide_key", "g_windowed", "g_count_distinct", "g_median", "g_mixed", "s_open"]


def main() -> None:
    spark = session(f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds, all_queries = {}, explorer.queries()
    for name in HEADLINE:
        best = []
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            all_queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        seconds[name] = round(min(best), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
