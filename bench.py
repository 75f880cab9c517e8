"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated query names (default: the list below)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "rule_coverage", "vote_matrix", "vote_matrix_policy_phrases", "vote_matrix_stemmed", "vote_matrix_policy_stemmed",
    "lf_summary_gold", "vote_moments", "posteriors", "label_model_posteriors", "noisy_labels",
    "clean_document_paragraphs", "clean_page_paragraphs", "numbered_lines", "stemmed_vocabulary",
    "similarity_filter", "best_per_label", "positional_join", "token_features", "row_losses",
    "end_model_scores",
]


def main() -> None:
    from weakloom.plans.queries import all_queries
    from weakloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("weakloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Start the engine and load classes before the first timing.
    spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
