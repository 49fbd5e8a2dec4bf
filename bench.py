"""Time the headline queries: prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) has the tables; BENCH_CPUS (default 8) is the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from importlib.util import find_spec

from tessella import plans
from tessella.session import local_session

HEADLINE = (
    "trials_eer", "trial_scores", "cavg_closed", "adaptive_score_norm", "cross_score_norm", "map_at_10", "lda_fusion", "plda_scores", "centred_unit_vectors",
    "filter_semi", "filter_length_and_members", "interval_overlap", "score_matrix", "sample_per_group", "every_kth_row", "group_to_list", "weighted_percentile",
    "label_runs", "sliding_vote", "mean_normalised", "uniform_subsegments", "connected_components", "combined_short", "term_counts", "tfidf_raw", "document_similarity",
    "word_errors", "sequential_chunks", "dynamic_batches", "user_sessions", "as_of_join", "table_checks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    found = dict(plans.QUERIES)
    names = list(HEADLINE)
    if find_spec("tessella.llm"):
        from tessella.llm import queries as llm

        found |= llm.QUERIES
        names += list(llm.QUERIES)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        began = time.time()
        try:
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
        except Exception as e:  # a query that fails is reported, the others still count
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            times[name] = None
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(t for t in times.values() if t), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
