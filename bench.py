"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

The queries run in one new session, in which an index is built once, as it is meant to be: what is marked `once` is written by the
first query that needs it, whose figure holds that work, and read by those after it. With $BENCH_ALONE set each query makes all it
needs anew. `value` sums the genotyping queries, as in earlier rounds; the text operators, where installed, are in `text`.
"""

from __future__ import annotations

import json
import os
import re
import time

from allelith.plans.registry import R
from allelith.session import session

HEADLINE = (
    "kmer_count", "approx_kmer_counter", "window_kmers", "signature_select", "kmer_index_build", "node_counts", "genotype_loglik_naive", "haplotype_to_path", "count_model_hist",
    "best_helper", "genotype_posterior_helper", "interval_merge_pad", "covered_by_sv", "overlapping_indels", "overlap_depth", "genotype_accuracy", "multiallelic_resolve",
)
#: Text operators are begun until so many seconds have gone by in all.
MOST_SECONDS = float(os.environ.get("BENCH_TEXT_UNTIL", "360"))


def text_queries() -> dict:
    try:
        from allelith.llm.queries import QUERIES
    except ImportError:
        return {}
    return QUERIES


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    began = time.time()
    spark = session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = R.queries(share=not os.environ.get("BENCH_ALONE"))
    queries["genotype_accuracy"](spark, sf_dir).collect()  # the first query also starts the session's code

    def timed(query) -> float:
        start = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    took = {name: timed(queries[name]) for name in HEADLINE}
    text = {name: timed(query) for name, query in text_queries().items() if time.time() - began < MOST_SECONDS}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "text": text, "sf": float(found[1]) if found else None}))


if __name__ == "__main__":
    main()
