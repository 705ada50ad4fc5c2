"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs to a count of its rows' hash, so that all columns are computed, once to warm up and then twice; the
its build apart.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "fts_bm25_topk", "fts_two_field", "fts_phrase", "fts_boolean_must_not", "fts_source_filter", "vector_topk", "hybrid_rrf", "substring_count", "substring_hits", "chunk_documents", "chunk_stats",
    "link_entities", "entity_cooccurrence", "entity_card", "fact_lookup", "graph_two_hop", "update_diff", "upsert_merge", "content_hash_dupes", "storage_rollup", "gap_segments", "stream_sessions", "strip_html",
)


def main() -> None:
    cpus, sf_dir = int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from almanac.operators import fts
    from almanac.plans import everything
    from almanac.session import build_session, table

    spark = build_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    def run(query) -> float:
        began = time.perf_counter()
        df = query(spark, sf_dir)
        df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).collect()
        return time.perf_counter() - began

    plans, seconds = everything(), {}
    with tempfile.TemporaryDirectory() as folder:
        began = time.perf_counter()
        fts.build_index(table(spark, sf_dir, "documents"), folder)
        built = time.perf_counter() - began
        timed = {name: plans[name][0] for name in HEADLINE} | {"fts_indexed_topk": lambda s, d: fts.search_index(s, folder, "aiai aian the")}
        for name, query in timed.items():
            run(query)
            seconds[name] = round(min(run(query) for _ in range(2)), 4)
    n = table(spark, sf_dir, "documents").count()
    rates = {"index_documents_per_sec": round(n / built), "chunk_documents_per_sec": round(n / seconds["chunk_documents"])}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "fts_index_build_sec": round(built, 3), "rates": rates, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
