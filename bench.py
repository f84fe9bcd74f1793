"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES (comma
separated) narrows the list. Results are written to a no-op sink, so every row
is computed and none is collected. Cached tables are dropped between queries.
"""

from __future__ import annotations

import json
import os
import time

from reviewminer.plans.queries import QUERIES
from reviewminer.session import local_session

HEADLINE = (
    "tagged_words", "word_counts", "tfidf", "ngrams_adj_noun", "clusters_exact", "feature_report",
    "modifier_weights_min1", "similar_pairs", "components", "clusters_similarity", "clusters_allpairs",
    "filter_similar", "vocabulary", "word2vec_vectors", "bow_regression",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["ngrams_adj_noun"](spark, sf_dir).count()  # start the JVM's compilers and the file listing
    seconds: dict[str, float] = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        spark.catalog.clearCache()
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "review_mining_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
