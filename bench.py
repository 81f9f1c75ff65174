"""Wall seconds of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from sofralytics.plans import load_queries
from sofralytics.session import build_session

HEADLINE = (
    "dish_scores", "top_dishes_per_venue", "name_similarity", "fuzzy_duplicates", "sliding_client_rate",
    "dish_rank", "venue_documents", "dish_stats", "dish_mentions_exact", "review_sentiment", "language_flag",
    "nearest_venues_per_point", "review_upsert", "failure_streaks", "search_by_distance",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, app="bench")
    builders = load_queries().BUILDERS
    builders["dish_scores"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's code paths
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        builders[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
