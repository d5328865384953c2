"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "assoc_rules",
    "frequent_itemsets_count",
    "feature_ssr",
    "covariance_matrix",
    "pca_fit",
    "knn_classify",
    "kmeans_lloyd3",
    "kmeans_fit",
    "nb_multinomial_predict",
    "nb_gaussian_predict",
    "tree_best_split_numeric",
    "tree_fit",
    "logit_gradient",
    "logit_fit",
    "lda_fit",
    "nn_forward_classes",
    "forest_subsample",
    "cv_folds",
    "rand_index",
    "bag_of_words",
]


def main() -> None:
    from quarry.plans.catalog import QUERIES
    from quarry.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
