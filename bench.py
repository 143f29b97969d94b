"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from knotwork.plans import catalog
from knotwork.plans.embedding_queries import graph_triples
from knotwork.operators import kge
from knotwork.session import cut, local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "entity_triples",
    "literal_thresholds",
    "measurement_expand",
    "bgp_match",
    "topk_per_cluster",
    "sparql_feature_category",
    "feature_matrix",
    "assemble_features",
    "roc_auc",
    "stratified_split",
    "split_triples",
    "encode_triples",
    "knn_graph",
    "silhouette",
    "rank_metrics",
    "label_propagation",
    "connected_components",
    "clf_logistic",
]


def main() -> None:
    spark = local_session(CORES)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        catalog.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    coded = cut(kge.encode_triples(graph_triples(spark, FOLDER))[2])
    for model in ("transe", "rotate", "complex"):
        start = time.perf_counter()
        kge.train_kge(coded, model, epochs=5)
        times[f"train_{model}_5_epochs"] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": FOLDER.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
