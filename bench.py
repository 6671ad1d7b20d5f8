"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

    BENCH_QUERIES=all|name,name,...   choose other queries
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "dq_unique_counts", "dq_missing", "dq_duplicate_rows", "clean_drop_unique", "clean_merge_dups_mode", "clean_impute_median", "clean_pipeline",
    "sample_random", "sample_stratified", "cv_stratified_folds", "cv_quantile_folds", "ua_value_counts", "ua_descriptive", "ua_quantiles", "ua_box_stats", "ua_kde",
    "ba_pearson", "ba_spearman", "ba_kendall", "ba_sample_means", "ba_chi_square", "fe_math", "fe_one_hot", "fe_pipeline_replay",
    "metric_f1", "metric_roc_auc_ovr", "metric_avg_precision_ovr", "metric_medae", "eval_category_metrics", "pred_soft_ensemble", "pred_wide", "ex_easy_difficult",
    "ml_logistic", "ml_lda", "ml_bernoulli_nb", "ml_decision_tree", "ml_random_forest", "ml_ols", "ml_ridge", "ml_lasso", "ml_elastic_net", "ml_knn_classify",
    "ex_partial_dependence", "ex_tree_shap",
]


def main() -> None:
    from colonnade.catalog import QUERIES, load_all
    from colonnade.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    load_all()
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/region.parquet").count()  # start-up is not part of any query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
