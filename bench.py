"""Time the three study stages and single operators; prints one JSON line.

The two input tables are derived and stored first, outside the clock, as the
stages read stored Parquet. The stages then run once untimed, to load classes
and compile code, and once more from the start with the clock on; nothing is
cached between the two passes.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from judgelens.operators import audits, bootstrap, joins, provenance, review, slices, splits  # noqa: E402
from judgelens.operators import classification as C  # noqa: E402
from judgelens.operators.features import lexical_features  # noqa: E402
from judgelens.plans import study  # noqa: E402
from judgelens.plans.prepare import prepare  # noqa: E402
from judgelens.sources import tables  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="judgelens-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("judgelens-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{work}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    fx.pairs(spark, sf_dir).write.parquet(f"{work}/pairs")
    fx.products(spark, sf_dir).write.parquet(f"{work}/products")
    pairs, products = tables.read_pairs(spark, f"{work}/pairs"), tables.read_products(spark, f"{work}/products")
    in_scope, items = joins.scope_pairs(pairs, fx.LOCALE), joins.scope_products(products, fx.LOCALE)
    joined = joins.attach_products(in_scope, items)
    root = f"{work}/study"
    seconds = {}

    def clock(name, action):
        start = time.monotonic()
        result = action()
        seconds[name] = round(time.monotonic() - start, 3)
        return result

    def rows(df):
        """Run a plan in full without moving its rows."""
        df.write.format("noop").mode("overwrite").save()

    def evaluate(folder):
        for frame in study.evaluate(spark, folder).values():
            frame.collect()

    # One untimed pass over the same tables loads classes and compiles code.
    prepare(spark, pairs, products, fx.LOCALE, f"{work}/warm-up/features", reports=f"{work}/warm-up/reports")
    study.train(spark, f"{work}/warm-up").collect()
    evaluate(f"{work}/warm-up")

    saved = clock("prepare", lambda: prepare(spark, pairs, products, fx.LOCALE, f"{root}/features", reports=f"{root}/reports"))
    clock("train", lambda: study.train(spark, root).collect())
    clock("evaluate", lambda: evaluate(root))
    stages = sum(seconds.values())

    scored = tables.read_scored(spark, f"{root}/scored/test")
    clock("lexical_features", lambda: rows(lexical_features(joined)))
    clock("assign_splits", lambda: rows(splits.assign_splits(in_scope)))
    clock("pair_product_join", lambda: rows(joined))
    clock("data_audit", lambda: audits.data_audit(in_scope, items, joined, splits.staged_profile(in_scope)).collect())
    clock("label_balance", lambda: audits.label_balance(in_scope).collect())
    clock("candidate_set_sizes", lambda: audits.candidate_set_sizes(in_scope).collect())
    clock("split_summary", lambda: splits.split_summary(saved).collect())
    clock("query_digest", lambda: provenance.query_digest(saved).collect())
    clock("per_class_metrics", lambda: C.per_class_metrics(scored).collect())
    clock("review_metrics", lambda: review.review_metrics(review.review_queue(scored)).collect())
    clock("slice_metrics", lambda: slices.slice_metrics(scored).collect())
    clock("bootstrap_intervals", lambda: bootstrap.bootstrap_intervals(scored).collect())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "prepare + train + evaluate, wall seconds after one untimed pass",
                "value": round(stages, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
