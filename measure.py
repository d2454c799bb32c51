"""

python measure.py [rows a client] [clients] [features] [rounds] [compressor,...]; the defaults have the shape of the w8a workload.
"""

import json
import os
import resource
import sys
import time

from pyspark.sql import SparkSession


def main() -> None:
    from newtonmill.plans.training import TrainConfig, train
    from newtonmill.scratch import save
    from newtonmill.sources.synthetic import federated

    rows, clients, d, rounds = (int(sys.argv[k]) if len(sys.argv) > k else v for k, v in ((1, 350), (2, 142), (3, 301), (4, 40)))
    names = sys.argv[5].split(",") if len(sys.argv) > 5 else ["identical", "topk", "toplek", "randk", "seqk", "natural"]
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    made = federated(spark, clients, rows, d, seed=1, iid=True).selectExpr("client_id", "transform(features, v -> v * label) as features")
    samples = save(made.repartition(16, "client_id"))
    for name in names:
        tracker, group = spark.sparkContext.statusTracker(), f"run-{name}"
        spark.sparkContext.setJobGroup(group, name)
        began = time.time()
        result = train(samples, TrainConfig(rounds=rounds, lam=1e-3, option="b", compressor=name, k_mult=8.0, tolerance=1e-9))
        taken, done = time.time() - began, len(result.log)
        reached = result.log[-1][1] <= 1e-9
        jobs = len(tracker.getJobIdsForGroup(group))
        sent = result.log[-1][4] + result.log[-1][5]
        print(json.dumps({"compressor": name, "rows": rows * clients, "clients": clients, "d": d, "rounds": done, "seconds_a_round": round(taken / done, 3), "jobs_a_round": round(jobs / done, 2), "grad_norm": result.log[-1][1], "rounds_to_1e-9": done - 1 if reached else None, "bytes_a_client_and_round": round(sent / clients / max(1, done - 1)), "peak_python_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}), flush=True)


if __name__ == "__main__":
    main()
