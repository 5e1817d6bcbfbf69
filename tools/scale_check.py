"""Scale and skew check on data multiplied from the given tables.

    python tools/scale_check.py [factor] [sf_dir]

Every document of ``sf_dir`` becomes ``factor`` catalog rows; a third of all
rows share ONE path (and a third of uploads and copy requests one catalog
id), the hot-key case the jobs must survive. Each job runs to completion
(noop sink); the Spark event log, written to a fresh scratch folder, gives
per-stage task balance: for each job, the largest share of a stage's
shuffle records that a single task read, and its task times.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cataloom.operators import images as im  # noqa: E402
from cataloom.operators import sync as sy  # noqa: E402
from cataloom.operators import transfer as tr  # noqa: E402
from cataloom.session import build_session  # noqa: E402
from cataloom.sources.fixtures import NEW_ROOT, OLD_ROOT  # noqa: E402

HOT = OLD_ROOT + "\\hot\\same.png"


def main() -> None:
    factor = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="cataloom-scale-")
    spark = build_session(master="local[8]", shuffle_partitions=64, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"), "spark.driver.memory": "16g",
        # keep all shuffle partitions, so record counts per task show the
        # hash/range balance instead of AQE merging small partitions
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # the skew split threshold scaled down with the data (default 256 MB)
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        # no broadcasts, static or adaptive: every join shows its shuffle
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    # as many map tasks as a large table has: a hot partition is split between them
    rows = rows.repartition(64).checkpoint()
    rid = (F.col("doc_id") * factor + F.col("copy"))
    path = F.when(F.col("copy") % 3 == 0, F.lit(HOT)).otherwise(
        F.concat(F.lit(OLD_ROOT + "\\"), F.col("lang"), F.lit("\\"), rid.cast("string"), F.lit(".png")))
    catalog = rows.where(rid % 11 != 5).select((rid + 1).cast("int").alias("id"), path.alias("origin_path"),
                                               F.lit("n").alias("name"), F.lit(None).cast("string").alias("target_path"))
    inventory = rows.where(rid % 10 != 3).select(path.alias("origin_path")).dropDuplicates(["origin_path"])
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    up = pages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    uid = F.col("page_id") * factor + F.col("copy")
    uploads = up.select(uid.cast("int").alias("upload_id"),
                        F.when(uid % 3 == 0, F.lit(1)).otherwise(uid % 5000 + 1).cast("int").alias("file_list_id"),
                        (uid % 9 != 4).alias("has_file"))
    images = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        (F.col("conv_id") + 1).cast("int").alias("file_list_id"), F.col("turn").cast("int").alias("sort"))
    shown = rows.select(rid.alias("id"), (rid % 5000 + 1).cast("int").alias("file_list_id"), F.lit(1).alias("sort"),
                        F.when(rid % 3 == 0, F.lit("/images/hot.png")).otherwise(F.concat(F.lit("/images/"), rid.cast("string"))).alias("image"))
    listed = shown.where("id % 4 <> 1").select("image")
    requests = rows.select(rid.cast("int").alias("req_id"),
                           F.when(rid % 3 == 0, F.lit(1)).otherwise(rid % 50000 + 1).cast("int").alias("id"))
    existing = inventory.select(F.col("origin_path").alias("path"))

    jobs = {
        "sync_stats": lambda: sy.sync_stats(catalog, inventory),
        "new_files": lambda: sy.new_files(inventory, catalog),
        "path_check": lambda: sy.path_check(catalog, inventory),
        "next_catalog_ids": lambda: sy.next_catalog(catalog, inventory, "2025-01-02 00:00:00"),
        "image_assign_hot": lambda: im.image_assign(uploads, images),
        "image_gallery_hot": lambda: im.gallery(shown, listed, "http://x"),
        "gallery_status_hot": lambda: im.gallery_status(uploads, shown, listed),
        "convert_plan_hot": lambda: tr.convert_plan(requests, catalog, existing, OLD_ROOT, NEW_ROOT),
    }
    n_catalog = catalog.count()
    timings = {}
    sc = spark.sparkContext
    for name, build in jobs.items():
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 2)
    spark.stop()
    balance = _balance(scratch)
    missing = set(jobs) - set(balance)
    if missing:
        sys.exit(f"no stage of {sorted(missing)} was measured")
    print(json.dumps({"factor": factor, "catalog_rows": n_catalog, "hot_share": "1/3", "sec": timings,
                      "balance": balance}, indent=1))


def _balance(folder: str) -> dict:
    """Per job group: the least balanced shuffle-reading stage, measured as
    the largest share of the stage's records read by one task (a hot third
    left in one task would show 0.33 or more), with its task times."""
    logs = [p for p in glob.glob(os.path.join(folder, "**", "*"), recursive=True)
            if os.path.isfile(p) and "ckpt" not in p and not os.path.basename(p).startswith(".")]
    job_group, stage_job, tasks = {}, {}, {}
    for line in open(logs[0]):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = group
        elif kind == "SparkListenerTaskEnd":
            info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
            took = info["Finish Time"] - info["Launch Time"]
            read = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            tasks.setdefault(ev["Stage ID"], []).append((took, read))
    out = {}
    for sid, ts in tasks.items():
        group = stage_job.get(sid)
        reads = [r for _, r in ts]
        total = sum(reads)
        if group is None or len(ts) < 8 or total == 0:
            continue
        share = round(max(reads) / total, 4)
        best = out.get(group)
        if best is None or share > best["max_task_share"]:
            out[group] = {"stage": sid, "tasks": len(ts), "max_task_share": share,
                          "stage_records": total, "max_records": max(reads),
                          "max_ms": max(t for t, _ in ts), "median_ms": statistics.median(t for t, _ in ts)}
    job_group.update(out)
    return job_group


if __name__ == "__main__":
    main()
