"""Task state from event logs: the lifecycle as a batch fold and as a stateful stream, expiry, running totals, fallback."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.plans.lineage import ensure_checkpoint_dir

TERMINAL = ("completed", "error", "cancelled")
STATE = "task_id long, state string, progress double, seq long, updated_at timestamp_ntz"


def lifecycle(events: DataFrame) -> DataFrame:
    """(task_id, state, progress, seq, updated_at) from (task_id, seq, ts, kind, progress).

    The first terminal event settles a task and later ones change nothing; its progress is then 100 when completed,
    0 otherwise. Two aggregates per task, combined before the shuffle, so a hot task is no hot row group.
    """
    end = F.col("kind").isin(*TERMINAL)
    picked = F.struct("seq", "kind", "progress", "ts")
    per = events.groupBy("task_id").agg(F.min(F.when(end, picked)).alias("t"), F.max(F.when(~end, picked)).alias("l"))
    e = F.coalesce("t", "l")
    progress = F.when(F.col("t").isNull(), e["progress"]).when(F.col("t.kind") == "completed", 100.0).otherwise(0.0)
    return per.select("task_id", e["kind"].alias("state"), progress.alias("progress"), e["seq"].alias("seq"), e["ts"].alias("updated_at"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else ("", 0.0, -1, 0)
    for rows in batches:
        for r in rows.sort_values("seq").itertuples():
            if held[0] in TERMINAL and held[2] <= r.seq:
                break
            if r.kind in TERMINAL:
                held = (r.kind, 100.0 if r.kind == "completed" else 0.0, int(r.seq), int(r.micros))
            elif held[0] not in TERMINAL and r.seq > held[2]:
                held = (r.kind, float(r.progress), int(r.seq), int(r.micros))
    state.update(held)
    yield pd.DataFrame({"task_id": [key[0]], "state": [held[0]], "progress": [held[1]], "seq": [held[2]], "micros": [held[3]]})


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: one row per task and micro-batch in update mode; the state of a task is four values."""
    keyed = events.withColumn("micros", F.expr("unix_micros(cast(ts as timestamp))")).select("task_id", "seq", "kind", "progress", "micros")
    return keyed.groupBy("task_id").applyInPandasWithState(
        _step, "task_id long, state string, progress double, seq long, micros long", "state string, progress double, seq long, micros long", "update", GroupStateTimeout.NoTimeout
    )


def replayed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a lifecycle stream over what there is; each task's last state. Files lie in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    query = lifecycle_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    out = spark.read.schema("task_id long, state string, progress double, seq long, micros long, batch int").parquet(f"{base}/out")
    last = out.groupBy("task_id").agg(F.max_by(F.struct("state", "progress", "seq", "micros"), "batch").alias("r"))
    stamp = F.expr("cast(timestamp_micros(r.micros) as timestamp_ntz)")
    return last.select("task_id", "r.state", "r.progress", "r.seq", stamp.alias("updated_at"))


def expired(states: DataFrame, now, idle_seconds: int = 3600) -> DataFrame:
    """Settled tasks that nothing happened to for so long."""
    idle = F.expr("unix_micros(cast(n as timestamp)) - unix_micros(cast(updated_at as timestamp))")
    return states.withColumn("n", now).filter(F.col("state").isin(*TERMINAL) & (idle >= idle_seconds * 1_000_000)).drop("n")


def admitted(states: DataFrame, keep: int = 1024) -> DataFrame:
    """Tasks kept when there are too many: all that run, and of the settled the latest, as many as fit."""
    settled = F.col("state").isin(*TERMINAL)
    running = states.filter(~settled)
    room = max(0, keep - running.count())
    return running.unionByName(states.filter(settled).orderBy(F.desc("updated_at"), "task_id").limit(room))


def running_totals(chunks: DataFrame) -> DataFrame:
    """(request, seq, total) of the pieces of each request so far, at least what the provider reported."""
    w = Window.partitionBy("request").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("total", F.greatest(F.sum("tokens").over(w), F.max(F.coalesce("reported", F.lit(0))).over(w)))


def first_success(attempts: DataFrame) -> DataFrame:
    """(request, provider) of the first success by priority; a read timeout before it stops the chain."""
    stop = F.min(F.when(F.col("outcome") == "timeout", F.col("priority")))
    good = F.min(F.when(F.col("outcome") == "ok", F.struct("priority", "provider")))
    per = attempts.groupBy("request").agg(stop.alias("s"), good.alias("g"))
    return per.select("request", F.when(F.col("s").isNull() | (F.col("g.priority") < F.col("s")), F.col("g.provider")).alias("provider"))
