"""Jobs as streams: events come in as files or any other source, states and rates go out as they change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnspark.api.transfers import LEAST_SPAN, STALE_SECONDS

EVENT = "job_id bigint, event_id bigint, ts timestamp, state string, total bigint"


def events(spark: SparkSession, where: str, files_each: int = 1000) -> DataFrame:
    """Events from JSON files as they appear in a folder; at most so many files a step, which bounds a step's size."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_each).json(where)


def changed_states(stream: DataFrame) -> DataFrame:
    """(job_id, event_id, ts, state) of the events that change a job's state; one state a job is kept between steps."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before = rows.state.shift(fill_value=last if last is not None else "")
        out = rows[(rows.state != before) | (before == "")]
        state.update((rows.state.iloc[-1],))
        yield out[["job_id", "event_id", "ts", "state"]]

    return stream.groupBy("job_id").applyInPandasWithState(run, "job_id bigint, event_id bigint, ts timestamp, state string", "last string", "append", GroupStateTimeout.NoTimeout)


def speeds(stream: DataFrame, window: float) -> DataFrame:
    """(job_id, event_id, rate): whole bytes a second over about the last `window` seconds of a running total.

    Kept between steps: the samples younger than the window and the newest one before it. A total that falls starts anew.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, totals = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        rates = []
        for at, total in zip(rows.ts.astype("int64") / 1e9 if str(rows.ts.dtype) == "datetime64[ns]" else rows.ts.map(lambda t: t.timestamp()), rows.total):
            if totals and total < totals[-1]:
                times, totals = [], []
            times.append(float(at))
            totals.append(int(total))
            while len(times) > 2 and at - times[1] >= window:
                del times[0], totals[0]
            span = at - times[0]
            rates.append(0 if span < LEAST_SPAN else int((total - totals[0]) / span))
        state.update((times, totals))
        yield pd.DataFrame({"job_id": rows.job_id, "event_id": rows.event_id, "rate": rates})

    return stream.groupBy("job_id").applyInPandasWithState(run, "job_id bigint, event_id bigint, rate bigint", "times array<double>, totals array<bigint>", "append", GroupStateTimeout.NoTimeout)


def silent_jobs(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(job_id, last): jobs of which nothing was heard for STALE_SECONDS of event time: their sessions that have ended.

    Events later than `delay` behind the newest are too late to count.
    """
    s = stream.withWatermark("ts", delay).groupBy("job_id", F.session_window("ts", f"{STALE_SECONDS} seconds").alias("w")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return s.select("job_id", "last", "n")


def folder_totals(stream: DataFrame) -> DataFrame:
    """Running totals of folders from a stream of changes (path, size, sign): each change counts at every folder above it."""
    up = F.expr("transform(sequence(0, size(filter(split(path, '/'), p -> p <> '')) - 1), i -> concat('/', array_join(slice(filter(split(path, '/'), p -> p <> ''), 1, i), '/')))")
    return stream.select(F.explode(up).alias("folder"), (F.col("size") * F.col("sign")).alias("d"), "sign").groupBy("folder").agg(F.sum("d").alias("bytes"), F.sum("sign").alias("files"))


def collected(stream: DataFrame, spark: SparkSession, where: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table: run to its end with its progress kept in `where`."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{where}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out-{number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/progress").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out-{q.lastProgress['batchId']}")
