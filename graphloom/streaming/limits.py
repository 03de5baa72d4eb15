"""Rate limits and caches with expiry as state of a stream: bounded by timers, restored from its checkpoint.

Both keep their state in ``transformWithStateInPandas``, which needs the RocksDB
state store (``with_state_store``). Time is that of the events: a timer that the watermark
passes removes what has expired, so the state holds live windows and entries only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class _Limiter(StatefulProcessor):
    """Counts requests of a key in fixed minutes; a minute's count goes when the watermark has passed its end."""

    def __init__(self, most: dict[str, int], default: int, width: int) -> None:
        self.most, self.default, self.width = most, default, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", T.StructType([T.StructField("window", T.LongType())]), T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows), ignore_index=True).sort_values(["at", "request_id"], kind="stable")
        seen: dict[int, int] = {}
        numbers = []
        for at in every["at"]:
            window = int(at) // self.width * self.width
            if window not in seen:
                seen[window] = int(self.counts.getValue((window,))[0]) if self.counts.containsKey((window,)) else 0
                if not seen[window]:
                    self.handle.registerTimer(window + self.width)
            seen[window] += 1
            numbers.append(seen[window])
        for window, n in seen.items():
            self.counts.updateValue((window,), (n,))
        most = self.most.get(str(every["tier"].iloc[0]), self.default)
        yield pd.DataFrame({"request_id": every["request_id"], "key": key[0], "n": pd.Series(numbers, dtype="int64"), "allowed": [x <= most for x in numbers]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window = int(expiredTimerInfo.getExpiryTimeInMs()) - self.width
        if self.counts.containsKey((window,)):
            self.counts.removeKey((window,))
        yield pd.DataFrame({"request_id": pd.Series([], dtype="int64"), "key": pd.Series([], dtype="object"), "n": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, most: dict[str, int], default: int, late: str = "10 minutes", width: int = MINUTE) -> DataFrame:
    """request_id, key, n, allowed: each request of a stream (request_id, key, tier, ts) with its number among those of its key in a fixed window, in order of arrival, and whether its tier's limit allows it."""
    held = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("request_id", "key", F.coalesce("tier", F.lit("")).alias("tier"), "ts", F.unix_millis("ts").alias("at"))
    schema = "request_id long, key string, n long, allowed boolean"
    return held.groupBy("key").transformWithStateInPandas(_Limiter(most, default, width), schema, "Append", "EventTime")


def limited_batch(requests: DataFrame, most: dict[str, int], default: int, width: int = MINUTE) -> DataFrame:
    """What ``limited`` gives for requests that arrive in order of time."""
    from pyspark.sql import Window

    window = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / width)
    n = F.row_number().over(Window.partitionBy("key", window).orderBy("ts", "request_id")).cast("long")
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in most.items() for x in pair)), F.coalesce("tier", F.lit(""))), F.lit(default)) if most else F.lit(default)
    return requests.withColumn("n", n).select("request_id", "key", "n", (F.col("n") <= limit).alias("allowed"))


class _Cache(StatefulProcessor):
    """The live entry of a key; a timer at its expiry removes it and says so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", T.StructType([T.StructField("data", T.StringType()), T.StructField("created", T.LongType()), T.StructField("expires", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.concat(list(rows), ignore_index=True).sort_values("created", kind="stable").iloc[-1]
        if self.entry.exists() and int(self.entry.get()[1]) > int(last["created"]):
            yield _none()
            return
        if self.entry.exists():
            self.handle.deleteTimer(int(self.entry.get()[2]))
        # An entry without a valid expiry has expired.
        live = pd.notna(last["expires"]) and int(last["expires"]) > max(int(last["created"]), int(timerValues.getCurrentWatermarkInMs()))
        if live:
            self.entry.update((last["data"], int(last["created"]), int(last["expires"])))
            self.handle.registerTimer(int(last["expires"]))
        else:
            self.entry.clear()
        yield pd.DataFrame({"key": [key[0]], "data": [last["data"]], "state": ["live" if live else "expired"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.entry.exists() and int(self.entry.get()[2]) <= int(expiredTimerInfo.getExpiryTimeInMs()):
            data = self.entry.get()[0]
            self.entry.clear()
            yield pd.DataFrame({"key": [key[0]], "data": [data], "state": ["expired"]})
        else:
            yield _none()

    def close(self) -> None:
        pass


def _none() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype="object") for c in ("key", "data", "state")})


def cached(entries: DataFrame, late: str = "0 seconds") -> DataFrame:
    """key, data, state: what becomes of the entries of a stream (key, data, created_at, expires_at): live when they come, expired when the time of the events has passed their expiry."""
    held = entries.withWatermark("created_at", late).select("key", "data", "created_at", F.unix_millis("created_at").alias("created"), F.unix_millis("expires_at").alias("expires"))
    return held.groupBy("key").transformWithStateInPandas(_Cache(), "key string, data string, state string", "Append", "EventTime")
