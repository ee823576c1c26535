"""The exact 24-hour count of each transaction on a stream, as ``features.velocity_24h`` has it for a table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The task functions travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MINUTE, _DAY = 60_000_000, 86_400_000_000  # microseconds
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTS = T.StructType().add("times", T.ArrayType(T.LongType())).add("ns", T.ArrayType(T.LongType()))
_WAITING = T.StructType().add("ids", T.ArrayType(T.StringType())).add("times", T.ArrayType(T.LongType()))
_KEY = T.StructType().add("minute", T.LongType())


class DayCounts(StatefulProcessor):
    """Per customer, by minute: the distinct times of the last day with their numbers, and the transactions whose count isn't
    final yet. A count is final once the watermark has passed its minute, so that nothing earlier can still come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", _KEY, _COUNTS)
        self.waiting = handle.getMapState("waiting", _KEY, _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for minute, part in batch.groupby(batch["us"] // _MINUTE):
                at = (int(minute),)
                held = self.counts.getValue(at) if self.counts.containsKey(at) else ([], [])
                merged = dict(zip(held[0], held[1], strict=True))
                for t, n in part["us"].value_counts().items():
                    merged[int(t)] = merged.get(int(t), 0) + int(n)
                times = sorted(merged)
                self.counts.updateValue(at, (times, [merged[t] for t in times]))
                ids, when = self.waiting.getValue(at) if self.waiting.containsKey(at) else ([], [])
                self.waiting.updateValue(at, ([*ids, *part["tid"].tolist()], [*when, *part["us"].astype(int).tolist()]))
                self.handle.registerTimer((int(minute) + 1) * _MINUTE // 1000)
        yield self.made(key, [], [], [])

    @staticmethod
    def made(key: tuple, ids: list, times: list, n: list) -> pd.DataFrame:
        return pd.DataFrame({"customer_id": pd.Series([key[0]] * len(ids), dtype=object), "tid": pd.Series(ids, dtype=object), "us": np.asarray(times, np.int64), "n": np.asarray(n, np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = [(m[0], ids, times) for m, (ids, times) in self.waiting.iterator() if (m[0] + 1) * _MINUTE <= passed]
        if ready:  # the first of the timers that expire together deals with all of their minutes
            known = sorted((t, n) for _, (times, ns) in self.counts.iterator() for t, n in zip(times, ns, strict=True))
            times, ns = (np.array(x, np.int64) for x in zip(*known, strict=True))
            upto = np.concatenate(([0], np.cumsum(ns)))
            wanted = np.array([t for _, _, some in ready for t in some], np.int64)
            n = upto[np.searchsorted(times, wanted, "right")] - upto[np.searchsorted(times, wanted - _DAY, "right")]
            yield self.made(key, [i for _, ids, _ in ready for i in ids], wanted, n)
            for minute, _, _ in ready:
                self.waiting.removeKey((minute,))
                # When its day is over, the minute itself is forgotten.
                self.handle.registerTimer(((minute + 2) * _MINUTE + _DAY) // 1000)
        else:
            yield self.made(key, [], [], [])
        for (minute,) in [m for m, _ in self.counts.iterator() if (m[0] + 2) * _MINUTE + _DAY <= passed]:
            self.counts.removeKey((minute,))

    def close(self) -> None:
        pass


def exact_velocity(transactions: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """transaction_id, customer_id, timestamp, txn_last_24h: the customer's transactions in (t - 24 h, t], same-time ones included.

    ``transactions`` is a stream of these three columns, the timestamp a time. A count is put out once the watermark has passed
    the transaction's minute and equals that of the table of all transactions that were not late. Rows that come later than
    ``late`` are dropped and not counted; pass None where the stream has its watermark. Rows without a customer or time get 0 at once.

    The state of a customer is a day of distinct times in minutes of their own, of which a batch touches only those that it has
    rows for. It is kept in RocksDB, which this sets for the session.
    """
    spark = transactions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    marked = transactions.withWatermark("timestamp", late) if late else transactions
    rows = marked.select("transaction_id", "customer_id", "timestamp")
    known = F.col("customer_id").isNotNull() & F.col("timestamp").isNotNull()
    keyed = rows.filter(known).withColumns({"tid": F.col("transaction_id").cast("string"), "us": F.unix_micros("timestamp")}).select("customer_id", "timestamp", "tid", "us")
    kind = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType().add("customer_id", kind["customer_id"]).add("tid", "string").add("us", "long").add("n", "long")
    counted = keyed.groupBy("customer_id").transformWithStateInPandas(DayCounts(), schema, "Append", "EventTime")
    final = counted.select(F.col("tid").cast(kind["transaction_id"]).alias("transaction_id"), "customer_id", F.timestamp_micros("us").alias("timestamp"), F.col("n").alias("txn_last_24h"))
    return final.unionByName(rows.filter(~known).withColumn("txn_last_24h", F.lit(0).cast("long")))
