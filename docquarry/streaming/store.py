"""A store of sessions over a stream: values and histories by key, each with a time to live.

Operations are rows (key, op, value): `set` keeps a value, `append` adds to the
history, of which the last ones are kept, `get` asks for both, `drop` forgets them.
State lives in Spark's state store, so a restart from the checkpoint finds it, and
entries end by themselves so many seconds after they were last written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the session must set: the state store that timed entries need, and no batches without data, as entries end by themselves.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class _Sessions(StatefulProcessor):
    def __init__(self, key: str, seconds: int, most: int):
        self.key, self.seconds, self.most = key, seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        of = T.StructType([T.StructField("value", T.StringType())])
        self.value = handle.getValueState("value", of, ttlDurationMs=self.seconds * 1000)
        self.history = handle.getListState("history", of, ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        told = []
        for seq, op, value in every[["seq", "op", "value"]].itertuples(index=False):
            if op == "set":
                self.value.update((value,))
            elif op == "append":
                kept = [(v[0],) for v in self.history.get()] if self.history.exists() else []
                self.history.put([*kept, (value,)][-self.most :])
            elif op == "drop":
                self.value.clear()
                self.history.clear()
            elif op == "get":
                told.append((key[0], seq, self.value.get()[0] if self.value.exists() else None, [v[0] for v in self.history.get()] if self.history.exists() else []))
        yield pd.DataFrame(told, columns=[self.key, "seq", "value", "history"])

    def close(self) -> None:
        pass


def sessions(operations: DataFrame, seconds: int, most: int = 20, key: str = "session_id") -> DataFrame:
    """(key, seq, value, history) for each `get`, by the order of `seq` in its batch. A history holds `most` entries."""
    kind = operations.schema[key].dataType.simpleString()
    rows = operations.select(key, "seq", "op", "value").groupBy(key)
    return rows.transformWithStateInPandas(_Sessions(key, seconds, most), f"{key} {kind}, seq long, value string, history array<string>", "append", "processingTime")
