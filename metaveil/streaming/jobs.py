"""Answers to requests as they arrive: of each job, that to its latest request counts, whatever comes late or twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType([T.StructField("request", T.LongType()), T.StructField("response", T.StringType())])
OUT = T.StructType([T.StructField("job", T.LongType()), *STATE.fields])
#: Spark keeps this kind of state in RocksDB alone.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Latest(StatefulProcessor):
    """Keeps a job's latest request with its answer, and tells a job when that changes. An answer that is older is ignored, and so is one seen before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = tuple(self.latest.get()) if self.latest.exists() else None
        best = before
        for batch in rows:
            for answer in zip(batch["request"].astype(int), batch["response"].astype(str), strict=True):
                best = answer if best is None or answer > best else best
        if best is not None and best != before:
            self.latest.update((int(best[0]), best[1]))
            yield pd.DataFrame({"job": [key[0]], "request": [int(best[0])], "response": [best[1]]})

    def close(self) -> None:
        pass


def supported(spark: SparkSession) -> None:
    """Sets the store that this state needs, where none is chosen."""
    if spark.conf.get(*PROVIDER[:1]).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(*PROVIDER)


def last_operation(responses: DataFrame) -> DataFrame:
    """job, request, response of a stream (job, request, response), in update mode: a row whenever a job's latest answer changes.

    The last row of each job is what relations.last_operation gives for the same responses as a table.
    """
    supported(responses.sparkSession)
    typed = responses.selectExpr("CAST(job AS BIGINT) AS job", "CAST(request AS BIGINT) AS request", "CAST(response AS STRING) AS response")
    whole = typed.where("job IS NOT NULL AND request IS NOT NULL AND response IS NOT NULL")
    return whole.groupBy("job").transformWithStateInPandas(Latest(), OUT, "Update", "None")
