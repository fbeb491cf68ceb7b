"""Session event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.loose import md5_route

ITEM = "session_id string, seq long, main_stream_type string, sub_stream_type string, content string, stream_state string, from_sandbox boolean"


def parsed_lines(lines: DataFrame, schema: str = ITEM) -> DataFrame:
    """NDJSON lines (column ``value``) as records, with ``error`` for what doesn't parse.

    Blank lines are left out; a last line without line end counts.
    """
    rec = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")
    rows = lines.filter(F.trim("value") != "").select("value", rec)
    return rows.select("r.*", F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), F.col("value")).alias("error")).drop("_corrupt")


def until_end(events: DataFrame) -> DataFrame:
    """A stream of events of ``ITEM`` up to and with each session's terminal one.

    State is one flag per session, kept until an item of ``main_stream_type`` reset
    clears it; that item isn't emitted, and the session starts anew after it.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs)).sort_values("seq", kind="stable")
        clear = (rows["main_stream_type"] == "reset").to_numpy()
        if clear.any():
            rows = rows.iloc[int(clear.nonzero()[0][-1]) + 1 :]
            if state.exists:
                state.remove()
        if (state.exists and state.get[0]) or rows.empty:
            return
        end = (rows["sub_stream_type"].fillna("") == "") & (rows["stream_state"] == "end")
        if end.any():
            rows = rows.iloc[: int(end.to_numpy().argmax()) + 1]
            state.update((True,))
        yield rows

    return events.groupBy("session_id").applyInPandasWithState(run, ITEM, "done boolean", "append", GroupStateTimeout.NoTimeout)


def over_rate(events: DataFrame, key: str, ts: str, limit: int = 200) -> DataFrame:
    """Seconds in which a key has more than ``limit`` events; batch or stream."""
    w = F.window(F.col(ts).cast("timestamp"), "1 second")
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(key, F.col("w.start").alias("second"), "n")


def lifecycle(events: DataFrame, session: str, order: str) -> DataFrame:
    """Adds ``stream_state``: start for a session's first event, end for its last, running between."""
    w = W.partitionBy(session)
    return events.withColumn("stream_state", F.when(F.row_number().over(w.orderBy(order)) == 1, "start").when(F.row_number().over(w.orderBy(F.desc(order))) == 1, "end").otherwise("running"))


def append_items(items: DataFrame, path: str) -> None:
    """Items as lines of JSON in the folder that a stream reads; each call appends."""
    items.write.mode("append").json(path)


def respond(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing a stream as lines of JSON; returns at once. With the same checkpoint it
    goes on where it stopped."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def routed(events: DataFrame, session: str, workers: int) -> DataFrame:
    """Adds ``worker``: by the session's hash; events without a session go anywhere."""
    return events.withColumn("worker", F.coalesce(md5_route(F.col(session), workers), F.floor(F.rand() * workers).cast("int")))
