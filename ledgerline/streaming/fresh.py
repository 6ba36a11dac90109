"""New news as a stateful stream: keys near the newest time are kept as state, the stored table is never read."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..sources import tables

LANDING = T.StructType([*schemas.NEWS.fields, T.StructField("ordinal", T.LongType())])


def first_seen(news: DataFrame, delay_days: int = 1, buckets: int = 1024) -> DataFrame:
    """The first row of each (asset_id, url), or article_id where there is no url, of a stream of news with ordinals.

    A row is late, and dropped, when it isn't newer than the newest time of all earlier micro-batches less the delay.
    A key is remembered for the delay after the time of its last row that counted; rows of the key with a time before that end are
    dropped, and of the others within one micro-batch the first by (published_at, ordinal) counts.  Times count in
    milliseconds here, as watermarks do.  A row with neither url nor article_id, and one without time or asset, is an error: check before.

    Keys are dealt to buckets by hash, and a bucket's keys are one state, read and written whole when one of them comes: choose
    about a bucket per thousand keys of one delay.  The number must stay the same for a checkpoint.
    """
    delay = delay_days * 86_400_000
    columns = news.columns
    keyed = news.withColumn("__key", F.coalesce(F.nullif("url", F.lit("")), F.nullif("article_id", F.lit(""))))
    whole = F.col("__key").isNotNull() & F.col("published_at").isNotNull() & F.col("asset_id").isNotNull()
    keyed = keyed.withColumn("__us", F.unix_micros("published_at")).withColumn("__key", F.concat("asset_id", F.lit("\n"), "__key"))
    keyed = keyed.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets))).filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("news without asset, time or key"))))

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the last of its keys is past
            state.remove()
            return
        now, first = state.getCurrentWatermarkMs(), None
        held = {k: until for k, until in json.loads(state.get[0]).items() if until > now} if state.exists else {}
        for frame in frames:  # rows beyond the first of a key go at once
            known = frame["__us"] // 1000 < frame["__key"].map(held).astype(float)
            rows = frame[~known] if first is None else pd.concat([first, frame[~known]])
            first = rows.sort_values(["__us", "ordinal"], kind="stable").drop_duplicates("__key")
        if first is not None and len(first):
            ends = (first["__us"] // 1000 + delay).tolist()
            held |= {k: int(end) for k, end in zip(first["__key"], ends, strict=True) if end > now}
            yield first[columns]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(held.values()))
        elif state.exists:
            state.remove()

    grouped = keyed.withWatermark("published_at", f"{delay_days} days").groupBy("__bucket")
    return grouped.applyInPandasWithState(run, news.schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_fresh_news(spark: SparkSession, landing: str, path: str, checkpoint: str, delay_days: int = 1, once: bool = True, buckets: int = 1024) -> StreamingQuery:
    """Append new rows of the landing files (news columns and ordinal) to a table of their own, partitioned by asset.

    The file sink's log makes each micro-batch count once, also when it is repeated after a failure, so the table is to be
    written by this stream alone.  State lies in the checkpoint; for very many keys set the state store to RocksDB in the session.
    The numbers of late rows are in the query's progress (numRowsDroppedByWatermark).
    """
    rows = tables.news_defaults(spark.readStream.schema(LANDING).parquet(landing))
    writer = first_seen(rows, delay_days, buckets).writeStream.format("parquet").partitionBy("asset_id").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
