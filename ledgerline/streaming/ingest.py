"""Incremental news ingest as a stream: each micro-batch of landing files is merged into the news table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import keys, validate
from ..sources import tables


def stream_news(spark: SparkSession, landing: str, table: str, checkpoint: str, staging: str, once: bool = True) -> StreamingQuery:
    """Merge new Parquet files of `landing` (news columns and ordinal) into the table by article_id.

    Upserts are idempotent, so a batch that is repeated after a failure changes nothing.
    """
    schema = T.StructType([*schemas.NEWS.fields, T.StructField("ordinal", T.LongType())])

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = tables.with_article_id(keys.keep_first_by_url(batch))
        valid, _ = validate.split_valid(rows, "news")
        if not valid.isEmpty():
            tables.merge(spark, table, valid, schemas.NEWS, schemas.KEYS["news"], staging)

    stream = spark.readStream.schema(schema).parquet(landing).withColumn("language", F.coalesce("language", F.lit("en")))
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
