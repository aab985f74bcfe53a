"""Delivery of messages to topics, so that a repeated micro-batch reaches a reader once.

A ledger notes (topic, batch) when all messages of a batch have reached a topic; a batch that is noted is not sent
again. Where a job ends between sending and noting, the batch is sent a second time with the same message ids, and
``received`` keeps one message of each id. An id is made of the batch, the message and its number among equal messages of
the batch, so equal messages that are meant twice stay two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.positions import number_sorted
from barloom.sources.keyed_store import Folder
from barloom.streaming.jobs import _start


class Publisher:
    """Sends (key, value, topic) rows, one topic after the other, to a sink that Spark can append to.

    For files ``path`` in ``options`` gets a folder per topic; a message sink takes the topic from its column.
    """

    def __init__(self, ledger: str, sink: str, options: dict[str, str], topics: Sequence[str]):
        self.ledger, self.sink, self.options, self.topics = ledger, sink, dict(options), list(topics)

    def delivered(self, spark: SparkSession) -> set[tuple[str, int]]:
        """(topic, batch) of all that is noted."""
        names = Folder(spark, self.ledger).names("delivered")
        return {(t, int(b)) for t, _, b in (n.rpartition("-") for n in names if not n.startswith("."))}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self.delivered(spark)
        left = [t for t in self.topics if (t, batch_id) not in done]
        if not left:
            return
        wanted = batch.filter(F.col("topic").isin(left)).select("key", "value", "topic")
        told = number_sorted(wanted, ["topic", "key", "value"], [])  # written, so all topics read it
        told = told.withColumn("id", F.sha2(F.to_json(F.struct(F.lit(batch_id).alias("batch"), "topic", "key", "value", "_t")), 256)).drop("_t")
        for topic in left:
            options = self.options | ({"path": f"{self.options['path']}/topic={topic}"} if "path" in self.options else {})
            self.send(told.filter(F.col("topic") == topic), options)
            Folder(spark, self.ledger).mark(f"delivered/{topic}-{batch_id}")

    def send(self, messages: DataFrame, options: dict[str, str]) -> None:
        if "path" in options:
            messages = messages.drop("topic")  # the folder names it
        messages.write.format(self.sink).mode("append").options(**options).save()


def publish(stream: DataFrame, publisher: Publisher, checkpoint: str, every: str | None = None):
    """Send the (key, value, topic) rows of a stream."""
    return _start(stream.writeStream.foreachBatch(publisher), checkpoint, every)


def received(messages: DataFrame) -> DataFrame:
    """Each message once, however often it was sent: rows with one id are alike in all columns."""
    return messages.distinct()


def sent_files(spark: SparkSession, path: str, sink: str = "parquet") -> DataFrame:
    """(key, value, id, topic) of messages that were sent to files, each once."""
    schema = "key string, value string, id string, topic string"
    return received(spark.read.schema(schema).option("basePath", path).format(sink).load(f"{path}/topic=*"))
