"""Streams of vertex and edge records, merged into tables by gid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..graph import PropertyGraph
from ..writes import check

VERTEX = "gid string, label string, data string"
EDGE = "gid string, label string, `from` string, `to` string, data string"


def kafka_records(spark: SparkSession, servers: str, topic: str, edges: bool) -> DataFrame:
    """JSON messages of a topic, from its oldest on, as records with the order they came in."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parse_messages(raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("at"), F.col("offset").alias("seq")), edges)


def file_records(spark: SparkSession, folder: str, edges: bool) -> DataFrame:
    """The same from files with one message a line, as they appear in a folder."""
    raw = spark.readStream.schema("value string").text(folder)
    return parse_messages(raw.select("value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_block_start").alias("seq")), edges)


def parse_messages(raw: DataFrame, edges: bool) -> DataFrame:
    v = F.try_parse_json("value")
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    data = F.coalesce(F.to_json(F.try_variant_get(v, "$.data", "variant")), F.lit("{}"))
    return raw.select(*[text(n).alias(n) for n in ("gid", "label", *(("from", "to") if edges else ()))], data.alias("data"), "at", "seq")


class GraphStore:
    """Tables of record versions in a folder; the latest version of a gid is the element.

    Each batch appends one partition of its own, so a batch that runs again
    after a failure overwrites what it wrote before and nothing is read and
    rewritten.  compact keeps the latest versions only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def start(self, records: DataFrame, edges: bool, checkpoint: str, once: bool = True):
        """Write a stream of records; once: what is there now, else on and on."""
        table = f"{self.folder}/{'edges' if edges else 'vertices'}"

        def put(batch: DataFrame, n: int) -> None:
            good = check(batch, edges)[0].withColumn("batch", F.lit(n).cast("long"))
            good.write.mode("overwrite").parquet(f"{table}/batch={n}")

        w = records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()

    def _latest(self, kind: str) -> DataFrame:
        schema = (EDGE if kind == "edges" else VERTEX) + ", at timestamp, seq long, batch long"
        reader = self.spark.read.schema(schema).option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
        df = reader.parquet(f"{self.folder}/{kind}")
        names = [c for c in df.columns if c not in ("at", "seq", "batch")]
        last = df.groupBy("gid").agg(F.max_by(F.struct(*names), F.struct("batch", "at", "seq")).alias("r")).select("r.*")
        return last.withColumn("data", F.parse_json("data"))

    def graph(self, name: str = "stream") -> PropertyGraph:
        try:
            return PropertyGraph(self._latest("vertices"), self._latest("edges"), name=name)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise NotFound(f"nothing was written to {self.folder} yet") from e
            raise
