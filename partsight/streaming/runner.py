"""Run a stream over everything that is there (``availableNow``) with its checkpoint and its output
in the shared folder, and read the output back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partsight.session import run_dir
from partsight.sources.domain import Domain
from partsight.sources.tables import read_table



def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.getFileStatus(where).isDirectory()


class StreamDomain(Domain):
    """The derived tables with the named driver tables read as streams."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, streamed: set[str], files: int | None = None
    ) -> None:
        super().__init__(spark, sf_dir)
        for name in streamed:
            static = read_table(spark, sf_dir, name)
            raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
            path = f"{sf_dir.rstrip('/')}/{name}.parquet"
            # A stream reads a folder: the table's own, or of a table that is one file the parent.
            reader = spark.readStream.schema(raw)
            if not _is_folder(spark, path):
                reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), sf_dir
            # Bounds what one key can bring at once; Spark takes one of the two limits.
            if files is None:
                reader = reader.option("maxBytesPerTrigger", str(1 << 30))
            else:
                reader = reader.option("maxFilesPerTrigger", files)
            stream = reader.parquet(path)
            self._built[name] = stream.select(
                *[F.col(f.name).cast(f.dataType) for f in static.schema.fields]
            )


def append_to_table(stream: DataFrame, what: str, folder: str | None = None) -> DataFrame:
    """Append-mode stream into a Parquet table (exactly once through the sink's log). A job that goes
    on after a stop names the same ``folder`` again; it holds the table and the checkpoint."""
    spark = stream.sparkSession
    folder = folder or run_dir(spark, what)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def merge_to_table(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], what: str, folder: str | None = None
) -> DataFrame:
    """The rows ``partial`` makes of each batch, which the reader merges (sums, minima, distinct keys).

    A batch overwrites its own rows when it is repeated, and there is no watermark, so no row is late:
    the merged result does not depend on how the input was cut into batches, nor on its order."""
    spark = stream.sparkSession
    folder = folder or run_dir(spark, what)
    empty = spark.createDataFrame([], partial(stream).schema)
    empty.write.mode("ignore").parquet(f"{folder}/table/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    for_each_batch(stream, write, folder)
    return spark.read.parquet(f"{folder}/table").drop("batch")


def for_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
