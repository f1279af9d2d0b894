"""A5: continuous dump with Structured Streaming, re-aimed from the reference's repeat-forever loop.

New rows arriving at a source (files, Kafka, a table's change feed) are turned into INSERT
statements batch by batch. Each micro-batch overwrites its own ``batch=<id>`` folder, so a batch
that is run again after a failure replaces its earlier output instead of adding to it; the query's
checkpoint folder records which batches are done. ``once=True`` processes what is there and stops
(``availableNow``), the analogue of the reference's ``--once``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablevault.functions.literals import COMPAT
from tablevault.operators.statements import DEFAULT_MAX_PACKET, insert_extended, insert_single
from tablevault.sinks.writers import codec


def dump_stream(stream: DataFrame, table: str, out_path: str, checkpoint_location: str,
                frequency_minutes: int | None = None, once: bool = False, mode: str = COMPAT,
                compression: str = "gzip", columns: list[str] | None = None, extended: bool = False,
                key: list[str] | None = None, max_packet: int = DEFAULT_MAX_PACKET) -> StreamingQuery:
    """Start a streaming dump of ``stream`` into ``out_path/batch=<id>/part-*``.

    With ``extended`` each batch's rows are packed (D3), in ``key`` order within the batch; a statement never spans batches.
    """
    comp = codec(compression)
    cols = columns or stream.columns

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if extended:
            packed = insert_extended(batch, table, key=key, max_packet=max_packet, columns=cols, mode=mode)
            stmts = packed.repartitionByRange("seq").sortWithinPartitions("seq").select("stmt")
        else:
            stmts = insert_single(batch, table, columns=cols, mode=mode)
        stmts.write.mode("overwrite").option("compression", comp).text(f"{out_path.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    if once:
        writer = writer.trigger(availableNow=True)
    elif frequency_minutes:
        writer = writer.trigger(processingTime=f"{int(frequency_minutes)} minutes")
    return writer.start()


def file_stream(spark, directory: str, schema, file_glob: str | None = None,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file source for :func:`dump_stream` (new files in ``directory`` are new rows)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(directory)
