"""Running a spec over new input only, as micro-batches.

The streamed source is a file drop or a Kafka topic. Each micro-batch is an
ordinary run of the spec with that source bound to the new rows, so
``aggregate`` and ``window`` see one micro-batch at a time and keep no state.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlspec.functions.canonical import quoted
from etlspec.operators.sizes import SPLIT_ROWS
from etlspec.plans.pipeline import output_sink, plan
from etlspec.plans.spec import PipelineSpec, load_spec
from etlspec.sinks.write import write_sink
from etlspec.sources.jdbc import Credentials
from etlspec.sources.read import read_source, stream_source, table_name

_log = logging.getLogger(__name__)

RUN_COLUMN, BATCH_COLUMN = "ingest_run", "ingest_batch"
_STREAMED = ("s3", "kafka")


def run_incremental(
    spark: SparkSession,
    spec: Any,
    checkpoint: str,
    *,
    stream: str | None = None,
    frames: Mapping[str, DataFrame] | None = None,
    base_dir: str | None = None,
    project_dir: str | None = None,
    allow_code: bool = False,
    credentials: Credentials | None = None,
    provider: str = "iceberg",
    split_rows: int | None = SPLIT_ROWS,
) -> None:
    """Process everything that arrived since the last call, then return.

    ``stream`` names the source to follow (default: the first one that can be);
    the others are read in full for every micro-batch. ``checkpoint`` remembers
    what was processed and must be on storage all executors share. ``split_rows``
    is that of ``run_pipeline``; None spares every micro-batch the passes that
    look for large groups.

    A file sink is written below ``ingest_run=<id>/ingest_batch=<n>``, and a
    batch that is repeated after a failure replaces its own directory, so no row
    is lost or doubled. Rows for a catalog or ``iceberg`` table carry the same two
    as columns, and a batch whose run and number the table holds already is
    not appended again; this relies on the table format to add all rows of a
    write or none. A table that was made without the two columns can't tell, so
    there, as in other sinks, a repeated batch appends again, with a warning.
    """
    given = dict(frames or {})
    spec = load_spec(spec, base_dir=base_dir, frames=tuple(given))
    if spec.sink is None:
        raise ValueError("an incremental run needs a sink")
    if spec.sink.mode not in (None, "append"):
        raise ValueError(f'an incremental run appends; mode "{spec.sink.mode}" cannot be used')
    followed = _followed(spec, stream)
    fixed = {s.name: read_source(spark, s, credentials) for s in spec.sources if s is not followed} | given

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        bound = {s.name: batch if s is followed else fixed[s.name] for s in spec.sources} | given
        result = plan(session, spec, bound, tuple(given), allow_code, project_dir, split_rows)
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        _write_batch(result.output, spec, run, batch_id, credentials, provider)

    query = (
        stream_source(spark, followed)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _followed(spec: PipelineSpec, stream: str | None):
    for source in spec.sources:
        if source.name == stream or (stream is None and source.kind in _STREAMED):
            return source
    raise ValueError(f"no source to follow{f' named {stream}' if stream else ''}")


def _write_batch(df: DataFrame, spec: PipelineSpec, run: str, batch_id: int, credentials, provider: str) -> None:
    sink = output_sink(spec)
    if sink.kind == "s3":
        sink = replace(
            sink,
            path=f"{sink.path.rstrip('/')}/{RUN_COLUMN}={run}/{BATCH_COLUMN}={batch_id}",
            mode="overwrite",
        )
    else:
        sink = replace(sink, mode="append")
        if sink.kind in ("catalog", "iceberg"):
            df = _not_yet_appended(df, table_name(sink.database, sink.table), run, batch_id)
    write_sink(df, sink, credentials=credentials, provider=provider)


def _not_yet_appended(df: DataFrame, table: str, run: str, batch_id: int) -> DataFrame:
    """The batch with its run and number as columns, less what the table holds of it."""
    marked = df.withColumns({RUN_COLUMN: F.lit(run), BATCH_COLUMN: F.lit(batch_id).cast("long")})
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        return marked
    present = spark.table(table)
    if not {RUN_COLUMN, BATCH_COLUMN} <= set(present.columns):
        _log.warning("table %s has no columns %s and %s, so a repeated batch would be appended again", table, RUN_COLUMN, BATCH_COLUMN)
        return df
    mine = present.filter((F.col(RUN_COLUMN) == run) & (F.col(BATCH_COLUMN) == batch_id))
    ledger = mine.select(RUN_COLUMN, BATCH_COLUMN).limit(1)  # one row, or none
    return marked.join(F.broadcast(ledger), [RUN_COLUMN, BATCH_COLUMN], "left_anti").select(*map(quoted, marked.columns))
