"""Running a spec: sources, then transforms in order, then the output frame.

Everything up to the sink is one lazy plan over named frames. The exceptions
are schema inference of CSV, JSON and HTTP sources, and the search for frequent
keys before outer joins and ordered windows.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from etlspec.functions.defaults import add_time_partitions, with_defaults
from etlspec.functions.privacy import mask_pii
from etlspec.operators import grouping, joins, projection, windows
from etlspec.operators.hooks import CodeNotAllowed, run_code
from etlspec.operators.sizes import SPLIT_ROWS
from etlspec.plans.check import sink_source, step_names
from etlspec.plans.spec import PipelineSpec, SinkSpec, TransformSpec, load_spec
from etlspec.sinks.write import write_sink
from etlspec.sources.jdbc import Credentials
from etlspec.sources.read import read_source

_log = logging.getLogger(__name__)


class TransformError(RuntimeError):
    """A transform could not be planned; ``field`` says which one."""

    def __init__(self, field: str, cause: Exception):
        self.field = field
        super().__init__(f"{field}: {cause}")


@dataclass(frozen=True)
class PipelineResult:
    """The named frames of a run, and the frame its sink receives."""

    spec: PipelineSpec
    frames: Mapping[str, DataFrame]
    output: DataFrame

    def write(self, *, credentials: Credentials | None = None, provider: str = "iceberg") -> None:
        if self.spec.sink is None:
            raise ValueError("the spec has no sink")
        write_sink(self.output, output_sink(self.spec), credentials=credentials, provider=provider)


def run_pipeline(
    spark: SparkSession,
    spec: Any,
    *,
    frames: Mapping[str, DataFrame] | None = None,
    base_dir: str | None = None,
    project_dir: str | None = None,
    allow_code: bool = False,
    credentials: Credentials | None = None,
    split_rows: int | None = SPLIT_ROWS,
) -> PipelineResult:
    """Plan a spec (dict, YAML path or ``PipelineSpec``). Nothing is written.

    ``frames`` are DataFrames known by name besides, or instead of, the
    sources. ``body`` and ``job_file`` need ``allow_code=True``. ``split_rows``
    is the number of rows from which a key of an outer join or of an ordered
    window is split over several tasks; None leaves out looking for such keys.
    """
    given = dict(frames or {})
    spec = load_spec(spec, base_dir=base_dir, frames=tuple(given))
    known = {s.name: read_source(spark, s, credentials) for s in spec.sources if s.name not in given} | given
    return plan(spark, spec, known, tuple(given), allow_code, project_dir, split_rows)


def plan(
    spark: SparkSession,
    spec: PipelineSpec,
    frames: Mapping[str, DataFrame],
    extra: tuple[str, ...] = (),
    allow_code: bool = False,
    project_dir: str | None = None,
    split_rows: int | None = SPLIT_ROWS,
) -> PipelineResult:
    """Plan a checked spec over frames that are already bound."""
    known = dict(frames)
    if spec.body is not None or spec.job_file is not None:
        if not allow_code:
            raise CodeNotAllowed("the spec has a body or job_file; pass allow_code=True to run it")
        if spec.mask_pii:
            _log.warning("mask_pii has no effect on a body or job_file")
        output = run_code(spark, spec, known, project_dir)
        known["result"] = output
        return PipelineResult(spec, known, _finish(output, replace(spec, mask_pii=())))

    names = step_names(spec, extra)
    for i, (step, (source, target)) in enumerate(zip(spec.transforms, names)):
        try:
            known[target] = apply_transform(spark, known, step, source, split_rows)
        except (PySparkException, ValueError) as exc:
            raise TransformError(f"transforms[{i}]", exc) from exc
    return PipelineResult(spec, known, _finish(known[_written(spec, names, extra)], spec))


def _written(spec: PipelineSpec, names, extra: tuple[str, ...]) -> str:
    if spec.sink is None and names:
        return names[-1][1]
    return sink_source(spec, extra)


def apply_transform(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    step: TransformSpec,
    source: str,
    split_rows: int | None = SPLIT_ROWS,
) -> DataFrame:
    df = frames[source]
    match step.kind:
        case "filter":
            return projection.filter_rows(df, step.condition)
        case "sql":
            return projection.run_sql(spark, frames, step.query)
        case "select":
            return projection.select(df, step.columns)
        case "drop_columns":
            return projection.drop_columns(df, step.columns)
        case "rename":
            return projection.rename(df, step.mapping)
        case "add_column":
            return projection.add_column(df, step.name, step.expression)
        case "join":
            return joins.join(df, frames[step.right], step.on, step.how or "inner", step.suffix, split_rows)
        case "aggregate":
            return grouping.aggregate(df, step.group_by, step.aggs)
        case "window":
            return windows.add_window(df, step.name, step.expression, step.partition_by, step.order_by, split_rows)
    raise ValueError(f"unknown transform '{step.kind}'")


def _finish(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    """Masking, null defaults and time partitions, in this order."""
    repeated = [c for c, n in Counter(df.columns).items() if n > 1]
    if repeated:
        raise ValueError(f"the output has several columns named {', '.join(repeated)}")
    if spec.mask_pii:
        df = mask_pii(df, spec.mask_pii)
    sink = spec.sink
    if sink is not None and (sink.fill_nulls or (sink.kind == "iceberg" and sink.fill_nulls is not False)):
        df = with_defaults(df)
    if spec.partition_by:
        df = add_time_partitions(df, spec.partition_by, spec.partition_timestamp_column, spec.create_timestamp)
    return df


def output_sink(spec: PipelineSpec) -> SinkSpec:
    """The sink with the time partitions put before its own partition columns."""
    if not spec.partition_by:
        return spec.sink
    return replace(spec.sink, partition_by=(*spec.partition_by, *spec.sink.partition_by))
