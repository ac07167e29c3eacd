"""Declarative data pipelines and keyed-table operators on PySpark."""

from etlspec.functions.canonical import fingerprint
from etlspec.functions.columns import compile_column
from etlspec.functions.defaults import add_time_partitions, with_defaults
from etlspec.functions.privacy import mask_pii, pii_report
from etlspec.operators.quality import check_rows, find_duplicates, find_orphans
from etlspec.operators.snapshots import existence, overlay, scope_subtree, scope_to, snapshot_diff
from etlspec.operators.windows import add_window
from etlspec.plans.pipeline import PipelineResult, TransformError, run_pipeline
from etlspec.plans.registry import register_sink, register_source
from etlspec.plans.spec import Problem, SpecError, check_spec, load_spec
from etlspec.sinks.write import write_sink
from etlspec.streaming.incremental import run_incremental

__all__ = [
    "PipelineResult",
    "Problem",
    "SpecError",
    "TransformError",
    "add_time_partitions",
    "add_window",
    "check_rows",
    "check_spec",
    "compile_column",
    "existence",
    "find_duplicates",
    "find_orphans",
    "fingerprint",
    "load_spec",
    "mask_pii",
    "overlay",
    "pii_report",
    "register_sink",
    "register_source",
    "run_incremental",
    "run_pipeline",
    "scope_subtree",
    "scope_to",
    "snapshot_diff",
    "with_defaults",
    "write_sink",
]
