"""Python code named by a spec: ``body`` text or a ``job_file``.

Both replace the declared transforms. They run only when the caller allows it.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etlspec.plans.spec import Import, PipelineSpec


class CodeNotAllowed(PermissionError):
    """The spec holds Python code and the caller did not allow it to run."""


def run_code(spark: SparkSession, spec: PipelineSpec, frames: Mapping[str, DataFrame], project_dir: str | None) -> DataFrame:
    result = (
        run_body(spark, spec.body, spec.imports, frames)
        if spec.body is not None
        else run_job_file(spark, job_path(spec, project_dir), frames)
    )
    if not isinstance(result, DataFrame):
        raise TypeError("body must leave a DataFrame in df_result; job_file must return one from run(spark, frames)")
    return result


def run_body(spark: SparkSession, body: str, imports: tuple[Import, ...], frames: Mapping[str, DataFrame]):
    names = {"spark": spark, "F": F, "Window": Window, **imported(imports)}
    names |= {f"df_{name}": frame for name, frame in frames.items()}
    exec(compile(body, "<body>", "exec"), names)
    return names.get("df_result")


def imported(imports: tuple[Import, ...]) -> dict[str, object]:
    bound: dict[str, object] = {}
    for item in imports:
        if item.source:
            bound[item.name] = getattr(importlib.import_module(item.source), item.name)
        else:
            importlib.import_module(item.name)
            top = item.name.split(".")[0]
            bound[top] = importlib.import_module(top)
    return bound


def job_path(spec: PipelineSpec, project_dir: str | None) -> str:
    """``~/x`` is below the project directory; other paths are below the spec's."""
    if spec.job_file.startswith("~/"):
        return os.path.join(project_dir or spec.base_dir or os.getcwd(), spec.job_file[2:])
    return os.path.join(spec.base_dir or os.getcwd(), spec.job_file)


def run_job_file(spark: SparkSession, path: str, frames: Mapping[str, DataFrame]):
    loaded = importlib.util.spec_from_file_location("etlspec_job_file", path)
    if loaded is None or not os.path.exists(path):
        raise FileNotFoundError(f"job_file not found: {path}")
    module = importlib.util.module_from_spec(loaded)
    loaded.loader.exec_module(module)
    return module.run(spark, dict(frames))
