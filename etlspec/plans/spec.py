"""The pipeline spec: plain frozen records read from a dict or a YAML file.

Reading never stops at the first mistake: every structural problem is put on a
list, and ``load_spec`` raises one ``SpecError`` that carries all of them
together with the semantic problems found by ``plans.check``.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

# The keys each block of a spec accepts, with the shape expected.
SOURCE_KEYS = {
    "name": "str",
    "type": "str",
    "format": "str",
    "path": "str",
    "connection_url": "str",
    "table": "str",
    "database": "str",
    "secret_id": "str",
    "engine": "str",
    "connection_type": "str",
    "topic": "str",
    "url": "str",
    "headers": "str_map",
    "options": "map",
    "auth": "auth",
}
SINK_KEYS = {
    "source": "str",
    "type": "str",
    "format": "str",
    "path": "str",
    "connection_url": "str",
    "connection_type": "str",
    "table": "str",
    "database": "str",
    "secret_id": "str",
    "mode": "str",
    "partition_by": "str_list",
    "fill_nulls": "bool",
    "auth": "auth",
}
TRANSFORM_KEYS = {
    "type": "str",
    "source": "str",
    "output": "str",
    "condition": "text",
    "query": "str",
    "columns": "str_list",
    "mapping": "str_map",
    "name": "str",
    "expression": "text",
    "left": "str",
    "right": "str",
    "on": "str_or_list",
    "how": "str",
    "suffix": "str",
    "group_by": "str_list",
    "aggs": "str_map",
    "partition_by": "str_list",
    "order_by": "order",
}
AUTH_KEYS = {"kind": "str", "username": "str", "host": "str", "port": "int", "region": "str"}
IMPORT_KEYS = {"name": "str", "from": "str"}
PIPELINE_KEYS = {
    "name": "str",
    "imports": "any",
    "body": "str",
    "job_file": "str",
    "sources": "any",
    "source": "any",
    "sink": "any",
    "transforms": "any",
    "mask_pii": "str_list",
    "partition_by": "str_list",
    "partition_timestamp_column": "str",
    "create_timestamp": "bool",
}
# Deployment settings a spec may carry; they do not affect the data.
DEPLOYMENT_KEYS = ("type", "role", "airflow", "config", "_aws", "plugin_version", "plugin_source")


@dataclass(frozen=True)
class Problem:
    """One thing wrong with a spec: where, and what."""

    field: str
    message: str

    def __str__(self) -> str:
        return f"{self.field}: {self.message}"


class SpecError(ValueError):
    """Raised with the full list of problems of a spec."""

    def __init__(self, problems: list[Problem]):
        self.problems = list(problems)
        super().__init__("; ".join(str(p) for p in self.problems))


@dataclass(frozen=True)
class Auth:
    kind: str | None = None
    username: str | None = None
    host: str | None = None
    port: int | None = None
    region: str | None = None


@dataclass(frozen=True)
class Order:
    column: str
    desc: bool = False


@dataclass(frozen=True)
class Import:
    name: str
    source: str | None = None


@dataclass(frozen=True)
class SourceSpec:
    name: str
    kind: str | None = None
    format: str | None = None
    path: str | None = None
    connection_url: str | None = None
    table: str | None = None
    database: str | None = None
    secret_id: str | None = None
    engine: str | None = None
    connection_type: str | None = None
    topic: str | None = None
    url: str | None = None
    headers: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, Any] = field(default_factory=dict)
    auth: Auth | None = None


@dataclass(frozen=True)
class SinkSpec:
    kind: str | None = None
    source: str | None = None
    format: str | None = None
    path: str | None = None
    connection_url: str | None = None
    connection_type: str | None = None
    table: str | None = None
    database: str | None = None
    secret_id: str | None = None
    mode: str | None = None
    partition_by: tuple[str, ...] = ()
    fill_nulls: bool | None = None
    auth: Auth | None = None


@dataclass(frozen=True)
class TransformSpec:
    kind: str | None = None
    source: str | None = None
    output: str | None = None
    condition: str | None = None
    query: str | None = None
    columns: tuple[str, ...] = ()
    mapping: Mapping[str, str] = field(default_factory=dict)
    name: str | None = None
    expression: str | None = None
    left: str | None = None
    right: str | None = None
    on: tuple[str, ...] = ()
    how: str | None = None
    suffix: str | None = None
    group_by: tuple[str, ...] = ()
    aggs: Mapping[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()


@dataclass(frozen=True)
class PipelineSpec:
    sources: tuple[SourceSpec, ...] = ()
    transforms: tuple[TransformSpec, ...] = ()
    sink: SinkSpec | None = None
    name: str | None = None
    imports: tuple[Import, ...] = ()
    body: str | None = None
    job_file: str | None = None
    mask_pii: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    partition_timestamp_column: str | None = None
    create_timestamp: bool = False
    base_dir: str | None = None


# --------------------------------------------------------------------------
# Reading


def read_yaml(path: str) -> Any:
    """Load YAML with 1.2-style booleans, so the key ``on`` stays a string."""
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a spec from YAML needs the PyYAML package") from exc

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {
        first: [(tag, rx) for tag, rx in pairs if tag != "tag:yaml.org,2002:bool"]
        for first, pairs in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    import re

    Loader.add_implicit_resolver(
        "tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF")
    )
    with open(path, encoding="utf-8") as handle:
        return yaml.load(handle, Loader)


_SHAPES = {
    "str": (lambda v: isinstance(v, str), "a string"),
    "int": (lambda v: isinstance(v, int) and not isinstance(v, bool), "an integer"),
    "bool": (lambda v: isinstance(v, bool), "true or false"),
    "text": (lambda v: isinstance(v, (str, bool, int, float)), "an expression"),
    "map": (lambda v: isinstance(v, Mapping), "a mapping"),
    "str_map": (
        lambda v: isinstance(v, Mapping) and all(isinstance(x, str) for kv in v.items() for x in kv),
        "a mapping of strings to strings",
    ),
    "str_list": (lambda v: isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v), "a list of strings"),
    "str_or_list": (
        lambda v: isinstance(v, str) or (isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)),
        "a column name or a list of column names",
    ),
    "order": (
        lambda v: isinstance(v, (list, tuple))
        and all(
            isinstance(x, Mapping)
            and isinstance(x.get("column"), str)
            and isinstance(x.get("desc", False), bool)
            and set(x) <= {"column", "desc"}
            for x in v
        ),
        "a list of {column, desc} records",
    ),
    "auth": (lambda v: isinstance(v, Mapping), "a mapping"),
    "any": (lambda v: True, ""),
}


def _block(raw: Any, keys: Mapping[str, str], path: str, problems: list[Problem]) -> dict[str, Any]:
    """Keep the known, well-shaped keys of one block; report all others."""
    if not isinstance(raw, Mapping):
        problems.append(Problem(path, "must be a mapping"))
        return {}
    kept: dict[str, Any] = {}
    for key, value in raw.items():
        shape = keys.get(key)
        where = f"{path}.{key}" if path else str(key)
        if shape is None:
            problems.append(
                Problem(path or "spec", f"unknown field '{key}' (this block accepts: {', '.join(keys)})")
            )
        elif value is not None:
            fits, wanted = _SHAPES[shape]
            if fits(value):
                kept[key] = _settle(value, shape, where, problems)
            else:
                problems.append(Problem(where, f"must be {wanted}"))
    return kept


def _settle(value: Any, shape: str, where: str, problems: list[Problem]) -> Any:
    if shape == "text":
        return value if isinstance(value, str) else repr(value)
    if shape == "str_list":
        return tuple(value)
    if shape == "str_or_list":
        return (value,) if isinstance(value, str) else tuple(value)
    if shape == "order":
        return tuple(Order(x["column"], x.get("desc", False)) for x in value)
    if shape == "auth":
        return _auth(value, where, problems)
    if shape in ("map", "str_map"):
        return dict(value)
    return value


def _auth(raw: Mapping[str, Any], where: str, problems: list[Problem]) -> Auth:
    auth = Auth(**_block(raw, AUTH_KEYS, where, problems))
    if auth.kind != "rds_iam":
        problems.append(Problem(f"{where}.kind", "must be rds_iam"))
    for key in ("host", "port", "region"):
        if getattr(auth, key) is None:
            problems.append(Problem(f"{where}.{key}", "is missing"))
    return auth


def _record(cls, raw: Any, keys: Mapping[str, str], path: str, problems: list[Problem], **defaults: Any):
    values = {**defaults, **_block(raw, keys, path, problems)}
    if "type" in values:
        values["kind"] = values.pop("type")
    elif isinstance(raw, Mapping):
        problems.append(Problem(f"{path}.type", "is missing"))
    known = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in values.items() if k in known})


def _entries(raw: Any, path: str, problems: list[Problem]) -> list[Any]:
    if raw is None:
        return []
    if not isinstance(raw, (list, tuple)):
        problems.append(Problem(path, "must be a list"))
        return []
    return list(raw)


def parse_spec(raw: Any, base_dir: str | None = None) -> tuple[PipelineSpec, list[Problem]]:
    """Turn a raw document into records plus the structural problems found."""
    problems: list[Problem] = []
    if not isinstance(raw, Mapping):
        return PipelineSpec(), [Problem("spec", "must be a mapping")]
    ignored = {*DEPLOYMENT_KEYS, raw.get("type")}
    top = _block({k: v for k, v in raw.items() if k not in ignored}, PIPELINE_KEYS, "", problems)

    if "sources" in top:
        sources = [
            _record(SourceSpec, item, SOURCE_KEYS, f"sources[{i}]", problems, name=f"source_{i}")
            for i, item in enumerate(_entries(top["sources"], "sources", problems))
        ]
    elif "source" in top:
        sources = [_record(SourceSpec, top["source"], SOURCE_KEYS, "source", problems, name="source")]
    else:
        sources = []

    transforms = []
    for i, item in enumerate(_entries(top.get("transforms"), "transforms", problems)):
        if isinstance(item, Mapping) and "transform_type" in item and "type" not in item:
            item = {("type" if k == "transform_type" else k): v for k, v in item.items()}
        transforms.append(_record(TransformSpec, item, TRANSFORM_KEYS, f"transforms[{i}]", problems))

    sink = _record(SinkSpec, top["sink"], SINK_KEYS, "sink", problems) if "sink" in top else None

    imports = []
    for i, item in enumerate(_entries(top.get("imports"), "imports", problems)):
        entry = _block(item, IMPORT_KEYS, f"imports[{i}]", problems)
        if "name" in entry:
            imports.append(Import(entry["name"], entry.get("from")))

    plain = ("name", "body", "job_file", "mask_pii", "partition_by", "partition_timestamp_column", "create_timestamp")
    spec = PipelineSpec(
        sources=tuple(sources),
        transforms=tuple(transforms),
        sink=sink,
        imports=tuple(imports),
        base_dir=base_dir,
        **{k: top[k] for k in plain if k in top},
    )
    return spec, problems


def load_spec(raw: Any, *, base_dir: str | None = None, frames: tuple[str, ...] = ()) -> PipelineSpec:
    """Read and check a spec given as a dict, a YAML path, or a ``PipelineSpec``.

    ``frames`` names DataFrames the caller will supply besides the sources.
    """
    from etlspec.plans.check import semantic_problems

    if isinstance(raw, PipelineSpec):
        spec, problems = raw, []
    else:
        if isinstance(raw, (str, os.PathLike)):
            base_dir = base_dir or os.path.dirname(os.path.abspath(raw))
            raw = read_yaml(os.fspath(raw))
        spec, problems = parse_spec(raw, base_dir)
    problems = problems + semantic_problems(spec, frames)
    if problems:
        raise SpecError(problems)
    return spec


def check_spec(raw: Any, frames: tuple[str, ...] = ()) -> list[Problem]:
    """All problems of a spec, as a list; empty when the spec is fine."""
    try:
        load_spec(raw, frames=frames)
    except SpecError as exc:
        return exc.problems
    return []
