"""JDBC connection options, shared by the source and the sink."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from etlspec.plans.spec import Auth, SinkSpec, SourceSpec
from etlspec.sources.files import reader_options

_log = logging.getLogger(__name__)

# credentials(secret_id, auth) -> (user, password)
Credentials = Callable[[str | None, Auth | None], tuple[str, str]]


def jdbc_url(block: SourceSpec | SinkSpec) -> str:
    if block.connection_url:
        return block.connection_url
    return f"jdbc:{block.connection_type}://{block.auth.host}:{block.auth.port}/{block.database}"


def jdbc_options(block: SourceSpec | SinkSpec, credentials: Credentials | None = None) -> dict[str, str]:
    """Options for ``format("jdbc")``.

    User and password come from ``credentials``, which the caller supplies; the
    secret is expected to hold ``username`` and ``password``. No cloud service
    is called from here.
    """
    options = {"url": jdbc_url(block), "dbtable": block.table}
    if block.secret_id or block.auth:
        if credentials is None:
            raise ValueError("this connection names a secret or an auth block, but no credentials function was given")
        user, password = credentials(block.secret_id, block.auth)
        if block.auth is not None and block.auth.username:
            user = block.auth.username
        options |= {"user": user, "password": password}
    return options | reader_options(getattr(block, "options", {}))


def read_jdbc(spark: SparkSession, source: SourceSpec, credentials: Credentials | None = None) -> DataFrame:
    options = jdbc_options(source, credentials)
    if "partitionColumn" not in options:
        _log.warning('source "%s" is read by one task: set partitionColumn, lowerBound, upperBound', source.name)
    return spark.read.format("jdbc").options(**options).load()
