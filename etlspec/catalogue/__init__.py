"""Named queries over the test tables, each with the SQL that gives its result."""

from etlspec.catalogue import privacy, sql, storage, tables, transforms  # noqa: F401
from etlspec.catalogue.base import CATALOGUE

__all__ = ["CATALOGUE"]
