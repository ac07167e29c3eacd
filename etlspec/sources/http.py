"""HTTP GET of JSON as a Spark data source: one task per URL.

A response is a JSON array, one JSON object, or JSON lines. It is read as a
stream and its items are handed to Spark as text, one row each; a response
is never held whole.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from etlspec.plans.spec import SourceSpec
from etlspec.sources.files import reader_options

FORMAT = "etlspec_http"
CHUNK = 1 << 20


class HttpDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "body STRING"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(dict(self.options))


class UrlPartition(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads(options["urls"])
        self.headers = json.loads(options.get("headers", "{}"))
        self.timeout = float(options.get("timeout", "60"))

    def partitions(self) -> list[InputPartition]:
        return [UrlPartition(url) for url in self.urls]

    def read(self, partition: UrlPartition) -> Iterator[tuple[str]]:
        request = urllib.request.Request(partition.url, headers=self.headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            reader = iter(lambda: response.read(CHUNK), b"")
            for item in json_items(_decoded(reader)):
                yield (item,)


def _decoded(chunks: Iterable[bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    for chunk in chunks:
        yield decoder.decode(chunk)
    yield decoder.decode(b"", final=True)


def json_items(chunks: Iterable[str]) -> Iterator[str]:
    """The text of each item of a JSON array, or of each top-level JSON value."""
    decoder, buffer, at, in_array = json.JSONDecoder(), "", 0, None
    source = iter(chunks)
    while True:
        more = next(source, None)
        buffer, at = buffer[at:] + (more or ""), 0
        while True:
            at = _skip(buffer, at, in_array)
            if at == len(buffer):
                break
            if in_array is None:
                in_array = buffer[at] == "["
                at += in_array
                continue
            if in_array and buffer[at] == "]":
                at, in_array = at + 1, None
                continue
            try:
                _, end = decoder.raw_decode(buffer, at)
            except json.JSONDecodeError:
                if more is None:
                    raise
                break
            if end == len(buffer) and more is not None:
                break  # a number may go on in the next chunk
            yield buffer[at:end]
            at = end
        if more is None:
            return


def _skip(text: str, at: int, in_array: bool | None) -> int:
    blanks = " \t\r\n," if in_array else " \t\r\n"
    while at < len(text) and text[at] in blanks:
        at += 1
    return at


def http_text(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """The response items as one string column, ``body``."""
    # By value, so that executors can run the reader without this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(HttpDataSource)
    options = reader_options(source.options)
    urls = json.loads(options.pop("urls")) if "urls" in options else [source.url]
    return (
        spark.read.format(FORMAT)
        .options(**options, urls=json.dumps(urls), headers=json.dumps(dict(source.headers)))
        .load()
    )


def read_http(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """The response items as columns.

    ``options.schema`` (a DDL string) fixes the columns. Without it the items
    are fetched once more to find them; the inference runs on the executors and
    only the schema text returns. ``options.urls`` lists several URLs of one
    data set, each read by its own task.

    An item that does not fit the schema fails the query. ``options.mode:
    PERMISSIVE`` makes it a row of nulls instead; a schema with a string column
    named by ``options.columnNameOfCorruptRecord`` then keeps its text.
    """
    text = http_text(spark, source)
    schema = source.options.get("schema") or inferred_schema(text)
    options = {"mode": "FAILFAST"} | {k: v for k, v in reader_options(source.options).items() if k != "urls"}
    return text.select(F.from_json("body", schema, options).alias("item")).select("item.*")


def inferred_schema(text: DataFrame) -> str:
    found = text.agg(F.schema_of_variant_agg(F.parse_json("body"))).first()[0]
    if not found or not found.startswith("OBJECT<"):
        raise ValueError(f"the response items are not JSON objects ({found}); give a schema in the options")

    def written(part: re.Match) -> str:
        if part["decimal"]:
            return "DOUBLE"  # like Spark's JSON source
        return {"OBJECT": "STRUCT", "VOID": "STRING"}.get(part[0], part[0])

    # Names, quoted or before a colon, are passed over as a whole.
    return re.sub(r"`(?:[^`]|``)*`|\w+:|(?P<decimal>DECIMAL\(\d+, ?\d+\))|\w+", written, found)
