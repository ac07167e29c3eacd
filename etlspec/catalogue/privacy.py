"""Queries for PII masking and counting, over whole texts."""

from __future__ import annotations

from functools import reduce

from etlspec.catalogue.base import query, table, transformed
from etlspec.functions.privacy import ENTITIES, PATTERNS, ordered, pii_report


def _masked_sql(column: str, entities) -> str:
    return reduce(
        lambda text, e: f"regexp_replace({text}, '{PATTERNS[e]}', '[{e}]', 'g')", ordered(entities), column
    )


def _masking(name: str, table_name: str, keep: str, column: str, entities) -> None:
    sql = f"SELECT {keep}, {_masked_sql(column, entities)} AS {column} FROM {table_name}"

    @query(name, sql)
    def run(spark, sf_dir):
        columns = [c.strip() for c in keep.split(",")]
        steps = [{"type": "select", "columns": [*columns, column]}]
        return transformed(spark, sf_dir, [table_name], steps, mask_pii=list(entities))


_masking("pii_email", "documents", "doc_id", "text", ["EMAIL"])
_masking("pii_card", "documents", "doc_id", "text", ["CREDIT_CARD"])
_masking("pii_all", "documents", "doc_id", "text", ENTITIES)
_masking("pii_pages", "pages", "page_id", "html", ENTITIES)
_masking("pii_conversations", "conversations", "conv_id, turn", "text", ["PHONE_NUMBER", "EMAIL", "IP_ADDRESS"])


def _report_sql() -> str:
    parts = []
    for i, entity in enumerate(ENTITIES):
        found = f"len(regexp_extract_all({_masked_sql('text', ENTITIES[:i])}, '{PATTERNS[entity]}'))"
        parts.append(
            f"""SELECT 'text' AS "column", '{entity}' AS entity, CAST(sum(m) AS BIGINT) AS matches,
                       CAST(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows
                FROM (SELECT {found} AS m FROM documents)"""
        )
    return " UNION ALL ".join(parts)


@query("pii_report", _report_sql())
def report(spark, sf_dir):
    return pii_report(table(spark, sf_dir, "documents").select("text"))
