"""Queries of the general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import canon
from tallyline.operators import difference, records, timestamps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, accounts = table(spark, sf_dir, "bank_transactions"), table(spark, sf_dir, "accounts")
    return timestamps.normalise_times(rows, accounts, "tx_id", "transaction_time", "transaction_date", "source_document_id", "branch_zone")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select("tx_id", "field_name", "norm").distinct()


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_records(table(spark, sf_dir, "statement_lines"), "line_id", "record_no", "record_text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rejected_rows(_records(spark, sf_dir), "line_id").select("line_id", "reason")


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.valid_rows(_records(spark, sf_dir), "line_id")


CELLS = ("account_number", "transaction_date", "transaction_time", "direction", "amount", "balance", "counterparty_name", "counterparty_account")
ROW_KEY = ["source_document_id", "page_no", "row_no"]


def _reading(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    cells = {n: canon.field(n, F.get("cell_values", F.lit(k)), text=canon.trimmed) for k, n in enumerate(CELLS)}
    return table(spark, sf_dir, name).select(
        *ROW_KEY,
        *(c.alias(n) for n, c in cells.items()),
        canon.trimmed(F.col("raw_direction")).alias("raw_direction"),
        difference.pair_set(F.col("issues"), "field_name", "kind").alias("issues"),
    )


def _compared(spark: SparkSession, sf_dir: str, extras: bool) -> DataFrame:
    left, right = _reading(spark, sf_dir, "assembled_rows"), _reading(spark, sf_dir, "independent_rows")
    return difference.differences(left, right, ROW_KEY, [*CELLS, "raw_direction", "issues"], extras)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case counts once a key, however often either reading repeats the row."""
    return _compared(spark, sf_dir, extras=False)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the rows that one reading holds more often."""
    return _compared(spark, sf_dir, extras=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_rows": p6_rows,
    "p7_found": p7_found,
    "p7_report": p7_report,
}
def _reading_sql(name: str) -> str:
    cells = ", ".join(f"{canon.field_sql(n, f'cell_values[{k + 1}]', spaced=True)} AS {n}" for k, n in enumerate(CELLS))
    pairs = "list_sort(list_distinct(list_transform(issues, lambda x: trim(coalesce(x.field_name,''), ' ') || chr(31) || trim(coalesce(x.kind,''), ' '))))"
    return f"SELECT DISTINCT {', '.join(ROW_KEY)}, {cells}, {canon.field_sql('', 'raw_direction', spaced=True)} AS raw_direction, coalesce(array_to_string({pairs}, chr(30)), '') AS issues FROM {name}"


def _found_sql() -> str:
    """For tables whose repeated rows agree, as those of the problem do."""
    fields, key = [*CELLS, "raw_direction", "issues"], ", ".join(ROW_KEY)
    values = " UNION ALL ".join(f"SELECT {key}, 'VALUE' AS diff_kind, '{f}' AS field_name FROM l JOIN r USING ({key}) WHERE l.{f} <> r.{f}" for f in fields)
    alone = lambda a, b, kind: f"SELECT DISTINCT {key}, '{kind}', '' FROM {a} WHERE ({key}) NOT IN (SELECT ({key}) FROM {b})"
    return f"WITH l AS ({_reading_sql('assembled_rows')}), r AS ({_reading_sql('independent_rows')}) {values} UNION ALL {alone('l', 'r', 'LEFT_ONLY')} UNION ALL {alone('r', 'l', 'RIGHT_ONLY')}"


ORACLE_SQL: dict[str, str] = {"p7_found": _found_sql()}
