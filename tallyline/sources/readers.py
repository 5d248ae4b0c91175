"""Readers and writers: strict and loose CSV, HTML tables, workbooks, JSON cases, documents by content, CSV and case output."""

from __future__ import annotations

import html
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators import records
from tallyline.operators.records import COLUMNS

#: The header of the strict form, in order.
STRICT_HEADER = (
    "accountNumber", "accountName", "bankName", "transactionTime", "transactionDate", "direction",
    "amount", "balance", "transactionType", "counterpartyName", "counterpartyAccount", "counterpartyBank",
)
#: Words in the headers of printed tables and the fields they mean.
HEADER_WORDS = {
    "transaction_date": ("交易日期", "记账日期", "日期", "date"), "transaction_time": ("交易时间", "时间", "time"), "amount": ("交易金额", "发生额", "金额", "amount"),
    "balance": ("余额", "balance"), "direction": ("借贷标志", "收支", "方向", "借贷", "dir"), "counterparty_name": ("对方户名", "对手方", "对方名称", "户名", "party"),
    "counterparty_account": ("对方账号", "对手账号"), "summary": ("摘要", "附言", "备注", "用途", "remark"),
}
MAX_SPAN = 100


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC01: ``(file, record_no, record_text)`` of comma-separated files. Line ends outside quotes part records; CR, LF and CRLF
    are one, a byte-order mark is dropped, and a last record without a line end counts. Each file is one task's work."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, text in zip(pdf["file"], pdf["text"], strict=True):
                out += [(name, k, r) for k, r in enumerate(split_records(text), 1)]
            yield pd.DataFrame(out, columns=["file", "record_no", "record_text"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return files.mapInPandas(split, "file string, record_no int, record_text string")


def split_records(text: str) -> list[str]:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    # a line end parts records where an even number of quotes precedes it
    out, start, quotes = [], 0, 0
    for m in re.finditer('["\n]', text):
        if m[0] == '"':
            quotes += 1
        elif quotes % 2 == 0:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]] if start < len(text) else out


def _strict_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = file_records(spark, path)
    heads = parts.where(F.col("record_no") == 1).select("file", (F.regexp_replace("record_text", '[" ]', "") == ",".join(STRICT_HEADER)).alias("strict"))
    body = parts.join(heads, "file").where(F.col("strict")).withColumn("id", F.concat_ws("#", "file", "record_no"))
    return heads, body, records.parse_records(body, "id", "record_no", "record_text")


def strict_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC03: the twelve columns, as texts, of the records of strict files that load."""
    parsed = _strict_parts(spark, path)[2].where(F.col("reason").isNull())
    return parsed.select(*(F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(COLUMNS)))


def strict_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC03: the typed rows of strict twelve-column files, and their errors ``(file, record_no, reason, offset)``. A file whose
    first record isn't the twelve names has one error, ``HEADER``, and no rows; one with a header alone has ``EMPTY``; a day
    that is none is kept as printed, with the issue ``INVALID_DATE``."""
    heads, body, parsed = _strict_parts(spark, path)
    typed = records.valid_rows(parsed, "id").withColumn("day", F.when(F.col("transaction_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("transaction_date")).try_cast("date"))
    rows = typed.withColumn("issues", F.when(F.col("day").isNull(), F.array(F.lit("INVALID_DATE"))).otherwise(F.array().cast("array<string>")))
    place = lambda df: df.withColumn("file", F.regexp_replace("id", r"#\d+$", "")).withColumn("record_no", F.regexp_extract("id", r"#(\d+)$", 1).cast("int")).drop("id")
    bad = place(records.rejected_rows(parsed, "id").withColumnRenamed("at", "offset")).select("file", "record_no", "reason", "offset")
    named = heads.where(~F.col("strict")).select("file", F.lit(1).alias("record_no"), F.lit("HEADER").alias("reason"), F.lit(0).alias("offset"))
    counts = body.groupBy("file").agg(F.max("record_no").alias("n"))
    empty = counts.where(F.col("n") == 1).select("file", F.lit(1).alias("record_no"), F.lit("EMPTY").alias("reason"), F.lit(0).alias("offset"))
    return place(rows), bad.unionByName(named).unionByName(empty)


def strict_summary(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SRC04: per account and bank of a strict file its rows, money, days and balances; the balance before the first row is
    inferred, and the account balances if that and the movements give the last."""
    move = F.when(F.col("direction") == "IN", F.col("amount")).when(F.col("direction") == "OUT", -F.col("amount")).otherwise(0)
    total = lambda side: F.coalesce(F.sum(F.when(F.col("direction") == side, F.col("amount"))), F.lit(0)).cast("decimal(28,2)")
    at = F.when(F.col("balance").isNotNull(), F.struct("transaction_date", "transaction_time", order))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), total("IN").alias("total_in"), total("OUT").alias("total_out"), F.min("transaction_date").alias("start_date"), F.max("transaction_date").alias("end_date"),
        F.min_by((F.col("balance") - move).cast("decimal(20,2)"), at).alias("start_balance"), F.max_by(F.col("balance").cast("decimal(20,2)"), at).alias("end_balance"),
    )
    diff = (F.col("start_balance") + F.col("total_in") - F.col("total_out") - F.col("end_balance")).cast("decimal(28,2)")
    return out.withColumn("difference", diff).withColumn("is_balanced", F.coalesce(diff == 0, F.lit(False)))


#: The short keys of recorded extractions and what they stand for.
SHORT_KEYS = {"ac": "acct", "bk": "bank", "p": "page", "r": "rowno", "tm": "tm", "dir": "dir", "amt": "amt", "bal": "bal", "cp": "cp_name"}


def recorded_rows(df: DataFrame, key: str, text: str, total_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC13: the rows of recorded extractions ``{"n": declared, "rows": [...]}`` in short keys, without those beyond the last
    page, and a warning where their number isn't the declared one."""
    one = "ac string, bk string, p int, r int, tm string, dir string, amt decimal(18,2), bal decimal(18,2), cp string"
    parsed = df.select(key, F.from_json(F.col(text), f"n int, rows array<struct<{one.replace(' string', ': string').replace(' int', ': int').replace(' decimal', ': decimal')}>>").alias("j"))
    rows = parsed.select(key, F.explode("j.rows").alias("x")).select(key, *(F.col(f"x.{a}").alias(b) for a, b in SHORT_KEYS.items()))
    rows = rows.where(F.col("page") <= total_pages) if total_pages else rows
    found = parsed.select(key, F.col("j.n").alias("declared"), F.coalesce(F.size("j.rows"), F.lit(0)).alias("found"))
    return rows, found.where(F.coalesce(F.col("declared") != F.col("found"), F.lit(True)))


def table_of(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: a comma-separated table with a header, all columns texts, byte-order mark aside."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


#: Fixed value: a printed row: serial number, owner, account, day, time, side, amount and balance.
ANCHOR = r"(?m)^\s*(\d{1,5})\s+(\S+)\s+(\d{10,30})\s+.*?(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})[\s\S]*?(借|贷)\s+([\d,.]+)\s+([\d,.]+)"


def text_anchors(df: DataFrame, key: str, text: str) -> DataFrame:
    """SRC16: the printed rows of page texts by their anchors, one a match."""
    parts = lambda k: F.regexp_extract_all(F.col(text), F.lit(ANCHOR), F.lit(k))
    names = ("serial", "owner", "account", "day", "clock", "side", "amount", "balance")
    zipped = F.arrays_zip(*(parts(k).alias(n) for k, n in enumerate(names, 1)))
    return df.select(key, F.explode(zipped).alias("a")).select(key, *(F.col(f"a.{n}").alias(n) for n in names))


def unread_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """SRC16: pages to look at: those without text, and those with dates but no row that can be told."""
    empty, dated = F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.col(text).rlike(r"\d{4}[-/]\d{2}[-/]\d{2}") & ~F.col(text).rlike(ANCHOR)
    return df.select(key, F.when(empty, "NO_TEXT").when(dated, "DATES_WITHOUT_ROWS").alias("reason")).where(F.col("reason").isNotNull())


#: The headers a table of transactions must have, and what its rows start with.
ROW_HEADERS = (r"交易日期|交易时间|记账日期|记账时间|入账日期|发生日期", r"交易金额|发生额|借方金额|贷方金额|收入金额|支出金额|转入金额|转出金额", r"余额")
ROW_START = r"^(?:\d{1,3}|20\d{6}|20\d{2}[-/]\d{2}[-/]\d{2}(?:\s+\d{2}:\d{2}:\d{2})?)$"


def counted_table_rows(df: DataFrame, key: str, text: str, headers: tuple[str, ...] = ROW_HEADERS) -> DataFrame:
    """AGG19: rows of each page whose first cell is a serial number or a day, in tables with headers of day, amount and balance."""
    tables = F.filter(F.regexp_extract_all(F.col(text), F.lit(r"(?is)<table\b.*?</table>"), F.lit(0)), lambda t: t.rlike(headers[0]) & t.rlike(headers[1]) & t.rlike(headers[2]))
    rows = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))))
    first = F.transform(rows, lambda r: F.trim(F.regexp_replace(F.regexp_extract(r, r"(?is)<td[^>]*>(.*?)</td>", 1), "<[^>]*>", "")))
    return df.where(F.col(text).rlike(r"(?i)<table\b")).select(key, F.size(F.filter(first, lambda c: c.rlike(ROW_START))).alias("n_rows"))


def loose_header(rows: list[list[str]], within: int = 25) -> tuple[int, dict[str, int]] | None:
    """SRC02, SRC08: the first row that names a date and an amount, and where each known field stands in it."""
    for k, row in enumerate(rows[:within]):
        found: dict[str, int] = {}
        for field, words in HEADER_WORDS.items():
            for word in words:
                at = next((i for i, cell in enumerate(row) if i not in found.values() and word in (cell or "").lower()), None)
                if at is not None:
                    found[field] = at
                    break
        if "amount" in found and ("transaction_date" in found or "transaction_time" in found):
            return k, found
    return None


_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|</table>|$)", re.S | re.I), re.compile(r"<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]>|$)", re.S | re.I)


def html_rows(text: str) -> list[list[str]]:
    """SRC07: the cells of every table row, spanned columns repeated, entities decoded; rows of empty cells are dropped."""
    out = []
    for row in _ROW.findall(text or ""):
        cells: list[str] = []
        for attributes, inner in _CELL.findall(row):
            span = re.search(r"colspan\s*=\s*[\"']?(\d+)", attributes, re.I)
            value = html.unescape(re.sub(r"<[^>]+>", "", inner)).strip()
            cells += [value] * max(1, min(MAX_SPAN, int(span[1]) if span else 1))
        if any(cells):
            out.append(cells)
    return out


def html_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """SRC07 to SRC09 over a column of markup: ``(key, rowno, cells, kind)``; kind tells tables with a known header."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                rows = html_rows(t)
                kind = "TRANSACTIONS" if loose_header(rows, 5) else "OTHER"
                out.append([{"rowno": k, "cells": cells, "kind": kind} for k, cells in enumerate(rows)])
            yield pd.Series(out)

    read_udf = F.pandas_udf(read, "array<struct<rowno: int, cells: array<string>, kind: string>>")
    marked = df.where(F.col(text).rlike(r"(?i)<t[rdh]\b"))
    return marked.select(key, F.explode(read_udf(F.col(text))).alias("r")).select(key, "r.rowno", "r.cells", "r.kind")


def workbook_rows(content: bytes) -> list[list[str]]:
    """SRC02, SRC05: the first sheet of an XLSX file by the standard library alone: shared, inline and formula texts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(z.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
    rows = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str] = {}
        for c in row.findall("m:c", ns):
            at = 0
            for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                at = at * 26 + ord(ch) - 64
            value = c.find("m:v", ns)
            inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            cells[at - 1] = shared[int(value.text)] if c.get("t") == "s" and value is not None else (value.text or "") if value is not None else inline
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: files with an identity that follows their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.concat(F.lit("DOC_"), F.sha2("content", 256)).alias("doc"))


def json_case(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC12: a case backup; one without an id fails."""
    reader = spark.read.option("multiLine", True)
    case = (reader.schema(schema) if schema else reader).json(path)
    return case.where(F.when(F.col("metadata.id").isNotNull(), True).otherwise(F.raise_error(F.lit("a case backup without an id"))))


def write_strict_csv(df: DataFrame, path: str) -> None:
    """SNK04: the twelve columns with their header, quoted where needed, in UTF-8."""
    named = df.select(*(F.col(c).cast("string").alias(h) for c, h in zip(COLUMNS, STRICT_HEADER, strict=True)))
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
