"""Cases of the review findings: each would fail on the code before its finding was settled."""

from __future__ import annotations

import datetime
import decimal
import threading

import duckdb

from tallyline.operators import alignment, flows, ledger, repair
from tallyline.plans import registry
from tallyline.plans.core import CELLS


def _ledger_dir(spark, tmp_path, rows):
    base = spark.read.parquet("/root/testdata/sf0.001/bank_transactions.parquet").schema
    empty = dict.fromkeys(base.names)
    data = [tuple((empty | {"source_document_id": "DOC", "ingested_at": datetime.datetime(2024, 1, 1)} | r)[n] for n in base.names) for r in rows]
    spark.createDataFrame(data, base).write.parquet(f"{tmp_path}/bank_transactions.parquet")
    accounts = spark.read.parquet("/root/testdata/sf0.001/accounts.parquet").schema
    spark.createDataFrame([], accounts).write.parquet(f"{tmp_path}/accounts.parquet")
    return str(tmp_path)


def test_ledger_reads_every_printed_day_and_amount(spark, tmp_path):
    day = datetime.date(2024, 1, 31)
    days = ["2024-01-31", "2024-01-31T00:00:00", "20240131", "2024.01.31", "2024/1/31", "2024年1月31日", "2024 年 1 月 31 日", "31-Jan-2024", "45322", "31/01/2024"]
    amounts = ["1,234.50", "¥1234.50", "1234．50", "１２３４．５０", " 1234.50", "1234.50 ", "1，234．50", "l234.5O", "​1234.50", "￥1,234.50元", "⒈234"]
    odd_days, odd_amounts = ["2024-02-30", "无", "2024-01", "01-31", ""], ["x", "", "1.2.3", "12-4"]
    rows = [{"tx_id": f"d{k}", "transaction_date": v} for k, v in enumerate(days + odd_days)] + [{"tx_id": f"a{k}", "amount": v} for k, v in enumerate(amounts + odd_amounts)]
    got = {r.tx_id: r for r in ledger.read_ledger(spark, _ledger_dir(spark, tmp_path, rows)).collect()}
    assert [got[f"d{k}"].d for k in range(len(days + odd_days))] == [day] * len(days) + [None] * len(odd_days)
    want = [decimal.Decimal("1234.50")] * (len(amounts) - 1) + [None] * (1 + len(odd_amounts))
    assert [got[f"a{k}"].amt for k in range(len(amounts + odd_amounts))] == want


def test_evaluation_matches_pair_absent_values_and_identical_rows(spark):
    # account, day, time, direction, amount, balance, name, counterparty account
    rows = {"1": ("a", "d", "t", "IN", "1", "1", "n", None), "2": ("a", "d", None, "IN", "2", "2", None, ""), "3": ("b", "d", "", "IN", "3", "", "", ""), "4": ("b", "d", "", "IN", "3", "", "", "")}
    left = spark.createDataFrame([(k, *v) for k, v in rows.items()], ["left_id", *CELLS])
    right = spark.createDataFrame([("7" + k, *(x or "" for x in v)) for k, v in rows.items()], ["right_id", *CELLS])
    got = alignment.evaluation_matches(left, right, list(CELLS), "left_id", "right_id").collect()
    assert sorted((r.left_id, r.right_id, r["pass"]) for r in got) == [("1", "71", 1), ("2", "72", 2), ("3", "73", 6), ("4", "74", 6)]


def test_party_totals_are_given_to_every_row(spark, tmp_path):
    rows = [{"tx_id": f"t{k}", "direction": "OUT", "counterparty_name": "n", "amount": v} for k, v in enumerate(["30000", "5", None])]
    got = registry.queries()["JON05_row_party_totals"](spark, _ledger_dir(spark, tmp_path, rows)).collect()
    assert sorted((r.tx_id, r.total_in, r.total_out) for r in got) == [(f"t{k}", 0, 30005) for k in range(3)]


def test_party_totals_fall_back_to_the_name(spark):
    rows = spark.createDataFrame([("t", "D", "", "622200001111", " 甲 乙 "), ("u", "D", "", "622200002222", "")], "tx_id string, doc string, cp_bank string, cp_acct string, cp_name string")
    summary = spark.createDataFrame([("name:甲乙", 1, 2)], "cp_key string, total_in int, total_out int")
    got = flows.row_party_totals(rows, summary).collect()
    assert sorted((r.tx_id, r.total_in, r.total_out) for r in got) == [("t", 1, 2), ("u", None, None)]


def test_one_digit_aliases_of_numbers_that_begin_alike(spark):
    numbers = spark.range(8000).selectExpr("concat('99000000', lpad(cast(id * 6173 % 100000000 as string), 8, '0')) AS account_number")
    planted = spark.createDataFrame([(n,) for n in ("9900000000006174", "99000000 00006179", "9900000000006179", "9900000100006173", "8900000000006173", "990000000000617", "99000001", None)], numbers.schema)
    sc = spark.sparkContext
    sc.setJobGroup("aliases", "one-digit aliases", interruptOnCancel=True)
    stop = threading.Timer(60, sc.cancelJobGroup, ["aliases"])
    stop.start()
    try:
        got = repair.one_digit_aliases(numbers.union(planted)).collect()
    finally:
        stop.cancel()
        sc._jsc.clearJobGroup()
    accounts = numbers.union(planted).toPandas()  # noqa: F841
    want = duckdb.sql(registry.oracle_sql()["JON10_one_digit_aliases"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 5
