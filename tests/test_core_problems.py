"""Times, records and differences against small cases with known answers and against plain Python."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.operators import difference, records, timestamps

TX = "tx_id string, source_document_id string, transaction_time string, transaction_date string, zone string"


def _times(spark, rows, accounts):
    tx = spark.createDataFrame(rows, TX)
    acc = spark.createDataFrame(accounts, "source_document_id string, branch_zone string")
    out = timestamps.normalise_times(tx, acc, "tx_id", "transaction_time", "transaction_date", "source_document_id", "branch_zone")
    return {(r.tx_id, r.field_name): r.norm for r in out.collect()}


ACCOUNTS = [("cn", "Asia/Shanghai"), ("us", "America/New_York"), ("uk", "Europe/London"), ("odd", "Nowhere/Land")]
CASES = [
    ("cn", "2020-01-02 03:04:05", None), ("cn", "2020-01-02", None), ("us", "2020-01-02 03:04:05", "2020-01-02T08:04:05Z"),
    ("cn", "2020-01-02 03:04", "2020-01-01T19:04:00Z"), ("cn", "20200102030405", "2020-01-01T19:04:05Z"),
    ("cn", "1577934245", "2020-01-02T03:04:05Z"), ("cn", "1577934245999", "2020-01-02T03:04:05Z"),
    ("cn", "2020-01-02T03:04:05.999Z", "2020-01-02T03:04:05Z"), ("cn", "2020-01-02 03:04:05 UTC+8", "2020-01-01T19:04:05Z"),
    ("us", "2020-11-01 01:30:00", "AMBIGUOUS"), ("us", "2020-11-01 01:30:00 EDT", "2020-11-01T05:30:00Z"), ("us", "2020-11-01 01:30:00 EST", "2020-11-01T06:30:00Z"),
    ("us", "2020-03-08 02:30:00", "NONEXISTENT"), ("cn", "2020-02-30 01:01:01", "INVALID"), ("cn", "2020-02-03 24:01:01", "INVALID"),
    ("cn", "??:??:??", "INVALID"), ("cn", "x" * 5000, "INVALID"), ("cn", "43831.5", "2020-01-01T04:00:00Z"),
    ("us", "01/02/2020 03:04:05", "2020-01-02T08:04:05Z"), ("uk", "01/02/2020 03:04:05", "2020-02-01T03:04:05Z"),
    ("cn", "Jan 2, 2020 12:04:05 AM", "2020-01-01T16:04:05Z"), ("cn", "2020-01-02 下午01:02:03", "2020-01-02T05:02:03Z"),
    ("cn", "2020年1月2日 03时04分05秒", "2020-01-01T19:04:05Z"), ("odd", "2020-01-02 03:04", "2020-01-01T19:04:00Z"), (None, "2020-01-02 03:04", "2020-01-01T19:04:00Z"),
]


def test_times(spark):
    rows = [(f"t{k}", doc, text, None, "clash") for k, (doc, text, _) in enumerate(CASES)] + [("t3", *CASES[3][:2], None, "again"), ("n", "cn", None, None, ""), ("e", "cn", "", "", "")]
    got = _times(spark, rows, ACCOUNTS)
    assert {k: got.get((f"t{k}", "transaction_time")) for k in range(len(CASES))} == {k: c[2] for k, c in enumerate(CASES)}
    assert not [k for k in got if k[0] in ("n", "e")]


def test_days(spark):
    cases = [("cn", "2020-01-02", None), ("cn", "2020-02-30", "INVALID"), ("cn", "20200102", "2020-01-02"), ("cn", "43832", "2020-01-02"), ("us", "01/02/2020", "2020-01-02"), ("uk", "01/02/2020", "2020-02-01"),
             ("cn", "2020-01", "INVALID"), ("cn", "2020-01-02T00:00:00", "2020-01-02"), ("cn", "02-Jan-2020", "2020-01-02"), ("uk", "25/12/2020", "2020-12-25"), ("cn", "无", "INVALID")]
    got = _times(spark, [(f"t{k}", d, None, t, "") for k, (d, t, _) in enumerate(cases)], ACCOUNTS)
    assert {k: got.get((f"t{k}", "transaction_date")) for k in range(len(cases))} == {k: c[2] for k, c in enumerate(cases)}


def test_times_of_empty_tables(spark):
    assert _times(spark, [], []) == {}
    assert _times(spark, [("a", "x", "2020-01-02 03:04", None, "")], []) == {("a", "transaction_time"): "2020-01-01T19:04:00Z"}


def test_local_times_match_the_zone_database(spark):
    zone, start = "Australia/Sydney", datetime(2021, 3, 25)
    local = [start + timedelta(hours=7 * k, minutes=11) for k in range(60)] + [datetime(2021, 4, 4, 2, 30), datetime(2021, 10, 3, 2, 30)]
    got = _times(spark, [(f"t{k}", "au", f"{t:%Y-%m-%d %H:%M:%S}", None, "") for k, t in enumerate(local)], [("au", zone)])
    for k, t in enumerate(local):
        early, late = (t.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(ZoneInfo("UTC")) for f in (0, 1))
        back = [x.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t for x in (early, late)]
        want = "NONEXISTENT" if not any(back) else f"{early:%Y-%m-%dT%H:%M:%SZ}" if early == late else "AMBIGUOUS"
        assert got[f"t{k}", "transaction_time"] == want


def test_month_order_is_learnt_from_the_source(spark):
    """A source whose country says day first, but most of whose values can only be month first, is read month first."""
    rows = [(f"t{k}", "uk", None, f"05/{13 + k % 15}/2020", "") for k in range(15000)] + [("x", "uk", None, "03/04/2020", "")]
    assert _times(spark, rows, [("uk", "Europe/London")])["x", "transaction_date"] == "2020-03-04"


GOOD = "a,b,c,2020-01-01,2020-01-01,IN,1.50,-2,t,n,x,y"
RECORDS = [
    (GOOD, None), (GOOD + "\r", None), ("﻿" + GOOD, None), (GOOD.replace("n,x", '"n, ""q""\n2",x'), None), (GOOD.replace("-2", ""), None), (GOOD.replace("1.50", " 1.50 "), None),
    (GOOD.replace("b,", 'b"b,'), "QUOTING"), (GOOD + '"', "QUOTING"), (GOOD.replace("b,", '"b,'), "QUOTING"), (GOOD.replace("b,", '"b"x,'), "QUOTING"),
    (GOOD + ",", "COLUMNS"), (GOOD.replace(",", "\t"), "COLUMNS"), (GOOD.replace("1.50", "1.505"), "AMOUNT"), (GOOD.replace("1.50", "-1"), "AMOUNT"), (GOOD.replace("1.50", ""), "AMOUNT"),
    (GOOD.replace("-2", "--"), "BALANCE"), (GOOD.replace("IN", "in"), "DIRECTION"), (GOOD.replace("1.50", "x").replace("-2", "x"), "AMOUNT"),
    (GOOD.replace("n,", '"' + "long, " * 500 + '",'), None), (GOOD.replace("n,", '"' + "long, " * 500 + ","), "QUOTING"),
]


def test_records(spark):
    rows = [(k, 2, t, "clash") for k, (t, _) in enumerate(RECORDS)] + [(900, 1, "not,a,row", ""), (901, 2, " \r", ""), (902, 2, None, ""), (903, 3, "", ""), (904, 2, "﻿", "")]
    parsed = records.parse_records(spark.createDataFrame(rows, "line_id bigint, record_no int, record_text string, reason string"), "line_id", "record_no", "record_text").collect()
    assert {r.line_id: r.reason for r in parsed} == {k: why for k, (_, why) in enumerate(RECORDS)}
    assert next(r.fields for r in parsed if r.line_id == 3)[9] == 'n, "q"\n2'


def _slow(text: str) -> list[str] | None:
    fields, field, state = [], "", "start"
    for ch in text:
        if ch == "," and state != "quoted":
            fields, field, state = [*fields, field], "", "start"
            continue
        field += ch
        if state == "quoted":
            state = "quote" if ch == '"' else state
        elif ch == '"':
            if state == "start":
                state = "quoted"
            elif state == "quote":
                state = "quoted"
            else:
                return None
        elif ch in " \t":
            state = {"quote": "closed"}.get(state, state)
        elif state in ("quote", "closed"):
            return None
        else:
            state = "bare"
    return None if state == "quoted" else [*fields, field]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='a", \n', max_size=700), max_size=5))
def test_tokenizer_equals_a_plain_state_machine(texts):
    assert [f for f, _ in records.tokenize(texts)] == [_slow(t) for t in texts]


LEFT = [("d", 1, "a", "b", ""), ("d", 1, "a", "b", ""), ("d", 2, "x", None, ""), ("d", 3, "p", "q", ""), (None, None, "n", "n", "")]
RIGHT = [("d", 1, "a", "b", ""), ("d", 2, "y", "", ""), ("d", 4, "r", "s", ""), (None, None, "n", "m", "")]


def _canon(spark, rows):
    from pyspark.sql import functions as F

    from tallyline.functions import canon

    df = spark.createDataFrame(rows, "k string, n int, f string, g string, row string")
    return df.select("k", "n", canon.trimmed(F.col("f")).alias("f"), canon.trimmed(F.col("g")).alias("g"), "row")


def test_differences(spark):
    found = difference.differences(_canon(spark, LEFT), _canon(spark, RIGHT), ["k", "n"], ["f", "g"])
    got = {tuple(r) for r in found.collect()}
    assert got == {("d", 2, "VALUE", "f"), ("d", 3, "LEFT_ONLY", ""), ("d", 4, "RIGHT_ONLY", ""), (None, None, "VALUE", "g")}
    none = _canon(spark, [])
    assert difference.differences(none, none, ["k", "n"], ["f", "g"]).count() == 0
    assert {r.diff_kind for r in difference.differences(_canon(spark, LEFT), none, ["k", "n"], ["f", "g"]).collect()} == {"LEFT_ONLY"}


@pytest.mark.parametrize(("name", "a", "b"), [("amount", "¥1,234.50", "1234.5"), ("transaction_date", "2020年1月2日", "20200102"), ("transaction_time", "05时29分19秒", "052919"), ("direction", "贷", "+"), ("account_number", "9900 0000", "9900-0000"), ("balance", "-0.00", "0")])
def test_printed_forms_are_one(spark, name, a, b):
    from pyspark.sql import functions as F

    from tallyline.functions import canon

    row = spark.range(1).select(canon.field(name, F.lit(a)).alias("a"), canon.field(name, F.lit(b)).alias("b")).first()
    assert row.a == row.b
