"""Strict files, declared chains, one-to-one choices, orders by balance, surplus rows, long records and unsettled mixtures."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline import session
from tallyline.functions import printed
from tallyline.operators import difference, events, records, sequence, timestamps
from tallyline.sources import readers, reports

HEAD = ",".join(readers.STRICT_HEADER)


def test_strict_files_tell_rows_from_errors(spark, tmp_path):
    row = "0001,n,b,,2020-01-01,IN,1.50,-2,t,p,a,c"
    files = {
        "good": f"﻿{HEAD}\r\n{row}\r\n\r\n" + row.replace("2020-01-01", "2020-13"), "bad": f"{HEAD}\n{row},x\n" + row.replace("1.50", "1.505") + "\n" + row.replace(",n,", ',"a\nb",'),
        "other": "a,b\n1,2\n", "alone": HEAD + "\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    rows, errors = readers.strict_rows(spark, str(tmp_path))
    name = lambda f: f.rsplit("/", 1)[-1][:-4]
    got = sorted((name(r.file), r.record_no, str(r.amount), str(r.balance), r.account_name, tuple(r.issues)) for r in rows.collect())
    assert got == [("bad", 4, "1.50", "-2.00", "a\nb", ()), ("good", 2, "1.50", "-2.00", "n", ()), ("good", 4, "1.50", "-2.00", "n", ("INVALID_DATE",))]
    assert sorted((name(r.file), r.record_no, r.reason) for r in errors.collect()) == [("alone", 1, "EMPTY"), ("bad", 2, "COLUMNS"), ("bad", 3, "AMOUNT"), ("other", 1, "HEADER")]


def test_records_are_split_outside_quotes():
    assert readers.split_records('a,"b\nc"\r\nd\re') == ['a,"b\nc"', "d", "e"] and readers.split_records("") == [] and readers.split_records("\n\n") == ["", ""]


def test_declared_duplicates_are_followed_to_the_end(spark):
    links = {"a": "b", "b": "c", "c": "d", "x": "y", "y": "z", "z": "x", "w": "x", "q": "gone", "s": "s"}
    rows = [(t, links.get(t, ""), t) for t in [*links, "d"]]
    got = {r.tx_id: r.representative for r in events.followed(spark.createDataFrame(rows, "tx_id string, dup_of string, representative string")).collect()}
    assert [got[t] for t in "abcd"] == ["d"] * 4 and got["q"] == "q" and got["s"] == "s"
    assert {got[t] for t in "xyzw"} <= {"x", "y", "z", "w"}  # a circle has no end; each of its rows still has one representative


def test_fast_pairs_take_the_first_row_left():
    pdf = pd.DataFrame([("i1", "o1", 0, "1", "3"), ("i1", "o2", 1, "1", "4"), ("i2", "o1", 0, "2", "3"), ("i2", "o2", 1, "2", "4"), ("i3", "o2", 0, "5", "4")], columns=["in_id", "out_id", "days", "in_at", "out_at"])
    assert events.first_later(pdf)[["in_id", "out_id"]].values.tolist() == [["i1", "o1"], ["i2", "o2"]]


def test_surplus_rows_equal_except_all(spark):
    rng = random.Random(3)
    rows = lambda n: [(rng.choice("abc"), rng.choice(["1", "2", None])) for _ in range(n)]
    left, right = rows(40), rows(40)
    schema = "k string, f string"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    counted = difference.occurrences(a, b, ["k"], ["f"])
    for more, less, x, y in (("n_left", "n_right", a, b), ("n_right", "n_left", b, a)):
        got = Counter({(r.k.k, r.row.f): r[more] - r[less] for r in counted.collect() if r[more] > r[less]})
        assert got == Counter((r.k, r.f) for r in x.exceptAll(y).collect())
    extra = difference.differences(a, b, ["k"], ["f"], extras=True)
    assert set(difference.differences(a, b, ["k"], ["f"]).collect()) == {r for r in extra.collect() if not r.diff_kind.endswith("EXTRA")}


def test_many_versions_of_a_key_never_meet_all_with_all(spark):
    a = spark.createDataFrame([(None, str(i)) for i in range(2000)], "k string, f string")
    b = spark.createDataFrame([(None, str(i)) for i in range(1000, 4000)], "k string, f string")
    assert sorted(tuple(r) for r in difference.differences(a, b, ["k"], ["f"], extras=True).collect()) == [(None, "RIGHT_EXTRA", ""), (None, "VALUE", "f")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text('a,"\n ', max_size=3 * records.CHUNK), max_size=4))
def test_chunks_compose_as_one_pass(texts):
    def plain(text):
        state = records.START
        cuts = []
        for i, c in enumerate(text):
            kind = {",": records.COMMA, '"': records.QUOTE, " ": records.SPACE}.get(c, records.OTHER)
            state = int(records._NEXT[state, kind])
            if state == records.START and c == ",":
                cuts.append(i)
        return None if state in (records.FAILED, records.QUOTED) else [text[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(text)], strict=True)]

    assert [f for f, _ in records.tokenize(texts)] == [plain(t) for t in texts]


def test_slabs_keep_order_and_bound():
    texts = ["a" * n for n in (10, records.SLAB, 5, records.SLAB // 2, records.SLAB // 2 + 1)]
    parts = list(records.slabs(texts))
    assert sum(parts, []) == texts and [len(p) for p in parts] == [1, 1, 2, 1]


def test_values_alone_settle_the_order_of_day_and_month(spark):
    days = [("a", "25/03/2020"), ("a", "03/04/2020"), ("b", "03/04/2020"), ("c", "03/25/2020"), ("d", "03/04/2020"), ("e", "03/04/2020")]
    zones = {"a": "Europe/Berlin", "b": "Europe/Berlin", "c": "America/New_York", "d": "America/New_York", "e": "Asia/Tokyo"}
    rows = spark.createDataFrame([(s, None, d) for s, d in days] + [("a", None, "26/03/2020")] * 8 + [("c", None, "03/26/2020")] * 8, "s string, t string, d string")
    accounts = spark.createDataFrame(list(zones.items()), "s string, z string")
    share = {r.s: r.month_first for r in timestamps.source_profiles(rows, accounts, "s", "z", ("t", "d"), customs=False).collect()}
    assert share["a"] < 0.1 and share["b"] < 0.1 and share["c"] > 0.9 and share["d"] > 0.9 and 0.1 < share["e"] < 0.9
    assert timestamps.source_profiles(rows, accounts, "s", "z", ("t", "d")).where("s = 'e'").first().month_first < 0.1


def test_a_source_with_evidence_of_its_own_leaves_its_zone(spark):
    rows = spark.createDataFrame([("a", None, "25/03/2020")] * 200 + [("b", None, "03/25/2020")] * 200, "s string, t string, d string")
    accounts = spark.createDataFrame([("a", "Europe/Berlin"), ("b", "Europe/Berlin")], "s string, z string")
    share = {r.s: r.month_first for r in timestamps.source_profiles(rows, accounts, "s", "z", ("t", "d")).collect()}
    assert share["a"] < 0.1 and share["b"] > 0.9


def test_printed_order_stays_where_dates_break_more_balances():
    day = lambda n: datetime.date(2020, 1, n)
    rows = [{"tx_id": t, "d": day(d), "clock": "", "dir": "IN", "amt": 10.0, "bal": b} for t, d, b in (("a", 1, 10.0), ("b", 9, 20.0), ("c", 3, 30.0))]
    assert [r["tx_id"] for r in sequence._chronological(rows)] == ["a", "b", "c"]


def test_hashes_follow_utf16(spark):
    def lanes(text):
        a, b = 2166136261, 2246822507
        units = np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist()
        for i, u in enumerate(units):
            a, b = ((a ^ u) * 16777619) % 2**32, ((b ^ (u + i)) * 3266489909) % 2**32
        return f"{a:08x}{b:08x}"

    texts = ["", "执行a", "😀x", "z" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(printed.two_lane_hash("t")).collect()] == [lanes(t) for t in texts]


def test_a_checkpoint_folder_is_demanded_on_clusters():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_workbook_tables_are_written(spark, tmp_path):
    from tallyline.operators.ledger import read_ledger

    tables = reports.workbook_tables(read_ledger(spark, "/root/testdata/sf0.001"))
    assert list(tables) == ["overview", "review_issues", "clues", "hidden_assets", "repayment_checks", "ledger", "counterparties"]
    reports.write_tables({k: tables[k] for k in ("overview", "counterparties")}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/overview").count() == 1
    assert readers.table_of(spark, f"{tmp_path}/counterparties").columns[0] == "cp_key"
