"""Ledger queries against their SQL on the smallest tables, kernels against plain specifications, readers and streaming."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import zipfile
from itertools import combinations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.operators import alignment, events, sequence
from tallyline.plans import registry
from tallyline.sources import readers
from tallyline.streaming import ingest

DATA = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return repr(round(v, 9))
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=lambda r: tuple(x or "" for x in r))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def _row(k, doc="a", **more):
    base = {"tx_id": f"t{k:02d}", "doc": doc, "page": 1, "rowno": k, "clock": None, "bal": None, "n_cp": "", "n_sum": "", "n_name": "", "n_raw": "", "rep_score": 0}
    return base | more


def test_events_keep_documents_apart():
    rows = [_row(1, "a", bal=5), _row(2, "a", bal=5), _row(3, "b", bal=5), _row(4, "b", bal=6), _row(5, "c", bal=5, rep_score=9)]
    out = events.group_events(pd.DataFrame(rows))
    home = dict(zip(out["tx_id"], out["representative"], strict=True))
    # same-day equal amounts of one document are no duplicates; the fullest row represents; another balance never joins
    assert home == {"t01": "t05", "t03": "t05", "t05": "t05", "t02": "t02", "t04": "t04"}


def test_amount_and_day_alone_are_no_duplicate():
    out = events.group_events(pd.DataFrame([_row(1, "a", n_sum="工资"), _row(2, "b", n_sum="工资")]))
    assert sorted(out["representative"]) == ["t01", "t02"]


def _transfer(k, day, side, part, cp=""):
    return {"tx_id": f"t{k}", "doc": "d", "page": 1, "rowno": k, "d": datetime.date(2020, 1, 1) + datetime.timedelta(days=day), "dir": side, "amt": decimal.Decimal(5), "part": part, "n_cp": cp}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["IN", "OUT"]), st.sampled_from("xyz"), st.sampled_from(["", "x", "y", "z"])), max_size=8))
def test_netting_is_one_to_one_and_allowed(drawn):
    rows = [_transfer(k, *r) for k, r in enumerate(drawn)]
    out = events.net_group(pd.DataFrame(rows, columns=list(_transfer(0, 0, "IN", "x")))) if rows else pd.DataFrame(columns=["tx_id", "pair_id", "score"])
    used = [*out["tx_id"], *out["pair_id"]]
    assert len(set(used)) == len(used)
    by = {r["tx_id"]: r for r in rows}
    for a, b in zip(out["tx_id"], out["pair_id"], strict=True):
        x, y = by[a], by[b]
        assert x["dir"] != y["dir"] and x["part"] != y["part"] and abs((x["d"] - y["d"]).days) <= 2
        assert (x["n_cp"] in ("", y["part"])) and (y["n_cp"] in ("", x["part"])) and (x["n_cp"] or y["n_cp"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=4), st.lists(st.sampled_from("abc"), max_size=4))
def test_forced_pairs_are_in_every_best_alignment(a, b):
    import numpy as np

    score = np.array([[2 if x == y else 0 for y in b] for x in a]).reshape(len(a), len(b))
    cells = [(i, j) for i in range(len(a)) for j in range(len(b)) if score[i, j]]
    best, sets = 0, [set()]
    for n in range(1, min(len(a), len(b)) + 1):
        for chosen in combinations(cells, n):
            if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chosen, chosen[1:], strict=False)):
                total = sum(score[c] for c in chosen)
                if total > best:
                    best, sets = total, []
                if total == best:
                    sets.append(set(chosen))
    want = set.intersection(*sets) if best else set()
    assert set(alignment._forced(score)) == want


def test_days_are_turned_round_where_balances_say_so():
    day = datetime.date(2020, 1, 1)
    rows = [{"tx_id": t, "d": day, "clock": "", "dir": "IN", "amt": 10.0, "bal": b} for t, b in (("c", 40.0), ("b", 30.0), ("a", 20.0))]
    assert [r["tx_id"] for r in sequence._chronological(rows)] == ["a", "b", "c"]
    assert [r["tx_id"] for r in sequence._chronological(rows[::-1])] == ["a", "b", "c"]


def test_batches_never_pass_the_target_but_for_one_large_page():
    out = pd.concat(sequence.batched(iter([pd.DataFrame({"n_rows": [100, 90, 50, 400, 10]})])))
    assert list(out["batch"]) == [0, 1, 1, 2, 3]


def test_html_rows():
    text = "<table><tr><th>日期</th><th colspan=2>金额</th></tr><tr><td>1 &amp; 2</td><td></td><td>3</td></tr><tr><td> </td></tr></table>"
    rows = readers.html_rows(text)
    assert rows == [["日期", "金额", "金额"], ["1 & 2", "", "3"]]
    assert readers.loose_header(rows)[0] == 0 and readers.html_rows("") == [] and readers.loose_header([["x"]]) is None


def test_workbook(tmp_path):
    path = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>日期</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert readers.workbook_rows(path.read_bytes()) == [["日期", "", "1.5"], ["", "x"]]


def test_strict_csv_round_trip(spark, tmp_path):
    values = ["1", 'a "b"', "c\nd", "", "2020-01-01", "IN", "1.50", "-2", "t", "n, m", "x", "y"]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in readers.COLUMNS))
    readers.write_strict_csv(df, str(tmp_path / "out"))
    assert [v or "" for v in readers.strict_csv(spark, str(tmp_path / "out")).first()] == values


def test_stream_drops_repeats_and_equals_the_batch(spark, tmp_path):
    source = f"{DATA}/bank_transactions.parquet"
    (tmp_path / "in").mkdir()
    os.symlink(source, tmp_path / "in" / "part.parquet")
    rows = ingest.ledger_stream(spark, str(tmp_path / "in"), "3650 days")
    query = ingest.run_available(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(source).select("tx_id").distinct().count()


def test_cell_texts(spark):
    from pyspark.sql import functions as F

    from tallyline.functions import text as T

    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    lit = F.lit
    assert one(T.source_line(lit("a\nb"), 2)) == "b" and one(T.source_line(lit("a"), 2)) is None
    assert one(T.source_party(lit("6222 0000 1111 / 甲乙"), "account")) == "6222 0000 1111" and one(T.source_party(lit("6222 0000 1111 / 甲乙"), "name")) == "甲乙" and one(T.source_party(lit("甲 / 乙"), "name")) is None
    assert one(T.number_spacing(lit("- 1 , 234 . 50"))) == "-1,234.50"
    assert one(T.account_from_text(lit("卡号 62220000 金额 5"))) == "62220000" and one(T.account_from_text(lit("62220000 62221111"))) is None
    assert one(T.holder_name(lit("甲乙_银行流水.pdf"))) == "甲乙_" and one(T.semantic_text(lit("a　b\\n c"))) == "abc"
    box = T.page_region(lit(10.0), lit(20.0), lit(30.0), lit(40.0), lit(100.0), lit(200.0))
    back = one(T.turned_region(T.turned_region(box, 90), 270))
    assert [round(back[k], 9) for k in ("x", "y", "width", "height")] == [0.1, 0.1, 0.3, 0.2]
    assert one(T.page_region(lit(1.0), lit(1.0), lit(0.0), lit(1.0), lit(9.0), lit(9.0))) is None
