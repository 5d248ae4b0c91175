"""Cases of the review findings on the llm operators: each would fail on the code before its finding was settled."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pandas as pd

from tallyline.llm import mapping, queries, representative


def test_a_mistyped_bank_is_found_in_a_long_text():
    m = mapping.CanonicalMatcher([("B1", "招商银行")], [], decorations=mapping.BANK_DECORATIONS, kinds=True)
    assert m.resolve("甲" * 20 + "招尚银行") == "B1" and m.resolve("甲" * 300 + "招尚银行") == "B1"


def _observations(spark, tmp_path, rows):
    """Rows of an event, a record, a counterparty's name and a confidence."""
    base = spark.read.parquet("/root/testdata/sf0.001/observations.parquet").schema
    empty = dict.fromkeys(base.names) | {"extracted_at": datetime(2025, 1, 1)}
    data = [empty | {"event_id": e, "obs_id": o, "counterparty_name": n, "extraction_confidence": c} for e, o, n, c in rows]
    spark.createDataFrame([tuple(r[n] for n in base.names) for r in data], base).write.parquet(f"{tmp_path}/observations.parquet")
    return str(tmp_path)


def _both(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW observations AS FROM '{folder}/observations.parquet/*.parquet'")
    return sorted(map(tuple, queries.p2_found(spark, folder).collect())), sorted(con.sql(queries.ORACLE_SQL["p2_found"]).fetchall())


def test_survivors_of_equal_trust_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    rows = [("e", "o1", "Alpha", 0.9), ("e", "o2", "Beta", 0.9), ("e", "o3", "Beta", 0.9), ("e", "o4", "Gamma", 0.1)]
    rows += [("f", "o6", "Beta", 0.9), ("f", "o5", "Alpha", 0.1), ("f", "o7", "Alpha", 0.9)]
    rows += [("g", f"o{k:03d}", f"name {k % 41}", 0.5) for k in range(120, 0, -1)]
    folder = _observations(spark, tmp_path, rows)
    got, want = _both(spark, folder)
    assert got == want == [("e", "counterparty_name", "o1"), ("f", "counterparty_name", "o6"), ("g", "counterparty_name", "o001")]
    monkeypatch.setattr(representative, "HOT_LEAST", 1)
    monkeypatch.setattr(representative, "HOT_SHARE", 4)
    assert _both(spark, folder)[0] == want


def test_every_torn_field_is_settled_by_the_vote(spark, tmp_path, monkeypatch):
    folder = _observations(spark, tmp_path, [("e", "o1", "Alpha", 0.9), ("e", "o2", "Beta", 0.5), ("f", "o3", "Gamma", 0.9), ("f", "o4", "Gamma", 0.1)])
    assert [r.obs_id for r in queries.p2_found(spark, folder).collect()] == ["o1"]
    last = lambda texts, records, candidates: pd.Series([0 if t is None else len(t) - 1 for t in texts], dtype="int32")
    last.__annotations__ = {"texts": pd.Series, "records": pd.Series, "candidates": pd.Series, "return": pd.Series}
    monkeypatch.setattr(representative, "_elect", last, raising=False)
    assert [r.obs_id for r in queries.p2_found(spark, folder).collect()] == ["o2"]


def test_the_most_trusted_outweigh_all_others_and_the_others_settle_what_they_leave():
    assert representative.elect(["abc", "xyz", "xyz"], [1, 900, 70], 1) == 0
    assert representative.elect(["abd", "abc", "xbc"], [1, 1, 1], 2) == 1
    assert representative.elect(["Alpha Trode", "Alpha Trade", "Alpha Tradx"], [1, 1, 1], 3) == 1
