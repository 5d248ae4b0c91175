"""Canonical lists, look-alike text, and surviving records, each against plain Python."""

from __future__ import annotations

import unicodedata
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import confusables, mapping, representative

BANKS = [("B1", "曙岫银行"), ("B2", "曙岫商业银行"), ("B3", "曙岫农村商业银行"), ("B4", "澧垚商业银行")]
ENGLISH = [("B1", "Shuxiu Bank"), ("B2", "Shuxiu Commercial Bank"), ("B3", "Shuxiu Rural Commercial Bank"), ("B4", "Liyao Commercial Bank")]
TYPES = [("T1", "账户转账"), ("T2", "退款"), ("T3", "分期退款"), ("T4", "分期"), ("T5", "贷款还款"), ("T6", "贷款放款"), ("T7", "消费")]


def test_banks():
    m = mapping.CanonicalMatcher(BANKS, ENGLISH, decorations=mapping.BANK_DECORATIONS, kinds=True)
    want = {
        "曙岫银行.": "B1", "曙岫农商行": "B3", "商业银行(曙岫)": "B2", "银行(曙岫)": "B1", "署岫农村商业银行支行": "B3", "曙 岫 商 业 银 行": "B2", "Shuxi Bank": "B1", "LIYAO COMMERCIAL BANK": "B4",
        "Shuxiu Rural Comm. Bk": "B3", "澧垚": "B4", "曙岫": "NONE", "澧垚银行": "NONE", "澧垚行": "NONE", "农村商业银行(澧垚)": "NONE", "商业银行": "NONE", "苍弋银行": "NONE", "Old Pelham Bank": "NONE",
        "曙岫银行 曙岫商业银行": "NONE", "曙岫银行东湄32网点": "B1", " ": "NONE", "/": "NONE", "曙岫银行" + "x" * 5000: "B1",
    }
    assert {v: m.resolve(v) for v in want} == want


def test_types():
    m = mapping.CanonicalMatcher(TYPES, [("T1", "zhanghu zhuanzhang"), ("T2", "货款返还")], decorations=mapping.TYPE_DECORATIONS)
    want = {"转账账户": "T1", "账转账": "T1", "分其退款": "T3", "退欵": "T2", "#分期": "T4", "贷款環款": "T5", "货款放款": "T6", "放款贷款": "T6", "ZHANGHU zhuanzhang": "T1", "消费交易": "T7", "冲正": "NONE", "1023": "NONE", "??": "NONE"}
    assert {v: m.resolve(v) for v in want} == want
    assert mapping.CanonicalMatcher([]).resolve("x") == "NONE"


def test_mapping_of_a_table(spark):
    banks = spark.createDataFrame([(*b, None, e[1]) for b, e in zip(BANKS, ENGLISH, strict=True)], "ref_id string, bank_name string, short_name string, english_name string")
    types = spark.createDataFrame([(*t, ["x" + t[1]]) for t in TYPES], "ref_id string, type_name string, keywords array<string>")
    rows = [("a", "曙岫银行", "退款类", "clash"), ("b", None, "", ""), ("c", "曙岫行", None, ""), ("c", "曙岫行", None, ""), (None, "?", "账户转账", "")]
    df = spark.createDataFrame(rows, "tx_id string, bank_name string, transaction_type string, ref_id string")
    out = mapping.map_to_canonical(df, "tx_id", {"bank_name": mapping.bank_matcher(banks), "transaction_type": mapping.type_matcher(types)})
    assert {(r.tx_id, r.field_name, r.ref_id) for r in out.collect()} == {("a", "transaction_type", "T2"), ("c", "bank_name", "B1"), (None, "bank_name", "NONE")}
    assert out.limit(0).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit(a, b):
    near = {a} | {a[:k] + c + a[k + d :] for k in range(len(a) + 1) for c in ["", *"abc"] for d in (0, 1)}
    assert mapping.within_one_edit(a, b) == (b in near)


FORMS = [
    ("amount", "５0O.l2", "500.12"), ("amount", "1 000.00", "1000.00"), ("amount", "−￥5", "-¥5"), ("amount", "¥1,000.00", None), ("account_number", "99О0 ＊＊", "9900 **"), ("account_number", "9900 XX", None),
    ("counterparty_name", "Dаniel В. Smith", "Daniel B. Smith"), ("counterparty_name", "ООО Зарнивест", None), ("counterparty_name", "Café Z​", "Café Z"), ("counterparty_name", "Zoë", None),
    ("counterparty_name", "⽩邑　公司", "白邑 公司"), ("counterparty_name", "阿木尔•乌兰图", "阿木尔·乌兰图"), ("counterparty_name", "​", ""), ("counterparty_name", "ạ́x", unicodedata.normalize("NFC", "ạ́x")),
    ("counterparty_name", "ＡＴＭ", "ATM"), ("counterparty_name", "РОS收单", "POS收单"),
]


def test_forms(spark):
    rows = [(f"t{k}", *(v if f == c else None for c in confusables.PLAIN_FIELDS), "clash") for k, (f, v, _) in enumerate(FORMS)]
    rows += [rows[0], ("n", None, None, None, ""), ("e", "", "", "", ""), ("long", None, None, "​" + "木" * 3000, "")]
    df = spark.createDataFrame(rows, "tx_id string, amount string, account_number string, counterparty_name string, value string")
    got = {r.tx_id: (r.field_name, r.canonical) for r in confusables.normalise_lookalikes(df, "tx_id").collect()}
    assert got.pop("long") == ("counterparty_name", "木" * 3000)
    assert got == {f"t{k}": (f, want) for k, (f, _, want) in enumerate(FORMS) if want is not None}


def test_composition_equals_the_standard(spark):
    texts = ["é", "ȫx", "Å", "ññ", "ḉ", "q́"]
    df = spark.createDataFrame([(str(k), None, None, t) for k, t in enumerate(texts)], "tx_id string, amount string, account_number string, counterparty_name string")
    forms = confusables.canonical_text(confusables.suspicious(df, "tx_id"), "tx_id").collect()
    assert {r.tx_id: r.canonical for r in forms} == {str(k): unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}


OBS = "event_id string, obs_id string, amount string, counterparty_name string, review_status string, extraction_confidence double, extracted_at timestamp, value string"
DAY = datetime(2025, 1, 1)


def _survivors(spark, rows, **options):
    df = spark.createDataFrame(rows, OBS)
    order = representative.trust_order("review_status", "extraction_confidence", "extracted_at")
    out = representative.surviving_values(df, "event_id", "obs_id", order, fields=("amount", "counterparty_name"), **options)
    return {(r.grp, r.field_name): (r.record, r.printed, r.n_values) for r in out.collect()}


def test_survivors(spark):
    rows = [
        ("e", "o3", "1,000.00", "甲 公司", None, 0.9, DAY, ""), ("e", "o1", "1000", "甲公司", None, None, DAY, ""), ("e", "o2", "1001", "乙公司", "VERIFIED", 0.1, DAY, ""),
        ("e", "o2", "1001", "乙公司", "VERIFIED", 0.1, DAY, ""), ("f", "o4", "5", None, None, None, None, ""), ("f", "o5", " ", "", None, None, None, ""), ("g", "o6", None, None, None, None, None, ""),
        (None, "o7", "1", "x", None, 0.5, DAY, ""), (None, "o8", "2", "x", None, 0.5, DAY, ""),
    ]
    got = _survivors(spark, rows)
    assert got == {
        ("e", "amount"): ("o2", "1001", 2), ("e", "counterparty_name"): ("o2", "乙公司", 2), ("f", "amount"): ("o4", "5", 1), (None, "amount"): ("o7", "1", 2), (None, "counterparty_name"): ("o7", "x", 1),
    }
    assert _survivors(spark, []) == {}


def test_plain_votes_choose_the_value_closest_to_the_consensus(spark):
    names = ["Alpha Trade Ltd", "Alpha Trode Ltd", "Alpha Trade Lid", "Alpha Trade Ltd Co", "Beta"]
    rows = [("e", f"o{k}", None, n, None, 0.5, DAY, "") for k, n in enumerate(names)]
    assert _survivors(spark, rows, dominant=False)["e", "counterparty_name"] == ("o0", "Alpha Trade Ltd", 5)


def test_hot_group(spark):
    rows = [("hot", f"o{k:04d}", str(k % 7), f"name {k % 50}", "VERIFIED" if k == 1234 else None, 0.5, DAY, "") for k in range(2000)]
    got = _survivors(spark, rows)
    assert got["hot", "amount"][1] == str(1234 % 7)
    assert got["hot", "counterparty_name"] == ("o0034", "name 34", 50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_alignment_is_least(a, b):
    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(old[j - 1] + (c != d), old[j] + 1, row[-1] + 1))
        return row[-1]

    placed = representative.align(a, b)
    assert [t for _, t in placed if t] == b and representative.edits(a, b) == edits(a, b)
    assert [p for p, _ in placed] == sorted(p for p, _ in placed)
