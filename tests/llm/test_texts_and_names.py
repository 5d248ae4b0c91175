"""Names, leaked passages, mixtures and text statistics, each against plain Python or exact invariants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import leakage, mixing, names, quality

PARTY = "counterparty_id bigint, cp_name string, aliases array<string>, account string, city string, entity string"


def _groups(spark, rows):
    linked = names.linked_rows(spark.createDataFrame(rows, PARTY), "counterparty_id", "cp_name", "aliases", "account", "city")
    return {(r.counterparty_id_1, r.counterparty_id_2) for r in names.linked_pairs(linked, "counterparty_id").collect()}


def _together(*groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_names(spark):
    rows = [
        (1, "海砚苒汐蔚淮家居股份有限公司", ["海砚苒汐蔚淮家居"], None, "海砚", ""), (2, "苒汐蔚淮(海砚)家居有限公词", None, None, None, ""), (3, "海砚苒夕蔚淮家居/代付", [], "", "海砚", ""),
        (4, "海砚苒汐蔚淮物流有限公司", None, None, "海砚", ""), (5, "平蓟苒汐蔚淮家居有限公司", None, None, "平蓟", ""),
        (10, "Robert B. Roswimgludol", None, None, "白邑", ""), (11, "Roswimglduol, Bob", [None, ""], None, "白邑", ""), (12, "R. Roswimgludol", None, None, "白邑", ""), (13, "Thomas Roswimgludol", None, None, "白邑", ""),
        (14, "Robert Roswimgludol", None, None, "南岑", ""), (20, "宓钰梓(个人)", None, None, "东湄", ""), (21, "宓 钰 梓", None, None, "东湄", ""), (22, "宓钰栩", None, None, "东湄", ""),
        (30, "Twehulwimvek Ceramics GmbH", ["Twehulwimvek"], None, "石塬", ""), (31, "CERA. TWEHULWIMVEK Gesellschaft mbH", None, None, "石塬", ""), (32, "Twehulwimvek GmbH", None, None, "石塬", ""),
        (40, None, None, None, None, ""), (41, "", ["", None], None, "", ""), (42, "x" * 5000, None, None, None, ""), (43, "x" * 5000, None, None, None, ""), (20, "宓钰梓(个人)", None, None, "东湄", ""),
    ]
    # the initial R. with the surname fits one full group only, Robert of 白邑; Thomas and the other city are others
    assert _groups(spark, rows) == _together((1, 2, 3), (10, 11, 12), (20, 21), (30, 31, 32), (42, 43))
    assert _groups(spark, []) == set()


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, k):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert names.edit_distance(a, b, k) == min(d[len(a), len(b)], k + 1)


def test_every_variant_key_is_found(spark):
    rng = random.Random(5)
    keys = {"".join(rng.choice("abcdef") for _ in range(rng.randint(4, 12))) for _ in range(150)}
    for k in list(keys):
        at = rng.randrange(len(k) - 1)
        keys |= {k[:at] + k[at + 1 :], k[:at] + "z" + k[at:], k[:at] + k[at + 1] + k[at] + k[at + 2 :]}
    found = {(r.word, r.other) for r in names.variant_keys(spark.createDataFrame([("P", k) for k in keys], "kind string, word string")).collect()}
    allowed = lambda a, b: min(names.edits_allowed("P", a), names.edits_allowed("P", b))
    assert found == {(a, b) for a in keys for b in keys if a == b or allowed(a, b) and names.edit_distance(a, b, allowed(a, b)) <= allowed(a, b)}


def _texts(n, seed, alphabet, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]


HAN = "".join(chr(0x4E00 + 7 * k) for k in range(900))
PHRASE = "请阅读下面的材料并依据材料内容回答问题"


def test_leaks(spark):
    items = [PHRASE + t for t in _texts(8, 1, HAN, 200)] + _texts(3, 2, "abcdefghij ", 500)
    filler = _texts(1, 3, HAN, 400)[0]
    own = items[0][len(PHRASE) :]
    changed = "".join(c if k % 17 else "某" for k, c in enumerate(own))
    docs = [
        filler + items[0] + filler, filler + own[:90] + filler, filler + own[:70] + filler, PHRASE * 3 + filler, "，\n".join(changed[k : k + 9] for k in range(0, 200, 9)), own[100:] + filler[:50] + own[:100],
        items[8].upper().replace(" ", "​\n"), None, "", "。。", filler, own[20:90] + "某" * 40 + own[90:150],
    ]
    d = spark.createDataFrame([(k, t, k) for k, t in enumerate(docs)] + [(0, docs[0], 0)], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(100 + k, t) for k, t in enumerate(items)] + [(999, PHRASE), (998, None)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(d, i).collect())
    assert got == [(0, 100), (0, 100), (1, 100), (4, 100), (5, 100), (6, 108), (11, 100)]
    full = {r.doc_id: round(r.coverage, 2) for r in leakage.find_leaks(d, i).collect()}
    assert full[0] == 1.0 and full[5] == 0.5
    assert {r.doc_id: r.coverage for r in leakage.find_leaks(d, i, ordered=False).collect()}[5] == 1.0
    assert leakage.find_leaks(d, i.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), i).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 0x10FFFF), max_size=40), st.integers(1, 17))
def test_hashes_are_equal_exactly_for_equal_runs(codes, length):
    h = leakage.rolling_hashes(np.array(codes, np.uint32), length)
    assert len(h) == max(0, len(codes) - length + 1)
    runs = [tuple(codes[k : k + length]) for k in range(len(h))]
    assert all((h[i] == h[j]) == (runs[i] == runs[j]) for i in range(len(h)) for j in range(len(h)))


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=30), st.text("ab", max_size=30))
def test_tiles_are_common_and_disjoint(a, b):
    index = leakage.SeedIndex([(1, a)], 3, 40)
    at, _, place = index.hits(leakage._codes(b)) if len(b) else ([], [], [])
    diagonals: dict[int, list[int]] = {}
    for j, i in zip(at, place, strict=True):
        diagonals.setdefault(int(j) - int(i), []).append(int(i))
    tiles = leakage.tile(index.items[0], b, diagonals, 3)
    assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in tiles)
    left, right = [k for i, _, n in tiles for k in range(i, i + n)], [k for _, j, n in tiles for k in range(j, j + n)]
    assert len(set(left)) == len(left) and len(set(right)) == len(right)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(1, 9))
def test_splitting_tree_keeps_counts(counts, shards):
    dealt = mixing.split_tree(np.array(counts), shards, np.random.default_rng(1))
    assert dealt.shape == (shards, len(counts)) and (dealt.sum(axis=0) == counts).all() and (dealt >= 0).all()
    sizes = dealt.sum(axis=1)
    assert sizes.max() - sizes.min() <= max(1, int(np.ceil(np.log2(shards))))


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(k, s, "word " * rng.randint(20, 60), "clash") for k, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["small"] * 40 + ["other"] * 50)] + [(9001, "small", None, ""), (9002, None, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.25, 2), ("small", 0.25, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeat int")
    mixed = mixing.mix_sources(docs, targets, shards=4)
    report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(report["big"].actual_share - 0.5) < 0.01 and abs(report["small"].actual_share - 0.25) < 0.01 and report["absent"].tokens == 0
    used: dict[int, list[int]] = {}
    for r in mixed.collect():
        used.setdefault(r.doc_id, []).append(r.copy)
    most = {"big": 1, "mid": 2, "small": 3}
    assert all(len(c) == len(set(c)) <= most[rows[d][1]] if d < 9000 else True for d, c in used.items())
    assert {len(c) for d, c in used.items() if 800 <= d < 840} == {3}
    assert {r.shard for r in mixed.collect()} == {0, 1, 2, 3}
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0


PROSE = "经查，被执行人名下的账户在该日向对手方转出款项，附言为定金。\n上述事实有交易明细和询问笔录为证，可以相互印证。"
KINDS = [
    (PROSE, None), (PROSE.replace("，", "，\n"), None), ("问：你是否收到？\n答：收到了，但没有申报该账户。\n问：为什么？\n答：因为长期不用而被遗漏。", None),
    ("The bank replied that the account had been closed and that it was not in use.", None), ("日期,方向,金额\n" + PROSE, None),
    ("\n".join(f"{k}、手续费{k}" for k in range(9)), "LIST"), ("利息、工资、房租、保费、退款、定金", "LIST"), ("cash, loan, rent, Foo Bar, levy", "LIST"), ("\n".join(["还款：12.00", "年费", "利息", "保费", "结息"]), "LIST"),
    ("\n".join(f"2020-01-0{k}\tIN\t{k}.00\t货款" for k in range(1, 9)), "TABLE"), ("<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>", "TABLE"), ("| a | b |\n| 1 | 2 |\n| 3 | 4 |", "TABLE"),
    ("\n".join(f"a{k}   b{k}   {k}.00" for k in range(5)), "TABLE"), ("�□■" * 20, "JUNK"), ("%$#@ !^& *()" * 9, "JUNK"), ("啊" * 80, "JUNK"), ("OK " * 50, "JUNK"), ("xkcd vbnm qwrt zxcv plkj" * 4, "JUNK"),
    ("袜郹綔穪柷螲渃佛肐鳝勅檄鴍鷒錘倾皆曌夫喻郛圸牎軴鲽硉愜枖", "JUNK"), (None, None), ("", None), (" \n", None), (PROSE * 400, None),
]


@pytest.mark.parametrize("words", [["的", "和", "被", "在", "为", "有", "与", "该", "了", "但", "并", "而", "the", "was", "that", "it", "in", "not", "had", "and"], []])
def test_kinds(spark, words):
    docs = spark.createDataFrame([(k, t, "clash") for k, (t, _) in enumerate(KINDS)], "doc_id int, text string, text_kind string")
    common = spark.createDataFrame([("x", w) for w in words], "lang string, word string")
    got = {r.doc_id: r.text_kind for r in quality.judge(docs, common).collect()}
    if words:
        assert got == {k: kind for k, (_, kind) in enumerate(KINDS)}
    else:
        assert got[0] is None and got[9] == "TABLE" and got[13] == "JUNK"
    assert quality.judge(docs.limit(0), common).count() == 0


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "The cat sat.\n* one\n* two\nthe end!")], "doc_id int, text string")
    r = quality.judge(docs, spark.createDataFrame([("the",)], "word string")).first()
    assert (r.n_lines, r.n_words, r.n_latin, r.common_share) == (4, 7, 7, 2 / 7)
    assert r.ended_share == 0.5 and r.mean_word_length == 3.0
