"""Cases beyond former bounds, hot groups and votes of the training-data operators."""

from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import confusables, leakage, mapping, mixing, names, quality, representative


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", min_size=5, max_size=14), st.data())
def test_any_key_within_the_edits_shares_an_entry(word, data):
    k = names.edits_by_length(False, len(word))
    other = list(word)
    for _ in range(data.draw(st.integers(0, k))):
        what, p = data.draw(st.sampled_from("idsw")), data.draw(st.integers(0, len(other) - 1))
        if what == "i":
            other.insert(p, data.draw(st.sampled_from("abcd")))
        elif what == "d" and len(other) > 1:
            del other[p]
        elif what == "s":
            other[p] = data.draw(st.sampled_from("abcd"))
        elif p + 1 < len(other):
            other[p], other[p + 1] = other[p + 1], other[p]
    other = "".join(other)
    if other and names.edit_distance(word, other, k) <= k and names.edits_allowed("P", other):
        assert names.entries_of(word) & names.probes_of(other)


def test_long_names_are_linked_and_large_entities_paired_whole(spark):
    long = "wonderfulbrand" * 12
    rows = [(k, f"{long[:-3]}{'x' * (k == 1)}{long[-3:]} Foods Ltd", None, None, "c", None, None) for k in range(2)]
    linked = names.linked_rows(spark.createDataFrame(rows, "id long, n string, a array<string>, acc string, city string, f date, e timestamp"), "id", "n", "a", "acc", "city")
    assert linked.select("entity").distinct().count() == 1
    many = spark.range(1200).selectExpr("id", "1L AS entity")
    assert names.linked_pairs(many, "id").distinct().count() == names.linked_pairs(many, "id").count() == 1200 * 1199 // 2


def test_words_are_learnt_from_the_table(spark):
    brands = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "iris", "jasmine"]
    rows = [(f"{b} {line} Ltd",) for b in brands for line in ("Cobbling", "Weaving")] + [(f"甲{b}乙丙丁织造有限公司",) for b in "子丑寅卯辰巳午未申酉"]
    found = names.learnt_vocabulary(spark.createDataFrame(rows, "n string"), (), names.Vocabulary((), (), frozenset()))
    assert found.latin == ("cobbling", "weaving") and found.han == ("织造",)


OBS = "event_id string, obs_id string, account_number string, name string, conf double"


def test_equally_trusted_values_vote_and_hot_groups_give_the_same(spark, monkeypatch):
    values = ["Alpha Trade", "Alpha Trode", "Alpha Tradx", "Alpha Trade Co"]
    rows = [("e", f"o{k}", None, v, 0.9) for k, v in enumerate(values)] + [("e", "low", None, "Beta", 0.1), ("f", "p1", None, "x", 0.9), ("f", "p2", None, "y", 0.5), (None, "q", None, "z", None)]
    df = spark.createDataFrame(rows, OBS).withColumn("s", mapping.F.lit("")).withColumn("t", mapping.F.lit(None).cast("timestamp"))
    run = lambda: {(r.grp, r.field_name): (r.record, r.printed, r.n_values, r.voted) for r in representative.surviving_values(df, "event_id", "obs_id", representative.trust_order("s", "conf", "t"), ("account_number", "name")).collect()}
    want = {("e", "name"): ("o0", "Alpha Trade", 5, True), ("f", "name"): ("p1", "x", 2, False), (None, "name"): ("q", "z", 1, False)}
    assert run() == want
    monkeypatch.setattr(representative, "HOT_LEAST", 1)
    monkeypatch.setattr(representative, "HOT_SHARE", 4)
    assert run() == want


def test_blocks_of_values_are_a_tree(spark, monkeypatch):
    monkeypatch.setattr(representative, "BLOCK", 3)
    good = "transfer of goods"
    rows = [("e", f"o{k:02d}", None, good[:k] + "#" + good[k + 1 :], 0.5) for k in range(len(good))] + [("e", "zz", None, good, 0.5)]
    df = spark.createDataFrame(rows, OBS).withColumn("s", mapping.F.lit("")).withColumn("t", mapping.F.lit(None).cast("timestamp"))
    got = representative.surviving_values(df, "event_id", "obs_id", representative.trust_order("s", "conf", "t"), ("name",), dominant=False, torn_only=True).collect()
    assert [(r.record, r.printed) for r in got] == [("zz", good)]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_alignment_by_halves_is_least(a, b):
    whole = representative.edits(list(a), list(b))
    old, representative.MATRIX = representative.MATRIX, 4
    try:
        assert representative.edits(list(a), list(b)) == whole
    finally:
        representative.MATRIX = old


def test_very_long_values_are_aligned_in_little_memory():
    a = "x" * 3000 + "q" + "y" * 3000
    assert representative.edits(list(a), list("z" + a.replace("q", ""))) == 2


def test_marks_compose_as_the_standard_says(spark):
    texts = ["ó̝", "ệ", "á́", "ệ", "ḉ", "́a", "ộ́"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "k string, counterparty_name string")
    got = {r.k: r.canonical for r in confusables.normalise_lookalikes(df, "k", {"counterparty_name": "^$"}).collect()}
    for k, t in enumerate(texts):
        assert got.get(str(k), t) == unicodedata.normalize("NFC", t), t


def test_short_items_and_any_number_of_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "前言甲乙丙丁戊后语"), (2, "别的话" * 20), (3, None), (4, "the quick brown fox jumps over a lazy dog")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "甲乙丙丁戊"), (2, "quick brown fox jumps over the fence today"), (3, ""), (4, "毫不相干的句子在这里出现")], "item_id long, text string")
    want = {(1, 1), (4, 2)}
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == want
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 1)
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == want


def test_long_texts_are_tokenized_whole(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    text = "付款 transfer 12,345.67 " * 4000 + "a" * 30_000
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.TOKENIZER, "rb"))}
    coder = tiktoken.Encoding("public", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert mixing.token_counts(spark.createDataFrame([(text,)], "text string"), "text").first().tokens == len(coder.encode_ordinary(text))


def test_repeated_characters_are_junk_and_tables_are_not(spark):
    texts = ["的" * 300, "null," * 60, "日期  金额  余额\n" + "2024-01-02  1.00  2.00\n" * 9, "本院认为，被告应当归还借款，并承担利息。" * 3, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.kind_reason for r in quality.judge(docs, spark.createDataFrame([("的",), ("的",), ("应",), ("并",)], "word string")).collect()}
    assert got[0] == got[1] == "JUNK repeated" and got[2] == "TABLE columns" and got[4] is None and got[5] is None


def test_similarity_by_index_equals_comparing_all():
    listed = [("A", "First Harbour Bank"), ("B", "Second Harbour Trust"), ("C", "Meadow Credit"), ("D", "城南商业信用社")]
    m = mapping.CanonicalMatcher(listed, threshold=0.3)
    for typed in ("Frst Harbour Bnk", "meadow credt", "harbour", "城南信用", "zzz", "First " * 200):
        key = m._key(typed)
        best = m._most_similar(key)
        saved, m._by_token = m._by_token, {f: set(range(len(m._tokens))) for f in {x for t in m._tokens_of(key) for x in ((t,) if mapping._ideographic(key) else mapping._with_one_left_out(t))}}
        assert m._most_similar(key) == best, typed
        m._by_token = saved


