"""Accounts and rows that are one: repeated rows of a document, accounts printed short or on another page, filled fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import printed as R
from tallyline.functions import text as T
from tallyline.operators.views import times_compatible

_SAME = ["doc", "d", "amt"]


def merged_chunks(rows: DataFrame) -> DataFrame:
    """ER12: rows read more than once, told by owner, page, row, time, direction, amount, balance and counterparty: the one
    read with the highest confidence stays, the smallest id where they are equal."""
    owner = F.when(T.is_reliable("acct"), F.concat(F.lit("account|"), T.identity_part("acct"))).otherwise(F.concat_ws("|", F.lit("unverified"), T.identity_part("bank"), T.identity_part("acct")))
    party = F.when(F.col("cp_acct") != "", F.col("cp_acct")).otherwise(F.col("cp_name"))
    keyed = rows.select("tx_id", F.coalesce("conf", F.lit(0.0)).alias("sure"), owner.alias("owner"), "page", "rowno", T.text("tm").alias("tm"), "dir", "amt", "bal", party.alias("party"))
    best = F.min_by("tx_id", F.struct(-F.col("sure"), F.col("tx_id")))
    return keyed.groupBy("owner", "page", "rowno", "tm", "dir", "amt", "bal", "party").agg(best.alias("tx_id"), F.count("*").alias("n_readings")).select("tx_id", "n_readings")


def _clock(c: Column) -> Column:
    return F.regexp_extract(T.text(c), r"(\d{2}:\d{2}(?::\d{2})?)", 1)


def repeats(a: str, b: str) -> Column:
    """ER05: whether two rows of one document with equal day and amount are the same printed row, by the list of decisions."""
    l, r = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))  # noqa: E741
    both = lambda c: (l(c) != "") & (r(c) != "")
    overlap = lambda c: both(c) & (l(c).contains(r(c)) | r(c).contains(l(c)))
    against = both("part") & (l("part") != r("part")) | (l("dir") != "UNKNOWN") & (r("dir") != "UNKNOWN") & (l("dir") != r("dir")) | both("clock") & ~times_compatible(l("clock"), r("clock"))
    balances, paged = l("bal").isNotNull() & r("bal").isNotNull(), (l("page") > 0) & (r("page") > 0)
    apart = paged & (l("page") != r("page"))
    far = F.abs(l("page") - r("page")) >= 2
    printed_twice = F.when(both("clock"), l("clock") == r("clock")).when(both("s"), overlap("s")).otherwise(far & (overlap("n") | (l("s") != "") | (r("s") != "")))
    on_page = both("clock") & (l("clock") == r("clock")) | both("s") & (l("s") == r("s")) | (l("s") == "") & (r("s") == "")
    unbalanced = F.when(paged & (l("page") == r("page")), (l("raw_text") != "") & (l("raw_text") == r("raw_text"))).otherwise(both("clock") & (l("clock") == r("clock")) & (F.length(l("clock")) == 8) | overlap("s") | overlap("n"))
    return ~against & F.when(balances, (l("bal") == r("bal")) & F.when(apart, printed_twice).otherwise(on_page)).otherwise(unbalanced)


def repeated_pairs(ledger: DataFrame) -> DataFrame:
    """ER05: ``(id_1, id_2)``, the earlier row of the document first."""
    rows = ledger.where(F.col("d").isNotNull() & F.col("amt").isNotNull()).select(
        "tx_id", *_SAME, "page", "rowno", "dir", "bal", "raw_text", T.identity_part("acct").alias("part"), _clock(F.col("tm")).alias("clock"), R.summary_text("summary").alias("s"), R.summary_text("cp_name").alias("n")
    )
    before = F.struct("a.page", "a.rowno", "a.tx_id") < F.struct("b.page", "b.rowno", "b.tx_id")
    met = rows.alias("a").join(rows.alias("b"), [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in _SAME), before])
    return met.where(repeats("a", "b")).select(F.col("a.tx_id").alias("id_1"), F.col("b.tx_id").alias("id_2"))


def first_matches(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows in order, each a repeat of the first representative it matches that its page hasn't matched yet."""
    matches: dict[str, list[tuple]] = {}
    for a, b in zip(pdf["id_1"], pdf["id_2"], strict=True):
        matches.setdefault(b, []).append(a)
    place = dict(zip(pdf["id_1"], pdf["at_1"], strict=True)) | dict(zip(pdf["id_2"], pdf["at_2"], strict=True))
    page = dict(zip(pdf["id_2"], pdf["page_2"], strict=True))
    repeat: dict[str, str] = {}
    used: set[tuple] = set()
    for row in sorted(matches, key=place.get):
        for target in sorted(matches[row], key=place.get):
            if target not in repeat and (page[row], target) not in used:
                repeat[row] = target
                used.add((page[row], target))
                break
    return pd.DataFrame({"tx_id": list(repeat), "representative": list(repeat.values())})


def repeated_rows(ledger: DataFrame) -> DataFrame:
    """ER04: ``(tx_id, representative)`` of the rows that repeat an earlier one of their document. Only rows with a match
    reach the kernel, one group of equal day and amount of a document at a time."""
    at = F.concat_ws("|", F.lpad(F.col("page").cast("string"), 9, "0"), F.lpad(F.col("rowno").cast("string"), 9, "0"), "tx_id")
    rows = ledger.select("tx_id", *_SAME, "page", at.alias("at"))
    pairs = repeated_pairs(ledger).join(rows.select(F.col("tx_id").alias("id_1"), *_SAME, F.col("at").alias("at_1")), "id_1").join(rows.select(F.col("tx_id").alias("id_2"), F.col("at").alias("at_2"), F.col("page").alias("page_2")), "id_2")
    return pairs.groupBy(*_SAME).applyInPandas(first_matches, "tx_id string, representative string")


def enriched(rows: DataFrame, group: str, order: list[str], fields: list[str], time: str) -> DataFrame:
    """ER06: the first row of each group of repeats, its empty fields filled from the next that has them, and the longest time."""
    at = F.struct(*order)
    fill = [F.min_by(F.col(f), F.when(T.text(f) != "", at)).alias(f) for f in fields]
    length = F.length(T.text(time))
    return rows.groupBy(group).agg(F.min(order[0]).alias("first"), F.count("*").alias("n"), *fill, F.min_by(T.text(time), F.struct(-length, *order)).alias(time))


def same_account(a: Column, b: Column, bank_a: Column, bank_b: Column) -> Column:
    """ER14: equal numbers, or one of at least twelve characters that ends the other, and banks that don't contradict."""
    n = (a == b) | (F.least(F.length(a), F.length(b)) >= 12) & (a.endswith(b) | b.endswith(a))
    bare = lambda c: F.regexp_replace(T.identity_part(c), "中国|股份有限公司|有限责任公司|银行", "")
    x, y = bare(bank_a), bare(bank_b)
    return (a != "") & (b != "") & n & ((x == "") | (y == "") | x.contains(y) | y.contains(x))


def same_account_pairs(accounts: DataFrame) -> DataFrame:
    """ER14: accounts of different documents that are one; the last twelve characters are the equality they are joined by."""
    rows = accounts.select("source_document_id", T.identity_part("account_number").alias("n"), "bank_name").withColumn("tail", F.right("n", F.lit(12)))
    met = rows.alias("a").join(rows.alias("b"), [F.col("a.tail") == F.col("b.tail"), F.col("a.source_document_id") < F.col("b.source_document_id")])
    return met.where(same_account(F.col("a.n"), F.col("b.n"), F.col("a.bank_name"), F.col("b.bank_name"))).select(F.col("a.source_document_id").alias("doc_1"), F.col("b.source_document_id").alias("doc_2"))


def evidenced_accounts(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """ER11: the account each row belongs to by evidence: the one reliable account listed for its page, else one listed for
    its document whose number is the row's, or ends it or is ended by it; '' without any."""
    listed = accounts.where(T.is_reliable("account_number")).select(F.col("source_document_id").alias("doc"), T.identity_part("account_number").alias("n"), "covered_pages")
    one = listed.select("doc", "n", F.explode("covered_pages").alias("page")).groupBy("doc", "page").agg(F.min("n").alias("local"), F.max("n").alias("other")).where(F.col("local") == F.col("other")).drop("other")
    rows = ledger.select("tx_id", "doc", "page", T.identity_part("acct").alias("part")).join(one, ["doc", "page"], "left")
    met = rows.join(listed.select("doc", "n"), "doc", "left")
    fits = (F.col("n") == F.col("part")) | (F.least(F.length("n"), F.length("part")) >= 12) & (F.col("n").endswith(F.col("part")) | F.col("part").endswith(F.col("n")))
    return met.groupBy("tx_id").agg(F.coalesce(F.max("local"), F.min(F.when(fits, F.col("n"))), F.lit("")).alias("account"))


def filled_banks(accounts: DataFrame, modes: DataFrame) -> DataFrame:
    """ER16: an absent bank is filled from the other reading; one that is there is never overwritten."""
    joined = accounts.join(modes, accounts["source_document_id"] == modes["doc"], "left")
    return joined.select("source_document_id", F.when(T.text("bank_name") != "", F.col("bank_name")).otherwise(F.coalesce("mode", F.lit(""))).alias("bank"), (T.text("bank_name") == "").alias("filled"))


def anchored_rows(ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """ER17: rows whose number isn't reliable take the page's one account; a reliable number that disagrees stays and is flagged."""
    rows = ledger.select("tx_id", "doc", "page", T.identity_part("acct").alias("part"), T.is_reliable("acct").alias("reliable")).join(pages.select("doc", "page", "account"), ["doc", "page"])
    state = F.when(F.col("account") == "", "NO_ANCHOR").when(~F.col("reliable"), "FILLED").when(F.col("part") == F.col("account"), "AGREES").otherwise("DISAGREES")
    return rows.select("tx_id", F.when(state == "FILLED", F.col("account")).otherwise(F.col("part")).alias("account"), state.alias("state"))


def stored_numbers(rows: DataFrame, full: DataFrame) -> DataFrame:
    """PRJ12: ``(doc, number, stored)``: a number printed without one to four leading digits, of ten at least, is stored as the
    one longest number of its source that ends with it; any other as itself."""
    a, b = rows.select("doc", "number").distinct(), full.select("doc", F.col("number").alias("long")).distinct()
    tail = lambda c: F.right(c, F.lit(10))
    gap = F.length("long") - F.length("number")
    met = a.withColumn("tail", tail("number")).join(b.withColumn("tail", tail("long")), ["doc", "tail"]).where((F.length("number") >= 10) & gap.between(1, 4) & F.col("long").endswith(F.col("number")))
    best = met.groupBy("doc", "number").agg(F.max(F.length("long")).alias("n"))
    longest = met.join(best, ["doc", "number"]).where(F.length("long") == F.col("n")).groupBy("doc", "number").agg(F.min("long").alias("least"), F.max("long").alias("most"))
    return a.join(longest, ["doc", "number"], "left").select("doc", "number", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.col("number")).alias("stored"))


def printed_aliases(pairs: DataFrame, inventory: DataFrame) -> DataFrame:
    """JON09: ``(card, account)`` where a printed card number stands beside one account alone, and that account is listed for
    the same holder. ``pairs`` has card, account and holder, ``inventory`` account and holder."""
    links = pairs.where(F.col("card") != "").groupBy("card", "holder").agg(F.min("account").alias("account"), F.max("account").alias("other")).where(F.col("account") == F.col("other")).drop("other")
    known = inventory.where((F.trim("holder") != "") & ~F.col("holder").rlike("待核|未知")).select("account", F.trim("holder").alias("holder")).distinct()
    return links.withColumn("holder", F.trim("holder")).join(known, ["account", "holder"], "left_semi").select("card", "account", "holder").distinct()


def bound_inventory(rows: DataFrame, inventory: DataFrame, least: int = 2) -> DataFrame:
    """JON12: a local number bound to the one listed account of its holder that ends with it, one to four digits longer, whose
    balance is that of the number's last row and whose day isn't before it. ``rows``: number, holder, d, bal and an order."""
    last = rows.where(F.col("d").isNotNull() & F.col("bal").isNotNull() & (F.col("holder") != "")).groupBy("number", "holder").agg(F.max(F.struct("d", "ord", "bal")).alias("z"), F.count("*").alias("n")).where(F.col("n") >= least)
    tail = lambda c: F.right(c, F.lit(12))
    a = last.where(F.col("number").rlike(r"^\d{12,28}$")).join(inventory.select(F.col("account").alias("number")), "number", "left_anti").withColumn("tail", tail("number"))
    b = inventory.select("account", "holder", "balance", "day").withColumn("tail", tail("account"))
    fits = F.col("account").endswith(F.col("number")) & (F.length("account") - F.length("number")).between(1, 4) & (F.col("balance") == F.col("z.bal")) & (F.col("day") >= F.col("z.d"))
    met = a.join(b, ["holder", "tail"]).where(fits)
    return met.groupBy("number", "holder").agg(F.min("account").alias("account"), F.max("account").alias("other")).where(F.col("account") == F.col("other")).drop("other")


def page_candidates(left: DataFrame, right: DataFrame, page: list[str], owner: str, day: str, time: str) -> DataFrame:
    """JON13, ASM11: ``(left_id, right_id, kind)`` of each left row: the one right row with its owner and exact time, else with
    its owner and day, else, on pages with one owner each, with its day; unique on both sides. Others are UNMATCHED where
    the other reading has no such row, else AMBIGUOUS."""
    passes = {"TIME": [owner, day, time], "DAY": [owner, day], "SINGLE": [day]}

    def counted(df: DataFrame, key: list[str], name: str) -> DataFrame:
        return df.where(F.concat(*(T.text(k) for k in key[-1:])) != "").groupBy(*page, *key).agg(F.count("*").alias(f"n_{name}"), F.min(name).alias(f"{name}_one"))

    single = lambda df: df.groupBy(*page).agg((F.count_distinct(T.text(owner)) == 1).alias("single"))
    out = left.select("left_id", *page, owner, day, time)
    alone = single(left).join(single(right).withColumnRenamed("single", "other"), page).select(*page, (F.col("single") & F.col("other")).alias("single"))
    out = out.join(alone, page, "left")
    for k, key in passes.items():
        l, r = counted(left, key, "left_id"), counted(right, key, "right_id")  # noqa: E741
        both = l.join(r, [*page, *key], "left").select(*page, *key, F.col("n_left_id").alias(f"l_{k}"), F.coalesce("n_right_id", F.lit(0)).alias(f"r_{k}"), F.col("right_id_one").alias(f"id_{k}"))
        out = out.join(both, [*page, *key], "left")
    once = lambda k: (F.col(f"l_{k}") == 1) & (F.col(f"r_{k}") == 1)
    none = F.coalesce(F.col("r_DAY"), F.lit(0)) == 0
    chosen = F.when(once("TIME"), F.col("id_TIME")).when(once("DAY"), F.col("id_DAY")).when(none & F.coalesce("single", F.lit(False)) & once("SINGLE"), F.col("id_SINGLE"))
    kind = F.when(chosen.isNotNull(), "MATCHED").when((F.col("l_DAY") == 1) & none, "UNMATCHED").otherwise("AMBIGUOUS")
    return out.select("left_id", chosen.alias("right_id"), kind.alias("kind"))
