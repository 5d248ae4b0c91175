"""Operators over rows in source or time order: votes, continuity, inheritance, segments, audits.

All windows are partitioned by document and account. A statement is bounded by its pages, but a document may hold a third
of all rows: Spark sorts such a partition on disk, and the functions used here (lag, lead, running sums, last known
value) keep a constant state along it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATEMENT = ["doc", "acct"]
ORDER = ["page", "rowno", "tx_id"]


def in_order() -> Window:
    return Window.partitionBy(*STATEMENT).orderBy(*ORDER)


def signed() -> Column:
    return F.when(F.col("dir") == "IN", F.col("amt")).when(F.col("dir") == "OUT", -F.col("amt"))


def direction_votes(ledger: DataFrame) -> DataFrame:
    """SEQ02: whether neighbours go forward or back in time, by statement."""
    before = F.lag("d").over(in_order())
    votes = ledger.where(F.col("d").isNotNull()).withColumn("before", before)
    count = lambda test: F.count(F.when(test, 1))
    out = votes.groupBy(*STATEMENT).agg(count(F.col("d") > F.col("before")).alias("forward"), count(F.col("d") < F.col("before")).alias("backward"))
    return out.withColumn("is_reversed", F.col("backward") > F.col("forward"))


def continuity_issues(ledger: DataFrame) -> DataFrame:
    """SEQ06: neighbours whose balances don't differ by the amount, to the cent; pairs over 30 days apart are told apart."""
    known = ledger.where(F.col("bal").isNotNull() & F.col("amt").isNotNull() & F.col("dir").isin("IN", "OUT"))
    order = in_order()
    rows = known.withColumn("prev_id", F.lag("tx_id").over(order)).withColumn("prev_bal", F.lag("bal").over(order)).withColumn("prev_d", F.lag("d").over(order))
    expected = (F.col("prev_bal") + signed()).cast("decimal(18,2)")
    broken = rows.withColumn("expected", expected).where(F.col("prev_id").isNotNull() & (F.col("expected") != F.col("bal")))
    return broken.select("prev_id", "tx_id", "expected", F.col("bal").alias("actual"), F.coalesce(F.abs(F.datediff("d", "prev_d")), F.lit(0)).alias("days_apart"), (F.coalesce(F.abs(F.datediff("d", "prev_d")), F.lit(0)) > 30).alias("is_long"))


def continuity_score(ledger: DataFrame) -> DataFrame:
    """SEQ04: the mean gap between expected and printed balance, each capped at a million."""
    known = ledger.where(F.col("bal").isNotNull() & F.col("amt").isNotNull() & F.col("dir").isin("IN", "OUT"))
    before = F.lag("bal").over(in_order())
    # least() passes over NULL, so rows without a neighbour are told apart first
    gap = F.when(before.isNotNull(), F.least(F.abs(before + signed() - F.col("bal")), F.lit(1_000_000))).cast("decimal(18,2)")
    return known.withColumn("gap", gap).groupBy(*STATEMENT).agg(F.count("gap").alias("n_pairs"), F.coalesce(F.sum("gap"), F.lit(0)).cast("decimal(28,2)").alias("gap_sum"))


def inherited_owner(rows: DataFrame, value: str, order: list[str], partition: list[str]) -> DataFrame:
    """SEQ14: a missing value takes that of its neighbours where the previous and the next known one agree."""
    known = F.when(F.col(value) != "", F.col(value))
    up = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*partition).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    before, after = F.last(known, ignorenulls=True).over(up), F.first(known, ignorenulls=True).over(down)
    return rows.withColumn("inherited", F.when(F.col(value) != "", F.col(value)).when(before == after, before).otherwise(""))


def segments(rows: DataFrame, value: str, order: list[str], partition: list[str]) -> DataFrame:
    """SEQ16: a new segment starts where the known value changes; blanks belong to the segment before."""
    window = Window.partitionBy(*partition).orderBy(*order)
    held = F.last(F.when(F.col(value) != "", F.col(value)), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("held", F.coalesce(held, F.lit("")))
    fresh = F.coalesce((F.lag("held").over(window) != F.col("held")) & (F.lag("held").over(window) != ""), F.lit(False)).cast("int")
    return marked.withColumn("fresh", fresh).withColumn("segment", F.sum("fresh").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def flipped_pages(ledger: DataFrame) -> DataFrame:
    """SEQ11: pages where turning all directions round would mend the balances: two comparisons at least, 65 % of them
    right when turned and 25 % at most as printed."""
    known = ledger.where(F.col("bal").isNotNull() & F.col("amt").isNotNull() & F.col("dir").isin("IN", "OUT"))
    moved = F.col("bal") - F.lag("bal").over(Window.partitionBy("doc", "acct", "page").orderBy("rowno", "tx_id"))
    near = lambda x: (F.abs(x) < 1).cast("int")
    judged = known.withColumn("moved", moved).where(F.col("moved").isNotNull()).groupBy("doc", "acct", "page")
    votes = judged.agg(F.count("*").alias("n"), F.sum(near(F.col("moved") - signed())).alias("direct"), F.sum(near(F.col("moved") + signed())).alias("turned"))
    return votes.where((F.col("n") >= 2) & (F.col("turned") >= 0.65 * F.col("n")) & (F.col("direct") <= 0.25 * F.col("n")))


def account_summary(ledger: DataFrame) -> DataFrame:
    """AGG06, AGG07: totals, days and end balances of each statement; the balance before the first row is inferred."""
    at = F.struct(*ORDER)
    total = lambda side: F.coalesce(F.sum(F.when(F.col("dir") == side, F.col("amt"))), F.lit(0)).cast("decimal(28,2)")
    first = F.min(F.when(F.col("bal").isNotNull(), F.struct(*ORDER, (F.col("bal") - F.coalesce(signed(), F.lit(0))).cast("decimal(20,2)").alias("v"))))
    last = F.max(F.when(F.col("bal").isNotNull(), F.struct(*ORDER, F.col("bal").alias("v"))))
    return ledger.groupBy(*STATEMENT).agg(
        F.count("*").alias("n_rows"), total("IN").alias("total_in"), total("OUT").alias("total_out"), F.min("d").alias("start_date"), F.max("d").alias("end_date"),
        first["v"].alias("start_balance"), last["v"].cast("decimal(20,2)").alias("end_balance"), F.bool_and(F.col("bal").isNotNull()).alias("all_balances"), F.max_by("bank", at).alias("last_bank"),
    )


def balance_audit(ledger: DataFrame) -> DataFrame:
    """AGG08: whether start and movements give the end, to the cent; NULL balances can't be judged."""
    diff = (F.col("start_balance") + F.col("total_in") - F.col("total_out") - F.col("end_balance")).cast("decimal(28,2)")
    audited = account_summary(ledger).withColumn("difference", diff)
    return audited.select(*STATEMENT, "difference", F.when(diff.isNull() | ~F.col("all_balances"), "MISSING_BALANCE").when(diff == 0, "BALANCED").otherwise("UNBALANCED").alias("state"))


def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG09: the mode of each group; ties go to the shorter, then the smaller value."""
    counted = rows.where(F.col(value) != "").groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.length(value), F.col(value))).alias("mode"))


def missing_pages(ledger: DataFrame) -> DataFrame:
    """AGG15, SET04: pages between a document's first and last that have no row."""
    pages = ledger.where(F.col("page") > 0).select("doc", "page").distinct()
    spans = pages.groupBy("doc").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    return spans.select("doc", F.explode(F.sequence("a", "b")).alias("page")).join(pages, ["doc", "page"], "left_anti")


def page_ranges(pages: DataFrame) -> DataFrame:
    """PRJ11: pages as ``1-3,5``: runs of numbers found by the difference to their rank."""
    order = Window.partitionBy("doc").orderBy("page")
    runs = pages.select("doc", "page").distinct().withColumn("run", F.col("page") - F.row_number().over(order)).groupBy("doc", "run").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))), lambda x: x["s"]), ",").alias("pages"))


def parsed_ranges(selections: DataFrame, key: str, text: str) -> DataFrame:
    """PRJ11: the way back, ``(key, page)`` of every page in a selection; parts that aren't numbers are ignored."""
    part = F.explode(F.split(F.col(text), ",")).alias("part")
    rows = selections.select(key, part).where(F.col("part").rlike(r"^\s*\d{1,6}(\s*-\s*\d{1,6})?\s*$"))
    a = F.trim(F.split_part("part", F.lit("-"), F.lit(1))).cast("int")
    b = F.coalesce(F.nullif(F.trim(F.split_part("part", F.lit("-"), F.lit(2))), F.lit("")).cast("int"), a)
    return rows.where(a <= b).select(key, F.explode(F.sequence(a, b)).alias("page")).distinct()


def unpreceded(ledger: DataFrame) -> DataFrame:
    """SEQ20: rows whose opening balance no earlier or same-day row of the statement ends with."""
    rows = ledger.where(F.col("bal").isNotNull() & F.col("amt").isNotNull() & F.col("d").isNotNull() & F.col("dir").isin("IN", "OUT"))
    opening = rows.withColumn("opening", (F.col("bal") - signed()).cast("decimal(18,2)")).alias("a")
    # the earliest day a balance is seen decides for all later days, so the range becomes one comparison a key
    closing = rows.groupBy("doc", "acct", "bal").agg(F.min("d").alias("seen")).alias("b")
    met = [F.col("a.doc") == F.col("b.doc"), F.col("a.acct") == F.col("b.acct"), F.col("a.opening") == F.col("b.bal"), F.col("b.seen") <= F.col("a.d")]
    return opening.join(closing, met, "left_anti").select("tx_id")


#: The lead a reversed day needs, what counts as a break of the order, and the most that one break counts.
REVERSAL_MARGIN, BREAK, MOST_GAP = 0.01, 1.0, 1_000_000.0


def _gap(rows: list[dict], before: float | None) -> float:
    """The mean difference between expected and printed balances along the rows."""
    total, n = 0.0, 0
    for r in rows:
        if r["bal"] is None or r["amt"] is None or r["dir"] not in ("IN", "OUT"):
            continue
        if before is not None:
            total += min(abs(before + (r["amt"] if r["dir"] == "IN" else -r["amt"]) - r["bal"]), MOST_GAP)
            n += 1
        before = r["bal"]
    return total / n if n else 0.0


def _breaks(rows: list[dict]) -> tuple[int, int]:
    """How many neighbours' balances follow from each other, and how many don't."""
    valid = broken = 0
    for a, b in zip(rows, rows[1:], strict=False):
        if a["bal"] is None or b["bal"] is None or b["amt"] is None or b["dir"] not in ("IN", "OUT"):
            continue
        near = abs(a["bal"] + (b["amt"] if b["dir"] == "IN" else -b["amt"]) - b["bal"]) < BREAK
        valid, broken = valid + near, broken + (not near)
    return valid, broken


def _chronological(rows: list[dict]) -> list[dict]:
    """SEQ05 over rows in source order: days in order, each by its times or as printed, turned round where the balances then
    fit better; but the printed order, turned if most days run backward, where it breaks fewer balances."""
    days: dict[str, list[dict]] = {}
    for r in rows:
        days.setdefault(str(r["d"] or "9999-99-99"), []).append(r)
    out: list[dict] = []
    before: float | None = None
    for day in sorted(days):
        group = days[day]
        if len(group) > 1:
            if any(r["clock"] for r in group):
                group = sorted(group, key=lambda r: r["clock"] or "00:00:00")
            if _gap(group[::-1], before) + REVERSAL_MARGIN < _gap(group, before):
                group = group[::-1]
        out += group
        before = next((r["bal"] for r in reversed(group) if r["bal"] is not None), before)
    dates = [str(r["d"]) for r in rows if r["d"]]
    backward = sum(a > b for a, b in zip(dates, dates[1:], strict=False))
    printed = rows[::-1] if backward > sum(a < b for a, b in zip(dates, dates[1:], strict=False)) else rows
    (valid, broken), (_, by_date) = _breaks(printed), _breaks(out)
    return printed if broken < by_date or valid and not broken and by_date else out


def chronological(ledger: DataFrame) -> DataFrame:
    """SEQ05 as a kernel by statement: ``(tx_id, place)``. It carries a balance from day to day, so it needs a statement's
    rows together; six narrow columns go to it, and a statement's pages bound their number."""
    clock = F.regexp_extract(F.coalesce("tm", F.lit("")), r"(\d{2}:\d{2}:\d{2})", 1)
    rows = ledger.select("doc", "acct", "page", "rowno", "tx_id", "d", clock.alias("clock"), "dir", F.col("amt").cast("double").alias("amt"), F.col("bal").cast("double").alias("bal"))

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "rowno", "tx_id"]).astype(object)
        rows = pdf.where(pdf.notna(), None).to_dict("records")
        return pd.DataFrame([(r["doc"], r["acct"], r["tx_id"], k) for k, r in enumerate(_chronological(rows))], columns=["doc", "acct", "tx_id", "place"])

    return rows.groupBy(*STATEMENT).applyInPandas(ordered, "doc string, acct string, tx_id string, place int")


def chronological_issues(ledger: DataFrame) -> DataFrame:
    """SEQ06: the neighbours in the order of SEQ05 whose balances don't follow to the cent."""
    order = Window.partitionBy(*STATEMENT).orderBy("place")
    rows = ledger.join(chronological(ledger).select("tx_id", "place"), "tx_id")
    near = rows.select("tx_id", "dir", "d", "bal", F.lag("tx_id").over(order).alias("prev_id"), F.lag("d").over(order).alias("pd"), (F.lag("bal").over(order) + signed()).cast("decimal(18,2)").alias("expected"))
    days = F.coalesce(F.abs(F.datediff("d", "pd")), F.lit(0))
    return near.where(F.col("expected") != F.col("bal")).select("prev_id", "tx_id", "expected", F.col("bal").alias("actual"), days.alias("days_apart"), (days > 30).alias("is_long"))


def exact_sequence_directions(ledger: DataFrame, words: str = "利息|结息|入息") -> DataFrame:
    """SEQ09: statements whose days strictly rise and whose balances all follow exactly, a missing direction of interest
    counting as IN: those directions are filled."""
    order = Window.partitionBy(*STATEMENT).orderBy("d", "tm", "page", "rowno", "tx_id")
    interest = F.concat_ws(" ", "type", "summary").rlike(words)
    side = F.when(F.col("dir").isin("IN", "OUT"), F.col("dir")).when(interest, "IN")
    move = F.when(side == "OUT", -F.col("amt")).when(side == "IN", F.col("amt"))
    rows = ledger.withColumn("side", side).withColumn("follows", F.coalesce((F.lag("bal").over(order) + move) == F.col("bal"), F.lag("tx_id").over(order).isNull())).withColumn("readable", F.col("bal").isNotNull() & F.col("amt").isNotNull() & F.col("d").isNotNull() & side.isNotNull())
    sound = rows.groupBy(*STATEMENT).agg(F.bool_and("follows").alias("follows"), F.bool_and("readable").alias("readable"), F.count("*").alias("n")).where(F.col("follows") & F.col("readable") & (F.col("n") >= 3))
    return rows.where(~F.col("dir").isin("IN", "OUT")).join(sound.select(*STATEMENT), STATEMENT, "left_semi").select("tx_id", "side")


def batched(parts: Iterator[pd.DataFrame], target: int = 180) -> Iterator[pd.DataFrame]:
    """SEQ19: greedy packing of pages into batches of about ``target`` rows, in the order they come."""
    batch, filled = 0, 0
    for pdf in parts:
        out = []
        for n in pdf["n_rows"]:
            if filled and filled + n > target:
                batch, filled = batch + 1, 0
            filled += n
            out.append(batch)
        yield pdf.assign(batch=out)
