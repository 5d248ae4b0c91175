"""Observations of one real event across documents, and transfers between a party's own accounts.

Both are candidate joins with an equality on everything an accepted pair must share, followed by an order-dependent
choice. The choice runs in grouped kernels whose keys cannot be crossed by any pair: account, day, direction and cents for
events; cents and islands of days for transfers. Kernels hold one group of equal amounts at a time; the key includes
the account (or an island of days), so no party with many rows becomes one group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions import text as T
from tallyline.session import cut_lineage

EVENT_KEY = ["part", "d", "dir", "amt"]
LEAST_POINTS = 4


def comparable(ledger: DataFrame) -> DataFrame:
    """Rows that can equal another document's row, with normalised values to compare."""
    clock = F.regexp_extract(F.coalesce("tm", F.lit("")), r"(\d{2}:\d{2}:\d{2})", 1)
    return (
        ledger.where(T.is_reliable("acct") & F.col("dir").isin("IN", "OUT") & F.col("d").isNotNull() & F.col("amt").isNotNull())
        .withColumn("part", T.identity_part("acct"))
        .withColumn("clock", F.when(clock != "", clock))
        .withColumn("n_cp", T.identity_part("cp_acct"))
        .withColumn("n_sum", T.plain_text("summary"))
        .withColumn("n_name", T.plain_text("cp_name"))
        .withColumn("n_raw", T.plain_text("raw_text"))
    )


def duplicate_points(a: str, b: str) -> Column:
    """ER02: the points of a pair, NULL where a time, balance or counterparty account contradicts."""
    l, r = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))  # noqa: E741
    both_time, both_bal = l("clock").isNotNull() & r("clock").isNotNull(), l("bal").isNotNull() & r("bal").isNotNull()
    both_cp = (l("n_cp") != "") & (r("n_cp") != "")
    against = both_time & (l("clock") != r("clock")) | both_bal & (l("bal") != r("bal")) | both_cp & (l("n_cp") != r("n_cp"))
    score = lambda test, n: F.when(test, n).otherwise(0)
    points = (
        score(both_time, 4) + score(both_bal, 4) + score(both_cp, 3) + score(T.texts_compatible(l("n_sum"), r("n_sum")), 1)
        + score(T.texts_compatible(l("n_name"), r("n_name")), 1) + score((l("n_raw") != "") & (l("n_raw") == r("n_raw")), 2)
    )
    return F.when(~against, points)


def duplicate_candidates(ledger: DataFrame) -> DataFrame:
    """JON01: ``(id_1, id_2, points)``, the smaller id first, of rows of different documents that reach the points."""
    rows = comparable(ledger)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in EVENT_KEY]
    pairs = rows.alias("a").join(rows.alias("b"), [*on, F.col("a.tx_id") < F.col("b.tx_id"), F.col("a.doc") != F.col("b.doc")])
    scored = pairs.select(F.col("a.tx_id").alias("id_1"), F.col("b.tx_id").alias("id_2"), duplicate_points("a", "b").alias("points"))
    return scored.where(F.col("points") >= LEAST_POINTS)


def representative_score() -> Column:
    """TOP05: checked rows first, then confidence, then how much a row tells."""
    return (
        F.when(F.col("status").isin("VERIFIED", "CORRECTED"), 100).otherwise(0)
        + F.floor(F.coalesce("conf", F.lit(0.0)) * 20 + 0.5).cast("int")
        + F.when(F.col("bal").isNotNull(), 8).otherwise(0) + F.when(F.col("cp_acct") != "", 5).otherwise(0)
        + F.when(F.col("cp_name") != "", 3).otherwise(0) + F.when(F.col("summary") != "", 2).otherwise(0)
    )


def _compatible(a: str, b: str) -> bool:
    return bool(a and b and (a == b or min(len(a), len(b)) >= 4 and (a in b or b in a)))


def _points(a, b) -> int | None:
    score = 0
    for name, points in (("clock", 4), ("bal", 4), ("n_cp", 3)):
        x, y = getattr(a, name), getattr(b, name)
        if x is not None and y is not None and x == x and y == y and x != "" and y != "":
            if x != y:
                return None
            score += points
    return score + _compatible(a.n_sum, b.n_sum) + _compatible(a.n_name, b.n_name) + 2 * bool(a.n_raw and a.n_raw == b.n_raw)


def group_events(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's rows in source order, each attached to the best event that doesn't hold its document yet."""
    events: list[dict] = []
    home: dict[str, str] = {}
    for row in pdf.sort_values(["doc", "page", "rowno", "tx_id"]).itertuples():
        best, most = None, LEAST_POINTS - 1
        for event in events:
            if row.doc in event["docs"]:
                continue
            points = _points(event["rep"], row)
            if points is not None and points > most:
                best, most = event, points
        if best is None:
            best = {"rep": row, "docs": set(), "rows": []}
            events.append(best)
        best["docs"].add(row.doc)
        best["rows"].append(row)
        best["rep"] = min(best["rows"], key=lambda r: (-r.rep_score, r.tx_id))
    for event in events:
        home |= {r.tx_id: event["rep"].tx_id for r in event["rows"]}
    return pd.DataFrame({"tx_id": list(home), "representative": list(home.values())})


def canonical_events(ledger: DataFrame) -> DataFrame:
    """ER01: ``(tx_id, representative)`` of every row. Only groups that hold more than one document reach the kernel; the
    others, and rows that can equal nothing, represent themselves. A declared duplicate follows the row it names."""
    rows = comparable(ledger).withColumn("rep_score", representative_score())
    needed = [*EVENT_KEY, "tx_id", "doc", "page", "rowno", "clock", "bal", "n_cp", "n_sum", "n_name", "n_raw", "rep_score"]
    several = rows.groupBy(*EVENT_KEY).agg((F.min("doc") != F.max("doc")).alias("several")).where("several").drop("several")
    shared = rows.select(*needed).join(several, EVENT_KEY, "left_semi")
    grouped = shared.groupBy(*EVENT_KEY).applyInPandas(group_events, "tx_id string, representative string")
    own = ledger.select("tx_id", "dup_of").join(grouped, "tx_id", "left").withColumn("representative", F.coalesce("representative", "tx_id"))
    return followed(own)


def followed(own: DataFrame) -> DataFrame:
    """Declared duplicates followed to the row at the end of their chain, by doubling; a circle of declarations ends at its
    least row."""
    links = cut_lineage(own.select("tx_id", F.when(F.col("dup_of") != "", F.col("dup_of")).alias("next"), "representative"))
    named = links.where(F.col("next").isNotNull()).select("tx_id", "next").join(links.select(F.col("tx_id").alias("next")), "next", "left_semi").select("tx_id", "next")
    ends = cut_lineage(named.select("tx_id", "next", F.least("tx_id", "next").alias("least"), F.lit(True).alias("on")))
    # after as many doublings as its number has digits, every chain has ended, and whatever goes on is in a circle or leads to one
    for _ in range(ends.count().bit_length()):
        ahead = ends.select(F.col("tx_id").alias("next"), F.col("next").alias("after"), F.col("least").alias("least_after"))
        moved = ends.join(ahead, "next", "left")
        ends = cut_lineage(moved.select("tx_id", F.coalesce("after", "next").alias("next"), F.least("least", F.coalesce("least_after", "least")).alias("least"), F.col("after").isNotNull().alias("on")))
        if ends.where("on").isEmpty():
            break
    ends = ends.withColumn("next", F.when(F.col("on"), F.col("least")).otherwise(F.col("next")))
    target = links.select(F.col("tx_id").alias("next"), F.col("representative").alias("declared"))
    found = ends.select("tx_id", "next").join(target, "next").select("tx_id", "declared")
    return links.join(found, "tx_id", "left").select("tx_id", F.coalesce("declared", "representative").alias("representative"))


def owned_accounts(accounts: DataFrame, owner: str = "DEBTOR_MAIN") -> DataFrame:
    return accounts.where(F.col("owner_type") == owner).select(T.identity_part("account_number").alias("part"), "case_number").where(F.col("part") != "").distinct()


def with_internal(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows of an owned account whose counterparty account is another owned one are ``internal``."""
    owned = owned_accounts(accounts).select("part").distinct()
    rows = ledger.withColumn("_own", T.identity_part("acct")).withColumn("_other", T.identity_part("cp_acct"))
    mark = lambda df, c: df.join(owned.select(F.col("part").alias(c), F.lit(True).alias(f"{c}_owned")), c, "left")
    both = mark(mark(rows, "_own"), "_other")
    internal = F.coalesce(F.col("_own_owned") & F.col("_other_owned") & (F.col("_own") != F.col("_other")), F.lit(False))
    return both.withColumn("internal", internal).drop("_own", "_other", "_own_owned", "_other_owned")


def transfer_rows(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows of owned accounts that can be one side of a transfer."""
    rows = ledger.where(F.col("dir").isin("IN", "OUT") & F.col("d").isNotNull() & F.col("amt").isNotNull())
    rows = rows.withColumn("part", T.identity_part("acct")).withColumn("n_cp", T.identity_part("cp_acct"))
    return rows.join(owned_accounts(accounts).select("part").distinct(), "part", "left_semi")


def transfer_candidates(ledger: DataFrame, accounts: DataFrame, days: int = 2) -> DataFrame:
    """JON02: ``(out_id, in_id, day_gap, score)``. The window of days is an equality: the incoming side is repeated for each day
    it may pair with. One side must print the other's account, so that is part of the key too: one join where the outgoing
    row prints it, one where the incoming row alone does, and no amount, however common, meets itself."""
    rows = transfer_rows(ledger, accounts)
    outgoing = rows.where(F.col("dir") == "OUT").alias("o")
    incoming = rows.where(F.col("dir") == "IN").withColumn("day", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days)))).alias("i")
    near = [F.col("o.amt") == F.col("i.amt"), F.col("o.d") == F.col("i.day"), F.col("o.part") != F.col("i.part")]
    gap = F.abs(F.datediff("o.d", "i.d"))
    found = lambda pairs, score: pairs.select(F.col("o.tx_id").alias("out_id"), F.col("i.tx_id").alias("in_id"), gap.alias("day_gap"), (score - gap).alias("score"))
    forward = outgoing.join(incoming, [*near, F.col("o.n_cp") == F.col("i.part")]).where((F.col("i.n_cp") == "") | (F.col("i.n_cp") == F.col("o.part")))
    reverse = outgoing.where(F.col("n_cp") == "").join(incoming, [*near, F.col("i.n_cp") == F.col("o.part")])
    return found(forward, F.when(F.col("i.n_cp") == "", 80).otherwise(100)).unionByName(found(reverse, F.lit(80)))


def net_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """In source order each unpaired row takes its best later counterpart: highest score, then earliest."""
    rows = pdf.sort_values(["doc", "page", "rowno", "tx_id"]).to_dict("records")
    pairs, used = [], set()
    for i, a in enumerate(rows):
        if i in used:
            continue
        best = None
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if j in used or a["dir"] == b["dir"] or a["part"] == b["part"]:
                continue
            gap = abs((a["d"] - b["d"]).days)
            forward, reverse = a["n_cp"] == b["part"], b["n_cp"] == a["part"]
            if gap > 2 or not (forward or reverse) or a["n_cp"] and not forward or b["n_cp"] and not reverse:
                continue
            score = (100 if forward and reverse else 80) - gap
            if best is None or score > best[0]:
                best = (score, j)
        if best:
            used |= {i, best[1]}
            pairs.append((a["tx_id"], rows[best[1]]["tx_id"], a["amt"], best[0]))
    return pd.DataFrame(pairs, columns=["tx_id", "pair_id", "amt", "score"])


def internal_transfers(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """NET01: the pairs netted. Rows without any candidate never reach the kernel, and its groups are islands of one
    amount: runs of days at most two apart, which no pair can cross."""
    rows = transfer_rows(ledger, accounts)
    met = transfer_candidates(ledger, accounts)
    ids = met.select(F.col("out_id").alias("tx_id")).union(met.select("in_id")).distinct()
    near = rows.select("tx_id", "doc", "page", "rowno", "d", "dir", "amt", "part", "n_cp").join(ids, "tx_id", "left_semi")
    order = Window.partitionBy("amt").orderBy("d", "tx_id")
    fresh = F.coalesce((F.datediff("d", F.lag("d").over(order)) > 2).cast("int"), F.lit(0))
    islands = near.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("amt", "island").applyInPandas(net_group, "tx_id string, pair_id string, amt decimal(18,2), score int")


def fast_in_out_candidates(ledger: DataFrame, least: int = 30000, days: int = 2, share: float = 0.15) -> DataFrame:
    """JON03: money that leaves an account within days of arriving, by an equality on account and day."""
    rows = ledger.where(F.col("d").isNotNull() & (F.col("acct") != ""))
    a = rows.where((F.col("dir") == "IN") & (F.col("amt") >= least)).withColumn("day", F.explode(F.sequence("d", F.date_add("d", days)))).alias("a")
    b = rows.where((F.col("dir") == "OUT") & (F.col("amt") >= least * (1 - share))).alias("b")
    pairs = a.join(b, [F.col("a.acct") == F.col("b.acct"), F.col("a.doc") == F.col("b.doc"), F.col("a.day") == F.col("b.d")])
    close = F.abs(F.col("a.amt") - F.col("b.amt")) <= F.col("a.amt") * F.lit(share).cast("decimal(4,2)")
    later = F.struct("b.page", "b.rowno", "b.tx_id") > F.struct("a.page", "a.rowno", "a.tx_id")
    return pairs.where(close & later).select(F.col("a.tx_id").alias("in_id"), F.col("b.tx_id").alias("out_id"), F.datediff("b.d", "a.d").alias("days"))


def first_later(pdf: pd.DataFrame) -> pd.DataFrame:
    """In the order of incoming rows, each takes its first outgoing candidate that no earlier one took."""
    taken: set[str] = set()
    out = []
    for in_id, own in pdf.sort_values(["in_at", "out_at"]).groupby("in_id", sort=False):
        free = next(((o, d) for o, d in zip(own["out_id"], own["days"], strict=True) if o not in taken), None)
        if free:
            taken.add(free[0])
            out.append((in_id, *free))
    return pd.DataFrame(out, columns=["in_id", "out_id", "days"])


def fast_in_out(ledger: DataFrame, **limits) -> DataFrame:
    """JON03: the one-to-one choice among the candidates, account by account; only rows with a candidate reach the kernel."""
    at = F.to_json(F.struct(F.lpad(F.col("page").cast("string"), 10, "0").alias("p"), F.lpad(F.col("rowno").cast("string"), 10, "0").alias("r"), "tx_id"))
    place = ledger.select("tx_id", "doc", "acct", at.alias("at"))
    met = fast_in_out_candidates(ledger, **limits)
    met = met.join(place.withColumnsRenamed({"tx_id": "in_id", "at": "in_at"}), "in_id").join(place.select(F.col("tx_id").alias("out_id"), F.col("at").alias("out_at")), "out_id")
    return met.groupBy("doc", "acct").applyInPandas(first_later, "in_id string, out_id string, days int")
