"""Two readings of the same rows matched: unique keys, priority passes, multisets, ordered alignment, and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.operators.repair import paired_by_occurrence
from tallyline.session import cut_lineage


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """JON14: pairs whose key occurs once on either side. Counting is a map-side combined aggregate that also carries the
    row, so the match is a join of two aggregates and no window."""
    once = lambda df, i: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(i).alias(i)).where(F.col("n") == 1).drop("n")
    known = lambda df: df.where(F.coalesce(*(F.when(F.col(k).isNull(), True) for k in keys), F.lit(False)) == False)  # noqa: E712, E731
    return once(known(left), left_id).join(once(known(right), right_id), keys)


def priority_matches(left: DataFrame, right: DataFrame, passes: list[list[str]], left_id: str, right_id: str) -> DataFrame:
    """JON16, JON17: unique matches by each key set in turn, over the rows that earlier passes left over."""
    out = None
    for n, keys in enumerate(passes):
        # each pass is needed by all later ones: without a cut the plan would triple with every pass
        found = cut_lineage(unique_matches(left, right, keys, left_id, right_id).select(left_id, right_id, F.lit(n + 1).alias("pass")))
        out = found if out is None else out.unionByName(found)
        left, right = left.join(found, left_id, "left_anti"), right.join(found, right_id, "left_anti")
    return out


#: The key sets of JON16, strongest first; the first needs a time.
EVALUATION_KEYS = [
    ["account_number", "_timed", "transaction_date", "direction", "amount", "balance", "counterparty_account"],
    ["account_number", "amount", "balance"],
    ["account_number", "transaction_date", "direction", "counterparty_account"],
    ["account_number", "transaction_date", "direction", "amount"],
    ["transaction_date", "direction", "amount", "balance"],
]


def evaluation_matches(left: DataFrame, right: DataFrame, cells: list[str], left_id: str, right_id: str) -> DataFrame:
    """JON16: five key sets in priority order, unique on both sides, then what is left over and equal in all cells, one for
    one. Absent values are ``''`` and equal each other."""
    shape = lambda df, i: df.select(i, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in cells)).withColumn("_timed", F.when(F.col("transaction_time") != "", F.col("transaction_time")))
    left, right = shape(left, left_id), shape(right, right_id)
    found = priority_matches(left, right, EVALUATION_KEYS, left_id, right_id)
    rest = paired_by_occurrence(left.join(found, left_id, "left_anti"), right.join(found, right_id, "left_anti"), cells, left_id, right_id)
    return found.unionByName(rest.withColumn("pass", F.lit(len(EVALUATION_KEYS) + 1)))


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """AGG18: per key the rows on either side and the smaller of the two, in one aggregate over the union."""
    both = left.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = both.groupBy(*keys).agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"))
    return counted.withColumn("n_both", F.least("n_left", "n_right"))


def overlap_rates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """EVA01, EVA06: matched rows, recall and precision by exact multiset."""
    counted = multiset_overlap(left, right, keys)
    sums = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_left", "n_right", "n_both")))
    rate = lambda c: F.when(F.col(c) > 0, F.col("n_both") / F.col(c)).otherwise(0.0)
    return sums.withColumn("recall", rate("n_left")).withColumn("precision", rate("n_right"))


def multiset_except(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """SET05."""
    return left.select(*keys).exceptAll(right.select(*keys))


#: What equal fields of two rows count, what differing ones cost, and what a row without a partner costs.
FIELD_SCORES = {"account_number": 3, "transaction_date": 2, "direction": 1, "amount": 3, "balance": 3, "counterparty_account": 2}
LEAST_EQUAL, LEAST_SCORE, GAP = 3, 4, -4


def _scores(a: pd.DataFrame, b: pd.DataFrame, fields: list[str]) -> np.ndarray:
    """The score of every pair of a page's rows, 0 for pairs that agree too little to be one."""
    total, equal = np.zeros((len(a), len(b)), int), np.zeros((len(a), len(b)), int)
    for f in (f for f in FIELD_SCORES if f in fields):
        x, y = a[f].to_numpy()[:, None], b[f].to_numpy()[None, :]
        there, same = (x != "") & (y != ""), x == y
        total += np.where(there, np.where(same, FIELD_SCORES[f], -1), 0)
        equal += there & same
    return np.where((equal >= LEAST_EQUAL) & (total >= LEAST_SCORE), total, 0)


def _best_ahead(score: np.ndarray, gap: int) -> np.ndarray:
    """``[i, j]``: the best alignment of the first i and j rows. A row of the matrix is one vector operation: the best way to
    reach each place from above, then the running best along it."""
    n, m = score.shape
    slope = gap * np.arange(m + 1)
    ahead = np.empty((n + 1, m + 1), int)
    ahead[0] = slope
    for i in range(1, n + 1):
        reach = ahead[i - 1] + gap
        reach[1:] = np.maximum(reach[1:], np.where(score[i - 1] > 0, ahead[i - 1, :-1] + score[i - 1], reach[1:]))
        ahead[i] = np.maximum.accumulate(reach - slope) + slope
    return ahead


def _forced(score: np.ndarray, gap: int = 0) -> list[tuple[int, int]]:
    """Pairs that are in every best monotone alignment: no best one leaves the row out or pairs it otherwise. One pass
    forward and one back tell the best alignment through every place."""
    n, m = score.shape
    ahead, back = _best_ahead(score, gap), _best_ahead(score[::-1, ::-1], gap)[::-1, ::-1]
    best = ahead[n, m]
    out = []
    for i in range(n):
        alone = (ahead[i] + gap + back[i + 1]).max() == best
        paired = np.nonzero((score[i] > 0) & (ahead[i, :-1] + score[i] + back[i + 1, 1:] == best))[0]
        if not alone and len(paired) == 1:
            out.append((i, int(paired[0])))
    return out


def aligned_pages(left: DataFrame, right: DataFrame, page: list[str], row: str, fields: list[str]) -> DataFrame:
    """JON15: per page the pairs of rows that every best order-keeping alignment has; ambiguous rows stay unpaired.
    A page's rows are bounded by paper; pages are the groups of the kernel."""

    def align(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(row).reset_index(drop=True).fillna(""), b.sort_values(row).reset_index(drop=True).fillna("")
        pairs = _forced(_scores(a, b, fields), GAP) if len(a) and len(b) else []
        return pd.DataFrame([(*key, int(a[row][i]), int(b[row][j])) for i, j in pairs], columns=[*page, "left_row", "right_row"])

    types = dict(left.dtypes)
    schema = ", ".join([*(f"{p} {types[p]}" for p in page), "left_row int", "right_row int"])
    return left.groupBy(*page).cogroup(right.groupBy(*page)).applyInPandas(align, schema)


def near_pages(pages: DataFrame, key: str, page: str, k: int = 2) -> DataFrame:
    """TOP08: for every page the nearest other pages of the same owner, at most k. Candidates are neighbours in page
    order, k before and k after, so no owner's pages are paired with each other."""
    order = Window.partitionBy(key).orderBy(page)
    around = F.array(*(F.lag(page, d).over(order) for d in range(1, k + 1)), *(F.lead(page, d).over(order) for d in range(1, k + 1)))
    spread = pages.select(key, page, around.alias("near")).select(key, page, F.explode("near").alias("other")).where(F.col("other").isNotNull())
    nearest = Window.partitionBy(key, page).orderBy(F.abs(F.col("other") - F.col(page)), "other")
    return spread.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
