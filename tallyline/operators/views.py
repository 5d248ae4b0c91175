"""Smaller views over ledgers and readings: order, membership, nearest values, flows for charts, document overlaps, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions import text as T
from tallyline.operators import flows


def source_order(ledger: DataFrame) -> DataFrame:
    """SEQ01: each row's place in its document; missing pages and rows count as 0."""
    return ledger.select("tx_id", F.row_number().over(Window.partitionBy("doc").orderBy("page", "rowno", "tx_id")).alias("place"))


def nearest_bank(ledger: DataFrame) -> DataFrame:
    """SEQ15: rows without a bank take that of the previous row that has one, else of the next."""
    order = Window.partitionBy("doc").orderBy("page", "rowno", "tx_id")
    known = F.when(F.col("bank") != "", F.col("bank"))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return ledger.withColumn("filled", F.coalesce(before, after, F.lit(""))).where(F.col("bank") == "").select("tx_id", "filled")


def of_accounts(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """PRJ05: rows that belong to a listed account of their document."""
    listed = accounts.select(F.col("source_document_id").alias("doc"), T.identity_part("account_number").alias("part")).distinct()
    return ledger.withColumn("part", T.identity_part("acct")).join(listed, ["doc", "part"], "left_semi").select("tx_id")


def rows_by_account(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """AGG05: rows of each listed account, accounts without any included."""
    counted = ledger.groupBy(F.col("doc").alias("source_document_id")).agg(F.count("*").alias("n"))
    return accounts.join(counted, "source_document_id", "left").select("source_document_id", "account_number", F.coalesce("n", F.lit(0)).alias("n_rows"))


def flow_chart(ledger: DataFrame) -> DataFrame:
    """SNK06: edges of a flow chart, sources to the account and the account to its uses, with totals and counts."""
    classed = ledger.withColumn("flow", flows.flow_class()).where(F.col("flow").isNotNull() & F.col("amt").isNotNull())
    edge = classed.select(F.when(F.col("dir") == "IN", F.col("flow")).otherwise("ACCOUNT").alias("src"), F.when(F.col("dir") == "IN", "ACCOUNT").otherwise(F.col("flow")).alias("dst"), "amt")
    return edge.groupBy("src", "dst").agg(F.sum("amt").cast("decimal(28,2)").alias("total"), F.count("*").alias("n_rows"))


def best_pairs(candidates: DataFrame) -> DataFrame:
    """TOP04: each outgoing row's best counterpart, the highest score, then the smallest id."""
    return candidates.groupBy("out_id").agg(F.min_by("in_id", F.struct(-F.col("score"), F.col("in_id"))).alias("in_id"), F.max("score").alias("score"))


def overlapping_documents(ledger: DataFrame, anchors: int = 3, days: int = 2) -> DataFrame:
    """ER09: documents that share anchors, rows equal in day, direction, amount and balance and unique in either document,
    on several days."""
    keys = ["d", "dir", "amt", "bal"]
    known = ledger.where(F.col("d").isNotNull() & F.col("amt").isNotNull() & F.col("bal").isNotNull())
    once = known.groupBy("doc", *keys).agg(F.count("*").alias("n")).where(F.col("n") == 1)
    pairs = once.alias("a").join(once.alias("b"), [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), F.col("a.doc") < F.col("b.doc")])
    shared = pairs.groupBy(F.col("a.doc").alias("doc_1"), F.col("b.doc").alias("doc_2")).agg(F.count("*").alias("n_anchors"), F.count_distinct("a.d").alias("n_days"))
    return shared.where((F.col("n_anchors") >= anchors) & (F.col("n_days") >= days))


def times_compatible(a: Column, b: Column) -> Column:
    """DAT06: equal to the minute, and to the second where both tell it; a missing time is compatible with any."""
    minute, second = (lambda c: F.regexp_extract(T.text(c), r"(\d{2}:\d{2})", 1)), (lambda c: F.regexp_extract(T.text(c), r"\d{2}:\d{2}:(\d{2})", 1))
    return (minute(a) == "") | (minute(b) == "") | ((minute(a) == minute(b)) & ((second(a) == "") | (second(b) == "") | (second(a) == second(b))))


def loose_number(c: Column) -> Column:
    """NUM02, NUM03: the first number of a text, negative with a minus or in parentheses, NULL if there is none."""
    bare = F.regexp_replace(T.text(c), "[,，¥￥ ]", "")
    value = F.regexp_extract(bare, r"(\d+(?:\.\d+)?)", 1)
    size = F.when(value != "", value).try_cast("decimal(18,2)")
    return F.when(bare.rlike(r"-\d|^\(.*\)$"), -size).otherwise(size)


def suite_totals(left: DataFrame, right: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """EVA04: expected, delivered and right rows by document; a document that wasn't delivered counts as all wrong."""
    a = left.select(document, *keys, F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = a.unionByName(right.select(document, *keys, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(document, *keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.groupBy(document).agg(F.sum("a").alias("n_expected"), F.sum("b").alias("n_delivered"), F.sum(F.least("a", "b")).alias("n_right"))
