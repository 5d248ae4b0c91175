"""Pages of documents: what they hold, runs of one bank, batches, contexts, and their accounting.

Pages are the rows here, many fewer than ledger rows; windows are by document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions import printed as R
from tallyline.functions import text as T

UNCONFIRMED = "待确认银行"


def pages_of(ledger: DataFrame) -> DataFrame:
    """``(doc, page, n_rows, bank, account, conf)``: the one bank and the one reliable account of a page, ``''`` if there is none or several."""
    bank = F.nullif(R.canonical_bank("bank"), F.lit(""))
    own = F.when(T.is_reliable("acct"), T.identity_part("acct"))
    one = lambda c: F.coalesce(F.when(F.min(c) == F.max(c), F.min(c)), F.lit(""))
    rows = ledger.where(F.col("page") > 0).withColumn("_b", bank).withColumn("_a", own)
    return rows.groupBy("doc", "page").agg(F.count("*").alias("n_rows"), one("_b").alias("bank"), one("_a").alias("account"), F.round(F.avg("conf"), 6).alias("conf"))


def bank_runs(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """SEQ18: ``pages`` with the bank of the run they belong to and its number: a sure bank of their own, else the nearest
    one before, else after."""
    order = Window.partitionBy("doc").orderBy("page")
    sure = F.when((F.col("bank") != "") & (F.coalesce("conf", F.lit(0.0)) >= least), F.col("bank"))
    before = F.last(sure, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(sure, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    held = pages.withColumn("run_bank", F.coalesce(before, after, F.lit(UNCONFIRMED)))
    fresh = F.coalesce((F.lag("run_bank").over(order) != F.col("run_bank")).cast("int"), F.lit(0))
    return held.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def bank_groups(runs: DataFrame) -> DataFrame:
    """SEQ18: one row a run, with its pages and their mean confidence."""
    return runs.groupBy("doc", "run").agg(F.min("run_bank").alias("bank"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"), F.round(F.avg("conf"), 4).alias("confidence"))


def batches(runs: DataFrame, target: int = 180) -> DataFrame:
    """SEQ19: pages packed greedily into batches of about ``target`` rows, in order and never across runs. A run is bounded
    by the pages of its document; only page numbers and row counts go to the kernel."""
    limit = max(40, target)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, filled = [], 0, 0
        pdf = pdf.sort_values("page")
        for n in pdf["n_rows"]:
            if filled and filled + n > limit:
                batch, filled = batch + 1, 0
            filled += n
            out.append(batch)
        return pdf[["doc", "run", "page"]].assign(batch=out)

    return runs.select("doc", "run", "page", "n_rows").groupBy("doc", "run").applyInPandas(pack, "doc string, run bigint, page int, batch int")


def planning_batches(pages: DataFrame, size: int = 8) -> DataFrame:
    """SEQ21: ``(doc, batch, page)``: batches of ``size`` pages, each with the last page of the one before."""
    own = F.floor((F.col("page") - 1) / size).cast("int")
    spread = F.when(F.col("page") % size == 0, F.array(own, own + 1)).otherwise(F.array(own))
    last = pages.groupBy("doc").agg(F.max("page").alias("last"))
    rows = pages.select("doc", "page", F.explode(spread).alias("batch")).join(last, "doc")
    return rows.where(F.col("batch") * size < F.col("last")).select("doc", "batch", "page")


def proposed_accounts(runs: DataFrame) -> DataFrame:
    """SEQ23: pages without an account in a run whose other pages all have the same one, with that account as a proposal."""
    named = F.when(F.col("account") != "", F.col("account"))
    anchors = runs.groupBy("doc", "run").agg(F.min(named).alias("least"), F.max(named).alias("most")).where(F.col("least") == F.col("most"))
    return runs.where(F.col("account") == "").join(anchors, ["doc", "run"]).select("doc", "page", F.col("least").alias("proposed"))


def dominant_vote(rows: DataFrame, keys: list[str], value: str, confidence: str, least: float = 0.55) -> DataFrame:
    """AGG13: the most frequent value of each group among sure rows; ties go to the smaller value."""
    counted = rows.where((F.col(value) != "") & (F.coalesce(F.col(confidence), F.lit(0.0)) >= least)).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("dominant"), F.max("n").alias("votes"))


def page_map(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """SEQ22: every page with its segment (pages of one known account; those without one belong to the segment before) and
    the segment's dominant value."""
    order = Window.partitionBy("doc").orderBy("page")
    known = F.when(F.col("account") != "", F.col("account"))
    held = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = pages.withColumn("_h", F.coalesce(held, F.lit("")))
    fresh = F.coalesce((F.lag("_h").over(order) != F.col("_h")) & (F.lag("_h").over(order) != ""), F.lit(False)).cast("int")
    mapped = marked.withColumn("_f", fresh).withColumn("segment", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("doc", "page", "segment", F.col("_h").alias("account"))
    return mapped.join(votes, ["doc", "page"], "left")


def remapped(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """PRJ07: the page of the original document that each local page, numbered within its file, stands for."""
    local = ledger.where(F.col("page") > 0).select("doc", "page").distinct().withColumn("local", F.row_number().over(Window.partitionBy("doc").orderBy("page")))
    lists = accounts.groupBy(F.col("source_document_id").alias("doc")).agg(F.min("covered_pages").alias("covered"))
    return local.join(lists, "doc").select("doc", "page", "local", F.get("covered", F.col("local") - 1).alias("original"))


def page_errors(pages: DataFrame, accounts: DataFrame) -> DataFrame:
    """PRJ14: listed pages that no group holds, pages that a list holds more than once, and pages held but not listed."""
    listed = accounts.select(F.col("source_document_id").alias("doc"), F.explode("covered_pages").alias("page")).groupBy("doc", "page").agg(F.count("*").alias("times"))
    both = listed.join(pages.select("doc", "page", F.lit(True).alias("held")), ["doc", "page"], "full_outer")
    error = F.when(F.col("times") > 1, "DUPLICATED").when(F.col("held").isNull(), "MISSING").when(F.col("times").isNull(), "UNLISTED")
    return both.select("doc", "page", error.alias("error")).where(F.col("error").isNotNull())


def completeness(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """ASM10: expected against extracted rows of each document and whether its fields are certain."""
    doubtful = (F.coalesce("conf", F.lit(1.0)) < 0.8) | F.col("amt").isNull() | F.col("d").isNull() | ~F.col("dir").isin("IN", "OUT")
    rows = ledger.groupBy(F.col("doc").alias("source_document_id")).agg(F.count("*").alias("n"), F.bool_or(doubtful).alias("doubtful"))
    n = F.coalesce("n", F.lit(0))
    tests = (("MISSING_ROWS", F.col("transaction_count") > n), ("EMPTY", (n == 0) & (F.col("transaction_count") > 0)), ("UNCERTAIN_FIELDS", F.coalesce("doubtful", F.lit(False))))
    issues = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests)), lambda x: x.isNotNull())
    return accounts.join(rows, "source_document_id", "left").select("source_document_id", n.alias("n_rows"), F.array_join(issues, ",").alias("issues"), (F.array_contains(issues, "MISSING_ROWS") | F.array_contains(issues, "EMPTY")).alias("blocks"))


def page_totals(ledger: DataFrame) -> DataFrame:
    """ASM12: a result of several pages regrouped by page."""
    total = lambda side: F.coalesce(F.sum(F.when(F.col("dir") == side, F.col("amt"))), F.lit(0)).cast("decimal(28,2)")
    return ledger.groupBy("doc", "page").agg(F.count("*").alias("n_rows"), total("IN").alias("total_in"), total("OUT").alias("total_out"))


def header_only_pages(accounts: DataFrame, pages: DataFrame) -> DataFrame:
    """ASM13: covered pages that are not among those with a printed account; they carry their document's as context."""
    covered = accounts.select(F.col("source_document_id").alias("doc"), "account_number", F.explode("covered_pages").alias("page")).distinct()
    return covered.join(pages.select("doc", "page"), ["doc", "page"], "left_anti")
