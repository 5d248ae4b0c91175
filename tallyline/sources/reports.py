"""Reports over a case: the tables of a workbook, the lines of a written report, booklet rows and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import flows
from tallyline.operators.review import review_issues


def overview(ledger: DataFrame, issues: DataFrame) -> DataFrame:
    """SNK01: one row: documents, accounts, rows, money and open issues."""
    total = lambda side: F.coalesce(F.sum(F.when(F.col("dir") == side, F.col("amt"))), F.lit(0)).cast("decimal(28,2)")
    facts = ledger.agg(F.count_distinct("doc").alias("n_documents"), F.count_distinct("doc", "acct").alias("n_accounts"), F.count("*").alias("n_rows"), total("IN").alias("total_in"), total("OUT").alias("total_out"))
    # two tables of one row each
    return facts.join(issues.agg(F.count("*").alias("n_issues")), F.lit(True))


def workbook_tables(ledger: DataFrame) -> dict[str, DataFrame]:
    """SNK01: the seven sheets as tables: overview, issues, clues, hidden assets, repayments, ledger, counterparties."""
    issues, summary = review_issues(ledger), flows.counterparty_summary(ledger)
    classed = ledger.withColumn("flow", flows.flow_class())
    return {
        "overview": overview(ledger, issues), "review_issues": issues, "clues": classed.where(flows.is_judicial()),
        "hidden_assets": classed.where(F.col("flow").isin("INSURANCE", "INVESTMENT_WEALTH")), "repayment_checks": classed.where(F.col("flow") == "LOAN_REPAYMENT"),
        "ledger": ledger, "counterparties": summary.orderBy(F.desc("net_out"), "cp_key"),
    }


def report_lines(ledger: DataFrame, k: int = 15) -> DataFrame:
    """SNK02: ``(section, place, line)`` of a written report: totals by flow class, then the k counterparties with the
    greatest net outflow. Both are small whatever the ledger's size."""
    classes = flows.flow_categories(ledger).select(F.lit(1).alias("section"), F.concat_ws(" ", "dir", "flow").alias("key"), F.concat_ws(" ", "dir", "flow", F.col("n_rows").cast("string"), F.col("total").cast("string")).alias("line"))
    top = flows.top_counterparties(flows.counterparty_summary(ledger), "net_out", k)
    parties = top.select(F.lit(2).alias("section"), F.concat_ws(" ", F.lpad((F.lit(10**15) - F.col("net_out")).cast("string"), 24, "0"), "cp_key").alias("key"), F.concat_ws(" ", "cp_name", F.col("net_out").cast("string")).alias("line"))
    return classes.unionByName(parties)


def booklet_rows(matches: DataFrame, ledger: DataFrame) -> DataFrame:
    """SNK03: adopted matches with their first row; one whose row is gone is kept without it."""
    rows = ledger.select(F.col("tx_id").alias("first_row"), "doc", "page", "d", "amt", "cp_name")
    return matches.where(F.col("adopted")).join(rows, "first_row", "left")


def diagnostics(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """SNK05: one text a document: its rows and its issues by kind, sorted; the kinds are few, so the list is short."""
    rows = ledger.groupBy("doc").agg(F.count("*").alias("n_rows"))
    kinds = review_issues(ledger).groupBy("doc", "category").agg(F.sum("n_rows").alias("n"))
    listed = kinds.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "category", F.col("n").cast("string")))), "；").alias("issues"), F.sum("n").alias("n_issues"))
    named = accounts.select(F.col("source_document_id").alias("doc"), "file_name").distinct()
    text = F.concat(F.lit("文件："), F.coalesce("file_name", F.lit("")), F.lit("；流水："), F.coalesce("n_rows", F.lit(0)).cast("string"), F.lit(" 笔；"), F.coalesce("issues", F.lit("无异常")))
    return named.join(rows, "doc", "left").join(listed, "doc", "left").select("doc", text.alias("text"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """SNK01, SNK07: one folder of CSV with a header a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")
