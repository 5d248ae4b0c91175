"""The case graph as two tables of nodes and edges, and review tasks over the ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import flows


def account_nodes(accounts: DataFrame) -> DataFrame:
    """GRA01: one node a master account; blank names are filled by the smallest name that is known."""
    key = T.master_account_key("account_number", "source_document_id", "bank_name", "file_name")
    known = lambda c: F.coalesce(F.min(F.when(T.text(c) != "", F.col(c))), F.lit(""))
    return accounts.groupBy(key.alias("node")).agg(known("account_name").alias("holder"), known("bank_name").alias("bank"), F.count("*").alias("n_sources"))


def first_accounts(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """JON04: the account of each row: that of its document and number, the first by number if several fit."""
    side = accounts.select(F.col("source_document_id").alias("doc"), T.identity_part("account_number").alias("part"), "account_number")
    first = side.groupBy("doc", "part").agg(F.min("account_number").alias("account_number"))
    return ledger.withColumn("part", T.identity_part("acct")).join(first, ["doc", "part"], "left").select("tx_id", F.coalesce("account_number", F.lit("")).alias("account_number"))


def edges(ledger: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """GRA04: ``(src, dst, kind)``: row to account, row to counterparty, row to flow class, account to judicial deduction and
    deduction to authority, row to the row it repeats, from one scan; and, once a pair, internal transfers, whose rows
    have no counterparty."""
    account = T.master_account_key("acct", "doc", "bank", "file")
    party = T.counterparty_key("cp_acct", "cp_name", "cp_bank", "doc", "tx_id")
    rows = ledger.withColumn("internal", F.lit(False))
    if pairs is not None:
        sides = pairs.select(F.col("out_id").alias("tx_id")).unionByName(pairs.select(F.col("in_id").alias("tx_id"))).distinct().withColumn("_side", F.lit(True))
        rows = ledger.join(sides, "tx_id", "left").withColumn("internal", F.col("_side").isNotNull()).drop("_side")
    rows = rows.withColumn("account", account).withColumn("party", party).withColumn("flow", F.when(~F.col("internal"), flows.flow_class())).withColumn("judicial", flows.is_judicial())
    edge = lambda test, src, dst, kind: F.when(test, F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")))
    row, deduction = F.col("tx_id"), F.concat(F.lit("judicial:"), "tx_id")
    made = F.array(
        edge(F.lit(True), row, F.col("account"), "OF_ACCOUNT"), edge(~F.col("internal"), row, F.col("party"), "WITH_PARTY"), edge(F.col("flow").isNotNull(), row, F.col("flow"), "IN_CLASS"),
        edge(F.col("judicial"), F.col("account"), deduction, "DEDUCTION"), edge(F.col("judicial"), deduction, F.col("party"), "TO_AUTHORITY"), edge(F.col("dup_of") != "", row, F.col("dup_of"), "REPEATS"),
    )
    out = rows.select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.*")
    if pairs is None:
        return out
    return out.unionByName(pairs.select(F.least("out_id", "in_id").alias("src"), F.greatest("out_id", "in_id").alias("dst"), F.lit("INTERNAL_PAIR").alias("kind")))


def zero_row_accounts(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """JON20: accounts without any row are kept."""
    return accounts.join(ledger.select(F.col("doc").alias("source_document_id")), "source_document_id", "left_anti").select("source_document_id", "account_number")


def suffix_accounts(short: DataFrame, full: DataFrame) -> DataFrame:
    """ER20: a number printed without its first one to four digits and the one longer number that ends with it. The
    last eight digits are an equality; a number with several longer ones stays as it is."""
    a = short.select(F.col("number").alias("short"), F.right("number", F.lit(8)).alias("tail")).where(F.length("number") >= 10).distinct()
    b = full.select(F.col("number").alias("long"), F.right("number", F.lit(8)).alias("tail")).distinct()
    gap = F.length("long") - F.length("short")
    met = a.join(b, "tail").where(gap.between(1, 4) & F.col("long").endswith(F.col("short")))
    return met.groupBy("short").agg(F.min("long").alias("long"), F.max("long").alias("other")).where(F.col("long") == F.col("other")).drop("other")


def page_issues(ledger: DataFrame) -> DataFrame:
    """REV02: rows of each page that need a look, by reason, from one scan."""
    tests = {
        "LOW_CONFIDENCE": F.col("conf") < 0.8, "INVALID_AMOUNT": F.col("amt").isNull() | (F.col("amt") < 0),
        "INVALID_DATE": F.col("d").isNull(), "INVALID_DIRECTION": ~F.col("dir").isin("IN", "OUT"),
    }
    reasons = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    return ledger.select("doc", "page", "tx_id", F.explode(reasons).alias("reason")).groupBy("doc", "page", "reason").agg(F.count("*").alias("n_rows"), F.min("tx_id").alias("first_row"))


def search(ledger: DataFrame, word: str, status: str | None = None) -> DataFrame:
    """PRJ06: rows that contain a word in any of six fields, whatever its case."""
    fields = ("cp_name", "cp_acct", "summary", "type", "raw_text", "tm")
    hit = reduce(lambda a, b: a | b, (F.lower(T.text(f)).contains(word.lower()) for f in fields))
    found = ledger.where(hit)
    return found.where(F.col("status") == status) if status else found


def milestone_errors(cases: DataFrame) -> DataFrame:
    """PRJ10: milestones that are missing, and pairs that stand in the wrong order."""
    names = ["debt_formation_date", "lawsuit_filing_date", "judgment_effective_date", "execution_filing_date", "report_order_served_date", "settlement_date"]
    missing = [F.when(F.col(n).isNull(), F.concat(F.lit("MISSING "), F.lit(n))) for n in names]
    order = [F.when(F.col(a) > F.col(b), F.concat(F.lit("ORDER "), F.lit(a))) for a, b in zip(names, names[1:], strict=False)]
    return cases.select("case_number", F.explode(F.filter(F.array(*missing, *order), lambda x: x.isNotNull())).alias("error"))


def fingerprints(ledger: DataFrame) -> DataFrame:
    """FPR01: one hash a statement that changes with any of its facts and with nothing else. Rows are hashed one by one and
    the hashes added up, so the order of rows doesn't matter and nothing is concatenated by group."""
    row = T.row_fingerprint("tx_id", "d", "dir", "amt", "bal", "cp_name", "cp_acct", "type", "summary")
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")
    return ledger.groupBy("doc", "acct").agg(F.count("*").alias("n_rows"), F.sum(part).cast("decimal(38,0)").alias("mark"))


def counterparty_nodes(ledger: DataFrame) -> DataFrame:
    """GRA03: one node a counterparty, with how many rows go either way. Ids stay in the edges, where they are rows."""
    party = T.counterparty_key("cp_acct", "cp_name", "cp_bank", "doc", "tx_id")
    count = lambda side: F.sum((F.col("dir") == side).cast("int")).alias(f"n_{side.lower()}")
    return ledger.groupBy(party.alias("node")).agg(count("IN"), count("OUT"), F.min(F.when(F.trim("cp_name") != "", F.trim("cp_name"))).alias("name"))


def judicial_nodes(ledger: DataFrame) -> DataFrame:
    """GRA05."""
    return ledger.where(flows.is_judicial()).select(F.concat(F.lit("judicial:"), "tx_id").alias("node"), "d", "amt")


def written_back(ledger: DataFrame, representatives: DataFrame) -> DataFrame:
    """GRA07, JON07: every observation with its event's representative and whether it is left out of sums."""
    return ledger.join(representatives, "tx_id", "left").select("tx_id", F.coalesce("representative", "tx_id").alias("representative"), (F.coalesce("representative", "tx_id") != F.col("tx_id")).alias("is_duplicate"))


def issuers(accounts: DataFrame) -> DataFrame:
    """JON19: the bank that issues an account, where all documents that print the account agree; conflicts are kept as such."""
    named = accounts.where((T.text("bank_name") != "") & T.is_reliable("account_number"))
    ends = named.groupBy(T.identity_part("account_number").alias("account")).agg(F.min("bank_name").alias("bank"), F.max("bank_name").alias("other"), F.count("*").alias("n_documents"))
    return ends.select("account", "n_documents", F.when(F.col("bank") == F.col("other"), F.col("bank")).alias("bank"), (F.col("bank") != F.col("other")).alias("conflict"))


def ownership_groups(accounts: DataFrame) -> DataFrame:
    """AGG17: accounts by their holder's name, however spaced."""
    return accounts.groupBy(T.person_name("account_name").alias("holder")).agg(F.count("*").alias("n_accounts"), F.count_distinct(T.identity_part("account_number")).alias("n_numbers"), F.min("account_name").alias("printed"))


def overlaid(drafts: DataFrame, model: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """JON21, ER18: model values over drafts by key; a key the model has twice isn't used, and drafts it omits are kept."""
    once = model.groupBy(*keys).agg(F.count("*").alias("n"), *(F.min(f).alias(f"m_{f}") for f in fields))
    laid = drafts.join(once, keys, "left")
    use = lambda f: F.when((F.col("n") == 1) & (F.coalesce(F.col(f"m_{f}"), F.lit("")) != ""), F.col(f"m_{f}")).otherwise(F.col(f)).alias(f)
    return laid.select(*keys, *(use(f) for f in fields), F.when(F.col("n").isNull(), "OMITTED").when(F.col("n") > 1, "REPEATED").otherwise("USED").alias("overlay"))
