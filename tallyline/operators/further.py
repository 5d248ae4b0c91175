"""Further projections over the ledger, account summaries, contexts, guarded suffixes, and weighted row matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions import printed as R
from tallyline.functions import text as T
from tallyline.operators.sequence import in_order, most_frequent, signed

#: The mark where an excerpt leaves text out, and what an instalment's first row says.
LEFT_OUT = "[中间内容未用于分组]"
INSTALMENT = "普通消费转分期|账单分期|分期"
#: What equal fields count when left-over rows are matched; every other field counts one.
MATCH_WEIGHTS = {"account_number": 3, "transaction_time": 5, "transaction_date": 2, "direction": 2, "amount": 5, "balance": 4, "counterparty_name": 2}


def observation_ids(ledger: DataFrame) -> DataFrame:
    """PRJ01: an id that tells a row's document, page and place."""
    safe = lambda c, n: F.right(F.regexp_replace(c, "[^0-9A-Za-z]", ""), F.lit(n))
    parts = F.concat(F.lit("TX_"), safe("doc", 16), F.lit("_P"), F.col("page").cast("string"), F.lit("_R"), F.col("rowno").cast("string"), F.lit("_"), safe("tx_id", 32))
    return ledger.select("tx_id", parts.alias("observation_id"))


def public_warning(c: Column) -> Column:
    """PRJ08: a warning without the names of services."""
    named = F.regexp_replace(F.regexp_replace(c, r"(?i)Gemini(?:\s*3\.8\s*Flash)?", "智能识别"), r"(?i)Qwen", "智能识别")
    return F.regexp_replace(named, r"智能识别\s*直传", "智能识别")


def row_accounts(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """GRA02: the account node of each row: that of its document and number, else one made for it."""
    first = accounts.groupBy(F.col("source_document_id").alias("doc"), T.identity_part("account_number").alias("part")).agg(F.min("account_number").alias("m"))
    rows = ledger.select("tx_id", "doc", T.identity_part("acct").alias("part")).join(first, ["doc", "part"], "left")
    node = F.when(F.col("m").isNotNull(), F.concat(F.lit("account|"), T.identity_part("m"))).otherwise(F.concat(F.lit("synthetic|"), "doc", F.lit("|"), "part"))
    return rows.select("tx_id", node.alias("node"), F.col("m").isNull().alias("synthetic"))


def account_summaries(ledger: DataFrame) -> DataFrame:
    """AGG04: per account across documents its money, days, pages, most frequent useful bank, first and last balance by day,
    whether they balance, and whether any row is doubtful."""
    rows = ledger.withColumn("account", T.master_account_key("acct", "doc", "bank", "file"))
    at = F.when(F.col("bal").isNotNull() & F.col("d").isNotNull(), F.struct("d", "doc", "page", "rowno", "tx_id"))
    total = lambda side: F.coalesce(F.sum(F.when(F.col("dir") == side, F.col("amt"))), F.lit(0)).cast("decimal(28,2)")
    doubtful = (F.coalesce("conf", F.lit(1.0)) < 0.8) | F.col("amt").isNull() | F.col("d").isNull() | ~F.col("dir").isin("IN", "OUT")
    out = rows.groupBy("account").agg(
        F.count("*").alias("n_rows"), total("IN").alias("total_in"), total("OUT").alias("total_out"), F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count_distinct("doc", "page").alias("pages"), F.bool_or(doubtful).alias("doubtful"),
        F.min_by((F.col("bal") - F.coalesce(signed(), F.lit(0))).cast("decimal(20,2)"), at).alias("start_balance"), F.max_by(F.col("bal").cast("decimal(20,2)"), at).alias("end_balance"),
    )
    useful = rows.where((F.col("bank") != "") & ~F.col("bank").rlike(R.UNVERIFIED) & F.col("bank").rlike(R.BANK_KINDS))
    diff = (F.col("start_balance") + F.col("total_in") - F.col("total_out") - F.col("end_balance")).cast("decimal(28,2)")
    joined = out.join(most_frequent(useful, ["account"], "bank"), "account", "left")
    return joined.select(
        "account", "n_rows", "total_in", "total_out", "start_date", "end_date", "pages", F.coalesce("mode", F.lit("待核验银行")).alias("bank"), "start_balance", "end_balance",
        F.abs(diff).alias("difference"), (diff == 0).alias("is_balanced"), F.when(F.col("doubtful"), "NEEDS_REVIEW").otherwise("COMPLETE").alias("status"),
    )


def excerpt(c: Column, budget: int) -> Column:
    """STR12: a text within its budget whole, else its first seven tenths and last quarter."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) <= budget, t).otherwise(F.concat(F.substring(t, 1, budget * 7 // 10), F.lit(f"\n{LEFT_OUT}\n"), F.right(t, F.lit(budget // 4))))


def context_pages(pages: DataFrame, k: int = 2) -> DataFrame:
    """JON23: for each page of one full account number the nearest other pages of that account in its document, k at most,
    unless their banks conflict. Candidates are the k neighbours on either side, so no account's pages are paired."""
    bank = F.nullif(F.regexp_replace("bank", r"中国|股份有限公司|\s", ""), F.lit(""))
    own = pages.where(F.col("account").rlike(r"^\d{12,32}$")).withColumn("_b", bank)
    whole, order = Window.partitionBy("doc", "account"), Window.partitionBy("doc", "account").orderBy("page")
    sound = own.withColumn("_x", F.min("_b").over(whole)).withColumn("_y", F.max("_b").over(whole)).where(F.col("_x").isNull() | (F.col("_x") == F.col("_y")))
    around = F.array(*(F.lag("page", i).over(order) for i in range(1, k + 1)), *(F.lead("page", i).over(order) for i in range(1, k + 1)))
    spread = sound.select("doc", "page", around.alias("near")).select("doc", "page", F.explode("near").alias("other")).where(F.col("other").isNotNull())
    nearest = Window.partitionBy("doc", "page").orderBy(F.abs(F.col("other") - F.col("page")), "other")
    return spread.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def holder_suffix_accounts(short: DataFrame, full: DataFrame) -> DataFrame:
    """JON11: a number of twelve digits at least, printed without its first one to four, and the one longer number of the same
    named holder that ends with it. Both have ``number`` and ``holder``."""
    named = lambda df: df.select("number", F.trim("holder").alias("holder")).where((F.col("holder") != "") & ~F.col("holder").rlike("待核验|未知")).distinct()
    a = named(short).where(F.col("number").rlike(r"^\d{12,}$")).withColumn("tail", F.right("number", F.lit(12)))
    b = named(full).select(F.col("number").alias("account"), "holder", F.right("number", F.lit(12)).alias("tail"))
    met = a.join(b, ["holder", "tail"]).where((F.length("account") - F.length("number")).between(1, 4) & F.col("account").endswith(F.col("number")))
    return met.groupBy("number", "holder").agg(F.min("account").alias("account"), F.max("account").alias("other")).where(F.col("account") == F.col("other")).drop("other")


def instalments(ledger: DataFrame, pattern: str = INSTALMENT) -> DataFrame:
    """SEQ10: three rows in a row, of one statement and day, IN, OUT and OUT, of which the first tells of an instalment."""
    order = in_order()
    ahead = lambda c, k: F.lead(c, k).over(order)
    rows = ledger.select("tx_id", "dir", "d", F.concat_ws(" ", "type", "summary").alias("words"), ahead("tx_id", 1).alias("next_id"), ahead("tx_id", 2).alias("fee_id"), ahead("dir", 1).alias("d1"), ahead("dir", 2).alias("d2"), ahead("d", 1).alias("e1"), ahead("d", 2).alias("e2"))
    met = (F.col("dir") == "IN") & (F.col("d1") == "OUT") & (F.col("d2") == "OUT") & (F.col("d") == F.col("e1")) & (F.col("d") == F.col("e2")) & F.col("words").rlike(pattern)
    return rows.where(met).select("tx_id", "next_id", "fee_id")


def greedy_matches(a: pd.DataFrame, b: pd.DataFrame, fields: list[str]) -> list[tuple[str, str, int]]:
    """Rows equal in all fields one for one, then every row left the free row with the greatest weight of equal fields, the
    first among equals; a pair without any equal field is none."""
    left, right = a[fields].to_numpy(object), b[fields].to_numpy(object)
    weights = np.array([MATCH_WEIGHTS.get(f, 1) for f in fields])
    score = ((left[:, None, :] == right[None, :, :]) & (left[:, None, :] != "")) @ weights
    whole = (left[:, None, :] == right[None, :, :]).all(axis=2)
    free, out, rest = np.ones(len(b), bool), [], []
    for i in range(len(a)):
        same = np.nonzero(whole[i] & free)[0]
        if len(same):
            free[same[0]] = False
            out.append((a["rid"].iloc[i], b["rid"].iloc[same[0]], int(weights.sum())))
        else:
            rest.append(i)
    for i in rest:
        own = np.where(free, score[i], 0)
        if len(own) and own.max() > 0:
            j = int(own.argmax())
            free[j] = False
            out.append((a["rid"].iloc[i], b["rid"].iloc[j], int(own[j])))
    return out


def weighted_matches(left: DataFrame, right: DataFrame, page: list[str]) -> DataFrame:
    """EVA13: the rows of two readings of a page matched exactly first, then by weight. A page's rows are bounded by paper."""
    fields = [*MATCH_WEIGHTS, "counterparty_account"]
    flat = lambda df: df.select(*page, "rid", *(T.text(f).alias(f) for f in fields))

    def match(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = greedy_matches(a.sort_values("rid"), b.sort_values("rid"), fields) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["left_id", "right_id", "weight"])

    return flat(left).groupBy(*page).cogroup(flat(right).groupBy(*page)).applyInPandas(match, "left_id string, right_id string, weight int")


def checked_results(df: DataFrame, key: str, text: str) -> DataFrame:
    """JSN02: whether a recorded result is an object, and which keys it has, so that missing and foreign ones show."""
    parsed = F.try_parse_json(text)
    keys = F.json_object_keys(F.col(text))
    is_object = parsed.isNotNull() & F.trim(text).startswith("{")
    return df.select(key, F.when(F.coalesce(is_object, F.lit(False)), "OBJECT").otherwise("NOT_AN_OBJECT").alias("state"), F.when(is_object, F.array_join(F.array_sort(keys), ",")).otherwise("").alias("keys"))


def restored_values(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """FIX08: corrected amounts that the balance before doesn't support, or of statements with negative balances, get their
    first printed value back."""
    fits = F.col("bal") == F.lag("bal").over(in_order()) + signed()
    rows = ledger.select("tx_id", "doc", "acct", fits.alias("fits")).join(ledger.groupBy("doc", "acct").agg(F.coalesce(F.bool_or(F.col("bal") < 0), F.lit(False)).alias("credit")), ["doc", "acct"])
    ends = versions.groupBy("tx_id").agg(F.min_by(T.text("amount"), "ingested_at").alias("original"), F.max_by(T.text("amount"), "ingested_at").alias("current")).where(F.col("original") != F.col("current"))
    value = F.when(F.col("credit") | ~F.coalesce("fits", F.lit(False)), F.col("original")).otherwise(F.col("current"))
    return ends.join(rows, "tx_id").select("tx_id", "original", "current", value.alias("value"))
