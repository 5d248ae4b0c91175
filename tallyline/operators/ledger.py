"""The typed ledger: one row a transaction, exact decimals, real dates, ``''`` for absent texts, NULL for absent balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import timestamps
from tallyline.session import written_once

MONEY = r"^-?\d{1,15}(\.\d{1,2})?$"


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of every key. Versions are combined on the map side, so a key repeated without end costs one row a partition."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def _printed_days(raw: DataFrame, accounts: DataFrame) -> DataFrame:
    """The days of each transaction that aren't written plainly, one entry a version and spelling. Only these rows move: the
    ledger is already spread by transaction when they join it."""
    days = timestamps.normalise_days(raw, accounts, "tx_id", "transaction_time", "transaction_date", "source_document_id", "branch_zone")
    return days.groupBy("tx_id").agg(F.collect_set(F.when(F.col("day").isNotNull(), F.struct("source_document_id", "value", "day"))).alias("_days"))


def read_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed ledger of a folder. Reading print is costly and every ledger query needs it, so the typed rows are written
    once an application, narrow and by column, and each query reads the columns it needs."""
    paths = [f"{sf_dir}/bank_transactions.parquet", f"{sf_dir}/accounts.parquet"]
    return written_once(spark, "ledger", paths, lambda: typed_ledger(spark, sf_dir))


def typed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and amounts in every printed form that names one: a day or amount is NULL only if there is none, or none settled."""
    raw = spark.read.parquet(f"{sf_dir}/bank_transactions.parquet")
    bare = F.regexp_replace("amount", "[,¥]", "")
    plain_day = F.when(F.col("transaction_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("transaction_date", 1, 10)).try_cast("date")
    own = F.filter("_days", lambda x: x["source_document_id"].eqNullSafe(F.col("source_document_id")) & (x["value"] == F.col("transaction_date")))
    word = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    rows = latest(raw, "tx_id", "ingested_at").join(_printed_days(raw, read_accounts(spark, sf_dir)), "tx_id", "left")
    # each step a projection of its own, which keeps the generated code of any one small
    rows = rows.withColumn("_d", F.coalesce(plain_day, F.get(own, F.lit(0))["day"])).withColumn("_plain", F.when(bare.rlike(MONEY), bare.try_cast("decimal(18,2)")))
    rows = rows.withColumn("_amount", F.when(F.col("_plain").isNull(), T.amount_text("amount"))).withColumn("_date", F.when(F.col("_d").isNull(), F.col("transaction_date")))
    return rows.select(
        "tx_id", F.col("source_document_id").alias("doc"), word("account_number", "acct"), word("account_name", "holder"), word("bank_name", "bank"),
        F.col("transaction_time").alias("tm"), F.coalesce("_d", T.date_of("_date")).alias("d"), word("direction", "dir"), F.coalesce("_plain", T.money("_amount")).alias("amt"),
        F.when(F.coalesce("balance_available", F.lit(True)), F.col("balance")).alias("bal"),
        word("counterparty_name", "cp_name"), word("counterparty_account", "cp_acct"), word("counterparty_bank", "cp_bank"),
        word("transaction_type", "type"), word("summary", "summary"), word("raw_text", "raw_text"), word("raw_source_file", "file"),
        F.coalesce("raw_page_number", F.lit(0)).alias("page"), F.coalesce("raw_row_index", F.lit(0)).alias("rowno"),
        word("review_status", "status"), F.col("extraction_confidence").alias("conf"), word("duplicate_of_transaction_id", "dup_of"),
    )


def read_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/accounts.parquet")


def read_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/cases.parquet")


def with_case(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """The case of each row by its document. Documents differ much in size: rows are spread over 16 parts of a document."""
    salt = F.pmod(F.xxhash64("tx_id"), F.lit(16)).cast("int")
    dims = accounts.select(F.col("source_document_id").alias("doc"), "case_number", "owner_type").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return ledger.withColumn("salt", salt).join(dims, ["doc", "salt"], "left").drop("salt")


def _amount_sql(c: str) -> str:
    """An amount from print, as the SQL side reads it."""
    odd, plain, several = T.amount_forms()
    one = f"translate(coalesce({c},''), '{odd}', '{plain}')"
    spelled = one
    for a, b in several.items():
        spelled = f"replace({spelled}, '{a}', '{b}')"
    text = f"(CASE WHEN regexp_matches({one}, '[{''.join(several)}]') THEN {spelled} ELSE {one} END)"
    bare = f"regexp_replace({text}, '[{T.SPACES}¥￥]|元$', '', 'g')"
    return rf"CASE WHEN regexp_matches({bare}, '^[+-]?(\d{{1,3}}(,\d{{3}})+|\d{{1,15}})(\.\d{{1,2}})?$') THEN TRY_CAST(replace({bare}, ',', '') AS DECIMAL(18,2)) END"


def _day_sql(t: str) -> str:
    """A day that isn't written plainly, from its trimmed text in capitals; years last are read in the order of the branch's country."""
    day = lambda p, y, m, d: f"TRY_CAST(regexp_extract({t}, '{p}', {y}) || '-' || regexp_extract({t}, '{p}', {m}) || '-' || regexp_extract({t}, '{p}', {d}) AS DATE)"
    named = lambda p, y, m, d: f"TRY_CAST(regexp_extract({t}, '{p}', {y}) || '-' || CAST((position(regexp_extract({t}, '{p}', {m}) IN 'JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC') + 2) / 3 AS INT) || '-' || regexp_extract({t}, '{p}', {d}) AS DATE)"
    p = {k: v for k, v in timestamps.day_patterns().items()}
    return rf"""CASE WHEN regexp_matches({t}, '^\d{{5}}(\.0*)?$') THEN DATE '1899-12-30' + CAST(regexp_extract({t}, '^(\d{{5}})', 1) AS INT)
      WHEN regexp_matches({t}, '{p["first"]}') THEN {day(p["first"], 1, 2, 3)} WHEN regexp_matches({t}, '{p["stamp"]}') THEN {day(p["stamp"], 1, 2, 3)} WHEN regexp_matches({t}, '{p["compact"]}') THEN {day(p["compact"], 1, 2, 3)}
      WHEN regexp_matches({t}, '{p["last"]}') THEN CASE WHEN month_first THEN {day(p["last"], 3, 1, 2)} ELSE {day(p["last"], 3, 2, 1)} END
      WHEN regexp_matches({t}, '{p["day_name"]}') THEN {named(p["day_name"], 3, 2, 1)} WHEN regexp_matches({t}, '{p["name_day"]}') THEN {named(p["name_day"], 3, 1, 2)} END"""


_SQL_TEXT = f"regexp_replace(coalesce(transaction_date,''), '[{T.SPACES}]', '', 'g')"
#: The same ledger for the SQL side, in which a year-last day is read in the order of the branch's country.
LEDGER_SQL = rf"""
led AS (
  SELECT tx_id, doc, acct, holder, bank, tm, coalesce(plain_d, CASE WHEN odd THEN {_day_sql("txt")} END,
      CASE WHEN regexp_matches(sq, '^(19|20)\d{{2}}[-/.年]\d{{1,2}}[-/.月]\d{{1,2}}日?') THEN TRY_CAST(regexp_replace(sq, '^(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}}).*$', '\1-\2-\3') AS DATE)
        WHEN regexp_matches(sq, '^(19|20)\d{{6}}$') THEN TRY_CAST(substr(sq,1,4) || '-' || substr(sq,5,2) || '-' || substr(sq,7,2) AS DATE) END) AS d,
    dir, amt, bal, cp_name, cp_acct, cp_bank, type, summary, raw_text, file, page, rowno, status, conf, dup_of FROM (
    SELECT tx_id, source_document_id AS doc, coalesce(b.account_number,'') AS acct, coalesce(b.account_name,'') AS holder, coalesce(b.bank_name,'') AS bank,
      transaction_time AS tm, coalesce(regexp_matches(a.branch_zone, '{timestamps.MONTH_FIRST_ZONES}'), false) AS month_first,
      CASE WHEN regexp_matches(transaction_date, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN TRY_CAST(substr(transaction_date,1,10) AS DATE) END AS plain_d,
      coalesce(transaction_date,'') <> '' AND NOT regexp_matches(transaction_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') AS odd,
      upper(trim(transaction_date, ' ')) AS txt, {_SQL_TEXT} AS sq,
      coalesce(direction,'') AS dir,
      CASE WHEN regexp_matches(regexp_replace(amount,'[,¥]','','g'), '^-?\d{{1,15}}(\.\d{{1,2}})?$') THEN CAST(regexp_replace(amount,'[,¥]','','g') AS DECIMAL(18,2)) ELSE {_amount_sql("amount")} END AS amt,
      CASE WHEN coalesce(balance_available,true) THEN balance END AS bal,
      coalesce(counterparty_name,'') AS cp_name, coalesce(counterparty_account,'') AS cp_acct, coalesce(counterparty_bank,'') AS cp_bank,
      coalesce(transaction_type,'') AS type, coalesce(summary,'') AS summary, coalesce(raw_text,'') AS raw_text, coalesce(raw_source_file,'') AS file,
      coalesce(raw_page_number,0) AS page, coalesce(raw_row_index,0) AS rowno, coalesce(review_status,'') AS status, extraction_confidence AS conf,
      coalesce(duplicate_of_transaction_id,'') AS dup_of,
      row_number() OVER (PARTITION BY tx_id ORDER BY ingested_at DESC) AS rn
    FROM bank_transactions b LEFT JOIN (SELECT source_document_id, min(branch_zone) AS branch_zone FROM accounts GROUP BY 1) a USING (source_document_id)) WHERE rn = 1)
"""


#: A ledger derived from the orders table, with rows in two documents, transfers between own accounts and repayments. The
#: statement runs unchanged in Spark and in the SQL that checks it.
ORDERS_LEDGER_SQL = """
SELECT CONCAT('TX_', LPAD(CAST(k AS STRING), 10, '0'), '_', CAST(leg AS STRING)) AS tx_id, CASE WHEN leg = 2 THEN 'DOC_B' ELSE 'DOC_A' END AS doc,
  CONCAT('6222', LPAD(CAST(cust AS STRING), 12, '0')) AS acct, '' AS holder, '' AS bank, CAST(NULL AS STRING) AS tm, d, dir, amt, CAST(NULL AS DECIMAL(18,2)) AS bal,
  CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN '甲乙保险有限公司' WHEN k % 13 = 0 THEN 'ATM' ELSE CONCAT('对手', CAST(k % 400 AS STRING)) END AS cp_name,
  CASE WHEN own_cp IS NOT NULL THEN CONCAT('6222', LPAD(CAST(own_cp AS STRING), 12, '0')) WHEN k % 3 = 0 THEN CONCAT('9558', LPAD(CAST(k % 400 AS STRING), 12, '0')) ELSE '' END AS cp_acct,
  '' AS cp_bank, '' AS type, CASE CAST(k % 12 AS INT) WHEN 0 THEN '还借款' WHEN 1 THEN '工资' WHEN 2 THEN '取现' WHEN 3 THEN '生活费' WHEN 4 THEN '借出款' WHEN 5 THEN '司法划扣' WHEN 6 THEN '保费'
    WHEN 7 THEN '理财申购' WHEN 8 THEN '销户结清' WHEN 9 THEN '货款往来' WHEN 10 THEN '结息' ELSE '' END AS summary,
  '' AS raw_text, '' AS file, 1 AS page, CAST(k AS INT) AS rowno, '' AS status, CAST(NULL AS DOUBLE) AS conf, '' AS dup_of
FROM (
  SELECT k, 0 AS leg, cust, d, dir, amt, CASE WHEN k % 10 = 0 THEN cust + 1 END AS own_cp FROM {base}
  UNION ALL SELECT k, 1, cust + 1, d + CAST(k % 3 AS INT), CASE dir WHEN 'OUT' THEN 'IN' WHEN 'IN' THEN 'OUT' ELSE dir END, amt, CASE WHEN k % 20 = 0 THEN cust END FROM {base} WHERE k % 10 = 0
  UNION ALL SELECT k, 2, cust, d, dir, amt, CASE WHEN k % 10 = 0 THEN cust + 1 END FROM {base} WHERE k % 25 = 0)
"""
ORDERS_BASE_SQL = """(SELECT o_orderkey AS k, o_custkey AS cust, CAST(o_orderdate AS DATE) AS d, CASE o_orderstatus WHEN 'F' THEN 'OUT' WHEN 'O' THEN 'IN' ELSE 'UNKNOWN' END AS dir, CAST(o_totalprice AS DECIMAL(18,2)) AS amt FROM {orders})"""


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ORDERS_LEDGER_SQL.replace("{base}", ORDERS_BASE_SQL), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def orders_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five customers own their accounts."""
    number = F.concat(F.lit("6222"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(F.lit("DOC_A").alias("source_document_id"), number.alias("account_number"), F.when(F.col("c_custkey") % 5 < 4, "DEBTOR_MAIN").otherwise("UNKNOWN").alias("owner_type"), F.lit("").alias("case_number"))


ORDERS_CTE = "led AS (" + ORDERS_LEDGER_SQL.replace("{base}", ORDERS_BASE_SQL).replace("{orders}", "orders") + ")"
