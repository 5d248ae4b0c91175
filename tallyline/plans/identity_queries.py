"""Queries of the identity operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import identity as I
from tallyline.operators import pages as G
from tallyline.operators import sequence
from tallyline.operators.ledger import orders_ledger, read_accounts, read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans.core import ROW_KEY, table
from tallyline.plans.page_queries import _PAGES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_led, _acc, _sql, _id = read_ledger, read_accounts, P._sql, P._ident
_OWNER = f"CASE WHEN {P._reliable('acct')} THEN 'account|' || {_id('acct')} ELSE 'unverified|' || {_id('bank')} || '|' || {_id('acct')} END"
_add(
    "ER12_merged_chunks",
    lambda s, d: I.merged_chunks(_led(s, d)),
    _sql(f"SELECT arg_min(tx_id, (-coalesce(conf, 0), tx_id)) AS tx_id, count(*) AS n_readings FROM led GROUP BY {_OWNER}, page, rowno, coalesce(tm,''), dir, amt, bal, CASE WHEN cp_acct <> '' THEN cp_acct ELSE cp_name END"),
)
_SUM = rf"lower(regexp_replace({{c}}, '[{T.SPACES}\-_@#*|/\\.,:;，。、：；]', '', 'g'))"
_OV = "({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"
_PAIRS = f"""rp AS (SELECT *, {_id('acct')} AS part, regexp_extract(coalesce(tm,''), '(\\d{{2}}:\\d{{2}}(?::\\d{{2}})?)', 1) AS clock, {_SUM.replace('{c}', 'summary')} AS s, {_SUM.replace('{c}', 'cp_name')} AS n FROM led WHERE d IS NOT NULL AND amt IS NOT NULL),
met AS (SELECT a.tx_id AS id_1, b.tx_id AS id_2, a.bal IS NOT NULL AND b.bal IS NOT NULL AS balances, a.bal = b.bal AS same_bal, a.page > 0 AND b.page > 0 AS paged, a.page = b.page AS same_page, abs(a.page - b.page) >= 2 AS far, a.clock <> '' AND b.clock <> '' AS timed, a.clock = b.clock AS same_clock, length(a.clock) AS clocked,
  a.s AS s1, b.s AS s2, {_OV.format(a='a.s', b='b.s')} AS os, {_OV.format(a='a.n', b='b.n')} AS oname, a.raw_text <> '' AND a.raw_text = b.raw_text AS same_raw
  FROM rp a JOIN rp b ON a.doc = b.doc AND a.d = b.d AND a.amt = b.amt AND (a.page, a.rowno, a.tx_id) < (b.page, b.rowno, b.tx_id)
  WHERE NOT (a.part <> '' AND b.part <> '' AND a.part <> b.part) AND NOT (a.dir <> 'UNKNOWN' AND b.dir <> 'UNKNOWN' AND a.dir <> b.dir)
    AND NOT (a.clock <> '' AND b.clock <> '' AND NOT (substr(a.clock, 1, 5) = substr(b.clock, 1, 5) AND (length(a.clock) < 8 OR length(b.clock) < 8 OR a.clock = b.clock)))),
rep AS (SELECT id_1, id_2 FROM met WHERE CASE WHEN balances THEN same_bal AND CASE WHEN paged AND NOT same_page THEN CASE WHEN timed THEN same_clock WHEN s1 <> '' AND s2 <> '' THEN os ELSE far AND (oname OR s1 <> '' OR s2 <> '') END
    ELSE timed AND same_clock OR s1 <> '' AND s2 <> '' AND s1 = s2 OR s1 = '' AND s2 = '' END ELSE CASE WHEN paged AND same_page THEN same_raw ELSE timed AND same_clock AND clocked = 8 OR os OR oname END END)"""
_add("ER05_repeated_pairs", lambda s, d: I.repeated_pairs(_led(s, d)), _sql("SELECT * FROM rep", _PAIRS))


def _one_document(s: SparkSession, d: str) -> DataFrame:
    """The orders ledger as one document whose second reading starts on page 3."""
    return orders_ledger(s, d).withColumn("page", F.when(F.col("doc") == "DOC_B", 3).otherwise(1)).withColumn("doc", F.lit("ONE"))


_add("ER05_orders", lambda s, d: I.repeated_pairs(_one_document(s, d)), P._orders_sql(_sql("SELECT * FROM rep", _PAIRS.replace("rp AS (SELECT *,", "rp AS (SELECT * REPLACE ('ONE' AS doc, CASE WHEN doc = 'DOC_B' THEN 3 ELSE 1 END AS page),"))))
_add("ER04_repeated_rows", lambda s, d: I.repeated_rows(_one_document(s, d)))
_FILL = ["summary", "counterparty_name", "counterparty_account", "balance"]
_add(
    "ER06_enriched_rows",
    lambda s, d: I.enriched(table(s, d, "observations").dropDuplicates(["obs_id"]), "event_id", ["obs_id"], _FILL, "transaction_date"),
    "SELECT event_id, min(obs_id) AS first, count(*) AS n, " + ", ".join(f"arg_min({f}, obs_id) FILTER (coalesce({f},'') <> '') AS {f}" for f in _FILL) + ", arg_min(coalesce(transaction_date,''), (-length(coalesce(transaction_date,'')), obs_id)) AS transaction_date FROM (SELECT DISTINCT ON (obs_id) * FROM observations) GROUP BY 1",
)
_BANK = f"regexp_replace({_id('coalesce({c},{e})')}, '中国|股份有限公司|有限责任公司|银行', '', 'g')"


def _bare(c: str) -> str:
    return _BANK.replace("{c}", c).replace("{e}", "''")


_add(
    "ER14_same_accounts",
    lambda s, d: I.same_account_pairs(_acc(s, d)),
    f"""WITH x AS (SELECT source_document_id AS doc, {_id('account_number')} AS n, {_bare('bank_name')} AS b FROM accounts) SELECT p.doc AS doc_1, q.doc AS doc_2 FROM x p JOIN x q ON p.doc < q.doc AND p.n <> '' AND q.n <> ''
      AND (p.n = q.n OR (least(length(p.n), length(q.n)) >= 12 AND (ends_with(p.n, q.n) OR ends_with(q.n, p.n)))) AND (p.b = '' OR q.b = '' OR contains(p.b, q.b) OR contains(q.b, p.b))""",
)
_add(
    "ER11_evidenced_accounts",
    lambda s, d: I.evidenced_accounts(_led(s, d), _acc(s, d)),
    _sql(f"""SELECT tx_id, coalesce(max(local), min(CASE WHEN n = part OR (least(length(n), length(part)) >= 12 AND (ends_with(n, part) OR ends_with(part, n))) THEN n END), '') AS account FROM (SELECT tx_id, doc, page, {_id('acct')} AS part FROM led) r
      LEFT JOIN (SELECT doc, page, min(n) AS local FROM (SELECT source_document_id AS doc, {_id('account_number')} AS n, unnest(covered_pages) AS page FROM accounts WHERE {P._reliable('account_number')}) GROUP BY 1, 2 HAVING min(n) = max(n)) USING (doc, page)
      LEFT JOIN (SELECT source_document_id AS doc, {_id('account_number')} AS n FROM accounts WHERE {P._reliable('account_number')}) l USING (doc) GROUP BY 1"""),
)
_add(
    "ER16_filled_banks",
    lambda s, d: I.filled_banks(_acc(s, d), sequence.most_frequent(_led(s, d), ["doc"], "bank")),
    _sql("""SELECT source_document_id, CASE WHEN coalesce(bank_name,'') <> '' THEN bank_name ELSE coalesce(mode, '') END AS bank, coalesce(bank_name,'') = '' AS filled FROM accounts LEFT JOIN (SELECT doc, bank AS mode FROM (SELECT doc, bank, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, length(bank), bank) AS rn FROM led WHERE bank <> '' GROUP BY 1, 2) WHERE rn = 1) ON doc = source_document_id"""),
)
_add(
    "ER17_anchored_rows",
    lambda s, d: (lambda led: I.anchored_rows(led, G.pages_of(led)))(_led(s, d)),
    _sql(f"""SELECT tx_id, CASE WHEN state = 'FILLED' THEN account ELSE part END AS account, state FROM (SELECT tx_id, part, pg.account, CASE WHEN pg.account = '' THEN 'NO_ANCHOR' WHEN NOT reliable THEN 'FILLED' WHEN part = pg.account THEN 'AGREES' ELSE 'DISAGREES' END AS state
      FROM (SELECT tx_id, doc, page, {_id('acct')} AS part, {P._reliable('acct')} AS reliable FROM led) r JOIN pg USING (doc, page))""", _PAGES),
)
_add(
    "PRJ12_stored_numbers",
    lambda s, d: I.stored_numbers(_acc(s, d).select(F.col("source_document_id").alias("doc"), F.expr("substr(account_number, 1 + length(file_name) % 4)").alias("number")), _acc(s, d).select(F.col("source_document_id").alias("doc"), F.col("account_number").alias("number"))),
    """WITH a AS (SELECT DISTINCT source_document_id AS doc, substr(account_number, 1 + length(file_name) % 4) AS number FROM accounts), b AS (SELECT DISTINCT source_document_id AS doc, account_number AS long FROM accounts),
      m AS (SELECT *, max(length(long)) OVER (PARTITION BY doc, number) AS n FROM a JOIN b USING (doc) WHERE length(number) >= 10 AND length(long) - length(number) BETWEEN 1 AND 4 AND ends_with(long, number))
      SELECT doc, number, coalesce(CASE WHEN x = y THEN x END, number) AS stored FROM a LEFT JOIN (SELECT doc, number, min(long) AS x, max(long) AS y FROM m WHERE length(long) = n GROUP BY 1, 2) USING (doc, number)""",
)


def _aliases(s: SparkSession, d: str) -> DataFrame:
    acc = _acc(s, d).select(F.col("source_document_id").alias("doc"), F.col("account_number").alias("account"), T.text("account_name").alias("holder"))
    pairs = _led(s, d).select("doc", F.col("acct").alias("card")).distinct().join(acc, "doc")
    return I.printed_aliases(pairs.select("card", "account", "holder"), acc.select("account", "holder"))


_add(
    "JON09_printed_aliases",
    _aliases,
    _sql("""SELECT DISTINCT card, account, trim(holder, ' ') AS holder FROM (SELECT card, holder, min(account) AS account FROM (SELECT DISTINCT l.acct AS card, a.account_number AS account, coalesce(a.account_name,'') AS holder FROM led l JOIN accounts a ON a.source_document_id = l.doc WHERE l.acct <> '') GROUP BY 1, 2 HAVING min(account) = max(account))
      WHERE (account, trim(holder, ' ')) IN (SELECT account_number, trim(account_name, ' ') FROM accounts WHERE trim(account_name, ' ') <> '' AND NOT regexp_matches(account_name, '待核|未知'))"""),
)


def _bound(s: SparkSession, d: str) -> DataFrame:
    led = _led(s, d).join(_acc(s, d).select(F.col("source_document_id").alias("doc"), F.col("account_number").alias("full")), "doc")
    rows = led.select(F.expr("substr(full, 3)").alias("number"), "holder", "d", "bal", F.struct("page", "rowno", "tx_id").alias("ord"))
    inventory = led.groupBy(F.col("full").alias("account"), "holder").agg(F.max_by("bal", F.when(F.col("bal").isNotNull() & F.col("d").isNotNull(), F.struct("d", "page", "rowno", "tx_id"))).alias("balance"), F.max("d").alias("day"))
    return I.bound_inventory(rows, inventory)


_add(
    "JON12_bound_inventory",
    _bound,
    _sql("""SELECT number, holder, min(account) AS account FROM (SELECT number, holder, arg_max(bal, (d, page, rowno, tx_id)) AS bal, max(d) AS d FROM r WHERE d IS NOT NULL AND bal IS NOT NULL AND holder <> '' GROUP BY 1, 2 HAVING count(*) >= 2) x
      JOIN (SELECT account, holder, arg_max(bal, (d, page, rowno, tx_id)) FILTER (bal IS NOT NULL AND d IS NOT NULL) AS balance, max(d) AS day FROM r GROUP BY 1, 2) i USING (holder)
      WHERE regexp_matches(number, '^\\d{12,28}$') AND number NOT IN (SELECT account FROM r) AND ends_with(account, number) AND length(account) - length(number) BETWEEN 1 AND 4 AND balance = x.bal AND day >= x.d GROUP BY 1, 2 HAVING min(account) = max(account)""",
      "r AS (SELECT led.*, a.account_number AS account, substr(a.account_number, 3) AS number FROM led JOIN accounts a ON a.source_document_id = led.doc)"),
)


def _met(s: SparkSession, d: str) -> DataFrame:
    a, b = P._cells(s, d, "assembled_rows").withColumnRenamed("rid", "left_id"), P._cells(s, d, "independent_rows").withColumnRenamed("rid", "right_id")
    flat = lambda df: df.withColumns({c: T.text(c) for c in ("account_number", "transaction_date", "transaction_time")})
    return I.page_candidates(flat(a), flat(b), ROW_KEY[:2], "account_number", "transaction_date", "transaction_time")


def _counted(n: str, key: str, last: str) -> str:
    return f"(SELECT source_document_id, page_no, {key}, count(*) AS k, min(rid) AS one FROM {n} WHERE {last} <> '' GROUP BY ALL)"


_FLAT = "{n} AS (SELECT source_document_id, page_no, rid, coalesce(account_number,'') AS o, coalesce(transaction_date,'') AS dy, coalesce(transaction_time,'') AS tt FROM {t})"
_add(
    "JON13_page_candidates",
    _met,
    "WITH " + ", ".join([*P._AB, _FLAT.format(n="l", t="a"), _FLAT.format(n="r", t="b")]) + ", sg AS (SELECT source_document_id, page_no, x.u AND y.u AS single FROM (SELECT source_document_id, page_no, count(DISTINCT o) = 1 AS u FROM l GROUP BY 1, 2) x JOIN (SELECT source_document_id, page_no, count(DISTINCT o) = 1 AS u FROM r GROUP BY 1, 2) y USING (source_document_id, page_no)) "
    + "SELECT left_id, c AS right_id, CASE WHEN c IS NOT NULL THEN 'MATCHED' WHEN ld = 1 AND none THEN 'UNMATCHED' ELSE 'AMBIGUOUS' END AS kind FROM (SELECT l.rid AS left_id, l2.k AS ld, coalesce(r2.k, 0) = 0 AS none, CASE WHEN l1.k = 1 AND r1.k = 1 THEN r1.one WHEN l2.k = 1 AND r2.k = 1 THEN r2.one WHEN coalesce(r2.k, 0) = 0 AND coalesce(single, false) AND l3.k = 1 AND r3.k = 1 THEN r3.one END AS c FROM l LEFT JOIN sg USING (source_document_id, page_no) "
    + " ".join(f"LEFT JOIN {_counted(n, key, last)} {n}{i} USING (source_document_id, page_no, {key})" for i, key, last in ((1, "o, dy, tt", "tt"), (2, "o, dy", "dy"), (3, "dy", "dy")) for n in ("l", "r")) + ")",
)
