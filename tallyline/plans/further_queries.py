"""Queries of further projections, summaries and guards, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import printed as R
from tallyline.functions import text as T
from tallyline.operators import further as X
from tallyline.operators import pages as G
from tallyline.operators.ledger import read_accounts, read_ledger
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
_SAFE = "regexp_replace({c}, '[^0-9A-Za-z]', '', 'g')"
_add(
    "PRJ01_observation_ids",
    lambda s, d: X.observation_ids(_led(s, d)),
    _sql(f"SELECT tx_id, 'TX_' || right({_SAFE.replace('{c}', 'doc')}, 16) || '_P' || page || '_R' || rowno || '_' || right({_SAFE.replace('{c}', 'tx_id')}, 32) AS observation_id FROM led"),
)
_add(
    "PRJ08_public_warnings",
    lambda s, d: table(s, d, "documents").select("doc_id", X.public_warning(F.concat(F.lit("Gemini 3.8 Flash 直传 "), T.text("text"), F.lit(" qwen"))).alias("warning")),
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('Gemini 3.8 Flash 直传 ' || coalesce(text,'') || ' qwen', '(?i)Gemini(?:\\s*3\\.8\\s*Flash)?', '智能识别', 'g'), '(?i)Qwen', '智能识别', 'g'), '智能识别\\s*直传', '智能识别', 'g') AS warning FROM documents",
)
_add(
    "GRA02_row_accounts",
    lambda s, d: X.row_accounts(_led(s, d), _acc(s, d)),
    _sql(f"""SELECT tx_id, CASE WHEN m IS NOT NULL THEN 'account|' || {_id('m')} ELSE 'synthetic|' || doc || '|' || {_id('acct')} END AS node, m IS NULL AS synthetic FROM led LEFT JOIN (SELECT source_document_id, {_id('account_number')} AS part, min(account_number) AS m FROM accounts GROUP BY 1, 2) a ON a.source_document_id = doc AND a.part = {_id('acct')}"""),
)
_MASTER = P._MASTER
_add(
    "AGG04_account_summaries",
    lambda s, d: X.account_summaries(_led(s, d)),
    _sql(f"""SELECT account, n_rows, total_in, total_out, start_date, end_date, pages, coalesce(mode, '待核验银行') AS bank, start_balance, end_balance, CAST(abs(start_balance + total_in - total_out - end_balance) AS DECIMAL(28,2)) AS difference, start_balance + total_in - total_out - end_balance = 0 AS is_balanced,
      CASE WHEN doubtful THEN 'NEEDS_REVIEW' ELSE 'COMPLETE' END AS status FROM (SELECT account, count(*) AS n_rows, {P._IN} AS total_in, {P._OUT} AS total_out, min(d) AS start_date, max(d) AS end_date, count(DISTINCT (doc, page)) AS pages, bool_or(coalesce(conf, 1) < 0.8 OR amt IS NULL OR d IS NULL OR dir NOT IN ('IN','OUT')) AS doubtful,
      CAST(arg_min(bal - coalesce({P._SIGN}, 0), (d, doc, page, rowno, tx_id)) FILTER (bal IS NOT NULL AND d IS NOT NULL) AS DECIMAL(20,2)) AS start_balance, CAST(arg_max(bal, (d, doc, page, rowno, tx_id)) FILTER (bal IS NOT NULL AND d IS NOT NULL) AS DECIMAL(20,2)) AS end_balance FROM (SELECT *, {_MASTER} AS account FROM led) GROUP BY 1)
      LEFT JOIN (SELECT account, bank AS mode FROM (SELECT account, bank, row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, length(bank), bank) AS rn FROM (SELECT *, {_MASTER} AS account FROM led) WHERE bank <> '' AND NOT regexp_matches(bank, '{R.UNVERIFIED}') AND regexp_matches(bank, '{R.BANK_KINDS}') GROUP BY 1, 2) WHERE rn = 1) USING (account)"""),
)
_add(
    "STR12_excerpts",
    lambda s, d: table(s, d, "documents").select("doc_id", X.excerpt(F.col("text"), 400).alias("text")),
    "SELECT doc_id, CASE WHEN length(coalesce(text,'')) <= 400 THEN coalesce(text,'') ELSE substr(text, 1, 280) || chr(10) || '" + X.LEFT_OUT + "' || chr(10) || right(text, 100) END AS text FROM documents",
)
_add(
    "JON23_owner_pages",
    lambda s, d: X.context_pages(G.pages_of(_led(s, d))),
    _sql("""SELECT doc, page, other, rank::INT AS rank FROM (SELECT p.doc, p.page, q.page AS other, row_number() OVER (PARTITION BY p.doc, p.page ORDER BY abs(q.page - p.page), q.page) AS rank FROM own p JOIN own q ON p.doc = q.doc AND p.account = q.account AND p.page <> q.page) WHERE rank <= 2""",
      _PAGES, "own AS (SELECT doc, page, account FROM (SELECT *, min(nullif(k,'')) OVER w AS x, max(nullif(k,'')) OVER w AS y FROM (SELECT *, regexp_replace(bank, '中国|股份有限公司|\\s', '', 'g') AS k FROM pg WHERE regexp_matches(account, '^\\d{12,32}$')) WINDOW w AS (PARTITION BY doc, account)) WHERE x IS NULL OR x = y)"),
)


def _held(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    acc = _acc(s, d)
    short = acc.select(F.expr("substr(account_number, 4)").alias("number"), T.text("account_name").alias("holder"))
    return short, acc.select(F.col("account_number").alias("number"), T.text("account_name").alias("holder"))


_add(
    "JON11_holder_accounts",
    lambda s, d: X.holder_suffix_accounts(*_held(s, d)),
    """SELECT a.number, holder, min(b.number) AS account FROM (SELECT DISTINCT substr(account_number, 4) AS number, trim(coalesce(account_name,''), ' ') AS holder FROM accounts) a JOIN (SELECT DISTINCT account_number AS number, trim(coalesce(account_name,''), ' ') AS holder FROM accounts) b USING (holder)
      WHERE holder <> '' AND NOT regexp_matches(holder, '待核验|未知') AND regexp_matches(a.number, '^\\d{12,}$') AND length(b.number) - length(a.number) BETWEEN 1 AND 4 AND ends_with(b.number, a.number) GROUP BY 1, 2 HAVING min(b.number) = max(b.number)""",
)
_add(
    "SEQ10_instalments",
    lambda s, d: X.instalments(_led(s, d)),
    _sql("""SELECT tx_id, next_id, fee_id FROM (SELECT *, lead(tx_id) OVER w AS next_id, lead(tx_id, 2) OVER w AS fee_id, lead(dir) OVER w AS d1, lead(dir, 2) OVER w AS d2, lead(d) OVER w AS e1, lead(d, 2) OVER w AS e2 FROM led WINDOW w AS (PARTITION BY doc, acct ORDER BY page, rowno, tx_id))
      WHERE dir = 'IN' AND d1 = 'OUT' AND d2 = 'OUT' AND d = e1 AND d = e2 AND regexp_matches(type || ' ' || summary, '""" + X.INSTALMENT + "')"),
)
_add(
    "EVA13_weighted_matches",
    lambda s, d: X.weighted_matches(P._cells(s, d, "assembled_rows"), P._cells(s, d, "independent_rows"), ROW_KEY[:2]),
)
_add(
    "JSN02_valid_results",
    lambda s, d: X.checked_results(table(s, d, "events"), "event_id", "props"),
    """SELECT event_id, CASE WHEN NOT json_valid(props) OR json_type(props) <> 'OBJECT' THEN 'NOT_AN_OBJECT' ELSE 'OBJECT' END AS state, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN array_to_string(list_sort(json_keys(props)), ',') ELSE '' END AS keys FROM events""",
)
_add(
    "FIX08_restored_values",
    lambda s, d: X.restored_values(table(s, d, "bank_transactions").where("ingested_at IS NOT NULL"), _led(s, d)),
    _sql("""SELECT v.tx_id, v.original, v.current, CASE WHEN credit OR NOT coalesce(fits, false) THEN v.original ELSE v.current END AS value FROM (SELECT tx_id, arg_min(coalesce(amount,''), ingested_at) AS original, arg_max(coalesce(amount,''), ingested_at) AS current FROM bank_transactions WHERE ingested_at IS NOT NULL GROUP BY 1) v
      JOIN (SELECT tx_id, doc, acct, bal = lag(bal) OVER w + CASE WHEN dir = 'IN' THEN amt WHEN dir = 'OUT' THEN -amt END AS fits FROM led WINDOW w AS (PARTITION BY doc, acct ORDER BY page, rowno, tx_id)) l USING (tx_id) JOIN (SELECT doc, acct, coalesce(bool_or(bal < 0), false) AS credit FROM led GROUP BY 1, 2) USING (doc, acct) WHERE v.original <> v.current"""),
)
