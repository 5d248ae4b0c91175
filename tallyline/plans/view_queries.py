"""Queries of the smaller views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import events, views
from tallyline.operators.ledger import orders_accounts, orders_ledger, read_accounts, read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans.core import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


_led, _sql = read_ledger, P._sql
_W = "OVER (PARTITION BY doc ORDER BY page, rowno, tx_id"
_add("SEQ01_source_order", lambda s, d: views.source_order(_led(s, d)), _sql(f"SELECT tx_id, (row_number() {_W}))::INT AS place FROM led"))
_add(
    "SEQ15_nearest_bank",
    lambda s, d: views.nearest_bank(_led(s, d)),
    _sql(f"SELECT tx_id, coalesce(p, n, '') AS filled FROM (SELECT tx_id, bank, last_value(nullif(bank,'') IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(nullif(bank,'') IGNORE NULLS) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM led) WHERE bank = ''"),
)
_add(
    "PRJ05_rows_of_accounts",
    lambda s, d: views.of_accounts(_led(s, d), read_accounts(s, d)),
    _sql(f"SELECT tx_id FROM led WHERE EXISTS (SELECT 1 FROM accounts a WHERE a.source_document_id = doc AND {P._ident('a.account_number')} = {P._ident('acct')})"),
)
_add("AGG05_rows_by_account", lambda s, d: views.rows_by_account(_led(s, d), read_accounts(s, d)), _sql("SELECT source_document_id, account_number, coalesce(n, 0) AS n_rows FROM accounts LEFT JOIN (SELECT doc, count(*) AS n FROM led GROUP BY 1) ON doc = source_document_id"))
_add(
    "SNK06_flow_chart",
    lambda s, d: views.flow_chart(_led(s, d)),
    _sql(f"SELECT CASE WHEN dir = 'IN' THEN flow ELSE 'ACCOUNT' END AS src, CASE WHEN dir = 'IN' THEN 'ACCOUNT' ELSE flow END AS dst, CAST(sum(amt) AS DECIMAL(28,2)) AS total, count(*) AS n_rows FROM (SELECT *, {P._FLOW} AS flow FROM led) WHERE flow IS NOT NULL AND amt IS NOT NULL GROUP BY 1, 2"),
)
_add(
    "TOP04_best_pairs",
    lambda s, d: views.best_pairs(events.transfer_candidates(orders_ledger(s, d), orders_accounts(s, d))),
    P.ORACLE_SQL["JON02_orders"].replace("SELECT o.tx_id AS out_id", "SELECT out_id, in_id, score FROM (SELECT *, row_number() OVER (PARTITION BY out_id ORDER BY score DESC, in_id) AS rn FROM (SELECT o.tx_id AS out_id", 1) + ")) WHERE rn = 1",
)
_add(
    "ER09_overlapping_documents",
    lambda s, d: views.overlapping_documents(_led(s, d), 1, 1),
    _sql("SELECT a.doc AS doc_1, b.doc AS doc_2, count(*) AS n_anchors, count(DISTINCT a.d) AS n_days FROM o a JOIN o b ON a.doc < b.doc AND a.d = b.d AND a.dir = b.dir AND a.amt = b.amt AND a.bal = b.bal GROUP BY 1, 2", "o AS (SELECT doc, d, dir, amt, bal FROM led WHERE d IS NOT NULL AND amt IS NOT NULL AND bal IS NOT NULL GROUP BY ALL HAVING count(*) = 1)"),
)
_ROW = ["source_document_id", "page_no", "row_no"]


def _times(s: SparkSession, d: str) -> DataFrame:
    a, b = P._cells(s, d, "assembled_rows").alias("a"), P._cells(s, d, "independent_rows").alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in _ROW])
    return joined.select("a.rid", views.times_compatible(F.col("a.transaction_time"), F.col("b.transaction_time")).alias("compatible"))


_M, _S = r"regexp_extract(coalesce({c},''), '(\d{{2}}:\d{{2}})', 1)", r"regexp_extract(coalesce({c},''), '\d{{2}}:\d{{2}}:(\d{{2}})', 1)"
_x, _y = "a.transaction_time", "b.transaction_time"
_add(
    "DAT06_compatible_times",
    _times,
    "WITH " + ", ".join(P._AB) + f" SELECT a.rid, ({_M.format(c=_x)} = '' OR {_M.format(c=_y)} = '' OR ({_M.format(c=_x)} = {_M.format(c=_y)} AND ({_S.format(c=_x)} = '' OR {_S.format(c=_y)} = '' OR {_S.format(c=_x)} = {_S.format(c=_y)}))) AS compatible FROM a JOIN b USING ({', '.join(_ROW)})",
)
_B = "regexp_replace(coalesce(balance,''), '[,，¥￥ ]', '', 'g')"
_add(
    "NUM02_loose_numbers",
    lambda s, d: table(s, d, "observations").select("obs_id", views.loose_number(F.col("balance")).alias("value")).distinct(),
    rf"SELECT DISTINCT obs_id, CASE WHEN regexp_matches({_B}, '-\d|^\(.*\)$') THEN -v ELSE v END AS value FROM (SELECT *, CAST(nullif(regexp_extract({_B}, '(\d+(?:\.\d+)?)', 1), '') AS DECIMAL(18,2)) AS v FROM observations)",
)
_add(
    "STR07_bounded_distance",
    lambda s, d: _led(s, d).where(F.col("acct").rlike("^[0-9]+$") & F.col("cp_acct").rlike("^[0-9]+$")).select("tx_id", F.levenshtein("acct", "cp_acct", 5).alias("distance")),
    _sql("SELECT tx_id, CASE WHEN levenshtein(acct, cp_acct) <= 5 THEN levenshtein(acct, cp_acct)::INT ELSE -1 END AS distance FROM led WHERE regexp_matches(acct, '^[0-9]+$') AND regexp_matches(cp_acct, '^[0-9]+$')"),
)
_add(
    "STR02_plain_texts",
    lambda s, d: _led(s, d).select("tx_id", T.plain_text("cp_name").alias("plain"), T.person_name("cp_name").alias("person")),
    _sql(rf"SELECT tx_id, lower(regexp_replace(cp_name, '[{T.SPACES}\-_—–·•,，。.、:：;；/\\()（）]', '', 'g')) AS plain, lower(regexp_replace(cp_name, '[{T.SPACES}·•]', '', 'g')) AS person FROM led"),
)
_K = ["page_no", "row_no", "amount", "balance"]
_add(
    "EVA04_suite_totals",
    lambda s, d: views.suite_totals(P._cells(s, d, "assembled_rows"), P._cells(s, d, "independent_rows"), "source_document_id", _K),
    "WITH " + ", ".join(P._AB) + f", u AS (SELECT source_document_id, {', '.join(_K)}, 1 AS x, 0 AS y FROM a UNION ALL SELECT source_document_id, {', '.join(_K)}, 0, 1 FROM b), g AS (SELECT source_document_id, sum(x) AS x, sum(y) AS y FROM u GROUP BY source_document_id, {', '.join(_K)}) SELECT source_document_id, sum(x)::BIGINT AS n_expected, sum(y)::BIGINT AS n_delivered, sum(least(x, y))::BIGINT AS n_right FROM g GROUP BY 1",
)
