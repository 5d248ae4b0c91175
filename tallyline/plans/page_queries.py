"""Queries of page operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.operators import pages as G
from tallyline.operators.ledger import read_accounts, read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans.scalar_queries import _bank_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


_led, _acc, _sql = read_ledger, read_accounts, P._sql
_PAGES = f"""pg AS (SELECT doc, page, count(*) AS n_rows, coalesce(CASE WHEN min(b) = max(b) THEN min(b) END, '') AS bank, coalesce(CASE WHEN min(k) = max(k) THEN min(k) END, '') AS account, round(avg(conf), 6) AS conf
  FROM (SELECT *, nullif({_bank_sql('bank')}, '') AS b, CASE WHEN {P._reliable('acct')} THEN {P._ident('acct')} END AS k FROM led WHERE page > 0) GROUP BY 1, 2)"""
_RUNS = f"""runs AS (SELECT * EXCLUDE (f), sum(f) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(run_bank) OVER (PARTITION BY doc ORDER BY page) <> run_bank THEN 1 ELSE 0 END AS f FROM (
  SELECT * EXCLUDE (s), coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(s IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '{G.UNCONFIRMED}') AS run_bank
  FROM (SELECT *, CASE WHEN bank <> '' AND coalesce(conf, 0) >= 0.5 THEN bank END AS s FROM pg))))"""


def _pages(s: SparkSession, d: str) -> DataFrame:
    return G.pages_of(_led(s, d))


def _runs(s: SparkSession, d: str) -> DataFrame:
    return G.bank_runs(_pages(s, d))


_add("SEQ18_bank_groups", lambda s, d: G.bank_groups(_runs(s, d)), _sql("SELECT doc, run, min(run_bank) AS bank, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, round(avg(conf), 4) AS confidence FROM runs GROUP BY 1, 2", _PAGES, _RUNS))
_add(
    "SEQ19_batches",
    lambda s, d: G.batches(_runs(s, d), 60),
    _sql("""SELECT doc, run, page, batch FROM walk""", _PAGES, _RUNS, """nth AS (SELECT doc, run, page, n_rows, row_number() OVER (PARTITION BY doc, run ORDER BY page) AS k FROM runs),
      walk AS (SELECT doc, run, page, k, n_rows AS filled, 0 AS batch FROM nth WHERE k = 1 UNION ALL
        SELECT n.doc, n.run, n.page, n.k, CASE WHEN w.filled > 0 AND w.filled + n.n_rows > 60 THEN n.n_rows ELSE w.filled + n.n_rows END, CASE WHEN w.filled > 0 AND w.filled + n.n_rows > 60 THEN w.batch + 1 ELSE w.batch END
        FROM walk w JOIN nth n ON n.doc = w.doc AND n.run = w.run AND n.k = w.k + 1)""").replace("WITH", "WITH RECURSIVE", 1),
)
_add(
    "SEQ21_planning_batches",
    lambda s, d: G.planning_batches(_pages(s, d)),
    _sql("SELECT doc, b::INT AS batch, page FROM (SELECT doc, page, max(page) OVER (PARTITION BY doc) AS last, unnest(CASE WHEN page % 8 = 0 THEN [(page - 1) // 8, (page - 1) // 8 + 1] ELSE [(page - 1) // 8] END) AS b FROM pg) WHERE b * 8 < last", _PAGES),
)
_add(
    "SEQ23_proposed_accounts",
    lambda s, d: G.proposed_accounts(_runs(s, d)),
    _sql("SELECT doc, page, a AS proposed FROM runs JOIN (SELECT doc, run, min(nullif(account,'')) AS a FROM runs GROUP BY 1, 2 HAVING min(nullif(account,'')) = max(nullif(account,''))) USING (doc, run) WHERE account = ''", _PAGES, _RUNS),
)
_VOTES = "votes AS (SELECT doc, page, dir AS dominant, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, dir) AS rn FROM (SELECT doc, page, dir, count(*) AS n FROM led WHERE dir <> '' AND coalesce(conf,0) >= 0.55 GROUP BY 1, 2, 3)) WHERE rn = 1)"
_add("AGG13_dominant_votes", lambda s, d: G.dominant_vote(_led(s, d), ["doc", "page"], "dir", "conf"), _sql("SELECT * FROM votes", _VOTES))
_add(
    "SEQ22_page_map",
    lambda s, d: G.page_map(_pages(s, d), G.dominant_vote(_led(s, d), ["doc", "page"], "dir", "conf")),
    _sql("""SELECT doc, page, sum(f) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS segment, h AS account, dominant, votes FROM (SELECT *, CASE WHEN lag(h) OVER w <> h AND lag(h) OVER w <> '' THEN 1 ELSE 0 END AS f FROM (
      SELECT doc, page, coalesce(last_value(nullif(account,'') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS h FROM pg) WINDOW w AS (PARTITION BY doc ORDER BY page)) LEFT JOIN votes USING (doc, page)""", _PAGES, _VOTES),
)
_add(
    "PRJ07_original_pages",
    lambda s, d: G.remapped(_led(s, d), _acc(s, d)),
    _sql("SELECT doc, page, k::INT AS local, covered_pages[k] AS original FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM (SELECT DISTINCT doc, page FROM led WHERE page > 0)) JOIN accounts ON source_document_id = doc"),
)
_add(
    "PRJ14_page_errors",
    lambda s, d: G.page_errors(_pages(s, d).where("bank <> ''"), _acc(s, d)),
    _sql("""SELECT doc, page, e AS error FROM (SELECT doc, page, CASE WHEN times > 1 THEN 'DUPLICATED' WHEN held IS NULL THEN 'MISSING' WHEN times IS NULL THEN 'UNLISTED' END AS e FROM (SELECT source_document_id AS doc, p AS page, count(*) AS times FROM (SELECT source_document_id, unnest(covered_pages) AS p FROM accounts) GROUP BY 1, 2)
      FULL JOIN (SELECT doc, page, true AS held FROM pg WHERE bank <> '') USING (doc, page)) WHERE e IS NOT NULL""", _PAGES),
)
_add(
    "ASM10_completeness",
    lambda s, d: G.completeness(_led(s, d), _acc(s, d)),
    _sql("""SELECT source_document_id, coalesce(n, 0) AS n_rows, concat_ws(',', CASE WHEN transaction_count > coalesce(n, 0) THEN 'MISSING_ROWS' END, CASE WHEN coalesce(n, 0) = 0 AND transaction_count > 0 THEN 'EMPTY' END, CASE WHEN coalesce(q, false) THEN 'UNCERTAIN_FIELDS' END) AS issues, transaction_count > coalesce(n, 0) AS blocks
      FROM accounts LEFT JOIN (SELECT doc, count(*) AS n, bool_or(coalesce(conf, 1) < 0.8 OR amt IS NULL OR d IS NULL OR dir NOT IN ('IN','OUT')) AS q FROM led GROUP BY 1) ON doc = source_document_id"""),
)
_add("ASM12_page_totals", lambda s, d: G.page_totals(_led(s, d)), _sql(f"SELECT doc, page, count(*) AS n_rows, {P._IN} AS total_in, {P._OUT} AS total_out FROM led GROUP BY 1, 2"))
_add(
    "ASM13_header_only_pages",
    lambda s, d: G.header_only_pages(_acc(s, d), _pages(s, d).where("account <> ''")),
    _sql("SELECT DISTINCT source_document_id AS doc, p AS page, account_number FROM (SELECT source_document_id, account_number, unnest(covered_pages) AS p FROM accounts) WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc = source_document_id AND pg.page = p AND account <> '')", _PAGES),
)
