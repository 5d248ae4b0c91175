"""Queries of the repair and scoring operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import events, graph, repair
from tallyline.operators.ledger import orders_ledger, read_accounts, read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans.core import CELLS, ROW_KEY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


_led, _sql, _sign, _ord = read_ledger, P._sql, P._SIGN, P._ORD
_BAL = "kb AS (SELECT * FROM led WHERE bal IS NOT NULL AND amt IS NOT NULL)"
_W = "type || ' ' || summary"

_add(
    "FIX02_printed_dates",
    lambda s, d: repair.printed_dates(_led(s, d)),
    _sql(r"""SELECT tx_id, d, p AS printed FROM (SELECT *, TRY_CAST(regexp_extract(raw_text, '(20\d{2})-?(\d{2})-?(\d{2})', 1) || '-' || regexp_extract(raw_text, '(20\d{2})-?(\d{2})-?(\d{2})', 2) || '-' || regexp_extract(raw_text, '(20\d{2})-?(\d{2})-?(\d{2})', 3) AS DATE) AS p
      FROM led WHERE d IS NOT NULL AND regexp_matches(raw_text, '20\d{2}-?\d{2}-?\d{2}')) WHERE month(p) = month(d) AND day(p) = day(d) AND abs(year(p) - year(d)) >= 2"""),
)
_add(
    "FIX05_calibrated_directions",
    lambda s, d: repair.calibrated_directions(_led(s, d)),
    _sql(f"""SELECT tx_id, dir, proposed FROM (SELECT *, CASE WHEN abs(b + amt - bal) <= 0.05 AND NOT abs(b - amt - bal) <= 0.05 THEN 'IN' WHEN abs(b - amt - bal) <= 0.05 AND NOT abs(b + amt - bal) <= 0.05 THEN 'OUT' END AS proposed
      FROM (SELECT *, lag(bal) OVER {_ord} AS b FROM kb) WHERE b IS NOT NULL) WHERE proposed <> dir""", _BAL),
)
_add(
    "FIX10_inferred_directions",
    lambda s, d: repair.inferred_directions(_led(s, d)),
    _sql(f"""SELECT tx_id, CASE WHEN abs(bal - b - amt) <= greatest(0.02, amt * 0.002) THEN 'IN' WHEN abs(bal - b + amt) <= greatest(0.02, amt * 0.002) THEN 'OUT'
      WHEN regexp_matches({_W}, '{repair.INCOME_WORDS}') AND NOT regexp_matches({_W}, '{repair.EXPENSE_WORDS}') THEN 'IN' WHEN regexp_matches({_W}, '{repair.EXPENSE_WORDS}') AND NOT regexp_matches({_W}, '{repair.INCOME_WORDS}') THEN 'OUT' ELSE 'UNKNOWN' END AS proposed
      FROM (SELECT *, lag(bal) OVER {_ord} AS b FROM led) WHERE dir NOT IN ('IN','OUT')"""),
)
_add(
    "SEQ03_physical_direction",
    lambda s, d: repair.physical_direction(_led(s, d)),
    _sql(f"""SELECT doc, acct, lead, CASE WHEN lead >= 2 THEN 1 WHEN lead <= -2 THEN -1 ELSE 0 END AS way FROM (SELECT doc, acct, sum(sign(date_diff('day', b, d)))::INT AS lead FROM (SELECT *, lag(d) OVER {_ord} AS b FROM led WHERE d IS NOT NULL) WHERE abs(year(d) - year(b)) < 2 GROUP BY 1, 2)"""),
)
_add(
    "SEQ07_balance_risks",
    lambda s, d: repair.balance_risks(_led(s, d)),
    _sql(f"""SELECT DISTINCT unnest([p, tx_id]) AS tx_id FROM (SELECT *, lag(tx_id) OVER w AS p, lag(bal) OVER w AS b FROM kb WHERE dir IN ('IN','OUT') WINDOW w AS (PARTITION BY doc, acct, page ORDER BY rowno, tx_id)) WHERE p IS NOT NULL AND b + ({_sign}) <> bal""", _BAL),
)
_add(
    "SEQ08_zero_settlements",
    lambda s, d: repair.confirmed_zero_settlements(_led(s, d)),
    _sql(f"""SELECT tx_id FROM (SELECT *, lag(bal) OVER {_ord} AS a, lead(bal) OVER {_ord} AS b FROM led WHERE bal IS NOT NULL) WHERE amt = 0 AND regexp_matches({_W}, '{repair.INTEREST}') AND (a = bal OR b = bal)"""),
)
_add(
    "SEQ12_shifted_pages",
    lambda s, d: repair.shifted_pages(_led(s, d)),
    _sql("SELECT doc, page, n, zero, large FROM (SELECT doc, page, count(*) AS n, count(*) FILTER (coalesce(bal,0) = 0) AS zero, count(*) FILTER (amt > 10) AS large FROM led GROUP BY 1, 2) WHERE n >= 3 AND zero * 10 >= n * 8 AND large * 10 >= n * 8"),
)
_add(
    "SEQ13_boundary_segments",
    lambda s, d: repair.boundary_segments(_led(s, d)),
    _sql(f"""SELECT tx_id, sum(f) OVER (PARTITION BY doc ORDER BY page, rowno, tx_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, CASE WHEN regexp_matches({_W}, '{repair.INTEREST}') AND abs(bal - lag(bal) OVER (PARTITION BY doc ORDER BY page, rowno, tx_id)) >= greatest(1000, amt * 20) THEN 1 ELSE 0 END AS f FROM kb)""", _BAL),
)
_add(
    "ER10_page_accounts",
    lambda s, d: repair.page_accounts(_led(s, d)),
    _sql(f"""SELECT doc, page, coalesce(own, CASE WHEN none AND a = b THEN a END, '') AS account FROM (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM (
      SELECT doc, page, CASE WHEN min(k) = max(k) THEN min(k) END AS own, min(k) IS NULL AS none FROM (SELECT doc, page, CASE WHEN {P._reliable('acct')} THEN {P._ident('acct')} END AS k FROM led) GROUP BY 1, 2))"""),
)
_add(
    "JON10_one_digit_aliases",
    lambda s, d: repair.one_digit_aliases(read_accounts(s, d)),
    f"""WITH n AS (SELECT DISTINCT {P._ident('account_number')} AS n FROM accounts WHERE length({P._ident('account_number')}) >= 12) SELECT a.n AS number_1, b.n AS number_2 FROM n a JOIN n b ON a.n < b.n AND length(a.n) = length(b.n) AND hamming(a.n, b.n) = 1""",
)
_add(
    "CLS04_credit_statements",
    lambda s, d: repair.credit_statements(_led(s, d)),
    _sql(f"""SELECT doc, acct, n, worded, named FROM (SELECT doc, acct, count(*) AS n, count(bal) AS nb, count(*) FILTER (bal < 0) AS neg,
      count(*) FILTER (type IN {repair.CREDIT_TYPES!r} OR regexp_matches(summary || ' ' || cp_name || ' ' || raw_text, '{repair.CREDIT_CARD}')) AS worded, bool_or(regexp_matches(bank || ' ' || summary || ' ' || cp_name || ' ' || raw_text, '{repair.CARD_NAMES}')) AS named
      FROM led GROUP BY 1, 2) WHERE named OR nb > 0 AND neg * 2 >= nb AND worded >= least(2, n)"""),
)
_add("CLS05_fee_waivers", lambda s, d: _led(s, d).where(repair.fee_waivers()).select("tx_id"), _sql(f"SELECT tx_id FROM led WHERE regexp_matches({_W}, '{repair.FEE_WAIVER}')"))
_add(
    "AGG12_dominant_bank",
    lambda s, d: repair.dominant(_led(s, d), ["doc"], "bank", "conf"),
    _sql("SELECT doc, bank AS dominant FROM (SELECT doc, bank, row_number() OVER (PARTITION BY doc ORDER BY sum(CAST(greatest(0.25, conf) AS DECIMAL(12,6))) DESC, bank) AS rn FROM led WHERE bank <> '' AND coalesce(conf,0) >= 0.45 GROUP BY 1, 2) WHERE rn = 1"),
)
_KEYS = ["source_document_id", "transaction_date", "direction", "amount"]
_add(
    "ASM07_paired_by_occurrence",
    lambda s, d: repair.paired_by_occurrence(P._cells(s, d, "assembled_rows").withColumnRenamed("rid", "left_id"), P._cells(s, d, "independent_rows").withColumnRenamed("rid", "right_id"), _KEYS, "left_id", "right_id"),
    "WITH " + ", ".join(P._AB) + f" SELECT x.rid AS left_id, y.rid AS right_id FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY rid) AS nth FROM a) x JOIN (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY rid) AS nth FROM b) y USING ({', '.join([*_KEYS, 'nth'])})",
)
_add(
    "TOP06_recovery_pages",
    lambda s, d: repair.recovery_pages(graph.page_issues(_led(s, d))),
    _sql("SELECT doc, page, n_rows::BIGINT AS n_rows, CASE WHEN row_number() OVER (PARTITION BY doc ORDER BY n_rows DESC, page) <= 6 THEN 'READ_AGAIN' ELSE 'DEFERRED' END AS plan FROM (SELECT doc, page, sum(n_rows) AS n_rows FROM iss GROUP BY 1, 2)", f"iss AS ({P._ISSUES})"),
)
_ROW = ", ".join(ROW_KEY)


def _once(n: str) -> str:
    return f"(SELECT {_ROW}, {', '.join(f'min({c}) AS {c}' for c in CELLS)} FROM {n} GROUP BY {_ROW} HAVING count(*) = 1)"


_add(
    "EVA01_field_accuracy",
    lambda s, d: repair.field_accuracy(P._cells(s, d, "assembled_rows"), P._cells(s, d, "independent_rows"), ROW_KEY, list(CELLS)),
    "WITH " + ", ".join(P._AB) + " " + " UNION ALL ".join(f"SELECT '{c}' AS field_name, count(*) AS n_compared, count(*) FILTER (x.{c} IS NOT DISTINCT FROM y.{c}) AS n_equal FROM {_once('a')} x JOIN {_once('b')} y USING ({_ROW})" for c in CELLS),
)
_add(
    "EVA12_direction_confusions",
    lambda s, d: repair.confusions(P._cells(s, d, "assembled_rows"), P._cells(s, d, "independent_rows"), ROW_KEY, "direction"),
    "WITH " + ", ".join(P._AB) + f" SELECT expected, actual, count(*) AS n FROM (SELECT {_ROW}, min(coalesce(direction,'')) AS expected FROM a GROUP BY {_ROW}) JOIN (SELECT {_ROW}, min(coalesce(direction,'')) AS actual FROM b GROUP BY {_ROW}) USING ({_ROW}) WHERE expected <> actual GROUP BY 1, 2 ORDER BY n DESC, expected, actual LIMIT 20",
)

_add(
    "GRA03_counterparty_nodes",
    lambda s, d: graph.counterparty_nodes(_led(s, d)),
    _sql(f"SELECT {P._PARTY_KEY} AS node, sum((dir = 'IN')::INT)::BIGINT AS n_in, sum((dir = 'OUT')::INT)::BIGINT AS n_out, min(nullif(trim(cp_name, ' '), '')) AS name FROM led GROUP BY 1"),
)
_add("GRA05_judicial_nodes", lambda s, d: graph.judicial_nodes(_led(s, d)), _sql(f"SELECT 'judicial:' || tx_id AS node, d, amt FROM led WHERE {P._JUD}"))
_add(
    "JON19_issuers",
    lambda s, d: graph.issuers(read_accounts(s, d)),
    f"SELECT {P._ident('account_number')} AS account, count(*) AS n_documents, CASE WHEN min(bank_name) = max(bank_name) THEN min(bank_name) END AS bank, min(bank_name) <> max(bank_name) AS conflict FROM accounts WHERE coalesce(bank_name,'') <> '' AND {P._reliable('account_number')} GROUP BY 1",
)
_add(
    "AGG17_ownership_groups",
    lambda s, d: graph.ownership_groups(read_accounts(s, d)),
    f"""SELECT {P._PERSON.replace('{c}', "coalesce(account_name,'')")} AS holder, count(*) AS n_accounts, count(DISTINCT {P._ident("coalesce(account_number,'')")}) AS n_numbers, min(account_name) AS printed FROM accounts GROUP BY 1""",
)
_OVERLAY = ["amount", "balance", "counterparty_name"]
_add(
    "JON21_overlay",
    lambda s, d: graph.overlaid(P._cells(s, d, "assembled_rows"), P._cells(s, d, "independent_rows"), ROW_KEY, _OVERLAY),
    "WITH " + ", ".join(P._AB) + f", o AS (SELECT {_ROW}, count(*) AS n, {', '.join(f'min({f}) AS m_{f}' for f in _OVERLAY)} FROM b GROUP BY {_ROW}) SELECT {_ROW}, "
    + ", ".join(f"CASE WHEN n = 1 AND coalesce(m_{f}, '') <> '' THEN m_{f} ELSE {f} END AS {f}" for f in _OVERLAY)
    + f", CASE WHEN n IS NULL THEN 'OMITTED' WHEN n > 1 THEN 'REPEATED' ELSE 'USED' END AS overlay FROM a LEFT JOIN o USING ({_ROW})",
)
_add(
    "STR10_account_runs",
    lambda s, d: _led(s, d).select("tx_id", T.account_from_text(F.concat_ws(" ", "acct", "cp_acct")).alias("account")),
    _sql(r"SELECT tx_id, CASE WHEN len(r) = 1 THEN r[1] END AS account FROM (SELECT tx_id, list_filter(regexp_extract_all(acct || ' ' || cp_acct, '\d+'), lambda x: length(x) BETWEEN 8 AND 32) AS r FROM led)"),
)
QUERIES["GRA07_written_back"] = lambda s, d: graph.written_back(orders_ledger(s, d), events.canonical_events(orders_ledger(s, d)))
