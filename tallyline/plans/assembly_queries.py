"""Queries of evidence assembly and of scores, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import alignment
from tallyline.operators import assembly as A
from tallyline.operators import scores as S
from tallyline.operators.ledger import read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans.core import CELLS, ROW_KEY, table
from tallyline.plans.review_queries import _IS, _issues
from tallyline.plans.scalar_queries import _MONEY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_led, _sql, _SP = read_ledger, P._sql, T.SPACES
_R = ", ".join(ROW_KEY)


def _a(s: SparkSession, d: str) -> DataFrame:
    return P._cells(s, d, "assembled_rows")


def _b(s: SparkSession, d: str) -> DataFrame:
    return P._cells(s, d, "independent_rows")


_add(
    "SRC11_registry",
    lambda s, d: A.registry(table(s, d, "assembled_rows")),
    """SELECT source_document_id, page_no, row_no, row_id::INT AS row_id, (before + k)::BIGINT AS cell_id, k::INT AS column_no, cell_values[k] AS text FROM (SELECT *, unnest(range(1, len(cell_values) + 1)) AS k FROM (
      SELECT *, row_number() OVER w AS row_id, coalesce(sum(len(cell_values)) OVER (PARTITION BY source_document_id ORDER BY page_no, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT DISTINCT ON (source_document_id, page_no, row_no) * FROM assembled_rows) WINDOW w AS (PARTITION BY source_document_id ORDER BY page_no, row_no)))""",
)
_DT = rf"""CASE WHEN regexp_matches({{t}}, '^(19|20)\d{{{{2}}}}[-/.年]\d{{{{1,2}}}}[-/.月]\d{{{{1,2}}}}日?') THEN TRY_CAST(regexp_replace({{t}}, '^(\d{{{{4}}}})[-/.年](\d{{{{1,2}}}})[-/.月](\d{{{{1,2}}}}).*$', '\1-\2-\3') AS DATE)
  WHEN regexp_matches({{t}}, '^(19|20)\d{{{{6}}}}$') THEN TRY_CAST(substr({{t}},1,4) || '-' || substr({{t}},5,2) || '-' || substr({{t}},7,2) AS DATE) END"""


def _day(c: str) -> str:
    return _DT.replace("{{", "{").replace("}}", "}").replace("{t}", f"regexp_replace(coalesce({c},''), '[{_SP}]', '', 'g')").replace("{{", "{").replace("}}", "}")


def _m(c: str) -> str:
    return _MONEY.replace("{c}", c)


_IN_W, _OUT_W = "('IN','贷','贷方','收','收入','转入','+','CR')", "('OUT','借','借方','支','支出','转出','-','DR')"
_SIDE = f"CASE WHEN upper(regexp_replace(coalesce(direction,''), '[{_SP}]', '', 'g')) IN {_IN_W} THEN 'IN' WHEN upper(regexp_replace(coalesce(direction,''), '[{_SP}]', '', 'g')) IN {_OUT_W} THEN 'OUT' ELSE 'UNKNOWN' END"


def _filled(c: str) -> str:
    return f"NOT regexp_matches(coalesce({c},''), '{A.EMPTY}')"


_TESTS = {
    "MISSING_KEY_SOURCE": f"NOT {_filled('account_number')} OR NOT {_filled('amount')}",
    "UNREADABLE_SOURCE": f"{_filled('amount')} AND {_m('amount')} IS NULL OR {_filled('balance')} AND {_m('balance')} IS NULL",
    "PARTIAL_DATE": f"{_filled('transaction_date')} AND {_day('transaction_date')} IS NULL",
    "DIRECTION_REQUIRES_INDEPENDENT_READ": f"{_SIDE} = 'UNKNOWN'",
    "COUNTERPARTY_IDENTITY_MISSING": f"NOT {_filled('counterparty_name')} AND NOT {_filled('counterparty_account')}",
    "SOURCE_VALUE_CONFLICT": f"{_m('amount')} <> {_m('o_amount')}",
    "TIME_SOURCE_CONFLICT": f"{_day('transaction_date')} <> {_day('o_day')}",
}
_CODES = ", ".join(P._AB) + f", tw AS (SELECT a.*, o.amount AS o_amount, o.transaction_date AS o_day FROM a LEFT JOIN (SELECT DISTINCT ON ({_R}) * FROM b) o USING ({_R})), codes AS (" + " UNION ALL ".join(f"SELECT {_R}, '{c}' AS code FROM tw WHERE {t}" for c, t in _TESTS.items()) + ")"
_add("ASM02_row_codes", lambda s, d: A.row_codes(_a(s, d), _b(s, d)), f"WITH {_CODES} SELECT * FROM codes")
_add(
    "ASM06_delivery_status",
    lambda s, d: A.delivery_status(table(s, d, "accounts").select("source_document_id"), A.row_codes(_a(s, d), _b(s, d))),
    f"WITH {_CODES} SELECT source_document_id, CASE WHEN n > 0 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status, coalesce(n, 0) AS n_pending, coalesce(r, 0) AS n_rows FROM accounts LEFT JOIN (SELECT source_document_id, count(*) AS n, count(DISTINCT (page_no, row_no)) AS r FROM codes GROUP BY 1) USING (source_document_id)",
)
_add(
    "ASM08_transactions",
    lambda s, d: A.as_transactions(_a(s, d), A.row_codes(_a(s, d), _b(s, d))),
    f"""WITH {_CODES} SELECT {_R}, {_day('transaction_date')} AS d, {_SIDE} AS dir, coalesce(abs({_m('amount')}), 0)::DECIMAL(18,2) AS amt, {_m('balance')} AS bal, {_m('balance')} IS NOT NULL AS balance_available, CASE WHEN p THEN 'PENDING' ELSE 'AUTO_PASSED' END AS status,
      concat_ws(',', CASE WHEN {_day('transaction_date')} IS NULL THEN 'INVALID_DATE' END, CASE WHEN {_m('amount')} IS NULL THEN 'INVALID_AMOUNT' END, CASE WHEN {_SIDE} = 'UNKNOWN' THEN 'UNKNOWN_DIRECTION' END) AS faults FROM a LEFT JOIN (SELECT DISTINCT {_R}, true AS p FROM codes) USING ({_R})""",
)


def _by_place(s: SparkSession, d: str) -> DataFrame:
    once = lambda df, n: df.groupBy(*ROW_KEY).agg(F.min("rid").alias(n), F.count("*").alias("n")).where("n = 1").drop("n")
    return once(_a(s, d), "left_id").join(once(_b(s, d), "right_id"), ROW_KEY).select("left_id", "right_id")


def _doubts(s: SparkSession, d: str) -> DataFrame:
    return _issues(s, d, "independent_rows").select(F.concat_ws("/", *ROW_KEY).alias("right_id"), "field_name")


def _by_order(s: SparkSession, d: str) -> DataFrame:
    pairs = alignment.aligned_pages(_a(s, d), _b(s, d), ROW_KEY[:2], "row_no", list(CELLS))
    return pairs.select(F.concat_ws("/", *ROW_KEY[:2], "left_row").alias("left_id"), F.concat_ws("/", *ROW_KEY[:2], "right_row").alias("right_id"))


_ONE = lambda n, c: f"(SELECT {_R}, min(rid) AS {c} FROM {n} GROUP BY ALL HAVING count(*) = 1)"
_PL = f"pl AS (SELECT left_id, right_id FROM {_ONE('a', 'left_id')} x JOIN {_ONE('b', 'right_id')} y USING ({_R}))"
_F = ", ".join(f"coalesce(a.{c},'') AS a_{c}, coalesce(b.{c},'') AS b_{c}" for c in A.COMPARED)
_add(
    "ASM04_compared_by_place",
    lambda s, d: A.compared_readings(_a(s, d), _b(s, d), _by_place(s, d), _doubts(s, d)),
    "WITH " + ", ".join([*P._AB, _PL, _IS.format(n="q", t="independent_rows")]) + f", m AS (SELECT left_id, {_F} FROM pl JOIN a ON a.rid = left_id JOIN b ON b.rid = right_id) "
    + " UNION ALL ".join(f"SELECT left_id AS rid, 'INDEPENDENT_VALUE_CONFLICT' AS code, '{c}' AS field_name FROM m WHERE a_{c} <> b_{c}" for c in A.COMPARED)
    + f" UNION ALL SELECT left_id, 'INDEPENDENT_SOURCE_UNCERTAIN', field_name FROM pl JOIN (SELECT DISTINCT source_document_id || '/' || page_no || '/' || row_no AS right_id, field_name FROM q WHERE field_name IN {A.COMPARED!r}) USING (right_id)"
    + " UNION ALL SELECT rid, 'INDEPENDENT_ROW_UNMATCHED', '' FROM a WHERE rid NOT IN (SELECT left_id FROM pl) UNION ALL SELECT rid, 'INDEPENDENT_EXTRA_OBSERVATION', '' FROM b WHERE rid NOT IN (SELECT right_id FROM pl)",
)
_add("ASM04_compared_by_order", lambda s, d: A.compared_readings(_a(s, d), _b(s, d), _by_order(s, d), _doubts(s, d)))


def _source_id() -> Column:
    return F.concat_ws("/", *ROW_KEY).alias("source_id")


def _accounting(s: SparkSession, d: str) -> DataFrame:
    source = table(s, d, "independent_rows").select(_source_id())
    used = table(s, d, "assembled_rows").select(_source_id())  # each output row uses the source row of its place; repeated outputs reuse it
    ignored = _b(s, d).where(T.text("amount") == "").select(F.col("rid").alias("source_id"))
    return A.row_accounting(source, used, ignored)


_KEY = "source_document_id || '/' || page_no || '/' || row_no"
_add(
    "ASM03_row_accounting",
    _accounting,
    "WITH " + P._AB[1] + f""", x AS (SELECT s.source_id, coalesce(u, 0) AS u, coalesce(i, 0) AS i FROM (SELECT DISTINCT {_KEY} AS source_id FROM independent_rows) s LEFT JOIN (SELECT {_KEY} AS source_id, count(*) AS u FROM assembled_rows GROUP BY 1) USING (source_id)
      LEFT JOIN (SELECT rid AS source_id, count(*) AS i FROM b WHERE coalesce(amount,'') = '' GROUP BY 1) USING (source_id))
      SELECT source_id, 'UNASSIGNED_SOURCE_ROW' AS code FROM x WHERE u = 0 AND i = 0 UNION ALL SELECT source_id, 'SOURCE_ROW_REUSED' FROM x WHERE u > 1 UNION ALL SELECT source_id, 'DUPLICATE_DISPOSITION' FROM x WHERE i > 1 UNION ALL SELECT source_id, 'TRANSACTION_IGNORED_CONFLICT' FROM x WHERE u > 0 AND i > 0""",
)
_add(
    "ASM09_valid_quotes",
    lambda s, d: _led(s, d).select("tx_id", A.is_valid_quote("summary", "raw_text").alias("valid")),
    _sql(f"SELECT tx_id, regexp_replace(summary, '[{_SP}]', '', 'g') <> '' AND contains(regexp_replace(raw_text, '[{_SP}]', '', 'g'), regexp_replace(summary, '[{_SP}]', '', 'g')) AS valid FROM led"),
)

# --- scores ------------------------------------------------------------------------------------------------------


def _results(s: SparkSession, d: str) -> DataFrame:
    return S.row_results(_a(s, d), _b(s, d), _issues(s, d, "independent_rows"), ROW_KEY)


_LST = ", ".join(f"coalesce({c},'')" for c in S.CRITICAL)
_RES = ", ".join(P._AB) + ", " + _IS.format(n="q", t="independent_rows") + f""", res AS (SELECT {_R}, CASE WHEN y IS NULL THEN 'MISSING' WHEN x IS NULL THEN 'EXTRA' WHEN x = y THEN 'CORRECT' ELSE 'WRONG' END AS state,
  CASE WHEN x IS NULL OR y IS NULL THEN [] ELSE list_filter([{', '.join(f"CASE WHEN x[{k + 1}] <> y[{k + 1}] THEN '{c}' END" for k, c in enumerate(S.CRITICAL))}], lambda v: v IS NOT NULL) END AS wrong, coalesce(al, []) AS alerted
  FROM (SELECT {_R}, min([{_LST}]) AS x FROM a GROUP BY ALL) FULL JOIN (SELECT {_R}, min([{_LST}]) AS y FROM b GROUP BY ALL) USING ({_R}) LEFT JOIN (SELECT {_R}, list(DISTINCT field_name) AS al FROM q GROUP BY ALL) USING ({_R}))"""
_ACC = """count(*) FILTER (state <> 'EXTRA') AS n_expected, count(*) FILTER (state <> 'MISSING') AS n_delivered, count(*) FILTER (state = 'CORRECT') AS n_correct, count(*) FILTER (len(alerted) > 0 AND state <> 'MISSING') AS n_review,
  sum(len(wrong) + (state IN ('MISSING','EXTRA'))::INT)::BIGINT AS n_errors, sum(len(list_filter(wrong, lambda v: NOT list_contains(alerted, v))) + (state IN ('MISSING','EXTRA'))::INT)::BIGINT AS n_unalerted"""
_FIN = f"round(n_correct / greatest(n_expected, n_delivered), 6) AS accuracy, CASE WHEN n_expected > 0 THEN round(n_review / n_expected, 6) END AS review_rate, coalesce(round(n_correct / greatest(n_expected, n_delivered), 6) >= {S.LEAST_ACCURACY} AND round(n_review / nullif(n_expected, 0), 6) <= {S.MOST_REVIEW} AND n_unalerted = 0, false) AS meets"
_add("EVA02_acceptance", lambda s, d: S.acceptance(_results(s, d)), f"WITH {_RES} SELECT *, {_FIN} FROM (SELECT {_ACC} FROM res)")
_add("EVA15_acceptance_by_document", lambda s, d: S.acceptance(_results(s, d), ["source_document_id"]), f"WITH {_RES} SELECT *, {_FIN} FROM (SELECT source_document_id, {_ACC} FROM res GROUP BY 1)")
_add(
    "EVA05_detection",
    lambda s, d: S.detection(_results(s, d)),
    f"""WITH {_RES} SELECT field_name, sum(w)::BIGINT AS n_wrong, sum(al)::BIGINT AS n_alerts, sum(h)::BIGINT AS n_found, CASE WHEN sum(w) > 0 THEN round(sum(h) / sum(w), 6) END AS recall, CASE WHEN sum(al) > 0 THEN round(sum(h) / sum(al), 6) END AS precision FROM (
      SELECT unnest(wrong) AS field_name, 1 AS w, 0 AS al, 0 AS h FROM res UNION ALL SELECT unnest(alerted), 0, 1, 0 FROM res WHERE state <> 'MISSING' UNION ALL SELECT unnest(list_filter(wrong, lambda v: list_contains(alerted, v))), 0, 0, 1 FROM res) GROUP BY 1""",
)
_add(
    "EVA03_truth_types",
    lambda s, d: _led(s, d).select("tx_id", S.truth_type(F.col("type")).alias("type")),
    _sql("SELECT tx_id, CASE WHEN type IN ('消费','缴费') THEN '消费' ELSE type END AS type FROM led"),
)
_PF = ("account_number", "amount", "balance", "counterparty_account", "counterparty_name")
_add(
    "EVA06_evidence_presence",
    lambda s, d: S.evidence_presence(_a(s, d), _b(s, d), ROW_KEY, ROW_KEY[:2], _PF),
    "WITH " + ", ".join(P._AB) + ", once AS (SELECT DISTINCT ON (" + _R + ") * FROM a), w AS (" + " UNION ALL ".join(f"SELECT source_document_id, page_no, '{f}' AS field_name, {f} AS v FROM once WHERE coalesce({f},'') <> ''" for f in _PF) + "), e AS (" + " UNION ".join(f"SELECT source_document_id, page_no, {f} AS v FROM b WHERE coalesce({f},'') <> ''" for f in _PF)
    + ") SELECT field_name, count(*) AS n_values, count(e.v) AS n_present, round(count(e.v) / count(*), 6) AS rate FROM w LEFT JOIN e USING (source_document_id, page_no, v) GROUP BY 1",
)
_add(
    "EVA07_party_rates",
    lambda s, d: S.party_rates(_a(s, d), _b(s, d), ROW_KEY, F.coalesce(T.direction_of("e_direction"), F.lit("UNKNOWN"))),
    "WITH " + ", ".join(P._AB) + f""" SELECT {_SIDE} AS flow_group, count(*) AS n_rows, count(nullif(x, '')) AS n_accounts, sum((x <> '' AND x = coalesce(u,''))::INT)::BIGINT AS right_accounts, count(nullif(y, '')) AS n_names, sum((y <> '' AND y = coalesce(v,''))::INT)::BIGINT AS right_names
      FROM (SELECT {_R}, min(coalesce(counterparty_account,'')) AS x, min(coalesce(counterparty_name,'')) AS y, min(coalesce(direction,'')) AS direction FROM a GROUP BY ALL) LEFT JOIN (SELECT {_R}, min(coalesce(counterparty_account,'')) AS u, min(coalesce(counterparty_name,'')) AS v FROM b GROUP BY ALL) USING ({_R}) GROUP BY 1""",
)
_add(
    "EVA14_row_checks",
    lambda s, d: S.row_checks(_led(s, d), table(s, d, "type_ref")),
    _sql(f"""SELECT tx_id, 'NO_PLACE' AS fault FROM led WHERE page <= 0 OR rowno <= 0 UNION ALL SELECT tx_id, 'DUPLICATE_PLACE' FROM (SELECT tx_id, count(*) OVER (PARTITION BY doc, page, rowno) AS k FROM led) WHERE k > 1 UNION ALL SELECT tx_id, 'NO_DAY' FROM led WHERE d IS NULL UNION ALL SELECT tx_id, 'NO_AMOUNT' FROM led WHERE amt IS NULL
      UNION ALL SELECT tx_id, 'UNKNOWN_TYPE' FROM led WHERE type <> '' AND type NOT IN (SELECT type_name FROM type_ref) UNION ALL SELECT tx_id, 'NO_PARTY' FROM led WHERE cp_name = '' AND cp_acct = ''
      UNION ALL SELECT tx_id, 'BALANCE_CHAIN' FROM (SELECT tx_id, bal, lag(bal) OVER {P._ORD} + {P._SIGN} AS x FROM led) WHERE x <> bal"""),
)


def _best(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "assembled_rows").dropDuplicates(ROW_KEY), table(s, d, "independent_rows").dropDuplicates(ROW_KEY)
    expected = a.groupBy(*ROW_KEY[:2]).agg(F.max("row_no").cast("bigint").alias("n_expected"))
    return S.best_reading({"assembled": a, "independent": b}, ROW_KEY[:2], expected)


_add(
    "TOP09_best_readings",
    _best,
    f"""WITH x AS (SELECT DISTINCT {_R} FROM assembled_rows), y AS (SELECT DISTINCT {_R} FROM independent_rows), e AS (SELECT source_document_id, page_no, max(row_no) AS k FROM x GROUP BY 1, 2),
      u AS (SELECT source_document_id, page_no, count(*) AS n, 'assembled' AS side FROM x GROUP BY 1, 2 UNION ALL SELECT source_document_id, page_no, count(*), 'independent' FROM y GROUP BY 1, 2)
      SELECT source_document_id, page_no, side AS chosen, n AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY source_document_id, page_no ORDER BY (abs(n - k) <> 0)::INT, abs(n - k), -n, side) AS rn FROM u JOIN e USING (source_document_id, page_no)) WHERE rn = 1""",
)
