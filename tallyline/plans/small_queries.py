"""Queries of functions that others only use inside, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import alignment, events, graph, repair, sequence, views
from tallyline.operators.ledger import ORDERS_CTE, orders_ledger, read_accounts, read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans import repair_queries as Q
from tallyline.plans import view_queries as V
from tallyline.plans.core import ROW_KEY, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


_led, _sql, _SP = read_ledger, P._sql, T.SPACES
_R = ", ".join(ROW_KEY)


def _both(s: SparkSession, d: str) -> DataFrame:
    once = lambda t, p: P._cells(s, d, t).dropDuplicates(ROW_KEY).select(*ROW_KEY, *(F.col(c).alias(f"{p}{c}") for c in ("amount", "counterparty_name", "transaction_time")))
    return once("assembled_rows", "a_").join(once("independent_rows", "b_"), ROW_KEY)


_BOTH = "WITH " + ", ".join(P._AB) + f", z AS (SELECT {_R}, coalesce(a.amount,'') AS aa, coalesce(b.amount,'') AS ba, coalesce(a.counterparty_name,'') AS an, coalesce(b.counterparty_name,'') AS bn, coalesce(a.transaction_time,'') AS tt FROM (SELECT DISTINCT ON ({_R}) * FROM a) a JOIN (SELECT DISTINCT ON ({_R}) * FROM b) b USING ({_R}))"
_add("ER03_compatible_texts", lambda s, d: _both(s, d).select(*ROW_KEY, T.texts_compatible(T.text("a_counterparty_name"), T.text("b_counterparty_name")).alias("compatible")), f"{_BOTH} SELECT {_R}, an <> '' AND bn <> '' AND (an = bn OR (least(length(an), length(bn)) >= 4 AND (contains(an, bn) OR contains(bn, an)))) AS compatible FROM z")
_add("FIX07_digit_variants", lambda s, d: _both(s, d).select(*ROW_KEY, T.digit_variant(T.text("a_amount"), T.text("b_amount")).alias("variant")), f"{_BOTH} SELECT {_R}, CASE WHEN length(aa) <> length(ba) THEN false WHEN aa = ba THEN true ELSE hamming(aa, ba) <= 1 END AS variant FROM z")
_C, _CC = r"^(?:.*\D)?([01]\d|2[0-3]):([0-5]\d):([0-5]\d)$", r"^([01]\d|2[0-3])([0-5]\d)([0-5]\d)$"
_TS = f"regexp_replace(coalesce(transaction_time,''), '[{_SP}]', '', 'g')"


def _hms(p: str) -> str:
    return " || ':' || ".join(f"regexp_extract({_TS}, '{p}', {k})" for k in (1, 2, 3))


_add(
    "DAT02_clocks",
    lambda s, d: table(s, d, "bank_transactions").select("tx_id", T.time_of("transaction_time").alias("clock")).distinct(),
    f"SELECT DISTINCT tx_id, CASE WHEN regexp_matches({_TS}, '{_C}') THEN {_hms(_C)} WHEN regexp_matches({_TS}, '{_CC}') THEN {_hms(_CC)} END AS clock FROM bank_transactions",
)
_add(
    "DAT05_days_between",
    lambda s, d: P._cased(s, d).select("tx_id", T.days_between(F.col("d"), F.col("execution_filing_date")).alias("days")),
    _sql("SELECT tx_id, coalesce(abs(date_diff('day', execution_filing_date, d)), 0)::INT AS days FROM cased", P._CASED),
)
_DW = f"upper(regexp_replace(coalesce(direction,''), '[{_SP}]', '', 'g'))"
_add(
    "DIR01_directions",
    lambda s, d: table(s, d, "observations").select("obs_id", T.direction_of("direction").alias("dir")).distinct(),
    f"SELECT DISTINCT obs_id, CASE WHEN {_DW} IN ('IN','贷','贷方','收','收入','转入','+','CR') THEN 'IN' WHEN {_DW} IN ('OUT','借','借方','支','支出','转出','-','DR') THEN 'OUT' ELSE 'UNKNOWN' END AS dir FROM observations",
)
_add("STR04_person_names", lambda s, d: _led(s, d).select("tx_id", T.person_name("cp_name").alias("name")), _sql(f"SELECT tx_id, lower(regexp_replace(cp_name, '[{_SP}·•]', '', 'g')) AS name FROM led"))
_add("STR05_semantic_texts", lambda s, d: table(s, d, "documents").select("doc_id", T.semantic_text("text").alias("text")), rf"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text,''), '\\n', '', 'g'), '[{_SP}]', '', 'g') AS text FROM documents")
_HOLD = r"trim(regexp_replace(regexp_replace(coalesce(file_name,''), '(?i)\.(pdf|xlsx?|csv)$', ''), '(银行)?(交易)?流水.*$', ''), ' ')"
_add("STR06_holder_names", lambda s, d: read_accounts(s, d).select("source_document_id", T.holder_name("file_name", "待核验").alias("holder")), f"SELECT source_document_id, CASE WHEN {_HOLD} = '' THEN '待核验' ELSE {_HOLD} END AS holder FROM accounts")
_PART = rf"regexp_matches(regexp_replace(x, '[{_SP}\-*]', '', 'g'), '^\d{{4,32}}$')"
_add(
    "STR08_source_parties",
    lambda s, d: (lambda c: _led(s, d).select("tx_id", T.source_party(c, "account").alias("account"), T.source_party(c, "name").alias("name")))(F.concat_ws("/", "cp_acct", "cp_name")),
    _sql(f"""SELECT tx_id, CASE WHEN ok THEN n[1] END AS account, CASE WHEN ok THEN m[1] END AS name FROM (SELECT tx_id, n, m, len(p) = 2 AND len(n) = 1 AND len(m) = 1 AS ok FROM (SELECT *, list_filter(p, lambda x: {_PART}) AS n, list_filter(p, lambda x: NOT {_PART} AND x <> '') AS m FROM (
      SELECT tx_id, list_transform(regexp_split_to_array(cp_acct || '/' || cp_name, '[/|\\n]'), lambda x: trim(x, ' ')) AS p FROM led)))"""),
)
_GAPS = r"regexp_replace({x}, '(\d)\s*([,.])\s*(\d)', '\1\2\3', 'g')"
_add(
    "STR09_number_spacing",
    lambda s, d: table(s, d, "observations").select("obs_id", T.number_spacing("amount").alias("amount")).distinct(),
    "SELECT DISTINCT obs_id, regexp_replace(" + _GAPS.replace("{x}", _GAPS.replace("{x}", "coalesce(amount,'')")) + r", '([-+¥￥])\s+(\d)', '\1\2', 'g') AS amount FROM observations",
)
_B = "regexp_replace(coalesce(amount,''), '[,，¥￥ ]', '', 'g')"
_add(
    "NUM03_money_values",
    lambda s, d: table(s, d, "observations").select("obs_id", views.loose_number(F.col("amount")).alias("value"), views.loose_number(F.col("amount")).isNotNull().alias("valid")).distinct(),
    rf"SELECT DISTINCT obs_id, CASE WHEN regexp_matches({_B}, '-\d|^\(.*\)$') THEN -v ELSE v END AS value, v IS NOT NULL AS valid FROM (SELECT *, CAST(nullif(regexp_extract({_B}, '(\d+(?:\.\d+)?)', 1), '') AS DECIMAL(18,2)) AS v FROM observations)",
)
_add(
    "GEO01_page_regions",
    lambda s, d: table(s, d, "events").select("event_id", T.page_region(F.col("value"), F.col("value") / 2, F.col("value") - 10, F.lit(5.0), F.lit(500.0), F.lit(800.0)).alias("r")).select("event_id", *(F.round(f"r.{c}", 9).alias(c) for c in ("x", "y", "width", "height"))),
    "SELECT event_id, " + ", ".join(f"CASE WHEN value > 10 THEN round({e}, 9) END AS {c}" for c, e in (("x", "l"), ("y", "t"), ("width", "r - l"), ("height", "b - t"))) + " FROM (SELECT event_id, value, greatest(0.0, least(1.0, value / 500)) AS l, greatest(0.0, least(1.0, value / 2 / 800)) AS t, greatest(0.0, least(1.0, (2 * value - 10) / 500)) AS r, greatest(0.0, least(1.0, (value / 2 + 5) / 800)) AS b FROM events)",
)
_add(
    "TOP05_row_scores",
    lambda s, d: _led(s, d).select("tx_id", events.representative_score().alias("score")),
    _sql("SELECT tx_id, (CASE WHEN status IN ('VERIFIED','CORRECTED') THEN 100 ELSE 0 END + floor(coalesce(conf, 0) * 20 + 0.5)::INT + CASE WHEN bal IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN cp_acct <> '' THEN 5 ELSE 0 END + CASE WHEN cp_name <> '' THEN 3 ELSE 0 END + CASE WHEN summary <> '' THEN 2 ELSE 0 END)::INT AS score FROM led"),
)
#: The orders ledger with times, balances and raw texts, of which some of the second document's differ.
_FILLED = {
    "tm": "CASE WHEN rowno % 3 = 0 THEN '1999-01-01 10:00:0' || CAST(CASE WHEN doc = 'DOC_B' AND rowno % 50 = 0 THEN 1 ELSE 0 END AS STRING) END",
    "bal": "CASE WHEN rowno % 4 <> 1 THEN CAST(CASE WHEN doc = 'DOC_B' AND rowno % 75 = 0 THEN amt + 1 ELSE amt * 2 END AS DECIMAL(18,2)) END",
    "raw_text": "CASE WHEN rowno % 2 = 0 THEN concat('row ', CAST(rowno AS STRING)) ELSE '' END",
}
_FILLED_CTE = ORDERS_CTE.replace("led AS (", "led0 AS (", 1) + ",\nled AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _FILLED.items()) + ") FROM led0)"


def _filled(s: SparkSession, d: str) -> DataFrame:
    return orders_ledger(s, d).withColumns({c: F.expr(e) for c, e in _FILLED.items()})


_add("ER02_points", lambda s, d: events.duplicate_candidates(_filled(s, d)), P.ORACLE_SQL["JON01_duplicate_candidates"].replace(P.L.LEDGER_SQL.strip(), _FILLED_CTE))
_add("AGG07_document_totals", lambda s, d: _led(s, d).groupBy("doc").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("dir") == "IN", F.col("amt"))), F.lit(0)).cast("decimal(28,2)").alias("total_in"), F.coalesce(F.sum(F.when(F.col("dir") == "OUT", F.col("amt"))), F.lit(0)).cast("decimal(28,2)").alias("total_out"), F.min("d").alias("start_date"), F.max("d").alias("end_date")), _sql(f"SELECT doc, count(*) AS n_rows, {P._IN} AS total_in, {P._OUT} AS total_out, min(d) AS start_date, max(d) AS end_date FROM led GROUP BY 1"))
_add(
    "JON07_declared_representatives",
    lambda s, d: (lambda led: graph.written_back(led, led.where("dup_of <> ''").select("tx_id", F.col("dup_of").alias("representative"))))(_led(s, d)),
    _sql("SELECT tx_id, CASE WHEN dup_of <> '' THEN dup_of ELSE tx_id END AS representative, dup_of <> '' AND dup_of <> tx_id AS is_duplicate FROM led"),
)
_EXTRA = ["source_document_id", "direction", "amount", "balance"]


def _one(n: str, c: str) -> str:
    k = ", ".join(_EXTRA)
    return f"(SELECT {k}, min(rid) AS {c} FROM {n} WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in _EXTRA) + f" GROUP BY {k} HAVING count(*) = 1)"


_add(
    "JON17_diagnostic_pass",
    lambda s, d: alignment.unique_matches(P._cells(s, d, "assembled_rows").withColumnRenamed("rid", "left_id"), P._cells(s, d, "independent_rows").withColumnRenamed("rid", "right_id"), _EXTRA, "left_id", "right_id").select("left_id", "right_id"),
    "WITH " + ", ".join(P._AB) + f" SELECT left_id, right_id FROM {_one('a', 'left_id')} x JOIN {_one('b', 'right_id')} y USING ({', '.join(_EXTRA)})",
)


# --- operators that find nothing over the bank tables, over the orders ledger with pages, balances and printed days that give them rows ---


def _variant(name: str, op: Callable[[DataFrame], DataFrame], source: str, columns: dict[str, str]) -> None:
    """``op`` over the orders ledger with ``columns`` in place of its own, and the SQL of the query ``source`` over the same rows."""
    cte = ORDERS_CTE.replace("led AS (", "led0 AS (", 1) + ",\nled AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + ") FROM led0)"
    made = lambda s, d: orders_ledger(s, d).selectExpr(*(f"{columns.get(c, c)} AS {c}" for c in orders_ledger(s, d).columns))
    _add(name, lambda s, d: op(made(s, d)), (P.ORACLE_SQL | V.ORACLE_SQL | Q.ORACLE_SQL)[source].replace(P.L.LEDGER_SQL.strip(), cte))


_variant("AGG15_orders", sequence.missing_pages, "AGG15_missing_pages", {"doc": "concat('D', CAST(rowno % 7 AS STRING))", "page": "rowno % 50 * 2 + 1"})
_variant("ER09_orders", lambda led: views.overlapping_documents(led, 1, 1), "ER09_overlapping_documents", {"bal": "CAST(amt * 2 AS DECIMAL(18,2))", "doc": "CASE WHEN doc = 'DOC_B' THEN 'B' ELSE concat('A', CAST(rowno % 5 AS STRING)) END"})
_variant("FIX02_orders", repair.printed_dates, "FIX02_printed_dates", {"raw_text": "concat('x 20', CAST(20 + rowno % 9 AS STRING), '-', lpad(CAST(month(d) AS STRING), 2, '0'), '-', lpad(CAST(day(d) AS STRING), 2, '0'))"})
_variant("SEQ12_orders", repair.shifted_pages, "SEQ12_shifted_pages", {"bal": "CAST(CASE WHEN rowno % 10 = 0 AND rowno % 3 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2))", "page": "rowno % 40"})
_variant("SEQ11_orders", sequence.flipped_pages, "SEQ11_flipped_pages", {"acct": "'6222000000000001'", "dir": "'OUT'", "amt": "CAST(100 AS DECIMAL(18,2))", "bal": "CAST(floor(rowno / 97) * 100 AS DECIMAL(18,2))", "page": "rowno % 97"})
