"""Queries over the ledger by operator id, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import alignment, events, flows, graph, review, sequence, views
from tallyline.operators import ledger as L
from tallyline.plans.core import CELLS, ROW_KEY, table
from tallyline.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _orders_sql(sql: str) -> str:
    """The same SQL over the ledger derived from orders, with accounts derived from customers."""
    accounts = "accounts AS (SELECT '6222' || lpad(c_custkey::VARCHAR, 12, '0') AS account_number, CASE WHEN c_custkey % 5 < 4 THEN 'DEBTOR_MAIN' ELSE 'UNKNOWN' END AS owner_type FROM customer)"
    return sql.replace(L.LEDGER_SQL.strip(), L.ORDERS_CTE + ",\n" + accounts)


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([L.LEDGER_SQL.strip(), *ctes]) + "\n" + body


_led, _acc = L.read_ledger, L.read_accounts
_SP = T.SPACES
_IDENT = "lower(regexp_replace({c}, '[" + _SP + r"\-_—–·•]', '', 'g'))"
_PERSON = "lower(regexp_replace({c}, '[" + _SP + "·•]', '', 'g'))"


def _ident(c: str) -> str:
    return _IDENT.replace("{c}", c)


def _reliable(c: str) -> str:
    return rf"(length({_ident(c)}) >= 8 AND NOT regexp_matches({_ident(c)}, '^\d{{17}}[\dx]$') AND NOT regexp_matches({c}, '{T.PLACEHOLDER}'))"


_PARTY_KEY = rf"""CASE WHEN regexp_matches({_ident('cp_acct')}, '^\d{{12,32}}$') AND NOT regexp_matches({_ident('cp_acct')}, '^0+$') THEN 'account:' || {_ident('cp_acct')}
  WHEN {_ident('cp_acct')} <> '' THEN 'other|' || {_ident('cp_acct')} || '|' || {_ident('cp_bank')} || '|' || {_PERSON.replace('{c}', 'cp_name')}
  WHEN trim(cp_name) <> '' THEN 'name:' || {_PERSON.replace('{c}', 'cp_name')} ELSE 'unknown:' || doc || ':' || tx_id END"""
_JUD = f"(dir = 'OUT' AND (type = '司法扣划' OR regexp_matches(summary || ' ' || raw_text, '{flows.JUDICIAL}')))"
_WORDS = "lower(summary || ' ' || cp_name || ' ' || cp_bank || ' ' || raw_text)"


def _flow_sql() -> str:
    party = "(cp_name <> '' OR cp_acct <> '')"
    out = [f"WHEN type = '{t}' AND dir = '{d}' THEN '{c}'" for t, d, c in flows.TYPE_CLASSES]
    out += [f"WHEN dir = 'IN' AND (regexp_matches({_WORDS}, '{p}'){' OR ' + party if c == 'TRANSFER_IN' else ''}) THEN '{c}'" for c, p in flows.IN_CLASSES]
    out += ["WHEN dir = 'IN' THEN 'OTHER_IN'", f"WHEN {_JUD} THEN 'JUDICIAL_DEDUCTION'"]
    atm = rf" OR regexp_matches({_WORDS}, '\batm\b')"
    out += [f"WHEN dir = 'OUT' AND (regexp_matches({_WORDS}, '{p}'){' OR ' + party if c == 'TRANSFER_OUT' else atm if c == 'CASH_WITHDRAWAL' else ''}) THEN '{c}'" for c, p in flows.OUT_CLASSES]
    return "CASE " + " ".join(out) + " WHEN dir = 'OUT' THEN 'OTHER_OUT' END"


_FLOW = _flow_sql()
_NAME = rf"""CASE WHEN regexp_matches(type || ' ' || summary || ' ' || raw_text, '{flows.JUDICIAL}') AND (trim(cp_name, ' ') = '' OR regexp_matches(trim(cp_name, ' '), '{flows.GENERIC_JUDICIAL}')) THEN '{flows.JUDICIAL_NAME}'
  WHEN trim(cp_name, ' ') <> '' THEN trim(cp_name, ' ')
  WHEN regexp_matches(type || ' ' || summary || ' ' || raw_text, '\bATM\b|{flows.CASH}') THEN '{flows.CASH_NAME}' ELSE '{flows.NO_NAME}' END"""
_CASED = """cased AS (SELECT led.*, a.case_number, a.owner_type, c.* EXCLUDE (case_number) FROM led LEFT JOIN accounts a ON a.source_document_id = led.doc LEFT JOIN cases c ON c.case_number = a.case_number)"""


def _cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the cases are a fixed table, so small that its size decides for a broadcast by itself
    return L.with_case(_led(spark, sf_dir), _acc(spark, sf_dir)).join(L.read_cases(spark, sf_dir), "case_number", "left")


# --- projections, classes and keys -------------------------------------------------------------------------------

_add("LED01_typed_rows", lambda s, d: _led(s, d).select("tx_id", "doc", "d", "dir", "amt", "bal", "page", "rowno"), _sql("SELECT tx_id, doc, d, dir, amt, bal, page, rowno FROM led"))
_add(
    "STR01_account_keys",
    lambda s, d: _led(s, d).select("tx_id", T.identity_part("acct").alias("part"), T.is_reliable("acct").alias("reliable"), T.master_account_key("acct", "doc", "bank", "file").alias("master")),
    _sql(f"""SELECT tx_id, {_ident('acct')} AS part, {_reliable('acct')} AS reliable,
      CASE WHEN {_reliable('acct')} THEN 'account|' || {_ident('acct')} ELSE 'unverified|' || 'unverified|' || {_ident('bank')} || '|' || {_ident('acct')} || '|' || file END AS master FROM led"""),
)
_add("ER15_counterparty_keys", lambda s, d: _led(s, d).select("tx_id", T.counterparty_key("cp_acct", "cp_name", "cp_bank", "doc", "tx_id").alias("cp_key")), _sql(f"SELECT tx_id, {_PARTY_KEY} AS cp_key FROM led"))
_add("CLS01_flow_class", lambda s, d: _led(s, d).select("tx_id", flows.flow_class().alias("flow")), _sql(f"SELECT tx_id, {_FLOW} AS flow FROM led"))
_add("CLS02_judicial", lambda s, d: _led(s, d).where(flows.is_judicial()).select("tx_id"), _sql(f"SELECT tx_id FROM led WHERE {_JUD}"))
_add("CLS03_effective_names", lambda s, d: _led(s, d).select("tx_id", flows.effective_name().alias("name")), _sql(f"SELECT tx_id, {_NAME} AS name FROM led"))
_MILE = ", ".join(f"CASE WHEN d >= {c} THEN {c} END" for c, _ in flows.MILESTONES)
_TAG = "CASE " + " ".join(f"WHEN {c} IS NOT NULL AND d >= {c} AND {c} = greatest({_MILE}) THEN '{label}'" for c, label in flows.MILESTONES)
_add(
    "PRJ02_phase_tags",
    lambda s, d: _cased(s, d).select("tx_id", flows.phase_tag().alias("phase")),
    _sql(f"SELECT tx_id, {_TAG} WHEN d < debt_formation_date THEN '{flows.BEFORE_DEBT}' WHEN d >= debt_formation_date THEN '{flows.AFTER_DEBT}' ELSE '{flows.USUAL}' END AS phase FROM cased", _CASED),
)
_add(
    "PRJ06_search",
    lambda s, d: graph.search(_led(s, d), "费", "VERIFIED").select("tx_id"),
    _sql("SELECT tx_id FROM led WHERE status = 'VERIFIED' AND (" + " OR ".join(f"contains(lower(coalesce({c},'')), '费')" for c in ("cp_name", "cp_acct", "summary", "type", "raw_text", "tm")) + ")"),
)
_add("PRJ06_status_counts", lambda s, d: _led(s, d).groupBy("status").agg(F.count("*").alias("n")), _sql("SELECT status, count(*) AS n FROM led GROUP BY 1"))
_TN = ["debt_formation_date", "lawsuit_filing_date", "judgment_effective_date", "execution_filing_date", "report_order_served_date", "settlement_date"]
_add(
    "PRJ10_milestone_errors",
    lambda s, d: graph.milestone_errors(L.read_cases(s, d)),
    " UNION ALL ".join([f"SELECT case_number, 'MISSING {n}' AS error FROM cases WHERE {n} IS NULL" for n in _TN] + [f"SELECT case_number, 'ORDER {a}' FROM cases WHERE {a} > {b}" for a, b in zip(_TN, _TN[1:], strict=False)]),
)
_add(
    "PRJ11_page_ranges",
    lambda s, d: sequence.page_ranges(_led(s, d).where("page > 0")),
    _sql("""SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM (
      SELECT doc, min(page) AS a, max(page) AS b FROM (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS run FROM (SELECT DISTINCT doc, page FROM led WHERE page > 0)) GROUP BY doc, run) GROUP BY doc"""),
)
_add(
    "PRJ11_parsed_ranges",
    lambda s, d: sequence.parsed_ranges(sequence.page_ranges(_led(s, d).where("page > 0")), "doc", "pages"),
    _sql("SELECT DISTINCT doc, page FROM led WHERE page > 0"),
)
_add(
    "NUM01_printed_money",
    lambda s, d: table(s, d, "observations").select("obs_id", T.money("amount").alias("amount"), T.money("balance", absolute=True).alias("balance")).distinct(),
    "SELECT DISTINCT obs_id, " + ", ".join(
        rf"""{f}(CASE WHEN regexp_matches(regexp_replace(coalesce({c},''), '[{_SP}¥￥]|元$', '', 'g'), '^[+-]?(\d{{1,3}}(,\d{{3}})+|\d{{1,15}})(\.\d{{1,2}})?$') THEN CAST(regexp_replace(regexp_replace({c}, '[{_SP}¥￥]|元$', '', 'g'), ',', '', 'g') AS DECIMAL(18,2)) END) AS {c}"""
        for c, f in (("amount", ""), ("balance", "abs"))
    ) + " FROM observations",
)
_add(
    "DAT01_printed_days",
    lambda s, d: table(s, d, "observations").select("obs_id", T.date_of("transaction_date").alias("day"), T.direction_of("direction").alias("dir")).distinct(),
    r"""SELECT DISTINCT obs_id, CASE WHEN regexp_matches(t, '^(19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?') THEN TRY_CAST(regexp_replace(t, '^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2}).*$', '\1-\2-\3') AS DATE)
      WHEN regexp_matches(t, '^(19|20)\d{6}$') THEN TRY_CAST(substr(t,1,4) || '-' || substr(t,5,2) || '-' || substr(t,7,2) AS DATE) END AS day,
      CASE WHEN upper(coalesce(direction,'')) IN ('IN','贷','贷方','收','收入','转入','+','CR') THEN 'IN' WHEN upper(coalesce(direction,'')) IN ('OUT','借','借方','支','支出','转出','-','DR') THEN 'OUT' ELSE 'UNKNOWN' END AS dir
      FROM (SELECT *, regexp_replace(coalesce(transaction_date,''), '\s', '', 'g') AS t FROM observations)""",
)
_add(
    "HSH03_row_hashes",
    lambda s, d: _led(s, d).select("tx_id", T.row_fingerprint("tx_id", "dir", "amt", "cp_name").alias("hash")),
    _sql("SELECT tx_id, sha256(tx_id || chr(31) || dir || chr(31) || coalesce(amt::VARCHAR,'') || chr(31) || cp_name) AS hash FROM led"),
)

_IN, _OUT = "CAST(coalesce(sum(CASE WHEN dir = 'IN' THEN amt END), 0) AS DECIMAL(28,2))", "CAST(coalesce(sum(CASE WHEN dir = 'OUT' THEN amt END), 0) AS DECIMAL(28,2))"

# --- joins -------------------------------------------------------------------------------------------------------

_COMP = rf"""comp AS (SELECT *, {_ident('acct')} AS part, nullif(regexp_extract(coalesce(tm,''), '(\d{{2}}:\d{{2}}:\d{{2}})', 1), '') AS clock, {_ident('cp_acct')} AS n_cp,
  lower(regexp_replace(summary, '[{_SP}\-_—–·•,，。.、:：;；/\\()（）]', '', 'g')) AS n_sum, lower(regexp_replace(cp_name, '[{_SP}\-_—–·•,，。.、:：;；/\\()（）]', '', 'g')) AS n_name,
  lower(regexp_replace(raw_text, '[{_SP}\-_—–·•,，。.、:：;；/\\()（）]', '', 'g')) AS n_raw
  FROM led WHERE {_reliable('acct')} AND dir IN ('IN','OUT') AND d IS NOT NULL AND amt IS NOT NULL)"""


def _compat(x: str) -> str:
    return f"(a.{x} <> '' AND b.{x} <> '' AND (a.{x} = b.{x} OR (least(length(a.{x}), length(b.{x})) >= 4 AND (contains(a.{x}, b.{x}) OR contains(b.{x}, a.{x})))))"


_add(
    "JON01_duplicate_candidates",
    lambda s, d: events.duplicate_candidates(_led(s, d)),
    _sql(f"""SELECT * FROM (SELECT a.tx_id AS id_1, b.tx_id AS id_2,
      CASE WHEN (a.clock <> b.clock) OR (a.bal <> b.bal) OR (a.n_cp <> '' AND b.n_cp <> '' AND a.n_cp <> b.n_cp) THEN NULL ELSE
      (CASE WHEN a.clock IS NOT NULL AND b.clock IS NOT NULL THEN 4 ELSE 0 END) + (CASE WHEN a.bal IS NOT NULL AND b.bal IS NOT NULL THEN 4 ELSE 0 END) + (CASE WHEN a.n_cp <> '' AND b.n_cp <> '' THEN 3 ELSE 0 END)
      + (CASE WHEN {_compat('n_sum')} THEN 1 ELSE 0 END) + (CASE WHEN {_compat('n_name')} THEN 1 ELSE 0 END) + (CASE WHEN a.n_raw <> '' AND a.n_raw = b.n_raw THEN 2 ELSE 0 END) END AS points
      FROM comp a JOIN comp b ON a.part = b.part AND a.d = b.d AND a.dir = b.dir AND a.amt = b.amt AND a.tx_id < b.tx_id AND a.doc <> b.doc) WHERE points >= 4""", _COMP),
)
_TR = f"""own AS (SELECT DISTINCT {_ident('account_number')} AS part FROM accounts WHERE owner_type = 'DEBTOR_MAIN'),
tr AS (SELECT *, {_ident('acct')} AS part, {_ident('cp_acct')} AS n_cp FROM led WHERE dir IN ('IN','OUT') AND d IS NOT NULL AND amt IS NOT NULL AND {_ident('acct')} IN (SELECT part FROM own WHERE part <> ''))"""
_add(
    "JON02_transfer_candidates",
    lambda s, d: events.transfer_candidates(_led(s, d), _acc(s, d)),
    _sql("""SELECT o.tx_id AS out_id, i.tx_id AS in_id, abs(date_diff('day', i.d, o.d))::INT AS day_gap,
      (CASE WHEN o.n_cp = i.part AND i.n_cp = o.part THEN 100 ELSE 80 END - abs(date_diff('day', i.d, o.d)))::INT AS score
      FROM tr o JOIN tr i ON o.amt = i.amt AND o.dir = 'OUT' AND i.dir = 'IN' AND o.part <> i.part AND abs(date_diff('day', i.d, o.d)) <= 2
      WHERE (o.n_cp = i.part OR i.n_cp = o.part) AND NOT ((o.n_cp <> '' AND o.n_cp <> i.part) OR (i.n_cp <> '' AND i.n_cp <> o.part))""", _TR),
)
_add(
    "JON03_fast_in_out",
    lambda s, d: events.fast_in_out_candidates(_led(s, d)),
    _sql("""SELECT a.tx_id AS in_id, b.tx_id AS out_id, date_diff('day', a.d, b.d)::INT AS days FROM led a JOIN led b ON a.doc = b.doc AND a.acct = b.acct AND a.acct <> '' AND a.dir = 'IN' AND b.dir = 'OUT'
      AND a.amt >= 30000 AND b.amt >= 25500 AND b.d - a.d BETWEEN 0 AND 2 WHERE abs(a.amt - b.amt) <= a.amt * 0.15 AND (b.page, b.rowno, b.tx_id) > (a.page, a.rowno, a.tx_id)"""),
)
_add(
    "JON04_row_accounts",
    lambda s, d: graph.first_accounts(_led(s, d), _acc(s, d)),
    _sql(f"""SELECT tx_id, coalesce(m, '') AS account_number FROM led LEFT JOIN (SELECT source_document_id, {_ident('account_number')} AS part, min(account_number) AS m FROM accounts GROUP BY 1, 2) a ON a.source_document_id = doc AND a.part = {_ident('acct')}"""),
)
_add(
    "JON05_row_party_totals",
    lambda s, d: (lambda led: flows.row_party_totals(led, flows.counterparty_summary(led)))(_led(s, d)),
    _sql(f"""SELECT k.tx_id, coalesce(x.total_in, y.total_in) AS total_in, coalesce(x.total_out, y.total_out) AS total_out
      FROM (SELECT tx_id, {_PARTY_KEY} AS key, CASE WHEN trim(cp_name, ' ') <> '' THEN 'name:' || {_PERSON.replace('{c}', 'cp_name')} END AS name_key FROM led) k
      LEFT JOIN summ x ON x.cp_key = k.key LEFT JOIN summ y ON y.cp_key = k.name_key""", f"summ AS (SELECT {_PARTY_KEY} AS cp_key, {_IN} AS total_in, {_OUT} AS total_out FROM led GROUP BY 1)"),
)
_add(
    "ER20_suffix_aliases",
    lambda s, d: graph.suffix_accounts(_acc(s, d).select(F.expr("substr(account_number, 4)").alias("number")), _acc(s, d).select(F.col("account_number").alias("number"))),
    """SELECT short, min(l) AS long FROM (SELECT DISTINCT substr(account_number, 4) AS short FROM accounts) a JOIN (SELECT DISTINCT account_number AS l FROM accounts) b
      ON length(short) >= 10 AND length(l) - length(short) BETWEEN 1 AND 4 AND ends_with(l, short) GROUP BY short HAVING count(*) = 1""",
)


def _cells(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select(*ROW_KEY, *(F.get("cell_values", F.lit(k)).alias(c) for k, c in enumerate(CELLS)))
    return rows.distinct().withColumn("rid", F.concat_ws("/", *ROW_KEY))


_CELL_SQL = "{n} AS (SELECT DISTINCT source_document_id, page_no, row_no, " + ", ".join(f"cell_values[{k + 1}] AS {c}" for k, c in enumerate(CELLS)) + ", source_document_id || '/' || page_no || '/' || row_no AS rid FROM {t})"
_AB = [_CELL_SQL.format(n="a", t="assembled_rows"), _CELL_SQL.format(n="b", t="independent_rows")]
_ANCHOR = ["source_document_id", "transaction_date", "amount", "balance"]


def _anchors(s: SparkSession, d: str) -> DataFrame:
    a, b = _cells(s, d, "assembled_rows").withColumnRenamed("rid", "left_id"), _cells(s, d, "independent_rows").withColumnRenamed("rid", "right_id")
    return alignment.unique_matches(a, b, _ANCHOR, "left_id", "right_id").select("left_id", "right_id")


def _once(n: str) -> str:
    k = ", ".join(_ANCHOR)
    return f"(SELECT {k}, min(rid) AS rid FROM {n} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _ANCHOR) + f" GROUP BY {k} HAVING count(*) = 1)"


_add("JON14_unique_anchors", _anchors, "WITH " + ", ".join(_AB) + f" SELECT x.rid AS left_id, y.rid AS right_id FROM {_once('a')} x JOIN {_once('b')} y USING ({', '.join(_ANCHOR)})")
_add(
    "JON16_priority_matches",
    lambda s, d: alignment.evaluation_matches(_cells(s, d, "assembled_rows").withColumnRenamed("rid", "left_id"), _cells(s, d, "independent_rows").withColumnRenamed("rid", "right_id"), list(CELLS), "left_id", "right_id"),
)
_add(
    "JON15_aligned_pages",
    lambda s, d: alignment.aligned_pages(_cells(s, d, "assembled_rows"), _cells(s, d, "independent_rows"), ROW_KEY[:2], "row_no", list(CELLS)),
)
_add("JON20_zero_row_accounts", lambda s, d: graph.zero_row_accounts(_acc(s, d), _led(s, d)), _sql("SELECT source_document_id, account_number FROM accounts WHERE source_document_id NOT IN (SELECT doc FROM led WHERE doc IS NOT NULL)"))
_add(
    "TOP08_near_pages",
    lambda s, d: alignment.near_pages(_led(s, d).where("page > 0").select("doc", "page").distinct(), "doc", "page"),
    _sql("""SELECT doc, page, other, rank::INT AS rank FROM (SELECT p.doc, p.page, q.page AS other, row_number() OVER (PARTITION BY p.doc, p.page ORDER BY abs(q.page - p.page), q.page) AS rank
      FROM (SELECT DISTINCT doc, page FROM led WHERE page > 0) p JOIN (SELECT DISTINCT doc, page FROM led WHERE page > 0) q ON p.doc = q.doc AND p.page <> q.page) WHERE rank <= 2"""),
)

# --- aggregates --------------------------------------------------------------------------------------------------



def _since(side: str, c: str, name: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN dir = '{side}' AND d >= {c} THEN amt END), 0) AS DECIMAL(28,2)) AS {name}"


_OWNED = f"""owned AS (SELECT DISTINCT {_ident('account_number')} AS part FROM accounts WHERE owner_type = 'DEBTOR_MAIN' AND {_ident('account_number')} <> '')"""
_INTERNAL = f"({_ident('cp_acct')} <> '' AND {_ident('cp_acct')} <> {_ident('acct')} AND {_ident('cp_acct')} IN (SELECT part FROM owned) AND {_ident('acct')} IN (SELECT part FROM owned))"


def _external(side: str, name: str, since: str = "") -> str:
    later = f" AND d >= {since}" if since else ""
    return f"CAST(coalesce(sum(CASE WHEN dir = '{side}' AND NOT internal{later} THEN amt END), 0) AS DECIMAL(28,2)) AS {name}"


_TOTALS = f"""SELECT case_number, count(*) AS n_rows, {_IN} AS total_in, {_OUT} AS total_out, {_external('IN', 'external_in')}, {_external('OUT', 'external_out')}, {_external('OUT', 'out_since_filing', 'execution_filing_date')},
  {_external('OUT', 'out_since_order', 'report_order_served_date')}, {_external('IN', 'in_since_filing', 'execution_filing_date')}, max(target_amount) AS target_amount,
  round(CAST(coalesce(sum(CASE WHEN dir = 'IN' AND NOT internal AND d >= execution_filing_date THEN amt END), 0) AS DOUBLE) / CAST(coalesce(nullif(max(target_amount), 0), 1) AS DOUBLE), 6) AS coverage"""
_add("AGG01_case_totals", lambda s, d: flows.case_totals(events.with_internal(_cased(s, d), _acc(s, d))), _sql(f"{_TOTALS} FROM (SELECT *, {_INTERNAL} AS internal FROM cased) GROUP BY 1", _CASED, _OWNED))
_SUMMARY = f"""summ AS (SELECT {_PARTY_KEY} AS cp_key, arg_min({_NAME}, (doc, page, rowno, tx_id)) AS cp_name, {_IN} AS total_in, {_OUT} AS total_out, count(*) AS n_rows, min(d) AS first_date, max(d) AS last_date, CAST({_OUT} - {_IN} AS DECIMAL(29,2)) AS net_out FROM led GROUP BY 1)"""
_add("AGG02_counterparty_summary", lambda s, d: flows.counterparty_summary(_led(s, d)), _sql("SELECT * FROM summ", _SUMMARY))
_add("TOP01_by_net_out", lambda s, d: flows.top_counterparties(flows.counterparty_summary(_led(s, d)), "net_out", 15), _sql("SELECT * FROM summ ORDER BY net_out DESC, cp_key LIMIT 15", _SUMMARY))
_add("TOP02_by_total_out", lambda s, d: flows.top_counterparties(flows.counterparty_summary(_led(s, d)), "total_out", 10), _sql("SELECT * FROM summ ORDER BY total_out DESC, cp_key LIMIT 10", _SUMMARY))
_add("AGG03_flow_categories", lambda s, d: flows.flow_categories(_led(s, d)), _sql(f"SELECT dir, flow, count(*) AS n_rows, CAST(coalesce(sum(amt),0) AS DECIMAL(28,2)) AS total FROM (SELECT *, {_FLOW} AS flow FROM led) WHERE flow IS NOT NULL GROUP BY 1, 2"))
_SIGN = "CASE WHEN dir = 'IN' THEN amt WHEN dir = 'OUT' THEN -amt END"
_STATEMENTS = f"""stat AS (SELECT doc, acct, count(*) AS n_rows, {_IN} AS total_in, {_OUT} AS total_out, min(d) AS start_date, max(d) AS end_date,
  CAST(arg_min(CASE WHEN bal IS NOT NULL THEN bal - coalesce({_SIGN}, 0) END, (page, rowno, tx_id)) FILTER (bal IS NOT NULL) AS DECIMAL(20,2)) AS start_balance,
  CAST(arg_max(bal, (page, rowno, tx_id)) FILTER (bal IS NOT NULL) AS DECIMAL(20,2)) AS end_balance, bool_and(bal IS NOT NULL) AS all_balances, arg_max(bank, (page, rowno, tx_id)) AS last_bank FROM led GROUP BY 1, 2)"""
_add("AGG06_account_summary", lambda s, d: sequence.account_summary(_led(s, d)), _sql("SELECT * FROM stat", _STATEMENTS))
_add(
    "AGG08_balance_audit",
    lambda s, d: sequence.balance_audit(_led(s, d)),
    _sql("""SELECT doc, acct, CAST(start_balance + total_in - total_out - end_balance AS DECIMAL(28,2)) AS difference,
      CASE WHEN start_balance IS NULL OR NOT all_balances THEN 'MISSING_BALANCE' WHEN start_balance + total_in - total_out = end_balance THEN 'BALANCED' ELSE 'UNBALANCED' END AS state FROM stat""", _STATEMENTS),
)
_add(
    "AGG09_usual_bank",
    lambda s, d: sequence.most_frequent(_led(s, d), ["doc"], "bank"),
    _sql("SELECT doc, bank AS mode FROM (SELECT doc, bank, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, length(bank), bank) AS rn FROM led WHERE bank <> '' GROUP BY 1, 2) WHERE rn = 1"),
)
_add("AGG10_rows_by_source", lambda s, d: _led(s, d).groupBy("doc").agg(F.count("*").alias("n_rows")), _sql("SELECT doc, count(*) AS n_rows FROM led GROUP BY 1"))
_add(
    "AGG11_direction_vote",
    lambda s, d: table(s, d, "assembled_rows").select("source_document_id", F.trim("raw_direction").alias("mark"), T.direction_of(F.get("cell_values", F.lit(3))).alias("dir")).where("mark <> '' AND dir <> 'UNKNOWN'").groupBy("mark").agg(F.sum(F.when(F.col("dir") == "IN", 1).otherwise(0)).alias("n_in"), F.sum(F.when(F.col("dir") == "OUT", 1).otherwise(0)).alias("n_out")).where("n_in <> n_out").select("mark", F.when(F.col("n_in") > F.col("n_out"), "IN").otherwise("OUT").alias("dir")),
    """SELECT mark, CASE WHEN i > o THEN 'IN' ELSE 'OUT' END AS dir FROM (SELECT trim(raw_direction, ' ') AS mark, count(*) FILTER (cell_values[4] IN ('IN','贷','贷方','收','收入','转入','+','CR')) AS i, count(*) FILTER (cell_values[4] IN ('OUT','借','借方','支','支出','转出','-','DR')) AS o
      FROM assembled_rows WHERE trim(raw_direction, ' ') <> '' GROUP BY 1) WHERE i <> o""",
)
_ISSUES = """SELECT doc, page, reason, count(*) AS n_rows, min(tx_id) AS first_row FROM (
  SELECT doc, page, tx_id, 'LOW_CONFIDENCE' AS reason FROM led WHERE conf < 0.8 UNION ALL SELECT doc, page, tx_id, 'INVALID_AMOUNT' FROM led WHERE amt IS NULL OR amt < 0
  UNION ALL SELECT doc, page, tx_id, 'INVALID_DATE' FROM led WHERE d IS NULL UNION ALL SELECT doc, page, tx_id, 'INVALID_DIRECTION' FROM led WHERE dir NOT IN ('IN','OUT')) GROUP BY 1, 2, 3"""
_add("REV02_page_issues", lambda s, d: graph.page_issues(_led(s, d)), _sql(_ISSUES))
_add("AGG15_missing_pages", lambda s, d: sequence.missing_pages(_led(s, d)), _sql("SELECT doc, page::INT AS page FROM (SELECT doc, unnest(generate_series(min(page), max(page))) AS page FROM led WHERE page > 0 GROUP BY doc) EXCEPT SELECT doc, page FROM led"))
_add(
    "AGG16_duplicate_groups",
    lambda s, d: table(s, d, "observations").select("event_id", "obs_id", "source_document_id", "extraction_confidence").distinct().groupBy("event_id").agg(F.count("*").alias("n"), F.countDistinct("source_document_id").alias("n_docs"), F.min("extraction_confidence").alias("least_confidence")).where("n > 1"),
    "SELECT event_id, count(*) AS n, count(DISTINCT source_document_id) AS n_docs, min(extraction_confidence) AS least_confidence FROM (SELECT DISTINCT event_id, obs_id, source_document_id, extraction_confidence FROM observations) GROUP BY 1 HAVING count(*) > 1",
)
_OVER = ["source_document_id", "transaction_date", "amount"]
_add(
    "AGG18_multiset_overlap",
    lambda s, d: alignment.multiset_overlap(_cells(s, d, "assembled_rows"), _cells(s, d, "independent_rows"), _OVER),
    "WITH " + ", ".join(_AB) + f", u AS (SELECT {', '.join(_OVER)}, 1 AS x, 0 AS y FROM a UNION ALL SELECT {', '.join(_OVER)}, 0, 1 FROM b) SELECT {', '.join(_OVER)}, sum(x)::BIGINT AS n_left, sum(y)::BIGINT AS n_right, least(sum(x), sum(y))::BIGINT AS n_both FROM u GROUP BY ALL",
)
_add(
    "EVA01_overlap_rates",
    lambda s, d: alignment.overlap_rates(_cells(s, d, "assembled_rows"), _cells(s, d, "independent_rows"), [*ROW_KEY, *CELLS]),
    "WITH " + ", ".join(_AB) + f", u AS (SELECT {', '.join([*ROW_KEY, *CELLS])}, 1 AS x, 0 AS y FROM a UNION ALL SELECT {', '.join([*ROW_KEY, *CELLS])}, 0, 1 FROM b), g AS (SELECT sum(x) AS x, sum(y) AS y FROM u GROUP BY {', '.join([*ROW_KEY, *CELLS])}) SELECT sum(x)::BIGINT AS n_left, sum(y)::BIGINT AS n_right, sum(least(x, y))::BIGINT AS n_both, sum(least(x, y))::DOUBLE / sum(x) AS recall, sum(least(x, y))::DOUBLE / sum(y) AS precision FROM g",
)
_add("SET05_multiset_except", lambda s, d: alignment.multiset_except(_cells(s, d, "assembled_rows"), _cells(s, d, "independent_rows"), _OVER), "WITH " + ", ".join(_AB) + f" SELECT {', '.join(_OVER)} FROM a EXCEPT ALL SELECT {', '.join(_OVER)} FROM b")

# --- sequences ---------------------------------------------------------------------------------------------------

_ORD = "(PARTITION BY doc, acct ORDER BY page, rowno, tx_id)"
_add(
    "SEQ02_direction_votes",
    lambda s, d: sequence.direction_votes(_led(s, d)),
    _sql(f"SELECT doc, acct, count(*) FILTER (d > b) AS forward, count(*) FILTER (d < b) AS backward, count(*) FILTER (d < b) > count(*) FILTER (d > b) AS is_reversed FROM (SELECT *, lag(d) OVER {_ORD} AS b FROM led WHERE d IS NOT NULL) GROUP BY 1, 2"),
)
_KNOWN = "known AS (SELECT * FROM led WHERE bal IS NOT NULL AND amt IS NOT NULL AND dir IN ('IN','OUT'))"
_add(
    "SEQ04_continuity_score",
    lambda s, d: sequence.continuity_score(_led(s, d)),
    _sql(f"SELECT doc, acct, count(gap) AS n_pairs, CAST(coalesce(sum(gap),0) AS DECIMAL(28,2)) AS gap_sum FROM (SELECT doc, acct, CAST(CASE WHEN lag(bal) OVER {_ORD} IS NULL THEN NULL ELSE least(abs(lag(bal) OVER {_ORD} + {_SIGN} - bal), 1000000) END AS DECIMAL(18,2)) AS gap FROM known) GROUP BY 1, 2", _KNOWN),
)
_add(
    "SEQ06_continuity_issues",
    lambda s, d: sequence.continuity_issues(_led(s, d)),
    _sql(f"""SELECT prev_id, tx_id, expected, bal AS actual, coalesce(abs(date_diff('day', pd, d)), 0)::INT AS days_apart, coalesce(abs(date_diff('day', pd, d)), 0) > 30 AS is_long FROM (
      SELECT *, lag(tx_id) OVER {_ORD} AS prev_id, lag(d) OVER {_ORD} AS pd, CAST(lag(bal) OVER {_ORD} + {_SIGN} AS DECIMAL(18,2)) AS expected FROM known) WHERE prev_id IS NOT NULL AND expected <> bal""", _KNOWN),
)
_add(
    "SEQ11_flipped_pages",
    lambda s, d: sequence.flipped_pages(_led(s, d)),
    _sql(f"""SELECT doc, acct, page, n, direct, turned FROM (SELECT doc, acct, page, count(*) AS n, sum((abs(moved - sg) < 1)::INT)::BIGINT AS direct, sum((abs(moved + sg) < 1)::INT)::BIGINT AS turned FROM (
      SELECT doc, acct, page, {_SIGN} AS sg, bal - lag(bal) OVER (PARTITION BY doc, acct, page ORDER BY rowno, tx_id) AS moved FROM known) WHERE moved IS NOT NULL GROUP BY 1, 2, 3) WHERE n >= 2 AND turned >= 0.65 * n AND direct <= 0.25 * n""", _KNOWN),
)
_add(
    "SEQ14_inherited_bank",
    lambda s, d: sequence.inherited_owner(_led(s, d), "bank", ["page", "rowno", "tx_id"], ["doc"]).where("bank = ''").select("tx_id", "inherited"),
    _sql("""SELECT tx_id, CASE WHEN p = n THEN p ELSE '' END AS inherited FROM (SELECT tx_id, bank, last_value(nullif(bank,'') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, rowno, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
      first_value(nullif(bank,'') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, rowno, tx_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM led) WHERE bank = ''"""),
)
_add(
    "SEQ16_segments",
    lambda s, d: sequence.segments(_led(s, d), "cp_bank", ["page", "rowno", "tx_id"], ["doc"]).select("tx_id", "segment"),
    _sql("""SELECT tx_id, sum(fresh) OVER (PARTITION BY doc ORDER BY page, rowno, tx_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, CASE WHEN lag(held) OVER w <> held AND lag(held) OVER w <> '' THEN 1 ELSE 0 END AS fresh FROM (
      SELECT *, coalesce(last_value(nullif(cp_bank,'') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, rowno, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS held FROM led) WINDOW w AS (PARTITION BY doc ORDER BY page, rowno, tx_id))"""),
)
_add(
    "SEQ20_unpreceded",
    lambda s, d: sequence.unpreceded(_led(s, d)),
    _sql(f"""SELECT a.tx_id FROM known a WHERE a.d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known b WHERE b.d IS NOT NULL AND b.doc = a.doc AND b.acct = a.acct AND b.d <= a.d AND b.bal = a.bal - ({_SIGN.replace('dir', 'a.dir').replace('amt', 'a.amt')}))""", _KNOWN),
)
_add("SEQ05_chronological", lambda s, d: sequence.chronological(_led(s, d)))

# --- events, netting, graph --------------------------------------------------------------------------------------

_add("ER01_events", lambda s, d: events.canonical_events(_led(s, d)))
_add("NET01_internal_transfers", lambda s, d: events.internal_transfers(_led(s, d), _acc(s, d)))
_add(
    "GRA01_account_nodes",
    lambda s, d: graph.account_nodes(_acc(s, d)),
    f"""SELECT CASE WHEN {_reliable('account_number')} THEN 'account|' || {_ident('account_number')} ELSE 'unverified|unverified|' || {_ident("coalesce(bank_name,'')")} || '|' || {_ident('account_number')} || '|' || coalesce(file_name,'') END AS node,
      coalesce(min(nullif(account_name,'')),'') AS holder, coalesce(min(nullif(bank_name,'')),'') AS bank, count(*) AS n_sources FROM accounts GROUP BY 1""",
)
_MASTER = f"CASE WHEN {_reliable('acct')} THEN 'account|' || {_ident('acct')} ELSE 'unverified|unverified|' || {_ident('bank')} || '|' || {_ident('acct')} || '|' || file END"
_EDGES = f"""SELECT tx_id AS src, {_MASTER} AS dst, 'OF_ACCOUNT' AS kind FROM led
  UNION ALL SELECT tx_id, {_PARTY_KEY}, 'WITH_PARTY' FROM led {{external}} UNION ALL SELECT tx_id, flow, 'IN_CLASS' FROM (SELECT tx_id, {_FLOW} AS flow FROM led {{external}}) WHERE flow IS NOT NULL
  UNION ALL SELECT {_MASTER}, 'judicial:' || tx_id, 'DEDUCTION' FROM led WHERE {_JUD} UNION ALL SELECT 'judicial:' || tx_id, {_PARTY_KEY}, 'TO_AUTHORITY' FROM led WHERE {_JUD} UNION ALL SELECT tx_id, dup_of, 'REPEATS' FROM led WHERE dup_of <> ''"""
_add("GRA04_edges", lambda s, d: graph.edges(_led(s, d)), _sql(_EDGES.replace("{external}", "")))
_add("FPR01_fingerprints", lambda s, d: graph.fingerprints(_led(s, d)))
_add("SRC07_html_tables", lambda s, d: readers.html_tables(table(s, d, "documents"), "doc_id", "text").withColumn("cells", F.array_join("cells", "|")))
_add("SRC14_file_identities", lambda s, d: readers.documents(s, f"{d}/cases.parquet").select("doc", "length"))


# --- the pair operators over the ledger derived from orders, which has more pairs -----------------------------------

_ord, _cust = L.orders_ledger, L.orders_accounts
_add("JON01_orders", lambda s, d: events.duplicate_candidates(_ord(s, d)), _orders_sql(ORACLE_SQL["JON01_duplicate_candidates"]))
_add("JON02_orders", lambda s, d: events.transfer_candidates(_ord(s, d), _cust(s, d)), _orders_sql(ORACLE_SQL["JON02_transfer_candidates"]))
_add("JON03_orders", lambda s, d: events.fast_in_out_candidates(_ord(s, d)), _orders_sql(ORACLE_SQL["JON03_fast_in_out"]))
_add("CLS01_orders", lambda s, d: _ord(s, d).select("tx_id", flows.flow_class().alias("flow")), _orders_sql(ORACLE_SQL["CLS01_flow_class"]))
_add("AGG02_orders", lambda s, d: flows.counterparty_summary(_ord(s, d)), _orders_sql(ORACLE_SQL["AGG02_counterparty_summary"]))
_add("ER01_orders", lambda s, d: events.canonical_events(_ord(s, d)))
_add("NET01_orders", lambda s, d: events.internal_transfers(_ord(s, d), _cust(s, d)))
_CAND = """cand AS (SELECT o.tx_id AS out_id, i.tx_id AS in_id, (CASE WHEN o.n_cp = i.part AND i.n_cp = o.part THEN 100 ELSE 80 END - abs(date_diff('day', i.d, o.d)))::INT AS score
  FROM tr o JOIN tr i ON o.amt = i.amt AND o.dir = 'OUT' AND i.dir = 'IN' AND o.part <> i.part AND abs(date_diff('day', i.d, o.d)) <= 2
  WHERE (o.n_cp = i.part OR i.n_cp = o.part) AND NOT ((o.n_cp <> '' AND o.n_cp <> i.part) OR (i.n_cp <> '' AND i.n_cp <> o.part))),
pairs AS (SELECT out_id, in_id FROM (SELECT *, row_number() OVER (PARTITION BY out_id ORDER BY score DESC, in_id) AS rn FROM cand) WHERE rn = 1)"""
_PAIRED_IDS = "(SELECT out_id FROM pairs UNION SELECT in_id FROM pairs)"


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return views.best_pairs(events.transfer_candidates(_ord(s, d), _cust(s, d))).select("out_id", "in_id")


_add(
    "GRA04_orders",
    lambda s, d: graph.edges(_ord(s, d), _pairs(s, d)),
    _orders_sql(_sql(_EDGES.replace("{external}", f"WHERE tx_id NOT IN {_PAIRED_IDS}") + " UNION ALL SELECT least(out_id, in_id), greatest(out_id, in_id), 'INTERNAL_PAIR' FROM pairs", _TR, _CAND)),
)
_add("PRJ03_external_rows", lambda s, d: review.external_rows(_ord(s, d), _pairs(s, d)).select("tx_id"), _orders_sql(_sql(f"SELECT tx_id FROM led WHERE tx_id NOT IN {_PAIRED_IDS}", _TR, _CAND)))
_add("JON03_fast_pairs", lambda s, d: events.fast_in_out(_ord(s, d), least=1000, share=0.5))
