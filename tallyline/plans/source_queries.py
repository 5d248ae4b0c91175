"""Queries of sources, sinks and the later repairs and sequences, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import flows, repair, sequence
from tallyline.operators.ledger import read_accounts, read_ledger
from tallyline.plans import core
from tallyline.plans import ledger_queries as P
from tallyline.plans.core import table
from tallyline.plans.review_queries import _ALL, _BREAKS, _ROWS
from tallyline.sources import readers, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_led, _acc, _sql = read_ledger, read_accounts, P._sql
_DATE_WORDS = ("日期|date", "金额|amount", "余额|balance")
_add(
    "AGG19_table_rows",
    lambda s, d: readers.counted_table_rows(table(s, d, "documents"), "doc_id", "text", _DATE_WORDS),
    rf"""SELECT doc_id, len(list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all(text, '(?is)<table\b.*?</table>'), lambda t: regexp_matches(t, '{_DATE_WORDS[0]}') AND regexp_matches(t, '{_DATE_WORDS[1]}') AND regexp_matches(t, '{_DATE_WORDS[2]}')), lambda t: regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1))),
      lambda r: trim(regexp_replace(regexp_extract(r, '(?is)<td[^>]*>(.*?)</td>', 1), '<[^>]*>', '', 'g'), ' ')), lambda c: regexp_matches(c, '{readers.ROW_START}')))::INT AS n_rows FROM documents WHERE regexp_matches(text, '(?i)<table\b')""",
)
_add("SRC04_strict_summaries", lambda s, d: readers.strict_summary(core.p6_rows(s, d), ["account_number", "bank_name"], "line_id"))


def _recorded(s: SparkSession, d: str) -> DataFrame:
    """The ledger written as recorded extractions, a text a page, and read back."""
    row = F.struct(*(F.col(b).alias(a) for a, b in readers.SHORT_KEYS.items()))
    pages = _led(s, d).groupBy("doc", "page").agg(F.to_json(F.struct(F.count("*").cast("int").alias("n"), F.collect_list(row).alias("rows"))).alias("text"))
    return readers.recorded_rows(pages, "doc", "text")[0]


_add("SRC13_recorded_rows", _recorded, _sql("SELECT doc, acct, bank, page, rowno, tm, dir, amt, bal, cp_name FROM led"))
_ANCHORED = "concat(' ', rowno, ' ', replace(holder, ' ', ''), ' ', regexp_replace(acct, '[^0-9]', '0'), '00000000000 x ', d, ' 10:00:00 y ', CASE dir WHEN 'IN' THEN '贷' ELSE '借' END, ' ', amt, ' ', bal)"
_add(
    "SRC16_text_anchors",
    lambda s, d: readers.text_anchors(_led(s, d).where("d IS NOT NULL AND amt IS NOT NULL AND bal IS NOT NULL AND holder <> '' AND acct RLIKE '^[0-9]{8,18}$'").withColumn("printed", F.expr(_ANCHORED)), "tx_id", "printed").select("tx_id", "serial", "day", "side", "amount"),
    _sql("SELECT tx_id, rowno::VARCHAR AS serial, d::VARCHAR AS day, CASE dir WHEN 'IN' THEN '贷' ELSE '借' END AS side, CAST(abs(amt) AS VARCHAR) AS amount FROM led WHERE d IS NOT NULL AND amt >= 0 AND bal >= 0 AND replace(holder, ' ', '') <> '' AND regexp_matches(acct, '^[0-9]{8,18}$') AND rowno < 100000"),
)
_add(
    "SRC16_unread_pages",
    lambda s, d: readers.unread_pages(table(s, d, "documents"), "doc_id", "text"),
    f"SELECT doc_id, CASE WHEN trim(coalesce(text,''), ' ') = '' THEN 'NO_TEXT' ELSE 'DATES_WITHOUT_ROWS' END AS reason FROM documents WHERE trim(coalesce(text,''), ' ') = '' OR regexp_matches(text, '\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}') AND NOT regexp_matches(text, '{readers.ANCHOR}')",
)
_add(
    "SNK01_overview",
    lambda s, d: reports.workbook_tables(_led(s, d))["overview"],
    _sql(f"SELECT * FROM (SELECT count(DISTINCT doc) AS n_documents, count(DISTINCT (doc, acct)) AS n_accounts, count(*) AS n_rows, {P._IN} AS total_in, {P._OUT} AS total_out FROM led), (SELECT count(*) AS n_issues FROM every)", _ROWS, _BREAKS, _ALL),
)
_add(
    "SNK01_hidden_assets",
    lambda s, d: reports.workbook_tables(_led(s, d))["hidden_assets"].select("tx_id", "flow"),
    _sql(f"SELECT tx_id, flow FROM (SELECT tx_id, {P._FLOW} AS flow FROM led) WHERE flow IN ('INSURANCE','INVESTMENT_WEALTH')"),
)
_add(
    "SNK02_report_lines",
    lambda s, d: reports.report_lines(_led(s, d)).select("section", "line"),
    _sql(f"""SELECT 1 AS section, concat_ws(' ', dir, flow, n::VARCHAR, total::VARCHAR) AS line FROM (SELECT dir, flow, count(*) AS n, CAST(coalesce(sum(amt),0) AS DECIMAL(28,2)) AS total FROM (SELECT *, {P._FLOW} AS flow FROM led) WHERE flow IS NOT NULL GROUP BY 1, 2)
      UNION ALL SELECT 2, concat_ws(' ', cp_name, net_out::VARCHAR) FROM (SELECT * FROM summ ORDER BY net_out DESC, cp_key LIMIT 15)""", P._SUMMARY),
)
_add(
    "SNK03_booklet_rows",
    lambda s, d: (lambda led: reports.booklet_rows(led.where(flows.is_judicial()).select(F.col("tx_id").alias("first_row"), F.col("status").isin("VERIFIED", "CORRECTED").alias("adopted")), led).select("first_row", "doc", "page", "d", "amt"))(_led(s, d)),
    _sql(f"SELECT tx_id AS first_row, doc, page, d, amt FROM led WHERE {P._JUD} AND status IN ('VERIFIED','CORRECTED')"),
)
_add(
    "SNK05_diagnostics",
    lambda s, d: reports.diagnostics(_acc(s, d), _led(s, d)),
    _sql("""SELECT doc, '文件：' || coalesce(file_name,'') || '；流水：' || coalesce(n_rows, 0) || ' 笔；' || coalesce(issues, '无异常') AS text, coalesce(n_issues, 0)::BIGINT AS n_issues FROM (SELECT DISTINCT source_document_id AS doc, file_name FROM accounts)
      LEFT JOIN (SELECT doc, count(*) AS n_rows FROM led GROUP BY 1) USING (doc) LEFT JOIN (SELECT doc, string_agg(category || '=' || n, '；' ORDER BY category || '=' || n) AS issues, sum(n) AS n_issues FROM (SELECT doc, category, sum(n_rows)::BIGINT AS n FROM every GROUP BY 1, 2) GROUP BY 1) USING (doc)""", _ROWS, _BREAKS, _ALL),
)
_add("SEQ06_chronological_issues", lambda s, d: sequence.chronological_issues(_led(s, d)))
_add(
    "SEQ09_exact_sequences",
    lambda s, d: sequence.exact_sequence_directions(_led(s, d)),
    _sql("""SELECT tx_id, side FROM (SELECT *, bool_and(ok AND side IS NOT NULL AND bal IS NOT NULL AND amt IS NOT NULL AND d IS NOT NULL) OVER (PARTITION BY doc, acct) AND count(*) OVER (PARTITION BY doc, acct) >= 3 AS sound FROM (
      SELECT *, coalesce(lag(bal) OVER w + CASE side WHEN 'OUT' THEN -amt WHEN 'IN' THEN amt END = bal, lag(tx_id) OVER w IS NULL) AS ok FROM (SELECT *, CASE WHEN dir IN ('IN','OUT') THEN dir WHEN regexp_matches(type || ' ' || summary, '利息|结息|入息') THEN 'IN' END AS side FROM led) WINDOW w AS (PARTITION BY doc, acct ORDER BY d NULLS FIRST, tm NULLS FIRST, page, rowno, tx_id))) WHERE sound AND dir NOT IN ('IN','OUT')"""),
)
_add(
    "FIX09_recorded_corrections",
    lambda s, d: repair.recorded_corrections(table(s, d, "bank_transactions").where("ingested_at IS NOT NULL"), "tx_id", "amount", "ingested_at"),
    "SELECT tx_id, arg_min(coalesce(amount,''), ingested_at) AS original, arg_max(coalesce(amount,''), ingested_at) AS current, count(DISTINCT ingested_at) AS n_versions, arg_min(coalesce(amount,''), ingested_at) <> arg_max(coalesce(amount,''), ingested_at) AS corrected FROM bank_transactions WHERE ingested_at IS NOT NULL GROUP BY 1",
)
_PEERS = """yr AS (SELECT doc, acct, page, rowno, tx_id, d, year(d)::INT AS y, lag(d) OVER w AS b, lead(d) OVER w AS f FROM led WHERE d IS NOT NULL WINDOW w AS (PARTITION BY doc, acct ORDER BY page, rowno, tx_id)),
peers AS (SELECT a.*, (SELECT min(p.y) FROM yr p WHERE p.doc = a.doc AND p.acct = a.acct AND p.tx_id <> a.tx_id) AS lo, (SELECT max(p.y) FROM yr p WHERE p.doc = a.doc AND p.acct = a.acct AND p.tx_id <> a.tx_id) AS hi, count(*) OVER (PARTITION BY doc, acct) AS n FROM yr a)"""
_add(
    "FIX03_outlier_years",
    lambda s, d: repair.outlier_years(_led(s, d)),
    _sql("""SELECT tx_id, d, p AS proposed FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY coalesce(abs(date_diff('day', CASE WHEN year(b) BETWEEN lo AND hi THEN b END, p)), 0) + coalesce(abs(date_diff('day', CASE WHEN year(f) BETWEEN lo AND hi THEN f END, p)), 0), p) AS rn
      FROM (SELECT *, try_cast(c || '-' || month(d) || '-' || day(d) AS DATE) AS p FROM (SELECT *, unnest(range(lo, hi + 1)) AS c FROM peers WHERE n >= 5 AND hi - lo <= 3 AND NOT y BETWEEN lo - 2 AND hi + 2)) WHERE p IS NOT NULL) WHERE rn = 1""", _PEERS),
)
_add(
    "PRJ13_row_policies",
    lambda s, d: _led(s, d).select("tx_id", (F.col("status").isin("VERIFIED", "CORRECTED")).alias("evidence_only"), (~F.col("status").isin("VERIFIED", "CORRECTED") & ~T.is_reliable("acct")).alias("can_inherit")),
    _sql(f"SELECT tx_id, status IN ('VERIFIED','CORRECTED') AS evidence_only, status NOT IN ('VERIFIED','CORRECTED') AND NOT {P._reliable('acct')} AS can_inherit FROM led"),
)
_add(
    "JON22_merged_context",
    lambda s, d: (lambda f: f("assembled_rows").withColumnRenamed("lines", "own").join(f("independent_rows"), ["source_document_id", "page_no"], "left").select("source_document_id", "page_no", F.size("own").alias("n_own"), F.size(F.array_union("own", F.coalesce("lines", F.array().cast("array<string>")))).alias("n_merged")))(
        lambda t: table(s, d, t).where("raw_direction IS NOT NULL").groupBy("source_document_id", "page_no").agg(F.collect_set("raw_direction").alias("lines"))
    ),
    "WITH x AS (SELECT source_document_id, page_no, list(DISTINCT raw_direction) AS own FROM assembled_rows WHERE raw_direction IS NOT NULL GROUP BY 1, 2), y AS (SELECT source_document_id, page_no, list(DISTINCT raw_direction) AS lines FROM independent_rows WHERE raw_direction IS NOT NULL GROUP BY 1, 2) SELECT source_document_id, page_no, len(own)::INT AS n_own, len(list_distinct(list_concat(own, coalesce(lines, []))))::INT AS n_merged FROM x LEFT JOIN y USING (source_document_id, page_no)",
)
