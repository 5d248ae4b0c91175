"""Queries of review issues, labels, decisions and carried annotations, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import flows, repair, review
from tallyline.operators.ledger import read_accounts, read_cases, read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans.core import ROW_KEY, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


_led, _acc, _sql = read_ledger, read_accounts, P._sql
_W = "type || ' ' || summary"
_ROWS = f"""issues AS (SELECT doc, acct, page, tx_id, 'LOW_CONFIDENCE' AS category FROM led WHERE coalesce(conf, 1) < 0.8
  UNION ALL SELECT doc, acct, page, tx_id, 'INVALID_AMOUNT' FROM led WHERE amt IS NULL OR amt <= 0 AND NOT regexp_matches({_W}, '{repair.FEE_WAIVER}')
  UNION ALL SELECT doc, acct, page, tx_id, 'INVALID_DATE' FROM led WHERE d IS NULL UNION ALL SELECT doc, acct, page, tx_id, 'INVALID_DIRECTION' FROM led WHERE dir NOT IN ('IN','OUT'))"""
_PERIODIC = f"regexp_matches(CASE WHEN summary <> '' THEN summary ELSE cp_name END, '{review.PERIODIC}')"
_BREAKS = f"""breaks AS (SELECT doc, acct, page, CASE WHEN disc THEN 'DISCRETE' ELSE 'BALANCE_BREAK' END AS category, CASE WHEN disc THEN 'ADVISORY' ELSE 'REQUIRED' END AS severity, n AS n_rows FROM (
  SELECT *, n_long * 2 >= n OR n_cross * 2 >= n OR ((n_per * 2 >= n OR per_rows * 2 >= rows) AND (sparse OR n_cross > 0 OR overdrawn)) OR (sparse AND overdrawn) AS disc FROM (
    SELECT b.*, p.rows, p.per_rows, p.overdrawn, p.dated >= 2 AND p.span >= 45 AND p.span >= 10 * p.dated AS sparse FROM (
      SELECT doc, acct, page, count(*) AS n, count(*) FILTER (gap > 30) AS n_long, count(*) FILTER (gap >= 20 OR date_trunc('month', pd) <> date_trunc('month', d)) AS n_cross, count(*) FILTER (per) AS n_per FROM (
        SELECT *, coalesce(abs(date_diff('day', pd, d)), 0) AS gap FROM (SELECT *, lag(d) OVER {P._ORD} AS pd, lag(bal) OVER {P._ORD} + {P._SIGN} AS expected, {_PERIODIC} AS per FROM led WHERE bal IS NOT NULL AND amt IS NOT NULL AND dir IN ('IN','OUT'))) WHERE expected <> bal GROUP BY 1, 2, 3) b
    JOIN (SELECT doc, acct, page, count(*) AS rows, count(d) AS dated, coalesce(date_diff('day', min(d), max(d)), 0) AS span, count(*) FILTER ({_PERIODIC}) AS per_rows, coalesce(bool_or(bal < 0), false) AS overdrawn FROM led GROUP BY 1, 2, 3) p USING (doc, acct, page)
    WHERE NOT (b.n = 1 AND b.n_long = 1))))"""
_ALL = "every AS (SELECT doc, acct, page, category, 'REQUIRED' AS severity, count(*) AS n_rows FROM issues GROUP BY 1, 2, 3, 4 UNION ALL SELECT * FROM breaks)"
_add("REV01_review_issues", lambda s, d: review.review_issues(_led(s, d)), _sql("SELECT * FROM every", _ROWS, _BREAKS, _ALL))
_add("REV01_balance_breaks", lambda s, d: review.balance_breaks(_led(s, d)), _sql("SELECT * FROM breaks", _BREAKS))
_add(
    "AGG14_review_groups",
    lambda s, d: review.review_groups(review.review_issues(_led(s, d))),
    _sql("SELECT key, count(*) AS n_issues, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, sum(n_rows)::BIGINT AS n_rows FROM (SELECT *, CASE WHEN page > 0 THEN 'document:' || doc || '|page:' || page ELSE doc || '|' || acct || '|issue:' || category END AS key FROM every) GROUP BY 1", _ROWS, _BREAKS, _ALL),
)
_add(
    "REV06_account_labels",
    lambda s, d: review.review_labels(_acc(s, d), _led(s, d)),
    _sql(f"""SELECT source_document_id, account_number, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN '{review.LABELS["empty"]}' WHEN coalesce(bank_name,'') = '' OR regexp_matches(bank_name, '{review.UNVERIFIED_BANK}') THEN '{review.LABELS["bank"]}'
      WHEN open THEN '{review.LABELS["open"]}' WHEN done THEN '{review.LABELS["done"]}' ELSE '{review.LABELS["system"]}' END AS label
      FROM accounts LEFT JOIN (SELECT doc, count(*) AS n, bool_and(status IN ('VERIFIED','CORRECTED')) AS done, bool_or(status = 'PENDING') AS open FROM led WHERE dup_of = '' GROUP BY 1) ON doc = source_document_id"""),
)
_add(
    "PRJ04_business_accounts",
    lambda s, d: _acc(s, d).where(review.is_business_account()).select("source_document_id", "account_number"),
    f"SELECT source_document_id, account_number FROM accounts WHERE NOT (coalesce(owner_type,'') = 'UNKNOWN' AND (regexp_matches(coalesce(account_number,''), '{review.UNASSIGNED}') OR coalesce(account_name,'') = '待归属页面'))",
)
_ISSUE_KEYS = ["source_document_id", "page_no", "field_name", "kind"]


def _issues(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name).select("source_document_id", "page_no", "row_no", F.explode("issues").alias("i")).select("source_document_id", "page_no", "row_no", "i.field_name", "i.kind", "i.reason")


def _saved(s: SparkSession, d: str) -> DataFrame:
    # the other reading's issues, closed on every third row, as if a person had gone through them
    status = F.when(F.col("row_no") % 3 == 0, "CONFIRMED").otherwise("UNRESOLVED")
    return _issues(s, d, "independent_rows").select(*_ISSUE_KEYS, status.alias("status"), F.coalesce("reason", F.lit("")).alias("note"))


_IS = "{n} AS (SELECT source_document_id, page_no, row_no, i.field_name AS field_name, i.kind AS kind, i.reason AS reason FROM (SELECT source_document_id, page_no, row_no, unnest(issues) AS i FROM {t}))"
_add(
    "JON08_saved_decisions",
    lambda s, d: review.with_saved_decisions(_issues(s, d, "assembled_rows"), _saved(s, d), _ISSUE_KEYS),
    "WITH " + _IS.format(n="g", t="assembled_rows") + ", " + _IS.format(n="h", t="independent_rows") + """, sv AS (SELECT source_document_id, page_no, field_name, kind, max((status, note)) AS s FROM (SELECT *, CASE WHEN row_no % 3 = 0 THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS status, coalesce(reason,'') AS note FROM h) GROUP BY 1, 2, 3, 4),
      now AS (SELECT DISTINCT source_document_id, page_no, field_name, kind, true AS now FROM g)
      SELECT source_document_id, page_no, field_name, kind, coalesce(s[1], 'PENDING') AS status, coalesce(s[2], '') AS note, CASE WHEN now THEN CASE WHEN s IS NULL THEN 'NEW' ELSE 'KEPT' END ELSE 'ORPHAN' END AS origin
      FROM now FULL JOIN sv USING (source_document_id, page_no, field_name, kind) WHERE coalesce(now, false) OR s[1] IN ('PENDING','UNRESOLVED')""",
)
_add(
    "SET03_kept_last",
    lambda s, d: review.kept_last(_issues(s, d, "assembled_rows"), _ISSUE_KEYS, ["row_no"]).select(*_ISSUE_KEYS, "row_no", "reason"),
    "WITH " + _IS.format(n="g", t="assembled_rows") + " SELECT source_document_id, page_no, field_name, kind, min(row_no) AS row_no, arg_max(reason, row_no) AS reason FROM g GROUP BY 1, 2, 3, 4",
)
_add(
    "REV03_pages_by_count",
    lambda s, d: (lambda led: review.page_by_count(led, led.groupBy("doc", "page").agg(F.count("*").alias("k")).select("doc", F.concat(F.lit("第"), F.col("page"), F.lit("页页面计数为 "), F.col("k") + 1, F.lit(" 笔，逐笔提取为 "), F.col("k"), F.lit(" 笔")).alias("m")).select("doc", review.count_comparison(F.col("m"))[0].alias("told"), review.count_comparison(F.col("m"))[1].alias("n"))))(_led(s, d)),
    _sql("""SELECT w.doc, w.n, w.n + 1 AS told, o.page FROM (SELECT doc, page, count(*)::INT AS n FROM led GROUP BY 1, 2) w JOIN (SELECT doc, n, min(page) AS page FROM (SELECT doc, page, count(*)::INT AS n FROM led WHERE page > 0 GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(*) = 1) o ON o.doc = w.doc AND o.n = w.n"""),
)
_add(
    "REV04_blocking_issues",
    lambda s, d: review.blocking_issues(_issues(s, d, "assembled_rows").withColumns({"category": F.when(F.col("row_no") % 2 == 0, "PAGE_INTEGRITY").otherwise("DATA_WARNING"), "severity": F.lit("REQUIRED"), "status": F.lit("PENDING"), "message": F.concat(F.lit("PDF 解析不完整 "), T.text("reason"))})).select(*ROW_KEY, "field_name", "kind").distinct(),
    "WITH " + _IS.format(n="g", t="assembled_rows") + " SELECT DISTINCT source_document_id, page_no, row_no, field_name, kind FROM g WHERE row_no % 2 = 0",
)


def _decisions(s: SparkSession, d: str) -> DataFrame:
    a, b = P._cells(s, d, "assembled_rows"), P._cells(s, d, "independent_rows")
    both = a.select(*ROW_KEY, F.col("amount").alias("current")).join(b.select(*ROW_KEY, F.col("amount").alias("original")), ROW_KEY)
    how = F.element_at(F.array(F.lit("USE_ORIGINAL"), F.lit("ACCEPT_CURRENT"), F.lit("UNRESOLVED")), (F.col("row_no") % 3 + 1).cast("int"))
    return review.decided_rows(both.withColumn("decision", how), "original", "current", "decision")


_add(
    "REV05_decided_rows",
    _decisions,
    "WITH " + ", ".join(P._AB) + """ SELECT source_document_id, page_no, row_no, c AS current, o AS original, h AS decision, CASE WHEN h = 'USE_ORIGINAL' THEN coalesce(o,'') ELSE coalesce(c,'') END AS value, CASE WHEN h = 'UNRESOLVED' THEN h ELSE 'CONFIRMED' END AS field_decision,
      CASE WHEN h = 'UNRESOLVED' THEN 'PENDING' WHEN coalesce(o,'') <> coalesce(c,'') THEN 'CORRECTED' ELSE 'VERIFIED' END AS row_status
      FROM (SELECT source_document_id, page_no, row_no, a.amount AS c, b.amount AS o, (['USE_ORIGINAL','ACCEPT_CURRENT','UNRESOLVED'])[row_no % 3 + 1] AS h FROM a JOIN b USING (source_document_id, page_no, row_no))""",
)
_NAMED = f"named AS (SELECT *, {P._PARTY_KEY} AS cp_key, {P._NAME} AS name FROM led)"


def _named(s: SparkSession, d: str) -> DataFrame:
    return flows.named_parties(_led(s, d))


_ALIKE = f"(trim(holder, ' ') <> '' AND starts_with(name, substr(trim(holder, ' '), 1, 1)) AND length(name) <= 4 AND name <> trim(holder, ' ') OR regexp_matches(summary, '{review.FAMILY}'))"
_DETAILS = f"""details AS (SELECT h.*, coalesce(t.summaries, '') AS summaries FROM (SELECT cp_key, count(DISTINCT name) AS n_aliases, arg_min({_ALIKE}, (doc, page, rowno, tx_id)) AS is_relative FROM named GROUP BY 1) h
  LEFT JOIN (SELECT cp_key, string_agg(summary, '|' ORDER BY pos) AS summaries FROM (SELECT *, row_number() OVER (PARTITION BY cp_key ORDER BY pos) AS nth FROM (SELECT cp_key, summary, min((doc, page, rowno, tx_id)) AS pos FROM named WHERE summary <> '' GROUP BY 1, 2)) WHERE nth <= 5 GROUP BY 1) t USING (cp_key))"""
_add("AGG02_counterparty_details", lambda s, d: review.counterparty_details(_named(s, d)), _sql("SELECT * FROM details", _NAMED, _DETAILS))
for _name, _value in (("AGG02_counterparty_aliases", "name"), ("AGG02_counterparty_rows", "tx_id")):
    _add(_name, lambda s, d, v=_value: review.numbered(_named(s, d), v), _sql(f"SELECT cp_key, {_value}, (row_number() OVER (PARTITION BY cp_key ORDER BY pos))::INT AS nth FROM (SELECT cp_key, {_value}, min((doc, page, rowno, tx_id)) AS pos FROM named GROUP BY 1, 2)", _NAMED))
_add(
    "PRJ09_role_tags",
    lambda s, d: (lambda named: named.select("tx_id", "cp_key").join(review.counterparty_details(named).where("is_relative").select("cp_key", F.lit("亲属").alias("tag")), "cp_key", "left").select("tx_id", F.coalesce("tag", F.lit("")).alias("tag")))(_named(s, d)),
    _sql("SELECT tx_id, CASE WHEN is_relative THEN '亲属' ELSE '' END AS tag FROM named JOIN details USING (cp_key)", _NAMED, _DETAILS),
)
_add(
    "JON06_annotations",
    lambda s, d: (lambda led: review.with_annotations(led.where(flows.is_judicial()).select(F.col("tx_id").alias("match_id"), F.lit("PENDING").alias("status"), F.lit("").alias("notes")), led.where("status <> ''").select(F.col("tx_id").alias("match_id"), "status", F.col("summary").alias("notes")), "match_id", ["status", "notes"]))(_led(s, d)),
    _sql(f"SELECT m.tx_id AS match_id, CASE WHEN p.tx_id IS NOT NULL THEN p.status ELSE 'PENDING' END AS status, CASE WHEN p.tx_id IS NOT NULL THEN p.summary ELSE '' END AS notes FROM (SELECT tx_id FROM led WHERE {P._JUD}) m LEFT JOIN (SELECT * FROM led WHERE status <> '') p ON p.tx_id = m.tx_id"),
)
_add(
    "SET01_checks_in_order",
    lambda s, d: (lambda led: review.in_registry_order([("judicial", led.where(flows.is_judicial()).select("tx_id")), ("waived", led.where(repair.fee_waivers()).select("tx_id"))]))(_led(s, d)),
    _sql(f"SELECT 0 AS ordinal, 'judicial' AS name, tx_id FROM led WHERE {P._JUD} UNION ALL SELECT 1, 'waived', tx_id FROM led WHERE regexp_matches({_W}, '{repair.FEE_WAIVER}')"),
)
_add(
    "SET02_protected_and_repaired",
    lambda s, d: (lambda led: led.where("status IN ('VERIFIED','CORRECTED')").select("tx_id", "dir", F.lit(True).alias("protected")).unionByName(repair.calibrated_directions(led.where("status NOT IN ('VERIFIED','CORRECTED')")).select("tx_id", F.col("proposed").alias("dir")), allowMissingColumns=True))(_led(s, d)),
    _sql(f"""SELECT tx_id, dir, true AS protected FROM led WHERE status IN ('VERIFIED','CORRECTED') UNION ALL SELECT tx_id, proposed, NULL FROM (SELECT *, CASE WHEN abs(b + amt - bal) <= 0.05 AND NOT abs(b - amt - bal) <= 0.05 THEN 'IN' WHEN abs(b - amt - bal) <= 0.05 AND NOT abs(b + amt - bal) <= 0.05 THEN 'OUT' END AS proposed
      FROM (SELECT *, lag(bal) OVER {P._ORD} AS b FROM led WHERE bal IS NOT NULL AND amt IS NOT NULL AND status NOT IN ('VERIFIED','CORRECTED')) WHERE b IS NOT NULL) WHERE proposed <> dir"""),
)
_add(
    "SET06_coverage_differences",
    lambda s, d: (lambda a, b: a.exceptAll(b).withColumn("side", F.lit("assembled")).unionByName(b.exceptAll(a).withColumn("side", F.lit("independent"))))(*(table(s, d, t).select(*ROW_KEY).distinct() for t in ("assembled_rows", "independent_rows"))),
    "SELECT *, 'assembled' AS side FROM (SELECT DISTINCT source_document_id, page_no, row_no FROM assembled_rows EXCEPT SELECT DISTINCT source_document_id, page_no, row_no FROM independent_rows) UNION ALL SELECT *, 'independent' FROM (SELECT DISTINCT source_document_id, page_no, row_no FROM independent_rows EXCEPT SELECT DISTINCT source_document_id, page_no, row_no FROM assembled_rows)",
)
_add(
    "TOP03_first_matches",
    lambda s, d: _led(s, d).where(flows.is_judicial()).select("tx_id", "doc", "amt").orderBy("doc", "page", "rowno", "tx_id").limit(5),
    _sql(f"SELECT tx_id, doc, amt FROM led WHERE {P._JUD} ORDER BY doc, page, rowno, tx_id LIMIT 5"),
)
_add(
    "TOP07_cases_by_date",
    lambda s, d: read_cases(s, d).select("case_number", F.row_number().over(repair.Window.orderBy(F.desc_nulls_last("execution_filing_date"), "case_number")).alias("place")),
    "SELECT case_number, (row_number() OVER (ORDER BY execution_filing_date DESC NULLS LAST, case_number))::INT AS place FROM cases",
)
_add(
    "PRJ16_pending_reviews",
    lambda s, d: (lambda i: i.groupBy(*ROW_KEY).agg(F.concat(F.lit("核对"), F.array_join(F.sort_array(F.collect_set("field_name")), "、")).alias("title"), F.count("*").alias("n_issues")))(_issues(s, d, "assembled_rows")),
    "WITH " + _IS.format(n="g", t="assembled_rows") + " SELECT source_document_id, page_no, row_no, '核对' || string_agg(DISTINCT field_name, '、' ORDER BY field_name) AS title, count(*) AS n_issues FROM g GROUP BY 1, 2, 3",
)
