"""Queries of the scalar functions, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import printed as R
from tallyline.functions import text as T
from tallyline.operators.ledger import read_ledger
from tallyline.plans import ledger_queries as P
from tallyline.plans.core import ROW_KEY, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


_led, _sql, _SP = read_ledger, P._sql, T.SPACES
_add("STR03_summaries", lambda s, d: _led(s, d).select("tx_id", R.summary_text("summary").alias("summary")), _sql(rf"SELECT tx_id, lower(regexp_replace(summary, '[{_SP}\-_@#*|/\\.,:;，。、：；]', '', 'g')) AS summary FROM led"))
_BARE_BANK = f"regexp_replace({{c}}, '[{_SP}]', '', 'g')"


def _bank_sql(c: str) -> str:
    bare = _BARE_BANK.replace("{c}", c)
    names = [(n, n) for n in R.BANKS] + list(R.BANK_ALIASES)
    return f"CASE WHEN regexp_matches({bare}, '{R.NO_BANK}') THEN '' " + " ".join(f"WHEN contains({bare}, '{a}') THEN '{n}'" for a, n in names) + f" ELSE regexp_replace({bare}, '股份有限公司|有限责任公司', '', 'g') END"


_add(
    "STR11_banks",
    lambda s, d: _led(s, d).select("tx_id", R.canonical_bank("bank").alias("bank"), R.is_useful_bank("bank", "holder").alias("useful")),
    _sql(f"""SELECT tx_id, {_bank_sql('bank')} AS bank, trim(bank, ' ') <> '' AND NOT regexp_matches(bank, '{R.UNVERIFIED}') AND regexp_matches(bank, '{R.BANK_KINDS}')
      AND NOT (length(trim(holder, ' ')) >= 2 AND contains(trim(bank, ' '), trim(holder, ' ')) AND contains(bank, '银行')) AS useful FROM led"""),
)
_LOOSE = rf"trim(regexp_replace(regexp_replace(coalesce(transaction_date,''), '[/.年月日{_SP}]', '-', 'g'), '-+', '-', 'g'), ' ')"
_add(
    "DAT03_loose_dates",
    lambda s, d: table(s, d, "observations").select("obs_id", R.loose_date("transaction_date").alias("day")).distinct(),
    f"""SELECT DISTINCT obs_id, CASE WHEN len(p) >= 3 THEN (CASE WHEN length(p[1]) = 4 THEN p[1] WHEN length(p[1]) = 2 THEN '20' || p[1] ELSE '2024' END) || '-' || (CASE WHEN length(p[2]) < 2 THEN lpad(p[2], 2, '0') ELSE p[2] END) || '-' || (CASE WHEN length(p[3]) < 2 THEN lpad(p[3], 2, '0') ELSE p[3] END)
      WHEN length(t) >= 8 THEN substr(t, 1, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7, 2) ELSE t END AS day FROM (SELECT obs_id, {_LOOSE} AS t, string_split({_LOOSE}, '-') AS p FROM observations)""",
)
_D8, _C6 = "regexp_replace(coalesce(transaction_date,''), '[^0-9]', '', 'g')", "regexp_replace(coalesce(transaction_time,''), '[^0-9]', '', 'g')"
_add(
    "DAT04_stamps",
    lambda s, d: table(s, d, "bank_transactions").select("tx_id", R.digits_stamp("transaction_date", "transaction_time").alias("by_digits"), R.sortable_stamp("transaction_date", "transaction_time").alias("sortable")).distinct(),
    rf"""SELECT DISTINCT tx_id, CASE WHEN NOT coalesce(length(d) >= 8 AND try_cast(substr(d,1,4) AS INT) BETWEEN 1900 AND 2100 AND try_cast(substr(d,5,2) AS INT) BETWEEN 1 AND 12 AND try_cast(substr(d,7,2) AS INT) BETWEEN 1 AND 31, false) THEN ''
      ELSE substr(d,1,4) || '-' || substr(d,5,2) || '-' || substr(d,7,2) || CASE WHEN coalesce(length(c) >= 4 AND try_cast(substr(c,1,2) AS INT) <= 23 AND try_cast(substr(c,3,2) AS INT) <= 59 AND try_cast(CASE WHEN length(c) >= 6 THEN substr(c,5,2) ELSE '00' END AS INT) <= 59, false)
        THEN ' ' || substr(c,1,2) || ':' || substr(c,3,2) || ':' || CASE WHEN length(c) >= 6 THEN substr(c,5,2) ELSE '00' END ELSE '' END END AS by_digits,
      trim(CASE WHEN regexp_matches(rd, '^\d{{4}}/\d{{2}}/\d{{2}}$') THEN replace(rd, '/', '-') WHEN regexp_matches(rd, '^\d{{8}}$') THEN substr(rd,1,4) || '-' || substr(rd,5,2) || '-' || substr(rd,7,2) WHEN rd = '' THEN '9999-99-99' ELSE rd END || ' ' ||
        CASE WHEN contains(rc, ':') THEN string_split(rc, ' ')[-1] WHEN regexp_matches(rc, '^\d{{6}}$') THEN substr(rc,1,2) || ':' || substr(rc,3,2) || ':' || substr(rc,5,2) WHEN rc <> '' THEN rc ELSE '00:00:00' END, ' ') AS sortable
      FROM (SELECT tx_id, {_D8} AS d, substr(CASE WHEN {_C6} <> '' THEN {_C6} ELSE substr({_D8}, 9, 20) END, 1, 6) AS c, trim(coalesce(transaction_date,''), ' ') AS rd, trim(coalesce(transaction_time,''), ' ') AS rc FROM bank_transactions)""",
)
_add(
    "DAT07_iso_dates",
    lambda s, d: table(s, d, "bank_transactions").select("tx_id", R.iso_date("transaction_date").alias("day")).distinct(),
    r"SELECT DISTINCT tx_id, CASE WHEN regexp_matches(transaction_date, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(transaction_date AS DATE) END AS day FROM bank_transactions",
)
_T = "replace(replace(trim(coalesce({c},''), ' '), '−', '-'), '，', ',')"


def _score_sql(f: str) -> str:
    t = _T.replace("{c}", f)
    bare = f"regexp_replace({t}, '[,￥¥]', '', 'g')"
    if f in ("amount", "balance"):
        value = rf"CASE WHEN regexp_matches({bare}, '^[+-]?(\d+(\.\d*)?|\.\d+)$') THEN try_cast({bare} AS DECIMAL(18,2)) END"
        return f"CAST({f'abs({value})' if f == 'amount' else value} AS VARCHAR)"
    if f in ("account_number", "counterparty_account"):
        runs = rf"list_filter(regexp_extract_all({t}, '\d+'), lambda x: length(x) >= 8)"
        return f"CASE WHEN len({runs}) = 1 THEN {runs}[1] END"
    if f == "transaction_date":
        p = r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})([^\d]|$)"
        return f"CASE WHEN regexp_matches({t}, '{p}') THEN " + " || '-' || ".join(f"lpad(regexp_extract({t}, '{p}', {k}), {w}, '0')" for k, w in ((1, 4), (2, 2), (3, 2))) + " END"
    return rf"CASE WHEN {t} IN ('IN','收入','贷','借贷2','2') THEN 'IN' WHEN {t} IN ('OUT','支出','借','借贷1','1') THEN 'OUT' WHEN regexp_matches({t}, '^[+-][\d,.]+$') THEN CASE WHEN starts_with({t}, '-') THEN 'OUT' ELSE 'IN' END END"


_SCORED = ("account_number", "transaction_date", "direction", "amount", "balance", "counterparty_account")
_add(
    "NUM04_scoring_values",
    lambda s, d: table(s, d, "observations").select("obs_id", *(R.scoring_value(f, f).alias(f) for f in _SCORED)).distinct(),
    "SELECT DISTINCT obs_id, " + ", ".join(f"{_score_sql(f)} AS {f}" for f in _SCORED) + " FROM observations",
)


def _lane(c: str, start: int, factor: int, placed: bool) -> str:
    unit = f"(unicode({c}[i]) + {'i - 1' if placed else '0'})::UBIGINT"
    return f"list_reduce(list_prepend({start}::UBIGINT, list_transform(range(1, length({c}) + 1), lambda i: {unit})), lambda a, x: (xor(a, x) * {factor}::UBIGINT) % 4294967296::UBIGINT)"


def _lanes(c: str) -> str:
    return f"lower(lpad(to_hex({_lane(c, 2166136261, 16777619, False)}), 8, '0') || lpad(to_hex({_lane(c, 2246822507, 3266489909, True)}), 8, '0'))"


_add(
    "HSH01_two_lane_hashes",
    lambda s, d: table(s, d, "accounts").select("source_document_id", R.two_lane_hash("account_name").alias("hash")),
    f"SELECT source_document_id, {_lanes('n')} AS hash FROM (SELECT source_document_id, coalesce(account_name,'') AS n FROM accounts)",
)
_add(
    "HSH02_short_hashes",
    lambda s, d: table(s, d, "accounts").select("source_document_id", R.short_hash(F.concat_ws("|", "account_number", "account_name")).alias("hash")),
    f"SELECT source_document_id, to_base(({_lane('n', 2166136261, 16777619, False)})::BIGINT, 36) AS hash FROM (SELECT source_document_id, concat_ws('|', account_number, account_name) AS n FROM accounts)",
)
_add(
    "GRA06_entity_keys",
    lambda s, d: _led(s, d).select("tx_id", F.concat(F.lit("counterparty_"), R.two_lane_hash(T.counterparty_key("cp_acct", "cp_name", "cp_bank", "doc", "tx_id"))).alias("entity")),
    _sql(f"SELECT tx_id, 'counterparty_' || {_lanes('k')} AS entity FROM (SELECT tx_id, {P._PARTY_KEY} AS k FROM led)"),
)
_BOXES = "SELECT event_id, [value, value / 2, value + 3, value + 40] AS box FROM events"
_add(
    "GEO02_source_boxes",
    lambda s, d: table(s, d, "events").select("event_id", R.source_box(F.array(F.col("value"), F.col("value") / 2, F.col("value") + 3, F.col("value") + 40)).alias("r")).select("event_id", F.round("r.x", 9).alias("x"), F.round("r.y", 9).alias("y"), F.round("r.width", 9).alias("width"), F.round("r.height", 9).alias("height")),
    f"""SELECT event_id, CASE WHEN ok THEN round(x, 9) END AS x, CASE WHEN ok THEN round(y, 9) END AS y, CASE WHEN ok THEN round(least(w, 1 - x), 9) END AS width, CASE WHEN ok THEN round(least(greatest(h, 0.008), 1 - y), 9) END AS height FROM (
      SELECT *, w >= 0.03 AND h >= 0.005 AS ok FROM (SELECT event_id, c[2] AS x, c[1] AS y, c[4] - c[2] AS w, c[3] - c[1] AS h FROM (SELECT event_id, list_transform(box, lambda v: greatest(0.0, least(1.0, v / CASE WHEN list_max(box) > 1 THEN 1000.0 ELSE 1.0 END))) AS c FROM ({_BOXES}))))""",
)
_SEM = rf"regexp_replace(regexp_replace({{c}}, '\\n', '', 'g'), '[{_SP}]', '', 'g')"
_S, _C = _SEM.replace("{c}", "summary"), "summary || ' ' || raw_text"
_add(
    "CLS06_printed_types",
    lambda s, d: _led(s, d).select("tx_id", R.printed_type("summary", F.concat_ws(" ", "summary", "raw_text"), "dir").alias("kind")),
    _sql(rf"""SELECT tx_id, CASE WHEN dir = 'OUT' AND cr AND ln THEN '' WHEN dir = 'OUT' AND cr THEN '信用卡还款' WHEN dir = 'OUT' AND ln THEN '贷款还款'
      WHEN dir = 'OUT' AND contains(c, '还款') AND NOT regexp_matches(s, '^(?:自动还款|人民币自动转帐还款|微众银行还款)$') THEN CASE WHEN s = '消费' THEN '消费' ELSE '' END
      WHEN contains(s, '分期付款退货') THEN '分期退款' WHEN regexp_matches(s, '消费退货|消费退款|^退货$|^退款$') THEN '退款'
      WHEN dir = 'IN' AND regexp_matches(s, '^(?:现金存入|现金存款|存现|.{{1,12}}存现)$') THEN '现金存入' WHEN dir = 'OUT' AND regexp_matches(s, '^(?:现金支取|现金取款|取现|.{{1,12}}取现)$') THEN '现金支取'
      WHEN dir = 'IN' AND (regexp_matches(s, '^银联入账|^支付机构提现') OR regexp_matches(c, '(?:微信|零钱|余额宝|支付宝).{{0,8}}提现')) THEN '第三方支付' WHEN dir = 'OUT' AND regexp_matches(s, '^(?:快捷支付|网上支付)') THEN '第三方支付'
      WHEN s = '入金' AND regexp_matches(c, '支付宝|财付通|微信|银联|支付有限公司|支付股份有限公司') THEN '第三方支付' WHEN dir = 'OUT' AND s = '充值' AND regexp_matches(c, '(?:微信|支付宝|财付通|余额宝).{{0,12}}充值') THEN '第三方支付' END AS kind
      FROM (SELECT *, {_S} AS s, {_C} AS c, regexp_matches({_C}, '信用卡.{{0,8}}还款|贷记卡.{{0,8}}还款') AS cr, regexp_matches({_C}, '贷款还款|归还贷款|偿还贷款|还贷') AS ln FROM led)"""),
)
_N = _SEM.replace("{c}", "cp_name")
_add(
    "CLS07_printed_purposes",
    lambda s, d: _led(s, d).select("tx_id", R.printed_purpose("cp_name", "dir").alias("by_party"), R.printed_purpose("summary", "dir").alias("by_summary")),
    _sql("SELECT tx_id, " + ", ".join(rf"CASE WHEN dir = 'IN' AND {x} = '代发工资' THEN '工资收入' WHEN dir = 'IN' AND {x} = '银联入账' THEN '第三方支付' WHEN dir = 'OUT' AND regexp_matches({x}, '^(?:支付宝|微信|财付通|银联)[-—－·:：]消费$') THEN '消费' WHEN dir = 'IN' AND {x} = '转账收入' OR dir = 'OUT' AND {x} = '转账支出' THEN '账户转账' ELSE '' END AS {n}" for x, n in ((_N, "by_party"), (_S, "by_summary"))) + " FROM led"),
)
_add(
    "CLS09_failure_kinds",
    lambda s, d: table(s, d, "documents").select("doc_id", R.failure_kind("text").alias("kind")),
    "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(text,''), '{p}') THEN '{k}'" for k, p in R.FAILURES) + " ELSE 'UNKNOWN' END AS kind FROM documents",
)
_add(
    "CLS10_preflight",
    lambda s, d: table(s, d, "events").select("event_id", R.preflight(F.when(F.col("event_type") == "view", "blank").otherwise("print"), F.substring(F.lit("ABCDE"), (F.col("event_id") % 5).cast("int") + 1, F.lit(1)), F.col("value") / 1e6, F.col("value") / 1e6, F.col("user_id") % 2 == 0).alias("p")).select("event_id", "p.*"),
    """SELECT event_id, k = 'blank' AND v <= 0.00005 AND NOT t AS blank_confirmed, v <= 0.00005 AS pixel_blank, CASE WHEN k = 'blank' OR i < 0 THEN 0 ELSE i * 90 END::INT AS rotation, k <> 'blank' AND i < 0 AS uncertain FROM (
      SELECT event_id, CASE WHEN event_type = 'view' THEN 'blank' ELSE 'print' END AS k, value / 1e6 AS v, user_id % 2 = 0 AS t, (CASE WHEN event_id % 5 < 4 THEN event_id % 5 ELSE -1 END) AS i FROM events)""",
)
_add(
    "CLS11_payment_channels",
    lambda s, d: _led(s, d).select("tx_id", R.payment_channel(F.lit(""), "cp_name").alias("channel")),
    _sql("SELECT tx_id, CASE " + " ".join(f"WHEN starts_with(cp_name, '{c}') THEN '{c}'" for c in R.CHANNELS) + " ELSE '' END AS channel FROM led"),
)
_add(
    "CLS12_page_strategies",
    lambda s, d: table(s, d, "documents").select("doc_id", R.page_strategy("text").alias("strategy")),
    r"""SELECT doc_id, CASE WHEN NOT h AND regexp_matches(t, '(?i)Ground Truth image|OCR result should be empty|UNDERSCORE\s*&\s*LINE RULES') THEN 'BLANK' WHEN NOT h AND (t = '' OR regexp_matches(t, '无法识别|^\s*[{}]\s*$|\\therefore|1\.\s*2\.\s*3\.\s*4\.\s*5\.')) THEN 'ORIGINAL_PDF'
      WHEN h AND regexp_matches(t, '交易日期|记账日期|交易金额|发生额') AND regexp_matches(t, '(?i)<td\b[^>]*\bcolspan\s*=\s*["'']?([4-9]|[1-9]\d)') THEN 'MODEL_AND_ORIGINAL_PDF' ELSE 'MODEL' END AS strategy
      FROM (SELECT doc_id, trim(coalesce(text,''), ' ') AS t, regexp_matches(coalesce(text,''), '(?i)<table\b') AS h FROM documents)""",
)


def _independent(s: SparkSession, d: str) -> DataFrame:
    """PRJ15: the eight values of a reading brought to the form of the assembled rows; what can't be read stays as printed."""
    rows = P._cells(s, d, "independent_rows")
    day = F.coalesce(T.date_of("transaction_date").cast("string"), T.text("transaction_date"))
    side = F.when(T.text("direction").isin("+", "收入", "转入", "贷", "贷方"), "IN").when(T.text("direction").isin("-", "支出", "转出", "借", "借方"), "OUT").otherwise(T.text("direction"))
    money = lambda c, absolute: F.coalesce(T.money(c, absolute).cast("string"), T.text(c))
    time = F.when(day != "", F.concat(day, F.when(T.text("transaction_time") != "", F.concat(F.lit(" "), T.text("transaction_time"))).otherwise(""))).otherwise("")
    return rows.select(*ROW_KEY, day.alias("transaction_date"), time.alias("transaction_time"), side.alias("direction"), money("amount", True).alias("amount"), money("balance", False).alias("balance"))


_DAY = r"""coalesce(CAST(CASE WHEN regexp_matches(t, '^(19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?') THEN TRY_CAST(regexp_replace(t, '^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2}).*$', '\1-\2-\3') AS DATE)
  WHEN regexp_matches(t, '^(19|20)\d{6}$') THEN TRY_CAST(substr(t,1,4) || '-' || substr(t,5,2) || '-' || substr(t,7,2) AS DATE) END AS VARCHAR), coalesce(transaction_date,''))"""
_MONEY = rf"CASE WHEN regexp_matches(regexp_replace(coalesce({{c}},''), '[{_SP}¥￥]|元$', '', 'g'), '^[+-]?(\d{{1,3}}(,\d{{3}})+|\d{{1,15}})(\.\d{{1,2}})?$') THEN CAST(regexp_replace(regexp_replace({{c}}, '[{_SP}¥￥]|元$', '', 'g'), ',', '', 'g') AS DECIMAL(18,2)) END"
_add(
    "PRJ15_independent_values",
    _independent,
    "WITH " + P._CELL_SQL.format(n="b", t="independent_rows") + rf""" SELECT source_document_id, page_no, row_no, day AS transaction_date, CASE WHEN day <> '' THEN day || CASE WHEN coalesce(transaction_time,'') <> '' THEN ' ' || transaction_time ELSE '' END ELSE '' END AS transaction_time,
      CASE WHEN direction IN ('+','收入','转入','贷','贷方') THEN 'IN' WHEN direction IN ('-','支出','转出','借','借方') THEN 'OUT' ELSE coalesce(direction,'') END AS direction,
      coalesce(CAST(abs({_MONEY.replace('{c}', 'amount')}) AS VARCHAR), coalesce(amount,'')) AS amount, coalesce(CAST({_MONEY.replace('{c}', 'balance')} AS VARCHAR), coalesce(balance,'')) AS balance
      FROM (SELECT *, {_DAY} AS day FROM (SELECT *, regexp_replace(coalesce(transaction_date,''), '[{_SP}]', '', 'g') AS t FROM b))""",
)
_add(
    "ARR01_distinct_aliases",
    lambda s, d: table(s, d, "counterparties").select("counterparty_id", F.array_join(F.array_distinct(F.filter("aliases", lambda x: F.coalesce(x, F.lit("")) != "")), "|").alias("aliases")).distinct(),
    "SELECT DISTINCT counterparty_id, array_to_string(list_filter(list_transform(range(1, len(aliases) + 1), lambda i: CASE WHEN aliases[i] <> '' AND NOT list_contains(aliases[1:i-1], aliases[i]) THEN aliases[i] END), lambda x: x IS NOT NULL), '|') AS aliases FROM counterparties",
)
_add(
    "MAP01_field_evidence",
    lambda s, d: table(s, d, "observations").select("obs_id", F.explode(F.map_filter(F.create_map(*(x for f in _SCORED for x in (F.lit(f), F.struct(F.col(f).alias("original"), F.coalesce(R.scoring_value(f, f), F.col(f)).alias("current"))))), lambda k, v: F.coalesce(v["original"], F.lit("")) != "")).alias("field_name", "v")).select("obs_id", "field_name", "v.original", "v.current").distinct(),
    " UNION ".join(f"SELECT obs_id, '{f}' AS field_name, {f} AS original, coalesce({_score_sql(f)}, {f}) AS current FROM observations WHERE coalesce({f},'') <> ''" for f in _SCORED),
)
_add(
    "JSN01_scope_groups",
    lambda s, d: table(s, d, "assembled_rows").groupBy(F.struct("source_document_id", "page_no").alias("scope")).agg(F.count("*").alias("n_rows")).select("scope.source_document_id", "scope.page_no", "n_rows"),
    "SELECT source_document_id, page_no, count(*) AS n_rows FROM assembled_rows GROUP BY 1, 2",
)

