"""Flow classes, milestones, counterparties and case totals over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import text as T

#: The words that make up each class, as unanchored patterns.
JUDICIAL = r"司法划扣|司法扣划|法院划扣|法院扣划|司法扣款|冻结扣划|强制扣划|强制执行扣款|(?:网络)?执行查控.{0,12}(?:扣划|划扣)|网络查控.{0,20}(?:扣划|划扣)"
GENERIC_JUDICIAL = r"网络.*查控.*(?:扣划|划扣)|(?:扣划|划扣).*专户"
CASH = r"现金取款|取现|柜面取款"
IN_CLASSES = [
    ("LOAN_DISBURSEMENT", r"放款|贷款入账|贷款发放|借款发放"),
    ("SALARY_INCOME", r"工资|薪资|薪酬|奖金|劳务|代发"),
    ("REFUND_REVERSAL", r"退款|退货|冲正|撤销|退汇"),
    ("INTEREST_INCOME", r"结息|利息收入|存款利息"),
    ("TRANSFER_IN", r"转账|汇款|入账|收款"),
]
OUT_CLASSES = [
    ("CASH_WITHDRAWAL", r"现金取款|现金支取|取现|柜面取款"),
    ("LOAN_REPAYMENT", r"贷款还款|偿还贷款|还贷|还本|按揭|房贷|车贷|信用卡还款|透支还款|分期付款到期扣收"),
    ("INVESTMENT_WEALTH", r"理财|基金|证券|银证|股票|债券|贵金属|黄金|投资"),
    ("INSURANCE", r"保险|保费|寿险|财险"),
    ("TAX_AND_FEES", r"手续费|服务费|年费|工本费|账户管理费|税款|税费|纳税|透支利息|罚息"),
    ("CONSUMPTION", r"消费|购物|餐饮|商户|pos|快捷支付|微信|支付宝|财付通|京东|美团|拼多多|水费|电费|燃气|话费"),
    ("TRANSFER_OUT", r"转账|汇款|付款|支付"),
]
TYPE_CLASSES = [
    ("司法扣划", "OUT", "JUDICIAL_DEDUCTION"), ("贷款放款", "IN", "LOAN_DISBURSEMENT"), ("贷款还款", "OUT", "LOAN_REPAYMENT"),
    ("信用卡还款", "OUT", "LOAN_REPAYMENT"), ("信用卡还款", "IN", "TRANSFER_IN"), ("工资收入", "IN", "SALARY_INCOME"),
    ("存款结息", "IN", "INTEREST_INCOME"), ("退款", "IN", "REFUND_REVERSAL"), ("分期退款", "IN", "REFUND_REVERSAL"),
    ("手续费", "OUT", "TAX_AND_FEES"), ("透支利息", "OUT", "TAX_AND_FEES"), ("保险支出", "OUT", "INSURANCE"),
    ("消费", "OUT", "CONSUMPTION"), ("缴费", "OUT", "CONSUMPTION"), ("账户转账", "IN", "TRANSFER_IN"), ("账户转账", "OUT", "TRANSFER_OUT"),
    ("第三方支付", "IN", "TRANSFER_IN"), ("第三方支付", "OUT", "TRANSFER_OUT"), ("分期", "OUT", "LOAN_REPAYMENT"),
]
#: Milestones, latest listed first among equal dates being the earlier one, and their labels.
MILESTONES = [
    ("lawsuit_filing_date", "【诉讼保全期间】"), ("judgment_effective_date", "【判决生效后至立案前】"), ("execution_filing_date", "【执行立案后】"),
    ("report_order_served_date", "【报告财产令后】"), ("freeze_date", "【查封冻结后】"), ("settlement_date", "【和解协议后】"),
]
SALTS = 8
USUAL, BEFORE_DEBT, AFTER_DEBT = "常规期间", "【债务形成前】", "【债务形成后至起诉前】"
NO_NAME, JUDICIAL_NAME, CASH_NAME = "【无对手方名称／用途待核对】", "【司法机关划扣】", "【现金取现】"


def _joined(*columns: str) -> Column:
    return F.concat_ws(" ", *(T.text(c) for c in columns))


def is_judicial() -> Column:
    """CLS02."""
    return (F.col("dir") == "OUT") & ((F.col("type") == "司法扣划") | _joined("summary", "raw_text").rlike(JUDICIAL))


def effective_name() -> Column:
    """CLS03: the judicial label, the printed name, the cash label or the label of no name."""
    name, context = F.trim("cp_name"), _joined("type", "summary", "raw_text")
    cash = context.rlike(CASH) | context.rlike(r"(?<![A-Za-z0-9_])ATM(?![A-Za-z0-9_])")
    return F.when(context.rlike(JUDICIAL) & ((name == "") | name.rlike(GENERIC_JUDICIAL)), JUDICIAL_NAME).when(name != "", name).when(cash, CASH_NAME).otherwise(NO_NAME)


def flow_class() -> Column:
    """CLS01: by type and direction, else by the words of the row; NULL for unknown directions."""
    out = None
    for kind, direction, code in TYPE_CLASSES:
        test = (F.col("type") == kind) & (F.col("dir") == direction)
        out = F.when(test, code) if out is None else out.when(test, code)
    words, party = F.lower(_joined("summary", "cp_name", "cp_bank", "raw_text")), (F.col("cp_name") != "") | (F.col("cp_acct") != "")
    incoming, outgoing = F.col("dir") == "IN", F.col("dir") == "OUT"
    for code, pattern in IN_CLASSES:
        out = out.when(incoming & (words.rlike(pattern) | (party if code == "TRANSFER_IN" else F.lit(False))), code)
    out = out.when(incoming, "OTHER_IN").when(outgoing & is_judicial(), "JUDICIAL_DEDUCTION")
    for code, pattern in OUT_CLASSES:
        extra = party if code == "TRANSFER_OUT" else words.rlike(r"(?<![a-z0-9_])atm(?![a-z0-9_])") if code == "CASH_WITHDRAWAL" else F.lit(False)
        out = out.when(outgoing & (words.rlike(pattern) | extra), code)
    return out.when(outgoing, "OTHER_OUT")


def phase_tag(day: str = "d") -> Column:
    """PRJ02: the latest milestone reached; among equal dates the one listed first."""
    reached = F.filter(
        F.array(*(F.struct(F.col(c).alias("at"), F.lit(-k).alias("rank"), F.lit(label).alias("label")) for k, (c, label) in enumerate(MILESTONES))),
        lambda m: m["at"].isNotNull() & (F.col(day) >= m["at"]),
    )
    last = F.array_max(reached)["label"]
    debt = F.col("debt_formation_date")
    return F.coalesce(last, F.when(debt.isNotNull() & (F.col(day) < debt), BEFORE_DEBT).when(debt.isNotNull() & (F.col(day) >= debt), AFTER_DEBT), F.lit(USUAL))


def case_totals(rows: DataFrame) -> DataFrame:
    """AGG01: one pass over rows with their case's milestones. Rows marked ``internal`` count in the raw totals, but are no
    external inflow or outflow; coverage is the income since filing over the target, 1 where that is 0 or absent."""
    incoming, outgoing, external = F.col("dir") == "IN", F.col("dir") == "OUT", ~F.col("internal")
    since = lambda c: F.col("d") >= F.col(c)
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("amt"))), F.lit(0)).cast("decimal(28,2)")
    out = rows.groupBy("case_number").agg(
        F.count("*").alias("n_rows"), total(incoming).alias("total_in"), total(outgoing).alias("total_out"),
        total(incoming & external).alias("external_in"), total(outgoing & external).alias("external_out"),
        total(outgoing & external & since("execution_filing_date")).alias("out_since_filing"), total(outgoing & external & since("report_order_served_date")).alias("out_since_order"),
        total(incoming & external & since("execution_filing_date")).alias("in_since_filing"), F.max("target_amount").alias("target_amount"),
    )
    target = F.coalesce(F.nullif(F.col("target_amount"), F.lit(0).cast("decimal(18,2)")), F.lit(1).cast("decimal(18,2)"))
    return out.withColumn("coverage", F.round(F.col("in_since_filing").cast("double") / target.cast("double"), 6))


def named_parties(rows: DataFrame) -> DataFrame:
    """Rows with the identity key and effective name of their counterparty."""
    return rows.withColumn("cp_key", T.counterparty_key("cp_acct", "cp_name", "cp_bank", "doc", "tx_id")).withColumn("name", effective_name())


def counterparty_summary(rows: DataFrame) -> DataFrame:
    """AGG02: totals, dates and the first spelling of every counterparty. Sums combine on the map side, so the account that
    holds a tenth of the rows is one more key; the first name is a least, not a list."""
    key = T.counterparty_key("cp_acct", "cp_name", "cp_bank", "doc", "tx_id")
    named = rows.withColumn("cp_key", key).withColumn("name", effective_name())
    total = lambda side: F.coalesce(F.sum(F.when(F.col("dir") == side, F.col("amt"))), F.lit(0)).cast("decimal(28,2)")
    out = named.groupBy("cp_key").agg(
        F.min_by("name", F.struct("doc", "page", "rowno", "tx_id")).alias("cp_name"), total("IN").alias("total_in"), total("OUT").alias("total_out"),
        F.count("*").alias("n_rows"), F.min("d").alias("first_date"), F.max("d").alias("last_date"),
    )
    return out.withColumn("net_out", F.col("total_out") - F.col("total_in"))


def row_party_totals(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """JON05: every row with the totals of its counterparty, by its key, else by its trimmed name as the key. Rows are spread
    over ``SALTS`` parts of a key, since one counterparty may hold a tenth of them."""
    summary = summary.select("cp_key", "total_in", "total_out").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_name = summary.select(F.col("cp_key").alias("name_key"), "salt", F.col("total_in").alias("name_in"), F.col("total_out").alias("name_out"))
    keyed = rows.select(
        "tx_id", T.counterparty_key("cp_acct", "cp_name", "cp_bank", "doc", "tx_id").alias("cp_key"), F.pmod(F.xxhash64("tx_id"), F.lit(SALTS)).cast("int").alias("salt"),
        F.when(F.trim("cp_name") != "", F.concat(F.lit("name:"), T.person_name("cp_name"))).alias("name_key"),
    )
    found = keyed.join(summary, ["cp_key", "salt"], "left").join(by_name, ["name_key", "salt"], "left")
    return found.select("tx_id", F.coalesce("total_in", "name_in").alias("total_in"), F.coalesce("total_out", "name_out").alias("total_out"))


def flow_categories(rows: DataFrame) -> DataFrame:
    """AGG03."""
    classed = rows.withColumn("flow", flow_class()).where(F.col("flow").isNotNull())
    return classed.groupBy("dir", "flow").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("amt"), F.lit(0)).cast("decimal(28,2)").alias("total"))


def top_counterparties(summary: DataFrame, measure: str, k: int) -> DataFrame:
    """TOP01, TOP02: a sort with limit becomes one heap a partition, not a full sort."""
    return summary.orderBy(F.desc(measure), "cp_key").limit(k)
