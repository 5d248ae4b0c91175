"""Review issues over the ledger, decisions on them, labels, and the joins that carry earlier decisions over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions import text as T
from tallyline.operators.repair import FEE_WAIVER
from tallyline.operators.sequence import in_order, signed

#: What marks an account of pages that belong to no account yet, and a reading that failed as a whole.
UNASSIGNED = r"待归属页面|待处理页面"
HARD_FAILURE = r"连续识别失败|服务暂时不可用|未能完整获取|PDF\s*解析不完整"
UNVERIFIED_BANK = r"待核验|未知|待核对"
PERIODIC = r"结息|利息|年费|还款|代扣|分期|违约金|滞纳金|减免"
LABELS = {"empty": "仅账户资料，未提供流水", "bank": "银行名称待确认", "open": "仍有字段待核对", "done": "流水已人工核对", "system": "系统检查通过，未人工核对"}
FAMILY = r"生活费|赡养|学费|零用钱|配偶|亲属|儿子|女儿|父母"


def is_business_account() -> Column:
    """PRJ04: all but the placeholder for pages without an account."""
    marked = T.text("account_number").rlike(UNASSIGNED) | (T.text("account_name") == "待归属页面")
    return ~((T.text("owner_type") == "UNKNOWN") & marked)


def external_rows(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """PRJ03: rows that are no side of an internal transfer."""
    sides = pairs.select(F.col("out_id").alias("tx_id")).unionByName(pairs.select(F.col("in_id").alias("tx_id"))).distinct()
    return ledger.join(sides, "tx_id", "left_anti")


def row_issues(ledger: DataFrame) -> DataFrame:
    """REV02: ``(doc, page, tx_id, category)`` of every row that needs a look by itself; waived fees may be nothing."""
    waived = F.concat_ws(" ", "type", "summary").rlike(FEE_WAIVER)
    tests = {
        "LOW_CONFIDENCE": F.coalesce("conf", F.lit(1.0)) < 0.8, "INVALID_AMOUNT": F.col("amt").isNull() | (F.col("amt") <= 0) & ~waived,
        "INVALID_DATE": F.col("d").isNull(), "INVALID_DIRECTION": ~F.col("dir").isin("IN", "OUT"),
    }
    found = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    return ledger.select("doc", "acct", "page", "tx_id", F.explode(found).alias("category"))


def balance_breaks(ledger: DataFrame) -> DataFrame:
    """REV01: one issue a statement's page with breaks of the balance: DISCRETE where the page reads like a periodic or sparse
    statement, else BALANCE_BREAK. A page whose only break spans over 30 days is none."""
    order = in_order()
    known = ledger.where(F.col("bal").isNotNull() & F.col("amt").isNotNull() & F.col("dir").isin("IN", "OUT"))
    near = known.withColumn("pd", F.lag("d").over(order)).withColumn("expected", F.lag("bal").over(order) + signed())
    days = F.coalesce(F.abs(F.datediff("d", "pd")), F.lit(0))
    broken = F.col("expected") != F.col("bal")
    periodic = F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("cp_name")).rlike(PERIODIC)
    crossing = (days >= 20) | (F.date_trunc("month", "pd") != F.date_trunc("month", "d"))
    n = lambda test: F.count(F.when(test, 1))
    breaks = near.groupBy("doc", "acct", "page").agg(n(broken).alias("n"), n(broken & (days > 30)).alias("n_long"), n(broken & F.coalesce(crossing, F.lit(False))).alias("n_cross"), n(broken & periodic).alias("n_periodic"))
    pages = ledger.groupBy("doc", "acct", "page").agg(
        F.count("*").alias("rows"), F.count("d").alias("dated"), F.coalesce(F.datediff(F.max("d"), F.min("d")), F.lit(0)).alias("span"),
        n(periodic).alias("periodic_rows"), F.coalesce(F.bool_or(F.col("bal") < 0), F.lit(False)).alias("overdrawn"),
    )
    both = breaks.where((F.col("n") > 0) & ~((F.col("n") == 1) & (F.col("n_long") == 1))).join(pages, ["doc", "acct", "page"])
    dominant = (F.col("n_periodic") * 2 >= F.col("n")) | (F.col("periodic_rows") * 2 >= F.col("rows"))
    sparse = (F.col("dated") >= 2) & (F.col("span") >= 45) & (F.col("span") >= 10 * F.col("dated"))
    discrete = (F.col("n_long") * 2 >= F.col("n")) | (F.col("n_cross") * 2 >= F.col("n")) | dominant & (sparse | (F.col("n_cross") > 0) | F.col("overdrawn")) | sparse & F.col("overdrawn")
    return both.select("doc", "acct", "page", F.when(discrete, "DISCRETE").otherwise("BALANCE_BREAK").alias("category"), F.when(discrete, "ADVISORY").otherwise("REQUIRED").alias("severity"), F.col("n").alias("n_rows"))


def review_issues(ledger: DataFrame) -> DataFrame:
    """REV01: the issues of all kinds, one a statement, page and category."""
    rows = row_issues(ledger).groupBy("doc", "acct", "page", "category").agg(F.count("*").alias("n_rows"))
    return rows.select("doc", "acct", "page", "category", F.lit("REQUIRED").alias("severity"), "n_rows").unionByName(balance_breaks(ledger))


def review_groups(issues: DataFrame) -> DataFrame:
    """AGG14: issues of one page of a document belong together, whatever their account; those without a page stand alone."""
    key = F.when(F.col("page") > 0, F.concat(F.lit("document:"), "doc", F.lit("|page:"), F.col("page").cast("string"))).otherwise(F.concat("doc", F.lit("|"), "acct", F.lit("|issue:"), "category"))
    return issues.groupBy(key.alias("key")).agg(F.count("*").alias("n_issues"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"), F.sum("n_rows").alias("n_rows"))


def review_labels(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """REV06: the label of each account of a document by its bank and the state of its rows, duplicates aside."""
    done = F.col("status").isin("VERIFIED", "CORRECTED")
    states = ledger.where(F.col("dup_of") == "").groupBy(F.col("doc").alias("source_document_id")).agg(F.count("*").alias("n_rows"), F.bool_and(done).alias("done"), F.bool_or(F.col("status") == "PENDING").alias("open"))
    label = (
        F.when(F.col("n_rows").isNull(), LABELS["empty"]).when((T.text("bank_name") == "") | T.text("bank_name").rlike(UNVERIFIED_BANK), LABELS["bank"])
        .when(F.col("open"), LABELS["open"]).when(F.col("done"), LABELS["done"]).otherwise(LABELS["system"])
    )
    return accounts.join(states, "source_document_id", "left").select("source_document_id", "account_number", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), label.alias("label"))


def blocking_issues(issues: DataFrame, text: str = "message") -> DataFrame:
    """REV04: open, required issues of page integrity that tell of a failed reading."""
    return issues.where((F.col("category") == "PAGE_INTEGRITY") & (F.col("severity") == "REQUIRED") & F.col("status").isin("PENDING", "UNRESOLVED") & F.col(text).rlike(HARD_FAILURE))


def with_saved_decisions(generated: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """JON08: generated issues keep the status and note saved under their key; saved ones that are no longer generated are
    kept while they are open. Repeated saved issues: the last note counts."""
    last = saved.groupBy(*keys).agg(F.max(F.struct("status", "note")).alias("s"))
    joined = generated.select(*keys).distinct().withColumn("now", F.lit(True)).join(last, keys, "full_outer")
    kept = F.coalesce("now", F.lit(False)) | F.col("s.status").isin("PENDING", "UNRESOLVED")
    return joined.where(kept).select(*keys, F.coalesce("s.status", F.lit("PENDING")).alias("status"), F.coalesce("s.note", F.lit("")).alias("note"), F.when(F.col("now"), F.when(F.col("s").isNull(), "NEW").otherwise("KEPT")).otherwise("ORPHAN").alias("origin"))


def with_annotations(matches: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JON06: where a previous match of the key exists, its annotations overwrite, also with empty values."""
    before = previous.select(key, F.lit(True).alias("_had"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = matches.join(before, key, "left")
    return joined.select(*(c for c in matches.columns if c not in columns), *(F.when(F.col("_had"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def decided_rows(rows: DataFrame, original: str, current: str, decision: str) -> DataFrame:
    """REV05: the value, field decision and row status that follow from a decision on one field."""
    o, c, how = T.text(original), T.text(current), F.col(decision)
    changed = (how == "USE_ORIGINAL") & (o != c)
    value = F.when(how == "USE_ORIGINAL", o).otherwise(c)
    status = F.when(how == "UNRESOLVED", "PENDING").when(changed | (o != c), "CORRECTED").otherwise("VERIFIED")
    return rows.withColumn("value", value).withColumn("field_decision", F.when(how == "UNRESOLVED", "UNRESOLVED").otherwise("CONFIRMED")).withColumn("row_status", status)


def count_comparison(message: Column) -> tuple[Column, Column]:
    """REV03: the two numbers of a warning that a page's summary and its rows differ; NULL if it is none."""
    # fixed values: the wordings of such warnings
    patterns = (r"页面汇总为\s*(\d+)\s*笔.*?(?:当前)?逐笔明细(?:实际)?(?:为|仅有)\s*(\d+)\s*笔", r"页面汇总为\s*(\d+)\s*笔.*?自动复核后最多识别\s*(\d+)\s*笔", r"页面计数为\s*(\d+)\s*笔.*?逐笔提取为\s*(\d+)\s*笔", r"独立清点为\s*(\d+)\s*笔.*?逐笔明细为\s*(\d+)\s*笔")
    part = lambda k: F.coalesce(*(F.nullif(F.regexp_extract(message, p, k), F.lit("")) for p in patterns)).cast("int")
    return part(1), part(2)


def page_by_count(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """REV03: the one page of a document with a given number of rows."""
    counts = ledger.where(F.col("page") > 0).groupBy("doc", "page").agg(F.count("*").cast("int").alias("n"))
    once = counts.groupBy("doc", "n").agg(F.min("page").alias("page"), F.count("*").alias("k")).where(F.col("k") == 1).drop("k")
    return wanted.join(once, ["doc", "n"])


def kept_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SET03: rows distinct by key, the last value at the first one's place."""
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"), F.min(F.struct(*order)).alias("_place"))
    return out.select(*key, *(F.col(f"_last.{c}").alias(c) for c in rest if c not in order), *(F.col(f"_place.{c}").alias(c) for c in order))


def in_registry_order(outputs: list[tuple[str, DataFrame]]) -> DataFrame:
    """SET01: the results of several checks one after the other, with the place of their check."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("ordinal"), F.lit(name).alias("name"), "*") for k, (name, df) in enumerate(outputs)))


def counterparty_details(named: DataFrame) -> DataFrame:
    """AGG02: of each counterparty its aliases' number, its first five distinct summaries and whether its first row makes
    a relative likely: the holder's surname in a short name that isn't the holder's, or words of family."""
    place = F.struct("doc", "page", "rowno", "tx_id")
    surname = F.substring(F.trim("holder"), 1, 1)
    alike = (surname != "") & F.col("name").startswith(surname) & (F.length("name") <= 4) & (F.col("name") != F.trim("holder"))
    heads = named.groupBy("cp_key").agg(F.count_distinct("name").alias("n_aliases"), F.min_by(alike | F.col("summary").rlike(FAMILY), place).alias("is_relative"))
    texts = named.where(F.col("summary") != "").groupBy("cp_key", "summary").agg(F.min(place).alias("at"))
    first = texts.withColumn("nth", F.row_number().over(Window.partitionBy("cp_key").orderBy("at"))).where(F.col("nth") <= 5)
    listed = first.groupBy("cp_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "summary"))), lambda x: x["summary"]), "|").alias("summaries"))
    return heads.join(listed, "cp_key", "left").withColumn("summaries", F.coalesce("summaries", F.lit("")))


def numbered(named: DataFrame, value: str) -> DataFrame:
    """AGG02, GRA03: the distinct values of each counterparty as rows, numbered by first appearance."""
    seen = named.groupBy("cp_key", value).agg(F.min(F.struct("doc", "page", "rowno", "tx_id")).alias("at"))
    return seen.select("cp_key", value, F.row_number().over(Window.partitionBy("cp_key").orderBy("at")).alias("nth"))
