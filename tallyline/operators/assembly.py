"""Evidence assembly over the two readings of a page: source registry, row issues, accounting, comparison, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions import text as T

PAGE = ["source_document_id", "page_no"]
ROW = [*PAGE, "row_no"]
#: The codes that keep an assembly from being complete.
STRUCTURAL = ("INVALID_ROW_SOURCE", "INVALID_CELL_SOURCE", "UNASSIGNED_SOURCE_ROW", "SOURCE_ROW_REUSED", "TRANSACTION_IGNORED_CONFLICT", "DUPLICATE_DISPOSITION")
#: What is printed for nothing.
EMPTY = r"(?i)^(?:\s*|[（(]空[）)]|无|--?|—|N/A|null)$"
COMPARED = ("account_number", "transaction_date", "direction", "amount", "balance", "counterparty_account")


def registry(rows: DataFrame) -> DataFrame:
    """SRC11: every cell of a document's tables with its running row and cell number, page by page and row by row. Numbers
    start anew in each document, which no other needs to know of."""
    once = rows.dropDuplicates(ROW).select(*ROW, "cell_values")
    numbered = once.withColumn("row_id", F.row_number().over(Window.partitionBy("source_document_id").orderBy("page_no", "row_no")))
    sizes = F.sum(F.size("cell_values")).over(Window.partitionBy("source_document_id").orderBy("page_no", "row_no").rowsBetween(Window.unboundedPreceding, -1))
    cells = numbered.withColumn("before", F.coalesce(sizes, F.lit(0)))
    return cells.select(*ROW, "row_id", F.posexplode("cell_values").alias("column", "text"), "before").select(*ROW, "row_id", (F.col("before") + F.col("column") + 1).alias("cell_id"), (F.col("column") + 1).alias("column_no"), "text")


def _codes(tests: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests)), lambda x: x.isNotNull())


def row_codes(rows: DataFrame, other: DataFrame) -> DataFrame:
    """ASM02: the issue codes of each assembled row, by its fields and by the other reading of its place."""
    filled = lambda c: ~T.text(c).rlike(EMPTY)
    money = {c: T.money(c) for c in ("amount", "balance")}
    day = T.date_of("transaction_date")
    side = T.direction_of("direction")
    twin = other.select(*ROW, F.col("amount").alias("_amount"), F.col("transaction_date").alias("_day")).dropDuplicates(ROW)
    both = rows.join(twin, ROW, "left")
    tests = [
        ("MISSING_KEY_SOURCE", ~filled("account_number") | ~filled("amount")),
        ("UNREADABLE_SOURCE", filled("amount") & money["amount"].isNull() | filled("balance") & money["balance"].isNull()),
        ("PARTIAL_DATE", filled("transaction_date") & day.isNull()),
        ("DIRECTION_REQUIRES_INDEPENDENT_READ", side == "UNKNOWN"),
        ("COUNTERPARTY_IDENTITY_MISSING", ~filled("counterparty_name") & ~filled("counterparty_account")),
        ("SOURCE_VALUE_CONFLICT", money["amount"] != T.money("_amount")),
        ("TIME_SOURCE_CONFLICT", day != T.date_of("_day")),
    ]
    return both.select(*ROW, F.explode(_codes(tests)).alias("code"))


def row_accounting(source: DataFrame, used: DataFrame, ignored: DataFrame) -> DataFrame:
    """ASM03: source rows that aren't disposed of exactly once: used by no output and not ignored, used by several, ignored
    more than once, or both used and ignored. ``used`` and ``ignored`` hold a source id a use."""
    count = lambda df, n: df.groupBy("source_id").agg(F.count("*").alias(n))
    both = source.select("source_id").distinct().join(count(used, "u"), "source_id", "left").join(count(ignored, "i"), "source_id", "left")
    u, i = F.coalesce("u", F.lit(0)), F.coalesce("i", F.lit(0))
    tests = [("UNASSIGNED_SOURCE_ROW", (u == 0) & (i == 0)), ("SOURCE_ROW_REUSED", u > 1), ("DUPLICATE_DISPOSITION", i > 1), ("TRANSACTION_IGNORED_CONFLICT", (u > 0) & (i > 0))]
    return both.select("source_id", F.explode(_codes(tests)).alias("code"))


def compared_readings(rows: DataFrame, other: DataFrame, pairs: DataFrame, doubts: DataFrame) -> DataFrame:
    """ASM04: ``(rid, code, field_name)`` of the paired rows' differing and doubted fields, of rows without a pair and of the
    other reading's rows that nothing claims. ``pairs`` has left_id and right_id, ``doubts`` right_id and field_name."""
    a = rows.select(F.col("rid").alias("left_id"), *(T.text(c).alias(c) for c in COMPARED))
    b = other.select(F.col("rid").alias("right_id"), *(T.text(c).alias(f"_{c}") for c in COMPARED))
    met = a.join(pairs, "left_id").join(b, "right_id")
    differ = F.filter(F.array(*(F.when(F.col(c) != F.col(f"_{c}"), F.lit(c)) for c in COMPARED)), lambda x: x.isNotNull())
    entry = lambda df, rid, code, field: df.select(F.col(rid).alias("rid"), F.lit(code).alias("code"), field.alias("field_name"))
    conflicts = entry(met.withColumn("f", F.explode(differ)), "left_id", "INDEPENDENT_VALUE_CONFLICT", F.col("f"))
    doubted = entry(pairs.join(doubts.where(F.col("field_name").isin(*COMPARED)).distinct(), "right_id"), "left_id", "INDEPENDENT_SOURCE_UNCERTAIN", F.col("field_name"))
    alone = entry(a.join(pairs, "left_id", "left_anti"), "left_id", "INDEPENDENT_ROW_UNMATCHED", F.lit(""))
    extra = entry(b.join(pairs, "right_id", "left_anti"), "right_id", "INDEPENDENT_EXTRA_OBSERVATION", F.lit(""))
    return conflicts.unionByName(doubted).unionByName(alone).unionByName(extra)


def delivery_status(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """ASM06: INCOMPLETE with any structural code, NEEDS_REVIEW with any other, else READY; and the rows to look at."""
    hard = F.col("code").isin(*STRUCTURAL)
    counted = codes.groupBy("source_document_id").agg(F.bool_or(hard).alias("hard"), F.count("*").alias("n_pending"), F.count_distinct("page_no", "row_no").alias("n_rows"))
    status = F.when(F.col("hard"), "INCOMPLETE").when(F.col("n_pending") > 0, "NEEDS_REVIEW").otherwise("READY")
    return documents.join(counted, "source_document_id", "left").select("source_document_id", F.coalesce(status, F.lit("READY")).alias("status"), F.coalesce("n_pending", F.lit(0)).alias("n_pending"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def as_transactions(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """ASM08: assembled values as typed transactions with the state of their review and the faults of their data."""
    pending = codes.select(*ROW).distinct().withColumn("pending", F.lit(True))
    day, amount, balance, side = T.date_of("transaction_date"), T.money("amount", absolute=True), T.money("balance"), T.direction_of("direction")
    faults = _codes([("INVALID_DATE", day.isNull()), ("INVALID_AMOUNT", amount.isNull()), ("UNKNOWN_DIRECTION", side == "UNKNOWN")])
    return rows.join(pending, ROW, "left").select(
        *ROW, day.alias("d"), side.alias("dir"), F.coalesce(amount, F.lit(0).cast("decimal(18,2)")).alias("amt"), balance.alias("bal"), balance.isNotNull().alias("balance_available"),
        F.when(F.col("pending"), "PENDING").otherwise("AUTO_PASSED").alias("status"), F.array_join(faults, ",").alias("faults"),
    )


def is_valid_quote(quote: str, block: str) -> Column:
    """ASM09: a quote is evidence if it stands, white space aside, in the block it is said to be from."""
    bare = lambda c: F.regexp_replace(T.text(c), rf"[{T.SPACES}]", "")
    return (bare(quote) != "") & bare(block).contains(bare(quote))
