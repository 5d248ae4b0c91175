"""Repairs and doubts that follow from a statement's own arithmetic and order. Every repair is a proposal: rows come out
with the value they had and the value that the evidence supports, and nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.functions import text as T
from tallyline.operators.sequence import STATEMENT, in_order, signed

#: How closely a balance must fit, by purpose.
DIRECTION_TOLERANCE = 0.05
INTEREST = r"结息|利息结算|计息"
CREDIT_CARD = r"透支|年费|自动转[账帐]还款|分期付款|消费转分期|分期利息|分期费用"
#: What names a credit card, and the types of its rows.
CARD_NAMES = r"信用卡|贷记卡|牡丹卡"
CREDIT_TYPES = ("透支利息", "分期", "分期转换", "分期退款", "违约金")
FEE_WAIVER = r"减免|免收|豁免|优惠|抵扣"
INCOME_WORDS, EXPENSE_WORDS = r"收入|转入|存入|工资|结息|退款|入账", r"支出|转出|取|消费|缴费|手续费|还款|扣"


def _known(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("bal").isNotNull() & F.col("amt").isNotNull())


def calibrated_directions(ledger: DataFrame) -> DataFrame:
    """FIX05: rows whose balance is reached in exactly one direction, and not the printed one."""
    before = F.lag("bal").over(in_order())
    fits = lambda sign: F.abs(F.col("before") + sign * F.col("amt") - F.col("bal")) <= DIRECTION_TOLERANCE
    rows = _known(ledger).withColumn("before", before).where(F.col("before").isNotNull()).withColumn("in_fits", fits(1)).withColumn("out_fits", fits(-1))
    proposed = F.when(F.col("in_fits") & ~F.col("out_fits"), "IN").when(F.col("out_fits") & ~F.col("in_fits"), "OUT")
    return rows.withColumn("proposed", proposed).where(F.col("proposed") != F.col("dir")).select("tx_id", "dir", "proposed")


def inferred_directions(ledger: DataFrame) -> DataFrame:
    """FIX10: directions of rows that print none: by the balance within 2 cents or 0.2 %, else by the row's words."""
    before = F.lag("bal").over(in_order())
    moved = F.col("bal") - F.col("before")
    near = F.greatest(F.lit(0.02).cast("decimal(18,6)"), F.col("amt") * F.lit("0.002").cast("decimal(6,4)"))
    words = F.concat_ws(" ", "type", "summary")
    by_balance = F.when(F.abs(moved - F.col("amt")) <= near, "IN").when(F.abs(moved + F.col("amt")) <= near, "OUT")
    by_words = F.when(words.rlike(INCOME_WORDS) & ~words.rlike(EXPENSE_WORDS), "IN").when(words.rlike(EXPENSE_WORDS) & ~words.rlike(INCOME_WORDS), "OUT")
    rows = ledger.withColumn("before", before).where(~F.col("dir").isin("IN", "OUT"))
    return rows.select("tx_id", F.coalesce(by_balance, by_words, F.lit("UNKNOWN")).alias("proposed"))


def printed_dates(ledger: DataFrame) -> DataFrame:
    """FIX02: rows whose raw text prints their month and day under a year two or more away."""
    pattern = r"(20\d{2})-?(\d{2})-?(\d{2})"
    part = lambda k: F.regexp_extract("raw_text", pattern, k)
    printed = F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")
    rows = ledger.where(F.col("d").isNotNull() & F.col("raw_text").rlike(pattern)).withColumn("printed", printed)
    return rows.where((F.month("printed") == F.month("d")) & (F.dayofmonth("printed") == F.dayofmonth("d")) & (F.abs(F.year("printed") - F.year("d")) >= 2)).select("tx_id", "d", "printed")


def physical_direction(ledger: DataFrame) -> DataFrame:
    """SEQ03: 1, -1 or 0 by neighbours' dates with a lead of two at least; pairs two or more years apart don't count."""
    before = F.lag("d").over(in_order())
    pairs = ledger.where(F.col("d").isNotNull()).withColumn("before", before).where(F.abs(F.year("d") - F.year("before")) < 2)
    votes = pairs.groupBy(*STATEMENT).agg(F.sum(F.signum(F.datediff("d", "before"))).cast("int").alias("lead"))
    return votes.withColumn("way", F.when(F.col("lead") >= 2, 1).when(F.col("lead") <= -2, -1).otherwise(0))


def balance_risks(ledger: DataFrame) -> DataFrame:
    """SEQ07: both rows of every break inside one page of a statement, in integer cents."""
    page = Window.partitionBy("doc", "acct", "page").orderBy("rowno", "tx_id")
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    rows = _known(ledger).where(F.col("dir").isin("IN", "OUT")).withColumn("prev", F.lag("tx_id").over(page)).withColumn("before", F.lag("bal").over(page))
    broken = rows.where(F.col("prev").isNotNull() & (cents("before") + (signed() * 100).cast("bigint") != cents("bal")))
    return broken.select(F.explode(F.array("prev", "tx_id")).alias("tx_id")).distinct()


def confirmed_zero_settlements(ledger: DataFrame) -> DataFrame:
    """SEQ08: settlements of nothing that a neighbour's equal balance confirms."""
    order = in_order()
    rows = ledger.where(F.col("bal").isNotNull()).withColumn("a", F.lag("bal").over(order)).withColumn("b", F.lead("bal").over(order))
    same = (F.abs(F.col("a") - F.col("bal")) < 0.005) | (F.abs(F.col("b") - F.col("bal")) < 0.005)
    return rows.where((F.col("amt") == 0) & F.concat_ws(" ", "type", "summary").rlike(INTEREST) & F.coalesce(same, F.lit(False))).select("tx_id")


def shifted_pages(ledger: DataFrame) -> DataFrame:
    """SEQ12: pages on which most balances are zero and most amounts are not: columns that slipped."""
    share = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("int"))
    pages = ledger.groupBy("doc", "page").agg(F.count("*").alias("n"), share(F.coalesce(F.col("bal"), F.lit(0)) == 0).alias("zero"), share(F.col("amt") > 10).alias("large"))
    return pages.where((F.col("n") >= 3) & (F.col("zero") * 10 >= F.col("n") * 8) & (F.col("large") * 10 >= F.col("n") * 8))


def boundary_segments(ledger: DataFrame) -> DataFrame:
    """SEQ13: a settlement whose balance jumps by a thousand or twenty times its amount starts another account's rows."""
    order = Window.partitionBy("doc").orderBy("page", "rowno", "tx_id")
    rows = _known(ledger).withColumn("before", F.lag("bal").over(order))
    jump = F.abs(F.col("bal") - F.col("before")) >= F.greatest(F.lit(1000).cast("decimal(20,2)"), (F.col("amt") * 20).cast("decimal(20,2)"))
    fresh = (F.concat_ws(" ", "type", "summary").rlike(INTEREST) & F.coalesce(jump, F.lit(False))).cast("int")
    return rows.withColumn("fresh", fresh).select("tx_id", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


def page_accounts(ledger: DataFrame) -> DataFrame:
    """ER10: the one reliable account of each page; a page without any takes that of its neighbours where they agree."""
    part = F.when(T.is_reliable("acct"), T.identity_part("acct"))
    pages = ledger.groupBy("doc", "page").agg(F.min(part).alias("least"), F.max(part).alias("most"))
    own = pages.withColumn("own", F.when(F.col("least") == F.col("most"), F.col("least"))).withColumn("none", F.col("least").isNull())
    up, down = (Window.partitionBy("doc").orderBy("page").rowsBetween(*b) for b in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    around = own.withColumn("a", F.last("own", ignorenulls=True).over(up)).withColumn("b", F.first("own", ignorenulls=True).over(down))
    return around.select("doc", "page", F.coalesce("own", F.when(F.col("none") & (F.col("a") == F.col("b")), F.col("a")), F.lit("")).alias("account"))


def one_digit_aliases(accounts: DataFrame, number: str = "account_number") -> DataFrame:
    """JON10: numbers of one length that differ in one place. Each number is known by all that is left when one character is
    taken out: two numbers share that and the place once if they differ there alone, and never otherwise. However many
    numbers begin or end alike, a key holds no more of them than there are characters."""
    numbers = accounts.select(T.identity_part(number).alias("n")).where(F.length("n") >= 12).distinct()
    part = lambda k, *n: F.substr("n", k, *n)
    left = lambda k: F.struct(k.alias("place"), F.concat(part(F.lit(1), k - 1), part(k + 1)).alias("rest"), part(k, F.lit(1)).alias("taken"))
    keyed = numbers.select("n", F.explode(F.sequence(F.lit(1), F.length("n"))).alias("k")).select(left(F.col("k")).alias("x")).select("x.*")
    alike = keyed.groupBy("place", "rest").agg(F.collect_list("taken").alias("taken")).where(F.size("taken") > 1)
    first = alike.select("*", F.explode("taken").alias("a"))
    pairs = first.select("place", "rest", "a", F.explode(F.filter("taken", lambda c: c > F.col("a"))).alias("b"))
    whole = lambda c: F.concat(F.substr("rest", F.lit(1), F.col("place") - 1), F.col(c), F.substr("rest", F.col("place")))
    return pairs.select(whole("a").alias("number_1"), whole("b").alias("number_2"))


def credit_statements(ledger: DataFrame) -> DataFrame:
    """CLS04: statements of credit cards: any row names a credit card, or half the balances are negative and at least two
    rows (or all) are of its types or in its words."""
    named = F.concat_ws(" ", "bank", "summary", "cp_name", "raw_text").rlike(CARD_NAMES)
    worded = F.col("type").isin(*CREDIT_TYPES) | F.concat_ws(" ", "summary", "cp_name", "raw_text").rlike(CREDIT_CARD)
    votes = ledger.groupBy(*STATEMENT).agg(F.count("*").alias("n"), F.count("bal").alias("n_bal"), F.sum((F.col("bal") < 0).cast("int")).alias("negative"), F.sum(worded.cast("int")).alias("worded"), F.bool_or(named).alias("named"))
    by_balance = (F.col("n_bal") > 0) & (F.col("negative") * 2 >= F.col("n_bal")) & (F.col("worded") >= F.least(F.lit(2), F.col("n")))
    return votes.where(F.col("named") | by_balance).select(*STATEMENT, "n", "worded", "named")


def fee_waivers() -> Column:
    """CLS05."""
    return F.concat_ws(" ", "type", "summary").rlike(FEE_WAIVER)


def dominant(rows: DataFrame, keys: list[str], value: str, confidence: str, least: float = 0.45) -> DataFrame:
    """AGG12, AGG13: the value of the greatest weight of each group; a row weighs its confidence, a quarter at least."""
    sure = rows.where((F.col(value) != "") & (F.coalesce(F.col(confidence), F.lit(0.0)) >= least))
    weight = F.greatest(F.lit(0.25), F.col(confidence)).cast("decimal(12,6)")
    summed = sure.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    return summed.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("w"), F.col(value))).alias("dominant"))


def paired_by_occurrence(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """ASM07: equal contents paired in order of occurrence, the first with the first and so on."""
    nth = lambda df, i: df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(i))).select(*keys, "nth", i)
    return nth(left, left_id).join(nth(right, right_id), [*keys, "nth"]).select(left_id, right_id)


def recovery_pages(issues: DataFrame, k: int = 6) -> DataFrame:
    """TOP06: of each document the k pages with the most doubtful rows; the rest is deferred, not dropped."""
    pages = issues.groupBy("doc", "page").agg(F.sum("n_rows").alias("n_rows"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n_rows"), "page"))
    return pages.withColumn("plan", F.when(rank <= k, "READ_AGAIN").otherwise("DEFERRED"))


def field_accuracy(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """EVA01, JON18: by source position, with positions that aren't unique left out; per field the rows compared and equal."""
    once = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*fields)).alias("row")).where(F.col("n") == 1).drop("n")
    both = once(left).withColumnRenamed("row", "a").join(once(right).withColumnRenamed("row", "b"), keys)
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col("a")[f].eqNullSafe(F.col("b")[f]).cast("int").alias("same")) for f in fields))
    return both.select(F.explode(cells).alias("c")).groupBy("c.field_name").agg(F.count("*").alias("n_compared"), F.sum("c.same").alias("n_equal"))


def confusions(left: DataFrame, right: DataFrame, keys: list[str], field: str, k: int = 20) -> DataFrame:
    """EVA12: the most frequent pairs of differing values of a field, over rows matched by position."""
    once = lambda df, n: df.groupBy(*keys).agg(F.min(F.coalesce(F.col(field), F.lit(""))).alias(n))
    pairs = once(left, "expected").join(once(right, "actual"), keys).where(F.col("expected") != F.col("actual"))
    return pairs.groupBy("expected", "actual").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "actual").limit(k)


def outlier_years(ledger: DataFrame, least: int = 5, spread: int = 3, beyond: int = 2) -> DataFrame:
    """FIX03: days whose year lies more than two years outside those of all other rows of their statement, which span three
    at most, with the year within that span that is nearest to their neighbours' days. Least, second least, greatest and
    second greatest years tell every row the span of the others, so the statement is read once and nothing is gathered."""
    part, order = Window.partitionBy(*STATEMENT), in_order()
    year = F.year("d")
    rows = ledger.where(F.col("d").isNotNull()).select(*STATEMENT, *("page", "rowno", "tx_id"), "d", year.alias("y"), F.lag("d").over(order).alias("before"), F.lead("d").over(order).alias("after"))
    years = rows.groupBy(*STATEMENT, "y").agg(F.count("*").alias("k"))
    rank = lambda o: F.row_number().over(part.orderBy(o))
    ranked = years.withColumn("up", rank(F.col("y"))).withColumn("down", rank(F.desc("y")))
    at = lambda c, k: F.max(F.when(F.col(c) == k, F.col("y")))
    ends = ranked.groupBy(*STATEMENT).agg(at("up", 1).alias("y1"), at("up", 2).alias("y2"), at("down", 1).alias("z1"), at("down", 2).alias("z2"), F.max(F.when(F.col("up") == 1, F.col("k"))).alias("k1"), F.max(F.when(F.col("down") == 1, F.col("k"))).alias("j1"), F.sum("k").alias("n"))
    both = rows.join(ends.where(F.col("n") >= least), STATEMENT)
    low = F.when((F.col("y") == F.col("y1")) & (F.col("k1") == 1), F.col("y2")).otherwise(F.col("y1"))
    high = F.when((F.col("y") == F.col("z1")) & (F.col("j1") == 1), F.col("z2")).otherwise(F.col("z1"))
    odd = both.withColumn("low", low).withColumn("high", high).where((F.col("high") - F.col("low") <= spread) & ~F.col("y").between(F.col("low") - beyond, F.col("high") + beyond))
    day = lambda y: F.concat_ws("-", y.cast("string"), F.month("d").cast("string"), F.dayofmonth("d").cast("string")).try_cast("date")
    inside = lambda c: F.when(F.year(c).between(F.col("low"), F.col("high")), F.col(c))
    gap = lambda y: F.coalesce(F.abs(F.datediff(day(y), inside("before"))), F.lit(0)) + F.coalesce(F.abs(F.datediff(day(y), inside("after"))), F.lit(0))
    tried = F.filter(F.transform(F.sequence(F.col("low"), F.col("high")), lambda y: F.struct(gap(y).alias("gap"), y.alias("y"), day(y).alias("d"))), lambda x: x["d"].isNotNull())
    return odd.select("tx_id", "d", F.array_min(tried)["d"].alias("proposed"))


def recorded_corrections(versions: DataFrame, key: str, field: str, version: str) -> DataFrame:
    """FIX09: the first value of a field, the current one and whether it was corrected, however many versions lie between."""
    at = lambda f: f(T.text(field), F.col(version))
    out = versions.groupBy(key).agg(at(F.min_by).alias("original"), at(F.max_by).alias("current"), F.count_distinct(version).alias("n_versions"))
    return out.withColumn("corrected", F.col("original") != F.col("current"))
