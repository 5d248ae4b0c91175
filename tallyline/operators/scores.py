"""Scores of delivered rows against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import text as T

CRITICAL = ("account_number", "transaction_date", "direction", "amount", "balance", "counterparty_account")
#: The gates of acceptance.
LEAST_ACCURACY, MOST_REVIEW = 0.995, 0.05
#: The weights by which rows of the two sides are paired.
WEIGHTS = {"account_number": 3, "transaction_date": 2, "direction": 1, "amount": 3, "balance": 3, "counterparty_account": 2}


def truth_type(c: Column) -> Column:
    """EVA03: purchases and bills are one type to the score."""
    return F.when(c.isin("消费", "缴费"), "消费").otherwise(c)


def row_results(expected: DataFrame, actual: DataFrame, alerts: DataFrame, keys: list[str], fields: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Each expected or delivered place with its state and, for both, the differing fields that no alert covers."""
    once = lambda df, n: df.groupBy(*keys).agg(F.min(F.struct(*(T.text(f).alias(f) for f in fields))).alias(n))
    marked = alerts.groupBy(*keys).agg(F.collect_set("field_name").alias("alerted"))
    both = once(expected, "e").join(once(actual, "a"), keys, "full_outer").join(marked, keys, "left")
    wrong = F.filter(F.array(*(F.when(F.col("e")[f] != F.col("a")[f], F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    state = F.when(F.col("a").isNull(), "MISSING").when(F.col("e").isNull(), "EXTRA").when(F.size(wrong) == 0, "CORRECT").otherwise("WRONG")
    known = F.coalesce("alerted", F.array().cast("array<string>"))
    return both.select(*keys, state.alias("state"), F.when(state.isin("WRONG"), wrong).otherwise(F.array().cast("array<string>")).alias("wrong"), known.alias("alerted"))


def acceptance(results: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """EVA02: accuracy over the larger of expected and delivered rows, share of rows to review, errors without an alert on
    their field, and whether the gates are met; EVA15 by group."""
    n = lambda test: F.count(F.when(test, 1))
    state = F.col("state")
    unseen = F.size(F.array_except("wrong", "alerted")) + state.isin("MISSING", "EXTRA").cast("int")
    out = results.groupBy(*(groups or [])).agg(
        n(state != "EXTRA").alias("n_expected"), n(state != "MISSING").alias("n_delivered"), n(state == "CORRECT").alias("n_correct"),
        n((F.size("alerted") > 0) & (state != "MISSING")).alias("n_review"), F.coalesce(F.sum(F.size("wrong") + state.isin("MISSING", "EXTRA").cast("int")), F.lit(0)).cast("bigint").alias("n_errors"), F.coalesce(F.sum(unseen), F.lit(0)).cast("bigint").alias("n_unalerted"),
    )
    share = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    out = out.withColumn("accuracy", share(F.col("n_correct"), F.greatest("n_expected", "n_delivered"))).withColumn("review_rate", share(F.col("n_review"), F.col("n_expected")))
    return out.withColumn("meets", F.coalesce((F.col("accuracy") >= LEAST_ACCURACY) & (F.col("review_rate") <= MOST_REVIEW) & (F.col("n_unalerted") == 0), F.lit(False)))


def detection(results: DataFrame) -> DataFrame:
    """EVA05: by field, how many wrong values were alerted (recall), how many alerts were right (precision) and the load."""
    wrong = results.select(F.explode("wrong").alias("field_name"), F.lit(1).alias("w"), F.lit(0).alias("a"), F.lit(0).alias("both"))
    hits = results.select(F.explode(F.array_intersect("wrong", "alerted")).alias("field_name"), F.lit(0).alias("w"), F.lit(0).alias("a"), F.lit(1).alias("both"))
    alerts = results.where(F.col("state") != "MISSING").select(F.explode("alerted").alias("field_name"), F.lit(0).alias("w"), F.lit(1).alias("a"), F.lit(0).alias("both"))
    summed = wrong.unionByName(alerts).unionByName(hits).groupBy("field_name").agg(F.sum("w").alias("n_wrong"), F.sum("a").alias("n_alerts"), F.sum("both").alias("n_found"))
    rate = lambda c: F.when(F.col(c) > 0, F.round(F.col("n_found") / F.col(c), 6))
    return summed.withColumn("recall", rate("n_wrong")).withColumn("precision", rate("n_alerts"))


def evidence_presence(expected: DataFrame, evidence: DataFrame, keys: list[str], page: list[str], fields: tuple[str, ...]) -> DataFrame:
    """EVA06: by field, the share of expected values that stand anywhere among the other side's values of their page."""
    cells = lambda df, cols: df.select(*cols, F.explode(F.array(*(F.struct(F.lit(f).alias("f"), T.text(f).alias("v")) for f in fields))).alias("c")).where(F.col("c.v") != "")
    seen = cells(evidence, page).select(*page, F.col("c.v").alias("v")).distinct().withColumn("seen", F.lit(1))
    wanted = cells(expected.dropDuplicates(keys), keys).select(*page, F.col("c.f").alias("field_name"), F.col("c.v").alias("v"))
    return wanted.join(seen, [*page, "v"], "left").groupBy("field_name").agg(F.count("*").alias("n_values"), F.count("seen").alias("n_present"), F.round(F.count("seen") / F.count("*"), 6).alias("rate"))


def party_rates(expected: DataFrame, actual: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """EVA07: by flow group, how many counterparty accounts and names are delivered exactly."""
    once = lambda df, p: df.groupBy(*keys).agg(*(F.min(T.text(c)).alias(f"{p}{c}") for c in ("counterparty_account", "counterparty_name", "direction")))
    both = once(expected, "e_").join(once(actual, "a_"), keys, "left").withColumn("flow_group", group)
    same = lambda c: F.sum(((F.col(f"e_{c}") != "") & (F.col(f"e_{c}") == F.coalesce(f"a_{c}", F.lit("")))).cast("int"))
    there = lambda c: F.count(F.when(F.col(f"e_{c}") != "", 1))
    return both.groupBy("flow_group").agg(F.count("*").alias("n_rows"), there("counterparty_account").alias("n_accounts"), same("counterparty_account").alias("right_accounts"), there("counterparty_name").alias("n_names"), same("counterparty_name").alias("right_names"))


def row_checks(ledger: DataFrame, types: DataFrame) -> DataFrame:
    """EVA14: ``(tx_id, fault)``: rows without a place, two rows in one place, absent days or amounts, types outside the list,
    rows without a counterparty, and balances that don't follow from the row before, in cents."""
    from tallyline.operators.sequence import in_order, signed

    listed = types.select(F.col("type_name").alias("type"), F.lit(True).alias("listed")).distinct()
    place = ledger.groupBy("doc", "page", "rowno").agg(F.count("*").alias("in_place"))
    chain = ledger.withColumn("expected", F.lag("bal").over(in_order()) + signed())
    rows = chain.join(listed, "type", "left").join(place, ["doc", "page", "rowno"])
    tests = [
        ("NO_PLACE", (F.col("page") <= 0) | (F.col("rowno") <= 0)), ("DUPLICATE_PLACE", F.col("in_place") > 1), ("NO_DAY", F.col("d").isNull()), ("NO_AMOUNT", F.col("amt").isNull()),
        ("UNKNOWN_TYPE", (F.col("type") != "") & F.col("listed").isNull()), ("NO_PARTY", (F.col("cp_name") == "") & (F.col("cp_acct") == "")), ("BALANCE_CHAIN", F.col("expected") != F.col("bal")),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests)), lambda x: x.isNotNull())
    return rows.select("tx_id", F.explode(found).alias("fault"))


def best_reading(sides: dict[str, DataFrame], page: list[str], expected: DataFrame) -> DataFrame:
    """TOP09: of several readings of a page the complete one, else the one nearest to the expected number of rows, then with
    more rows, then of the name that comes first."""
    out = None
    for name, df in sides.items():
        one = df.groupBy(*page).agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
        out = one if out is None else out.unionByName(one)
    gap = F.abs(F.col("n") - F.col("n_expected"))
    rank = F.struct((gap != 0).cast("int"), gap, -F.col("n"), F.col("side"))
    return out.join(expected, page).groupBy(*page).agg(F.min_by("side", rank).alias("chosen"), F.min_by("n", rank).alias("n_rows"))
