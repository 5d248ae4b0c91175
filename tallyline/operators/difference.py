"""The differences between two copies of one table.

Rows are normalised (one canonical string a field) and EXCEPT ALL is taken in both directions. Either direction is, as
the optimizer rewrites it, a count of each row's occurrences in both copies; both need the same counts, so the copies are
united and counted once, and one exchange serves both: a row that the left copy holds n times more often is n times in
the left residue. The residues are then joined in full by key: a key in both has different values, which are listed field
by field; a key in one residue alone is a row that only this copy holds, or, where the copies hold other rows of the key
in common, a surplus (an extra version or repetition), which is listed where ``extras`` are asked for.

Where several rows of a key are left over on both sides, they meet one for one in the order of their values, so a key
with many versions never pairs all with all. Counting combines on the map side; a row repeated without end is one row a
partition.

Defined results: NULL equals ``''``; spaces around a value don't count; NULL keys equal each other; two empty tables
give no row, one empty table makes every key one-sided; repeated rows count once, and with ``extras`` a row that both
copies hold, but one more often, is a ``LEFT_EXTRA`` or ``RIGHT_EXTRA``, as is a version beyond those of the other side;
every difference is listed once a key; missing array elements are NULL; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEFT_ONLY, RIGHT_ONLY, VALUE = "LEFT_ONLY", "RIGHT_ONLY", "VALUE"
LEFT_EXTRA, RIGHT_EXTRA = "LEFT_EXTRA", "RIGHT_EXTRA"


def occurrences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``(k, row, n_left, n_right)``: how often either copy holds each row. ``left EXCEPT ALL right`` is every row
    ``n_left - n_right`` times where that is positive, the other direction the reverse."""
    side = lambda df, l, r: df.select(F.struct(*keys).alias("k"), F.struct(*fields).alias("row"), F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
    both = side(left, 1, 0).unionByName(side(right, 0, 1))
    return both.groupBy("k", "row").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def residue(counted: DataFrame, more: str, less: str, name: str) -> DataFrame:
    """``more EXCEPT ALL less`` as ``(k, nth, row, surplus)``, repetitions of a row as their number; rows of a key are numbered by their values."""
    nth = F.row_number().over(Window.partitionBy("k").orderBy("row"))
    return counted.where(F.col(more) > F.col(less)).select("k", nth.alias("nth"), F.col("row").alias(name), (F.col(more) - F.col(less)).alias(f"{name}_surplus"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], extras: bool = False) -> DataFrame:
    """``(*keys, diff_kind, field_name)`` of two copies whose columns are ``keys`` and canonical ``fields``."""
    counted = occurrences(left, right, keys, fields)
    a, b = residue(counted, "n_left", "n_right", "a"), residue(counted, "n_right", "n_left", "b")
    # struct keys compare NULL members as equal
    joined = a.join(b, ["k", "nth"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = F.array(*(F.when(~F.col("a")[f].eqNullSafe(F.col("b")[f]), F.lit(f)) for f in fields))
    sided = F.when(both, F.lit(None).cast("string")).when(F.col("a").isNotNull(), "LEFT").otherwise("RIGHT")
    # one row a key: the fields that differ, and the sides that hold more
    by_key = joined.groupBy("k").agg(
        F.array_distinct(F.flatten(F.collect_set(F.when(both, F.filter(changed, lambda x: x.isNotNull()))))).alias("fields"),
        F.bool_or(sided == "LEFT").alias("more_left"), F.bool_or(sided == "RIGHT").alias("more_right"), F.bool_or(both).alias("met"),
    )
    shared = counted.where((F.col("n_left") > 0) & (F.col("n_right") > 0)).groupBy("k").agg(F.lit(True).alias("shared"))
    found = by_key.join(shared, "k", "left").withColumn("held", F.col("met") | F.coalesce("shared", F.lit(False)))
    entry = lambda kind, field: F.struct(F.lit(kind).alias("diff_kind"), field.alias("field_name"))
    one = lambda test, held, alone: F.when(F.coalesce(test, F.lit(False)), F.when(F.col("held"), entry(held, F.lit(""))).otherwise(entry(alone, F.lit(""))))
    kinds = F.concat(F.transform("fields", lambda f: entry(VALUE, f)), F.array(one(F.col("more_left"), LEFT_EXTRA, LEFT_ONLY), one(F.col("more_right"), RIGHT_EXTRA, RIGHT_ONLY)))
    kept = F.filter(kinds, lambda x: x.isNotNull() & (F.lit(extras) | ~x["diff_kind"].isin(LEFT_EXTRA, RIGHT_EXTRA)))
    listed = found.select("k", F.explode(kept).alias("d"))
    return listed.select(*(F.col(f"k.{k}").alias(k) for k in keys), "d.diff_kind", "d.field_name")


def pair_set(issues: Column, *names: str) -> Column:
    """The set of the named members' pairs of an array of structs, as one string; NULL and empty are the same."""
    pairs = F.transform(issues, lambda x: F.concat_ws("\u001f", *(F.trim(F.coalesce(x[n], F.lit(""))) for n in names)))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(pairs)), "\u001e"), F.lit(""))
