"""Text that looks the same brought to one form, code point by code point.

Values that can't hold anything but plain characters pass a cheap character-class test and are left alone; that test is
exact, not a sample. The others are exploded to positioned code points. Two small tables derived from the Unicode
database are broadcast to them: what each code point decomposes to or looks like in its context, with combining classes,
and which base-and-marks sequences compose. Marks are put in canonical order, sequences recomposed and strings rebuilt.
Every step after the first shuffle is keyed by the same columns, so there is one exchange in all, over the rows that
need work only, each value its own group: no key gathers more than the code points of one value.

The tables are bounded by the Unicode database (about 11,000 code points), never by the data.

Contexts: ``amount`` and ``account_number`` hold digits, so O and l look-alikes are 0 and 1 there (and X look-alikes the
mask X); in names a letter of another script is replaced only inside a word, or a value, that otherwise is Latin, or the
reverse where the word holds letters that exist in the other script alone.

Defined results: NULL and ``''`` are absent and give no row; a value of invisible characters only has the form ``''``; a
repeated row gives one row; conjoining Hangul jamo stay as they are; a character with no plain counterpart stays and the
value counts as not plain; extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters of other scripts and the Latin letters they look like.
LATIN_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХҮԚԜаеѕіјорсухһԁԛԝոѵ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυχκϲϳ",
        "ABESIJKMHOPCTXYQWaesijopcyxhdqwnv" + "ABEZHIKMNOPTYXoviapuxkcj",
        strict=True,
    )
)
#: Characters taken for digits or masks in numbers.
DIGIT_LOOKALIKES = {**dict.fromkeys("OoОоΟοՕօ", "0"), **dict.fromkeys("lIіІιΙ|ӏӀ", "1"), **dict.fromkeys("xХхΧχ×", "X"), "∗": "*", "•": "*"}
#: Simplified radicals that have no compatibility mapping, and the ideographs they look like.
RADICALS = dict(zip("⺠⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳", "民西见角贝车长门青韦页风飞食马骨鬼鱼鸟卤麦黄齐齿龙龟", strict=True))
#: Dots, dashes and quotes with a plain counterpart.
MARKS = {
    **dict.fromkeys("∙•・･‧⋅·●", "·"),
    **dict.fromkeys("−‐‑‒–—―﹣－", "-"),
    **dict.fromkeys("’‘′＇`´", "'"),
    **dict.fromkeys("“”″＂", '"'),
}
_SKIPPED = set("͏ᅟᅠ឴឵᠎ㅤﾠ") | {chr(c) for c in range(0xFE00, 0xFE10)}

NUMERIC, TEXT, TO_LATIN, FROM_LATIN = "numeric", "text", "to_latin", "from_latin"
_LOOKALIKE_CLASS = "".join(sorted(LATIN_LOOKALIKES))
_REVERSED = {latin: other for other, latin in reversed(LATIN_LOOKALIKES.items()) if "Ѐ" <= other <= "ӿ"}

PLAIN_FIELDS = {
    "amount": r"^[0-9,.\-¥]*$",
    "account_number": r"^[0-9*X]+( [0-9*X]+)*$",
    "counterparty_name": r"^[!-~·㐀-䶿一-鿿]+( [!-~·㐀-䶿一-鿿]+)*$",
}


def _plain_form(ch: str) -> str:
    """The compatibility decomposition of one code point with look-alike punctuation and radicals replaced, invisible ones removed."""
    if ch in RADICALS:
        return RADICALS[ch]
    if ch in MARKS:
        return MARKS[ch]
    category = unicodedata.category(ch)
    if category == "Cf" or ch in _SKIPPED or category == "Cc" and ch not in "\t\n\r":
        return ""
    if category.startswith("Z") or ch in "\t\n\r":
        return " "
    out = unicodedata.normalize("NFKD", ch)
    return "".join(MARKS.get(c, " " if unicodedata.category(c).startswith("Z") else c) for c in out)


@cache
def mapping_rows() -> list[tuple]:
    """One row for each code point that isn't its own plain form, looks like another one or is a combining mark:
    ``(cp, pieces)`` and, where a context changes them, the pieces in that context. A piece is ``(place, class, out)``."""
    special = {NUMERIC: DIGIT_LOOKALIKES, TO_LATIN: LATIN_LOOKALIKES, FROM_LATIN: _REVERSED}
    looked_at = {cp for own in special.values() for cp in own}
    rows = []
    for code in range(0x20, sys.maxunicode + 1):
        ch = chr(code)
        # the mapping of the rest is known without asking: ideographs, Hangul syllables and unassigned planes are plain
        if 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3 or 0x20000 <= code < 0x2F800 or 0x30000 <= code < 0xE0000 or code >= 0xE0200:
            continue
        text = _plain_form(ch)
        if text == ch and not unicodedata.combining(ch) and ch not in looked_at:
            continue
        pieces = [(k, unicodedata.combining(c), c) for k, c in enumerate(text)] or [(0, 0, "")]
        in_context = []
        for own in special.values():
            changed = [(0, 0, own[ch])] if ch in own else [(k, ccc, own.get(c, c)) for k, ccc, c in pieces]
            in_context.append(changed if changed != pieces else None)
        rows.append((ch, pieces, *in_context))
    return rows


@cache
def composition_pairs() -> dict[str, str]:
    """``{starter and mark: composed character}`` of every canonical composition but Hangul's."""
    pairs = {}
    for code in range(0xA0, sys.maxunicode + 1):
        ch = chr(code)
        if not 0xAC00 <= code <= 0xD7A3 and unicodedata.decomposition(ch) and not unicodedata.decomposition(ch).startswith("<"):
            apart = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(ch).split())
            if len(apart) == 2 and unicodedata.normalize("NFC", apart) == ch:
                pairs[apart] = ch
    return pairs


def composed(parts: Column) -> Column:
    """A starter and its marks in canonical order, composed: each mark joins the starter if the pair composes and no mark
    of its class was left standing before it."""
    pairs = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in composition_pairs().items())), F.lit("\x01"), F.lit("\x02"))

    def take(s: Column, x: Column) -> Column:
        pair = F.try_element_at(pairs, F.concat(s["base"], x["out"]))
        joined = F.struct(pair.alias("base"), s["left"].alias("left"), s["last"].alias("last"))
        kept = F.struct(s["base"].alias("base"), F.concat(s["left"], x["out"]).alias("left"), x["ccc"].alias("last"))
        return F.when(pair.isNotNull() & (s["last"] != x["ccc"]), joined).otherwise(kept)

    start = F.struct(F.coalesce(F.get(parts, F.lit(0))["out"], F.lit("")).alias("base"), F.lit("").alias("left"), F.lit(-1).alias("last"))
    whole = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, take, lambda s: F.concat(s["base"], s["left"]))
    return F.when(F.size(parts) <= 1, start["base"]).otherwise(whole)


def _tables(spark) -> DataFrame:
    pieces = "array<struct<place: int, ccc: int, out: string>>"
    return spark.createDataFrame(mapping_rows(), f"cp string, pieces {pieces}, {NUMERIC} {pieces}, {TO_LATIN} {pieces}, {FROM_LATIN} {pieces}")


def _context(numeric: Column, word: Column, value: Column) -> Column:
    latin, other = word.rlike(r"\p{IsLatin}"), word.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")
    own = rf"[\p{{IsCyrillic}}\p{{IsGreek}}&&[^{_LOOKALIKE_CLASS}]]"
    latin_only = rf"[\p{{IsLatin}}&&[^{''.join(_REVERSED)}]]"
    return (
        F.when(numeric, NUMERIC)
        .when(other & latin & word.rlike(own) & ~word.rlike(latin_only), FROM_LATIN)
        .when(other & latin, TO_LATIN)
        .when(other & value.rlike(r"\p{IsLatin}") & ~value.rlike(own), TO_LATIN)
        .otherwise(TEXT)
    )


def suspicious(df: DataFrame, key: str, fields: dict[str, str] = PLAIN_FIELDS) -> DataFrame:
    """``(key, field_name, value)``, once each, for the non-empty values that aren't made of each field's plain characters alone."""
    spread = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.when(~F.col(c).cast("string").rlike(p), F.col(c).cast("string")).alias("value")) for c, p in fields.items())))
    return df.select(F.col(key), spread.alias("v")).where(F.coalesce(F.col("v.value"), F.lit("")) != "").select(key, "v.field_name", "v.value").dropDuplicates()


def canonical_text(values: DataFrame, key: str, numeric_fields: tuple[str, ...] = ("amount", "account_number")) -> DataFrame:
    """``(key, field_name, value)`` rows with their ``canonical`` form and ``is_plain``.

    ``values`` must have no repeated rows, as ``suspicious`` gives them.
    """
    mapping = _tables(values.sparkSession)
    ids = [key, "field_name", "value"]
    numeric = F.col("field_name").isin(*numeric_fields)
    words = F.regexp_extract_all("value", F.lit(r"[\p{L}\p{M}\p{Cf}᠎]+|[^\p{L}\p{M}\p{Cf}᠎]+"), F.lit(0))
    points = (
        values.select(*ids, F.posexplode(words).alias("w", "word"))
        .select(*ids, "w", _context(numeric, F.col("word"), F.col("value")).alias("context"), F.posexplode(F.split("word", "")).alias("p", "cp"))
        .join(F.broadcast(mapping), "cp", "left")
        .withColumn("chosen", F.coalesce(*(F.when(F.col("context") == c, F.col(c)) for c in (NUMERIC, TO_LATIN, FROM_LATIN)), "pieces"))
        .select(*ids, "w", "p", F.explode(F.coalesce("chosen", F.array(F.struct(F.lit(0).alias("place"), F.lit(0).alias("ccc"), F.col("cp").alias("out"))))).alias("piece"))
        .select(*ids, F.struct("w", "p", "piece.place").alias("pos"), "piece.ccc", "piece.out")
    )
    # an invisible point starts nothing and adds nothing; those before the first visible one form a sequence of their own,
    # so that a value of invisible characters only keeps its row
    before = Window.partitionBy(*ids).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    started = points.withColumn("start", F.last(F.when((F.col("ccc") == 0) & (F.col("out") != ""), F.col("pos")), ignorenulls=True).over(before))
    sequences = started.groupBy(*ids, "start").agg(F.filter(F.sort_array(F.collect_list(F.struct("ccc", "pos", "out"))), lambda x: x["out"] != "").alias("parts"))
    texts = sequences.select(*ids, "start", composed(F.col("parts")).alias("text"))
    rebuilt = texts.groupBy(*ids).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    canonical = rebuilt.withColumn("canonical", F.trim(F.regexp_replace("text", " +", " ")))
    tidy = F.when(F.col("field_name") == "amount", F.regexp_replace("canonical", " ", "")).otherwise(F.col("canonical"))
    canonical = canonical.withColumn("canonical", tidy)
    odd = F.col("value").rlike(r"[^\p{L}\p{M}\x20-\x7e¥·]") | (numeric & F.col("value").rlike(r"[^0-9,.\-¥*X ]")) | ((F.col("field_name") == "amount") & F.col("value").contains(" "))
    return canonical.select(*ids, "canonical", ((F.col("canonical") == F.col("value")) & ~odd).alias("is_plain"))


def normalise_lookalikes(df: DataFrame, key: str, fields: dict[str, str] = PLAIN_FIELDS) -> DataFrame:
    """Every value of ``fields`` that isn't in plain characters, with its plain form: ``(key, field_name, value, canonical)``."""
    return canonical_text(suspicious(df, key, fields), key).where(~F.col("is_plain")).drop("is_plain")
