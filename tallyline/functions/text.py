"""Identity keys, text normalisation and printed-value readers as column expressions.

NULL text is ``''`` throughout; a value that can't be read is NULL, an explicit empty one ``''`` (money) or NULL (dates).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser sees it, then the separators of account numbers and names.
SPACES = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SEPARATORS = rf"[{SPACES}\-_—–·•]"
#: Words that stand where an account number is missing.
PLACEHOLDER = r"待核对|未识别|未知|UNKNOWN|unknown|无账号"
#: Letters and dashes that recognition puts for the digits and the sign of an amount.
DIGIT_LOOKALIKES = {**dict.fromkeys("OoОоΟοՕօ", "0"), **dict.fromkeys("lIіІιΙ|ӏӀ", "1"), **dict.fromkeys("−‐‑‒–—―﹣－", "-")}


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def identity_part(c: Column | str) -> Column:
    """STR01: without spaces and separators, lower case."""
    return F.lower(F.regexp_replace(text(c), SEPARATORS, ""))


def is_reliable(c: Column | str) -> Column:
    """At least eight characters, no national identity number, no placeholder."""
    part = identity_part(c)
    return (F.length(part) >= 8) & ~part.rlike(r"^\d{17}[\dx]$") & ~text(c).rlike(PLACEHOLDER)


def plain_text(c: Column | str) -> Column:
    """STR02: without spaces and punctuation of either width, lower case."""
    return F.lower(F.regexp_replace(text(c), rf"[{SPACES}\-_—–·•,，。.、:：;；/\\()（）]", ""))


def person_name(c: Column | str) -> Column:
    """STR04: without spaces and dots, lower case."""
    return F.lower(F.regexp_replace(text(c), rf"[{SPACES}·•]", ""))


def semantic_text(c: Column | str) -> Column:
    """STR05: without white space and without a literal backslash-n."""
    return F.regexp_replace(F.regexp_replace(text(c), r"\\n", ""), rf"[{SPACES}]", "")


def holder_name(c: Column | str, default: str = "") -> Column:
    """STR06: a holder's name out of a file name, without extension and statement suffix."""
    bare = F.regexp_replace(F.regexp_replace(text(c), r"(?i)\.(pdf|xlsx?|csv)$", ""), r"(银行)?(交易)?流水.*$", "")
    return F.when(F.trim(bare) == "", default).otherwise(F.trim(bare))


def texts_compatible(a: Column, b: Column) -> Column:
    """ER03: equal, or one of at least four characters contained in the other; both must be there."""
    return (a != "") & (b != "") & ((a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (a.contains(b) | b.contains(a))))


def digit_variant(a: Column, b: Column) -> Column:
    """FIX07: equal length, at most one character different."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return (F.length(a) == F.length(b)) & (F.aggregate(pairs, F.lit(0), lambda n, x: n + x) <= 1)


def account_key(account: str, document: str, bank: str, file: str) -> Column:
    """The key of an account within its source."""
    part = identity_part(account)
    reliable = F.when(text(document) != "", F.concat(F.lit("source-account|"), text(document), F.lit("|"), part)).otherwise(F.concat(F.lit("account|"), part))
    return F.when(is_reliable(account), reliable).otherwise(F.concat_ws("|", F.lit("unverified"), identity_part(bank), part, text(file)))


def master_account_key(account: str, document: str, bank: str, file: str) -> Column:
    """The key of an account across the documents of a case."""
    return F.when(is_reliable(account), F.concat(F.lit("account|"), identity_part(account))).otherwise(F.concat(F.lit("unverified|"), account_key(account, document, bank, file)))


def counterparty_key(account: str, name: str, bank: str, source: str, row: str) -> Column:
    """ER15: a numeric account, any other account with its bank and name, the name, or the row itself."""
    part = identity_part(account)
    numeric = part.rlike(r"^\d{12,32}$") & ~part.rlike("^0+$")
    named = F.trim(text(name))
    return (
        F.when(numeric, F.concat(F.lit("account:"), part))
        .when(part != "", F.concat_ws("|", F.lit("other"), part, identity_part(bank), person_name(name)))
        .when(named != "", F.concat(F.lit("name:"), person_name(name)))
        .otherwise(F.concat_ws(":", F.lit("unknown"), text(source), text(row)))
    )


def money(c: Column | str, absolute: bool = False) -> Column:
    """NUM01: an exact amount from print; ``''`` and dashes are absent (NULL), wrong groups and more than two decimals too."""
    bare = F.regexp_replace(text(c), rf"[{SPACES}¥￥]|元$", "")
    grouped = bare.rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d{1,15})(\.\d{1,2})?$")
    value = F.when(grouped, F.regexp_replace(bare, ",", "")).try_cast("decimal(18,2)")
    return F.abs(value) if absolute else value


@cache
def _amount_characters() -> dict[str, str]:
    """The code points that stand for plain characters of an amount, invisible ones for none."""
    forms = dict(DIGIT_LOOKALIKES)
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) == "Cf":
            forms[ch] = ""
        elif ch not in forms and ch != "¥" and (form := unicodedata.normalize("NFKC", ch)) != ch and all(x in "0123456789.,+-¥" for x in form):
            forms[ch] = form
    return forms


@cache
def amount_forms() -> tuple[str, str, dict[str, str]]:
    """The characters with a plain counterpart of one character and those counterparts in the same order, invisible ones
    last and without any, and the few that stand for several characters."""
    forms = _amount_characters()
    one = {a: b for a, b in forms.items() if len(b) == 1}
    return "".join([*one, *(a for a, b in forms.items() if not b)]), "".join(one.values()), {a: b for a, b in forms.items() if len(b) > 1}


def amount_text(c: Column | str) -> Column:
    """The text of an amount with full-width and look-alike characters in their plain form and without invisible ones."""
    odd, plain, several = amount_forms()
    one = F.translate(text(c), odd, plain)
    # a literal map, looked up character by character, for the rows alone that hold a sign of several characters
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in several.items())), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(one, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    return F.when(one.rlike("[" + "".join(several) + "]"), spelled).otherwise(one)


def date_of(c: Column | str) -> Column:
    """DAT01: a real day of 1900 to 2099, with separators or compact."""
    bare = F.regexp_replace(text(c), rf"[{SPACES}]", "")
    pattern, compact = r"^((?:19|20)\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?", r"^((?:19|20)\d{2})(\d{2})(\d{2})$"
    parts = lambda p: F.concat_ws("-", *(F.regexp_extract(bare, p, k) for k in (1, 2, 3))).try_cast("date")
    return F.when(bare.rlike(pattern), parts(pattern)).when(bare.rlike(compact), parts(compact))


def time_of(c: Column | str) -> Column:
    """DAT02: ``HH:MM:SS`` or compact; NULL for anything else."""
    bare = F.regexp_replace(text(c), rf"[{SPACES}]", "")
    pattern, compact = r"^(?:.*\D)?([01]\d|2[0-3]):([0-5]\d):([0-5]\d)$", r"^([01]\d|2[0-3])([0-5]\d)([0-5]\d)$"
    parts = lambda p: F.concat_ws(":", *(F.regexp_extract(bare, p, k) for k in (1, 2, 3)))
    return F.when(bare.rlike(pattern), parts(pattern)).when(bare.rlike(compact), parts(compact))


def direction_of(c: Column | str) -> Column:
    """DIR01: ``IN``, ``OUT`` or ``UNKNOWN`` from the printed word or sign."""
    bare = F.upper(F.regexp_replace(text(c), rf"[{SPACES}]", ""))
    return F.when(bare.isin("IN", "贷", "贷方", "收", "收入", "转入", "+", "CR"), "IN").when(bare.isin("OUT", "借", "借方", "支", "支出", "转出", "-", "DR"), "OUT").otherwise("UNKNOWN")


def row_fingerprint(*columns: str) -> Column:
    """HSH03: SHA-256 of the columns' texts, a unit separator between them."""
    return F.sha2(F.concat_ws("\u001f", *(text(F.col(c).cast("string")) for c in columns)), 256)


def days_between(a: Column, b: Column) -> Column:
    """DAT05: whole days, 0 if either is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(0))


def source_line(c: Column | str, line: int) -> Column:
    """STR08: the n-th printed line of a cell, from 1; NULL if there is none."""
    return F.get(F.split(text(c), r"\r?\n"), F.lit(line - 1))


def source_party(c: Column | str, part: str) -> Column:
    """STR08: the account or the name of a cell that holds both, split by a slash, bar or line feed; NULL unless exactly one side is a number."""
    sides = F.transform(F.split(text(c), r"[/|\n]"), lambda x: F.trim(x))
    number = F.filter(sides, lambda x: F.regexp_replace(x, rf"[{SPACES}\-*]", "").rlike(r"^\d{4,32}$"))
    name = F.filter(sides, lambda x: ~F.regexp_replace(x, rf"[{SPACES}\-*]", "").rlike(r"^\d{4,32}$") & (x != ""))
    clear = (F.size(sides) == 2) & (F.size(number) == 1) & (F.size(name) == 1)
    return F.when(clear, F.get(number if part == "account" else name, F.lit(0)))


def number_spacing(c: Column | str) -> Column:
    """STR09: spaces that recognition put around a sign, comma or point, or after a currency sign, taken out again."""
    closed = F.regexp_replace(text(c), r"(?<=\d)\s*([,.])\s*(?=\d)", "$1")
    return F.regexp_replace(closed, r"(?<=[-+¥￥])\s+(?=\d)", "")


def account_from_text(c: Column | str) -> Column:
    """STR10: the only run of 8 to 32 digits of a text; NULL if there is none or several."""
    runs = F.filter(F.regexp_extract_all(text(c), F.lit(r"\d+"), F.lit(0)), lambda x: F.length(x).between(8, 32))
    return F.when(F.size(runs) == 1, F.get(runs, F.lit(0)))


def page_region(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """GEO01: a box in page units as shares of the page, cut to the page; NULL for boxes without extent or page."""
    share = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b))
    left, top = share(x, page_width), share(y, page_height)
    box = F.struct(left.alias("x"), top.alias("y"), (share(x + width, page_width) - left).alias("width"), (share(y + height, page_height) - top).alias("height"))
    return F.when((width > 0) & (height > 0) & (page_width > 0) & (page_height > 0), box)


def turned_region(box: Column, degrees: int) -> Column:
    """GEO01: a region of shares on a page turned clockwise by a multiple of 90 degrees."""
    x, y, w, h = (box[k] for k in ("x", "y", "width", "height"))
    turned = {0: (x, y, w, h), 90: (1 - y - h, x, h, w), 180: (1 - x - w, 1 - y - h, w, h), 270: (y, 1 - x - w, h, w)}[degrees % 360]
    return F.struct(*(c.alias(n) for c, n in zip(turned, ("x", "y", "width", "height"), strict=True)))
