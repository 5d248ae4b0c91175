"""One canonical string for each printed form of a number, day, time, direction or account.

Every function takes and returns a string ``Column``; NULL and blank input give ``''``. A text that is not of the
expected kind comes out trimmed and otherwise unchanged, so two unreadable values are equal only if they are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The printed words for the two directions.
DIRECTION_IN = ("IN", "转入", "贷", "收入", "+")
DIRECTION_OUT = ("OUT", "转出", "借", "支出", "-")

_SPACE = r"[\s  -   　﻿​]"
_SEPARATOR = r"[\s  -   　﻿​\-_—–·•]"


def trimmed(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", ""), F.lit(""))


def account(c: Column) -> Column:
    """Account numbers without spaces and separators, lower case."""
    return F.coalesce(F.lower(F.regexp_replace(c, _SEPARATOR, "")), F.lit(""))


def number(c: Column) -> Column:
    """``¥1,234.5`` and ``1234.50`` both give ``1234.5``; grouping, currency signs and spaces make no difference."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), rf"[,，¥￥$元]|{_SPACE}", "")
    ok = bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$") & (F.length(bare) <= 40)
    whole = F.regexp_extract(bare, r"^[+-]?0*(\d*)", 1)
    frac = F.regexp_replace(F.regexp_extract(bare, r"\.(\d*)$", 1), "0+$", "")
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)))
    signed = F.when(bare.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(ok, signed).otherwise(trimmed(c))


def day(c: Column) -> Column:
    """Year-first days in any common separator, and compact ``YYYYMMDD``, as ``YYYY-MM-DD``."""
    t = trimmed(c)
    pattern = r"^(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?(?:[T ]00:00:00(?:\.0+)?)?$"
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    joined = lambda p: F.concat_ws("-", F.regexp_extract(t, p, 1), F.lpad(F.regexp_extract(t, p, 2), 2, "0"), F.lpad(F.regexp_extract(t, p, 3), 2, "0"))
    return F.when(t.rlike(pattern), joined(pattern)).when(t.rlike(compact), joined(compact)).otherwise(t)


def clock(c: Column) -> Column:
    """``05:29:19``, ``052919`` and ``5时29分19秒`` as ``05:29:19``; a time without seconds keeps only hour and minute."""
    t = trimmed(c)
    pattern = r"^(\d{1,2})\s*[:：时]\s*(\d{1,2})(?:\s*[:：分]\s*(\d{1,2})\s*秒?|\s*分?)$"
    compact = r"^(\d{2})(\d{2})(\d{2})$"
    pad = lambda p, k: F.lpad(F.regexp_extract(t, p, k), 2, "0")
    second = F.regexp_extract(t, pattern, 3)
    spoken = F.concat_ws(":", pad(pattern, 1), pad(pattern, 2), F.when(second != "", F.lpad(second, 2, "0")))
    return F.when(t.rlike(pattern), spoken).when(t.rlike(compact), F.concat_ws(":", pad(compact, 1), pad(compact, 2), pad(compact, 3))).otherwise(t)


def direction(c: Column) -> Column:
    t = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, ""))
    return F.when(t.isin(*DIRECTION_IN), "IN").when(t.isin(*DIRECTION_OUT), "OUT").otherwise(t)


def words(c: Column) -> Column:
    """Free text in which spacing makes no difference."""
    return F.coalesce(F.regexp_replace(c, _SPACE, ""), F.lit(""))


#: Which function holds for which field of a statement row.
FIELD_KIND = {
    "account_number": account,
    "transaction_date": day,
    "transaction_time": clock,
    "direction": direction,
    "amount": number,
    "balance": number,
    "counterparty_account": account,
}


def field(name: str, c: Column, text=words) -> Column:
    """The canonical value of the field ``name``; ``text`` is used for names, summaries and other free text."""
    return FIELD_KIND.get(name, text)(c)


def _trimmed_sql(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')"


def field_sql(name: str, c: str, spaced: bool = False) -> str:
    """The same canonical values for the SQL side; free text keeps its inner spaces where ``spaced``."""
    t = _trimmed_sql(c)
    parts = lambda p, sep: f" || '{sep}' || ".join(f"lpad(regexp_extract({t}, '{p}', {k}), {2 if k > 1 or sep == ':' else 4}, '0')" for k in (1, 2, 3))
    if name in ("account_number", "counterparty_account"):
        return f"coalesce(lower(regexp_replace({c}, '{_SEPARATOR}', '', 'g')), '')"
    if name == "transaction_date":
        p, q = r"^(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?(?:[T ]00:00:00(?:\.0+)?)?$", r"^(\d{4})(\d{2})(\d{2})$"
        return f"CASE WHEN regexp_matches({t}, '{p}') THEN {parts(p, '-')} WHEN regexp_matches({t}, '{q}') THEN {parts(q, '-')} ELSE {t} END"
    if name == "transaction_time":
        p, q = r"^(\d{1,2})\s*[:：时]\s*(\d{1,2})(?:\s*[:：分]\s*(\d{1,2})\s*秒?|\s*分?)$", r"^(\d{2})(\d{2})(\d{2})$"
        short = f"lpad(regexp_extract({t}, '{p}', 1), 2, '0') || ':' || lpad(regexp_extract({t}, '{p}', 2), 2, '0')"
        return f"CASE WHEN regexp_matches({t}, '{p}') THEN CASE WHEN regexp_extract({t}, '{p}', 3) = '' THEN {short} ELSE {parts(p, ':')} END WHEN regexp_matches({t}, '{q}') THEN {parts(q, ':')} ELSE {t} END"
    if name == "direction":
        u = f"upper(regexp_replace(coalesce({c},''), '{_SPACE}', '', 'g'))"
        return f"CASE WHEN {u} IN {DIRECTION_IN!r} THEN 'IN' WHEN {u} IN {DIRECTION_OUT!r} THEN 'OUT' ELSE {u} END"
    if name in ("amount", "balance"):
        b = rf"regexp_replace(coalesce({c},''), '[,，¥￥$元]|{_SPACE}', '', 'g')"
        whole, frac = rf"regexp_extract({b}, '^[+-]?0*(\d*)', 1)", rf"regexp_replace(regexp_extract({b}, '\.(\d*)$', 1), '0+$', '')"
        digits = f"(CASE WHEN {whole} = '' THEN '0' ELSE {whole} END || CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END)"
        return rf"CASE WHEN regexp_matches({b}, '^[+-]?(\d+(\.\d*)?|\.\d+)$') AND length({b}) <= 40 THEN CASE WHEN starts_with({b}, '-') AND {digits} <> '0' THEN '-' ELSE '' END || {digits} ELSE {t} END"
    return t if spaced else f"coalesce(regexp_replace({c}, '{_SPACE}', '', 'g'), '')"
