"""Looser and stricter readings of print, bank names, hashes of identifiers, boxes and printed purposes.

All are column expressions; NULL text is ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import SPACES, semantic_text, text

#: Banks by their full names, aliases, and words that name no bank.
BANKS = (
    "中国工商银行", "中国农业银行", "中国建设银行", "中国银行", "交通银行", "中国邮政储蓄银行", "中国光大银行", "招商银行", "中信银行", "兴业银行",
    "平安银行", "中国民生银行", "华夏银行", "浦发银行", "四川农信", "绵阳市商业银行",
)
BANK_ALIASES = (("工商银行", "中国工商银行"), ("工行", "中国工商银行"), ("农业银行", "中国农业银行"), ("建设银行", "中国建设银行"), ("光大银行", "中国光大银行"))
NO_BANK = r"^(?:银行|商业银行|农村商业银行|信用社)$"
BANK_KINDS = r"银行|农信|信用社|农商|邮储|财务公司"
UNVERIFIED = r"待核验|待核对|未知"
#: Payment channels that lead a merchant's name.
CHANNELS = ("抖音支付", "微信支付", "财付通", "支付宝", "程支付", "银联")
#: What error texts say about why a reading failed, in the order in which they are tried.
FAILURES = (
    ("CAPACITY", r"(?i)OUTPUT_LIMIT|MAX_TOKENS|length limit|输出.{0,8}(上限|超限)|请求体.{0,8}(过大|超限)|(^|[^0-9A-Za-z_])413([^0-9A-Za-z_]|$)"),
    ("TIMEOUT", r"(?i)timeout|超时|长时间没有|最长处理时间"),
    ("TRANSIENT", r"(?i)(^|[^0-9A-Za-z_])(429|502|503|504|1102)([^0-9A-Za-z_]|$)|resource limits|temporar|限流"),
    ("INVALID_OUTPUT", r"(?i)结构化|JSON|不完整|没有返回|结果为空|流在完成前中断"),
)


def summary_text(c: Column | str) -> Column:
    """STR03: without spaces and the signs that part words, but with parentheses; lower case."""
    return F.lower(F.regexp_replace(text(c), rf"[{SPACES}\-_@#*|/\\.,:;，。、：；]", ""))


def canonical_bank(c: Column | str) -> Column:
    """STR11: the full name a text contains, that of an alias, or the text without its legal form; '' for a mere kind of bank."""
    bare = F.regexp_replace(text(c), rf"[{SPACES}]", "")
    out = F.when(bare.rlike(NO_BANK), "")
    for name in BANKS:
        out = out.when(bare.contains(name), name)
    for alias, name in BANK_ALIASES:
        out = out.when(bare.contains(alias), name)
    return out.otherwise(F.regexp_replace(bare, "股份有限公司|有限责任公司", ""))


def is_useful_bank(c: Column | str, holder: Column | str) -> Column:
    """STR11: names a bank, isn't marked unverified and doesn't contain the holder's name."""
    bare, own = F.trim(text(c)), F.trim(text(holder))
    return (bare != "") & ~bare.rlike(UNVERIFIED) & bare.rlike(BANK_KINDS) & ~((F.length(own) >= 2) & bare.contains(own) & bare.contains("银行"))


def loose_date(c: Column | str) -> Column:
    """DAT03: three parts in the order written, two-digit years in this century, no calendar; compact texts are cut."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text(c), rf"[/.年月日{SPACES}]", "-"), "-+", "-"))
    p = F.split(t, "-")
    year = F.when(F.length(F.get(p, F.lit(0))) == 4, F.get(p, F.lit(0))).when(F.length(F.get(p, F.lit(0))) == 2, F.concat(F.lit("20"), F.get(p, F.lit(0)))).otherwise("2024")
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    cut = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    return F.when(F.size(p) >= 3, F.concat_ws("-", year, pad(F.get(p, F.lit(1))), pad(F.get(p, F.lit(2))))).when(F.length(t) >= 8, cut).otherwise(t)


def digits_stamp(day: Column | str, clock: Column | str) -> Column:
    """DAT04: day and time from their digits alone; '' without a plausible day, the day alone without a possible time."""
    d = F.regexp_replace(text(day), "[^0-9]", "")
    c = F.regexp_replace(text(clock), "[^0-9]", "")
    c = F.substring(F.when(c != "", c).otherwise(F.substring(d, 9, 20)), 1, 6)
    n = lambda x, a, k: F.substring(x, a, k).try_cast("int")
    plausible = (F.length(d) >= 8) & n(d, 1, 4).between(1900, 2100) & n(d, 5, 2).between(1, 12) & n(d, 7, 2).between(1, 31)
    date = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    second = F.when(F.length(c) >= 6, F.substring(c, 5, 2)).otherwise("00")
    possible = (F.length(c) >= 4) & (n(c, 1, 2) <= 23) & (n(c, 3, 2) <= 59) & (second.try_cast("int") <= 59)
    return F.when(~F.coalesce(plausible, F.lit(False)), "").when(F.coalesce(possible, F.lit(False)), F.concat(date, F.lit(" "), F.concat_ws(":", F.substring(c, 1, 2), F.substring(c, 3, 2), second))).otherwise(date)


def sortable_stamp(day: Column | str, clock: Column | str) -> Column:
    """DAT04: a text that sorts by day and time, last without a day, at midnight without a time; nothing is validated."""
    d, c = F.trim(text(day)), F.trim(text(clock))
    date = F.when(d.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.regexp_replace(d, "/", "-")).when(d.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).when(d == "", "9999-99-99").otherwise(d)
    time = F.when(c.contains(":"), F.element_at(F.split(c, " "), -1)).when(c.rlike(r"^\d{6}$"), F.concat_ws(":", F.substring(c, 1, 2), F.substring(c, 3, 2), F.substring(c, 5, 2))).when(c != "", c).otherwise("00:00:00")
    return F.trim(F.concat_ws(" ", date, time))


def iso_date(c: Column | str) -> Column:
    """DAT07: a real day written ``YYYY-MM-DD`` and nothing else."""
    return F.when(text(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), text(c)).try_cast("date")


def scoring_value(field: str, c: Column | str) -> Column:
    """NUM04: the value that two readings of a field are compared by, NULL if there is none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text(c)), "−", "-"), "，", ",")
    if field in ("amount", "balance"):
        value = F.when(F.regexp_replace(t, "[,￥¥]", "").rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), F.regexp_replace(t, "[,￥¥]", "")).try_cast("decimal(18,2)")
        return (F.abs(value) if field == "amount" else value).cast("string")
    if field in ("account_number", "counterparty_account"):
        runs = F.filter(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda x: F.length(x) >= 8)
        return F.when(F.size(runs) == 1, F.get(runs, F.lit(0)))
    if field == "transaction_date":
        p = r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})([^\d]|$)"
        part = lambda k, w: F.lpad(F.regexp_extract(t, p, k), w, "0")
        return F.when(t.rlike(p), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)))
    if field == "direction":
        signed = t.rlike(r"^[+-][\d,.]+$")
        return F.when(t.isin("IN", "收入", "贷", "借贷2", "2"), "IN").when(t.isin("OUT", "支出", "借", "借贷1", "1"), "OUT").when(signed & t.startswith("-"), "OUT").when(signed, "IN")
    return F.lit(None).cast("string")


def _units(c: Column | str) -> Column:
    """The UTF-16 code units of a text."""
    words = F.regexp_extract_all(F.hex(F.encode(text(c), "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.transform(words, lambda x: F.conv(x, 16, 10).cast("bigint"))


def _times(x: Column, factor: int) -> Column:
    """A product modulo 2**32, in two halves so that no intermediate exceeds 64 bits."""
    high = (x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (high + x * F.lit(factor & 0xFFFF)).bitwiseAND(F.lit(0xFFFFFFFF))


def _hex8(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 8, "0"))


def two_lane_hash(c: Column | str) -> Column:
    """HSH01, GRA06: sixteen hexadecimal digits of two multiply-xor lanes, the second of which also takes the place."""
    fixed = (2166136261, 16777619, 2246822507, 3266489909)  # fixed values: offsets and factors of the lanes
    placed = F.transform(_units(c), lambda x, i: F.struct(x.alias("x"), (x + i).alias("y")))
    start = F.struct(F.lit(fixed[0]).cast("bigint").alias("a"), F.lit(fixed[2]).cast("bigint").alias("b"))
    step = lambda s, u: F.struct(_times(s["a"].bitwiseXOR(u["x"]), fixed[1]).alias("a"), _times(s["b"].bitwiseXOR(u["y"]), fixed[3]).alias("b"))
    return F.aggregate(placed, start, step, lambda s: F.concat(_hex8(s["a"]), _hex8(s["b"])))


def short_hash(c: Column | str) -> Column:
    """HSH02: one multiply-xor lane in base 36, capitals."""
    start = F.lit(2166136261).cast("bigint")
    return F.aggregate(_units(c), start, lambda s, u: _times(s.bitwiseXOR(u), 16777619), lambda s: F.upper(F.conv(s.cast("string"), 10, 36)))


def source_box(box: Column) -> Column:
    """GEO02: ``[top, left, bottom, right]`` in shares or thousandths as a region; NULL for boxes that are incomplete or too small."""
    top, left, bottom, right = (F.get(box, F.lit(k)).cast("double") for k in range(4))
    unit = F.when(F.greatest(top, left, bottom, right) > 1, 1000.0).otherwise(1.0)
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / unit))
    x, y, width, height = share(left), share(top), share(right) - share(left), share(bottom) - share(top)
    whole = (F.size(box) == 4) & top.isNotNull() & left.isNotNull() & bottom.isNotNull() & right.isNotNull()
    region = F.struct(x.alias("x"), y.alias("y"), F.least(width, 1 - x).alias("width"), F.least(F.greatest(height, F.lit(0.008)), 1 - y).alias("height"))
    return F.when(whole & (width >= 0.03) & (height >= 0.005), region)


def printed_type(summary: Column | str, context: Column, direction: Column | str, account_kind: str = "deposit") -> Column:
    """CLS06: the transaction type that the printed purpose names, '' where it names conflicting or unresolved repayments,
    NULL where it names none. Purpose outranks the way of payment."""
    s, side = semantic_text(summary), F.col(direction) if isinstance(direction, str) else direction
    outgoing, incoming = side == "OUT", side == "IN"
    credit, loan = context.rlike(r"信用卡.{0,8}还款|贷记卡.{0,8}还款"), context.rlike(r"贷款还款|归还贷款|偿还贷款|还贷")
    unresolved = context.rlike("还款") & ~s.rlike(r"^(?:自动还款|人民币自动转帐还款|微众银行还款)$")
    out = (
        F.when(outgoing & credit & loan, "")
        .when(outgoing & credit, "信用卡还款")
        .when(outgoing & loan, "贷款还款")
        .when(outgoing & unresolved, F.when(s == "消费", "消费").otherwise(""))
        .when(s.rlike("分期付款退货"), "分期退款")
        .when(s.rlike(r"消费退货|消费退款|^退货$|^退款$"), "退款")
    )
    if account_kind == "deposit":
        out = (
            out.when(incoming & s.rlike(r"^(?:现金存入|现金存款|存现|.{1,12}存现)$"), "现金存入")
            .when(outgoing & s.rlike(r"^(?:现金支取|现金取款|取现|.{1,12}取现)$"), "现金支取")
            .when(incoming & (s.rlike(r"^银联入账|^支付机构提现") | context.rlike(r"(?:微信|零钱|余额宝|支付宝).{0,8}提现")), "第三方支付")
            .when(outgoing & s.rlike(r"^(?:快捷支付|网上支付)"), "第三方支付")
            .when((s == "入金") & context.rlike("支付宝|财付通|微信|银联|支付有限公司|支付股份有限公司"), "第三方支付")
            .when(outgoing & (s == "充值") & context.rlike(r"(?:微信|支付宝|财付通|余额宝).{0,12}充值"), "第三方支付")
        )
    return out


def printed_purpose(label: Column | str, direction: Column | str) -> Column:
    """CLS07: the type that a complete business label in a merchant column stands for, '' for merchants and parts of labels."""
    s, side = semantic_text(label), F.col(direction) if isinstance(direction, str) else direction
    incoming, outgoing = side == "IN", side == "OUT"
    return (
        F.when(incoming & (s == "代发工资"), "工资收入")
        .when(incoming & (s == "银联入账"), "第三方支付")
        .when(outgoing & s.rlike(r"^(?:支付宝|微信|财付通|银联)[-—－·:：]消费$"), "消费")
        .when(incoming & (s == "转账收入") | outgoing & (s == "转账支出"), "账户转账")
        .otherwise("")
    )


def failure_kind(message: Column | str) -> Column:
    """CLS09."""
    out = None
    for kind, pattern in FAILURES:
        test = text(message).rlike(pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("UNKNOWN")


def preflight(kind: Column, upright: Column, dark_160: Column, dark_210: Column, has_text: Column) -> Column:
    """CLS10: whether a page is blank by reading, pixels and text layer alike, and how far it must be turned."""
    index = F.instr(F.lit("ABCD"), upright) - 1
    pixels = (dark_160 <= 0.00005) & (dark_210 <= 0.0001)
    turned = F.when((kind == "blank") | (index < 0), 0).otherwise(index * 90)
    return F.struct(((kind == "blank") & pixels & ~has_text).alias("blank_confirmed"), pixels.alias("pixel_blank"), turned.alias("rotation"), ((kind != "blank") & (index < 0)).alias("uncertain"))


def payment_channel(printed: Column | str, merchant: Column | str) -> Column:
    """CLS11: the channel that is printed, else the one that leads the merchant's name."""
    out = F.when(text(printed) != "", text(printed))
    for name in CHANNELS:
        out = out.when(text(merchant).startswith(name), name)
    return out.otherwise("")


def page_strategy(body: Column | str) -> Column:
    """CLS12: whether a page's text is empty, must be read again from print, beside its text, or serves as it is."""
    t = F.trim(text(body))
    has_table = t.rlike(r"(?i)<table\b")
    damaged = t.rlike("交易日期|记账日期|交易金额|发生额") & t.rlike(r"(?i)<td\b[^>]*\bcolspan\s*=\s*[\"']?([4-9]|[1-9]\d)")
    unread = (t == "") | t.rlike(r"无法识别|^\s*[{}]\s*$|\\therefore|1\.\s*2\.\s*3\.\s*4\.\s*5\.")
    blank = t.rlike(r"(?i)Ground Truth image|OCR result should be empty|UNDERSCORE\s*&\s*LINE RULES")
    return F.when(~has_table & blank, "BLANK").when(~has_table & unread, "ORIGINAL_PDF").when(has_table & damaged, "MODEL_AND_ORIGINAL_PDF").otherwise("MODEL")
