"""Free-entered values mapped to the entries of a canonical list.

The reference list is small by contract (``MAX_REFERENCE_ROWS``, checked), so its names, aliases and derived spellings
fit one multi-pattern automaton that travels in the task closure. The typed column is never shuffled for the mapping:
each Arrow batch is resolved in place and every distinct spelling once per Python worker, so a value that makes up a
third of the table costs nothing extra.

Resolution of one value, in this order:

1. all embedded mentions are found in one pass of the automaton, and the longest non-overlapping ones win;
2. if they name exactly one entry and leave nothing but known decorations over, that entry is the answer;
3. otherwise the undecorated text is compared by token-set similarity with the names that share a token with it, found
   by an index of tokens (characters for ideographic text, characters with their place for brands of banks, words for
   Latin text, a word also matching one edit away), and the single best entry above the threshold wins;
4. failing that, a single embedded mention decides whatever else stands around it.

Everything else (no mention, several entries, a tie, a brand without its kind where the brand has several) is ``NONE``.

Defined results: NULL and ``''`` are absent and give no row; a value equal to a canonical name is canonical and gives
no row either; white space alone is a value and gives ``NONE``; texts of any length are searched whole by the automaton,
and compared by similarity unless they have so many tokens that no name could reach the threshold; repeated rows of one
key give one row; an empty reference list maps every value to ``NONE``; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_REFERENCE_ROWS = 50_000
NONE = "NONE"

#: Written and spoken abbreviations of the kinds of bank.
KIND_ABBREVIATIONS = {
    "农村商业银行": ("农商行", "农商银行", "农村商行"),
    "商业银行": ("商行", "商银行"),
    "银行": ("行",),
}
#: Abbreviated words of English bank names.
WORD_ABBREVIATIONS = {"comm": "commercial", "coml": "commercial", "bk": "bank", "bnk": "bank", "rur": "rural"}
#: What may stand around a bank's name without changing its meaning.
BANK_DECORATIONS = ("股份有限公司", "有限责任公司", "股份公司", "有限公司", "开户行", "总行", "分行", "支行", "营业部", "网点", "中国")
#: What may stand around a transaction type without changing its meaning.
TYPE_DECORATIONS = ("业务", "交易", "网银", "柜面", "自助", "手机", "app", "类", "补", "01")
#: Characters often typed for another one (variant forms, same sound, same shape).
TYPED_FOR = {
    "還": "还", "環": "还", "轉": "转", "帳": "账", "帐": "账", "欵": "款", "褪": "退", "熄": "息", "其": "期",
    "枝": "支", "交": "缴", "销": "消", "守": "手", "姿": "资", "発": "法", "验": "险", "咸": "减", "今": "金",
    "弟": "第", "为": "违", "銀": "银", "艮": "银", "很": "银",
}
#: The type names in romanised spelling.
ROMANISED_TYPES = {
    "账户转账": "zhanghu zhuanzhang", "存款结息": "cunkuan jiexi", "手续费": "shouxufei", "工资收入": "gongzi shouru",
    "司法扣划": "sifa kouhua", "保险支出": "baoxian zhichu", "贷款放款": "daikuan fangkuan", "贷款还款": "daikuan huankuan",
    "信用卡还款": "xyk huankuan", "消费": "xiaofei", "退款": "tuikuan", "缴费": "jiaofei", "第三方支付": "disanfang zhifu",
    "分期": "fenqi", "分期转换": "fenqi zhuanhuan", "分期退款": "fenqi tuikuan", "费用减免": "feiyong jianmian",
    "违约金": "weiyuejin", "透支利息": "touzhi lixi", "现金存入": "xianjin cunru", "现金支取": "xianjin zhiqu",
}


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def _ideographic(text: str) -> bool:
    return any("㐀" <= ch <= "鿿" for ch in text)


def _squeezed(text: str) -> str:
    return "".join(ch for ch in text if ch.isalnum())


def _words(text: str) -> list[str]:
    return [WORD_ABBREVIATIONS.get(w, w) for w in re.findall(r"[^\W_]+", text)]


def within_one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or substitution at most turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _with_one_left_out(word: str) -> set[str]:
    """A word and its forms with one character missing: words one edit apart share one of them."""
    return {word} | {word[:k] + word[k + 1 :] for k in range(len(word)) if len(word) >= 3}


@dataclass
class CanonicalMatcher:
    """Resolves typed values against one reference list; see the module docstring for the rules."""

    names: list[tuple[str, str]]
    aliases: list[tuple[str, str]] = field(default_factory=list)
    decorations: tuple[str, ...] = ()
    kinds: bool = False
    threshold: float = 0.5

    def __post_init__(self) -> None:
        self._exact: dict[str, set[str]] = defaultdict(set)
        self._around = sorted({self._key(word) for word in self.decorations}, key=len, reverse=True)
        self._patterns: dict[str, set[str]] = defaultdict(set)
        self._similar: list[tuple[str, str]] = []
        for ref, name in [*self.names, *self.aliases]:
            if key := self._key(name):
                self._patterns[key].add(ref)
                self._similar.append((ref, key))
        self._brands: dict[str, set[str]] = defaultdict(set)
        self._kind_of: dict[str, tuple[str, str]] = {}
        if self.kinds:
            self._derive_kinds()
        self._tokens = [(ref, key, Counter(self._tokens_of(key))) for ref, key in self._similar]
        # shared / union reaches the threshold only if the text has at most this many tokens
        self._most_tokens = max((sum(own.values()) for *_, own in self._tokens), default=0) / self.threshold
        self._by_token: dict[str, set[int]] = defaultdict(set)
        for k, (_, key, own) in enumerate(self._tokens):
            for token in own:
                for form in (token,) if _ideographic(key) else _with_one_left_out(token):
                    self._by_token[form].add(k)
        self._automaton = ahocorasick.Automaton()
        for key, refs in self._patterns.items():
            self._automaton.add_word(key, (len(key), tuple(sorted(refs))))
        for word in self._around:
            if word not in self._patterns:
                self._automaton.add_word(word, (len(word), None))
        if len(self._automaton):
            self._automaton.make_automaton()
        self._known: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("names", "aliases", "decorations", "kinds", "threshold")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _key(self, text: str) -> str:
        text = _folded(text)
        if _ideographic(text):
            return "".join(TYPED_FOR.get(ch, ch) for ch in _squeezed(text))
        return " ".join(_words(text))

    def _tokens_of(self, key: str) -> Iterable[str]:
        return key if _ideographic(key) else key.split()

    def _derive_kinds(self) -> None:
        """Names are a brand followed by a kind; every brand gets its kinds in each written order, and each kind the
        list doesn't have for that brand becomes a blocking pattern, so that another kind is never taken for it."""
        kinds = sorted(KIND_ABBREVIATIONS, key=len, reverse=True)
        for ref, name in self.names:
            key = self._key(name)
            if kind := next((k for k in kinds if key.endswith(k) and len(key) > len(k)), None):
                self._brands[key[: -len(kind)]].add(ref)
                self._kind_of[ref] = (key[: -len(kind)], kind)
        listed = {pair: ref for ref, pair in self._kind_of.items()}
        for brand, refs in self._brands.items():
            self._exact[brand] |= refs
            for kind in kinds:
                ref = listed.get((brand, kind), "")
                for spelling in (brand + kind, kind + brand, *(brand + short for short in KIND_ABBREVIATIONS[kind])):
                    self._patterns[spelling].add(ref)

    def _mentions(self, key: str) -> tuple[set[str], int]:
        """The entries of the longest non-overlapping mentions, and how many characters neither they nor decorations cover."""
        found = []
        if len(self._automaton):
            for end, (length, refs) in self._automaton.iter(key):
                start = end - length + 1
                if not _ideographic(key) and (key[start - 1 : start].strip() or key[end + 1 : end + 2].strip()):
                    continue
                found.append((length, start, refs))
        taken = bytearray(len(key))
        refs_found: set[str] = set()
        for length, start, refs in sorted(found, key=lambda x: (x[2] is None, -x[0], x[1])):
            if not any(taken[start : start + length]):
                taken[start : start + length] = b"\1" * length
                refs_found |= set(refs or ())
        return refs_found, sum(not t and ch != " " for t, ch in zip(taken, key, strict=True))

    def _undecorated(self, key: str) -> str:
        for word in self._around:
            if len(key) > len(word):
                if key.startswith(word):
                    key = key[len(word) :]
                if key.endswith(word) and len(key) > len(word):
                    key = key[: -len(word)]
        return key.strip()

    def _most_similar(self, key: str) -> str | None:
        if self.kinds and _ideographic(key):
            return self._most_similar_brand(key)
        tokens = Counter(self._tokens_of(key))
        total, scored = sum(tokens.values()), []
        if total > self._most_tokens:
            return None
        forms = tokens if _ideographic(key) else {f for t in tokens for f in _with_one_left_out(t)}
        for ref, name, own in (self._tokens[k] for k in sorted(set().union(*(self._by_token.get(f, ()) for f in forms)))):
            shared = sum((tokens & own).values())
            if not _ideographic(key):
                if _ideographic(name):
                    continue
                rest, other = list((tokens - own).elements()), list((own - tokens).elements())
                for a in rest:
                    if b := next((b for b in other if len(a) >= 3 and len(b) >= 3 and within_one_edit(a, b)), None):
                        other.remove(b)
                        shared += 0.9
            union = total + sum(own.values()) - shared
            if shared and (score := shared / union) >= self.threshold:
                scored.append((round(score, 6), within_one_edit(key, name), ref))
        if not scored:
            return None
        best = max(scored)[:2]
        refs = {ref for *rank, ref in scored if tuple(rank) == best}
        return refs.pop() if len(refs) == 1 else NONE

    def _most_similar_brand(self, key: str) -> str | None:
        """Token sets whose tokens are the brand's characters with their places: the kind must be the same, and a third of
        the tokens of both shared, that is half the brand's."""
        best: dict[int, set[str]] = defaultdict(set)
        for ref, (brand, kind) in self._kind_of.items():
            for spelling in (kind, *KIND_ABBREVIATIONS[kind]):
                for at in (i.start() for i in re.finditer(spelling, key)):
                    typed = key[max(0, at - len(brand)) : at]
                    same = len(set(enumerate(typed)) & set(enumerate(brand))) if len(typed) == len(brand) else 0
                    if same and 2 * same >= len(brand) and not any(key[:at].endswith(k[: -len(spelling)]) for k in KIND_ABBREVIATIONS if k.endswith(spelling) and k != spelling):
                        best[100 * same + len(spelling)].add(ref)
        if not best:
            return None
        refs = best[max(best)]
        return refs.pop() if len(refs) == 1 else NONE

    def resolve(self, value: str) -> str:
        if (known := self._known.get(value)) is None:
            known = self._known[value] = self._resolve(value)
            if len(self._known) > 500_000:
                self._known.clear()
        return known

    def _resolve(self, value: str) -> str:
        key = self._key(value)
        if not key:
            return NONE
        core = self._undecorated(key)
        for text in (key, core):
            if refs := self._patterns.get(text) or self._exact.get(text):
                return (next(iter(refs)) or NONE) if len(refs) == 1 else NONE
        refs, left = self._mentions(key)
        one = (next(iter(refs)) or NONE) if len(refs) == 1 else None
        if len(refs) > 1:
            return NONE
        if one and (not left or self.kinds):
            return one
        similar = self._most_similar(core)
        return similar or one or NONE


def reference_matcher(names: DataFrame, aliases: DataFrame, **options) -> CanonicalMatcher:
    """A matcher from ``(ref_id, name)`` and ``(ref_id, alias)`` rows; the lists must stay within ``MAX_REFERENCE_ROWS``."""

    def bounded(df: DataFrame) -> list[tuple[str, str]]:
        rows = df.limit(MAX_REFERENCE_ROWS + 1).collect()
        if len(rows) > MAX_REFERENCE_ROWS:
            raise ValueError(f"a reference list of more than {MAX_REFERENCE_ROWS} rows")
        return sorted((str(r[0]), r[1]) for r in rows if r[1])

    extra = options.pop("more_aliases", [])
    return CanonicalMatcher(bounded(names), [*bounded(aliases), *extra], **options)


def bank_matcher(bank_ref: DataFrame) -> CanonicalMatcher:
    aliases = bank_ref.select("ref_id", F.explode(F.array("short_name", "english_name")).alias("alias"))
    return reference_matcher(bank_ref.select("ref_id", "bank_name"), aliases, decorations=BANK_DECORATIONS, kinds=True)


def type_matcher(type_ref: DataFrame) -> CanonicalMatcher:
    names = type_ref.select("ref_id", "type_name")
    by_name = {r[1]: r[0] for r in names.where(F.col("type_name").isin(list(ROMANISED_TYPES))).distinct().collect()}
    romanised = [(by_name[name], spelling) for name, spelling in ROMANISED_TYPES.items() if name in by_name]
    return reference_matcher(names, type_ref.select("ref_id", F.explode("keywords")), decorations=TYPE_DECORATIONS, more_aliases=romanised)


def map_to_canonical(df: DataFrame, key: str, matchers: dict[str, CanonicalMatcher]) -> DataFrame:
    """``(key, field_name, value, ref_id)`` for every non-empty value of the matchers' columns that isn't a canonical name.

    One projection and one Arrow stage; no shuffle.
    """
    spread = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in matchers)))
    canonical = {c: [name for _, name in m.names] for c, m in matchers.items()}
    typed = F.col("v.value").isNotNull() & (F.col("v.value") != "")
    for c, names in canonical.items():
        typed &= ~((F.col("v.field_name") == c) & F.col("v.value").isin(names)) if names else F.lit(True)

    @F.pandas_udf("string")
    def resolved(fields: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([matchers[f].resolve(v) for f, v in zip(fields, values, strict=True)], dtype=object)

    rows = df.select(F.col(key), spread.alias("v")).where(typed).select(key, "v.field_name", "v.value")
    return rows.withColumn("ref_id", resolved("field_name", "value"))


def mapping_report(mapped: DataFrame) -> DataFrame:
    """Per column and entry: rows and distinct spellings; the ``NONE`` rows are the unmatched values."""
    return mapped.groupBy("field_name", "ref_id").agg(F.count("*").alias("n_rows"), F.approx_count_distinct("value", 0.01).alias("n_spellings"))
