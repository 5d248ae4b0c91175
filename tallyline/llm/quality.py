"""Per-document statistics of text quality, and fixed rules that tell prose from lists, tables and junk.

All statistics are counted over whole texts by vector operations, for many documents at once: one table lookup gives every
code point its classes, which are summed by document, and lines and entries are columns of their own to which each pattern
is applied once. Nothing is shuffled, and a document costs its own length. An Arrow batch is worked off in slabs of a
bounded number of characters, so that large texts don't multiply in memory. The list of common words is a small fixed
table (``MAX_WORDS``, checked).

Rules, first match wins, each with its reason recorded; thresholds are parameters of ``RULES`` in the manner of the
published web-text filters (symbol ratio, bullet and ellipsis lines, terminal punctuation, stop words):

* JUNK ``repeated``: most characters repeat those a few places before them;
* JUNK ``unreadable``: few letters and digits among the visible characters, or many replacement and control characters;
* JUNK ``no_vocabulary``: hardly any common word, and ideographs that ordinary text doesn't use;
* TABLE ``markup`` / ``columns``: most of the text is table markup, or lines with the same number of the same separator;
* LIST ``bullets`` / ``short_lines`` / ``entries``: most of it is enumerated short lines, short unpunctuated lines, or
  short entries in one line, without the words of sentences;
* JUNK ``no_words``: hardly any common word otherwise.

Everything else is natural prose (NULL kind). Wrapped lines, questions and answers, and prose with a heading or a few
table rows hold common words and stay below the shares, so they are prose.

Defined results: NULL, empty and blank texts have zero statistics and no kind (they hold nothing that could be junk);
repeated documents are judged each; an empty word list makes no text ``no_words`` or ``no_vocabulary``; extra columns
are kept unless they clash with a statistic's name, which then is replaced.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.records import slabs

MAX_WORDS = 5_000
RULES = {
    "repeated": 0.7, "readable": 0.5, "broken": 0.1, "vocabulary": 0.02, "rare": 0.35, "table": 0.5, "bullets": 0.5, "short_lines": 0.6,
    "entries": 0.7, "sentence_words_zh": 0.03, "sentence_words_en": 0.12, "least_entries": 4, "entry_length": 60, "short_length": 48,
}

#: How far back a repeated character is looked for.
PERIODS = range(1, 9)
_BULLET = (
    r"^\s*(?:[-*•·●◦▪‣–—○■□◆※>+]|[(（]?\d{1,3}[.)、）．:：]|[(（][一二三四五六七八九十]+[)）]|[一二三四五六七八九十]{1,3}[、.．]"
    r"|[(（]?[a-zA-Z][.)）]|[①-⑳]|[ivxIVX]{1,5}[.)])"
)
_SENTENCE_END = r"[。．.！!？?；;：:…”’\"')）」]\s*$"
_SENTENCE_PART = r"[。！!？?；;，,]\s*$"
_GAP = r"[ \x{3000}]*\x{3000}[ \x{3000}]*| {2,}"
_ENTRY_MARKS = r"[,，、;；|\r\n]+"
_MARKUP = r"(?is)<table\b.*?</table>|<tr\b.*?</tr>|</?(?:table|tbody|thead|tr|td|th)\b[^>]*>"


@cache
def everyday_ideographs() -> str:
    """The ideographs of the basic national character set, from the codec's table."""

    def known(ch: str) -> bool:
        try:
            return bool(ch.encode("gb2312"))
        except UnicodeEncodeError:
            return False

    return "".join(filter(known, map(chr, range(0x4E00, 0xA000))))


STATISTICS = {
    "n_visible": "int", "n_lines": "int", "n_han": "int", "n_latin": "int", "n_words": "int", "mean_word_length": "double", "alnum_share": "double",
    "broken_share": "double", "symbol_share": "double", "common_share": "double", "rare_share": "double", "repeated_share": "double", "ended_share": "double",
    "bullet_share": "double", "short_line_share": "double", "n_entries": "int", "entry_share": "double", "markup_share": "double", "column_share": "double",
}
#: Classes of code points, one bit each.
VISIBLE, HAN, LETTER, ALNUM, BROKEN, RARE, COMMON, PIPE = (1 << k for k in range(8))


@cache
def _classes() -> np.ndarray:
    """The classes of every code point, but for common words."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    spans = lambda bit, *ranges: [table.__setitem__(slice(a, b + 1), table[a : b + 1] | bit) for a, b in ranges]
    spans(VISIBLE, (0x21, sys.maxunicode))
    spans(HAN, (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
    spans(LETTER, (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x400, 0x4FF))
    spans(BROKEN, (0x7F, 0x9F), (0x25A0, 0x25A1), (0xFFFD, 0xFFFD))
    table[ord("|")] |= PIPE
    everyday = set(everyday_ideographs())
    for code in range(0x21, sys.maxunicode + 1):
        if 0x3400 <= code <= 0x4DBF or 0x4E00 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3 or 0x20000 <= code <= 0x323AF:
            table[code] |= ALNUM
        elif (category := unicodedata.category(chr(code)))[0] in "LN":
            table[code] |= ALNUM
        elif category[0] == "Z":
            table[code] &= ~np.uint8(VISIBLE)
    for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
        for code in range(a, b + 1):
            if chr(code) not in everyday:
                table[code] |= RARE
    return table


class Counter:
    """The statistics of lists of texts, for one list of common words."""

    def __init__(self, common_words: list[str]) -> None:
        words = sorted({w.casefold() for w in common_words if w})
        ideographic = [w for w in words if any("㐀" <= c <= "鿿" for c in w)]
        self.single = "".join(w for w in ideographic if len(w) == 1)
        self.long = "|".join(re.escape(w) for w in ideographic if len(w) > 1)
        latin = [w for w in words if w not in ideographic]
        self.plain = {w for w in latin if re.fullmatch("[a-z]+", w)}
        self.other = re.compile(r"(?i)(?<![A-Za-z])(?:" + "|".join(re.escape(w) for w in latin if w not in self.plain) + r")(?![A-Za-z])") if len(self.plain) < len(latin) else None
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = _classes().copy()
            for ch in self.single:
                self._table[ord(ch)] |= COMMON
        return self._table

    def _latin(self, text: str) -> int:
        found = sum(w in self.plain for w in re.findall("[a-z]+", text.lower())) if self.plain else 0
        return found + (len(self.other.findall(text)) if self.other else 0)

    def statistics(self, texts: list[str]) -> pd.DataFrame:
        n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(n), sizes)
        flags = self.table()[codes]
        count = lambda mask: np.bincount(owner[mask], minlength=n)
        having = lambda bit: (flags & bit) != 0
        share = lambda part, whole: np.divide(part, whole, out=np.zeros(n), where=np.asarray(whole) > 0)
        visible, letters, same_text = having(VISIBLE), having(LETTER), owner[1:] == owner[:-1]
        seen, han = count(visible), count(having(HAN))
        starts = letters.copy()
        starts[1:] &= ~(letters[:-1] & same_text)
        latin = count(starts)
        out = {"n_visible": seen, "n_han": han, "n_latin": latin, "n_words": han + latin}
        out["mean_word_length"] = share(count(letters) + han, han + latin)
        out["alnum_share"] = share(count(having(ALNUM)), seen - count(having(PIPE)))
        out["broken_share"] = share(count(having(BROKEN)), seen)
        out["symbol_share"] = np.where(seen > 0, 1 - out["alnum_share"], 0.0)
        out["rare_share"] = share(count(having(RARE)), han)
        repeated = np.zeros(n)
        for p in PERIODS:
            again = np.zeros(len(codes), bool)
            again[p:] = (codes[p:] == codes[:-p]) & (owner[p:] == owner[:-p]) & visible[p:]
            repeated = np.maximum(repeated, share(count(again), seen))
        out["repeated_share"] = repeated
        common = count(having(COMMON)) + np.array([self._latin(t) if k else 0 for t, k in zip(texts, latin, strict=True)])
        array = pa.array(texts, pa.large_string())
        if self.long:
            common = common + pc.count_substring_regex(array, self.long).to_numpy()
        out["common_share"] = share(common, han + latin)
        return pd.DataFrame(out | self._by_line(array, n, share) | self._by_entry(array, n, share))[list(STATISTICS)]

    def _by_line(self, array: pa.Array, n: int, share) -> dict[str, np.ndarray]:
        split = pc.split_pattern_regex(array, r"[\r\n]+")
        line, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
        bare = pc.utf8_trim_whitespace(line)
        kept = pc.not_equal(bare, "")
        line, bare, owner = line.filter(kept), bare.filter(kept), owner[kept.to_numpy(zero_copy_only=False)]
        length = pc.utf8_length(bare).to_numpy().astype(np.int64)
        total = lambda mask: np.bincount(owner[mask], length[mask], minlength=n)
        like = lambda pattern: pc.match_substring_regex(line, pattern).to_numpy(zero_copy_only=False)
        chars = np.bincount(owner, length, minlength=n)
        lines = np.bincount(owner, minlength=n)
        out = {"n_lines": lines, "ended_share": share(np.bincount(owner[like(_SENTENCE_END)], minlength=n), lines)}
        out["bullet_share"] = share(total(like(_BULLET) & (length <= RULES["entry_length"])), chars)
        out["short_line_share"] = share(total((length <= RULES["short_length"]) & ~like(_SENTENCE_PART)), chars)
        # the separator of a line and how often it has it; 0 for a line that is no row of columns
        bare = pc.replace_substring_regex(bare, '"[^"]*"', "q")
        held = lambda sign: pc.count_substring(bare, sign).to_numpy()
        tabs, pipes, semicolons, commas = held("\t"), held("|"), held(";"), held(",")
        edges = pc.starts_with(bare, "|").to_numpy(zero_copy_only=False).astype(int) + pc.ends_with(bare, "|").to_numpy(zero_copy_only=False)
        gaps = pc.count_substring_regex(bare, _GAP).to_numpy()
        worded = pc.match_substring_regex(bare, ", [A-Za-z]").to_numpy(zero_copy_only=False)
        kinds = [(tabs > 0, tabs), (pipes >= 2, pipes - edges), (semicolons >= 2, semicolons), ((commas >= 3) & ~worded, commas), (gaps >= 2, gaps)]
        separator = np.select([k for k, _ in kinds], [(m.astype(np.int64) << 3) + i + 1 for i, (_, m) in enumerate(kinds)], 0)
        # each document's most frequent separator: one sort of the marked lines, whatever their number
        marked = separator > 0
        pairs, first, times = np.unique(np.stack([owner[marked], separator[marked]], axis=1), axis=0, return_index=True, return_counts=True)
        order = np.lexsort((pairs[:, 1], times, pairs[:, 0]))
        last = order[np.append(np.diff(pairs[order, 0]) > 0, True)] if len(order) else order
        mode = np.full(n, -1, np.int64)
        mode[pairs[last, 0][times[last] >= 3]] = pairs[last, 1][times[last] >= 3]
        return out | {"column_share": share(total(separator == mode[owner]), chars)}

    def _by_entry(self, array: pa.Array, n: int, share) -> dict[str, np.ndarray]:
        split = pc.split_pattern_regex(array, _ENTRY_MARKS)
        owner = pc.list_parent_indices(split).to_numpy()
        length = pc.utf8_length(pc.utf8_trim_whitespace(split.flatten())).to_numpy().astype(np.int64)
        short = (length >= 1) & (length <= 30)
        whole = pc.utf8_length(pc.replace_substring_regex(array, r"[,，、;；|\s]+", " ")).to_numpy()
        out = {"n_entries": np.bincount(owner[short], minlength=n), "entry_share": share(np.bincount(owner[short], length[short], minlength=n), whole)}
        size, left = pc.utf8_length(array).to_numpy(), pc.utf8_length(array).to_numpy().copy()
        tagged = np.nonzero(pc.match_substring_regex(array, "(?i)</?t").to_numpy(zero_copy_only=False))[0]
        if len(tagged):
            left[tagged] = pc.utf8_length(pc.replace_substring_regex(array.take(pa.array(tagged)), _MARKUP, "")).to_numpy()
        return out | {"markup_share": share(size - left, size)}


def with_statistics(docs: DataFrame, text: str, common_words: list[str]) -> DataFrame:
    """``docs`` with one column a statistic."""
    counter = Counter(common_words)

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            # lone surrogates can't be in an Arrow string
            read = [(t or "").encode("utf-8", "replace").decode() for t in texts]
            yield pd.concat([counter.statistics(part) for part in slabs(read)], ignore_index=True)

    udf = F.pandas_udf(counted, ", ".join(f"{c} {t}" for c, t in STATISTICS.items()))
    kept = [c for c in docs.columns if c not in STATISTICS]
    return docs.select(*(F.col(f"`{c}`") for c in kept), udf(F.col(text)).alias("_statistics")).select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"_statistics.{c}") for c in STATISTICS))


def with_kind(df: DataFrame, rules: dict[str, float] = RULES, has_words: bool = True) -> DataFrame:
    """``text_kind`` (NULL for prose) and ``kind_reason`` of documents with statistics."""
    c = F.col
    latin = c("n_latin") > c("n_han")
    wordless = F.lit(has_words) & (c("common_share") < F.when(latin, rules["sentence_words_en"]).otherwise(rules["sentence_words_zh"]))
    reason = (
        F.when(c("n_visible") == 0, F.lit(None).cast("string"))
        .when(c("repeated_share") >= rules["repeated"], "JUNK repeated")
        .when(c("markup_share") >= rules["table"], "TABLE markup")
        .when((c("broken_share") >= rules["broken"]) | (c("alnum_share") < rules["readable"]), "JUNK unreadable")
        .when(F.lit(has_words) & (c("common_share") < rules["vocabulary"]) & (c("n_han") >= 20) & (c("rare_share") >= rules["rare"]), "JUNK no_vocabulary")
        .when(c("column_share") >= rules["table"], "TABLE columns")
        .when((c("bullet_share") >= rules["bullets"]) & (c("n_lines") >= rules["least_entries"]), "LIST bullets")
        .when(wordless & (c("short_line_share") >= rules["short_lines"]) & (c("n_lines") >= rules["least_entries"]), "LIST short_lines")
        .when(wordless & (c("entry_share") >= rules["entries"]) & (c("n_entries") >= rules["least_entries"]), "LIST entries")
        .when(wordless, "JUNK no_words")
    )
    return df.withColumn("kind_reason", reason).withColumn("text_kind", F.substring_index("kind_reason", " ", 1))


def not_prose(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("text_kind").isNotNull())


def judge(docs: DataFrame, common_words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    rows = common_words.select(word).distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")
    words = [r[0] for r in rows if r[0]]
    return with_kind(with_statistics(docs, text, words), has_words=bool(words))
