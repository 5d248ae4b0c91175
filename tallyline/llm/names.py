"""Variant spellings of persons and firms linked to one entity.

A name is read into a key (what names the entity: brand, surname or full ideographic name) and qualifiers (line of
business, city, given name), with decorations, legal forms, titles and spacing gone. Spelling variants of keys are found
by the pigeonhole principle: a key within k edits of another, cut into k+1 segments, shares at least one segment with it
unchanged and shifted by at most k. A swap of neighbours is one edit but may spoil two segments, where it crosses their
border; so the segments beside a border are indexed with its two characters swapped too. Each key's segments form an
inverted index, position-shifted substrings of every key are looked up in it by an equi-join, and the pairs are verified
with a banded edit distance. Only distinct keys take part; exact copies never meet each other.

What is a line of business or a given name is known from a ``Vocabulary``, a reference list, and learnt from the table:
the last word before a legal form that stands with many different brands, and the first word of persons' names that
stands with many different surnames.

Qualified names (line of business and city of a firm, given name and city of a person are known) with equal qualifiers
and keys that are variants are one entity; so are the names of one row. Their groups are connected components of a graph
whose edges are linear in rows plus variant key pairs, found by repeated minimum labels with checkpoints. A row that
lacks a qualifier joins the one group its known qualifiers fit; where it fits several, an equal account decides; where
it still does, it stays with the rows that read exactly like it. "Fits one group" is the equality of two aggregates, the
least and the greatest fitting label, so nothing is gathered for it either.

Scale: rows are spread by row id or by full qualified key; an entity with a third of all rows is a set of equal
qualified keys, which collapse on the map side. The result by ``linked_rows`` is one row an entity row; ``linked_pairs``
expands it, as its contract wants all pairs.

Defined results: a repeated row id is one row; NULL or blank names and aliases are ignored; a row without any name is an
entity of its own; NULL accounts never decide; names of any length may vary; an empty table gives no row; extra columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import cut_lineage

MAX_PLACES = 10_000
MOST_EDITS = 2
PAIR_BLOCK = 500
#: A learnt word stands in so many names of its kind at least, and in such a share of them.
LEARNT_LEAST, LEARNT_SHARE = 8, 0.004
#: Lines of business in firm names.
INDUSTRIES_HAN = "园林 贸易 物流 商务 建材 纺织 酒店 山货 高科 金属 水产 石材 药材 电子 食品 家居 木业 机械 农业 包装".split()
INDUSTRIES_LATIN = (
    "aviation brewing catering ceramics chemicals dairy foods haulage horticulture imports insurance logistics machinery "
    "marine optics packaging plumbing publishing robotics tanning textiles timber"
).split()
#: Legal forms of firms.
LEGAL_LATIN = set("limited ltd co company corporation corp incorporated inc gmbh gesellschaft mbh llc plc ag".split())
_LEGAL_HAN = re.compile(r"(?:股份|有限|责任)*(?:有限|股份)(?:责任)?公?[司可词同]?$|公[司可词同]$")
#: Titles, and what is written beside a name without belonging to it.
TITLES = set("mr mrs ms miss dr prof sir".split())
_BESIDE = re.compile(r"^(?:户名|收款人|付款人|姓名)[:：]|[(（](?:借记卡|信用卡|个人|对公户|普通|基本户|一般户)[)）]?$|[/／](?:代付|零钱|代收)$|[-－](?:货款|本人|工资)$|(?:基本户|一般户)$|(?:先生|女士|小姐)$")
#: Short forms of given names.
NICKNAMES = {
    "tom": "thomas", "tommy": "thomas", "bob": "robert", "rob": "robert", "bobby": "robert", "greg": "gregory", "bill": "william", "will": "william", "billy": "william",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "danny": "daniel", "dan": "daniel", "joe": "joseph", "joey": "joseph", "tony": "anthony", "steve": "stephen",
    "steven": "stephen", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "fred": "frederick", "freddy": "frederick",
    "pete": "peter", "zach": "zachary", "zack": "zachary", "nick": "nicholas", "len": "leonard", "lenny": "leonard", "chris": "christopher", "vicky": "victoria", "bella": "isabella",
}
GIVEN = {*NICKNAMES.values(), "henrietta", "ulysses", "orlando"}
FIRM, PERSON = "F", "P"


@dataclass(frozen=True)
class Vocabulary:
    """Lines of business in ideographs and in letters, and given names."""

    han: tuple[str, ...] = tuple(INDUSTRIES_HAN)
    latin: tuple[str, ...] = tuple(INDUSTRIES_LATIN)
    given: frozenset[str] = frozenset(GIVEN)


KNOWN = Vocabulary()


def edit_distance(a: str, b: str, k: int) -> int:
    """Edits (insertion, deletion, substitution, swap of neighbours) within a band of ``k``; ``k + 1`` if there are more."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    if a == b:
        return 0
    big = k + 1
    older: dict[int, int] = {}
    old = {j: j for j in range(k + 1)}
    for i in range(1, len(a) + 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                new[j] = i
                continue
            best = min(old.get(j - 1, big) + (a[i - 1] != b[j - 1]), old.get(j, big) + 1, new.get(j - 1, big) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, older.get(j - 2, big) + 1)
            new[j] = min(best, big)
        if min(new.values()) > k:
            return big
        older, old = old, new
    return old.get(len(b), big)


def _with_one_left_out(word: str) -> set[str]:
    return {word} | {word[:k] + word[k + 1 :] for k in range(len(word))}


@cache
def _neighbours(vocabulary: tuple[str, ...] | frozenset[str]) -> dict[str, set[str]]:
    """The words of a vocabulary by their forms with one letter left out, of which words one edit or swap apart share one."""
    out: dict[str, set[str]] = {}
    for word in vocabulary:
        for form in _with_one_left_out(word):
            out.setdefault(form, set()).add(word)
    return out


def _near(word: str, vocabulary: tuple[str, ...] | frozenset[str]) -> str | None:
    forms = _neighbours(vocabulary)
    met = set().union(*(forms.get(f, ()) for f in _with_one_left_out(word)))
    found = {v for v in met if edit_distance(word, v, 1) <= 1}
    return found.pop() if len(found) == 1 else None


def _industry(word: str, dotted: bool, lines: tuple[str, ...]) -> str | None:
    if word in lines:
        return word
    if len(word) >= 3 and dotted:
        found = [w for w in lines if w.startswith(word)]
        return found[0] if len(found) == 1 else None
    return _near(word, lines) if len(word) >= 5 else None


def _read_latin(text: str, known: Vocabulary) -> tuple[str, str, str | None, str | None, str | None]:
    parts = [(w.casefold().strip(".'"), w.endswith(".")) for w in re.split(r"[\s,/&]+", text) if w.strip(".',-")]
    parts = [p for p in parts if p[0] and p[0] not in TITLES]
    rest, industry, legal, given, initials = [], None, False, None, []
    for word, dotted in parts:
        if word in LEGAL_LATIN:
            legal = True
        elif len(word) == 1:
            initials.append(word)
        elif industry is None and (line := _industry(word, dotted, known.latin)):
            industry = line
        elif given is None and (name := NICKNAMES.get(word) or (word if word in known.given else None)):
            given = name
        else:
            rest.append(word)
    firm = legal or industry is not None
    if firm and given:
        rest.append(given)
    if not firm and given is None and len(rest) > 1:
        typed = [(k, n) for k, w in enumerate(rest) if len(w) >= 5 and (n := _near(w, known.given))]
        if typed:
            given = typed[0][1]
            del rest[typed[0][0]]
    if not firm and given is None and not initials and len(rest) == 1:
        firm = True
    if not firm:
        return PERSON, "".join(rest) or (given or ""), None, None, given or (initials[0] if initials else None)
    return FIRM, "".join(rest), industry, None, None


def _without_place(text: str, places: tuple[str, ...]) -> tuple[str, str | None]:
    for place in places:
        if place not in text:
            continue
        name = re.escape(place)
        shorter = re.sub(rf"^{name}市*|[(（]{name}市?[)）]?|{name}市?$", "", text)
        if shorter != text and len(shorter) >= 2:
            return shorter, place
    return text, None


def _without_form(text: str) -> tuple[str, bool]:
    """An ideographic name without its legal form and signs."""
    text = re.sub(r"[(（]((?:股份|有限|责任|公司)[^)）]*)[)）]?$", r"\1", text)
    text, firm = re.sub(r"[()（）·•,，.。\-－/／]", "", text), False
    while (shorter := _LEGAL_HAN.sub("", text)) != text and len(shorter) >= 2:
        text, firm = shorter, True
    return text, firm


def _read_han(text: str, places: tuple[str, ...], known: Vocabulary) -> tuple[str, str, str | None, str | None, str | None]:
    text, city = _without_place(re.sub(r"\s", "", text), places)
    text, firm = _without_form(text)
    industry = None
    if len(text) >= 4 and text[-2:] in known.han:
        text, industry = text[:-2], text[-2:]
    elif len(text) >= 6 and len(near := {w for w in known.han if w[0] == text[-2] or w[1] == text[-1]}) == 1:
        text, industry = text[:-2], near.pop()
    firm = firm or industry is not None or city is not None
    return (FIRM if firm or len(text) >= 4 and "·" not in text else PERSON), text, industry, city, None


def _bare_name(name: str) -> str:
    text = unicodedata.normalize("NFKC", name)
    if not text.isprintable():  # format characters aren't
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = text.strip()
    while (shorter := _BESIDE.sub("", text).strip()) != text and shorter:
        text = shorter
    return text


def word_evidence(name: str, places: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """``(role, word, rest)``: what a name tells about lines of business (H, L) and given names (G), and words elsewhere in it (X)."""
    text = _bare_name(name)
    if any("㐀" <= c <= "鿿" for c in text):
        text, firm = _without_form(_without_place(re.sub(r"\s", "", text), places)[0])
        if firm and len(text) >= 4:
            yield "H", text[-2:], text[:-2]
        return
    words = [w.casefold().strip(".'") for w in re.split(r"[\s,/&]+", text)]
    words = [w for w in words if len(w) > 2 and w not in TITLES]
    legal = next((k for k, w in enumerate(words) if w in LEGAL_LATIN), None)
    if legal is not None and legal >= 2:
        yield "L", words[legal - 1], " ".join(words[: legal - 1])
    elif legal is None and len(words) == 2 and "," not in text:
        yield "G", words[0], words[1]
        yield "X", words[1], words[0]


def learnt_vocabulary(names: DataFrame, places: tuple[str, ...], known: Vocabulary = KNOWN) -> Vocabulary:
    """``known`` and the words that the names (one column) themselves show to be lines of business or given names. At most
    one in ``LEARNT_SHARE`` words of a role can reach its share, so what is collected is bounded whatever the table."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([e for n in pdf["n"] for e in word_evidence(n, places)], columns=["role", "word", "rest"], dtype=object)

    told = names.select(F.col(names.columns[0]).alias("n")).distinct().mapInPandas(read, "role string, word string, rest string").distinct()
    counts = cut_lineage(told.groupBy("role", "word").agg(F.count("*").alias("n")))
    totals = counts.groupBy("role").agg((F.sum("n") * LEARNT_SHARE).alias("least"))
    often = counts.join(F.broadcast(totals), "role").where((F.col("n") >= LEARNT_LEAST) & (F.col("n") >= F.col("least")))
    found: dict[str, dict[str, int]] = {"H": {}, "L": {}, "G": {}, "X": {}}
    for r in often.collect():
        found[r["role"]][r["word"]] = r["n"]
    given = {w for w, n in found["G"].items() if n >= 2 * found["X"].get(w, 0) and w not in found["L"]}
    return Vocabulary(tuple(dict.fromkeys([*known.han, *sorted(found["H"])])), tuple(dict.fromkeys([*known.latin, *sorted(found["L"])])), known.given | given)


def read_name(name: str, places: tuple[str, ...] = (), known: Vocabulary = KNOWN) -> tuple[str, str, str | None, str | None, str | None]:
    """``(kind, key, line of business, city, given name or initial)``."""
    text = _bare_name(name)
    han = sum("㐀" <= c <= "鿿" for c in text)
    dots = "·" in text or "•" in text
    if han and not dots and 2 * han >= len(re.sub(r"\W", "", text)):
        return _read_han(text, places, known)
    if han:
        return PERSON, re.sub(r"\W", "", text), None, None, ""
    return _read_latin(text, known)


def name_rows(df: DataFrame, key: str, name: str, aliases: str, account: str, city: str, vocabulary: Vocabulary = KNOWN) -> DataFrame:
    """One row a row and spelling: ``(id, account, kind, word, industry, city, given)``, qualifiers joined over the row's names."""
    known = df.select(city).where(F.coalesce(F.col(city), F.lit("")) != "").distinct().limit(MAX_PLACES + 1).collect()
    if len(known) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} places")
    places = tuple(sorted((r[0] for r in known), key=lambda p: (-len(p), p)))

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for names in batches:
            yield pd.DataFrame([read_name(n, places, vocabulary) for n in names], columns=["kind", "word", "industry", "place", "given"], dtype=object)

    read_udf = F.pandas_udf(read, "kind string, word string, industry string, place string, given string")
    names = F.array_distinct(F.filter(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    rows = df.select(F.col(key).alias("id"), F.nullif(F.col(account), F.lit("")).alias("account"), F.nullif(F.col(city), F.lit("")).alias("city"), F.explode(names).alias("n"))
    vocabulary = learnt_vocabulary(rows.select("n"), places, vocabulary)
    # the aggregate by row also takes repeated rows together
    spelled = rows.select("id", "account", "city", read_udf(F.col("n")).alias("r")).where(F.col("r.word") != "")
    given = F.max(F.when(F.length("r.given") > 1, F.col("r.given")))
    whole = spelled.groupBy("id").agg(
        F.max("account").alias("account"),
        F.when(F.max((F.col("r.kind") == FIRM) & (F.col("r.industry").isNotNull() | F.col("r.place").isNotNull())), FIRM).otherwise(F.min("r.kind")).alias("kind"),
        F.collect_set(F.col("r.word")).alias("words"),
        F.max("r.industry").alias("industry"),
        F.coalesce(F.max("city"), F.max("r.place")).alias("city"),
        F.coalesce(given, F.max("r.given")).alias("given"),
    )
    person = F.col("kind") == PERSON
    return whole.select("id", "account", "kind", F.explode("words").alias("word"), F.when(~person, F.col("industry")).alias("industry"), "city", F.when(person, F.col("given")).alias("given"))


def variant_keys(words: DataFrame) -> DataFrame:
    """``(kind, word, other)`` of the distinct keys that are variants of each other, both ways, and each with itself."""

    def spread(batches: Iterator[pd.DataFrame], probe: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, word in zip(pdf["kind"], pdf["word"], strict=True):
                if edits_allowed(kind, word):
                    out += [(kind, *entry, word) for entry in (probes_of(word) if probe else entries_of(word))]
            yield pd.DataFrame(out, columns=["kind", "length", "seg", "part", "word"])

    schema = "kind string, length int, seg int, part string, word string"
    # keys are few bytes but much work: a number of parts that isn't merged again keeps them spread
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = words.select("kind", "word").distinct()
    spaced = distinct.repartition(width)
    index = spaced.mapInPandas(lambda b: spread(b, False), schema)
    probes = spaced.mapInPandas(lambda b: spread(b, True), schema).withColumnRenamed("word", "other")
    met = index.hint("merge").join(probes, ["kind", "length", "seg", "part"]).where(F.col("word") < F.col("other")).select("kind", "word", "other").distinct()
    # a swap is two plain edits, so the built-in plain distance rules nearly all of them out before any Python
    near = F.when(F.least(F.length("word"), F.length("other")) >= 11, F.levenshtein("word", "other", 2 * MOST_EDITS)).otherwise(F.levenshtein("word", "other", MOST_EDITS))
    met = met.where(near >= 0)

    def verified(kinds: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x, y, k) <= k for x, y, k in ((x, y, min(edits_allowed(t, x), edits_allowed(t, y))) for t, x, y in zip(kinds, a, b, strict=True))])

    pairs = met.where(F.pandas_udf(verified, "boolean")("kind", "word", "other"))
    return pairs.unionByName(pairs.select("kind", F.col("other").alias("word"), F.col("word").alias("other"))).unionByName(distinct.select("kind", "word", F.col("word").alias("other")))


def _has_ideographs(word: str) -> bool:
    return any("㐀" <= c <= "鿿" for c in word)


def edits_by_length(ideographs: bool, length: int) -> int:
    """Edits allowed between keys: an ideograph carries a name by itself, a letter a fraction of one."""
    return int(length >= 4) if ideographs else 2 if length >= 11 else int(length >= 5)


def edits_allowed(kind: str, word: str) -> int:
    return edits_by_length(_has_ideographs(word), len(word))


def entries_of(word: str) -> set[tuple[int, int, str]]:
    """``(length, segment, text)`` of the k+1 segments of a key, and of those beside a border with its characters swapped."""
    length, k = len(word), edits_by_length(_has_ideographs(word), len(word))
    cuts = segments(length, k + 1)
    out = {(length, seg, word[p : p + size]) for seg, (p, size) in enumerate(cuts)}
    for seg in range(k):
        p = cuts[seg + 1][0]
        turned = word[: p - 1] + word[p] + word[p - 1] + word[p + 1 :]
        out |= {(length, s, turned[cuts[s][0] : sum(cuts[s])]) for s in (seg, seg + 1)}
    return out


def probes_of(word: str) -> set[tuple[int, int, str]]:
    """What the entries of any key within the edits would be, in this word: substrings shifted by at most k."""
    out = set()
    for length in range(max(1, len(word) - MOST_EDITS), len(word) + MOST_EDITS + 1):
        # the length of the indexed key decides how it is cut
        k = edits_by_length(_has_ideographs(word), length)
        for seg, (start, size) in enumerate(segments(length, k + 1) if k else ()):
            out |= {(length, seg, word[p : p + size]) for p in range(max(0, start - k), min(len(word) - size, start + k) + 1)}
    return out


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """``(start, size)`` of the parts a word of this length is cut into; they differ by one at most."""
    sizes = [length // parts + (k < length % parts) for k in range(parts)]
    return [(sum(sizes[:k]), s) for k, s in enumerate(sizes)]


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, label)``: the least node reachable, by minimum labels over neighbours and their labels' labels."""
    both = cut_lineage(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:  # labels only ever fall, so this ends
        around = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jumped = nearer.join(nearer.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        jumped = cut_lineage(jumped)
        labels = jumped.select("node", F.col("new").alias("label"))
        if jumped.where(F.col("label") != F.col("new")).isEmpty():
            break
    return labels


def linked_rows(df: DataFrame, key: str, name: str, aliases: str, account: str, city: str, vocabulary: Vocabulary = KNOWN) -> DataFrame:
    """``(id, entity)`` of every row that has a name."""
    rows = cut_lineage(name_rows(df, key, name, aliases, account, city, vocabulary))
    qualifiers = ["industry", "city", "given"]
    full = F.col("city").isNotNull() & F.when(F.col("kind") == FIRM, F.col("industry").isNotNull()).otherwise(F.length("given") != 1)
    rows = rows.withColumn("pid", F.xxhash64("kind", "word", *qualifiers)).withColumn("full", F.coalesce(full, (F.col("kind") == PERSON) & F.col("given").isNull() & F.col("city").isNotNull(), F.lit(False)))
    variants = cut_lineage(variant_keys(rows))

    profiles = rows.select("pid", "kind", "word", *qualifiers, "full").distinct()
    same = lambda a, b: [F.col(f"{a}.{q}").eqNullSafe(F.col(f"{b}.{q}")) for q in qualifiers]
    turned = profiles.join(variants.where(F.col("word") < F.col("other")), ["kind", "word"]).select("pid", "kind", "other", *qualifiers, "full").alias("x")
    spelled = turned.join(profiles.alias("y"), [F.col("x.kind") == F.col("y.kind"), F.col("x.other") == F.col("y.word"), F.col("x.full") == F.col("y.full"), *same("x", "y")])
    spelled = spelled.select(F.col("x.pid").alias("a"), F.col("y.pid").alias("b"))
    own = rows.groupBy("id").agg(F.min("pid").alias("a")).join(rows.select("id", F.col("pid").alias("b")), "id").where(F.col("a") != F.col("b")).select("a", "b")
    groups = components(spelled.unionByName(own).distinct(), rows.select(F.col("pid").alias("node")).distinct())

    labelled = cut_lineage(rows.join(groups.withColumnRenamed("node", "pid"), "pid"))
    # rows lacking a qualifier look for the one group of full profiles that fits, else for the one other group at all
    known = labelled.select("kind", "word", *qualifiers, "label", "account", "full").distinct()
    targets = known.withColumnRenamed("word", "other").alias("t")
    seekers = known.where(~F.col("full")).join(variants, ["kind", "word"]).alias("s")
    fits = lambda q: F.col(f"s.{q}").isNull() | F.col(f"t.{q}").isNull() | (F.col(f"s.{q}") == F.col(f"t.{q}"))
    given_fits = fits("given") | (F.length("s.given") == 1) & F.col("t.given").startswith(F.col("s.given")) | (F.length("t.given") == 1) & F.col("s.given").startswith(F.col("t.given"))
    met = seekers.join(targets, [F.col("s.kind") == F.col("t.kind"), F.col("s.other") == F.col("t.other"), F.col("s.label") != F.col("t.label"), fits("industry"), fits("city"), given_fits])
    tests = {"full": F.col("t.full"), "account": F.col("s.account") == F.col("t.account"), "any": F.lit(True)}
    ends = [f(F.when(test, F.col("t.label"))).alias(f"{n}_{f.__name__}") for n, test in tests.items() for f in (F.min, F.max)]
    found = met.groupBy(F.col("s.label").alias("a")).agg(*ends)
    one = lambda n: F.when(F.col(f"{n}_min") == F.col(f"{n}_max"), F.col(f"{n}_min"))
    moved = found.select("a", F.coalesce(one("account"), one("full"), F.when(F.col("full_min").isNull(), one("any"))).alias("b")).where(F.col("b").isNotNull())
    final = components(moved, labelled.select(F.col("label").alias("node")).distinct()).withColumnRenamed("label", "entity")
    return labelled.join(final, F.col("label") == F.col("node")).groupBy("id").agg(F.min("entity").alias("entity"))


def linked_pairs(linked: DataFrame, key: str) -> DataFrame:
    """Every pair of rows of one entity, the smaller id first. The rows of an entity are cut into blocks of about
    ``PAIR_BLOCK``, and block meets block, so an entity with a third of all rows is many tasks."""
    sizes = linked.groupBy("entity").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    cut = cut_lineage(linked.join(sizes, "entity").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = cut.select("entity", F.col("block").alias("x"), every.alias("y"), F.col("id").alias(f"{key}_1"))
    b = cut.select("entity", every.alias("x"), F.col("block").alias("y"), F.col("id").alias(f"{key}_2"))
    return a.join(b, ["entity", "x", "y"]).where(F.col(f"{key}_1") < F.col(f"{key}_2")).select(f"{key}_1", f"{key}_2")
