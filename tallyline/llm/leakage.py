"""Corpus documents that hold passages of held-out test items, by greedy string tiling.

Texts are compared as sequences of letters and digits in one case and width: punctuation, spacing, line breaks and
invisible characters are gone before anything is matched. The corpus is streamed in Arrow batches, in slabs of a bounded
number of characters and without a shuffle. The seeds of up to ``ITEMS_AT_ONCE`` items travel with the task; a longer list
of items is worked off block by block, each a pass of its own, so no number of items has to fit into memory.

1. Seeds: Karp-Rabin hashes of every run of ``seed`` characters, for all documents of a batch at once, are looked up
   among the items' hashes.
2. Filter without loss: every tile of at least ``seed`` characters consists of seeds, so a pair whose seeds together
   cover less than the threshold of an item's own wording can't reach it.
3. Tiling: seeds that follow each other on one diagonal are one run, and a run is compared with the text itself, so that
   hash collisions don't matter. The longest common run of unmarked characters is marked, then the next, down to ``seed``.
4. Coverage: the tiles that follow each other in the item's order, at best weight, over the item's own wording. With
   ``ordered=False`` all tiles count, which catches reordered passages too.

Items so short that two fifths of them are shorter than a seed have seeds of that length. A copy that differs more often
than every ``seed`` characters has no seed and isn't found.

An item's own wording is what is left without standing phrases: runs of ``phrase`` characters that at least
``PHRASE_ITEMS`` items (and a 33rd of them) share.

Defined results: NULL and empty texts and texts without letters hold nothing; an item without own wording is held by no
document; a repeated document is reported as often as it occurs; texts of any length are matched whole; no items or no
documents give no row; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.records import slabs
from tallyline.session import cut_lineage

ITEMS_AT_ONCE = 20_000
PHRASE_ITEMS = 6
THRESHOLD = 0.4
#: Seed and phrase lengths of ideographic and of alphabetic items.
LENGTHS = {True: (6, 12), False: (14, 40)}
_BASE = np.uint64(0x100000001B3)


def plain(text: str) -> str:
    """Letters and digits only, one width, one case."""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of ``length`` codes, modulo 2**64, by doubling the run length."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, have, value = _BASE, 1, codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        done, n_done = None, 0
        need = length
        while True:
            if need & 1:
                if done is None:
                    done, n_done = value, have
                    scale = power
                else:
                    done = done[: len(done) - have] * power + value[n_done:]
                    n_done += have
            need >>= 1
            if not need:
                return done[: len(codes) - length + 1]
            value = value[: len(value) - have] * power + value[have:]
            power, have = power * power, have * 2


@dataclass
class Item:
    item_id: int
    text: str
    own: np.ndarray


class SeedIndex:
    """The items of one script with their seeds."""

    def __init__(self, items: list[tuple[int, str]], seed: int, phrase: int, standing: set[str] | None = None) -> None:
        self.seed = seed
        if standing is None:
            shared = Counter(g for _, t in items for g in {t[k : k + phrase] for k in range(len(t) - phrase + 1)})
            standing = {g for g, n in shared.items() if n >= max(PHRASE_ITEMS, len(items) / 33)}
        self.items: list[Item] = []
        for item_id, text in items:
            own = np.ones(len(text), bool)
            for k in range(len(text) - phrase + 1):
                if text[k : k + phrase] in standing:
                    own[k : k + phrase] = False
            if own.any():
                self.items.append(Item(item_id, text, own))
        hashes = [rolling_hashes(_codes(i.text), seed) for i in self.items]
        keys = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        where = np.concatenate([*(np.full(len(h), k) for k, h in enumerate(hashes)), np.zeros(0, int)]).astype(np.int64)
        places = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.where, self.places = keys[order], where[order], places[order]
        # the own characters before each place of each item, one item after the other
        self.before = np.concatenate([*(np.concatenate([[0], np.cumsum(i.own)]) for i in self.items), np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(i.text) + 1 for i in self.items])]).astype(np.int64)
        self.owned = np.array([int(i.own.sum()) for i in self.items], np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document position, item, item position)`` of every shared seed."""
        hashes = rolling_hashes(codes, self.seed)
        lo, hi = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        found = np.nonzero(hi > lo)[0]
        counts = (hi - lo)[found]
        at = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(found) else np.zeros(0, int)
        return np.repeat(found, counts), self.where[at], self.places[at]


def tile(item: Item, text: str, diagonals: Counter, seed: int) -> list[tuple[int, int, int]]:
    """The tiles of a text, from the places of the shared seeds on each diagonal."""
    runs: list[tuple[int, int, int]] = []
    for shift, starts in diagonals.items():
        first = last = None
        for i in [*sorted(starts), None]:
            if first is not None and i != last + 1:
                runs += checked(item.text, text, first, first + shift, last - first + seed, seed)
                first = None
            first, last = i if first is None else first, i
    return tiles_of(runs, item, text, seed)


def checked(item: str, text: str, i: int, j: int, n: int, seed: int) -> list[tuple[int, int, int]]:
    """The runs ``(length, item place, text place)`` in which item and text really agree; hashes alone may collide."""
    if item[i : i + n] == text[j : j + n]:
        return [(n, i, j)]
    same = [item[i + k : i + k + 1] == text[j + k : j + k + 1] for k in range(n)]
    edges = [-1, *(k for k, s in enumerate(same) if not s), n]
    return [(b - a - 1, i + a + 1, j + a + 1) for a, b in zip(edges, edges[1:], strict=False) if b - a - 1 >= seed]


def tiles_of(runs: list[tuple[int, int, int]], item: Item, text: str, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item position, text position, length)``, longest first, never overlapping on either side."""
    left, right = bytearray(len(item.text)), bytearray(len(text))
    tiles: list[tuple[int, int, int]] = []
    runs.sort(key=lambda r: (r[0], -r[1], -r[2]))
    while runs:
        n, i, j = runs.pop()
        free = [k for k in range(n) if not left[i + k] and not right[j + k]]
        if len(free) == n:
            left[i : i + n] = right[j : j + n] = b"\1" * n
            tiles.append((i, j, n))
            continue
        # what is left of a run in unmarked pieces goes back to its place among the shorter runs
        start = None
        for k in range(n + 1):
            if k < n and not left[i + k] and not right[j + k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= seed:
                    piece = (k - start, i + start, j + start)
                    at = next((p for p in range(len(runs), 0, -1) if runs[p - 1] <= piece), 0)
                    runs.insert(at, piece)
                start = None
    return tiles


def coverage(item: Item, tiles: list[tuple[int, int, int]], ordered: bool = True) -> float:
    """The share of the item's own wording in the tiles, or in their heaviest chain that keeps the item's order."""
    weight = np.concatenate([[0], np.cumsum(item.own)])
    best: list[tuple[int, int, float]] = []
    for i, j, n in sorted(tiles):
        own = float(weight[i + n] - weight[i])
        before = max((w for _, end, w in best if end <= j), default=0.0) if ordered else max((w for *_, w in best), default=0.0)
        best.append((i + n, j + n, before + own))
    return max((w for *_, w in best), default=0.0) / float(item.own.sum())


def held_items(texts: list[str | None], indexes: list[SeedIndex], threshold: float = THRESHOLD, ordered: bool = True) -> list[list[tuple[int, float]]]:
    """For each text the items it holds with their coverage."""
    plains = [plain(t) if t else "" for t in texts]
    out: list[list[tuple[int, float]]] = [[] for _ in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in plains])]).astype(np.int64)
    codes = _codes("\0".join(plains))
    for index in indexes:
        at, item, place = index.hits(codes)
        if not len(at):
            continue
        pair = (np.searchsorted(starts, at, "right") - 1) * len(index.items) + item
        order = np.lexsort((place, at - place, pair))
        at, place, pair, item = at[order], place[order], pair[order], item[order]
        # seeds one after the other on a diagonal are one run
        fresh = np.append(True, (pair[1:] != pair[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (place[1:] != place[:-1] + 1))
        first = np.nonzero(fresh)[0]
        length = np.diff(np.append(first, len(at))) + index.seed - 1
        at, place, pair, item = at[first], place[first], pair[first], item[first]
        # no pair can cover more than the own characters of all its runs
        own = index.before[index.first[item] + place + length] - index.before[index.first[item] + place]
        names, begin = np.unique(pair, return_index=True)
        bound = np.add.reduceat(own, begin)
        ends = np.append(begin[1:], len(pair))
        for k in np.nonzero(bound >= threshold * index.owned[item[begin]])[0]:
            a, b = begin[k], ends[k]
            d, it = int(names[k]) // len(index.items), index.items[item[a]]
            runs = [r for i, j, n in zip(place[a:b].tolist(), (at[a:b] - starts[d]).tolist(), length[a:b].tolist(), strict=True) for r in checked(it.text, plains[d], i, j, n, index.seed)]
            share = coverage(it, tiles_of(runs, it, plains[d], index.seed), ordered)
            if share >= threshold:
                out[d].append((it.item_id, share))
    return out


def _ideographic(text: str) -> bool:
    return 2 * sum("㐀" <= ch <= "鿿" for ch in text) > len(text)


def seed_length(script: bool, length: int, threshold: float) -> int:
    """The usual seed, or, for an item of which the threshold is shorter, that."""
    return max(1, min(LENGTHS[script][0], math.ceil(threshold * length)))


def plain_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(item_id, script, text)`` of the items that hold any letter or digit."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, _ideographic(p), p) for i, p in ((int(i), plain(t)) for i, t in zip(pdf["item_id"], pdf["text"], strict=True) if t) if p]
            yield pd.DataFrame(rows, columns=["item_id", "script", "text"])

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return cut_lineage(rows.mapInPandas(read, "item_id bigint, script boolean, text string"))


def standing_phrases(items: DataFrame) -> dict[bool, set[str]]:
    """The runs that many items of a script share. One that a 33rd of the items share can't be one of more than 33 times
    as many runs as an item has on average, whatever the number of items."""
    counts = {r["script"]: r["n"] for r in items.groupBy("script").agg(F.count("*").alias("n")).collect()}

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, g) for s, t in zip(pdf["script"], pdf["text"], strict=True) for g in {t[k : k + LENGTHS[s][1]] for k in range(len(t) - LENGTHS[s][1] + 1)}]
            yield pd.DataFrame(rows, columns=["script", "run"])

    least = {s: max(PHRASE_ITEMS, n / 33) for s, n in counts.items()}
    held = items.mapInPandas(runs, "script boolean, run string").groupBy("script", "run").agg(F.count("*").alias("n"))
    many = held.where(F.col("n") >= F.when(F.col("script"), least.get(True, 0.0)).otherwise(least.get(False, 0.0)))
    out: dict[bool, set[str]] = {True: set(), False: set()}
    for r in many.collect():
        out[r["script"]].add(r["run"])
    return out


def seed_indexes(rows: list[tuple[int, bool, str]], standing: dict[bool, set[str]], threshold: float) -> list[SeedIndex]:
    groups: dict[tuple[bool, int], list[tuple[int, str]]] = {}
    for item_id, script, text in sorted(rows):
        groups.setdefault((script, seed_length(script, len(text), threshold)), []).append((item_id, text))
    return [SeedIndex(items, seed, LENGTHS[script][1], standing[script]) for (script, seed), items in sorted(groups.items())]


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, ordered: bool = True) -> DataFrame:
    """``(doc_key, item_key, coverage)`` of every document and item it holds."""
    known = plain_items(items, item_key, item_text)
    standing, passes = standing_phrases(known), max(1, -(-known.count() // ITEMS_AT_ONCE))

    def one_pass(block: int) -> DataFrame:
        # about ITEMS_AT_ONCE items, by a hash of their ids
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == block).collect()
        indexes = [i for i in seed_indexes([tuple(r) for r in rows], standing, threshold) if i.items]

        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                found = [f for part in slabs([t or "" for t in texts]) for f in held_items(part, indexes, threshold, ordered)]
                yield pd.Series([[{"item": i, "coverage": c} for i, c in f] for f in found])

        held_udf = F.pandas_udf(held, "array<struct<item: bigint, coverage: double>>")
        return docs.select(doc_key, F.explode(held_udf(F.col(text))).alias("h")).select(doc_key, F.col("h.item").alias(item_key), "h.coverage")

    return reduce(DataFrame.unionByName, map(one_pass, range(passes)))
