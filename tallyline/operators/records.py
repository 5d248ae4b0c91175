"""Raw comma-separated records told apart into typed rows and rows with a reason for failure.

A quote-aware finite-state tokenizer reads the records. Records are cut into chunks of ``CHUNK`` characters, fewer than
most records have; every chunk is run from every state at once, one table lookup per character position over all chunks
of a slab, which gives the chunk's transition function; the functions of a record's chunks are composed by doubling
(each with the one before, then two before, then four), which gives each chunk's true start state; and one more pass
marks the separators. So a record of any length costs a linear amount of vector work and none is read character by
character in Python. A slab is so many records as hold ``SLAB`` characters, so an Arrow batch of large records doesn't
multiply in memory.

Records are independent: the operator is one Arrow stage without a shuffle.

The first reason that holds is given, with the offset at which it was seen:
``QUOTING``, ``COLUMNS``, ``AMOUNT``, ``BALANCE``, ``DIRECTION``.

Defined results: NULL and blank records (white space, a byte-order mark or a carriage return only) are neither rows nor
errors; the header record is skipped by number; a leading byte-order mark and trailing carriage returns are harmless;
spaces around a quoted field are harmless, other characters beside its quotes are ``QUOTING``; a record that ends inside
quotes is ``QUOTING``; a line feed inside quotes belongs to its field; repeated rows are read again each time; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = (
    "account_number", "account_name", "bank_name", "transaction_time", "transaction_date", "direction",
    "amount", "balance", "transaction_type", "counterparty_name", "counterparty_account", "counterparty_bank",
)
CHUNK = 64
SLAB = 1 << 22
#: The start of a field, inside an unquoted one, inside quotes, after a quote inside quotes, after a closed field's spaces, failed.
START, BARE, QUOTED, QUOTE_IN_QUOTED, CLOSED, FAILED = range(6)
#: Character classes.
OTHER, COMMA, QUOTE, SPACE, END = range(5)
_NEXT = np.array(
    [  # OTHER    COMMA   QUOTE            SPACE    END
        [BARE, START, QUOTED, START, START],  # START
        [BARE, START, FAILED, BARE, BARE],  # BARE
        [QUOTED, QUOTED, QUOTE_IN_QUOTED, QUOTED, QUOTED],  # QUOTED
        [FAILED, START, QUOTED, CLOSED, QUOTE_IN_QUOTED],  # QUOTE_IN_QUOTED
        [FAILED, START, FAILED, CLOSED, CLOSED],  # CLOSED
        [FAILED, FAILED, FAILED, FAILED, FAILED],  # FAILED
    ],
    dtype=np.uint8,
)
_AMOUNT = re.compile(r"[0-9]+(\.[0-9]{1,2})?")
_BALANCE = re.compile(r"(-?[0-9]+(\.[0-9]{1,2})?)?")
_SPACES = " \t　 "


def _classes(codes: np.ndarray) -> np.ndarray:
    kinds = np.full(codes.shape, OTHER, np.uint8)
    kinds[codes == ord(",")] = COMMA
    kinds[codes == ord('"')] = QUOTE
    for ch in _SPACES:
        kinds[codes == ord(ch)] = SPACE
    kinds[codes == 0] = END  # padding leaves every state as it is
    return kinds


def _chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The padded code points of all chunks, one row each, and the number of chunks before each record's first."""
    counts = np.array([max(1, -(-len(t) // CHUNK)) for t in texts])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    pieces = [t[k : k + CHUNK].ljust(CHUNK, "\0") for t in texts for k in range(0, max(1, len(t)), CHUNK)]
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(pieces), CHUNK)
    return codes, firsts


def slabs(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of ``SLAB`` characters or of one longer text."""
    out: list[str] = []
    held = 0
    for text in texts:
        if out and held + len(text) > SLAB:
            yield out
            out, held = [], 0
        out.append(text)
        held += max(CHUNK, len(text))
    if out:
        yield out


def tokenize(texts: list[str]) -> list[tuple[list[str] | None, int]]:
    """For each record its fields as written, or None and the offset at which its quoting fails."""
    if not texts:
        return []
    texts = [t.replace("\0", "�") for t in texts]
    codes, firsts = _chunks(texts)
    kinds = _classes(codes)
    n = len(kinds)
    # the transition function of every chunk: the end state for each start state
    states = np.tile(np.arange(len(_NEXT), dtype=np.uint8), (n, 1))
    width = int((kinds != END).sum(axis=1).max(initial=1))
    for k in range(width):
        states = _NEXT[states, kinds[:, k : k + 1]]
    # composition within records by doubling: after a step of d, a chunk's function covers the 2d chunks up to it
    rank = np.arange(n) - np.repeat(firsts[:-1], np.diff(firsts))
    step, upto = 1, states
    while step <= rank.max(initial=0):
        at = np.nonzero(rank >= step)[0]
        composed = upto.copy()
        composed[at] = np.take_along_axis(upto[at], upto[at - step].astype(np.intp), axis=1)
        step, upto = 2 * step, composed
    start = np.zeros(n, np.uint8)
    later = np.nonzero(rank)[0]
    start[later] = upto[later - 1, START]
    current, separator, failed = start.copy(), np.zeros(kinds.shape, bool), np.full(n, -1)
    for k in range(width):
        after = _NEXT[current, kinds[:, k]]
        separator[:, k] = (after == START) & (kinds[:, k] == COMMA)
        failed[(after == FAILED) & (current != FAILED)] = k
        current = after
    out: list[tuple[list[str] | None, int]] = []
    rows, columns = np.nonzero(separator)
    cuts = np.searchsorted(rows, firsts)
    for r, text in enumerate(texts):
        a, b = firsts[r], firsts[r + 1]
        if current[b - 1] in (FAILED, QUOTED):
            bad = next((i for i in range(a, b) if failed[i] >= 0), None)
            out.append((None, len(text) if bad is None else int((bad - a) * CHUNK + failed[bad])))
            continue
        at = (rows[cuts[r] : cuts[r + 1]] - a) * CHUNK + columns[cuts[r] : cuts[r + 1]]
        edges = [-1, *at.tolist(), len(text)]
        out.append(([text[i + 1 : j] for i, j in zip(edges, edges[1:], strict=False)], -1))
    return out


def _value(field: str) -> str:
    field = field.strip(_SPACES)
    return field[1:-1].replace('""', '"') if len(field) > 1 and field[0] == '"' else field


def read_records(texts: list[str]) -> list[tuple[list[str] | None, str | None, int]]:
    """For each record its twelve values, or the first reason why it fails and the offset of the offending place."""
    out: list[tuple[list[str] | None, str | None, int]] = []
    for fields, bad in (read for slab in slabs(texts) for read in tokenize(slab)):
        if fields is None:
            out.append((None, "QUOTING", bad))
            continue
        if len(fields) != len(COLUMNS):
            out.append((None, "COLUMNS", sum(map(len, fields)) + len(fields) - 1))
            continue
        values = [_value(f) for f in fields]
        offset = lambda k: sum(len(f) + 1 for f in fields[:k])  # noqa: E731, B023
        if not _AMOUNT.fullmatch(values[6].strip(_SPACES)):
            out.append((None, "AMOUNT", offset(6)))
        elif not _BALANCE.fullmatch(values[7].strip(_SPACES)):
            out.append((None, "BALANCE", offset(7)))
        elif values[5].strip(_SPACES) not in ("IN", "OUT", ""):
            out.append((None, "DIRECTION", offset(5)))
        else:
            out.append((values, None, -1))
    return out


def _read_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        read = read_records([t.lstrip("\ufeff").rstrip("\r") for t in texts])
        yield pd.DataFrame(read, columns=["fields", "reason", "at"])


def parse_records(df: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """``(key, fields, reason, at)`` of every record that is neither blank nor a header; ``reason`` is NULL for rows that load."""
    body = df.where((F.coalesce(F.col(number), F.lit(0)) != 1) & F.col(text).rlike("[^\\s　 ﻿]"))
    read = F.pandas_udf(_read_batches, "fields array<string>, reason string, at int")
    return body.select(key, read(F.col(text)).alias("r")).select(key, "r.fields", "r.reason", "r.at")


def valid_rows(parsed: DataFrame, key: str) -> DataFrame:
    """The rows that load, typed."""
    kept = parsed.where(F.col("reason").isNull())
    typed = {"amount": "decimal(18,2)", "balance": "decimal(18,2)"}
    columns = [F.trim(F.col("fields")[k]) for k in range(len(COLUMNS))]
    return kept.select(key, *((F.when(c != "", c).try_cast(typed[n]) if n in typed else c).alias(n) for n, c in zip(COLUMNS, columns, strict=True)))


def rejected_rows(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(key, "reason", "at")
