"""Collection Burrows-Wheeler transform with common prefixes, built column by column.

All strings of a collection are inserted together from their last symbol on: each round puts one
symbol of every unfinished string in front of its suffix and inserts the longer suffixes into the
sorted table of all suffixes so far. The table is never sorted. Where a suffix goes follows from
the transform (its row's symbol c, counted up to the row, plus the start of c's segment), and so
do the common prefixes: between two consecutive rows of symbol c they are one more than the
least value in between, which is what a round computes for the new rows and those next to them.

The two columns (symbol, common prefix with the row above) live in files that each round reads and
rewrites from front to end, ``CHUNK`` rows at a time. A file stays in memory up to ``SPOOL`` bytes and
goes to the task's scratch space beyond; it has no name and vanishes with the task. Which string a
row belongs to is not kept: the finished transform tells, followed from the string ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import numpy as np

CHUNK = 1 << 20
SPOOL = 1 << 24
TYPES = {"symbol": np.uint8, "lcp": np.uint8}


class Table:
    """The two columns as sequential files."""

    def __init__(self) -> None:
        self.files = {c: SpooledTemporaryFile(max_size=SPOOL) for c in TYPES}
        self.rows = 0

    def append(self, **columns: np.ndarray) -> None:
        for c, values in columns.items():
            self.files[c].write(np.ascontiguousarray(values, TYPES[c]).data)
        self.rows += len(values)

    def rewind(self) -> None:
        for f in self.files.values():
            f.seek(0)

    def read(self, column: str, rows: int) -> np.ndarray:
        return np.frombuffer(self.files[column].read(rows * np.dtype(TYPES[column]).itemsize), TYPES[column])

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _targets(table: Table, new_rows: np.ndarray, strings: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scan symbols and prefixes: where the new rows' extensions go, and all prefixes that change.

    Returns (target, string) of the new suffixes and (target, lcp) of the changed prefixes, both ascending.
    """
    table.rewind()
    seen = np.zeros(256, np.int64)
    least = np.full(256, 255, np.uint8)  # of the prefixes since a symbol's last row
    last_new = np.zeros(256, bool)
    inserted, who, changed, values = [], [], [], []
    done = 0
    for at in range(0, table.rows, CHUNK):
        n = min(CHUNK, table.rows - at)
        symbol, lcp = table.read("symbol", n), np.append(table.read("lcp", n), np.uint8(255))
        end = done + int(np.searchsorted(new_rows[done:], at + n))
        fresh = np.zeros(n, bool)
        fresh[new_rows[done:end] - at] = True
        order = np.argsort(symbol, kind="stable")
        counts = np.bincount(symbol, minlength=256)
        stop = np.cumsum(counts)
        first = stop - counts
        new = np.flatnonzero(fresh[order])
        after = new + 1
        after = after[after < stop[symbol[order[new]]]]  # the next row of the same symbol
        opened = first[(counts > 0) & last_new]
        need = np.sort(np.concatenate([new, after, opened]))
        need = need[np.append(True, need[1:] != need[:-1])[:len(need)]]
        need = need[np.searchsorted(need, counts[0]):]  # not the finished strings
        row = order[need]
        c = symbol[row].astype(np.int64)
        target = begin[c] + seen[c] + need - first[c]
        is_first = need == first[c]
        low = np.where(is_first, 0, order[need - 1] + 1)
        if len(need):
            bounds = np.empty(2 * len(need), np.int64)
            bounds[0::2], bounds[1::2] = low, row + 1
            value = np.minimum.reduceat(lcp, bounds)[::2]
            value = np.where(is_first, np.where(seen[c] > 0, np.minimum(value, least[c]).astype(np.int64) + 1, 0), value.astype(np.int64) + 1)
            changed.append(target)
            values.append(value.astype(np.uint8))
            own = fresh[row]
            inserted.append(target[own])
            who.append(strings[done:end][np.searchsorted(new_rows[done:end] - at, row[own])])
        if at + n < table.rows:
            here = np.flatnonzero(counts)
            back = np.minimum.accumulate(lcp[::-1])[::-1]
            ends = order[stop[here] - 1]
            least = np.minimum(least, lcp[:n].min())
            least[here] = back[ends + 1]
            last_new[here] = fresh[ends]
        seen += counts
        done = end
    if not changed:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint32), none, np.empty(0, np.uint8)
    a, b, c, d = (np.concatenate(x) for x in (inserted, who, changed, values))
    if table.rows > CHUNK:
        i, j = np.argsort(a, kind="stable"), np.argsort(c, kind="stable")
        a, b, c, d = a[i], b[i], c[j], d[j]
    return a, b, c, d


def _merged(table: Table, target: np.ndarray, symbols: np.ndarray, changed: np.ndarray, values: np.ndarray) -> Table:
    """The table with the new rows inserted and prefixes changed: one sequential pass."""
    table.rewind()
    out = Table()
    total = table.rows + len(target)
    i = j = 0
    for at in range(0, total, CHUNK):
        n = min(CHUNK, total - at)
        i_end = i + int(np.searchsorted(target[i:], at + n))
        j_end = j + int(np.searchsorted(changed[j:], at + n))
        old = np.ones(n, bool)
        put = target[i:i_end] - at
        old[put] = False
        columns = {}
        for c, new in (("symbol", symbols[i:i_end]), ("lcp", 0)):
            column = np.empty(n, TYPES[c])
            column[put] = new
            column[old] = table.read(c, n - len(put))
            columns[c] = column
        columns["lcp"][changed[j:j_end] - at] = values[j:j_end]
        out.append(**columns)
        i, j = i_end, j_end
    table.close()
    return out


def build(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Table:
    """The table of all suffixes of the strings ``data[starts:starts + sizes]`` (at most 250 bytes each, none 0xFF)."""
    data = np.where(data == 0, np.uint8(255), data)  # 0 marks the front of a string; UTF-8 has no 0xFF
    ends = starts + sizes
    strings = np.arange(len(starts), dtype=np.uint32)
    symbols = data[ends - 1]
    table = Table()
    table.append(symbol=symbols, lcp=np.zeros(len(starts)))
    counts = np.bincount(symbols, minlength=256)
    rows = np.arange(len(starts))
    size = 0
    while len(rows):
        size += 1
        begin = len(starts) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        target, strings, changed, values = _targets(table, rows, strings, begin)
        left = sizes[strings] > size
        symbols = np.where(left, data[np.maximum(ends[strings] - 1 - size, 0)], 0).astype(np.uint8)
        table = _merged(table, target, symbols, changed, values)
        counts += np.bincount(symbols, minlength=256)
        counts[0] = 0
        rows, strings = target[left], strings[left]
    return table


def locate(table: Table, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, strings, rows): where the suffixes of each length are, by following the transform."""
    table.rewind()
    symbol = table.read("symbol", table.rows)
    order = np.argsort(symbol, kind="stable")
    ends = int(np.searchsorted(symbol[order], 1))  # rows that hold a whole string
    following = np.empty(table.rows, np.int64)
    following[order[ends:]] = np.arange(len(sizes), len(sizes) + table.rows - ends)
    strings = rows = np.arange(len(sizes))
    for length in range(int(sizes.max()) + 1):
        yield length, strings, rows
        left = sizes[strings] > length
        strings = strings[left]
        rows = following[rows[left]]


def intervals(table: Table, length: int) -> np.ndarray:
    """The number of each row's interval of common prefixes of at least ``length`` symbols."""
    table.rewind()
    parts, last = [], -1
    for at in range(0, table.rows, CHUNK):
        n = min(CHUNK, table.rows - at)
        parts.append(last + np.cumsum(table.read("lcp", n) < length))
        last = int(parts[-1][-1])
    return np.concatenate(parts).astype(np.int32)
