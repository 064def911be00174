"""Repeated fixed-length windows of a corpus: anchors, and an enhanced suffix array of what they leave open.

A window is ``window`` consecutive symbols (bytes or words). Every window is assigned to
its anchor, the run of ``gram`` symbols in it with the least hash; neighbouring windows
with one anchor form a superwindow. Equal windows have equal anchors at equal places, so

1. an anchor that occurs once has no repeated window,
2. an anchor whose superwindows are all equal (by 128 bits) repeats all its windows,
3. only anchors with different superwindows are open; those are compared symbol by symbol.

The work is one narrow row for each superwindow, not one for each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import _SPACE, _mix, _tables
from .common import materialize

#: Symbols scanned at once; what a task holds beside its batch is some twenty arrays of this length.
PIECE = 1 << 18
_LOW = np.uint64(PIECE - 1)
#: Anchors of more different superwindows than this are split by window content.
WIDE = 16
ROW = "d long, h long, start long, n int, off int, anchor long, c long, c2 long"
_COLUMNS = ["d", "h", "start", "n", "off", "anchor", "c", "c2"]
#: What a superwindow is known by: its anchor and 128 bits of its content, two hashes of different base.
KEY = ["anchor", "c", "c2"]


def superwindows(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """(start, number of windows, anchor's offset, anchor hash, two content hashes) of the superwindows of a piece.

    ``symbols`` (uint64, at most PIECE) holds texts end to end, with ends ``bounds``;
    starts are positions in it. The leftmost of equal least hashes is the anchor.
    """
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
    span = window - gram + 1
    if len(symbols) < window:
        return none
    power, inverse = _tables()
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * power[: len(symbols)], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(symbols) - gram + 1])
    m = len(grams)
    key = (grams & ~_LOW) | np.arange(m, dtype=np.uint64)
    rows = -(-m // span)
    padded = np.full(rows * span, np.uint64(2**64 - 1))
    padded[:m] = key
    grid = padded.reshape(rows, span)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - span + 1
    least = (np.minimum(backward[:count], forward[span - 1 : span - 1 + count]) & _LOW).astype(np.int64)
    ends = np.repeat(bounds, np.diff(np.concatenate([[0], bounds])))
    at = np.flatnonzero(np.arange(count) + window <= ends[:count])
    if not len(at):
        return none
    least = least[at]
    new = np.flatnonzero((np.diff(least) != 0) | (np.diff(at) != 1)) + 1
    first, stop = np.concatenate([[0], new]), np.concatenate([new, [len(at)]])
    start, n = at[first], stop - first
    end = start + n - 1 + window
    content = _mix((sums[end] - sums[start]) * inverse[start] + n.astype(np.uint64))
    return start, n, least[first] - start, grams[least[first]], content, _second(symbols, start, end)


_SECOND = np.uint64(0xD6E8FEB86659FD93)
_TABLES2: list[np.ndarray] = []


def _second(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of symbols[start:end] of another base, over mixed symbols."""
    if not _TABLES2:
        for base in (int(_SECOND), pow(int(_SECOND), -1, 1 << 64)):
            table = np.full(PIECE + 64, base, np.uint64)
            table[0] = 1
            _TABLES2.append(np.multiply.accumulate(table))
    power, inverse = _TABLES2
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols ^ (symbols >> np.uint64(29)) ^ np.uint64(0x5851F42D4C957F2D)) * power[: len(symbols)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _word_symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts that stand end to end in ``data`` (at most PIECE bytes), and the texts' ends counted in words."""
    power, inverse = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    word = ~_SPACE[data]
    after = np.zeros(len(data), bool)
    after[1:] = word[:-1]
    starts_text = np.concatenate([[0], bounds[:-1]])
    after[starts_text[starts_text < len(data)]] = False
    begin = np.flatnonzero(word & ~after)
    follows = np.ones(len(data), bool)
    follows[:-1] = ~(word[1:] & after[1:])
    end = np.flatnonzero(word & follows) + 1
    hashes = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, bounds)


def _long_word_symbols(text: bytes) -> np.ndarray:
    """The same hashes for a text of more than one piece, from pieces that end between words.

    A word longer than a piece has a hash of its own; one of a piece or less always has that of ``_word_symbols``.
    """
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        part = data[at : at + PIECE]
        if at + PIECE < len(data) and not _SPACE[data[at + PIECE]]:
            gaps = np.flatnonzero(_SPACE[part])
            if not len(gaps):
                stop = _word_end(data, at)
                out.append(np.array([xxhash.xxh64_intdigest(text[at:stop])], np.uint64))
                at = stop
                continue
            part = part[: gaps[-1] + 1]
        out.append(_word_symbols(part, np.array([len(part)]))[0])
        at += len(part)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _word_end(data: np.ndarray, at: int) -> int:
    """Where the word that holds ``at`` ends."""
    while at < len(data):
        gaps = np.flatnonzero(_SPACE[data[at : at + PIECE]])
        if len(gaps):
            return at + int(gaps[0])
        at += PIECE
    return len(data)


def symbols_of(text: bytes, unit: str) -> np.ndarray:
    """A whole text as symbols."""
    if unit == "bytes":
        return np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    if len(text) > PIECE:
        return _long_word_symbols(text)
    data = np.frombuffer(text, np.uint8)
    return _word_symbols(data, np.array([len(data)]))[0]


def _pieces(column: pa.Array, unit: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, ends, row of each text, symbols before it in its row) of pieces that hold whole texts or parts of one."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        part = data[offsets[i] : offsets[k]]
        if len(part) <= PIECE:
            bounds = offsets[i + 1 : k + 1] - offsets[i]
            if unit == "bytes":
                yield part.astype(np.uint64) + np.uint64(1), bounds, np.arange(i, k), np.zeros(k - i, np.int64)
            else:
                yield *_word_symbols(part, bounds), np.arange(i, k), np.zeros(k - i, np.int64)
        else:
            whole, back = symbols_of(part.tobytes(), unit), 1 << 10
            for a in range(0, max(1, len(whole) - back), PIECE - back):
                piece = whole[a : a + PIECE]
                yield piece, np.array([len(piece)]), np.array([i]), np.array([a])
        i = k


def scan(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """One row for each superwindow of docs(d, h, t): see ROW. Texts longer than a piece are cut with an overlap."""
    assert window <= 1 << 10

    def run(batches):
        for batch in batches:
            d, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            column = batch.column(2)
            column = column.cast(pa.binary()) if pa.types.is_large_binary(column.type) else column
            for symbols, bounds, row, before in _pieces(column, unit):
                start, n, off, anchor, c, c2 = superwindows(symbols, bounds, window, gram)
                if not len(start):
                    continue
                which = np.searchsorted(bounds, start, "right")
                begin = np.concatenate([[0], bounds[:-1]])[which]
                at = start - begin + before[which]
                r = row[which]
                if len(row) == 1 and before[0]:  # windows that lie in the overlap belong to the piece before
                    skip = np.maximum(0, (1 << 10) - window + 1 - start)
                    at, n, off = at + skip, n - skip, off - skip
                    keep = n > 0
                    cut = skip[keep] > 0
                    at, n, off, anchor, c, c2, r = (x[keep] for x in (at, n, off, anchor, c, c2, r))
                    if cut.any():  # the content of a superwindow cut short is that of what is left
                        b = at[cut] - before[0]
                        c[cut], c2[cut] = _content(symbols, b, n[cut], window), _second(symbols, b, b + n[cut] - 1 + window)
                arrays = [pa.array(d[r]), pa.array(h[r]), pa.array(at), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(c.view(np.int64)), pa.array(c2.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, _COLUMNS)

    return docs.select("d", "h", "t").mapInArrow(run, ROW)


def _content(symbols: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    power, inverse = _tables()
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * power[: len(symbols)], out=sums[1:])
    return _mix((sums[start + n - 1 + window] - sums[start]) * inverse[start] + n.astype(np.uint64))


def maximal_repeats(texts: list[bytes], windows: list[int], depth: int, step: int = 1) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences (text, window)) of the maximal repeats of at least ``depth`` bytes.

    An enhanced suffix array: the suffixes at the texts' windows in sorted order, with the
    length of the prefix that each shares with the one before. One scan with a stack
    finds the intervals of a common prefix, that is the nodes of the interval tree; one
    is reported with all its occurrences if these can't all be extended to the left by
    the same symbol. ``step`` is the bytes of a symbol.
    """
    suffixes = sorted((t[w * step :], i, w) for i, t in enumerate(texts) for w in range(windows[i]))
    shared = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:], strict=False):
        shared.append(_common(a, b, depth) // step * step)
    shared.append(0)
    stack: list[tuple[int, int]] = []  # (length, left end)
    for i in range(1, len(shared)):
        left = i - 1
        while stack and stack[-1][0] > shared[i]:
            length, left = stack.pop()
            if (group := _diverse(texts, suffixes[left:i], step)) is not None:
                yield length, group
        if shared[i] >= depth and (not stack or stack[-1][0] < shared[i]):
            stack.append((shared[i], left))


def _common(a: bytes, b: bytes, depth: int) -> int:
    """Length of the common prefix, or 0 if that is below depth."""
    if a[:depth] != b[:depth]:
        return 0
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def _diverse(texts: list[bytes], members: list[tuple], step: int) -> list[tuple[int, int]] | None:
    before = {texts[i][(w - 1) * step : w * step] if w else None for _, i, w in members}
    if len(before) == 1 and None not in before:
        return None
    return [(i, w) for _, i, w in members]


def _runs(best: np.ndarray) -> list[dict]:
    """(w, n, d) of the runs of equal values of ``best`` that aren't the largest long."""
    edges = np.flatnonzero(np.diff(best)) + 1
    out = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(best)], strict=True):
        if best[a] != _NONE:
            out.append({"w": a, "n": b - a, "d": int(best[a])})
    return out


_NONE = np.iinfo(np.int64).max
_RUNS = "array<struct<w:int,n:int,d:long>>"
_RUNS_ARROW = pa.list_(pa.struct([("w", pa.int32()), ("n", pa.int32()), ("d", pa.int64())]))


def settle(contents: DataFrame, window: int, step: int, distinct_docs: bool) -> DataFrame:
    """(anchor, c, c2, runs): which windows of each open superwindow are repeated, and the least document that has them.

    ``contents`` has each different superwindow of the open anchors once: KEY, count, d, n
    and content in bytes, ``step`` a symbol. The intervals of a common prefix that are at
    least a window deep lie in the subtree of one window's content. Anchors of up to WIDE
    superwindows are one suffix array each; those of more are split into these subtrees by
    a 128-bit digest of the window, whose roots are summed before they are shuffled, so no
    task holds a large anchor. Both give the same: a window is repeated if its subtree has
    two occurrences, or, with ``distinct_docs``, by the least document in it. An empty table
    gives an empty table.
    """
    depth = window * step
    narrow, wide = _by_width(contents)
    narrow = narrow.repartition("anchor").sortWithinPartitions("anchor", "c", "c2")

    def compare(batches):
        out = []
        for group in _anchors(batches):
            out += _settle_group(group, depth, step, distinct_docs)
            if len(out) > 4096:
                yield _resolved(out)
                out = []
        yield _resolved(out)

    cold = narrow.select(*KEY, "count", "d", "n", "content").mapInArrow(compare, f"anchor long, c long, c2 long, runs {_RUNS}")
    rows = wide.select(*KEY, "count", "d", "n", "content").mapInArrow(_subtrees(depth, step, False), _SUBTREE)
    same = rows.groupBy("p", "q").agg(F.sum("count").alias("_n"), F.min("d").alias("_d"))
    same = same if distinct_docs else same.where("_n > 1")
    hit = rows.join(same, ["p", "q"]).select(*KEY, F.struct("w", F.lit(1).alias("n"), F.col("_d").alias("d")).alias("run"))
    hot = hit.groupBy(*KEY).agg(F.collect_list("run").alias("runs"))
    return cold.union(hot)


_SUBTREE = "anchor long, c long, c2 long, count long, d long, w int, p long, q long"


def _by_width(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The superwindows of anchors that fit one suffix array, and those of anchors that are split."""
    many = materialize(contents.groupBy("anchor").agg(F.count("*").alias("_m")).where(F.col("_m") > WIDE).select("anchor"), "wide-anchors")
    return contents.join(many, "anchor", "left_anti"), contents.join(many, "anchor", "left_semi")


def _anchors(batches):
    """The rows of each anchor, whole; rows come sorted by it."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if group and group[0][0] != row[0]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _subtrees(depth: int, step: int, whole: bool):
    """One row for each window of a superwindow, with the digest of the window: the root of its subtree.

    With ``whole`` also the symbol before the window (null for a superwindow's first) and
    what follows it.
    """

    def split(batches):
        for batch in batches:
            anchor, c, c2, count, d, n, content = (x.to_pylist() for x in batch.columns)
            for i in range(len(anchor)):
                k, t = n[i], content[i]
                digests = b"".join(xxhash.xxh3_128_digest(t[w * step : w * step + depth]) for w in range(k))
                pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
                full = lambda x: pa.array(np.full(k, x, np.int64))  # noqa: B023, E731
                arrays = [full(anchor[i]), full(c[i]), full(c2[i]), full(count[i]), full(d[i]), pa.array(np.arange(k, dtype=np.int32)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())]
                names = ["anchor", "c", "c2", "count", "d", "w", "p", "q"]
                if whole:
                    arrays += [pa.array([t[(w - 1) * step : w * step] if w else None for w in range(k)], pa.binary()), pa.array([t[w * step + depth :] for w in range(k)], pa.binary())]
                    names += ["before", "rest"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return split


def _resolved(rows: list[tuple]) -> pa.RecordBatch:
    anchor, c, c2, runs = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor, c, c2)] + [pa.array(runs, _RUNS_ARROW)], [*KEY, "runs"])


def _settle_group(group: list[tuple], depth: int, step: int, distinct_docs: bool) -> list[tuple]:
    texts, windows = [g[6] for g in group], [g[5] for g in group]
    best = [np.full(n, g[4] if distinct_docs or g[3] > 1 else _NONE, np.int64) for g, n in zip(group, windows, strict=True)]
    for length, members in maximal_repeats(texts, windows, depth, step):
        d, reach = min(group[i][4] for i, _ in members), (length - depth) // step + 1
        for i, w in members:
            part = best[i][w : w + reach]
            np.minimum(part, d, out=part)
    return [(*g[:3], runs) for g, b in zip(group, best, strict=True) if (runs := _runs(b))]


_GROUP = "anchor long, c long, c2 long, w int, length int, grp long"


def repeat_intervals(contents: DataFrame, window: int, step: int) -> DataFrame:
    """(KEY, w, length, grp): the maximal repeats among the superwindows of ``contents``, one row for each place in a superwindow.

    A repeat is an interval of the suffix array at least a window deep whose places are not
    all preceded by one symbol; it has ``length`` symbols. A superwindow that alone has its
    content and occurs twice (``count``) is one repeat as a whole. Large anchors are split
    into the subtrees of their windows, scanned as they come sorted.
    """
    depth = window * step
    narrow, wide = _by_width(contents)
    narrow = narrow.repartition("anchor").sortWithinPartitions("anchor", "c", "c2")

    def rows_of(found) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [*KEY, "w", "length", "grp"])

    def name(text: bytes) -> int:
        return int.from_bytes(xxhash.xxh3_64_digest(text), "little", signed=True)

    def scan_arrays(batches):
        for rows in _anchors(batches):
            group = list({g[:3]: g for g in rows}.values())  # documents repeated as a whole give their contents again
            texts, windows = [g[6] for g in group], [g[5] for g in group]
            found = []
            for length, members in maximal_repeats(texts, windows, depth, step):
                i, w = members[0]
                grp = name(texts[i][w * step : w * step + length])
                found += [(*group[i][:3], w, length // step, grp) for i, w in members]
            # what occurs twice as a whole is a repeat of its own, if no longer one has all its places
            found += [(*g[:3], 0, len(g[6]) // step, name(g[6])) for g in group if g[3] > 1]
            yield rows_of(sorted(set(found)))

    def scan_subtrees(batches):
        root, held = None, []
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if root is not None and row[:2] != root:
                    yield rows_of(_subtree(held, depth, step))
                    held = []
                root = row[:2]
                held.append(row[2:])
        if held:
            yield rows_of(_subtree(held, depth, step))

    split = wide.select(*KEY, "count", "d", "n", "content").mapInArrow(_subtrees(depth, step, True), _SUBTREE + ", before binary, rest binary")
    split = split.select("p", "q", *KEY, "w", "count", "before", "rest").repartition("p", "q").sortWithinPartitions("p", "q", "rest")
    small = narrow.select(*KEY, "count", "d", "n", "content").mapInArrow(scan_arrays, _GROUP)
    return small.union(split.mapInArrow(scan_subtrees, _GROUP))


def _subtree(rows: list[tuple], depth: int, step: int) -> list[tuple]:
    """The maximal repeats of one window's subtree; rows (KEY, w, count, before, rest) come sorted by rest."""
    rows = list({r[:4]: r for r in rows}.values())
    found, seen = [], xxhash.xxh3_64()
    seen.update(repr((rows[0][:4], len(rows))))
    shared = [0] + [depth + _common_bytes(a[6], b[6]) // step * step for a, b in zip(rows, rows[1:], strict=False)] + [0]
    stack: list[tuple[int, int]] = []
    for i in range(1, len(shared)):
        left = i - 1
        own = depth + len(rows[left][6])
        if rows[left][3] == 0 and rows[left][4] > 1 and shared[i] < own:  # occurs twice as a whole, and nowhere within another
            found.append((*rows[left][:4], own // step, _grp(seen, left, left, -1)))
        while stack and stack[-1][0] > shared[i]:
            length, left = stack.pop()
            before = {r[5] for r in rows[left:i]}
            if len(before) > 1 or None in before:
                found += [(*r[:4], length // step, _grp(seen, left, i, length)) for r in rows[left:i]]
        if shared[i] >= depth and (not stack or stack[-1][0] < shared[i]):
            stack.append((shared[i], left))
    return found


def _grp(seen, left: int, right: int, length: int) -> int:
    h = seen.copy()
    h.update(repr((left, right, length)))
    return int.from_bytes(h.digest(), "little", signed=True)


def _common_bytes(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def contents_of(docs: DataFrame, places: DataFrame, unit: str, window: int) -> DataFrame:
    """(KEY, count, d, n, content) of places(d, h, start, n, KEY, count, d0), cut from docs(d, h, t).

    Words are their 64-bit hashes, eight bytes each. Null texts are not allowed; an empty
    table gives an empty table.
    """
    wanted = places.groupBy("d", "h").agg(F.collect_list(F.struct("start", "n", *KEY, "count", "d0")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                data = raw if unit == "bytes" else symbols_of(raw, unit).astype(">u8").tobytes()
                step = 1 if unit == "bytes" else 8
                for p in wanted.as_py():
                    end = p["start"] + p["n"] - 1 + window
                    out.append((p["anchor"], p["c"], p["c2"], p["count"], p["d0"], p["n"], data[p["start"] * step : end * step]))
                if len(out) > 8192:
                    yield _contents(out)
                    out = []
            yield _contents(out)

    return docs.join(wanted, ["d", "h"]).select("t", "wanted").mapInArrow(cut, "anchor long, c long, c2 long, count long, d long, n int, content binary")


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [*KEY, "count", "d", "n", "content"])


def cover(runs: list[dict], window: int) -> list[list[int]]:
    """Maximal [from, to) that the windows of runs (s, n) cover, touching ones joined."""
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["s"] + r["n"] - 1 + window) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out
