"""Suffix-array dedup: repeated byte strings found by a distributed merge sort of front-coded runs.

A byte is removed if a string of LENGTH bytes that covers it also starts in a
document with a smaller doc_id.  Sorting all suffixes would move many times the
input, so suffixes are first thinned without loss:

0. Texts that equal a smaller document's are covered whole.
1. Winnowing.  Every window of LENGTH bytes names the least hash among its
   GRAM-byte grams (the leftmost of equals) as its anchor.  Equal windows have equal anchors at equal
   places.  Consecutive windows with one anchor form a stretch, about one for
   every 14 bytes.  Only stretches whose anchor gram occurs in two documents can
   repeat; tasks first find those among their own documents, and one entry a
   gram and task goes to the bucket that decides the rest.
2. Stretches, written from their anchor on, are sorted in each task; equal ones
   collapse to those of the smallest doc_id (the others are covered).  Runs are front-coded
   (shared prefix lengths, rests) and dealt out by ranges of strings.  A part's
   pieces of runs are merged by a stable sort, up to JOINED strings; a usual part
   has fewer.  In larger ones such merged runs meet in a loser tree that keeps each
   loser's common prefix with the last winner and never compares a byte of it
   again.  Equal stretches meet; all but the smallest doc_id are covered.
3. Different stretches with one anchor gram stand next to each other in that
   order.  Only they can share some of their windows; the windows that end inside
   what a stretch has in common with a neighbour are sorted and merged the same way.
   The first and the last stretch of a part, whose neighbours stand in other
   parts, send all their windows on.

Scale: a string common to a third of all documents is one entry per task in
every exchange.  Texts travel compressed, twice.  A part is a range of strings,
so a gram that stands in many different contexts is split over parts like any
other; beyond RANGES ranges strings are dealt out by a hash of their first bytes
too.  Parts are sized by entries (PART), so a task's memory does not follow the
session's shuffle partitions.  Pieces of runs grow in number with the square of
the input and get shorter, so all pieces that a task writes are coded at once,
and a part's pieces are decoded at once and joined up to JOINED strings; only
such joined runs meet in the loser tree, whose width is thus that of a part, not
of the input.  Splitters come from a sample of the sorted strings themselves,
DRAWS a range; they steer balance, not results.

Defined cases: null text is empty; texts shorter than LENGTH bytes lose nothing;
a null doc_id neither covers nor loses bytes; rows that repeat a doc_id do not
cover each other; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelith.llm.shared import materialize, whole_text
from cinelith.llm.text import mix, slices

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams in a window, and at most windows in a stretch
WIDE = LENGTH + SPAN + 1  # a stretch's bytes, then where its left part begins, then its size
PART = 200_000  # entries of a part of a sort
SORTED = 1 << 24  # bytes of strings that a task sorts at once
JOINED = 1 << 18  # entries that pieces of runs are joined to before the loser tree merges them
BUCKET_BYTES = 8 << 20  # bytes of text whose grams make a bucket
RANGES = 4096
DRAWS = 32
SLICE = 1 << 16  # bytes of text worked on at once (one text at least); the hashes of more leave the CPU's cache
_HOLD = 600_000
_ROWS = 16_384
_BASE = np.uint64(0x9E3779B97F4A7C15)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_SPREAD, _HIGH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the gram that starts at each byte, put together from grams that are powers of two long."""
    h, size, factor = _BYTE[data], 1, np.array([_BASE])
    whole, held, shift = None, 0, np.array([1], np.uint64)
    while size <= gram:
        if gram & size:
            whole = h if whole is None else whole[: len(data) - held - size + 1] + h[held:] * shift
            held, shift = held + size, shift * factor
        h = h[: max(len(h) - size, 0)] + h[size:] * factor
        size, factor = size * 2, factor * factor
    return whole


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, anchor, first window, last window) of each stretch; places are in data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none, none
    value = gram_hashes(data)
    # 32 bits of hash above 32 bits of place: the least of these is the leftmost least hash
    best = (value * _SPREAD & _HIGH) | np.arange(len(value), dtype=np.uint64)
    size = 1
    while size < SPAN:
        step = min(size, SPAN - size)
        best = np.minimum(best[: len(best) - step], best[step:])
        size += step
    at = best.astype(np.uint32)
    n = len(best)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + LENGTH <= offsets[row + 1]
    first = inside.copy()
    first[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    lo = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~inside[1:]
    hi = np.flatnonzero(last)
    anchor = at[lo].astype(np.int64)
    return row[lo], mix(value[anchor]), anchor, lo, hi


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, text): rk is a hash of both, equal rows share it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")


def compressed(rows: DataFrame) -> DataFrame:
    """(rk, doc_id, z binary)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [tool.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), pa.array(z, pa.binary())], ["rk", "doc_id", "z"])

    return rows.mapInArrow(pack, "rk bigint, doc_id bigint, z binary")


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """slices() of the decompressed texts of a batch of compressed()."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    packed = b.column("z")
    lo = 0
    while lo < len(packed):
        texts, held = [], 0
        while lo + len(texts) < len(packed) and (not texts or held < SLICE):
            texts.append(tool.decompress(packed[lo + len(texts)].as_py()))
            held += len(texts[-1])
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        yield lo, lo + len(texts), np.frombuffer(b"".join(texts), np.uint8), offsets
        lo += len(texts)


def _plane_places(cuts: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's first byte stands in the planes of its cut, and how far its other bytes are from each other."""
    n = np.diff(cuts)
    return np.arange(cuts[-1]) + (wide - 1) * np.repeat(cuts[:-1], n), np.repeat(n, n)


def _planes(a: np.ndarray, cuts: np.ndarray, skip: int = 0) -> bytes:
    """The bytes of each cut of a, all first bytes together and so on (such columns compress), without the lowest `skip`."""
    rows = a.view(np.uint8).reshape(len(a), -1)[:, skip:]
    at, step = _plane_places(cuts, rows.shape[1])
    out = np.empty(rows.size, np.uint8)
    for b in range(rows.shape[1]):
        out[at + b * step] = rows[:, b]
    return out.tobytes()


def _unplanes(raw: bytes, cuts: np.ndarray, kind: type, skip: int = 0) -> np.ndarray:
    flat, wide = np.frombuffer(raw, np.uint8), np.dtype(kind).itemsize
    table = np.zeros((cuts[-1], wide), np.uint8)
    at, step = _plane_places(cuts, wide - skip)
    for b in range(wide - skip):
        table[:, skip + b] = flat[at + b * step]
    return table.view(kind).ravel()


def _pieces(columns: list[tuple[bytes, np.ndarray]]) -> list[bytes]:
    """A binary for each cut: what each column, given with its cuts in bytes, has of it."""
    views = [[view[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for view, cuts in ((memoryview(raw), cuts.tolist()) for raw, cuts in columns)]
    return [b"".join(piece) for piece in zip(*views, strict=True)]


def packed(cuts: np.ndarray, rk: np.ndarray, doc: np.ndarray | None, *columns: tuple[np.ndarray, int]) -> list[bytes]:
    """A binary for each cut of the rows: sizes, each rk (and its doc) once, the columns as byte planes.

    All cuts are packed at once, as there are many small ones in large inputs.
    columns are given with the number of lowest bytes to leave out.
    """
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((rk, owner))
    sorted_rk = rk[order]
    fresh = np.append(True, (sorted_rk[1:] != sorted_rk[:-1]) | (owner[1:] != owner[:-1]))
    who = order[fresh]
    whose = np.searchsorted(owner[fresh], np.arange(len(cuts)))
    place = np.empty(len(rk), np.uint32)
    place[order] = np.cumsum(fresh) - 1 - whose[owner]
    heads = np.stack([np.diff(cuts), np.diff(whose)], 1).astype(np.int64)
    parts = [(heads.tobytes(), 16 * np.arange(len(cuts))), (rk[who].tobytes(), 8 * whose)]
    if doc is not None:
        parts.append((doc[who].tobytes(), 8 * whose))
    for column, skip in ((place, 0), *columns):
        column = np.ascontiguousarray(column)
        parts.append((_planes(column, cuts, skip), (column.itemsize - skip) * cuts))
    return _pieces(parts)


def unpacked(raws: list[bytes], with_doc: bool, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """[rk, doc if there, each column] of the rows of all raws, one behind the other."""
    n, docs = np.frombuffer(b"".join([r[:16] for r in raws]), np.int64).reshape(-1, 2).T
    cuts, at = np.append(0, np.cumsum(n)), np.full(len(raws), 16)

    def section(size: np.ndarray) -> bytes:
        nonlocal at
        lo, at = at, at + size
        return b"".join([r[a:b] for r, a, b in zip(raws, lo.tolist(), at.tolist(), strict=True)])

    known = [np.frombuffer(section(8 * docs), np.int64) for _ in range(1 + with_doc)]
    place = _unplanes(section(4 * n), cuts, np.uint32) + np.repeat(np.cumsum(docs) - docs, n)
    return [k[place] for k in known] + [_unplanes(section((np.dtype(kind).itemsize - skip) * n), cuts, kind, skip) for kind, skip in kinds]


def _per_row(rk: np.ndarray, number: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(rk, list of numbers)."""
    order = np.argsort(rk, kind="stable")
    rk = rk[order]
    starts = np.flatnonzero(np.append(True, rk[1:] != rk[:-1]))
    return pa.array(rk[starts]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(rk)).astype(np.int32)), pa.array(number[order].astype(np.int32)))


def shared_stretches(rows: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """(rk, picks array<int>): numbers of each row's stretches whose anchor gram occurs in two documents.

    Rows whose rk is in copies are left out.
    Grams are told apart by their upper 48 bits; a chance meeting only adds a candidate.
    """
    names = ["bucket", "entries", "rk", "picks"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> Iterator[pa.RecordBatch]:
            gram, doc, rk, number = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            order = np.argsort(gram, kind="stable")
            gram, doc, rk, number = gram[order], doc[order], rk[order], number[order].astype(np.int32)
            starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            known = np.repeat(several, np.diff(starts, append=len(gram)))
            if known.any():
                at, lists = _per_row(rk[known], number[known])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at), dtype=np.int32) % buckets), pa.nulls(len(at), pa.binary()), at, lists], names)
            # of grams of one document all places go on, of others one (numbered -1) that stands for all
            number[known] = -1
            keep = ~known
            keep[starts] = True
            gram, doc, rk, number = gram[keep], doc[keep], rk[keep], number[keep]
            bucket = gram // np.uint64(-(-(1 << 64) // buckets))
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            entries = packed(np.append(edges, len(gram)), rk, doc, (gram, 2), (number, 0))
            n = len(entries)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(entries, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names)

        for b in batches:
            doc_ids, keys = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("rk").to_numpy()
            for lo, hi, data, offsets in slices(b.column("text"), SLICE):
                row, gram, _, _, _ = stretches(data, offsets)
                if not len(row):
                    continue
                starts = np.searchsorted(row, np.arange(hi - lo))
                held.append((gram & ~np.uint64(0xFFFF), doc_ids[lo:hi][row].astype(np.int64), keys[lo:hi][row], np.arange(len(row)) - starts[row]))
                if sum(len(h[0]) for h in held) > _HOLD:
                    yield from emit()
        if held:
            yield from emit()

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            rk, doc, gram, number = unpacked(held, True, (np.uint64, 2), (np.int32, 0))
            order = np.argsort(gram, kind="stable")
            gram, doc, rk, number = gram[order], doc[order], rk[order], number[order]
            starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (np.minimum.reduceat(number, starts) < 0)
            out = np.repeat(several, np.diff(starts, append=len(gram))) & (number >= 0)
            if out.any():
                yield from directed(rk[out], number[out])

        def directed(rk: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Picks by where their row will gather them: a row for each target."""
            target = rk % buckets
            order = np.argsort(target, kind="stable")
            target = target[order]
            edges = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            raw = packed(np.append(edges, len(target)), rk[order], None, (number[order], 0))
            yield pa.RecordBatch.from_arrays([pa.array(target[edges].astype(np.int32)), pa.array(raw, pa.binary())], ["target", "raw"])

        sure: list[tuple] = []
        for b in batches:
            mine = b.column("rk").is_valid()
            lists = b.column("picks").filter(mine)
            if len(lists):
                sure.append((np.repeat(b.column("rk").filter(mine).to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()))
                if sum(len(x[0]) for x in sure) > _HOLD:
                    yield from directed(*map(np.concatenate, zip(*sure, strict=True)))
                    sure.clear()
            for k, entries in zip(b.column("bucket").to_pylist(), b.column("entries"), strict=True):
                if not entries.is_valid:
                    continue
                if k != bucket:
                    if held:
                        yield from close()
                    bucket, held = k, []
                held.append(entries.as_py())
        if held:
            yield from close()
        if sure:
            yield from directed(*map(np.concatenate, zip(*sure, strict=True)))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            rk, number = unpacked(held, False, (np.int32, 0))
            order = np.lexsort((number, rk))
            rk, number = rk[order], number[order]
            fresh = np.append(True, (rk[1:] != rk[:-1]) | (number[1:] != number[:-1]))
            yield pa.RecordBatch.from_arrays(list(_per_row(rk[fresh], number[fresh])), ["rk", "picks"])

        for b in batches:
            for k, raw in zip(b.column("target").to_pylist(), b.column("raw").to_pylist(), strict=True):
                if k != target:
                    if held:
                        yield from close()
                    target, held = k, []
                held.append(raw)
        if held:
            yield from close()

    known = rows.where("doc_id IS NOT NULL").mapInArrow(local, "bucket int, entries binary, rk bigint, picks array<int>")
    sent = known.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(decided, "target int, raw binary")
    picks = sent.repartition("target").sortWithinPartitions("target").mapInArrow(gathered, "rk bigint, picks array<int>")
    return picks.join(copies.select("rk").distinct(), "rk", "left_anti")


def stretch_strings(data: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows of WIDE bytes: from the anchor to the end, then from the start to the anchor, then sizes."""
    size, right = hi + LENGTH - lo, hi + LENGTH - anchor
    column = np.arange(WIDE - 2, dtype=np.int32)
    place = np.where(column < right.astype(np.int32)[:, None], anchor.astype(np.int32)[:, None], (lo - right).astype(np.int32)[:, None]) + column
    out = np.zeros((len(lo), WIDE), np.uint8)
    np.multiply(data.take(place, mode="clip"), column < size.astype(np.int32)[:, None], out=out[:, :-2])
    out[:, -2], out[:, -1] = right, size
    return out


def unrotated(string: bytes) -> bytes:
    right, size = string[-2], string[-1]
    return string[right:size] + string[:right]


def common_prefixes(table: np.ndarray) -> np.ndarray:
    """What each row shares with the one before (the first row: 0)."""
    out = np.zeros(len(table), np.uint8)
    for lo in range(1, len(table), _ROWS):
        rows = table[lo : lo + _ROWS]
        differ = rows != table[lo - 1 : lo - 1 + len(rows)]
        out[lo : lo + _ROWS] = np.where(differ.any(1), differ.argmax(1), table.shape[1])
    return out


def front_coded_cuts(table: np.ndarray, shared: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """front_coded() of each cut; shared is common_prefixes() of all rows."""
    width = table.shape[1]
    shared = shared.copy()
    shared[cuts[:-1]] = 0
    rests = b"".join([table[lo : lo + _ROWS][np.arange(width) >= shared[lo : lo + _ROWS, None]].tobytes() for lo in range(0, len(table), _ROWS)])
    ends = np.append(0, np.cumsum(width - shared.astype(np.int64)))
    return _pieces([(np.diff(cuts).astype("<u4").tobytes(), 4 * np.arange(len(cuts))), (shared.tobytes(), cuts), (rests, ends[cuts])])


def front_coded(table: np.ndarray) -> bytes:
    """Sorted rows: their number, each one's shared prefix length, then the rests."""
    return front_coded_cuts(table, common_prefixes(table), np.array([0, len(table)]))[0]


class Run:
    """A front-coded run, decoded `block` strings at a time."""

    def __init__(self, coded: bytes, width: int, block: int = 1024):
        self.coded, self.width, self.block = np.frombuffer(coded, np.uint8), width, block
        self.n = int.from_bytes(coded[:4], "little")
        self.row, self.at, self.last = 0, 4 + self.n, np.zeros((1, width), np.uint8)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The next strings as rows of bytes, and what each shares with the one before; empty at the end."""
        shared = self.coded[4 + self.row : 4 + min(self.row + self.block, self.n)]
        self.row += len(shared)
        ends = np.cumsum(self.width - shared.astype(np.int64))
        # a byte that is not written again is that of the last row that wrote its column
        written = np.append(0, ends)[:-1] + self.at - shared
        columns = np.empty((self.width, len(shared)), np.uint8)
        for c in range(self.width if len(shared) else 0):
            at = np.flatnonzero(shared <= c)
            before = at[0] if len(at) else len(shared)
            columns[c, :before] = self.last[0, c]
            columns[c, before:] = np.repeat(self.coded[written[at] + c], np.diff(at, append=len(shared))) if len(at) < len(shared) else self.coded[written + c]
        table = np.ascontiguousarray(columns.T)
        if len(shared):
            self.at += int(ends[-1])
            self.last = table[-1:].copy()
        return table, shared

    def more(self) -> tuple[list[bytes], list[int]]:
        """rows() as lists."""
        table, shared = self.rows()
        return table.view(f"S{self.width}").ravel().tolist(), shared.tolist()


def joined(coded: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of several front-coded runs in order, and the place each had among all of theirs.

    Runs behind each other decode as one, for each begins with a string that shares
    nothing.  The stable sort finds the runs again and merges them.
    """
    sizes = [int.from_bytes(c[:4], "little") for c in coded]
    whole = Run(b"".join([sum(sizes).to_bytes(4, "little"), *[c[4 : 4 + n] for c, n in zip(coded, sizes, strict=True)], *[c[4 + n :] for c, n in zip(coded, sizes, strict=True)]]), width, _ROWS)
    table = np.concatenate([whole.rows()[0] for _ in range(0, whole.n, _ROWS)])
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    return table[order], order


def merge_runs(runs: list[Run], chunk: int = 1 << 15) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Chunks of (place among all runs' strings, common prefix with the string before, string) in order.

    tree[node] is the loser of a match; prefix has each run's common prefix with
    the last overall winner (-1 if it has ended).  A longer common prefix wins
    outright; only of equal ones are the bytes behind it compared.
    """
    k = 1
    while k < len(runs):
        k *= 2
    width = runs[0].width
    strings, shares = [[b""]] * k, [[0]] * k
    head, prefix, at = [b""] * k, [-1] * k, [0] * k
    place = [0] * k
    seen = 0
    for i, run in enumerate(runs):
        place[i], seen = seen, seen + run.n
        if run.n:
            strings[i], shares[i] = run.more()
            head[i], prefix[i] = strings[i][0], 0
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes what it shares with the winner."""
        x, y = prefix[a], prefix[b]
        if x != y or x < 0:
            return (a, b) if x >= y else (b, a)
        s, t = head[a][x:], head[b][x:]
        if s == t:
            prefix[b] = width
            return a, b
        if s > t:
            a, b = b, a
        for c, d in zip(s, t, strict=True):
            if c != d:
                break
            x += 1
        prefix[b] = x
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1)
    out: tuple[list, list, list] = ([], [], [])
    while prefix[top] >= 0:
        out[0].append(place[top])
        out[1].append(prefix[top])
        out[2].append(head[top])
        if len(out[0]) == chunk:
            yield out
            out = ([], [], [])
        place[top] += 1
        i = at[top] + 1
        if i == len(strings[top]):
            strings[top], shares[top] = runs[top].more()
            i = 0
        at[top] = i
        if strings[top]:
            head[top] = strings[top][i]
            p = shares[top][i]
        else:
            p = -1
        prefix[top] = p
        node = (top + k) >> 1
        while node:
            other = tree[node]
            q = prefix[other]
            if q > p:
                tree[node], top, p = top, other, q
            elif q == p and p >= 0:
                top, tree[node] = play(top, other)
            node >>= 1
    if out[0]:
        yield out


def in_order(tables: Iterator[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (place among all strings, common prefix with the string before, strings) in the order of all sorted tables."""
    first = next(tables)
    second = next(tables, None)
    if second is None:
        shared = common_prefixes(first)
        for lo in range(0, len(first), 1 << 15):
            at = slice(lo, lo + (1 << 15))
            yield np.arange(len(first))[at], shared[at], first[at]
        return
    # of several, only front-coded runs are held
    runs = [Run(front_coded(t), width) for t in (first, second)]
    del first, second
    runs += (Run(front_coded(t), width) for t in tables)
    for place, shared, strings in merge_runs(runs):
        yield np.array(place), np.array(shared), np.array(strings, f"S{width}").view(np.uint8).reshape(-1, width)


def shared_windows(table: np.ndarray, agreed: np.ndarray) -> np.ndarray:
    """How many of each stretch's first windows another may share.

    table has stretch_strings, agreed what each has in common with a neighbour.
    A window that starts j bytes before the anchor is shared only with a stretch
    that agrees on LENGTH - j bytes from the anchor on; in sorted order the longest
    such agreement is with a neighbour.
    """
    right, size = table[:, -2].astype(np.int64), table[:, -1].astype(np.int64)
    return np.minimum((size - right) - (LENGTH - np.minimum(right, agreed)) + 1, size - LENGTH + 1)


ENTRY = np.dtype([("rk", np.int64), ("doc", np.int64), ("start", np.int32), ("size", np.int32)])


COVER = "rk bigint, start int, size int"


def string_hashes(table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    factor = np.cumprod(np.full(table.shape[1], _BASE))
    return mix(np.concatenate([table[lo : lo + 4096].astype(np.uint64) @ factor for lo in range(0, len(table), 4096)] or [np.zeros(0, np.uint64)]))


def splitters_of(strings, make, width: int, entries: int, ranges: int) -> np.ndarray:
    """Strings that cut the sorted order of make's strings into about equal ranges.

    strings(condition) gives the rows of a sample.  About DRAWS different strings a
    range reach the driver, 64 times RANGES * DRAWS at most.
    """
    if ranges < 2:
        return np.zeros(0, f"S{width}")
    share = min(1.0, DRAWS * ranges / entries)
    of_rows = min(1.0, 16 * share)
    least = np.uint64(min(share / of_rows, 1.0) * (2**64 - 2048))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, *_ in make(batches):
            found = table[string_hashes(table) <= least]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(f"S{width}").ravel().tolist(), pa.binary())], ["string"])

    rows = strings(F.pmod(F.xxhash64(F.lit(3), "rk"), F.lit(1 << 30)) < int((1 << 30) * of_rows))
    found = rows.mapInArrow(drawn, "string binary").distinct().limit(64 * RANGES * DRAWS).toArrow()
    every = np.sort(np.array(found.column("string").to_pylist(), f"S{width}"))
    return np.unique(every[np.linspace(0, len(every) - 1, ranges + 1).astype(int)[1:-1]]) if len(every) else every


def merge_sorted(strings, make, width: int, entries: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(covers COVER, neighbours (rk, doc_id, start, size, string)) of a distributed sort.

    strings(condition) gives the input rows that meet a condition on rk (None: all),
    make(batches) yields (strings as rows of width bytes, rk, doc_id, start, size)
    arrays of them, about `entries` in all.  Neighbours are the smallest documents'
    entries of strings that may share windows with others of the same first `group`
    bytes; size counts those windows (none if group is 0).
    """
    parts = max(1, -(-entries // PART))
    splitters = splitters_of(strings, make, width, entries, min(parts, RANGES))
    lanes = -(-parts // RANGES)
    names = ["part", "run", "entries", "rk", "start", "size"]

    def covers(rk: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, rk))
        rk, start, end = rk[order], start[order].astype(np.int64), (start + size)[order].astype(np.int64)
        fresh = np.append(True, rk[1:] != rk[:-1])
        reach = np.maximum.accumulate(end + (np.cumsum(fresh) << 40)) - (np.cumsum(fresh) << 40)
        cut = fresh | np.append(True, start[1:] > reach[:-1])
        at = np.flatnonzero(cut)
        ends = reach[np.append(at[1:], len(rk)) - 1]
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(rk[at] % parts, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(rk[at]), pa.array(start[at].astype(np.int32)), pa.array((ends - start[at]).astype(np.int32))], names
        )

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> Iterator[pa.RecordBatch]:
            table = np.concatenate([h[0] for h in held])
            about = np.zeros(len(table), ENTRY)
            for i, name in enumerate(ENTRY.names):
                about[name] = np.concatenate([h[i + 1] for h in held])
            held.clear()
            order = np.lexsort((about["doc"], table.view(f"S{width}").ravel()))
            table, about = table[order], about[order]
            shared = common_prefixes(table)
            starts = np.flatnonzero(shared < width)
            least = np.repeat(about["doc"][starts], np.diff(starts, append=len(table)))
            gone = about["doc"] > least
            if gone.any():
                yield covers(*(about[c][gone] for c in ("rk", "start", "size")))
                table, about, shared = table[~gone], about[~gone], shared[~gone]
            part = np.searchsorted(splitters, table.view(f"S{width}").ravel(), "right")
            if lanes > 1:
                part = part * lanes + (string_hashes(table[:, : group or width]) % np.uint64(lanes)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                table, about, part = table[order], about[order], part[order]
                shared = common_prefixes(table)
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            cuts = np.append(edges, len(part))
            runs = front_coded_cuts(table, shared, cuts)
            entries = packed(cuts, about["rk"], about["doc"], (about["start"], 0), (about["size"], 0))
            n = len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int32)), pa.array(runs, pa.binary()), pa.array(entries, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names)

        for made in make(batches):
            held.append(made)
            if sum(len(h[0]) for h in held) * width > SORTED:
                yield from emit()
        if held:
            yield from emit()

    runs = strings(None).mapInArrow(sorted_runs, "part int, run binary, entries binary, " + COVER)
    dealt = runs.repartition("part").sortWithinPartitions("part")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            columns = unpacked([e for _, e in held], True, (np.int32, 0), (np.int32, 0))
            about = np.zeros(len(columns[0]), ENTRY)
            for name, column in zip(ENTRY.names, columns, strict=True):
                about[name] = column
            coded = [run for run, _ in held]
            held.clear()

            def tables() -> Iterator[np.ndarray]:
                seen = first = size = 0
                for i, run in enumerate(coded):
                    size += int.from_bytes(run[:4], "little")
                    if size >= JOINED or i == len(coded) - 1:
                        table, order = joined(coded[first : i + 1], width)
                        about[seen : seen + size] = about[seen : seen + size][order]
                        yield table
                        first, seen, size = i + 1, seen + size, 0

            # the group of equal strings that the chunks so far ended with
            tail = None
            first = True
            for more in in_order(tables(), width):
                places, shares, kept = more if tail is None else map(np.concatenate, zip(tail, more, strict=True))
                starts = np.flatnonzero(shares < width)
                if starts[-1]:
                    yield from settled(about, places, shares, kept, starts, first)
                    first = False
                tail = tuple(c[starts[-1] :] for c in (places, shares, kept))
            places, shares, kept = tail
            yield from settled(about, places, np.append(shares, width - 1), kept, np.array([0, len(places)]), first)

        def settled(about: np.ndarray, at: np.ndarray, share: np.ndarray, kept: np.ndarray, starts: np.ndarray, first: bool) -> Iterator[pa.RecordBatch]:
            """Covers and neighbours of all groups of equal strings but the last."""
            mine = about[at[: starts[-1]]]
            size = np.diff(starts)
            gone = mine["doc"] > np.repeat(np.minimum.reduceat(mine["doc"], starts[:-1]), size)
            if gone.any():
                yield rows(mine["rk"][gone], pa.nulls(int(gone.sum()), pa.int64()), mine["start"][gone], mine["size"][gone], pa.nulls(int(gone.sum()), pa.binary()))
            if not group:
                return
            agreed = share[starts].astype(np.int64)
            if first:
                agreed[0] = width
            agreed = np.maximum(agreed[:-1], agreed[1:])
            near = np.flatnonzero(agreed >= group)
            if not len(near):
                return
            windows = np.zeros(len(size), np.int64)
            windows[near] = shared_windows(kept[starts[near]], agreed[near])
            n = np.repeat(windows, size)
            out = np.flatnonzero((n > 0) & ~gone)
            if len(out):
                string = pa.array(kept[out].view(f"S{width}").ravel().tolist(), pa.binary())
                yield rows(mine["rk"][out], mine["doc"][out], mine["start"][out], n[out].astype(np.int32), string)

        def rows(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["rk", "doc_id", "start", "size", "string"])

        for b in batches:
            mine = b.column("rk").is_valid()
            rk, start, size = (b.column(c).filter(mine) for c in ("rk", "start", "size"))
            n = len(rk)
            yield rows(rk, pa.nulls(n, pa.int64()), start, size, pa.nulls(n, pa.binary()))
            for p, run, entries in zip(b.column("part").to_pylist(), b.column("run"), b.column("entries"), strict=True):
                if not run.is_valid:
                    continue
                if p != part:
                    if held:
                        yield from close()
                    part, held = p, []
                held.append((run.as_py(), entries.as_py()))
        if held:
            yield from close()

    done = materialize(dealt.mapInArrow(merged, "rk bigint, doc_id bigint, start int, size int, string binary"), "merged")
    return done.where("string IS NULL").select("rk", "start", "size"), done.where("string IS NOT NULL")


def covered(rows: DataFrame) -> DataFrame:
    """COVER of all bytes to remove; a range may come more than once."""
    known = rows.where("doc_id IS NOT NULL")

    def stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            keys, doc_ids = b.column("rk").to_numpy(), b.column("doc_id").to_numpy()
            picks, sizes = b.column("picks").flatten().to_numpy(), b.column("picks").value_lengths().to_numpy()
            cuts = np.append(0, np.cumsum(sizes))
            for first, end, data, offsets in _texts(b):
                row, _, anchor, lo, hi = stretches(data, offsets)
                starts = np.searchsorted(row, np.arange(end - first))
                wanted = picks[cuts[first] : cuts[end]] + np.repeat(starts, sizes[first:end])
                row, anchor, lo, hi = row[wanted], anchor[wanted], lo[wanted], hi[wanted]
                for at in range(0, len(row), _ROWS):
                    part = slice(at, at + _ROWS)
                    made = stretch_strings(data, anchor[part], lo[part], hi[part])
                    yield made, keys[first + row[part]], doc_ids[first + row[part]], (lo - offsets[row])[part], (hi + LENGTH - lo)[part]

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            keys, doc_ids, starts, n = (b.column(c).to_numpy() for c in ("rk", "doc_id", "start", "size"))
            n = n.astype(np.int64)
            strings = [unrotated(s) for s in b.column("string").to_pylist()]
            data = np.frombuffer(b"".join(strings), np.uint8)
            sizes = np.array([len(s) for s in strings])
            owner = np.repeat(np.arange(len(strings)), n)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(sizes) - sizes)[owner] + inner
            for lo in range(0, len(at), _ROWS):
                part = slice(lo, lo + _ROWS)
                # the last byte keeps a closing zero byte of the text from being taken for padding
                table = np.ones((len(at[part]), LENGTH + 1), np.uint8)
                table[:, :-1] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at[part]]
                yield table, keys[owner[part]], doc_ids[owner[part]], starts[owner[part]] + inner[part], np.full(len(table), LENGTH)

    # a whole copy of a smaller document's text is covered as it is
    slim = known.select("rk", "doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    slim = materialize(slim.where(F.col("size") >= LENGTH), "texts")
    least = slim.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = materialize(least, "copied")
    copies = materialize(slim.join(least, ["h1", "h2"]).where("doc_id > least").select("rk", F.lit(0).alias("start"), "size"), "copies")
    text_bytes = slim.agg(F.sum("size")).first()[0] or 0
    picks = materialize(shared_stretches(rows, copies, max(2, -(-text_bytes // BUCKET_BYTES))), "picks")

    def picked(condition) -> DataFrame:
        some = known if condition is None else known.where(condition)
        return compressed(some).join(picks if condition is None else picks.where(condition), "rk")

    entries = picks.agg(F.sum(F.size("picks").cast("bigint"))).first()[0] or 0
    whole, near = merge_sorted(picked, stretch_rows, WIDE, entries, GRAM)
    entries = near.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0
    windows, _ = merge_sorted(lambda condition: near if condition is None else near.where(condition), window_rows, LENGTH + 1, entries, 0)
    return whole.unionByName(windows).unionByName(copies)


def cut(docs: DataFrame) -> DataFrame:
    """(doc_id, text binary, n_bytes, n_removed, n_spans) of every row; text is what is left."""
    rows = keyed_texts(docs)
    spans = covered(rows).groupBy("rk").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("spans")
            cuts = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            flat = lists.flatten()
            starts, sizes = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = []
            for first, end, data, offsets in _texts(b):
                for i in range(first, end):
                    text = data[offsets[i - first] : offsets[i - first + 1]]
                    gone = np.zeros(len(text) + 2, np.int32)
                    at, size = starts[cuts[i] : cuts[i + 1]], sizes[cuts[i] : cuts[i + 1]]
                    np.add.at(gone, at + 1, 1)
                    np.add.at(gone, at + 1 + size, -1)
                    gone = np.cumsum(gone) > 0
                    out.append((text[~gone[1:-1]].tobytes(), len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum())))
            columns = zip(*out, strict=True)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "text", "n_bytes", "n_removed", "n_spans"])

    return compressed(rows).join(spans, "rk", "left").select("doc_id", "z", "spans").mapInArrow(applied, "doc_id bigint, text binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def digest(docs: DataFrame) -> DataFrame:
    done = cut(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
