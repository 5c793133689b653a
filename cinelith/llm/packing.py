"""Packing: documents in order, cut into windows by dynamic programming.

Tokens of a partition's documents form one stream, each document closed by the
separator id.  A window is at most WINDOW tokens; its row is padded to WINDOW
unless its length is a power of two.  Cuts are chosen among document ends,
sentence ends and, at a higher price, some places inside sentences: those a whole
number of windows behind a boundary whose next one is further than a window, and
those one window behind a boundary where the last boundary before them would
leave more padding than the price differs.  Among the cuts at these places (see
candidates(); other places inside sentences are not tried) padding plus penalties
is least:

    f(j) = price(j) + min over i, p(j) - p(i) <= WINDOW, of f(i) + WINDOW - (p(j) - p(i))

f(i) + p(i) does not depend on j, so a monotone queue gives each minimum in
amortised constant time; lengths that are a power of two (UNPADDED or more) are
extra transitions without padding.  The stream is solved in blocks of BLOCK tokens; a block's last
window is carried into the next block, so memory follows BLOCK and the longest
document.  No shuffle: order is that of the input, and every partition pads at
most its own last window.

Ids: byte-level BPE from a tokenizers JSON file.  When its ids are its merge
ranks (the file's vocabulary says so) the ranks run in tiktoken, which gives the
same ids several times faster; other files run in tokenizers.  An added token's
text becomes that token, as tokenizers have it.

Defined cases: null or empty text is the separator alone; a document longer than
a window is cut; repeated rows are packed each; a null doc_id is kept as null;
columns besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
BLOCK = 1 << 18
SEPARATOR = 0
#: What a cut costs, in tokens of padding: at a document's end, a sentence's end, elsewhere.
PRICES = (0, 6, 20)
#: Shortest power of two that is considered as a window's length.
UNPADDED = 128
#: What an unpadded window shorter than WINDOW costs.
SHORT = 8


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files: printable bytes
    stand for themselves, the rest take code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """(texts -> list of id lists, sentence-end flags by id)."""
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    letters = _byte_letters()
    added = {t["content"]: t for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    ends = np.zeros(max([*vocab.values(), *(t["id"] for t in added.values())]) + 1, bool)
    ranks = {}
    for token, i in vocab.items():
        if token in added or any(c not in letters for c in token):
            continue
        ranks[raw] = i if (raw := bytes(letters[c] for c in token)) not in ranks else -1
        ends[i] = raw.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?") or b"\n" in raw
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
    joined = [vocab["".join(m)] for m in merges]
    plain = not any(t.get(k) for t in added.values() for k in ("single_word", "lstrip", "rstrip"))
    if plain and len(ranks) + len(added) >= len(vocab) and joined == list(range(256, 256 + len(merges))) and spec.get("normalizer") is None:
        import public_tokenizers
        import tiktoken

        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={c: t["id"] for c, t in added.items()})
        return (lambda texts: [fast.encode(t, allowed_special="all") for t in texts]), ends
    slow = Tokenizer.from_file(path)
    return (lambda texts: [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]), ends


def candidates(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW, prices: tuple = PRICES) -> tuple[np.ndarray, np.ndarray]:
    """Places at which n tokens may be cut, 0 and n included, and what each costs."""
    soft = np.union1d(np.append(doc_ends, (0, n)), sentence_ends)
    inside = [np.arange(soft[g] + window, soft[g + 1], window) for g in np.flatnonzero(np.diff(soft) > window)]
    full = soft + window
    full = full[full <= n]
    inside.append(full[full - soft[np.searchsorted(soft, full, "right") - 1] > prices[2] - prices[1]])
    at = np.union1d(soft, np.concatenate(inside))
    at = at[at <= n]
    price = np.full(len(at), prices[2])
    price[np.isin(at, sentence_ends, kind="sort")] = prices[1]
    price[np.isin(at, np.append(doc_ends, n), kind="sort")] = prices[0]
    return at, price


def choose_cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW, prices: tuple = PRICES) -> list[int]:
    """Cut positions over n tokens, 0 and n included, of least padding plus penalties among candidates()."""
    at, price = candidates(n, doc_ends, sentence_ends, window, prices)
    whole: dict[int, list[int]] = {}
    size = UNPADDED
    while size < window:
        where = np.searchsorted(at, at - size)
        for j in np.flatnonzero((at >= size) & (at[np.minimum(where, len(at) - 1)] == at - size)).tolist():
            whole.setdefault(j, []).append(int(where[j]))
        size *= 2
    p, c = at.tolist(), price.tolist()
    best, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    total = [p[0]] + [0] * (len(p) - 1)  # best + position
    for j in range(1, len(p)):
        here = p[j]
        while here - p[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        least, origin = total[i] + window - here, i
        for i in whole.get(j, ()):
            if best[i] + SHORT < least:
                least, origin = best[i] + SHORT, i
        best[j], back[j] = least + c[j], origin
        value = total[j] = best[j] + here
        while queue and total[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts = [len(p) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [p[i] for i in reversed(cuts)]


class _Stream:
    """Tokens not yet in a window, and which document each stretch belongs to."""

    def __init__(self, first_sequence: int, with_ids: bool, ends: np.ndarray, window: int):
        self.sequence, self.with_ids, self.ends, self.window = first_sequence, with_ids, ends, window
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, tokens before, tokens here, tokens in all)
        self.size = 0

    def add(self, doc_id, ids: list[int]) -> None:
        ids = np.array(ids + [SEPARATOR], np.uint32)
        self.tokens.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.size += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        ids = np.concatenate(self.tokens)
        lengths = np.array([d[2] for d in self.docs])
        doc_ends = np.cumsum(lengths)
        sentence_ends = np.flatnonzero(self.ends[ids]) + 1
        cuts = choose_cuts(len(ids), doc_ends, sentence_ends, self.window)
        if not last:
            cuts = cuts[:-1]
        stop = cuts[-1]
        doc_starts = doc_ends - lengths
        edges = np.union1d(cuts, doc_starts[doc_starts < stop])
        starts = edges[:-1]
        owner = np.searchsorted(doc_ends, starts, "right").tolist()
        window = (np.searchsorted(cuts, starts, "right") - 1).tolist()
        out = []
        for a, b, d, w in zip(starts.tolist(), edges[1:].tolist(), owner, window, strict=True):
            doc_id, before, _, whole = self.docs[d]
            piece = ids[a:b]
            row = (doc_id, before + a - int(doc_starts[d]), b - a, zlib.crc32(piece.tobytes()), whole, self.sequence + w, a - cuts[w])
            out.append((*row, piece.tolist()) if self.with_ids else row)
        self.sequence += len(cuts) - 1
        self.tokens, self.size = [ids[stop:]], len(ids) - stop
        keep = int(np.searchsorted(doc_ends, stop, "right"))
        rest = []
        for d in range(keep, len(self.docs)):
            doc_id, before, here, whole = self.docs[d]
            gone = max(0, stop - int(doc_starts[d]))
            rest.append((doc_id, before + gone, here - gone, whole))
        self.docs = rest
        return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row per piece: SCHEMA, and the piece's ids if with_ids."""
    path = tokenizer or default_tokenizer()
    schema = SCHEMA + (", ids array<bigint>" if with_ids else "")
    arrow = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(path)
        context = TaskContext.get()
        stream = _Stream((context.partitionId() if context else 0) << 40, with_ids, ends, window)

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo in range(0, len(ids), 64):
                for doc_id, found in zip(ids[lo : lo + 64], encode([t or "" for t in texts.slice(lo, 64).to_pylist()]), strict=True):
                    stream.add(doc_id, found)
                    if stream.size >= BLOCK:
                        yield from emit(stream.flush(False))
        yield from emit(stream.flush(True))

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(packed, schema)


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
