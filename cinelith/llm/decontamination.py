"""Benchmark decontamination: pigeonhole edit matching.

Both sides are normalised: A-Z lower-cased, ASCII punctuation dropped, runs of
blanks as one space.  A test item of n characters may differ by
k = n // CHARS_PER_EDIT edits.  It is split into k + 1 pieces; k edits leave at
least one piece untouched, so every approximate copy holds an exact piece at
about its place.  Pieces of all items run over a text in one Aho-Corasick pass;
around each hit Myers' bit-parallel algorithm finds the least edit distance of
the whole item to any stretch of the text.  Nothing is sampled and no partner is
capped.

Scale: a benchmark of up to BLOCK_CHARS characters is one pass over the documents
without a shuffle.  A larger one is cut into blocks of that size, each of which is
broadcast and searched by a job of its own, so a worker holds one block's machine
(about 62 bytes a character, measured) whatever the size of the benchmark; only
the keys of rows with hits are written, and joined to the rows at the end.  An item
that is longer than a block is alone in its block.  A Python worker keeps the
machine of its last block, so it is built once a worker, not once a task.

Defined cases: null or empty texts hold nothing; items that are null or empty
after normalisation match nothing; an item of a few characters is found wherever
these stand, inside words too, so most texts hold it (none is left out here);
items with an equal text are each reported; rows that repeat are judged each;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelith.llm.shared import materialize, row_keys, whole_text

CHARS_PER_EDIT = 14
BLOCK_CHARS = 2_000_000
#: ASCII punctuation goes, A-Z is lower-cased, control bytes are blanks.
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_MAP = bytes(32 if b < 33 or b == 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))

HITS = "array<struct<item_id:bigint,start:bigint,end:bigint,distance:int>>"


def normalise(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(_MAP, _PUNCTUATION).split()).decode()


class Pattern:
    """One test item: its pieces and the bit masks Myers' algorithm needs."""

    def __init__(self, item_id: int, text: str, chars_per_edit: int):
        self.item_id, self.text, self.n = item_id, text, len(text)
        self.budget = self.n // chars_per_edit
        edges = [self.n * i // (self.budget + 1) for i in range(self.budget + 2)]
        self.pieces = list(zip(edges, edges[1:], strict=False))
        self._masks: dict[str, int] | None = None

    def masks(self) -> dict[str, int]:
        if self._masks is None:
            self._masks = {}
            for i, c in enumerate(self.text):
                self._masks[c] = self._masks.get(c, 0) | 1 << i
        return self._masks

    def nearest(self, text: str) -> tuple[int, int]:
        """(least edit distance of the item to any stretch of text, that stretch's end)."""
        masks, full, top = self.masks(), (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        best, end = self.n, 0
        for i, c in enumerate(text):
            eq = masks.get(c, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | (full & ~(d | up)), up & d
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = minus | (full & ~(x | plus)), plus & x
            if score < best:
                best, end = score, i + 1
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        import ahocorasick

        self.items = [Pattern(i, t, chars_per_edit) for i, t in items]
        self.machine = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for a, b in item.pieces:
                owners.setdefault(item.text[a:b], []).append((k, a))
        for piece, who in owners.items():
            self.machine.add_word(piece, (len(piece), who))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) in the normalised text, the nearest place of each item."""
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        judged: dict[int, set[int]] = {}  # item -> places its window has been searched around
        front: dict[int, int] = {}  # item -> the last of these whose window starts at 0
        for last, (length, who) in self.machine.iter(text):
            for k, offset in who:
                item = self.items[k]
                at = last + 1 - length - offset
                # windows are equally long unless cut at 0, so a window lies inside a searched one only in these two cases
                if (k in best and best[k][0] == 0) or at in judged.get(k, ()) or at <= front.get(k, at - 1):
                    continue
                if text.startswith(item.text, max(at, 0)) and at >= 0:
                    best[k] = (0, at, at + item.n)
                    continue
                lo, hi = max(0, at - item.budget), at + item.n + item.budget
                judged.setdefault(k, set()).add(at)
                if lo == 0:
                    front[k] = max(front.get(k, at), at)
                distance, end = item.nearest(text[lo:hi])
                if distance <= item.budget and (k not in best or distance < best[k][0]):
                    best[k] = (distance, max(0, lo + end - item.n), lo + end)
        return sorted((self.items[k].item_id, a, b, d) for k, (d, a, b) in best.items())


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in lists of at most block_chars characters, one item at least."""
    held, size = [], 0
    # an item at a time reaches the driver, a partition at most is buffered
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        text = normalise(row.text)
        if not text:
            continue
        if held and size + len(text) > block_chars:
            yield held
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    if held:
        yield held


_held: dict[str, Matcher] = {}


def matcher_of(name: str, items: list[tuple[int, str]], chars_per_edit: int) -> Matcher:
    """This worker's matcher of a block; the one before is given up."""
    if name not in _held:
        _held.clear()
        _held[name] = Matcher(items, chars_per_edit)
    return _held[name]


def find(docs: DataFrame, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """docs as struct `row`, with hits: HITS, places in the normalised text."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(name, sent.value, chars_per_edit)
        for b in batches:
            hits = [
                [dict(zip(("item_id", "start", "end", "distance"), h, strict=True)) for h in matcher.find(normalise(t))]
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(hits, kind)], ["row", "hits"])

    packed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(found, f"row {docs.schema.simpleString()}, hits {HITS}")


def judge(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs as struct `row`, with the hits of all blocks."""
    every = blocks(benchmark, block_chars)
    first, second = next(every, []), next(every, None)
    if second is None:
        return find(docs, first, chars_per_edit)
    rows = docs.select(F.struct("*").alias("row"), whole_text().alias("text"), "doc_id").select("row", "text", *row_keys())
    slim = rows.select("rk1", "rk2", "text")
    found = None
    for items in chain([first, second], every):
        one = find(slim, items, chars_per_edit).where(F.size("hits") > 0).select("row.rk1", "row.rk2", "hits").dropDuplicates(["rk1", "rk2"])
        one = materialize(one, "hits")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("rk1", "rk2").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return rows.join(found, ["rk1", "rk2"], "left").select("row", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of docs that hold no test item, columns unchanged."""
    return judge(docs, benchmark, chars_per_edit).where(F.size("hits") == 0).select("row.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    done = judge(docs.select("doc_id", "text"), benchmark)
    return done.select("row.doc_id", (F.size("hits") == 0).alias("kept"), F.size("hits").cast("bigint").alias("n_items"), F.array_sort("hits").alias("hits"))
