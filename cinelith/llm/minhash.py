"""Near-duplicates: minhash with tensored banding, exact confirmation.

A document's set holds its distinct 5-word shingles, as 64-bit hashes.
COLLECTIONS small hash collections of WIDTH minhashes each are computed; the
keys of the hash tables are all pairs of collections, so 153 tables of keys six
minhashes wide cost 54 minhashes instead of 918.  A pair with similarity 0.75
shares no table with probability 7e-4, one with 0.85 with less than 1e-6.

1. Documents with equal sets form classes; one representative goes on.
2. A collection value that no other representative has can be in no shared key,
   so only shared values are combined into table keys.
3. Star rounds: every bucket whose members are in different components names a
   pivot; each member is confirmed, on full sets, against the pivots it shares
   most buckets with (COMMON at least); components are merged.
4. Exhaustive round: in buckets that still span components, all pairs across
   components are compared, each in the first table the two share, by sketches
   of BINS bytes (a set's least hash in each of BINS ranges; the cut is DEVIATIONS
   standard deviations below the threshold), in memory.  What passes is
   confirmed on full sets.  A pair inside one component needs no comparison, as
   it cannot change the components: only the members outside a bucket's largest
   component are held, in blocks of BLOCK, and the others stream past them.

Scale: no group is collected: buckets are reduced by partial aggregates, large
ones are dealt out in blocks of BLOCK members and strands of STRAND, and a
pivot's members are spread over SALTS groups that stream past the pivot's set.

Defined cases: without words or text a set is empty, linked with nothing, and
the document its own component; with one to four words the whole sequence is
the one shingle; a null doc_id takes no part (component_id null, kept); rows that
repeat a doc_id are one document, linked by any of its rows; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelith.llm.graph import components
from cinelith.llm.shared import materialize
from cinelith.llm.text import mix, slices, words

SHINGLE = 5
PERCENT = 75
COLLECTIONS = 18
WIDTH = 3
BINS = 512
DEVIATIONS = 4.0
STARS = 3
PIVOTS = 4
#: Buckets that a member must share with a pivot to be confirmed in a star round; the exhaustive round takes the others.
COMMON = 6
#: Rows of ids that are broadcast, 36 bytes each at most; more are joined by a shuffle.
MOST_SENT = 1_000_000
BLOCK = 1024
STRAND = 8192
SALTS = 64
_rng = np.random.default_rng(20240)
_XOR, _ODD = _rng.integers(0, 2**63, (2, COLLECTIONS * WIDTH)).astype(np.uint64)
_ODD = _ODD * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, _, doc = words(data, offsets)
    cuts = np.searchsorted(doc, np.arange(len(offsets)))
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += h[k : len(h) - width + 1 + k] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        else:
            short = h[a:b]
            out.append(mix((short * _PLACE[8 : 8 + len(short)]).sum(keepdims=True)) if len(short) else short)
    return out


_BIN = np.uint64(64 - (BINS - 1).bit_length())
_EDGES = np.arange(BINS, dtype=np.uint64) << _BIN


def bins(ordered: np.ndarray) -> bytes:
    """A byte (1 to 255) of the least hash in each range of hashes, 0 where there is none."""
    if not len(ordered):
        return bytes(BINS)
    at = np.searchsorted(ordered, _EDGES)
    least = ordered[np.minimum(at, len(ordered) - 1)]
    held = (at < len(ordered)) & (least >> _BIN == np.arange(BINS, dtype=np.uint64))
    return np.where(held, least % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def row_key() -> Column:
    """A hash of doc_id and text; equal rows share it."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, n, s1, s2, u array<bigint>): row key, set size, set hash, collections."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b.column("text")):
                sets = shingle_sets(data, offsets)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                u = np.zeros((len(sets), COLLECTIONS), np.uint64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    s1[full] = np.add.reduceat(every, starts)
                    s2[full] = np.add.reduceat(mix(every ^ _XOR[0]), starts)
                    for k in range(COLLECTIONS * WIDTH):
                        least = np.minimum.reduceat((every ^ _XOR[k]) * _ODD[k], starts)
                        u[full, k // WIDTH] = mix(u[full, k // WIDTH] * _PLACE[15] + least)
                flat = pa.array(u.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, hi - lo), b.column("rk").slice(lo, hi - lo), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COLLECTIONS), flat),
                    ],
                    ["doc_id", "rk", "n", "s1", "s2", "u"],
                )

    return keyed(docs).mapInArrow(signed, "doc_id bigint, rk bigint, n bigint, s1 bigint, s2 bigint, u array<bigint>")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rk)."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.withColumn("rk", row_key())


def sketched(texts: DataFrame) -> DataFrame:
    """(rep, n, sketch) from (id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b.column("text")):
                sets = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array([bins(x) for x in sets], pa.binary())],
                    ["rep", "n", "sketch"],
                )

    return texts.select("id", "text").mapInArrow(made, "rep bigint, n bigint, sketch binary")


def table_members(reps: DataFrame) -> DataFrame:
    """(key, t, rep) of every bucket with two members or more, from (rep, u).

    t numbers the table: first collection times COLLECTIONS, plus the second.
    """
    values = reps.select("rep", F.posexplode("u").alias("i", "value")).select("rep", "i", F.xxhash64("i", "value").alias("h"))
    values = materialize(values, "collections")
    shared = materialize(values.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    held = values.join(shared, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("c"))
    pairs = F.expr(
        "flatten(transform(sequence(0, size(c) - 2), x -> transform(slice(c, x + 2, size(c)), y -> "
        f"named_struct('key', xxhash64(c[x].h, y.h), 't', c[x].i * {COLLECTIONS} + y.i))))"
    )
    keys = materialize(held.where(F.size("c") > 1).select("rep", F.explode(pairs).alias("k")).select("rep", "k.*"), "tables")
    full = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "buckets")
    return materialize(keys.join(full, "key"), "members")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of pairs (a, b) whose full sets are similar enough.  texts: (id, text)."""
    dealt = materialize(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")), "pairs")
    heads = dealt.select("a", "salt").distinct().select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"))
    members = dealt.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("side"), "b")
    # heads and members meet the texts in one join; while they are few, the texts need not be dealt out for it
    asked = heads.unionByName(members)
    asked = F.broadcast(asked) if 2 * dealt.count() <= most_sent else asked.hint("merge")
    rows = texts.join(asked, "id").select("a", "salt", "side", "b", "text")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, side, b = (batch.column(c).to_pylist() for c in ("a", "side", "b"))
            good = []
            for lo, hi, data, offsets in slices(batch.column("text")):
                for i, found in zip(range(lo, hi), shingle_sets(data, offsets), strict=True):
                    if side[i] == 0:
                        head, held = a[i], found
                        continue
                    if head != a[i] or not len(found) or not len(held):
                        continue
                    at = np.minimum(np.searchsorted(held, found), len(held) - 1)
                    both = int((held[at] == found).sum())
                    if 100 * both >= percent * (len(held) + len(found) - both):
                        good.append((a[i], b[i]))
            if good:
                x, y = zip(*good, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return rows.select("a", "side", "b", "text").mapInArrow(confirmed, "a bigint, b bigint")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (rep, comp) after links (a, b) between representatives; comp as it is without links."""
    links = materialize(links, "links")
    if links.isEmpty():
        return comp
    one, two = comp.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    labels = components(links.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = comp.join(labels.select(F.col("id").alias("comp"), "label"), "comp", "left")
    return materialize(new.select("rep", F.coalesce("label", "comp").alias("comp")), "components")


def star_pairs(members: DataFrame, comp: DataFrame, seed: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """((a pivot, b member) in different components, the pivots of most common buckets first;
    the members of buckets that still span components)."""
    held = members.join(comp, "rep")
    order = F.struct(F.xxhash64(F.lit(seed), "rep").alias("o"), F.col("rep").alias("a"), F.col("comp").alias("ca"))
    heads = held.groupBy("key").agg(F.min(order).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    heads = materialize(heads.select("key", "p.a", "p.ca"), "pivots")
    # a bucket inside one component stays so, and later rounds need not read it
    spanning = materialize(held.join(heads, "key"), "members")
    met = spanning.where("comp <> ca").groupBy("rep", "a").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    best = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), "a"))
    return met.withColumn("r", best).where(F.col("r") <= pivots).select("a", F.col("rep").alias("b")), spanning.select("key", "t", "rep")


def open_pairs(members: DataFrame, comp: DataFrame, reps: DataFrame, texts: DataFrame, percent: int = PERCENT, block: int = BLOCK, strand: int = STRAND) -> DataFrame:
    """(a, b): all pairs of a bucket in different components whose sketches agree enough.

    reps: (rep, u); texts: (id, text).  The sketches' deviation is that of a
    sample without replacement, as most of a short text's hashes are in its sketch.
    """
    held = members.join(comp, "rep")
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("c"))
    spans = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    parts, strands = F.ceil((F.col("all") - F.col("top.c")) / block).cast("int"), F.ceil(F.col("all") / strand).cast("int")
    spans = materialize(spans.select("key", F.col("top.comp").alias("top"), parts.alias("parts"), strands.alias("strands")), "open")
    rows = materialize(held.join(spans, "key"), "spanning")
    who = materialize(rows.select("rep").distinct(), "spanning-reps")
    # half of each collection's value tells tables apart as well
    halves = reps.select("rep", F.transform("u", lambda x: F.shiftright(x, 32).cast("int")).alias("u"))
    sketches = materialize(sketched(texts.join(who.withColumnRenamed("rep", "id"), "id")).join(halves, "rep"), "sketches")
    rows = rows.join(sketches, "rep")
    # a member outside the largest component is held in its block, in every strand, and streams past the
    # later blocks; one inside it streams past all blocks; with one block and strand each row goes once
    own = F.when(F.col("comp") == F.col("top"), -1).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    lane = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("strands")).cast("int")
    places = F.expr(
        "concat(IF(own < 0, array(), transform(sequence(0, strands - 1), s -> named_struct('x', own, 'y', s, 'side', 0))), "
        "transform(filter(sequence(0, parts - 1), p -> p > own), p -> named_struct('x', p, 'y', lane, 'side', 1)))"
    )
    dealt = rows.withColumns({"own": own, "lane": lane}).withColumn("place", F.explode(places))
    dealt = dealt.select("key", "place.x", "place.y", "place.side", "t", "rep", "comp", "n", "u", "sketch")
    share = percent / 100

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = None, 0
        rep, comp, n = np.zeros((3, 64), np.int64)
        u, sketch = np.zeros((64, COLLECTIONS), np.int32), np.zeros((64, BINS), np.uint8)
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("key", "x", "y", "side", "t", "rep", "comp", "n", "u", "sketch")]
            for key, x, y, side, table, one, its, count, values, drawn in zip(*columns, strict=True):
                if (key, x, y) != group:
                    group, size = (key, x, y), 0
                values, drawn = np.array(values, np.int32), np.frombuffer(drawn, np.uint8)
                # two members of one block are compared in its first strand only
                if side or not y:
                    at = np.flatnonzero(comp[:size] != its)
                    same = u[at] == values
                    first = same.argmax(1)
                    same[np.arange(len(at)), first] = False
                    at = at[first * COLLECTIONS + same.argmax(1) == table]
                    there = (sketch[at] | drawn) != 0
                    filled = there.sum(1)
                    agree = ((sketch[at] == drawn) & there).sum(1)
                    unseen = np.maximum(1 - filled * (1 + share) / (n[at] + count), 0) + 0.02
                    ok = at[agree >= share * filled - DEVIATIONS * np.sqrt(share * (1 - share) * filled * unseen)]
                    if len(ok):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, rep[ok])), pa.array(np.maximum(one, rep[ok]))], ["a", "b"])
                if not side:
                    if size == len(rep):
                        rep, comp, n, u, sketch = (np.concatenate([z, np.zeros_like(z)]) for z in (rep, comp, n, u, sketch))
                    rep[size], comp[size], n[size], u[size], sketch[size] = one, its, count, values, drawn
                    size += 1

    rows = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")
    return rows.mapInArrow(compared, "a bigint, b bigint")


def repeated_ids(sig: DataFrame) -> DataFrame | None:
    """(doc_id, s1, s2, n) of every different set of the ids whose rows have several; None where no id has."""
    kind = F.struct("s1", "s2", "n")
    ids = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo <> hi").select("doc_id")
    ids = materialize(ids, "repeated")
    return None if ids.isEmpty() else materialize(sig.join(ids, "doc_id").select("doc_id", "s1", "s2", "n").distinct(), "repeated-sets")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sig = materialize(signatures(docs), "signatures")
    known = sig.where("n > 0 AND doc_id IS NOT NULL")
    # a class is named by the row key of its smallest document's row, as an id may stand in several classes
    classes = materialize(
        known.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "rk", "u")).alias("m"), F.count("*").alias("copies"))
        .select("s1", "s2", "n", F.col("m.rk").alias("rep"), F.col("m.doc_id").alias("least"), "m.u", "copies"),
        "classes",
    )
    members = table_members(classes.select("rep", "u"))
    wanted = materialize(members.select(F.col("rep").alias("id")).distinct(), "wanted")
    sent = F.broadcast(wanted) if wanted.count() <= most_sent else wanted.hint("merge")
    texts = materialize(keyed(docs).select(F.col("rk").alias("id"), "text").join(sent, "id"), "texts")
    comp = materialize(wanted.select(F.col("id").alias("rep"), F.col("id").alias("comp")), "components")
    for seed in range(STARS):
        pairs, members = star_pairs(members, comp, seed)
        comp = merged(comp, confirm(pairs, texts, percent, most_sent))
    comp = merged(comp, confirm(open_pairs(members, comp, classes.select("rep", "u"), texts), texts, percent, most_sent))
    sets = repeated_ids(sig)
    if sets is not None:
        # rows that repeat a doc_id with other texts are one document, so classes that share an id meet
        nodes = materialize(sets.join(classes, ["s1", "s2", "n"]).select("doc_id", "rep"), "shared-ids")
        alone = nodes.select("rep").distinct().join(comp, "rep", "left_anti")
        comp = materialize(comp.unionByName(alone.select("rep", F.col("rep").alias("comp"))), "components")
        comp = merged(comp, nodes.join(nodes.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")))
    # the smallest doc_id of each component; classes of one row that no other is linked to keep their own
    placed = classes.select("s1", "s2", "n", "rep", "least", "copies").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = materialize(placed, "placed")
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1").select("comp", "component_id")
    labels = materialize(placed.join(smallest, "comp").select("s1", "s2", "n", "component_id"), "class-labels")
    own = sig.join(labels, ["s1", "s2", "n"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id")))
    if sets is not None:
        # of such an id every row, an empty one too, takes the id's component
        by_id = sets.where("n > 0").join(labels, ["s1", "s2", "n"]).groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        own = own.join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("of_id", "component_id"))
    return own.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose document isn't the smallest of its component; columns unchanged."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent).where("NOT kept").select(F.col("doc_id").alias("id")).distinct()
    gone = materialize(gone, "gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["id"], "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
