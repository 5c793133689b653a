"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are quantised to integers.  Candidates are range-partitioned by id and
packed into segments of SEGMENT ids; inside a segment, blocks of BLOCK
consecutive ids have a forward index (their integer rows) and, per component,
their largest and smallest value.  For a query, a block's bound is the sum over
components of the larger of q * max and q * min.  Blocks are taken in order of
their bound and scored through the forward index until the next bound falls
below the query's k-th score so far; what is skipped cannot enter the result.

Before all rows are searched, nested samples of them are, each WIDER times the one
before: a sample's k-th best (score, id) is a bound that the true k-th cannot be
below.  Each search drops what lies below the bound found so far, whole blocks
where their bound shows it, so a search over any number of segments returns about
WIDER * k rows a query at most, in expectation, also where a third of all rows tie.

Queries travel in groups of GROUP: every slot of segments meets every query group
once (an equi-join on slots), so the work is the stated query set against all rows
in blocks.  A group-wise merge keeps the k best; ties go to the smaller id.

Scale: a task holds one segment and one query group at a time, whatever the sizes.
Queries are sent once to each of SLOTS slots a shuffle partition, not to every segment.

Defined cases: rows with a null id, a null vector, or one holding null, NaN or
infinite components take no part; an empty vector scores 0 with everything;
vectors of unequal length meet as if padded with zeros; rows that repeat an id
are separate candidates (all are excluded for a query with that id); of rows that
repeat a query's id, the one with the greatest vector in array order asks;
columns besides vec_id and embedding are not read.  Components are whole numbers
held as doubles, which is exact; a product is a sum in floating point only where
that is exact, else in 64-bit or unlimited integers; a score beyond a long is held
at the long's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelith.llm.shared import materialize

K = 20
SEGMENT = 4096
BLOCK = 256
GROUP = 512
SLOTS = 2
WIDER = 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the rows that take part."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor() of a double would be a long, which large components do not fit; from 2**52 on a double has no fraction
    scaled = lambda x: x.cast("double") * factor
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, v, score, id) of a partition, in order, as (rows, width, ids, values, scores, bounds): size rows each.

    score and id are the least result that a query may still return; null: any.
    """
    names = ["rows", "width", "ids", "values", "scores", "bounds"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, bounds = [], [], []

        def one() -> pa.RecordBatch:
            width = max(map(len, rows))
            table = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                table[i, : len(r)] = r
            score, last = np.array(bounds, np.int64).T
            binary = [np.array(ids, np.int64), table, score, last]
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([width], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()]) for x in binary]], names)

        for b in batches:
            lists = b.column("v")
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            for i, (vec_id, score, last) in enumerate(zip(*(b.column(c).to_pylist() for c in ("vec_id", "score", "id")), strict=True)):
                ids.append(vec_id)
                rows.append(flat[cuts[i] : cuts[i + 1]].copy())
                bounds.append((_LEAST, _MOST) if score is None else (score, last))
                if len(ids) == size:
                    yield one()
                    ids, rows, bounds = [], [], []
        if ids:
            yield one()

    return vectors.select("vec_id", "v", "score", "id").mapInArrow(pack, "rows int, width int, ids binary, values binary, scores binary, bounds binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: through float64 where that holds every sum, else in 64-bit integers or in Python's."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    big, wide = float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0))
    most = big * wide * max(width, 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62 and max(big, wide) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    # object arrays of Python integers
    whole = [np.array([[int(x) for x in r] for r in t], object).reshape(len(t), width) for t in (a, b)]
    return np.array([[min(max(x, _LEAST), _MOST) for x in r] for r in whole[0] @ whole[1].T], np.int64).reshape(len(a), len(b))


def search(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK, score: np.ndarray | None = None, last: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, vec id, score) of each query's k best among ids, and how many blocks were scored.

    Only results of at least `score`, and at that score of ids up to `last`, are returned.
    """
    width = min(queries.shape[1], rows.shape[1])
    least_score = np.full(len(queries), _LEAST) if score is None else score
    last_id = np.full(len(queries), _MOST) if last is None else last
    edges = np.arange(0, len(ids), block)
    most, least = (f.reduceat(rows[:, :width], edges, axis=0) for f in (np.maximum, np.minimum))
    q = queries[:, :width]
    bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    bound += np.abs(bound) * 1e-9  # float sums of integers beyond 2**53 may round down
    order = np.argsort(-bound, axis=1, kind="stable")
    best_score = np.full((len(q), k), _LEAST)
    best_id = np.full((len(q), k), _MOST)
    filled = np.zeros((len(q), k), bool)
    scored = 0
    for turn in range(len(edges)):
        target = order[:, turn]
        kth = np.maximum(np.where(filled[:, -1], best_score[:, -1], _LEAST), least_score)
        active = np.flatnonzero((bound[np.arange(len(q)), target] >= kth) | (kth == _LEAST))
        if not len(active):
            break
        for e in np.unique(target[active]):
            who = active[target[active] == e]
            part = slice(edges[e], edges[e] + block)
            found = products(queries[who], rows[part])
            scored += len(who)
            floor = least_score[who, None]
            apt = (query_ids[who, None] != ids[None, part]) & ((found > floor) | ((found == floor) & (ids[None, part] <= last_id[who, None])))
            at = np.concatenate([best_score[who], found], 1)
            name = np.concatenate([best_id[who], np.broadcast_to(ids[part], found.shape)], 1)
            ok = np.concatenate([filled[who], apt], 1)
            # ~at is -at - 1, which no long overflows
            pick = np.lexsort((name, ~at, ~ok), axis=1)[:, :k]
            take = np.arange(len(who))[:, None]
            best_score[who], best_id[who], filled[who] = at[take, pick], name[take, pick], ok[take, pick]
    n, slot = np.nonzero(filled)
    return query_ids[n], best_id[n, slot], best_score[n, slot], scored


def meet(rows: DataFrame, size: int, wanted: DataFrame, k: int, segment: int, group: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of rows (vec_id, v), about `size`, for each of wanted (vec_id, v, score, id)."""
    free = [F.lit(None).cast("bigint").alias(c) for c in ("score", "id")]
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-size // segment), SLOTS * parallel))
    # no more partitions than segments, whatever a session deals ranges out to: a segment with few rows returns them all
    ordered = rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").coalesce(parts)
    segments = packed(ordered.select("*", *free), segment).select("rows", "width", "ids", "values")
    segments = materialize(segments.withColumn("segment", F.monotonically_increasing_id()), "segments")
    groups = packed(wanted, group).select(*[F.col(c).alias(f"q_{c}") for c in ("rows", "width", "ids", "values", "scores", "bounds")])
    slots = max(1, min(segments.count(), SLOTS * parallel))
    slot = F.pmod(F.xxhash64("segment"), F.lit(slots)).cast("int")
    meetings = groups.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).join(segments.withColumn("slot", slot), "slot")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                q, c = ((np.frombuffer(r[p + "ids"], np.int64), np.frombuffer(r[p + "values"]).reshape(r[p + "rows"], r[p + "width"])) for p in ("q_", ""))
                query_id, vec_id, score, _ = search(*q, *c, k, BLOCK, np.frombuffer(r["q_scores"], np.int64), np.frombuffer(r["q_bounds"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"])

    found = meetings.mapInArrow(met, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, segment: int = SEGMENT, group: int = GROUP, wider: int = WIDER) -> DataFrame:
    """query_id, rank, vec_id, score.  Both inputs: vec_id, embedding.  Queries may
    be rows of vectors; a candidate with the query's own id is left out."""
    rows = materialize(quantised(vectors), "vectors")
    asking = materialize(quantised(queries).groupBy("vec_id").agg(F.max("v").alias("v")), "queries")
    wanted = asking.withColumns({"score": F.lit(None).cast("bigint"), "id": F.lit(None).cast("bigint")})
    every, size = rows.count(), segment
    while size < every:
        sample = rows.where(F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 30)) < int((1 << 30) * size / every))
        kth = meet(sample, size, wanted, k, segment, group).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score", F.col("vec_id").alias("id"))
        wanted = asking.join(materialize(kth, "bounds"), "vec_id", "left")
        size *= wider
    return meet(rows, every, wanted, k, segment, group)


def digest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    slim = vectors.select("vec_id", "embedding")
    return top_k(slim, slim.where(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
