"""Exact top-k search by inner product, term at a time.

A vector is a sparse row of integer weights, a posting list holds the weights
of one dimension ("term") over a block of candidates. Queries scatter their
weighted postings into one dense array of scores a block; a partition
selection keeps the block's best, and a ranked merge keeps the best overall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a packed block of candidates or queries: bounds the memory of a task.
BLOCK = 4096
#: Queries scored together: a dense array of QUERY_STEP x BLOCK scores.
QUERY_STEP = 64
#: Blocks of candidates that a task holds on average.
SALT_BLOCKS = 4


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, weights array<bigint>): floor(scale * x) of each component as double.

    Vectors that are null or hold a null or non-finite component take no part,
    nor do rows without a key. Of rows with the same key the smallest vector
    counts once.
    """
    usable = vectors.select(F.col(key).alias("id"), F.col(vector).alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    usable = usable.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return usable.groupBy("id").agg(F.min("x").alias("x")).select("id", F.transform("x", lambda v: F.floor(v.cast("double") * scale)).alias("w"))


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of up to ``block`` rows of a partition: (ids, weights) as little-endian bytes, and the width."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, flat, width):
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_pydict({"ids": [ids[order].tobytes()], "weights": [flat.reshape(len(ids), width)[order].tobytes()], "width": pa.array([width], pa.int32()), "rows": pa.array([len(ids)], pa.int32())})

        held: dict[int, list] = {}
        for batch in batches:
            w = batch.column("w")
            widths = pc.list_value_length(w).to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = w.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(widths)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                flat = values[(ends[at] - width)[:, None] + np.arange(width)]
                kept = held.setdefault(int(width), [np.zeros(0, np.int64), np.zeros((0, int(width)), np.int64)])
                kept[0], kept[1] = np.concatenate([kept[0], ids[at]]), np.concatenate([kept[1], flat])
                while len(kept[0]) >= block:
                    yield from out(kept[0][:block], kept[1][:block], int(width))
                    kept[0], kept[1] = kept[0][block:], kept[1][block:]
        for width, (ids, flat) in held.items():
            if len(ids):
                yield from out(ids, flat, width)

    return rows.mapInArrow(pack, "ids binary, weights binary, width int, rows int")


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest scores of each row; of equal ones those that stand first."""
    n = scores.shape[1]
    take = min(k, n)
    largest = max(abs(int(scores.max(initial=0))), abs(int(scores.min(initial=0))))
    if largest < 2**62 // max(n, 1):
        # one number orders by score, then by place
        order = scores * n + np.arange(n - 1, -1, -1, dtype=np.int64)
        return np.argpartition(order, n - take, axis=1)[:, n - take :]
    return np.argsort(~scores, axis=1, kind="stable")[:, :take]


def block_scores(k: int):
    """A mapInArrow function: rows of (queries, candidates), by block of queries, to the k best candidates of each query.

    What is best so far of a block of queries is merged with the next block of
    candidates, and goes out once another block of queries begins.
    """

    def scored(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        postings = np.ascontiguousarray(c.T)  # one row of weights a term
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
        if largest >= 2**63:
            # sums that might not fit are made of whole numbers of any size
            exact = q.astype(object) @ postings.astype(object)
            return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
        kind = np.int32 if largest < 2**31 else np.int64
        postings, q = postings.astype(kind), q.astype(kind)
        scores = np.zeros((len(q), c.shape[0]), kind)
        for term in np.flatnonzero(q.any(axis=0)):
            having = np.flatnonzero(q[:, term])
            scores[having] += q[having, term, None] * postings[term]
        return scores.astype(np.int64)

    def merged(best: tuple[np.ndarray, ...], q_ids, q, c_ids, c) -> tuple[np.ndarray, ...]:
        """(ids, scores, whether it is the query itself), a row a query: the best of both."""
        parts = []
        for at in range(0, len(q_ids), QUERY_STEP):
            own, new = q_ids[at : at + QUERY_STEP], scored(q[at : at + QUERY_STEP], c)
            # the query itself gives its place to one more
            top = best_of(new, k + 1)
            row = np.arange(len(own))[:, None]
            both_ids = np.concatenate([best[0][at : at + QUERY_STEP], c_ids[top]], axis=1)
            both = np.concatenate([best[1][at : at + QUERY_STEP], new[row, top]], axis=1)
            gone = np.concatenate([best[2][at : at + QUERY_STEP], c_ids[top] == own[:, None]], axis=1)
            order = np.lexsort((both_ids, ~both, gone), axis=1)[:, :k]
            parts.append((both_ids[row, order], both[row, order], gone[row, order]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def out(q_ids, best) -> pa.RecordBatch:
        row, col = np.nonzero(~best[2])
        return pa.RecordBatch.from_pydict({"query_id": q_ids[row], "vec_id": best[0][row, col], "score": best[1][row, col]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q_ids, q, best = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                asked = (batch.column("q_ids")[i].as_py(), batch.column("width")[i].as_py())
                if asked != last:
                    if last is not None:
                        yield out(q_ids, best)
                    last, q_ids = asked, np.frombuffer(asked[0], np.int64)
                    q = np.frombuffer(batch.column("q_weights")[i].as_py(), np.int64).reshape(len(q_ids), asked[1])
                    best = np.zeros((len(q_ids), 0), np.int64), np.zeros((len(q_ids), 0), np.int64), np.zeros((len(q_ids), 0), bool)
                c_ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                c = np.frombuffer(batch.column("weights")[i].as_py(), np.int64).reshape(len(c_ids), asked[1])
                best = merged(best, q_ids, q, c_ids, c)
        if last is not None:
            yield out(q_ids, best)

    return run


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query=None, k: int = 20, scale: int = 64) -> DataFrame:
    """The k best other rows of each query row by integer inner product: query_id, rank, vec_id, score.

    ``is_query`` is a Column on ``id`` (default: every id divisible by 20).
    Ties go to the smaller id. Candidates with another number of components
    than the query are left out. Fewer than k candidates: all are returned.
    Empty input: no rows. Other columns aren't read. Components and scores
    beyond 64 bits count as the largest or smallest number of 64 bits. Blocks of queries meet blocks of candidates
    through an equi-join on a salt, so neither side is broadcast. A salt has
    about SALT_BLOCKS blocks of candidates, however many there are; a task holds
    those and one block of queries.
    """
    rows = quantised(vectors, key, vector, scale)
    chosen = (F.col("id") % 20 == 0) if is_query is None else is_query
    counts = rows.agg(F.count("*").alias("n"), F.count_if(chosen).alias("asked")).first()
    salts = max(1, -(-counts["n"] // (BLOCK * SALT_BLOCKS)))
    candidates = packed(rows).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    blocks = -(-counts["asked"] // BLOCK) or 1
    queries = packed(rows.where(chosen).repartition(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)))).select(F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), "width")
    # each block of queries goes once to every salt, each block of candidates to its own
    queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    # the candidates of a salt are looked up for one block of queries after the other
    pairs = queries.repartition(salts, "salt", "width").join(candidates.repartition(salts, "salt", "width").hint("shuffle_hash"), ["salt", "width"])
    scored = pairs.select("q_ids", "q_weights", "ids", "weights", "width").mapInArrow(block_scores(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
