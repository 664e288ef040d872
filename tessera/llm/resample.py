"""Importance resampling towards a target distribution, with an exact distributed draw.

Documents and target texts are bags of hashed word n-grams. A bucket's gain is
the logarithm of how much likelier it is in the target than in the corpus; the
gains are one array, and a document's weight is their sum over its features.
Adding Gumbel noise from the document's key to the weights and taking the
largest draws without replacement in proportion to them. The draw is exact at
any size: a radix selection over the digits of (score, key) finds the last key
that is drawn by a few grouped counts, and only drawn rows are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import LOWER, Tables, flat, slices, words
from tessera.operators.ordering import numbered
from tessera.session import kept

#: Buckets of features, and the longest run of words that is a feature.
BUCKETS, GRAMS = 10_000, 3
#: Of the documents with LEAST_WORDS words or more so many in a hundred are drawn.
PER_CENT, LEAST_WORDS = 5, 20
SEED = 42
#: Bits of a digit of the radix selection; a count of 2 ** DIGIT rows comes to the driver at most.
DIGIT = 12
OFFSET = 1 << 63

#: A word is a run of a-z, 0-9 and bytes of non-ASCII characters, after A-Z is lower-cased.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Words of more bytes are hashed one by one.
LONG = 64
#: Words whose features are worked on at once.
STEP = 1 << 17

_tables = Tables()


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a byte's step, [n][4][256]: the four bytes of a state moved on by n zero bytes, the same by 64 * 2 ** n)."""
    if "step" not in _tables:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
        one = np.arange(256, dtype=np.uint32)
        near = [np.stack([one << np.uint32(8 * k) for k in range(4)])]
        for _ in range(LONG):
            near.append((near[-1] >> np.uint32(8)) ^ step[near[-1] & np.uint32(255)])
        far = [near[LONG]]
        for _ in range(30):
            far.append(_moved(far[-1], far[-1]))
        _tables["step"], _tables["near"], _tables["far"] = step, np.stack(near), np.stack(far)
    return _tables["step"], _tables["near"], _tables["far"]


def _moved(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][state & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ table[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def shifted(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC states after n more zero bytes each; the CRC is linear, so a state of joined spans is a xor of shifted ones."""
    _, near, far = _crc_tables()
    low = n & (LONG - 1)
    out = np.zeros_like(state)
    for k in range(4):
        out ^= near[low, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
    rest, bit = n >> 6, 0
    while (rest >> bit).any():
        own = np.flatnonzero((rest >> bit) & 1)
        out[own] = _moved(out[own], far[bit])
        bit += 1
    return out


def states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC state of each span, from the state 0."""
    step, _, _ = _crc_tables()
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    sorted_size, at = size[order], starts[order]
    out = np.zeros(len(starts), np.uint32)
    many = int(np.searchsorted(-sorted_size, -LONG, "left"))  # spans of over LONG bytes
    for j in range(int(sorted_size[many]) if many < len(order) else 0):
        upto = int(np.searchsorted(-sorted_size, -j, "left"))
        c = out[many:upto]
        out[many:upto] = (c >> np.uint32(8)) ^ step[(c ^ data[at[many:upto] + j]) & np.uint32(255)]
    for i in range(many):
        out[i] = zlib.crc32(data[at[i] : at[i] + sorted_size[i]])
    if many:
        start = np.full(many, 0xFFFFFFFF, np.uint32)  # what zlib begins with, taken off again
        out[:many] ^= shifted(start, sorted_size[:many]) ^ np.uint32(0xFFFFFFFF)
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of each feature of each text, in steps of STEP words."""
    lowered = LOWER[data]
    starts, ends, doc = words(lowered, offsets, BREAKS)
    step, _, _ = _crc_tables()
    for at in range(0, len(starts), STEP):
        own = min(STEP, len(starts) - at)
        s, e, d = (x[at : at + own + GRAMS - 1] for x in (starts, ends, doc))
        word = states(lowered, s, e)
        size = e - s
        # the state of a blank and the word
        behind = word ^ shifted(np.full(len(word), step[32], np.uint32), size)
        state, length = word[:own], size[:own]
        for n in range(1, GRAMS + 1):
            if n > 1:
                last = np.arange(n - 1, min(own + n - 1, len(s)))
                state, length = state[: len(last)], length[: len(last)]
                state = shifted(state, size[last] + 1) ^ behind[last]
                length = length + size[last] + 1
            crc = state ^ shifted(np.full(len(state), 0xFFFFFFFF, np.uint32), length) ^ np.uint32(0xFFFFFFFF)
            inside = d[: len(state)] == d[n - 1 : n - 1 + len(state)]
            yield d[: len(state)][inside], (crc[inside] % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame, text: str) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends a row a bucket at most, the driver gets BUCKETS."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "t"):
            for _, bucket in features(*flat(batch.column("t"))):
                sums += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["b", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(F.col(text).cast("string").alias("t")).mapInArrow(partial, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down."""
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, key: str, text: str) -> DataFrame:
    """(k, n_words, n_features, weight) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            data, offsets = flat(batch.column("t"))
            n = len(offsets) - 1
            count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for doc, bucket in features(data, offsets):
                count += np.bincount(doc, minlength=n)
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                weight += np.diff(sums[np.searchsorted(doc, np.arange(n + 1))])
            # w words have w + (w - 1) + ... features
            full = GRAMS * (GRAMS - 1) // 2
            n_words = np.where(count >= GRAMS * (GRAMS + 1) // 2, (count + full) // GRAMS, 0)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n_words), pa.array(count), pa.array(weight)], names=["k", "n_words", "n_features", "weight"])

    return documents.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "k bigint, n_words bigint, n_features bigint, weight bigint")


def first_rows(rows: DataFrame, order: list[Column], k: int) -> Column:
    """Which of rows are the k first by ``order``, columns of whole numbers that together differ for all rows.

    A radix selection from the highest digit on: a grouped count of one digit
    of the rows that agree with the k-th in all digits before it says what
    digit the k-th row has there. It ends when all rows that agree are among
    the first. No rows are moved; the table is read once a digit.
    """
    if k <= 0:
        return F.lit(False)
    bounds = rows.agg(F.count("*"), *[f(c) for c in order for f in (F.min, F.max)]).first()
    if k >= bounds[0]:
        return F.lit(True)
    chosen, level = F.lit(False), F.lit(True)
    for i, column in enumerate(order):
        # as unsigned numbers, so that digits are in order; those that all rows share are skipped
        low, high = bounds[1 + 2 * i] + OFFSET, bounds[2 + 2 * i] + OFFSET
        done = (low ^ high).bit_length()
        prefix = low >> done
        while done:
            bits = min(DIGIT, done)
            at_least, at_most = _range(prefix, done)
            done -= bits
            digit = F.shiftrightunsigned(column.bitwiseXOR(F.lit(-OFFSET)), done).bitwiseAND(F.lit((1 << bits) - 1))
            counts = rows.where(level & column.between(at_least, at_most)).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()
            for r in sorted(counts, key=lambda r: r["d"]):
                if r["n"] >= k:
                    break
                k -= r["n"]
            prefix = (prefix << bits) + r["d"]
            if r["n"] == k:  # all rows that agree so far are among the first, and all before them
                return chosen | (level & (column <= _range(prefix, done)[1]))
        chosen = chosen | (level & (column < prefix - OFFSET))
        level = level & (column == prefix - OFFSET)
    raise ValueError("order has equal rows")


def _range(prefix: int, shift: int) -> tuple[int, int]:
    """The smallest and the largest number whose digits above ``shift`` are ``prefix``."""
    return (prefix << shift) - OFFSET, ((prefix + 1) << shift) - 1 - OFFSET


def resample(documents: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank, n_words): each document's weight, noisy score and place in the draw.

    Features are runs of 1 to 3 words; of the N documents with at least
    ``least_words`` words floor(per_cent * N / 100) with the highest scores are
    drawn and ranked from 1, ties to the smaller key; other ranks are null. A
    text that is null or empty has no features and weight 0. A row without a
    key has no score, doesn't count in N and is never drawn; its features
    count. Rows that repeat a key are rows of their own; of rows with equal key
    and score those with more features come first. Other columns are left out.
    """
    gain = gains(bucket_counts(documents, text), bucket_counts(target, target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")
    scored = kept(weighed(documents, gain, key, text).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))
    able = (F.col("n_words") >= least_words) & F.col("k").isNotNull()
    order = [F.bitwise_not("score"), F.col("k"), F.bitwise_not("n_features"), F.col("row")]
    n = scored.where(able).count()
    drawn = able & first_rows(scored.where(able), order, per_cent * n // 100)
    ranked = numbered(scored.where(drawn), [F.desc("score"), F.asc("k"), F.desc("n_features"), F.asc("row")], "rank")
    names = [F.col("k").alias(key), "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*names).union(scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint")).select(*names))
