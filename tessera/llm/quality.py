"""Quality classifier: regularised quadratic discriminant analysis.

Each class has a Gaussian over transformed statistics of a document, with a
covariance shrunk towards its diagonal mean. A score is the difference of the
two log-densities, from Mahalanobis distances by cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import LOWER, flat, run_starts, slices, span_hashes, words

#: Kinds of bytes: lower case, upper case, digit, white space, sentence marks, other marks, beyond ASCII.
KINDS = np.full(256, 5, np.uint8)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = 0, 1, 2, 6
KINDS[[9, 10, 11, 12, 13, 32]] = 3
KINDS[[ord(c) for c in ".,;:?!'\"()-"]] = 4
N_KINDS = 7
WIDTH = 8 + N_KINDS - 1
#: Weight of the pooled diagonal in a class covariance.
SHRINKAGE = 0.02
#: Added to the sizes that counts are divided by, so that a mark or two don't decide on a short text.
PRIOR_BYTES, PRIOR_WORDS = 32, 8
#: Added to the variances of the standardised statistics.
RIDGE = 1e-3


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) transformed statistics; those of an empty text are zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * N_KINDS + KINDS[data], minlength=N_KINDS * n).reshape(n, N_KINDS).astype(float)
    lines = 1 + np.bincount(owner[data == 10], minlength=n)
    starts, ends, doc = words(data, offsets)
    lowered = LOWER[data]
    hashes = span_hashes(lowered, starts, ends)
    count = np.bincount(doc, minlength=n).astype(float)
    repeated = np.zeros(n)
    same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    repeated += np.bincount(doc[1:][same], minlength=n)
    order = np.lexsort((hashes, doc))
    distinct = np.bincount(doc[order][run_starts(doc[order], hashes[order])], minlength=n)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(count, 1)
    square = np.bincount(doc, length**2, n) / np.maximum(count, 1)
    # marks that follow one of their own kind, and words of marks alone
    mark = (KINDS[data] == 4) | (KINDS[data] == 5)
    again = np.flatnonzero(mark[1:] & (data[1:] == data[:-1])) + 1
    doubled = np.bincount(owner[again], minlength=n)
    marks = np.concatenate([[0], np.cumsum(mark)])
    bare = np.bincount(doc[marks[ends] - marks[starts] == ends - starts], minlength=n)
    share = np.sqrt(kinds / (size + PRIOR_BYTES)[:, None])
    out = np.column_stack(
        [
            np.log1p(count),
            mean,
            np.sqrt(np.maximum(square - mean**2, 0)),
            np.log1p(distinct) / np.log1p(np.maximum(count, 1)) * (count > 0),
            np.sqrt(repeated / (count + PRIOR_WORDS)),
            np.log1p(count / lines),
            np.sqrt(doubled / (size + PRIOR_BYTES)),
            np.sqrt(bare / (count + PRIOR_WORDS)),
            share[:, 1:],
        ]
    )
    out[size == 0] = 0
    return out


def with_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features array<double>), a row for each row of documents."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = statistics(*flat(batch.column("t")))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, WIDTH, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), rows], names=["k", "features"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, features array<double>").withColumnRenamed("k", key)


class Discriminant:
    """Two Gaussians; class 1 is the wanted one."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        self.prior = None
        known = {c: m for c, m in moments.items() if m[0] > 0}
        if len(known) < 2:
            # one class or none to learn from: its score is certain, or even
            self.constant = 0.5 if not known else float(next(iter(known)))
            return
        total = sum(m[0] for m in known.values())
        self.mean = sum(m[1] for m in known.values()) / total
        spread = np.diag(sum(m[2] for m in known.values())) / total - self.mean**2
        self.scale = np.sqrt(np.maximum(spread, 0))
        self.scale[self.scale < 1e-9] = 1
        self.classes = []
        for c in (0, 1):
            n, sums, squares = known[c]
            centre = sums / n
            cov = (squares / n - np.outer(centre, centre)) / np.outer(self.scale, self.scale)
            cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / WIDTH * np.eye(WIDTH) + RIDGE * np.eye(WIDTH)
            factor = np.linalg.cholesky(cov)
            self.classes.append(((centre - self.mean) / self.scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / total)))
        self.prior = True

    def score(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher where class 1 is likelier."""
        if self.prior is None:
            return np.full(len(features), self.constant)
        x = (features - self.mean) / self.scale
        log = []
        for centre, inverse, logdet, prior in self.classes:
            z = (x - centre) @ inverse.T
            log.append(prior - 0.5 * (logdet + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Class moments over all labelled rows whose crc32(key) mod 3 is not 1.

    Of several labels of a key the smallest counts; a null label is none. The
    moments are 2 x (1 + WIDTH + WIDTH (WIDTH + 1) / 2) sums, whatever the number of rows.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(label).cast("int").alias("c"))
    rows = features.join(marks, key).select("c", *[F.element_at("features", i + 1).alias(f"x{i}") for i in range(WIDTH)])
    pairs = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
    sums = rows.groupBy("c").agg(F.count("*").alias("n"), F.array(*[F.sum(f"x{i}") for i in range(WIDTH)]).alias("s"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("q"))
    moments = {}
    for r in sums.where("c in (0, 1)").collect():
        squares = np.zeros((WIDTH, WIDTH))
        for (i, j), v in zip(pairs, r["q"]):
            squares[i, j] = squares[j, i] = v
        moments[r["c"]] = (r["n"], np.array(r["s"]), squares)
    return Discriminant(moments, shrinkage)


def held_out(key: str):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(key, held_out, score, predicted) of each row of documents.

    Null and empty texts are scored like any other (their statistics are
    zeros). Null keys and repeated rows stay as they are; other columns are
    not read. Without labels of both classes the score is 0.5, or the only
    class's.
    """
    model = fit(with_statistics(documents, key, text), labels, key, label)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(model.score(statistics(*flat(batch.column("t")))))], names=["k", "score"])

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of documents whose text is predicted good, with their own columns."""
    model = fit(with_statistics(documents, key, text), labels, key)
    columns = documents.columns
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            good = model.score(statistics(*flat(batch.column(text)))) >= threshold
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(run, schema).select(*columns)
