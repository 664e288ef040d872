"""Line dedup with a fixed-depth tree of log templates.

A line goes down the tree by its number of tokens, then by its leading tokens;
the leaf holds its templates. Tokens with a digit are variable fields, as long
as words are at least as many. Behind the leading tokens a leaf's templates
leave more fields open: one or two tokens of a short line, one or two of a few
segments of a longer one, one segment of a long one. A line falls under each
template that it matches, whole or generalised. Templates are 64-bit keys,
counted over documents by a grouped aggregate, so a template that every
document carries costs a row a task, not a group; what a field is comes out of
the count, as only templates that really recur get over the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import LOWER, flat, lists, mix, run_starts, signed, slices, span_hashes, words

#: Leading tokens that every template keeps: of lines of LONG tokens or more, and of shorter ones.
DEPTH, SHORT_DEPTH = 3, 1
#: Tokens from which on a line is generalised by tokens, by segments, and by single segments alone.
SHORT, LONG, LONGEST = 4, 12, 25
#: Parts of the rest of a longer line.
SEGMENTS = 4
#: Of a short line's tokens so many in five may be fields.
OPEN_OF_FIVE = 2
#: A template is recurring from so many documents on; one with open tokens, of a short line, from more. A line that two
#: documents share is mostly part of a pair of copies, which near-dedup removes whole.
MIN_DOCS, MIN_DOCS_OPEN = 3, 5
FIELD = np.uint64(0xF1E1D)
PLACE = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, line of each key, and by line: text number, start, end) of the lines with a token.

    Keys of templates with open tokens are odd, all others even.
    """
    lowered = LOWER[data]
    starts, ends, doc = words(lowered, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), doc, starts, ends
    h = span_hashes(lowered, starts, ends)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    field = digits[ends] > digits[starts]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts] + doc
    first = run_starts(line)
    n = np.diff(np.append(first, len(line)))
    fields = np.add.reduceat(field, first, dtype=np.int64)
    field &= np.repeat(2 * fields <= n, n)  # a line of more numbers than words has its own tokens
    h[field] = FIELD
    place = np.arange(len(line)) - np.repeat(first, n)
    term = mix(h + place.astype(np.uint64) * PLACE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    size = mix(n.astype(np.uint64))
    whole = sums[first + n] - sums[first] + size
    keys, whose = [mix(whole) & ~ONE], [np.arange(len(n))]
    # segments of longer lines
    long = np.flatnonzero(n >= LONG)
    parts = [first[long] + DEPTH + (n[long] - DEPTH) * j // SEGMENTS for j in range(SEGMENTS + 1)]
    part = [sums[parts[j + 1]] - sums[parts[j]] for j in range(SEGMENTS)]
    brief = n[long] < LONGEST
    for i in range(SEGMENTS):
        keys.append(mix(whole[long] - part[i] + np.uint64(i + 1) * FIELD) & ~ONE)
        whose.append(long)
        for j in range(i + 1, SEGMENTS):
            keys.append(mix((whole[long] - part[i] - part[j])[brief] + np.uint64((i + 1) * 64 + j + 1) * FIELD) & ~ONE)
            whose.append(long[brief])
    # tokens of short ones
    for m in range(SHORT, LONG):
        own = np.flatnonzero(n == m)
        if not len(own):
            continue
        at = first[own][:, None] + np.arange(m)
        terms, fixed = term[at], ~field[at]
        given = m - fixed.sum(axis=1)
        for i in range(SHORT_DEPTH, m):
            for j in range(i, m):
                more = 1 if i == j else 2
                use = fixed[:, i] & fixed[:, j] & (5 * (given + more) <= OPEN_OF_FIVE * m)
                left_out = terms[use, i] + (terms[use, j] if j > i else np.uint64(0))
                keys.append(mix(whole[own][use] - left_out + np.uint64((i + 1) * 64 + j + 1) * FIELD) | ONE)
                whose.append(own[use])
    at = doc[first]
    # the line's own bounds: from after the break before its first token to the break after its last
    newlines = np.concatenate([np.flatnonzero(data == 10), [len(data)]])
    before = np.searchsorted(newlines, starts[first]) - 1
    left = np.maximum(np.where(before >= 0, newlines[np.maximum(before, 0)] + 1, 0), offsets[at])
    right = np.minimum(newlines[np.searchsorted(newlines, starts[first])], offsets[at + 1])
    return np.concatenate(keys), np.concatenate(whose), at, left, right


def templates(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, template): each template of each row of documents once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            keys, whose, doc, _, _ = line_keys(*flat(batch.column("t")))
            owner = doc[whose]
            order = np.lexsort((keys, owner))
            at = order[run_starts(owner[order], keys[order])]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner[at])), pa.array(signed(keys[at]))], names=["id", "template"])

    return documents.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {dict(documents.dtypes)[key]}, template bigint")


def recurring(documents: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_docs_open: int = MIN_DOCS_OPEN) -> DataFrame:
    """(id, drop array<bigint>): the recurring templates of each document that isn't their first carrier."""
    entries = templates(documents, key, text)
    least = F.when(F.col("template") % 2 == 0, min_docs).otherwise(min_docs_open)
    known = entries.groupBy("template").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where((F.col("n") >= least) & (F.col("last") > F.col("first"))).select("template", "first")
    return entries.join(known, "template").where("id <> first").groupBy("id").agg(F.collect_set("template").alias("drop"))


def without_recurring_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_docs_open: int = MIN_DOCS_OPEN, dropped: str | None = None) -> DataFrame:
    """Documents without the lines of a template that recurs in ``min_docs`` documents or more.

    Templates with open tokens count from ``min_docs_open`` on. The document with the smallest key keeps its lines: of copies one stays
    whole. Lines are compared with A-Z lower-cased and by tokens between white
    space; blank lines stay. A document that loses every line keeps its row,
    with an empty text. Null texts stay null, rows without a key stay as they
    are, and rows that repeat a key count once each. All columns are kept;
    ``dropped`` names one more for the number of lines taken out.
    """
    columns = documents.columns
    schema = ", ".join(f"`{c}` {k}" for c, k in documents.dtypes) + ", `\u0001drop` array<bigint>, `\u0001lines` int"
    lost = recurring(documents, key, text, min_docs, min_docs_open).select(F.col("id").alias(key), F.col("drop").alias("\u0001drop"))
    rows = documents.join(lost, key, "left").select(*[F.col(f"`{c}`") for c in columns], "\u0001drop", F.lit(0).alias("\u0001lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            marked = pc.is_valid(batch.column("\u0001drop"))
            untouched = batch.filter(pc.invert(marked))
            if untouched.num_rows:
                yield untouched
            batch = batch.filter(marked)
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column(text))
            keys, whose, doc, left, right = line_keys(data, offsets)
            drop = batch.column("\u0001drop")
            bad = signed(drop.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(drop).to_numpy(zero_copy_only=False))
            # (row, key) pairs that are to go, looked up by one mixed number
            wanted = np.sort(mix(bad + mix(owner.astype(np.uint64))))
            have = mix(keys + mix(doc.astype(np.uint64))[whose])
            at = np.searchsorted(wanted, have)
            hit = np.zeros(len(doc), bool)
            hit[whose[wanted[np.minimum(at, len(wanted) - 1)] == have]] = True
            gone = np.zeros(len(data) + 1, np.int32)
            # a line goes with the break after it, the last line with the break before it
            a, b = left[hit].copy(), right[hit].copy()
            end = offsets[doc[hit] + 1]
            b[b < end] += 1
            np.add.at(gone, a, 1)
            np.add.at(gone, b, -1)
            keep = np.cumsum(gone[:-1]) == 0
            kept = data[keep]
            bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
            texts = pa.array([bytes(kept[s:e]).decode() for s, e in zip(bounds[:-1], bounds[1:])], pa.string())
            lines = np.bincount(doc[hit], minlength=batch.num_rows).astype(np.int32)
            stripped = pc.if_else(pa.array(lines > 0), pc.utf8_rtrim(texts, "\n"), texts)
            stripped = pc.if_else(pc.is_valid(batch.column(text)), stripped, pa.scalar(None, pa.string()))
            arrays = [stripped if c == text else pa.array(lines) if c == "\u0001lines" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in columns], *([F.col("\u0001lines").alias(dropped)] if dropped else []))
