"""Repeated passages by sparse suffix arrays.

Every passage of ``MIN_WORDS`` words (a window) has a head: the k-word gram in
it that is the minimum, the first of equal ones. Only the suffixes that begin
at heads are retained, each with the words before and behind the head that its
windows reach. Suffixes whose head stands in one document alone are left out
by a grouped count; the others meet by their heads. There they are sorted by
what follows, and once more by what precedes, read backwards; the common
lengths of neighbours in both orders say how far any of them match to the
right and to the left. Suffixes that agree in enough words on both sides
together share a window, and the spans of a document are joined. Every split
of a window into the two sides is looked at, so no partner is missed, however
far apart two suffixes stand in either order. The windows of heads that are too
common for one task are counted by grouped aggregates instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.kernels import LOWER, flat, lists, ranges, run_starts, signed, slices, span_hashes, words
from tessera.session import written

#: Words of the shortest passage that counts, of a window's head, and grams in a window.
MIN_WORDS, HEAD = 50, 25
WINDOW = MIN_WORDS - HEAD + 1
#: Windows of one head that a task compares at once; those of more common heads are counted by aggregates.
MOST = 1 << 18
#: Parts that the documents of a common window are dealt out to.
SALTS = 64


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the least values of each run of ``width`` values stands."""
    at, size = np.arange(len(x)), 1

    def chosen(a, b):
        return np.where(x[b] < x[a], b, a)

    while size * 2 <= width:
        at, size = chosen(at[:-size], at[size:]), size * 2
    rest = width - size
    return chosen(at[: len(at) - rest], at[rest:]) if rest else at


class Suffixes:
    """The retained suffixes of some texts: head's hash, text number, first window's first word, windows, and words before and behind."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lowered = LOWER[data]
        starts, ends, doc = words(lowered, offsets)
        self.word = span_hashes(lowered, starts, ends)
        if len(self.word) < MIN_WORDS:
            self.head = np.zeros(0, np.uint64)
            self.owner = self.at = self.first = self.n = self.inside = np.zeros(0, np.int64)
            return
        every = np.arange(len(self.word) - HEAD + 1)
        grams = span_hashes(self.word, every, every + HEAD)
        at = first_least(grams, WINDOW)
        window = np.flatnonzero(doc[: len(at)] == doc[MIN_WORDS - 1 :])
        run = run_starts(at[window], doc[window])
        self.n = np.diff(np.append(run, len(window)))
        self.first, self.at = window[run], at[window[run]]
        self.head, self.owner = grams[self.at], doc[self.first]
        self.inside = self.first - np.searchsorted(doc, self.owner)

    def keep(self, mask: np.ndarray) -> None:
        for name in ("head", "owner", "at", "first", "n", "inside"):
            setattr(self, name, getattr(self, name)[mask])

    def sides(self) -> tuple[pa.Array, pa.Array]:
        """The hashes of the words before and behind each head."""
        left = self.at - self.first
        right = self.n + WINDOW - 2 - left
        return tuple(lists(signed(self.word[ranges(at, n)]), np.concatenate([[0], np.cumsum(n)])) for at, n in ((self.first, left), (self.at + HEAD, right)))


def heads(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, n): each head of each document once, and how many windows of the document have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = Suffixes(*flat(batch.column("t")))
            n, h, owner = found.n, found.head, found.owner
            order = np.lexsort((h, owner))
            at = run_starts(owner[order], h[order])
            n = np.add.reduceat(n[order], at) if len(at) else n
            at = order[at]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner[at])), pa.array(signed(h[at])), pa.array(n)], names=["id", "h", "n"])

    return documents.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id bigint, h bigint, n bigint")


def candidates(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(h, id, first, left, right, common): the suffixes whose head is in two documents or more.

    ``first`` is the first word of the first window that has the head there,
    ``left`` and ``right`` are the words around it; ``common`` marks heads of
    over MOST windows.
    """
    entries = heads(documents, key, text)
    shared = entries.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), (F.sum("n") > MOST).alias("common")).where("a < b").select("h", "common")
    wanted = entries.join(shared, "h").groupBy("id").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("common"), F.col("h"))).alias("cs"))

    def known(column: pa.Array) -> np.ndarray:
        return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = Suffixes(*flat(batch.column("t")))
            found.keep(np.isin(signed(found.head), known(batch.column("hs"))))
            h = signed(found.head)
            left, right = found.sides()
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("id").take(pa.array(found.owner)), pa.array(found.inside.astype(np.int32)), left, right, pa.array(np.isin(h, known(batch.column("cs"))))], names=["h", "id", "first", "left", "right", "common"])

    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(wanted, "id").select("id", "t", "hs", "cs")
    return rows.mapInArrow(run, "h bigint, id bigint, first int, left array<bigint>, right array<bigint>, common boolean")


def around(column: pa.Array, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words) of lists of up to WINDOW - 1 words, a row each, read away from the head."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), WINDOW - 1), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[row, np.repeat(n, n) - 1 - place if backwards else place] = column.flatten().to_numpy(zero_copy_only=False)
    return out, n


class Ordered:
    """Suffixes in the order of their heads and of the words that are read on from them, with what neighbours have in common."""

    def __init__(self, head: np.ndarray, read: np.ndarray):
        self.order = np.lexsort((*read.T[::-1], head))
        same = read[self.order[1:]] == read[self.order[:-1]]
        # the common length of neighbours; none if their heads differ
        self.common = np.where(head[self.order[1:]] == head[self.order[:-1]], np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64), -1)

    def classes(self, n: int) -> np.ndarray:
        """By suffix a number that those have in common that agree in n words or more: they stand together."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.common < n)
        return out


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by head to the spans of their windows that stand in another document too."""

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, first, head = (t.column(c).to_numpy() for c in ("id", "first", "h"))
        column = lambda c: pa.concat_arrays(t.column(c).chunks)
        (before, n_left), (behind, n_right) = around(column("left"), True), around(column("right"), False)
        windows = n_left + n_right - (WINDOW - 2)
        left, right = Ordered(head, before), Ordered(head, behind)
        low, high, other = np.full(len(ids), WINDOW), np.full(len(ids), -1), np.full(len(ids), np.iinfo(np.int64).max)
        for a in range(WINDOW):
            # windows with a words before the head, and so WINDOW - 1 - a behind it
            row = np.flatnonzero((a <= n_left) & (a > n_left - windows))
            if len(row) < 2:
                continue
            match = left.classes(a)[row] * (len(ids) + 1) + right.classes(WINDOW - 1 - a)[row]
            order = np.lexsort((ids[row], match))
            # each document of each match once, and the first two documents of it
            at = run_starts(match[order], ids[row][order])
            group = run_starts(match[order][at])
            size = np.diff(np.append(group, len(at)))
            own = ids[row][order][at]
            one, two = own[group], own[np.minimum(group + 1, len(at) - 1)]
            one, two, many = (np.repeat(x, size) for x in (one, two, size > 1))
            often = np.diff(np.append(at, len(row)))
            hit = np.repeat(many, often)
            found, partner = row[order[hit]], np.repeat(np.where(own == one, two, one), often)[hit]
            place = n_left[found] - a
            np.minimum.at(low, found, place)
            np.maximum.at(high, found, place)
            np.minimum.at(other, found, partner)
        # windows of one suffix are less than WINDOW apart, so they overlap
        good = high >= 0
        return pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array((first + low)[good].astype(np.int32)), pa.array((first + high + MIN_WORDS)[good].astype(np.int32)), pa.array(other[good])], names=["id", "first", "last", "other"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # whole heads at a time: the last one may go on in the next batch
        h = batch.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut or (held and last != h[0]):
            held += [batch.slice(0, cut)] if cut else []
            yield spans(held)
            held = []
        held.append(batch.slice(cut))
        last = h[-1]
    if held:
        yield spans(held)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes to the hashes of their windows: of the words before the head, the head, and the words behind it."""
    for batch in batches:
        (before, n_left), (behind, n_right) = around(batch.column("left"), True), around(batch.column("right"), False)
        n = n_left + n_right - (WINDOW - 2)
        size = n_left + 1 + n_right
        base = np.cumsum(size) - size
        line = np.zeros(int(size.sum()), np.int64)
        line[ranges(base, n_left)] = batch.column("left").flatten().to_numpy(zero_copy_only=False)
        line[base + n_left] = batch.column("h").to_numpy()
        line[ranges(base + n_left + 1, n_right)] = batch.column("right").flatten().to_numpy(zero_copy_only=False)
        start = ranges(base, n)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("first"), lists(signed(span_hashes(line.view(np.uint64), start, start + WINDOW)), np.concatenate([[0], np.cumsum(n)]))], names=["id", "first", "windows"])


def counted(rows: DataFrame) -> DataFrame:
    """The same for the windows of common heads, by grouped aggregates over single windows."""
    rows = rows.select("h", "id", "first", "left", "right").mapInArrow(hashed, "id bigint, first int, windows array<bigint>")
    each = rows.select("id", "first", F.posexplode("windows").alias("i", "w")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    # the two smallest documents of each salt, then of each window
    cells = each.groupBy("w", "salt").agg(F.min("id").alias("m"))
    more = each.join(cells, ["w", "salt"]).where("id > m").groupBy("w", "salt").agg(F.min("id").alias("m"))
    two = cells.union(more).groupBy("w").agg(F.sort_array(F.collect_list("m")).alias("m")).where(F.size("m") > 1).select("w", F.col("m")[0].alias("one"), F.col("m")[1].alias("two"))
    both = cells.select("w", "salt").join(two, "w")
    at = F.col("first") + F.col("i")
    return each.join(both, ["w", "salt"]).select("id", at.alias("first"), (at + MIN_WORDS).alias("last"), F.when(F.col("id") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("other"))


def repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_word, end_word, n_words, other_doc): the passages of a document that stand in another one too.

    Passages have MIN_WORDS words or more; words are runs of bytes that aren't
    white space, A-Z lower-cased, counted from 0, the end being after the last.
    Overlapping passages are one span; ``other_doc`` is the smallest other key
    that has MIN_WORDS words of it. Repeats within one document don't count.
    Rows that repeat a key are one document. Null and short texts, and rows
    without a key, give no rows.
    """
    rows = written(candidates(documents, key, text))
    sized = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = rows.where("not common").select("h", "id", "first", "left", "right").repartition(sized, "h").sortWithinPartitions("h").mapInArrow(compared, "id bigint, first int, last int, other bigint")
    common = rows.where("common")
    if not common.isEmpty():
        spans = spans.union(counted(common))
    by_start = Window.partitionBy("id").orderBy("first", "last")
    reach = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("id", "island").agg(F.min("first").alias("start_word"), F.max("last").alias("end_word"), F.min("other").alias("other_doc"))
    return joined.select(F.col("id").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc")
