"""Benchmark decontamination under edit distance.

Windows of as many words as a benchmark item start at every word of a text.
The CGK random walk embeds a sequence of words so that the edit distance of
two sequences bounds the Hamming distance of their embeddings from above with
good probability. Repetitions, each with a walk of its own and a sample of
embedded places as its key, find the items that a window may match. Candidates
are confirmed by the exact edit distance.

A window only enters the search if enough of its words occur in the items at
all, and if it holds enough of the words of one item that stand in few items:
each other word costs an edit, and so does each such word that is missing, so
nothing within the distance is lost. Items too short for an edit are looked up
word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import LOWER, flat, mix, ranges, slices, span_hashes, words

#: Edits in words that a match may have, as a share of the item's words.
EDITS = 0.2
#: Repetitions of walk and sample; places in a sample.
REPETITIONS, SAMPLE = 24, 3
#: Items whose words are sent to the tasks at once: the bound of what is broadcast. More items take more passes.
ITEM_BLOCK = 20_000
#: Items of fewer words leave no room for an edit.
WALKED = 5
SEED = 4711
#: Bytes of text whose windows are embedded together.
STEP_BYTES = 2 << 20
#: A word is a mark of its items if it stands in so many of them at most.
FEW = 2


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end)."""
    data, offsets = flat(texts)
    lowered = LOWER[data]
    starts, ends, doc = words(lowered, offsets)
    return span_hashes(lowered, starts, ends), np.searchsorted(doc, np.arange(len(texts) + 1))


def walk_keys(h: np.ndarray, at: np.ndarray, size: np.ndarray, repetition: int) -> np.ndarray:
    """The sampled key of the CGK embedding of each window h[at:at + size].

    At step j the walk writes the word it stands on, then moves on by one or
    not at all, as a random function of step and word says; past the end it
    writes a blank. Of the first 2 x size steps SAMPLE are kept, the same for
    all windows of a size.
    """
    key = mix(np.uint64(repetition * 1_000_003) + size.astype(np.uint64))
    sizes, of = np.unique(size, return_inverse=True)
    steps = np.array([np.sort(np.random.default_rng([SEED, repetition, n]).choice(2 * n, SAMPLE, replace=False)) for n in sizes]).reshape(-1, SAMPLE)
    rank = np.argsort(np.argsort(steps[:, -1], kind="stable"))  # sizes that are done first stand first
    order = np.argsort(rank[of], kind="stable")
    bounds = np.searchsorted(rank[of][order], np.arange(len(sizes) + 1))
    samples: dict[int, list[int]] = {}
    for i, row in enumerate(steps):
        for j in row:
            samples.setdefault(int(j), []).append(int(rank[i]))
    here, n, start = np.zeros(len(at), np.int64), size[order], at[order]
    last, out = steps[of, -1][order], key[order]
    for j in range(int(last[-1]) + 1 if len(at) else 0):
        a = int(np.searchsorted(last, j))
        place = here[a:]
        word = h[np.minimum(start[a:] + place, len(h) - 1)]
        word[place >= n[a:]] = 0
        for i in samples.get(j, ()):
            out[bounds[i] : bounds[i + 1]] = mix(out[bounds[i] : bounds[i + 1]] + word[bounds[i] - a : bounds[i + 1] - a])
        # one bit of the word and the step decides on the move
        place += ((word ^ np.uint64(mix(np.array([j * 7919 + repetition * 104_729], np.uint64))[0])) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.int64)
    key[order] = out
    return key


def best_end(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(edits, words) of the prefix of ``text`` nearest to the item, the shortest of equals; most + 1 edits if there are more."""
    row = np.arange(len(text) + 1)
    for i, x in enumerate(item):
        cost = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        new = np.concatenate([[i + 1], cost])
        # insertions run along the row: a running minimum of the value less its place
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def spans(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out += mix(h[at + j] + np.uint64(j * 2_654_435_761 + n))
    return mix(out)


class Items:
    """The items of a block: their words, and the keys of their embeddings by number of words."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, first = word_hashes(pa.array(texts, pa.string()))
        size = np.diff(first)
        #: By number of words, up to WALKED: the sorted hashes of the short items, and their ids.
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, WALKED):
            own = np.flatnonzero(size == n)
            if len(own):
                whole = spans(h, first[own], n)
                order = np.argsort(whole, kind="stable")
                self.exact[n] = whole[order], np.array([ids[i] for i in own[order]], np.int64)
        use = np.flatnonzero(size >= WALKED)
        self.ids, self.words = [ids[i] for i in use], [h[first[i] : first[i + 1]] for i in use]
        self.vocabulary = np.unique(np.concatenate(self.words)) if len(use) else np.zeros(0, np.uint64)
        items_of = np.unique(np.concatenate([np.unique(w) for w in self.words]), return_counts=True) if len(use) else (self.vocabulary, self.vocabulary)
        self.is_mark = items_of[1] <= FEW
        #: A table of one bit each for the top bits of the vocabulary's hashes.
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            self.by_size.setdefault(len(w), []).append(i)
        size = np.array([len(w) for w in self.words], np.int64)
        self.size, self.most = size, (EDITS * size).astype(np.int64)
        place = [np.searchsorted(self.vocabulary, w) for w in self.words]
        #: By item: the fewest marks that a match of it has; the others' windows are found by their words alone.
        self.least_marks = np.array([int(self.is_mark[p].sum()) for p in place], np.int64) - self.most
        self.unmarked = {n: [i for i in own if self.least_marks[i] < 2] for n, own in self.by_size.items()}
        pairs = np.unique(np.array([(v, i) for i, p in enumerate(place) if self.least_marks[i] >= 2 for v in p[self.is_mark[p]]], np.int64).reshape(-1, 2), axis=0)
        #: The items of each mark, one after the other, and where each word's begin.
        self.items_of, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1))
        #: For each repetition the sorted keys of all items, and the items.
        self.keys = []
        if len(use):
            joined = np.concatenate(self.words)
            for r in range(REPETITIONS):
                keys = walk_keys(joined, np.cumsum(size) - size, size, r)
                order = np.argsort(keys, kind="stable")
                self.keys.append((keys[order], order))

    def short_matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, start, words, 0) of the first place of each short item in each text."""
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, (known, ids) in self.exact.items():
            at = np.flatnonzero(text_of[: len(h) - n + 1] == text_of[n - 1 :]) if len(h) >= n else np.zeros(0, np.int64)
            got = spans(h, at, n)
            a, b = np.searchsorted(known, got, "left"), np.searchsorted(known, got, "right")
            hit = np.flatnonzero(b > a)
            # the first of each text and item: places are in order
            _, one = np.unique(np.stack([text_of[at[hit]], a[hit]]), axis=1, return_index=True)
            for k in hit[one].tolist():
                for i in ids[a[k] : b[k]].tolist():
                    yield int(text_of[at[k]]), i, int(at[k] - first[text_of[at[k]]]), n, 0

    def matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, start, words, edits) of each window start that matches."""
        yield from self.short_matches(h, first)
        if not len(self.vocabulary) or not len(h):
            return
        known = self.bits[(h >> np.uint64(44)).astype(np.int64)]
        near = np.flatnonzero(known)
        at = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
        known[near] = self.vocabulary[at] == h[near]
        sums = np.concatenate([[0], np.cumsum(known)])
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        last = first[1:][text_of]
        full, sizes, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()

        def enter(start: np.ndarray, n: np.ndarray, own) -> None:
            # words of the window, or of what is left of the text where fewer are left but enough
            end = np.minimum(start + n, last[start])
            enough = known[start] & (sums[end] - sums[start] >= n - (EDITS * n).astype(np.int64))
            start, n, whole = start[enough], n[enough], (end - start)[enough] == n[enough]
            full.append(start[whole])
            sizes.append(n[whole])
            # a walk must not run into the next text: the few short windows meet the items of their size
            for s, m in zip(start[~whole].tolist(), n[~whole].tolist()):
                seen.update((s, i) for i in own(m))

        # items with marks: as many of one item's marks as a match has at least, within the words of a match
        found = near[known[near]]
        v = at[known[near]]
        count = self.items_at[v + 1] - self.items_at[v]
        item, place = self.items_of[ranges(self.items_at[v], count)], np.repeat(found, count)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        k = np.arange(len(item))
        ahead = k + self.least_marks[item] - 1
        k, ahead = k[ahead < len(item)], ahead[ahead < len(item)]
        reach = (self.size + self.most)[item[k]]
        good = (item[ahead] == item[k]) & (place[ahead] - place[k] < reach) & (text_of[place[ahead]] == text_of[place[k]])
        k, ahead, reach = k[good], ahead[good], reach[good]
        low = np.maximum(place[ahead] - reach + 1, first[text_of[place[k]]])
        run = place[k] - low + 1
        windows = np.unique(np.stack([ranges(low, run), np.repeat(self.size[item[k]], run)]), axis=1)
        enter(windows[0], windows[1], lambda m: self.by_size[m])
        starts = np.flatnonzero(known)
        for n, own in self.unmarked.items():
            if own:
                enter(starts, np.full(len(starts), n), lambda m: self.unmarked[m])
        full, sizes = np.concatenate(full), np.concatenate(sizes)
        for r in range(REPETITIONS if len(full) else 0):
            keys, own = self.keys[r]
            got = walk_keys(h, full, sizes, r)
            a, b = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            for k in np.flatnonzero(b > a):
                seen.update((int(full[k]), int(i)) for i in own[a[k] : b[k]])
        for s, i in sorted(seen):
            n = len(self.words[i])
            most = int(EDITS * n)
            text = h[s : min(int(last[s]), s + n + most)]
            if np.isin(text, self.words[i]).sum() < n - most:
                continue
            edits, size = best_end(self.words[i], text, most)
            if edits <= most:
                yield int(text_of[s]), self.ids[i], int(s - first[text_of[s]]), size, edits


def item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The benchmark in blocks of at most ITEM_BLOCK items, each collected by itself."""
    rows = benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("i"), F.col(text).alias("t")).distinct()
    blocks = -(-rows.count() // ITEM_BLOCK)
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        yield Items([r["i"] for r in own], [r["t"] for r in own])


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, start_word, n_words, edits): each document and item that match, at the match of fewest edits.

    A match is a stretch of the document within EDITS x words of the item, in
    words inserted, deleted or changed; words are runs of bytes that aren't
    white space, A-Z lower-cased. It starts at a word of the item's
    vocabulary. Items of under WALKED words match where they stand unchanged.
    Null texts and items, items without a word and rows without a key match
    nothing; repeated rows count once. Other columns, whatever their names,
    aren't read; an empty table gives no rows.
    """
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    schema = "id bigint, item bigint, start int, size int, edits int"
    found = None
    for items in item_blocks(benchmark, item, item_text):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in slices(batches, "t", STEP_BYTES):
                got = list(block.matches(*word_hashes(batch.column("t"))))
                if got:
                    doc, i, start, size, edits = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(doc)), pa.array(i, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(edits, pa.int32())], names=["id", "item", "start", "size", "edits"]
                    )

        new = rows.mapInArrow(run, schema)
        found = new if found is None else found.union(new)
    if found is None:
        found = rows.limit(0).select("id", F.lit(0).cast("bigint").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).alias("edits"))
    best = found.groupBy("id", "item").agg(F.min(F.struct("edits", "start", "size")).alias("m"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item), F.col("m.start").alias("start_word"), F.col("m.size").alias("n_words"), F.col("m.edits").alias("edits"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that match no item, with their own columns."""
    return documents.join(contaminated(documents, benchmark, key, text).select(key).distinct(), key, "left_anti").select(*documents.columns)
