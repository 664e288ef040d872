"""Near-duplicates by one-permutation MinHash.

A document is the set of its distinct word shingles. One permutation deals the
shingles into bins, whose minima are the signature; empty bins borrow from a
bin chosen by a hash of their own number (optimal densification). Bands of the
signature are bucket keys. Sets of up to SMALL shingles, of which a signature
says too little, have as keys those of their shingles of which two linking sets
share one at least, and a bitmap in place of the signature, which never rules
out a pair that links. In a bucket documents form stars: a centre, the one
most like the others, is paired with all that may link with it, then another
for those that are left. Pairs are confirmed on full sets. Who isn't in the
largest component of a bucket after that is paired with its likeliest partners
of other components. Where some had more than these, they are paired with all
that may link by a finer signature and, for sets of up to FULL shingles, by
the halves of their hashes, which leave hardly a pair that doesn't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, extended
from tessera.llm.kernels import LOWER, Tables, flat, lists, mix, run_starts, signed, slices, span_hashes, words
from tessera.session import written

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
WORDS = 5
PERCENT = 75
#: Sets of up to SMALL shingles have prefix keys; those over BOTH have bands (too), so a pair has both kinds or one in common.
SMALL = 124
BOTH = PERCENT * SMALL // 100
#: Bins that agree, at least, of a pair that may link: six standard deviations (4.9 measured at 94 shingles) under 75 %.
MAY = 66
#: Bins of the finer signature that is compared last, and how many agree at least: six standard deviations (11.2 measured) under 75 %.
FINE, MAY_FINE = 512, 316
#: Sets of up to so many shingles go whole into the last comparison, as halves of their hashes.
FULL = 1024
#: Bytes of a row's signature: one of each bin, then four of each key. A small set has a bitmap of as many bytes for the bins.
PACKED = BINS + 4 * BANDS
#: Partners that one outside the largest component is paired with first.
FIRST = 4
#: Members of a bucket that one task compares; larger buckets are salted, and their centres meet again.
MOST, ROUNDS = 8192, 3
#: Pairs of a batch that leaves a task, and what stands for a missing partner there.
STEP, NONE = 65_536, np.iinfo(np.int64).min
#: Added to the hash of a word by its place in a shingle.
PLACE = np.cumsum(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_tables = Tables()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text number), sorted by text and hash: each text's distinct k-word shingles.

    A text of fewer than k words, but one at least, has its whole sequence.
    """
    lowered = LOWER[data]
    starts, ends, doc = words(lowered, offsets)
    h = span_hashes(lowered, starts, ends)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    last = len(h) - k + 1
    out = np.zeros(max(last, 0), np.uint64)
    for j in range(k if last > 0 else 0):
        out += mix(h[j : j + last] + PLACE[j])
    whole = (doc[:last] == doc[k - 1 :]) if last > 0 else np.zeros(0, bool)
    values, owner = [mix(out[whole])], [doc[:last][whole] if last > 0 else doc[:0]]
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = h[first[i] : first[i] + count[i]]
        sums = sum(mix(own[j : j + 1] + PLACE[j]) for j in range(len(own)))
        values.append(mix(sums + np.uint64(len(own))))
        owner.append(np.array([i]))
    values, owner = np.concatenate(values), np.concatenate(owner)
    if (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    bounds = np.append(run_starts(owner), len(owner))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[s:e].sort()  # a text's own run: several times faster than an order of all
    at = run_starts(owner, values)
    return values[at], owner[at]


def donors(size: int) -> np.ndarray:
    """donors[t, i]: the bin of ``size`` that the empty bin i asks at its attempt t; at the end all bins in turn."""
    name = f"donors {size}"
    if name not in _tables:
        tries = 8 * size
        asked = mix(np.arange(tries * size, dtype=np.uint64) + np.uint64(77)).reshape(tries, size) % np.uint64(size)
        turn = (np.arange(size)[:, None] + np.arange(size)[None, :]) % size
        _tables[name] = np.concatenate([asked.astype(np.int64), turn])
    return _tables[name]


def signatures(values: np.ndarray, owner: np.ndarray, n: int, size: int = BINS) -> np.ndarray:
    """(n, size) minima of each text's bins, densified; rows of empty sets mean nothing. ``size`` is a power of two."""
    bins = (values >> np.uint64(65 - size.bit_length())).astype(np.int64)
    at = run_starts(owner, bins)  # sorted values: the first of a bin is its minimum
    signature, filled = np.zeros((n, size), np.uint64), np.zeros((n, size), bool)
    signature[owner[at], bins[at]], filled[owner[at], bins[at]] = values[at], True
    row, column = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for asked in donors(size):
        if not len(row):
            break
        donor = asked[column]
        has = filled[row, donor]
        signature[row[has], column[has]] = signature[row[has], donor[has]]
        row, column = row[~has], column[~has]
    return signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(rows.shape[:2], np.uint64)
    for j in range(ROWS):
        key += mix(rows[:, :, j] + np.uint64(j + 1))
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def prefixes(values: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among all values, text number, place in its text) of the prefix keys of the small sets.

    Of sets that link, each shares at least PERCENT of its own shingles; so both
    have one of the shared ones among the smallest that are left beside those.
    """
    size = np.where((n > 0) & (n <= SMALL), n + 1 + -PERCENT * n // 100, 0)
    place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(place < np.repeat(size, n))
    return at, owner[at], place[at]


def bitmaps(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) bytes: a bit for each value of a text, several may have the same."""
    bits = np.zeros((n, 8 * BINS), bool)
    bits[owner, (values >> np.uint64(10)).astype(np.int64) % (8 * BINS)] = True
    return np.packbits(bits, axis=1)


def rows_of_bytes(table: np.ndarray) -> pa.Array:
    """A binary column of the rows of a table of bytes."""
    rows, width = table.shape
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(table))])


def profiles(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, f, g, bands, sig, small): set size, two fingerprints of the set, bucket keys, and both packed for each kind of key; a row for each row of documents.

    Keys of bands are even and stand before those of prefixes, which are odd.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            values, owner = shingle_sets(*flat(batch.column("t")))
            rows = batch.num_rows
            n = np.bincount(owner, minlength=rows)
            bounds = np.concatenate([[0], np.cumsum(n)])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(99)), dtype=np.uint64)])
            f, g = sums[bounds[1:]] - sums[bounds[:-1]], other[bounds[1:]] - other[bounds[:-1]]
            signature = signatures(values, owner, rows)
            keys = band_keys(signature)
            low = np.concatenate([signature.astype(np.uint8), np.ascontiguousarray((keys >> np.uint64(32)).astype("<u4")).view(np.uint8)], axis=1)
            at, text_no, place = prefixes(values, owner, n)
            tokens = mix(values[at] + np.uint64(7))
            packed = np.zeros((rows, BANDS), "<u4")
            packed[text_no, place] = tokens >> np.uint64(32)
            small = np.concatenate([bitmaps(values, owner, rows), packed.view(np.uint8)], axis=1)
            banded = np.flatnonzero(n > BOTH)
            every = np.concatenate([(keys[banded] & ~np.uint64(1)).ravel(), tokens | np.uint64(1)])
            whose = np.concatenate([np.repeat(banded, BANDS), text_no])
            every = every[np.argsort(whose, kind="stable")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n.astype(np.int64)), pa.array(signed(f)), pa.array(signed(g)), lists(signed(every), np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=rows))])), rows_of_bytes(low), rows_of_bytes(small)],
                names=["id", "n", "f", "g", "bands", "sig", "small"],
            )

    return documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id bigint, n bigint, f bigint, g bigint, bands array<bigint>, sig binary, small binary")


def full_sets(documents: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(id, hashes, fine, halves): the full set of each wanted(id, f), from the document with that fingerprint, its finer signature, a byte of each bin, and of sets of up to FULL shingles the upper halves of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            values, owner = shingle_sets(*flat(batch.column("t")))
            n = np.bincount(owner, minlength=batch.num_rows)
            bounds = np.concatenate([[0], np.cumsum(n)])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
            same = signed(sums[bounds[1:]] - sums[bounds[:-1]]) == batch.column("f").to_numpy()
            fine = rows_of_bytes(signatures(values, owner, batch.num_rows, FINE).astype(np.uint8))
            size = np.where(n <= FULL, n, 0)
            upper = (values[np.repeat(n <= FULL, n)] >> np.uint64(32)).astype("<u4")
            halves = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(size)]).astype(np.int32)), pa.py_buffer(upper)])
            out = pa.RecordBatch.from_arrays([batch.column("id"), lists(signed(values), bounds), fine, halves], names=["id", "hashes", "fine", "halves"])
            yield out.filter(pa.array(same))

    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(wanted, "id")
    return rows.select("id", "f", "t").mapInArrow(run, "id bigint, hashes array<bigint>, fine binary, halves binary").dropDuplicates(["id"])


def tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``ok``: the full sets have a Jaccard similarity of PERCENT or more."""
    a = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (100 * both >= PERCENT * (F.size("ha") + F.size("hb") - both)).alias("ok"))


def stars(phase: int):
    """A mapInArrow function: rows sorted by bucket, salt and id to pairs (a, b) that may link.

    Phase 1 pairs each member with one centre; the centres of a salted bucket
    come back as (bucket, a). Phases 2 and 3 pair the members outside the
    largest component with members of other components, in the first bucket
    that they share: the FIRST likeliest, then all that may link by the finer
    signature and the halves too. Who has more than FIRST in phase 2 comes back
    as (bucket, a).
    Sets whose sizes rule a link out aren't paired.
    """

    def out(found):
        """A batch of the rows (bucket, a, b) found, of which b may be missing."""
        bucket, a, b = (np.concatenate([np.asarray(f[i], np.int64) for f in found]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(a), pa.array(b, mask=b == NONE)], names=["bucket", "a", "b"])

    def fits(n, m, same, small, own, other):
        """(whether a link between sets of n and m shingles isn't ruled out, likeness), from bins that agree or bits in common; of bitmaps ``own`` and ``other`` are the numbers of bits."""
        sized = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        if not small:
            return sized & (same >= MAY), same
        # what one has and the other lacks, at least; a link leaves room for so many
        lacks, extra = own - same, other - same
        shared = -(-PERCENT * (n + m) // (100 + PERCENT))
        return sized & (lacks <= n - shared) & (extra <= m - shared), -lacks - extra

    def couples(n, signature, small, x, y):
        """Of the couples of rows (x, y): whether a link isn't ruled out."""
        if not small:
            return fits(n[x], n[y], (signature[x] == signature[y]).sum(axis=1), small, None, None)[0]
        p, q = np.ascontiguousarray(signature[x]).view(np.uint64), np.ascontiguousarray(signature[y]).view(np.uint64)
        own, other, same = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (p, q, p & q))
        return fits(n[x], n[y], same, small, own, other)[0]

    def alike(bins, bytes_):
        """In how many rows of ``bins`` each column has the row's byte."""
        return (bins == bytes_[:, None]).view(np.uint8).sum(axis=0, dtype=np.uint8).astype(np.int64)  # BINS at most

    class Group:
        """The members of a bucket, with what is compared of them by columns: a row a bin, or a row 64 bits."""

        def __init__(self, n, signature, small):
            self.n, self.small = n, small
            self.columns = np.ascontiguousarray((np.ascontiguousarray(signature).view(np.uint64) if small else signature).T)
            self.bits = np.bitwise_count(self.columns).sum(axis=0, dtype=np.int64) if small else None

        def with_(self, i):
            """(whether a link with i isn't ruled out, likeness) of each member."""
            column = self.columns[:, i]
            if not self.small:
                return fits(self.n[i], self.n, alike(self.columns, column), False, None, None)
            same = np.bitwise_count(self.columns & column[:, None]).sum(axis=0, dtype=np.int64)
            return fits(self.n[i], self.n, same, True, self.bits[i], self.bits)

        def of(self, members):
            self.n, self.columns = self.n[members], np.ascontiguousarray(self.columns[:, members])
            self.bits = self.bits[members] if self.small else None

    def pair(x, y):
        return np.maximum(x, y), np.minimum(x, y)

    def first_stars(bucket, ids, n, signature, salted, small):
        """Stars of a bucket of three or more. Counts of the bins' bytes follow the members that are left, and likenesses to the most common ones change where these do."""
        group, bins = Group(n, signature, small), np.ascontiguousarray(signature.T)
        base = (np.arange(BINS) * 256)[:, None]
        counts = np.bincount((base + bins).ravel(), minlength=BINS * 256).astype(np.int32)
        modal = np.zeros(BINS, np.uint8)
        like = alike(bins, modal)
        free, left, centres = np.ones(len(ids), bool), len(ids), []
        while left:
            k = int(free.argmax())
            if left > 2:
                now = counts.reshape(BINS, 256).argmax(axis=1).astype(np.uint8)
                other = np.flatnonzero(now != modal)
                if len(other):
                    like += alike(bins[other], now[other]) - alike(bins[other], modal[other])
                modal = now
                k = int(np.where(free, like, -1).argmax())
            centres.append(ids[k])
            near, _ = group.with_(k)
            near &= free
            near[k] = False
            if near.any():
                a, b = pair(ids[near], ids[k])
                yield np.full(len(a), bucket), a, b
            near[k] = True
            gone = np.flatnonzero(near)
            np.subtract.at(counts, (base + bins[:, gone]).ravel(), 1)
            free[gone] = False
            left -= len(gone)
            if 2 * left < len(free) and left > 2:
                some = np.flatnonzero(free)
                group.of(some)
                ids, like, bins, free = ids[some], like[some], np.ascontiguousarray(bins[:, some]), np.ones(left, bool)
        if salted:
            yield np.full(len(centres), bucket), centres, np.full(len(centres), NONE)

    def first_couples(bucket, ids, n, signature, salted, small, x):
        """The stars of buckets of two, at the rows x and x + 1."""
        near = couples(n, signature, small, x, x + 1)
        a, b = pair(ids[x[near]], ids[x[near] + 1])
        yield bucket[x[near]], a, b
        centres = np.concatenate([x[salted[x]], x[salted[x] & ~near] + 1])
        yield bucket[centres], ids[centres], np.full(len(centres), NONE)

    def met_before(keys, place, i, others, small):
        """Of the others: whether a bucket of an earlier key is shared too."""
        if not small:
            return (keys[others] == keys[i]).argmax(axis=1) != place[i]
        return np.isin(keys[others], keys[i, : place[i]]).any(axis=1)

    def share_enough(halves, n, i, others):
        """Of the others: whether enough of their halves are halves of i's; who has none, or if i has none, isn't ruled out."""
        values, bounds = halves
        own = values[bounds[i] : bounds[i + 1]]
        size = bounds[others + 1] - bounds[others]
        if not len(own) or not size.any():
            return np.ones(len(others), bool)
        whose = np.repeat(np.arange(len(others)), size)
        theirs = values[np.arange(len(whose)) + np.repeat(bounds[others] - np.cumsum(size) + size, size)]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.bincount(whose[hit], minlength=len(others))
        return (size == 0) | (100 * both >= PERCENT * (n[others] + n[i] - both))

    def outsiders(bucket, ids, n, signature, comp, outer, visitor, salted, keys, place, fine, halves, small):
        outside = outer
        if not salted:
            names, count = np.unique(comp, return_counts=True)
            outside = comp != names[count.argmax()]
        group = Group(n, signature, small) if outside.any() else None
        for i in np.flatnonzero(outside):
            near, same = group.with_(i)
            keep = np.flatnonzero(near & (comp != comp[i]) & ~visitor)
            keep = keep[~met_before(keys, place, i, keep, small)]
            if phase == 2 and len(keep) > FIRST:
                keep = keep[np.argsort(-same[keep], kind="stable")[:FIRST]]
                yield [bucket], ids[i : i + 1], [NONE]
            elif phase == 3:
                if not small:
                    keep = keep[(fine[keep] == fine[i]).sum(axis=1) >= MAY_FINE]
                keep = keep[share_enough(halves, n, i, keep)]
            if len(keep):
                a, b = pair(ids[keep], ids[i])
                yield np.full(len(a), bucket), a, b

    def outside_couples(bucket, ids, n, signature, comp, keys, place, small, x):
        """What phase 2 pairs in buckets of two that aren't salted, at the rows x and x + 1: the member of the larger component with the other."""
        x = x[comp[x] != comp[x + 1]]
        i = np.where(comp[x] > comp[x + 1], x, x + 1)
        near = couples(n, signature, small, i, 2 * x + 1 - i)
        i, o = i[near], (2 * x + 1 - i)[near]
        if not small:
            met = (keys[o] == keys[i]).argmax(axis=1) != place[i]
        else:
            earlier = np.arange(BANDS) < place[i][:, None]
            met = ((keys[i][:, :, None] == keys[o][:, None, :]).any(axis=2) & earlier).any(axis=1)
        a, b = pair(ids[i[~met]], ids[o[~met]])
        yield bucket[i[~met]], a, b

    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        bucket, salt = t.column("bucket").to_numpy(), t.column("salt").to_numpy()
        ids, n, comp, outer, visitor, salted = (t.column(c).to_numpy() for c in ("id", "n", "comp", "outer", "visitor", "salted"))
        packed = flat(t.column("sig"))[0].reshape(len(bucket), -1)
        signature, keys, fine = packed[:, :BINS], np.ascontiguousarray(packed[:, BINS:PACKED]).view("<u4"), packed[:, PACKED:]
        values, bounds = flat(t.column("halves")) if phase == 3 else (np.zeros(0, np.uint8), np.zeros(len(bucket) + 1, np.int64))
        values, bounds = np.ascontiguousarray(values).view("<u4"), bounds // 4
        place = t.column("band_no").to_numpy() - np.where((bucket & 1 == 1) & (n > BOTH), BANDS, 0)
        at = np.append(run_starts(bucket, salt), len(bucket))
        # most buckets are couples: these are compared all at once
        size, two = np.diff(at), np.zeros(len(at) - 1, bool)
        if phase < 3:
            two = (size == 2) & ((phase == 1) | ~salted[at[:-1]])
        for small in (0, 1):
            x = at[:-1][two & (bucket[at[:-1]] & 1 == small)]
            if len(x) and phase == 1:
                yield from first_couples(bucket, ids, n, signature, salted, small, x)
            elif len(x):
                yield from outside_couples(bucket, ids, n, signature, comp, keys, place, small, x)
        for s, e in zip(at[:-1][~two], at[1:][~two]):
            if phase == 1 and e - s == 1 and salted[s]:
                yield bucket[s:e], ids[s:e], [NONE]
            elif phase == 1 and e - s > 1:
                yield from first_stars(bucket[s], ids[s:e], n[s:e], signature[s:e], salted[s], bucket[s] & 1)
            elif e - s > 1:
                yield from outsiders(bucket[s], ids[s:e], n[s:e], signature[s:e], comp[s:e], outer[s:e], visitor[s:e], salted[s], keys[s:e], place[s:e], fine[s:e], (values, bounds[s : e + 1]), bucket[s] & 1)

    def packed_up(rows):
        """The rows found, some tens of thousands a batch."""
        found, size = [], 0
        for part in rows:
            found.append(part)
            size += len(part[1])
            if size >= STEP:
                yield out(found)
                found, size = [], 0
        if size:
            yield out(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            # whole groups at a time: the last one may go on in the next batch
            bucket, salt = batch.column("bucket").to_numpy(), batch.column("salt").to_numpy()
            if not len(bucket):
                continue
            at = run_starts(bucket, salt)
            if held and (bucket[0], salt[0]) == last:
                cut = int(at[1]) if len(at) > 1 else len(bucket)
                held.append(batch.slice(0, cut))
                batch, at = batch.slice(cut), at[1:] - cut
            if batch.num_rows:
                if held:
                    yield from packed_up(flush(held))
                last = (bucket[-1], salt[-1])
                if len(at) > 1:
                    yield from packed_up(flush([batch.slice(0, int(at[-1]))]))
                held = [batch.slice(int(at[-1]))]
        if held:
            yield from packed_up(flush(held))

    return run


def star_pairs(members: DataFrame, bands: DataFrame, packed: DataFrame, phase: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) over all buckets of members(bucket, band_no, id, n, comp), once each; the buckets where phase 2 left some out.

    ``packed`` has what is compared of each id: sig and small, in phase 3 fine
    and halves too. It meets the members when these have been dealt out.

    A bucket of over MOST members is dealt out by a salt. In phase 1 the
    centres of its parts meet in a next round, with one band more in the key,
    so that what only happens to share a band comes apart; in buckets that are
    large after ROUNDS rounds every two parts meet. In the later phases those
    outside the largest component visit every part.
    """
    pairs, turn = None, 0
    rows = members
    while True:
        turn += 1
        last = phase == 1 and turn > ROUNDS
        if phase == 1:
            large = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.lit(None).cast("bigint").alias("main")).where(F.col("m") > MOST)
        else:
            counted = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
            large = counted.groupBy("bucket").agg(F.sum("c").alias("m"), F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main")).where(F.col("m") > MOST)
        # there is one large bucket for every MOST members at most
        split = rows.join(F.broadcast(large), "bucket", "left").withColumn("salted", F.col("m").isNotNull() & F.lit(not last))
        parts = F.coalesce(F.ceil(F.col("m") / (MOST // 2 if last else MOST)), F.lit(1))
        dealt = split.withColumn("own", F.pmod(F.xxhash64("id"), parts)).withColumn("outer", F.col("salted") & F.lit(phase > 1) & F.coalesce(F.col("comp") != F.col("main"), F.lit(False)))
        every = F.sequence(F.lit(0).cast("bigint"), parts - 1)
        if last:
            salts = F.transform(every, lambda q: F.least(F.col("own"), q) * parts + F.greatest(F.col("own"), q))
        else:
            salts = F.when(F.col("outer"), every).otherwise(F.array("own"))
        dealt = dealt.withColumn("salt", F.explode(salts))
        sig = F.when(F.col("bucket").bitwiseAND(F.lit(1).cast("bigint")) == 1, F.col("small")).otherwise(F.col("sig"))
        compared = [F.concat(sig, "fine").alias("sig"), "halves"] if phase == 3 else [sig.alias("sig")]
        dealt = dealt.withColumn("visitor", F.col("outer") & (F.col("salt") != F.col("own"))).join(packed, "id")
        dealt = dealt.select("bucket", "salt", "band_no", "id", "n", "comp", "salted", "outer", "visitor", *compared)
        dealt = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "id")
        found = written(dealt.mapInArrow(stars(phase), "bucket bigint, a bigint, b bigint").distinct())
        new = found.where("b is not null").select("a", "b")
        pairs = new if pairs is None else pairs.union(new)
        centres = found.where("b is null").select("bucket", F.col("a").alias("id"))
        if phase > 1 or centres.isEmpty():
            return pairs.distinct(), centres.select("bucket").distinct()
        again = centres.join(rows, ["bucket", "id"]).join(bands, "id").select("bucket", "id", "n", "comp", "band_no", F.posexplode("bands").alias("i", "band"))
        kind = F.col("bucket").bitwiseAND(F.lit(1).cast("bigint"))
        rows = again.where("i > band_no").select(F.xxhash64("bucket", "band").bitwiseAND(F.lit(-2).cast("bigint")).bitwiseOR(kind).alias("bucket"), "id", "n", "comp", F.col("i").alias("band_no"))


def star_roots(members: DataFrame, bands: DataFrame, packed: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, component) by confirmed links: every two members of a bucket that may link end in one component, or were compared in full."""
    known, roots, rows = None, None, members.withColumn("comp", F.col("id"))
    for phase in (1, 2, 3):
        pairs, more = star_pairs(rows, bands, packed, phase)
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        new = written(tested(pairs, sets))
        known = new if known is None else known.union(new)
        links = new.where("ok").select("a", "b")
        if roots is None:
            roots = components(links)
        elif not links.isEmpty():
            roots = extended(roots, links)
        if phase < 3:
            rows = members.join(roots, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        if phase == 2:
            rows, packed = rows.join(more, "bucket", "left_semi"), packed.join(sets.select("id", "fine", "halves"), "id")
    return roots


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept), a row for each key.

    Words are runs of bytes that aren't white space, with A-Z lower-cased.
    Documents link if 100 x |A and B| >= PERCENT x |A or B| over their sets of
    distinct shingles. A null or wordless text has the empty set and links with
    nothing. ``component_id`` is the smallest key reachable. Rows that repeat
    a key are one document (if their texts differ, that of the smallest
    fingerprint); a null key gives one row that links with nothing and is kept.
    """
    rows = written(profiles(documents, key, text).groupBy("id").agg(F.min(F.struct("f", "g", "n", "bands", "sig", "small")).alias("p")).select("id", "p.*"))
    # equal sets are one class, represented by its smallest document
    classes = rows.where("n > 0 and id is not null").groupBy("f", "g", "n").agg(F.min("id").alias("rep"))
    member = rows.select("id", "f", "g", "n").join(classes, ["f", "g", "n"], "left")
    reps = rows.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").where("n > 0")
    entries = reps.select("id", "n", F.posexplode("bands").alias("band_no", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    members = written(entries.join(shared, "bucket").select("id", "bucket", "n", "band_no"))
    compared = written(rows.select("id", "f", "sig", "small").join(members.select("id").distinct(), "id", "left_semi"))
    sets = written(full_sets(documents, key, text, compared.select("id", "f")))
    roots = star_roots(members, reps.select("id", "bands"), compared.drop("f"), sets)
    out = member.join(roots.select(F.col("id").alias("rep"), "component"), "rep", "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have a smaller near-duplicate, with their own columns."""
    gone = near_duplicates(documents, key, text).where("not kept").select(key)
    return documents.join(gone, key, "left_anti").select(*documents.columns)
