"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rolled) by its place; a text's
vector bundles (adds) those of its n-grams; a language's prototype bundles its
texts' vectors. A text goes to the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import Tables, mix, run_starts, slices

DIMENSIONS = 512
SEED = 20250
_tables = Tables()


def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and its lower case."""
    if "letter" not in _tables:
        n = 0x110000
        is_letter, lower = np.zeros(n, bool), np.arange(n, dtype=np.int32)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalpha():
                is_letter[c] = True
                low = ch.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        is_letter[0x30000:0x32000] = [chr(c).isalpha() for c in range(0x30000, 0x32000)]
        _tables["letter"], _tables["lower"] = is_letter, lower
    return _tables["letter"], _tables["lower"]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """(codes, DIMENSIONS) of +1 and -1, the same for a code everywhere."""
    cells = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = mix(mix(codes.astype(np.uint64) + np.uint64(SEED))[:, None] + cells * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8).reshape(len(codes), -1), axis=1).astype(np.int8) * 2 - 1)[:, :DIMENSIONS]


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, DIMENSIONS) bundles of trigram vectors, and whether a text has a letter.

    A word is a run of letters, with a blank on each side; a trigram stays in its word.
    """
    is_letter, lower = letters()
    joined = np.frombuffer(("\n" + "\n".join("" if t is None else t.replace("\n", " ") for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(joined == 10) - 1
    low = lower[joined]
    inside = is_letter[joined]
    low[~inside] = 0
    keep = inside.copy()  # letters, and one blank after each run, serve as the middle of a trigram
    keep[1:] |= inside[:-1]
    keep[:-1] |= inside[1:]
    code, owner, letter = low[keep].astype(np.int64), doc[keep], inside[keep]
    n = len(texts)
    owner = np.minimum(owner, n - 1)
    has = np.zeros(n, bool)
    has[owner[letter]] = True
    out = np.zeros((n, DIMENSIONS), np.float32)
    middle = np.flatnonzero(letter)
    if not len(middle):
        return out, has
    used, index = np.unique(code, return_inverse=True)
    a, b, c = index[middle - 1], index[middle], index[middle + 1]
    k = len(used)
    grams, of = np.unique((a * k + b) * k + c, return_inverse=True)
    vectors = letter_vectors(used)
    vectors[used == 0] = 1
    bound = np.roll(vectors, 2, axis=1)[grams // (k * k)] * np.roll(vectors, 1, axis=1)[grams // k % k] * vectors[grams % k]
    # counts of the trigrams of each text, then one product: the bundle
    texts_of = owner[middle]
    step = max(1, 4_000_000 // max(1, len(grams)))
    bound = bound.astype(np.float32)
    for at in range(0, n, step):
        lo, hi = np.searchsorted(texts_of, [at, at + step])
        rows = min(step, n - at)
        counts = np.bincount((texts_of[lo:hi] - at) * len(grams) + of[lo:hi], minlength=rows * len(grams)).reshape(rows, len(grams))
        used_grams = np.flatnonzero(counts.any(axis=0))
        out[at : at + rows] = counts[:, used_grams].astype(np.float32) @ bound[used_grams]
    return out, has


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def held_out(key: str):
    """Rows that no prototype is learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def prototypes(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Each language's bundle of unit text vectors, over all rows that aren't held out and have a language."""
    rows = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "t"):
            vectors, has = text_vectors(batch.column("t").to_pylist())
            vectors = unit(vectors)
            names, of = np.unique(np.array(batch.column("l").to_pylist(), dtype=object), return_inverse=True)
            for i, name in enumerate(names):
                if (own := has & (of == i)).any():
                    sums[name] = sums.get(name, 0) + vectors[own].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_pydict({"l": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    added = rows.mapInArrow(partial, "l string, v array<double>").select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("x"))
    table: dict[str, np.ndarray] = {}
    for r in added.collect():  # languages x DIMENSIONS numbers
        table.setdefault(r["l"], np.zeros(DIMENSIONS))[r["i"]] = r["x"]
    names = sorted(table)
    return names, unit(np.array([table[k] for k in names])) if names else np.zeros((0, DIMENSIONS))


def identify(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of each row of documents.

    The score is the best cosine, from 0 to 1. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if no language could
    be learnt. Ties go to the first language by name. Null keys and repeated
    rows stay.
    """
    names, profiles = prototypes(documents, key, text, lang)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            vectors, has = text_vectors(batch.column("t").to_pylist())
            known = has & bool(names)
            cosine = unit(vectors) @ profiles.T if names else np.zeros((len(has), 1))
            best = cosine.argmax(axis=1)
            found = [names[b] if k else "und" for b, k in zip(best, known)]
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.string()), pa.array(score)], names=["k", "l", "s"])

    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, l string, s double")
    return out.select(F.col("k").alias(key), held_out("k").alias("held_out"), F.col("l").alias("lang_pred"), F.col("s").alias("score"))
