"""Chunking and context selection: per document an ordered pass, spread over documents by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.llm.kernels import LOWER, Tables, ranges, run_starts, slices

#: Marks that end a sentence, what may close behind them, and how far a likeness must fall for a break.
ENDS, CLOSERS = ".!?。！？", "\"'’”）)]"
MIN_DROP, MAD_SCALE, FLOOR = 0.08, 2.5, 0.55
#: Kinds of characters: white space, what words are made of, marks that join words, all others.
BLANK, LETTER, JOIN, OTHER = range(4)
#: Places of a hashed sentence vector, and the bytes up to which words are hashed together.
PLACES, SHORT = 1 << 12, 64
_tables = Tables()


def _kinds() -> np.ndarray:
    if "kinds" not in _tables:
        kinds = np.full(0x110000, OTHER, np.uint8)
        kinds[[c for c in range(0x3001) if chr(c).isspace()]] = BLANK  # none lies beyond
        kinds[[c for c in range(128) if chr(c).isalnum()]] = LETTER
        kinds[[ord(c) for c in "-_./"]] = JOIN
        _tables["kinds"] = kinds
    return _tables["kinds"]


def _crc_step() -> np.ndarray:
    if "crc" not in _tables:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        _tables["crc"] = step
    return _tables["crc"]


def crc32_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes: of short ones byte by byte, all at once."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(sizes, SHORT + 1).astype(np.int16), kind="stable")
    long = int((sizes > SHORT).sum())
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes())
    order = order[long:]
    at, size, step = starts[order], sizes[order], _crc_step()
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # so many have a byte more
        crc[:n] = step[(crc[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    return out


def medians(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each run values[bounds[i]:bounds[i + 1]]; none is empty."""
    n = np.diff(bounds)
    ordered = values[np.lexsort((values, np.repeat(np.arange(len(n)), n)))]
    return (ordered[bounds[:-1] + (n - 1) // 2] + ordered[bounds[:-1] + n // 2]) / 2


class Units:
    """The tokens of texts, and their sentences as (first, last) token, those of over ``most`` tokens cut after every ``most``.

    All texts of a list are worked on at once, one text alone as a list of it.
    ``starts`` and ``ends`` of tokens count from the beginning of their text.
    """

    def __init__(self, texts: str | list[str], most: int):
        texts = [texts] if isinstance(texts, str) else texts
        # each text stands between blanks, at which no token and no mark of a sentence's end goes on
        self.joined = f" {' '.join(texts)} "
        self.letters = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = 1 + np.cumsum(sizes) - sizes
        kind = _kinds()[self.letters]
        word = kind == LETTER
        inner = np.flatnonzero(kind == JOIN)
        word[inner[word[inner - 1] & word[inner + 1]]] = True
        other = (kind != BLANK) & ~word
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        self.at, self.to = np.flatnonzero(first | other), np.flatnonzero(last | other) + 1
        self.in_text = np.searchsorted(self.begin, self.at, "right") - 1
        self.starts, self.ends = self.at - self.begin[self.in_text], self.to - self.begin[self.in_text]
        begins, ends = self._edges(kind)
        first, last = np.searchsorted(self.at, begins[:-1]), np.searchsorted(self.at, ends[1:])
        first, last = first[first < last], last[first < last]
        parts = -(-(last - first) // most)
        self.first = ranges(np.zeros(len(parts), np.int64), parts) * most + np.repeat(first, parts)
        self.last = np.minimum(self.first + most, np.repeat(last, parts))
        self.size = self.last - self.first

    def _edges(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where a sentence may begin, where the one before ends): at ends of texts, blanks behind a mark that ends a sentence, and empty lines; what closes behind a mark is in neither."""
        blank, between = kind == BLANK, np.append(self.begin - 1, len(kind) - 1)
        run = np.setdiff1d(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, between, assume_unique=True)
        closing = np.isin(self.letters, [ord(c) for c in CLOSERS])
        mark = np.maximum.accumulate(np.where(closing, 0, np.arange(len(kind))))[run - 1]
        ended = np.isin(self.letters[mark], [ord(c) for c in ENDS])
        line = self.letters == 10
        plain = np.concatenate([between, np.flatnonzero(line[1:] & line[:-1])])
        return np.sort(np.concatenate([run[ended], plain])), np.sort(np.concatenate([mark[ended] + 1, plain]))

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token's lower-cased hash, whether it counts as a word)"""
        letter, single = self.letters[self.at], self.to - self.at == 1
        place, counts = np.zeros(len(self.at), np.int64), np.ones(len(self.at), bool)
        wide = single & (letter > 127)
        found = letter[wide]
        if (sigma := np.flatnonzero(found == 0x3A3)).size:
            low = self.joined.replace("\u0130", "i").lower()  # as long as the text; a sigma's form depends on what stands around it
            found[sigma] = [ord(low[i]) for i in self.at[wide][sigma].tolist()]
        each, which = np.unique(found, return_inverse=True)
        lower = [chr(c).lower() for c in each.tolist()]
        place[wide] = np.array([zlib.crc32(c.encode("utf-8", "surrogatepass")) for c in lower], np.int64)[which]
        counts[wide] = np.array([c[0].isalnum() for c in lower], bool)[which]
        counts[~wide] = _kinds()[letter[~wide]] == LETTER
        plain = np.flatnonzero(~wide & counts)
        place[plain] = crc32_of(LOWER[np.minimum(self.letters, 255).astype(np.uint8)], self.at[plain], (self.to - self.at)[plain])
        return place % PLACES, counts

    def likeness(self) -> np.ndarray:
        """The cosine of each unit's hashed word counts with the next one's."""
        place, counts = self._places()
        own, at = np.repeat(np.arange(len(self.size)), self.size), ranges(self.first, self.size)
        word = counts[at]
        key, count = np.unique(own[word] * PLACES + place[at][word], return_counts=True)
        norm = np.sqrt(np.bincount(key // PLACES, count.astype(float) ** 2, len(self.size)))
        near = np.searchsorted(key, key + PLACES)
        hit = (near < len(key)) & (key[np.minimum(near, len(key) - 1)] == key + PLACES) if len(key) else np.zeros(0, bool)
        dots = np.bincount(key[hit] // PLACES, count[hit] * count[near[hit]], max(1, len(self.size)))[: max(0, len(self.size) - 1)]
        size = norm[:-1] * norm[1:]
        return np.where(size > 0, dots / np.where(size > 0, size, 1), 0.0)

    def breaks(self) -> np.ndarray:
        """Of each unit, whether the subject changes before it: a likeness under the floor, or far under the text's median."""
        out = np.zeros(len(self.size), bool)
        text = self.in_text[self.first]
        inside = np.flatnonzero(text[1:] == text[:-1])
        if len(inside):
            likeness, bounds = self.likeness()[inside], np.append(run_starts(text[inside]), len(inside))
            n = np.diff(bounds)
            middle = medians(likeness, bounds)
            off = medians(np.abs(likeness - np.repeat(middle, n)), bounds)
            least = middle - np.maximum(MIN_DROP, MAD_SCALE * off)
            out[inside + 1] = (likeness <= FLOOR) | (likeness <= np.repeat(least, n))
        return out

    def packed(self, target: int, most: int, overlap: int, least: int, semantic: bool) -> list[tuple[int, int, int, int, int]]:
        """(text, ordinal, start, end, tokens) of chunks of whole units: packed to the target, a short tail joined to the last, each begun with up to ``overlap`` tokens of the one before."""
        size, first, last = self.size.tolist(), self.first.tolist(), self.last.tolist()
        breaks = self.breaks().tolist() if semantic else [False] * len(size)
        bounds = np.append(run_starts(self.in_text[self.first]), len(size)).tolist()
        out = []
        for begin, end in zip(bounds[:-1], bounds[1:]):
            text = int(self.in_text[first[begin]])
            packs, sums = [begin], [0]
            for i in range(begin, end):
                n, used = size[i], sums[-1]
                if i > begin and (used + n > target or (breaks[i] and used >= least)):
                    packs.append(i)
                    sums.append(0)
                sums[-1] += n
            if len(packs) > 1 and sums[-1] < least and sums[-1] + sums[-2] <= most:
                packs.pop()
                sums[-2:] = [sums[-2] + sums[-1]]
            packs.append(end)
            for k, total in enumerate(sums):
                start, room = packs[k], min(overlap, most - total)
                for i in range(start - 1, packs[k - 1] - 1 if k else start - 1, -1):
                    if size[i] > room:
                        break
                    start, room, total = i, room - size[i], total + size[i]
                out.append((text, k, int(self.starts[first[start]]), int(self.ends[last[packs[k + 1] - 1] - 1]), total))
        return out

    def chunks(self, target: int, most: int, overlap: int, least: int, semantic: bool) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of the chunks of all texts, as ``packed`` has them."""
        return [c[2:] for c in self.packed(target, most, overlap, least, semantic)]


def chunk(docs: DataFrame, key: str, text: str, target: int = 384, most: int = 512, overlap: int = 64, least: int = 96, semantic: bool = False) -> DataFrame:
    """(key, ordinal, char_start, char_end, n_tokens, chunk, content_hash): each chunk is a slice of its text.

    With ``semantic`` a chunk of ``least`` tokens also ends where neighbouring
    sentences have little in common, by their hashed word counts. Null and
    empty texts, and texts of white space, have no chunks.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            texts = batch.column("t").fill_null("").to_pylist()
            found = Units(texts, most).packed(target, most, overlap, least, semantic)
            if found:
                at, o, s, e, n = zip(*found)
                own = batch.column("k").take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int32()) for x in (o, s, e, n)), pa.array([texts[i][a:b] for i, a, b in zip(at, s, e)], pa.string())], names=["k", "ordinal", "char_start", "char_end", "n_tokens", "chunk"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ordinal int, char_start int, char_end int, n_tokens int, chunk string")
    return out.withColumnRenamed("k", key).withColumn("content_hash", F.sha2("chunk", 256))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, path, body): each line that is no heading, with the titles above it joined by ' > '.

    A heading ends all headings of its level or deeper: of each level the last
    title counts if no shallower heading came after it.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    level = F.length(F.regexp_extract("body", r"^(#{1,6})\s+\S", 1))
    marked = lines.withColumn("level", level).withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_replace("body", r"^#{1,6}\s+", ""))))
    by = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for i in range(1, 7):
        marked = marked.withColumn(f"h{i}", F.last(F.when(F.col("level") == i, F.struct("line", "title")), True).over(by))
        marked = marked.withColumn(f"cut{i}", F.max(F.when((F.col("level") > 0) & (F.col("level") < i), F.col("line"))).over(by))
    path = F.concat_ws(" > ", *[F.when(F.col(f"h{i}.line") > F.coalesce(F.col(f"cut{i}"), F.lit(-1)), F.col(f"h{i}.title")) for i in range(1, 7)])
    return marked.where("level = 0").select(key, "line", path.alias("path"), "body")


def select_context(docs: DataFrame, key: str, text: str, asked: list[str], budget: int) -> DataFrame:
    """(key, ordinal, path, module) of the sections that fit the budget, the likeliest first, given back in document order.

    score = 16 x terms in the path + 5 x terms in the content + 3 for the
    first + place / number; sections that don't fit any more are skipped, the
    first choice is cut to the budget.
    """
    sections = markdown_sections(docs, key, text)
    modules = sections.groupBy(key, "path").agg(F.min("line").alias("line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("module"))
    w = Window.partitionBy(key)
    placed = modules.withColumn("ordinal", F.row_number().over(w.orderBy("line"))).withColumn("total", F.count("*").over(w))
    q = F.array(*map(F.lit, asked))
    hits = lambda c: F.size(F.array_intersect(terms(F.col(c)), q))
    scored = placed.withColumn("score", 16 * hits("path") + 5 * hits("module") + F.when(F.col("ordinal") == 1, 3).otherwise(0) + F.col("ordinal") / F.col("total"))
    row = F.struct((-F.col("score")).alias("s"), "ordinal", "path", F.left("module", F.lit(budget)).alias("module"))
    packed = scored.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = packed.schema["rows"].dataType.simpleString()

    def step(state, r):
        fits = state["used"] + F.length(r["module"]) <= budget
        return F.struct((state["used"] + F.when(fits, F.length(r["module"])).otherwise(0)).alias("used"), F.when(fits, F.concat(state["out"], F.array(r))).otherwise(state["out"]).alias("out"))

    done = packed.select(key, F.aggregate("rows", F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("out")), step, lambda s: s["out"]).alias("out"))
    return done.select(key, F.explode("out").alias("r")).select(key, F.col("r.ordinal").alias("ordinal"), F.col("r.path").alias("path"), F.col("r.module").alias("module"))
