"""Alignment of two tokenizers: where their tokens end together, and which tokens are linked.

A text is cut before each blank that follows a character of another kind; no
token of either vocabulary goes over such a cut (which is checked), so a task
learns each piece of text once, as a dictionary of pieces. A piece's tokens
are laid out one a place, their lengths added up along the piece, the two
layouts equi-joined on (piece, end), and the joined rows counted along it: the
running counts are the numbers of the groups. What the corpus has to say about
a link, how often it is made and whether its second token is linked more often
otherwise, comes from grouped counts and a join of Spark's.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import lists, ranges, run_starts, slices
from tessera.session import shared_folder

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Where a text is cut.
CUT = re.compile(r"(?<=\S)(?= )")
#: A task's dictionary starts anew beyond so many pieces or characters.
PIECES, CHARACTERS = 400_000, 8_000_000
_END = 1 << 40
#: Fixed value: the pattern by which a byte-level vocabulary of this kind cuts texts before it merges.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_encoder(file: bytes) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """(texts to lists of ids, bytes of each id) of a byte-level vocabulary file.

    Where ids are numbered by their merges, the merges are a ranking of byte
    strings, which takes a third of the time; elsewhere the file's own steps run.
    """
    parts = json.loads(file)
    model, of = parts["model"], byte_level()
    vocabulary = {t: i for t, i in model["vocab"].items() if all(c in of for c in t)}
    spelt = [b""] * (1 + max(model["vocab"].values()))
    for token, i in model["vocab"].items():
        spelt[i] = bytes(of[c] for c in token) if token in vocabulary else token.encode()
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    pre = parts.get("pre_tokenizer") or {}
    ranked = all(vocabulary.get(m) == 256 + i for i, m in enumerate(merges)) and sorted(vocabulary[c] for c in of) == list(range(256))
    if ranked and parts.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        import tiktoken

        # merged tokens only: entries that no merge makes can't come up in plain text
        known = {spelt[vocabulary[t]]: vocabulary[t] for t in [*of, *merges]}
        encoding = tiktoken.Encoding("ranked", pat_str=WORD, mergeable_ranks=known, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts], spelt
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file.decode())
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], spelt


class Dictionary:
    """Pieces of text with their tokens, groups and links; grows as pieces come up."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece

        self.a, self.a_bytes = byte_encoder(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = pieces.index("▁")
        # merges never go over a cut if no piece has a blank behind another character
        self.cuts = CUT if not any(re.search("[^▁]▁", p) for p in pieces) else re.compile(r"(?!)")
        self.a_size, self.b_size = (np.array([len(x) for x in spelt]) for spelt in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.characters = 0
        self.groups: list[str] = []
        self._numbers, self._links = np.zeros((4, 1 << 16), np.int64), np.zeros(1 << 17, np.int64)
        self._held = 0

    @property
    def numbers(self) -> np.ndarray:
        """By piece: whether both vocabularies give it back, tokens of a, of b, groups."""
        return self._numbers[:, : len(self.groups)]

    @property
    def links(self) -> np.ndarray:
        return self._links[: self._held]

    def places(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece in the dictionary."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.index]
        if self.index and (len(self.index) + len(new) > PIECES or self.characters + sum(map(len, new)) > CHARACTERS):
            self.clear()
            new = list(dict.fromkeys(pieces))
        if new:
            self.learn(new)
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def given_back(self, new: list[str], tokens: list[list[int]], spelt: list[bytes]) -> list[bool]:
        """Whether the tokens of each piece are its bytes, compared for all at once if they are."""
        n = np.array([len(x) for x in tokens])
        at = np.cumsum(n)
        texts = [p.encode("utf-8", "surrogatepass") for p in new]
        every = [spelt[t] for x in tokens for t in x]
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in every])])
        if (np.diff(sizes[np.concatenate([[0], at])]) == [len(t) for t in texts]).all() and b"".join(every) == b"".join(texts):
            return [True] * len(new)
        return [b"".join([spelt[t] for t in x]) == t for x, t in zip(tokens, texts)]

    def learn(self, new: list[str]) -> None:
        a = self.a(new)
        b = [[self.blank] if p == " " else ids for p, ids in zip(new, self.b.encode([p[1:] for p in new], num_threads=1))]
        right = [x and y for x, y in zip(self.given_back(new, a, self.a_bytes), self.given_back(new, b, self.b_bytes))]
        if not all(right):
            a, b = ([x if r else [] for x, r in zip(tokens, right)] for tokens in (a, b))
        # a token a row, and where it ends in its piece
        (a_id, a_own, a_n, a_end), (b_id, b_own, b_n, b_end) = self.laid_out(a, self.a_size), self.laid_out(b, self.b_size)
        # the equi-join on piece and end
        _, i, j = np.intersect1d(a_own * _END + a_end, b_own * _END + b_end, assume_unique=True, return_indices=True)
        made = np.bincount(a_own[i], minlength=len(new))
        old, total = len(self.groups), self._held + len(i)
        if old + len(new) > self._numbers.shape[1]:
            self._numbers = np.concatenate([self._numbers, np.zeros((4, old + 2 * len(new)), np.int64)], axis=1)
        if total > len(self._links):
            self._links = np.concatenate([self._links, np.zeros(self._held + 2 * len(i), np.int64)])
        self._numbers[:, old : old + len(new)] = right, a_n, b_n, made
        self._links[self._held : total] = (a_id[i] << 32) | b_id[j]
        self._held = total
        self.index.update(zip(new, range(old, old + len(new))))
        self.characters += sum(map(len, new))
        a_text, b_text = list(map(str, a_id.tolist())), list(map(str, b_id.tolist()))
        i, j = (i + 1).tolist(), (j + 1).tolist()
        # pieces end with a joined row, so a group's tokens are those behind the last one's
        each = [",".join(a_text[p:q]) + "|" + ",".join(b_text[r:s]) for p, q, r, s in zip([0, *i], i, [0, *j], j)]
        ends = np.cumsum(made).tolist()
        self.groups += [";".join(each[e - m : e]) for e, m in zip(ends, made.tolist())]

    @staticmethod
    def laid_out(tokens: list[list[int]], size: np.ndarray) -> tuple[np.ndarray, ...]:
        n = np.array([len(x) for x in tokens], np.int64)
        ids = np.fromiter(chain.from_iterable(tokens), np.int64, int(n.sum()))
        own = np.repeat(np.arange(len(tokens)), n)
        total = np.cumsum(size[ids])
        before = np.concatenate([[0], total])[np.cumsum(n) - n]
        return ids, own, n, total - before[own] if len(ids) else total


def aligned(documents: DataFrame, key: str, text: str, a_file: str, b_file: str) -> DataFrame:
    """(k, n_a, n_b, n_groups, groups_sha256, a, b, n) of each row: linked ids of the text, each pair once, and how often."""
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        files = documents.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        d = Dictionary(*files.value)
        for batch in slices(batches, "t"):
            texts = batch.column("t").to_pylist()
            cut = [d.cuts.split(" " + t) if t else [] for t in texts]
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
            place = d.places([p for c in cut for p in c])
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            right, n_a, n_b, made = (np.bincount(doc, x, len(texts)).astype(np.int64) for x in d.numbers[:, place])
            whole = (right == np.diff(bounds)) & (right > 0)
            n_a, n_b, made = n_a * whole, n_b * whole, made * whole
            order = place.tolist()
            digests = [hashlib.sha256(";".join([d.groups[p] for p in order[s:e]]).encode()).hexdigest() if w else "" for s, e, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), whole)]
            # the links of all texts, counted
            own = place[whole[doc]]
            count = d.numbers[3, own]
            at = np.cumsum(d.numbers[3]) - d.numbers[3]
            link, link_doc = d.links[ranges(at[own], count)], np.repeat(doc[whole[doc]], count)
            sort = np.lexsort((link, link_doc))
            link, link_doc = link[sort], link_doc[sort]
            first = run_starts(link_doc, link)
            often = np.diff(np.append(first, len(link)))
            ends = np.searchsorted(link_doc[first], np.arange(len(texts) + 1))
            pair = link[first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(n_a), pa.array(n_b), pa.array(made), pa.array(digests, pa.string()), lists((pair >> 32).astype(np.int32), ends), lists((pair & 0xFFFFFFFF).astype(np.int32), ends), lists(often.astype(np.int32), ends)],
                names=["k", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "n"],
            )

    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a array<int>, b array<int>, n array<int>")


def _written(rows: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, numbered there, so that numbers stay whatever is lost."""
    path = f"{shared_folder(rows.sparkSession)}/align-{uuid.uuid4().hex}"
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def links(texts: DataFrame) -> DataFrame:
    """(row, a, b, n, count, best) of rows of ``aligned``: each linked id pair of a text once.

    ``n`` is how often the text links it, ``count`` how often all texts do, and
    ``best`` says that no pair of its id of b is linked more often.
    """
    pair = F.shiftleft(F.col("l.a").cast("bigint"), 32).bitwiseOR(F.col("l.b").cast("bigint"))
    each = texts.where("n_groups > 0").select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("l")).select("row", pair.alias("pair"), F.col("l.n").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(second).agg(F.max("count").alias("most"))
    known = counts.withColumn("b", second).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return each.join(known, "pair").select("row", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n", "count", "best")


def align(documents: DataFrame, key: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of documents.

    Tokens of space + text by A (byte-level BPE) and of the text by B (a
    SentencePiece model that puts the space before it), without special tokens.
    Offsets at which tokens of both end cut them into groups; a link is a token
    of each that end together, and a group ends with one. A text that is null,
    empty, or isn't given back byte by byte by one of them (as with a U+2581 of
    its own) has no tokens: zeros, and an empty digest. Null keys and repeated
    rows stay rows of their own; other columns are left out; no rows give none.
    """
    texts = _written(aligned(documents, key, text, a_file, b_file))
    parts = links(texts).select("row", "n", F.when(F.col("best"), F.col("n")).otherwise(0).alias("b"), (F.col("n") * F.col("count")).alias("c"))
    # a text's links come from as many partitions as it has links: adding up before they meet would save nothing at scale
    sums = parts.repartition("row").groupBy("row").agg(F.sum("n").alias("n_links"), F.sum("b").alias("n_best"), F.sum("c").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return texts.drop("a", "b", "n").join(sums, "row", "left").select(F.col("k").alias(key), "n_a", "n_b", "n_groups", *zero, "groups_sha256")
