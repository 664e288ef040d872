"""Sampled SentencePiece segmentations without replacement, and decoding.

The pieces of a vocabulary that match a text form a lattice; a piece weighs
minus the logarithm of its rank (Zipf's law on the merge order). Segmentations
are drawn without replacement by Gumbel top-k: the space is split at every
decision of the best one into regions, each with a Gumbel bound truncated at
its parent's, and the region of the largest bound is opened next, as in A*
search with exact bounds. Random numbers are hashes of the row's key and of
the place in the text, so a row's result doesn't depend on the partitioning.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import lists, mix, powers, ranges, run_starts, slices, span_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
#: Segmentations of each text.
SAMPLES = 2
#: Weight of a character that only bytes can spell, and scale of the weights (larger: less random).
BYTES_WEIGHT, ALPHA = -14.0, 1.0
#: Bytes of text worked on at once, characters whose lattices are built at once, edges of lattices held before the store is emptied.
STEP, ADDED, HELD_EDGES = 1 << 19, 1 << 16, 4_000_000


def sums_of(codes: np.ndarray) -> np.ndarray:
    """Running sums of which a difference, times an inverse power, is a hash of the codes between."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers("up", len(codes)), dtype=np.uint64)])


#: Brings all bits of a hash to its top.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces and their beginnings by hash, and the bytes that each id stands for."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in pieces]
        size = np.array([len(c) for c in codes])
        begin = np.cumsum(size) - size
        joined = np.concatenate(codes)
        # every beginning of every piece, so that a longer match is only looked for where a shorter one may go on
        starts = np.repeat(begin, size)
        ends = np.arange(len(joined)) + 1
        sums = sums_of(joined)
        self.hashes, at = np.unique((sums[ends] - sums[starts]) * powers("down", len(joined) + 1)[starts], return_index=True)
        whole = np.searchsorted(self.hashes, (sums[begin + size] - sums[begin]) * powers("down", len(joined) + 1)[begin])
        self.ids, self.weights = np.full(len(self.hashes), -1), np.zeros(len(self.hashes))
        self.ids[whole], self.weights[whole] = ids, -ALPHA * np.log(2.0 + np.array(ids) - ids[0])
        #: By the top bits of a spread hash: a beginning with these, or -1 where there is none.
        self.slot = np.full(1 << 21, -1, np.int32)
        self.slot[(self.hashes * SPREAD >> np.uint64(43)).astype(np.int64)] = np.arange(len(self.hashes))
        self.longest = max(map(len, codes))
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        spelt = [b""] * sp.vocab_size()
        for i, p in zip(ids, pieces):
            spelt[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids):
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_at = np.concatenate([[0], np.cumsum([len(s) for s in spelt])])


class Lattices:
    """The lattices of the distinct units seen so far; a unit is what no piece reaches across.

    A node is a place in a unit. Its edges have the probabilities of the next
    piece given the rest of the unit, summed up by a backward pass.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.root: dict[int, int] = {}
        self.nodes = self.edges = 0
        # by node: its first edge; by edge: cumulated probability, log-probability, next node, ids
        self.first = np.zeros(1 << 16, np.int32)
        self.total, self.logp = np.zeros(1 << 16), np.zeros(1 << 16)
        self.to, self.id_at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.id_n = np.zeros(1 << 16, np.int8)
        self.pool, self.pooled = np.zeros(1 << 16, np.int32), 0

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        """values at a place of a growing array."""
        have = getattr(self, name)
        if at + len(values) > len(have):
            more = np.zeros(max(at + len(values), len(have) * 3 // 2), have.dtype)
            more[: len(have)] = have
            setattr(self, name, have := more)
        have[at : at + len(values)] = values

    def add(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Lattices of new distinct units codes[start:end]; nodes are numbered by their distance from the unit's end."""
        size = ends - starts
        own = codes[ranges(starts, size)]
        bounds = np.concatenate([[0], np.cumsum(size)])
        n = len(own)
        left = np.repeat(bounds[1:], size) - np.arange(n)
        by_left = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        node_of = np.empty(n, np.int64)
        node_of[by_left] = np.arange(n)
        sums, down = sums_of(own), powers("down", n + 1)
        # the pieces that begin at each place, by length
        found = []
        count = np.zeros(n, np.int64)
        reach = np.arange(n)
        for k in range(1, self.v.longest + 1):
            reach = reach[left[reach] >= k]
            if not len(reach):
                break
            h = (sums[reach + k] - sums[reach]) * down[reach]
            i = self.v.slot[(h * SPREAD >> np.uint64(43)).astype(np.int64)]
            likely = np.flatnonzero(i >= 0)
            reach, h, i = reach[likely], h[likely], i[likely]
            other = np.flatnonzero(self.v.hashes[i] != h)
            i[other] = np.minimum(np.searchsorted(self.v.hashes, h[other]), len(self.v.hashes) - 1)
            hit = self.v.hashes[i] == h
            reach, i = reach[hit], i[hit]
            piece = self.v.ids[i] >= 0
            at, i = reach[piece], i[piece]
            if k == 1:
                loose = np.ones(n, bool)
                loose[at] = False
                loose = np.flatnonzero(loose)
                found.append((loose, count[loose], 1, BYTES_WEIGHT, -1 - own[loose].astype(np.int64)))
                count[loose] += 1
            found.append((at, count[at], k, self.v.weights[i], self.v.ids[i]))
            count[at] += 1
        per = count[by_left]
        first = np.concatenate([[0], np.cumsum(per)])
        total = int(first[-1])
        weight, piece, to, rank = np.empty(total), np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        for at, place, k, w, ids in found:
            e = first[node_of[at]] + place
            weight[e], piece[e], rank[e] = w, ids, place
            to[e] = np.where(left[at] == k, -1, node_of[np.minimum(at + k, n - 1)])
        del found
        beta, prob = np.zeros(n + 1), np.empty(total)  # a step to -1 finds the 0 at the end
        levels = np.searchsorted(left[by_left], np.arange(1, int(left.max()) + 2))
        for s, e in zip(levels[:-1].tolist(), levels[1:].tolist()):
            x, y = first[s], first[e]
            value = weight[x:y] + beta[to[x:y]]
            at = first[s:e] - x
            top = np.maximum.reduceat(value, at)
            mass = np.log(np.add.reduceat(np.exp(value - np.repeat(top, per[s:e])), at)) + top
            beta[s:e] = mass
            prob[x:y] = value - np.repeat(mass, per[s:e])
        p = np.exp(np.minimum(prob, 0.0))
        # within a node the likeliest first: a walk then mostly takes the first
        node = np.repeat(np.arange(n), per)
        order = np.lexsort((rank, np.int64(1 << 32) - (p * (1 << 32)).astype(np.int64), node)) if n >> 25 else np.argsort(((node << 33 | np.int64(1 << 32) - (p * (1 << 32)).astype(np.int64)) << 5) | rank)
        piece, to, prob, run = piece[order], to[order], prob[order], p[order]
        for j in range(1, int(per.max())):
            e = first[:-1][per > j] + j
            run[e] += run[e - 1]
        run[first[1:] - 1] = 1.0
        # the ids of an edge: its piece, or the bytes of its character
        spelt = [np.frombuffer(chr(-1 - int(c)).encode("utf-8", "replace"), np.uint8) for c in piece[piece < 0]]
        id_n = np.ones(total, np.int8)
        id_n[piece < 0] = [len(b) for b in spelt]
        pool = np.repeat(piece, id_n)
        if spelt:
            pool[np.repeat(piece < 0, id_n)] = self.v.byte_ids[np.concatenate(spelt)]
        for name, values in (("total", run), ("logp", np.minimum(prob, 0.0)), ("to", np.where(to < 0, -1, to + self.nodes)), ("id_at", self.pooled + np.cumsum(id_n) - id_n), ("id_n", id_n)):
            self.put(name, self.edges, values)
        self.put("pool", self.pooled, pool)
        self.put("first", self.nodes, self.edges + first)
        self.root.update(zip(hashes.tolist(), (node_of[bounds[:-1]] + self.nodes).tolist()))
        self.edges, self.pooled, self.nodes = self.edges + total, self.pooled + len(pool), self.nodes + n

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of a random path from each node to its unit's end, number of the path of each edge)."""
        steps = []
        size = np.zeros(len(nodes), np.int64)
        path = np.flatnonzero(nodes >= 0)
        node, seed = nodes[path], seeds[path]
        while len(path):
            seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
            u = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            on = np.flatnonzero(u > self.total[edge])  # the last edge's is 1
            while len(on):
                edge[on] += 1
                on = on[u[on] > self.total[edge[on]]]
            steps.append((path, edge))
            size[path] += 1
            node = self.to[edge]
            on = np.flatnonzero(node >= 0)
            path, node, seed = path[on], node[on], seed[on]
        begin = np.cumsum(size) - size
        edges = np.empty(int(size.sum()), np.int64)
        for j, (path, edge) in enumerate(steps):
            edges[begin[path] + j] = edge
        return edges, np.repeat(np.arange(len(nodes)), size)


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points with blanks as the vocabulary has them, start and end of each unit, first unit of each text and the end)."""
    codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "replace"), np.uint32).copy()
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    codes[codes == 32] = BLANK
    new = np.zeros(len(codes) + 1, bool)
    blank, control = codes == BLANK, codes < 32
    new[1:-1] = blank[1:] & ~blank[:-1] | control[1:] | control[:-1]
    new[bounds] = True
    starts = np.flatnonzero(new[:-1])
    return codes, starts, np.append(starts[1:], len(codes)), np.searchsorted(starts, bounds)


def best_of(value: np.ndarray, starts: np.ndarray, most: int) -> list[np.ndarray]:
    """The places of the largest, second largest ... value of each run, up to ``most``; -1 where a run has no more."""
    value = value.copy()
    size = np.diff(np.append(starts, len(value)))
    out = []
    for _ in range(min(most, int(size.max(initial=0)))):
        top = np.maximum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(top, size))
        run = np.searchsorted(starts, hit, "right") - 1
        at = run_starts(run)
        best = np.full(len(starts), -1)
        best[run[at]] = hit[at]
        best[np.isneginf(top)] = -1
        out.append(best)
        value[best[best >= 0]] = -np.inf
    return out


def segmentations(lattices: Lattices, keys: np.ndarray, texts: list[str | None], k: int) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """(text number, sample, edges, log-probability, inclusion score), samples of a text in the order drawn.

    The texts are worked on together: each round takes one path of every text
    that isn't done, splits its region, and opens the text's next region.
    """
    codes, starts, ends, first = units(texts)
    if lattices.edges > HELD_EDGES:
        lattices.clear()
    h = span_hashes(codes, starts, ends)
    known, at, index = np.unique(h, return_index=True, return_inverse=True)
    missing = np.array([i for i, x in enumerate(known.tolist()) if x not in lattices.root], np.int64)
    size = np.cumsum((ends - starts)[at[missing]])
    for part in np.split(missing, np.searchsorted(size, np.arange(ADDED, size[-1], ADDED))) if len(missing) else ():
        if len(part):
            lattices.add(known[part], codes, starts[at[part]], ends[at[part]])
    roots = np.array([lattices.root[x] for x in known.tolist()], np.int64)[index] if len(h) else np.zeros(0, np.int64)
    n = len(texts)
    text_of = np.repeat(np.arange(n), np.diff(first))
    row = mix(keys.view(np.uint64) + np.uint64(1))
    place = (np.arange(len(h)) - first[text_of]).astype(np.uint64)

    def seed(text: np.ndarray, draw: np.ndarray) -> np.ndarray:
        return mix(row[text] + draw.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def uniform(seeds: np.ndarray, place: np.ndarray) -> np.ndarray:
        x = mix(seeds + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    edges, of = lattices.walk(roots, mix(row[text_of] + place))
    cut = np.searchsorted(text_of[of] if len(of) else of, np.arange(n + 1))
    every, zero = np.arange(n), np.zeros(n, np.int64)
    draws = zero + 1
    bounds = (-np.log(-np.log(uniform(seed(every, draws), zero)))).tolist()
    # by text: regions (minus bound, order, decision at which a path is left, the path, its units, the edges barred there); what is drawn
    heaps: list[list[tuple]] = [[] for _ in range(n)]
    out: list[list[tuple]] = [[] for _ in range(n)]
    # (text, path, its units, decisions that are fixed, edges barred at the last of them)
    turn = [(t, edges[cut[t] : cut[t + 1]], of[cut[t] : cut[t + 1]], 0, ()) for t in range(n)]
    while turn:
        for t, path, _, _, _ in turn:
            if not len(path):
                out[t].append((path, 0.0, bounds[t]))
        turn = [x for x in turn if len(x[1])]
        if not turn:
            break
        # each path is the best of its region; what else the region holds splits at each decision after the fixed ones
        live = np.array([x[0] for x in turn])
        size = np.array([len(x[1]) for x in turn])
        begin = np.cumsum(size) - size
        draws[live] += 1
        logp = lattices.logp[np.concatenate([x[1] for x in turn])]
        with np.errstate(divide="ignore"):
            mass = np.where(logp > -1e-13, -np.inf, np.log(-np.expm1(logp)))
        for (t, path, _, fixed, barred), s, m in zip(turn, begin.tolist(), size.tolist()):
            before = np.cumsum(logp[s : s + m])
            out[t].append((path, float(before[-1]), bounds[t]))
            mass[s + 1 : s + m] += before[:-1]
            if fixed:
                mass[s : s + fixed] = -np.inf
                rest = -np.expm1(np.log(np.exp(lattices.logp[list(barred)]).sum()))
                if rest > 1e-13:
                    mass[s + fixed - 1] = (before[fixed - 2] if fixed > 1 else 0.0) + np.log(rest)
        # masses of the regions less their exponential draws: the order of the truncated bounds
        value = mass - np.log(-np.log(uniform(np.repeat(seed(live, draws[live]), size), np.arange(len(mass)) - np.repeat(begin, size))))
        for best in best_of(value, begin, k + 1):
            for (t, path, path_units, fixed, barred), s, d in zip(turn, begin.tolist(), best.tolist()):
                if d >= 0:
                    bound = -float(np.logaddexp(-bounds[t], -value[d]))
                    d -= s
                    heapq.heappush(heaps[t], (-bound, (int(draws[t]), d), d, path, path_units, barred if barred and d == fixed - 1 else (int(path[d]),)))
        opened = []
        for t in live.tolist():
            if not heaps[t]:
                continue
            minus, _, d, parent, parent_units, barred = heapq.heappop(heaps[t])
            bounds[t] = -minus
            if len(out[t]) == k:
                out[t].append((None, 0.0, -minus))
            else:
                opened.append((t, d, parent, parent_units, barred))
        if not opened:
            break
        # the decision taken anew among the other edges of its node, then a free walk to the end
        live = np.array([x[0] for x in opened])
        draws[live] += 1
        seeds = seed(live, draws[live])
        chance = uniform(seeds, np.zeros(len(live), np.int64)).tolist()
        nodes = np.searchsorted(lattices.first[: lattices.nodes + 1], np.array([x[2][x[1]] for x in opened], np.int32), "right") - 1
        edges_taken, rests = [], []
        for (t, d, parent, parent_units, barred), node, u in zip(opened, nodes.tolist(), chance):
            options = np.array([e for e in range(lattices.first[node], lattices.first[node + 1]) if e not in barred])
            weights = np.cumsum(np.exp(lattices.logp[options]))
            edge = int(options[min(int(np.searchsorted(weights, u * weights[-1], "right")), len(options) - 1)])
            edges_taken.append(edge)
            rests.append(np.concatenate([lattices.to[edge : edge + 1], roots[parent_units[d] + 1 : first[t + 1]]]))
        size = np.array([len(x) for x in rests])
        begin = np.cumsum(size) - size
        of_text = np.repeat(np.arange(len(rests)), size)
        more, more_of = lattices.walk(np.concatenate(rests), mix(seeds[of_text] + (np.arange(len(of_text)) - begin[of_text]).astype(np.uint64)))
        cut = np.searchsorted(more_of, np.append(begin, len(of_text)))
        turn = []
        for j, ((t, d, parent, parent_units, barred), edge) in enumerate(zip(opened, edges_taken)):
            a, b = cut[j], cut[j + 1]
            path = np.concatenate([parent[:d], [edge], more[a:b]])
            path_units = np.concatenate([parent_units[: d + 1], more_of[a:b] - begin[j] + parent_units[d]])
            turn.append((t, path, path_units, d + 1, (*barred, edge)))
    for t in range(n):
        threshold = out[t][k][2] if len(out[t]) > k else -np.inf
        for i, (path, lp, _) in enumerate(out[t][:k]):
            yield t, i, path, lp, float(-np.expm1(-np.exp(min(lp - threshold, 50.0)))) if np.isfinite(threshold) else 1.0


def spellings(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes that each run of ids stands for, without the blank before the first word."""
    n = v.spelt_at[ids + 1] - v.spelt_at[ids]
    spelt = v.spelt[ranges(v.spelt_at[ids], n)].tobytes()
    at = np.concatenate([[0], np.cumsum(n)])[bounds].tolist()
    return [spelt[s + (spelt[s : min(s + 1, e)] == b" ") : e] for s, e in zip(at[:-1], at[1:])]


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, sample, ids, log_prob, inclusion, exact): up to k distinct segmentations of each text, in the order drawn.

    ``inclusion`` is the probability that the segmentation is among k drawn,
    given the first bound not drawn (1 if there are no more than k).
    ``exact`` says that decoding gives the text back; a text with a
    U+2581 of its own is the one case that doesn't. An empty text has one
    segmentation, without ids; a null text one row with null ids. Null keys
    are seeded as 0; repeated rows have equal results. The vocabulary file,
    of a size of its own, is read by the driver and goes to the tasks with
    the function.
    """
    model = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model.value)
        lattices = Lattices(v)
        for batch in slices(batches, "t", STEP):
            texts = batch.column("t").to_pylist()
            seeds = batch.column("s").to_numpy(zero_copy_only=False)
            rows, samples, paths, logs, inclusions, valid = [], [], [], [], [], []
            for t, i, path, lp, inc in segmentations(lattices, seeds, texts, k):
                null = texts[t] is None
                rows.append(t), samples.append(i), paths.append(path), logs.append(None if null else lp), inclusions.append(None if null else inc), valid.append(not null)
            edges = np.concatenate(paths)
            id_n = lattices.id_n[edges]
            ids = lattices.pool[ranges(lattices.id_at[edges], id_n)]
            bounds = np.concatenate([[0], np.cumsum(id_n)])[np.concatenate([[0], np.cumsum([len(p) for p in paths])])]
            back = spellings(v, ids, bounds)
            exact = [None if texts[t] is None else b == texts[t].encode("utf-8", "replace") for t, b in zip(rows, back)]
            ids = lists(ids, bounds)
            if not all(valid):
                ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=pa.array([not x for x in valid]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(pa.array(rows, pa.int64())), pa.array(samples, pa.int32()), ids, pa.array(logs, pa.float64()), pa.array(inclusions, pa.float64()), pa.array(exact, pa.bool_())], names=["k", "sample", "ids", "log_prob", "inclusion", "exact"]
            )

    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("s"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, sample int, ids array<int>, log_prob double, inclusion double, exact boolean").withColumnRenamed("k", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, sample, text): the texts of rows of ids; null ids give a null text, bytes that aren't UTF-8 a replacement mark."""
    model = encoded.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model.value)
        for batch in batches:
            column = batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))])
            back = spellings(v, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            texts = [b.decode("utf-8", "replace") if known else None for b, known in zip(back, column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("sample"), pa.array(texts, pa.string())], names=["k", "sample", "text"])

    return encoded.select(F.col(key).alias("k"), "sample", F.col(ids).alias("ids")).mapInArrow(run, f"k {kind}, sample int, text string").withColumnRenamed("k", key)
