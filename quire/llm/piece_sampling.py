"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice.

A text falls into units before each space that follows another character, and around line feeds; no piece of the model
crosses these places (which is checked), so the lattice of a text is the chain of its units' lattices and each unit is
filtered once per worker. Of a unit of any length without a space only the forward sums are kept, and the edges into a
place are found again when the backward way comes there. Backward sampling goes through all occurrences of a batch at once: one step draws, for each, the edge that ends at
its place. The draws come from a counter-based generator keyed by the row's key, the unit's place in the text and the
step, so a row's segmentation depends on nothing else.

The model is a BPE one whose scores are merge ranks; they become probabilities by Zipf's law, p = 1 / (rank + 10), raised to
alpha. Characters without a piece (and the space mark itself) are spelled in byte pieces, so decoding gives every text back.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .codec import texts_of
from .common import list_column, mix, powers, released
from .token_files import ids_crc32

MODEL, ALPHA, SEED = "piece_bpe_32k.model", 0.25, 1
UNITS = re.compile(r"\n| *[^ \n]+| +")
MARK = "▁"
LONG = 64  # units of more characters are sampled one by one, with rescaling, and not kept
BLOCK = 1 << 16  # characters of such a unit whose pieces are looked up at once
TINY, HUGE = 1e-150, 1e150

_samplers: dict[tuple, "Sampler"] = {}


def sampler(model: str, alpha: float) -> "Sampler":
    if (model, alpha) not in _samplers:
        _samplers[model, alpha] = Sampler(model, alpha)
    return _samplers[model, alpha]


def load(model: str):
    """(piece text to (id, rank), byte to id, id to bytes) of a model file."""
    import sentencepiece

    from .common import tokenizer_path

    sp = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else tokenizer_path(model))
    crossing = [p for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and len(UNITS.findall(p := sp.id_to_piece(i).replace(MARK, " "))) != 1]
    if crossing:
        raise ValueError(f"pieces that cross units: {crossing[:5]}")
    pieces, spelled, raw = {}, {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            spelled[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            pieces[piece.replace(MARK, " ")] = (i, -sp.get_score(i))
            raw.append(piece.replace(MARK, " ").encode())
    return pieces, spelled, raw


class Sampler:
    def __init__(self, model: str, alpha: float, most: int = 4_000_000):
        """most: edges kept; beyond that, the table of units is begun anew."""
        self.pieces, self.spelled, self.raw = load(model)
        self.weights = {p: (i, (1 / (rank + 10)) ** alpha) for p, (i, rank) in self.pieces.items()}
        self.rare = (1 / (len(self.raw) + 10)) ** alpha
        self.reach = max(map(len, self.pieces))
        self.most = most
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64) for p in self.weights]
        up, _ = powers(self.reach)
        keys = np.array([(mix(c) * up[: len(c)]).sum(dtype=np.uint64) for c in codes], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.sieve = np.zeros(1 << 20, bool)  # by the first bits of a key: whether a piece may have it
        self.sieve[keys >> np.uint64(44)] = True
        self.key_ids, self.key_weights = (np.array(x)[order] for x in zip(*self.weights.values()))
        self.emitted, self.spellings = np.arange(len(self.raw), dtype=np.int32), {}
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.begin, self.end = np.empty(0, np.int64), np.empty(0, np.int64)  # of each unit: its first and last state
        #: by edge: the state that it ends at plus its share of the draws, the state before, where its ids are, how many
        self.upto, self.before, self.emit_at, self.emit_n = np.empty(0), *(np.empty(0, np.int64) for _ in range(3))
        self.first_edge = np.zeros(1, np.int64)  # by state, and one more

    def _into(self, unit: str, j: int):
        """Edges into state j, by their start: (start, ids, weight)."""
        weights, out = self.weights, []
        for i in range(max(0, j - self.reach), j):
            if (hit := weights.get(unit[i:j])) is not None:
                out.append((i, (hit[0],), hit[1]))
        if unit[j - 1] not in weights:
            spelled = tuple(self.spelled[b] for b in unit[j - 1].encode())
            out.append((j - 1, spelled, self.rare ** len(spelled)))
        return out

    def forward(self, unit: str):
        """(sums, scales) of states 0..len(unit): all paths' weight into a state is its sum over HUGE ** its scale."""
        sums, scales = array("d", bytes(8 * (len(unit) + 1))), array("i", bytes(4 * (len(unit) + 1)))
        sums[0], scale = 1.0, 0
        for a in range(0, len(unit), BLOCK):
            head = max(0, a - self.reach)
            part = unit[head : a + BLOCK]
            size = len(part)
            _, to, start, weight, _, _ = self._edges([part])
            order = np.argsort(to, kind="stable")
            to, start, weight = to[order], start[order], weight[order]
            cuts = np.searchsorted(to, np.arange(size + 2)).tolist()
            start, weight = start.tolist(), weight.tolist()
            for j in range(a - head + 1, size + 1):
                total = 0.0
                for e in range(cuts[j], cuts[j + 1]):
                    i = head + start[e]
                    total += sums[i] * weight[e] if scales[i] == scale else sums[i] * weight[e] * HUGE ** (scale - scales[i])
                if total < TINY:
                    scale, total = scale + 1, total * HUGE
                sums[head + j], scales[head + j] = total, scale
        return sums, scales

    def sample(self, unit: str, stream: int) -> list[int]:
        """The ids of one sampled way through a unit of any length; stream: the key of its draws."""
        sums, scales = self.forward(unit)
        steps, j = [], len(unit)
        draws, k = [], 0
        while j:
            if k == len(draws):
                more = np.arange(k, k + 4096, dtype=np.uint64)
                draws += ((mix(np.uint64(stream) + more) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            edges = self._into(unit, j)
            shares = [sums[i] * w * HUGE ** (scales[j] - scales[i]) for i, _, w in edges]
            left, e = draws[k] * sum(shares), 0
            while e < len(edges) - 1 and left >= shares[e]:
                left -= shares[e]
                e += 1
            steps.append(edges[e][1])
            j, k = edges[e][0], k + 1
        return list(chain.from_iterable(reversed(steps)))

    def _spelling(self, char: str) -> int:
        """Where the byte pieces of a character without a piece are in `emitted`."""
        if char not in self.spellings:
            ids = [self.spelled[b] for b in char.encode()]
            self.spellings[char] = len(self.emitted)
            self.emitted = np.concatenate([self.emitted, np.array(ids, np.int32)])
        return self.spellings[char]

    def _edges(self, units: list[str]):
        """Edges of many units at once: (states of each unit, end state, start state, weight, where the ids are, how many)."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(size)
        place = np.arange(len(points)) - np.repeat(stop - size, size)  # in its unit
        left = np.repeat(size, size) - place  # characters up to the unit's end
        base = np.repeat(stop - size + np.arange(len(units)), size) + place  # the state before the character: a unit has one more than characters
        up, down = powers(len(points) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(points) * up[:-1], dtype=np.uint64)])
        parts = []
        for n in range(1, min(self.reach, int(size.max())) + 1):
            i = np.flatnonzero(left >= n)
            key = (sums[i + n] - sums[i]) * down[i]
            hit = self.sieve[key >> np.uint64(44)]
            k = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
            k = k[found := self.keys[k] == key[hit]]
            hit[hit] = found
            own = self.key_ids[k]
            parts.append((base[i[hit]] + n, base[i[hit]], self.key_weights[k], own, np.ones(len(own), np.int64)))
            if n == 1 and not hit.all():
                lone = i[~hit]
                chars = [chr(c) for c in points[lone].tolist()]
                at = np.array([self._spelling(c) for c in chars], np.int64)
                many = np.array([len(c.encode()) for c in chars], np.int64)
                parts.append((base[lone] + 1, base[lone], self.rare**many, at, many))
        to, start, weight, at, many = (np.concatenate(x) for x in zip(*parts))
        return size + 1, to, start, weight, at, many

    def _lattices(self, units: list[str]):
        """Edges of many short units with their shares of the draws: (states of each unit, end state, start state, share, emit_at, emit_n), by end state."""
        states, to, start, weight, at, many = self._edges(units)
        begin = np.cumsum(states) - states
        level = to - np.repeat(begin, states)[to]
        forward = np.zeros(int(states.sum()))
        forward[begin] = 1.0
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(1, int(states.max()) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = order[a:b]
            np.add.at(forward, to[e], forward[start[e]] * weight[e])
        order = np.lexsort((start, to))
        to, start, at, many, share = to[order], start[order], at[order], many[order], (forward[start] * weight / forward[to])[order]
        return states, to, start, share, at, many

    def _append(self, states, to, start, share, at, many):
        """Edges by end state, with states counted from 0, become the last ones of the table."""
        base, n = len(self.first_edge) - 1, int(states.sum())
        counts = np.bincount(to, minlength=n)
        stops = np.cumsum(counts)
        run = np.cumsum(share)
        run -= np.repeat(np.where(stops > counts, run[np.maximum(stops - counts, 1) - 1], 0.0), counts) if len(run) else 0
        run = np.minimum(run, 1.0)
        run[stops[counts > 0] - 1] = 1.0
        self.upto = np.concatenate([self.upto, base + to + run])
        self.before = np.concatenate([self.before, base + start])
        self.emit_at, self.emit_n = np.concatenate([self.emit_at, at]), np.concatenate([self.emit_n, many])
        self.first_edge = np.concatenate([self.first_edge, self.first_edge[-1] + stops])
        ends = base + np.cumsum(states)
        self.begin, self.end = np.concatenate([self.begin, ends - states]), np.concatenate([self.end, ends - 1])

    def _learn(self, units: list[str]):
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        for k in range(0, len(units), 50_000):
            self._append(*self._lattices(units[k : k + 50_000]))

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED):
        """(ids of all texts, ids of each text); keys: the rows' keys as unsigned 64-bit integers."""
        split = [UNITS.findall(t) for t in texts]
        units = list(chain.from_iterable(split))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        place = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stream = mix(np.repeat(mix(keys ^ np.uint64(seed)), sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        long = np.fromiter(map(len, units), np.int64, len(units)) > LONG
        if not long.any():
            ids, own = self._walk(units, stream)
        else:
            short, most = self._walk([u for u in units if len(u) <= LONG], stream[~long])
            ways = [np.array(self.sample(units[k], int(stream[k])), np.int32) for k in np.flatnonzero(long).tolist()]
            own = np.empty(len(units), np.int64)
            own[~long], own[long] = most, [len(w) for w in ways]
            ids = np.empty(int(own.sum()), np.int32)
            at = np.repeat(long, own)
            ids[~at], ids[at] = short, np.concatenate(ways)
        ends = np.concatenate([[0], np.cumsum(own)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

    def _walk(self, units: list[str], stream: np.ndarray):
        """(ids of all units, ids of each) of sampled ways through the lattices of short units, all at once."""
        fresh = [u for u in dict.fromkeys(units) if u not in self.at]
        if fresh and len(self.upto) > self.most:
            self._clear()
            fresh = list(dict.fromkeys(units))
        if fresh:
            self._learn(fresh)
        n = len(units)
        which = np.fromiter(map(self.at.__getitem__, units), np.int64, n)
        begin, state = self.begin[which], self.end[which]
        upto, before, emit_at, emit_n = self.upto, self.before, self.emit_at, self.emit_n
        steps, active, counts = [], np.arange(n), np.zeros(n, np.int64)
        k = 0
        while len(active):
            draw = (mix(stream[active] + np.uint64(k)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = state[active]
            first, last = self.first_edge[at], self.first_edge[at + 1] - 1
            edge = first.copy()
            many = last > first
            edge[many] = np.clip(np.searchsorted(upto, at[many] + draw[many], side="right"), first[many], last[many])
            counts[active] += 1
            steps.append((active, edge))
            state[active] = before[edge]
            active = active[state[active] != begin[active]]
            k += 1
        ends = np.cumsum(counts)
        path = np.empty(int(ends[-1]) if n else 0, np.int64)
        for k, (rows, edge) in enumerate(steps):
            path[ends[rows] - 1 - k] = edge
        many = emit_n[path]
        stops = np.cumsum(many)
        ids = self.emitted[np.repeat(emit_at[path] - (stops - many), many) + np.arange(int(stops[-1]) if len(stops) else 0)]
        return ids, np.diff(np.concatenate([[0], stops])[np.concatenate([[0], ends])])

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()


def _sample(model: str, alpha: float, seed: int, digest: bool):
    def run(batches):
        import pyarrow as pa

        coder = sampler(model, alpha)
        for batch in batches:
            docs = batch.column(0)
            keys = docs.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for a, texts in texts_of(batch.column(1), 1 << 21):
                n = len(texts)
                ids, counts = coder.encode(texts, keys[a : a + n], seed)
                if not digest:
                    yield pa.RecordBatch.from_arrays([docs.slice(a, n), list_column(ids, counts, pa.int32())], names=["doc_id", "ids"])
                    continue
                ends = np.cumsum(counts)
                own = [ids[e - c : e] for e, c in zip(ends, counts)]
                back = [coder.decode(x.tolist()) == t for x, t in zip(own, texts)]
                yield pa.RecordBatch.from_arrays([docs.slice(a, n), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts), pa.array([ids_crc32(x) for x in own], pa.int64()), pa.array(back)], names=["doc_id", "n_chars", "n_pieces", "ids_crc32", "lossless"])

    return run


def sample_pieces(docs: DataFrame, alpha: float = ALPHA, seed: int = SEED, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids) for every row; with digest, (doc_id, n_chars, n_pieces, ids_crc32, lossless: whether decoding gave the text back).

    Null texts are empty and have no pieces. A null id has a key of its own; rows that repeat an id draw alike. An empty
    table gives no rows; other columns are ignored. A very long text without a space takes memory of about 12 bytes a
    character besides itself and its ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(_sample(model, alpha, seed, digest)), "doc_id long, n_chars long, n_pieces long, ids_crc32 long, lossless boolean" if digest else "doc_id long, ids array<int>")


def decode_pieces(coded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null lists give null."""
    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        import pyarrow as pa

        coder = sampler(model, ALPHA)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


QUERIES = {"op6_piece_sampling": op6_piece_sampling}
ORACLES: dict[str, str] = {}
