"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The lattice of a text has its character positions as nodes and a link for every vocabulary piece that fits
between two of them; a character that no piece holds is a chain of byte pieces. The forward pass sums the
weights of all paths to each node; the backward pass draws the last piece by its share of that sum, then the one
before it, and so on: an exact sample among all segmentations. A piece of rank r weighs (r H)^-alpha.

No piece spans the beginning of a run of blanks (checked when the vocabulary is loaded), so a text's
lattice is a row of independent small ones. The forward pass is made once for each different one a worker
meets; the backward draws of all occurrences in a batch go a step at a time, together.

A draw depends on the row's key, the place in the text and the step, and on nothing else: reruns, other
partitions and repeated rows with the same key give the same pieces.

Defined cases: null and empty texts have no pieces; a null key draws by the text; decoding returns the text
exactly (a null becomes empty); an empty table gives an empty result; further columns are carried by ``encode``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftline.llm.common import fresh, map_arrow

ALPHA = 1.0
SEED = 7
#: Links of lattices that a worker remembers, at 16 bytes each.
MEMORY = 4_000_000
#: Characters of the texts that are sampled together, and units that are filtered together.
BLOCK_CHARS = 1 << 20
BLOCK_UNITS = 1 << 13
UNIT = re.compile(r" *[^ ]+| +")
MARK = "▁"


class Grown:
    """A numpy array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            more = np.empty(max(n, 2 * len(self.data)), self.data.dtype)
            more[:self.n] = self.data[:self.n]
            self.data = more
        self.data[self.n:n] = values
        self.n = n


class Numbers(dict):
    """Numbers what it is asked for, in the order of first sight."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Lattices:
    """The vocabulary with its weights, and the forward-filtered lattices of the units met so far.

    States (nodes of the lattices) are numbered through all units. The links of state s begin at ``first[s]`` in
    ``upto`` (cumulative shares, long pieces first), ``piece`` and ``back`` (the state a link comes from, -1 at a
    unit's beginning). A unit is kept without the blank it begins with.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.surface: list[bytes] = [b""] * size
        self.ids: dict[str, int] = {}
        self.byte_id = np.full(256, -1)
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                text = piece.replace(MARK, " ")
                if text.strip(" ") and " " in text.lstrip(" "):
                    raise ValueError(f"piece {piece!r} spans units")
                self.ids[text] = i
                self.surface[i] = text.encode()
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.longest = max(map(len, self.ids))
        ranks = np.arange(1, size + 1, dtype=float)
        share = -alpha * (np.log(ranks) + np.log((1 / ranks).sum()))
        self.weight = np.full(size, share[-1])  # logarithmic
        order = sorted(self.ids.values())
        self.weight[order] = share[:len(order)]
        self._trie()
        self.clear()

    def _trie(self) -> None:
        """Transitions (node, character) -> node as a sorted array of keys; ``holds[node]`` is its piece or -1."""
        number, holds, moves = {"": 0}, [-1], {}
        for text, i in self.ids.items():
            for k in range(1, len(text) + 1):
                if text[:k] not in number:
                    number[text[:k]] = len(holds)
                    holds.append(-1)
                    moves[number[text[:k - 1]] << 21 | ord(text[k - 1])] = number[text[:k]]
            holds[number[text]] = i
        self.holds = np.array(holds)
        self.keys = np.array(sorted(moves), np.int64)
        self.child = np.array([moves[k] for k in self.keys.tolist()])

    def clear(self) -> None:
        self.numbers = Numbers()
        self.known = 0
        self.last, self.first = Grown(np.int64), Grown(np.int64)  # of a unit, its final state; of a state, its first link
        self.upto, self.piece, self.back = Grown(np.float64), Grown(np.int32), Grown(np.int32)

    def add(self, units: list[str]) -> None:
        """Forward filtering of units, all of them a position at a time; sums are logarithmic."""
        units = [" " + u for u in units]
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.array([len(u) for u in units])
        ends = np.cumsum(lens)
        stop = np.repeat(ends, lens)
        place = np.arange(len(chars)) - np.repeat(ends - lens, lens)
        starts, stops, pieces = [], [], []  # links over characters [start, stop)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for width in range(1, self.longest + 1):
            inside = at + width <= stop[at]
            at, node = at[inside], node[inside]
            key = node << 21 | chars[at + width - 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at, node = at[hit], self.child[k[hit]]
            full = self.holds[node] >= 0
            starts.append(at[full])
            stops.append(at[full] + width)
            pieces.append(self.holds[node[full]])
            if width == 1:
                bare = np.ones(len(chars), bool)
                bare[at[full]] = False
        weights = [self.weight[p] for p in pieces]
        base, n_states = self.first.n, len(chars)
        bare = np.nonzero(bare)[0]
        chain_piece, chain_back, come = [], [], {}
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[bare].tolist()]
        for p, bytes_ in zip(bare.tolist(), raw):  # characters that no piece holds: bytes, through states of their own
            before = base + p - 1 if place[p] else -1
            for x in bytes_[:-1]:
                chain_piece.append(self.byte_id[x])
                chain_back.append(before)
                before = base + n_states + len(chain_piece) - 1
            come[p] = before
        starts.append(bare)
        stops.append(bare + 1)
        pieces.append(self.byte_id[[x[-1] for x in raw]] if raw else np.zeros(0, np.int64))
        weights.append(np.array([self.weight[self.byte_id[list(x)]].sum() for x in raw]))
        start, end, piece, weight = (np.concatenate(x) for x in (starts, stops, pieces, weights))
        order = np.argsort(end * 64 - (end - start), kind="stable")  # by end, long links first
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        begin = np.concatenate([[0], np.nonzero(np.diff(end))[0] + 1])  # first link of each state
        count = np.diff(np.append(begin, len(end)))

        total = np.zeros(len(chars) + 1)  # logarithm of the sum of all paths that end before character p; by state
        share = np.empty(len(end))
        by_place = np.argsort(place, kind="stable")
        cuts = np.cumsum(np.bincount(place))
        for k, (lo, hi) in enumerate(zip(np.append(0, cuts[:-1]), cuts)):
            states = by_place[lo:hi]
            n = count[states]
            links = np.repeat(begin[states] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = start[links]
            path = weight[links] + np.where(place[own] > 0, total[own - 1], 0.0)
            group = np.cumsum(n) - n
            top = np.maximum.reduceat(path, group)
            part = np.exp(path - np.repeat(top, n))
            whole = np.add.reduceat(part, group)
            total[states] = top + np.log(whole)
            share[links] = part / np.repeat(whole, n)
        upto = np.cumsum(share)
        upto -= np.repeat(upto[begin] - share[begin], count)
        upto[begin + count - 1] = 2.0  # the last link takes what rounding leaves
        back = np.where(place[start] > 0, base + start - 1, -1)
        for p, before in come.items():
            link = begin[p] + count[p] - 1  # the shortest link is the last
            back[link] = before
        links = self.upto.n
        self.first.extend(np.concatenate([links + begin, links + len(end) + np.arange(len(chain_piece))]))
        self.upto.extend(np.concatenate([upto, np.full(len(chain_piece), 2.0)]))
        self.piece.extend(np.concatenate([piece, np.array(chain_piece, np.int64)]))
        self.back.extend(np.concatenate([back, np.array(chain_back, np.int64)]))
        self.last.extend(base + ends - 1)
        self.known += len(units)

    def sample(self, texts: Sequence[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts); some texts at a time."""
        ids, offsets, at, size, total = [], [np.zeros(1, np.int64)], 0, 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= BLOCK_CHARS or k + 1 == len(texts):
                part, ends = self._sample(texts[at:k + 1], keys[at:k + 1])
                ids.append(part)
                offsets.append(ends[1:] + total)
                at, size, total = k + 1, 0, total + len(part)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(offsets)

    def _sample(self, texts: Sequence[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.upto.n > MEMORY:
            self.clear()
        units = [units_of(t) for t in texts]
        counts = np.array([len(u) for u in units], np.int64)
        n = int(counts.sum())
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        unit = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(units)), np.int64, n)
        if len(self.numbers) > self.known:
            new = list(islice(self.numbers, self.known, None))
            for k in range(0, len(new), BLOCK_UNITS):
                self.add(new[k:k + BLOCK_UNITS])
        state = self.last.data[unit]
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = _mix(np.repeat(keys, counts) ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        first, upto, piece, back = self.first.data, self.upto.data, self.piece.data, self.back.data
        steps, who, found = np.zeros(n, np.int32), [], []
        active, step = np.arange(n), 0
        while len(active):
            u = (_mix(seed + np.uint64(step)) >> np.uint64(11)).astype(float) * 2.0 ** -53
            at = first[state]
            over = np.nonzero(u >= upto[at])[0]
            while len(over):
                at[over] += 1
                over = over[u[over] >= upto[at[over]]]
            who.append(active)
            found.append(piece[at])
            steps[active] += 1
            state = back[at]
            on = state >= 0
            active, state, seed = active[on], state[on], seed[on]
            step += 1
        ends = np.cumsum(steps, dtype=np.int64)
        out = np.empty(int(ends[-1]), np.int32)
        for k, (w, p) in enumerate(zip(who, found)):  # the k-th draw is the k-th piece from the end
            out[ends[w] - 1 - k] = p
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a segmentation: surfaces without the blank that was put before the text."""
        return b"".join([self.surface[i] for i in ids])[1:].decode()


def units_of(text: str | None) -> list[str]:
    """The runs of blanks with the word after them, of a blank and the text; each without its first blank."""
    if not text:
        return []
    units = text.split(" ")
    return units if all(units) else [u[1:] for u in UNIT.findall(" " + text)]


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64: a uniform 64-bit value from a counter."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_keys(keys: Sequence, texts: Sequence[str | None], seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(b"t" + (t or "").encode() if k is None else b"k" + str(k).encode(), seed)
                     for k, t in zip(keys, texts)], np.uint64)


_LATTICES: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float = ALPHA) -> Lattices:
    """One set of lattices for each worker, file and alpha."""
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattices(path, alpha)
    return _LATTICES[path, alpha]


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", out: str = "pieces",
           lossless: str | None = None, keep: Sequence[str] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The columns in ``keep`` (all), the sampled pieces as array<int>, and whether decoding them gives the text.

    A carried column that has the name of a result, in upper or lower case, is carried as ``own_`` and its name.
    """
    kept = [docs.schema[c] for c in (docs.columns if keep is None else keep)]
    results = {out.lower(), *([lossless.lower()] if lossless else [])}
    clash = [f.name for f in kept if f.name.lower() in results]
    carried = dict(zip(clash, fresh(docs, *[f"own_{c}" for c in clash])))
    names = [*[carried.get(f.name, f.name) for f in kept], out, *([lossless] if lossless else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(path, alpha)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            keys = row_keys(b.column(b.schema.get_field_index(key)).to_pylist(), texts, seed)
            ids, offsets = own.sample(texts, keys)
            cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            cols.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
            if lossless:
                cols.append(pa.array([own.decode(ids[a:z].tolist()) == (t or "") for t, a, z in zip(texts, offsets, offsets[1:])],
                                     pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = [*[T.StructField(carried.get(f.name, f.name), f.dataType) for f in kept], T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(lossless, T.BooleanType())] if lossless else [])]
    return map_arrow(docs, run, T.StructType(fields))


def decode(encoded: DataFrame, path: str, *, pieces: str = "pieces", out: str = "text", alpha: float = ALPHA) -> DataFrame:
    """The encoded rows with their text in the place of the pieces; null pieces give a null text."""
    kept = [f for f in encoded.schema.fields if f.name not in (pieces, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(path, alpha)
        for b in batches:
            ids = b.column(b.schema.get_field_index(pieces)).to_pylist()
            cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([None if i is None else own.decode(i) for i in ids], pa.string())],
                                             names=[*[f.name for f in kept], out])

    return map_arrow(encoded, run, T.StructType([*kept, T.StructField(out, T.StringType())]))
