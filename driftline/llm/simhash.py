"""SimHash near-duplicates: a self-join of fingerprints by a binary trie.

The 64-bit fingerprints, distinct ones only, are the leaves of a binary trie. Two of its nodes are visited
together, from the root with itself; going one bit down, the pair splits into four, of which two differ in that
bit. A pair whose differing bits exceed the limit is dropped with all below it.

The upper part of the trie, cut where a node holds at most ``NODE_ROWS`` fingerprints, is walked on the
driver, from counts by prefix. Each surviving pair of nodes is a task's work: it walks on in the two sorted
arrays, many pairs of ranges at a time, and returns for each fingerprint the least one it has reached, not
all pairs. No fingerprint has more than 2080 others within two bits, whatever the size of a group, since
equal fingerprints are one leaf. The stars of all tasks are joined to components by alternating star steps.

Defined cases: null, empty and blank texts have the fingerprint zero and are linked like any other; texts
of fewer words than a shingle are one shingle; rows with equal ids are rows of their own in the same
component; null ids take no part in the smallest id, which is null if all are null; an empty table gives an
empty result; further columns are carried where documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import fresh, join_checked, map_arrow, named, staged
from driftline.session import cut_lineage

BITS = 64
SHINGLE = 3
MAX_BITS = 2
SEED = 42

#: Fingerprints in a node that is one side of a task: so many, but a 16th of all at most, and never so few that
#: there would be over 2^MAX_NODE_BITS nodes.
NODE_ROWS = 1 << 15
MIN_NODES = 16
MAX_NODE_BITS = 12
#: Bits by which a node that holds too many is refined at a time.
STEP_BITS = 8
#: Text is hashed in blocks of about this many bytes, pairs of ranges are walked in blocks of this many.
BLOCK_BYTES = 1 << 20
BLOCK_PAIRS = 1 << 18
#: Pairs of ranges are compared one by one when the ranges have at most so many pairs.
LEAF_PAIRS = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text, unsigned; blocks end at blanks and share ``shingle - 1`` words."""
    from xxhash import xxh64_digest

    data = (text or b"").lower()  # of bytes: A-Z alone
    ones, n, carry, at = np.zeros(BITS, np.int64), 0, [], 0
    while at < len(data):
        end = at + BLOCK_BYTES
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = carry + data[at:end].split()
        at = end
        if len(words) < shingle and at < len(data):
            carry = words
            continue
        rows = zip(*[words[k:] for k in range(shingle)]) if len(words) >= shingle else [words] if words and not n else []
        digests = b"".join([xxh64_digest(b" ".join(r), SEED) for r in rows])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
        carry = words[len(words) - shingle + 1:] if shingle > 1 else []
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def with_fingerprints(docs: DataFrame, *, text: str = "text", out: str = "fp", shingle: int = SHINGLE,
                      keep_text: bool = True) -> DataFrame:
    """The documents with their fingerprint as a signed 64-bit integer."""
    keep = [f for f in docs.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).astype(np.int64)
            cols = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps)], names=[*[f.name for f in keep], out])

    return map_arrow(docs, run, T.StructType([*keep, T.StructField(out, T.LongType())]))


def upper_nodes(fps: DataFrame, rows: int) -> np.ndarray:
    """Starts (unsigned) and depths of the trie's nodes with at most ``rows`` fingerprints, or a single one.

    Counts by prefix come to the driver only for the nodes that still hold too many, ``STEP_BITS`` at a time.
    """
    n = fps.count()
    rows = max(1, min(rows, n // MIN_NODES), n >> MAX_NODE_BITS)
    done, heavy = [], [(0, 0)] if n > rows else []
    if not heavy:
        done = [(0, 0)]
    while heavy:
        depth = heavy[0][1]
        shift = BITS - depth - STEP_BITS
        prefix = F.expr(f"shiftrightunsigned(fp, {shift})")
        mine = fps if not depth else fps.where(F.expr(f"shiftrightunsigned(fp, {BITS - depth})").isin([p for p, _ in heavy]))
        counts = {r["p"]: r["n"] for r in mine.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        todo, heavy = heavy, []
        for p, _ in todo:
            stack = [(p, 0)]
            while stack:
                q, k = stack.pop()
                span = 1 << (STEP_BITS - k)
                held = sum(counts.get((q << (STEP_BITS - k)) + i, 0) for i in range(span)) if k else rows + 1
                if held <= rows:
                    done.append((q, depth + k))
                elif k < STEP_BITS:
                    stack += [(2 * q, k + 1), (2 * q + 1, k + 1)]
                elif depth + k < BITS:
                    heavy.append((q, depth + k))
                else:
                    done.append((q, depth + k))
    return np.array(sorted((p << (BITS - d) if d else 0, d) for p, d in done), dtype=object)


def node_pairs(nodes: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Pairs of upper nodes that fingerprints within ``max_bits`` can lie in, walked from the root."""
    starts, depths = [int(s) for s in nodes[:, 0]], [int(d) for d in nodes[:, 1]]
    leaf = {(s, d): i for i, (s, d) in enumerate(zip(starts, depths))}
    pairs, stack = set(), [((0, 0), (0, 0), 0)]
    while stack:
        a, b, err = stack.pop()
        if a in leaf and b in leaf:
            pairs.add((min(leaf[a], leaf[b]), max(leaf[a], leaf[b])))
            continue
        down_a = [a] if a in leaf else [(a[0], a[1] + 1), (a[0] | 1 << (BITS - 1 - a[1]), a[1] + 1)]
        down_b = [b] if b in leaf else [(b[0], b[1] + 1), (b[0] | 1 << (BITS - 1 - b[1]), b[1] + 1)]
        for x in down_a:
            for y in down_b:
                common = min(x[1], y[1])
                bits = ((x[0] ^ y[0]) >> (BITS - common)).bit_count() if common else 0
                if bits <= max_bits and (a != b or x <= y):
                    stack.append((x, y, bits))
    return sorted(pairs)


def _roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the trees of linked items; labels always point to smaller or equal items."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def walk(values: np.ndarray, split: int, same: bool, depth: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Labels of the values: the least index each one reaches by links between the two nodes.

    ``values[:split]`` and ``values[split:]`` are the sorted, distinct members of either node (one node with
    itself: ``same``, split at the end). ``depth``: bits that all members of a node share.
    """
    label = np.arange(len(values))
    left, right = values[:split], values if same else values[split:]
    base = 0 if same else split
    one = np.uint64(1)
    first = np.array([[0, len(left), 0, len(right), 0]])
    work = [(first, depth)] if len(left) and len(right) else []
    while work:
        rows, d = work.pop()
        while len(rows):
            if len(rows) > BLOCK_PAIRS:
                half = len(rows) // 2
                work.append((rows[half:], d))
                rows = rows[:half]
            al, ah, bl, bh, _ = rows.T
            n = (ah - al) * (bh - bl)
            small = (n <= LEAF_PAIRS) | (d >= BITS)
            if small.any():
                al, ah, bl, bh, n = (x[small] for x in (al, ah, bl, bh, n))
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(bh - bl, n)
                i, j = np.repeat(al, n) + k // wide, np.repeat(bl, n) + k % wide
                near = np.bitwise_count(left[i] ^ right[j]) <= max_bits
                if same:
                    near &= i < j
                if near.any():
                    label = _roots(label, i[near], j[near] + base)
                rows = rows[~small]
                if not len(rows):
                    break
                al, ah, bl, bh, _ = rows.T
            bit = one << np.uint64(BITS - 1 - d)
            clear = ~(bit | (bit - one))
            am = np.searchsorted(left, (left[al] & clear) | bit)
            bm = np.searchsorted(right, (right[bl] & clear) | bit)
            am, bm = np.clip(am, al, ah), np.clip(bm, bl, bh)
            err = rows[:, 4]
            more = err < max_bits
            mirror = more & ~((al == bl) & (ah == bh)) if same else more
            kids = [np.stack([al, am, bl, bm, err], 1), np.stack([am, ah, bm, bh, err], 1),
                    np.stack([al, am, bm, bh, err + 1], 1)[more], np.stack([am, ah, bl, bm, err + 1], 1)[mirror]]
            rows = np.concatenate(kids)
            rows = rows[(rows[:, 0] < rows[:, 1]) & (rows[:, 2] < rows[:, 3])]
            d += 1
    return label


def stars(fps: DataFrame, *, max_bits: int = MAX_BITS, rows: int = NODE_ROWS) -> DataFrame:
    """Links (u, v): fingerprint u reaches the smaller v; together they connect all within ``max_bits``."""
    nodes = upper_nodes(fps, rows)
    pairs = node_pairs(nodes, max_bits)
    starts, depths = np.array([int(s) for s in nodes[:, 0]], np.uint64), [int(d) for d in nodes[:, 1]]
    of_node: list[list[int]] = [[] for _ in depths]
    for k, (a, b) in enumerate(pairs):
        of_node[a].append(k)
        if b != a:
            of_node[b].append(k)
    counts = np.array([len(x) for x in of_node])
    flat, first = np.array([k for x in of_node for k in x], np.int64), np.cumsum(counts) - counts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            node = np.searchsorted(starts, fp.view(np.uint64), side="right") - 1
            n = counts[node]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(flat[np.repeat(first[node], n) + k]), pa.array(np.repeat(fp, n))], names=["pair", "fp"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        a, b = pairs[key[0].as_py()]
        fp = np.unique(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        split = len(fp) if a == b else int(np.searchsorted(fp, starts[b]))
        label = walk(fp, split, a == b, min(depths[a], depths[b]) if a == b else 0, max_bits)
        moved = label != np.arange(len(fp))
        return pa.table({"u": fp[moved].view(np.int64), "v": fp[label[moved]].view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "pair long, fp long")
    return dealt.groupBy("pair").applyInArrow(join, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """Component of every linked fingerprint: (fp, root), the root being its least member as signed integers.

    Alternating large-star and small-star steps until no link changes; each round is written to the shared
    checkpoint folder.
    """
    def rise(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def fall(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = mark(edges)
    while state[0]:
        edges = cut_lineage(fall(rise(edges)))
        now = mark(edges)
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("fp"), F.col("v").alias("root")))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def rooted(marked: DataFrame, *, max_bits: int = MAX_BITS, rows: int = NODE_ROWS) -> DataFrame:
    """(fp, root) of every distinct fingerprint in ``marked``."""
    fps = cut_lineage(marked.select("fp").distinct())
    found = components(stars(fps, max_bits=max_bits, rows=rows))
    return fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    slim = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    marked = cut_lineage(with_fingerprints(slim, shingle=shingle, keep_text=False))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    by_root = cut_lineage(least.join(rooted(marked, max_bits=max_bits, rows=rows), "fp"))
    smallest = by_root.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = by_root.join(smallest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS, rows: int = NODE_ROWS) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns.

    The documents are written once with a row number; whichever of the kept and the dropped rows are fewer
    are joined to them, broadcast only if few.
    """
    rid, fp = fresh(docs, "rid", "fp")
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    full = staged(with_fingerprints(numbered, text=text, out=fp, shingle=shingle), "simhash")
    marked = full.select(named(rid).alias("rid"), named(doc_id).alias("doc_id"), named(fp).alias("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("rid"))
    first = marked.groupBy("fp").agg(F.min(order).alias("o"))
    of_root = first.join(rooted(marked, max_bits=max_bits, rows=rows), "fp").groupBy("root").agg(F.min("o").alias("o"))
    kept_rid, dropped_rid = fresh(full, "kept_rid", "dropped_rid")
    kept = cut_lineage(of_root.select(F.col("o.rid").alias(kept_rid)))
    dropped = marked.join(kept, F.col("rid") == named(kept_rid), "left_anti").select(F.col("rid").alias(dropped_rid))
    if full.count() <= 2 * kept.count():
        dropped = cut_lineage(dropped)
        rest = join_checked(full, dropped, named(rid) == named(dropped_rid), "left_anti")
    else:
        rest = join_checked(full, kept, named(rid) == named(kept_rid), "left_semi")
    return rest.select(*[named(c) for c in docs.columns])
