"""SimHash near-duplicates by a binary trie joined with itself (operator 8).

Two fingerprints within d bits agree on at least one of d + 1 blocks of bits.  For each
block the fingerprints are rotated so that the block comes first; all that share it are
one node of a binary trie, and tasks hold whole nodes.  From these nodes pairs of nodes go
down the trie together, adding one for each differing bit; a pair is dropped as soon as
its sum exceeds d.  Pairs that reach the last bit are links.  Linked fingerprints are
then contracted to components by alternating star operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import documents, id_text, map_texts, stage

SHINGLE = 3
MAX_BITS = 2
SEED = 42
# Node pairs that one step down the trie handles at a time.
PAIRS_AT_ONCE = 500_000
# A node with more fingerprints is dealt out in parts, and each pair of parts is a task's work of its own.
NODE_ROWS = 100_000


# ---------------------------------------------------------------------------------
# Fingerprints
# ---------------------------------------------------------------------------------

def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; one is set where over half of the shingle hashes have it set.  No word: zero."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the blanks of the contract
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n - shingle + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)),
                         dtype=np.uint64, count=len(starts))
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # of a very long text some at a time
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""
    def make():
        def run(ids, texts):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            return {"doc_id": ids, "fp": fps.view(np.int64)}
        return run
    texts = id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_texts(texts, make, "doc_id long, fp long")


# ---------------------------------------------------------------------------------
# Trie join
# ---------------------------------------------------------------------------------

def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def join_nodes(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, depth: int, max_bits: int, same: bool):
    """Index pairs of ``left`` and ``right`` (both sorted) within ``max_bits``.

    ``nodes``: rows ``(a0, a1, b0, b1)``, ranges that agree on their first ``depth`` bits.
    ``same``: left and right are one array, and only pairs a < b are wanted.
    """
    todo = [(nodes[i:i + PAIRS_AT_ONCE], np.zeros(len(nodes[i:i + PAIRS_AT_ONCE]), dtype=np.int8), depth)
            for i in range(0, len(nodes), PAIRS_AT_ONCE)]
    while todo:
        ranges, used, d = todo.pop()
        a0, a1, b0, b1 = ranges.T
        size = (a1 - a0) * (b1 - b0)
        leaf = (size <= 64) | (d == 64)
        if leaf.any():
            yield from _compare(left, right, ranges[leaf], max_bits, same)
            ranges, used = ranges[~leaf], used[~leaf]
            a0, a1, b0, b1 = ranges.T
        if not len(ranges):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        high = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        am = np.clip(np.searchsorted(left, (left[a0] & high) | bit), a0, a1)
        bm = np.clip(np.searchsorted(right, (right[b0] & high) | bit), b0, b1)
        out, spent = [], []
        for (x0, x1), (y0, y1), cost in (((a0, am), (b0, bm), 0), ((am, a1), (bm, b1), 0),
                                         ((a0, am), (bm, b1), 1), ((am, a1), (b0, bm), 1)):
            ok = (x1 > x0) & (y1 > y0) & (used + cost <= max_bits)
            if same:
                ok &= x0 < y1 - 1  # else no a < b is left
                if cost and x0 is am:
                    ok &= a0 != b0  # the mirror of the pair before
            out.append(np.stack([x0, x1, y0, y1], axis=1)[ok])
            spent.append(used[ok] + np.int8(cost))
        ranges, used = np.concatenate(out), np.concatenate(spent)
        todo += [(ranges[i:i + PAIRS_AT_ONCE], used[i:i + PAIRS_AT_ONCE], d + 1)
                 for i in range(0, len(ranges), PAIRS_AT_ONCE)]


def _compare(left, right, ranges, max_bits, same, at_once: int = 20_000):
    """Compares the fingerprints of small node pairs."""
    for i in range(0, len(ranges), at_once):
        a0, a1, b0, b1 = ranges[i:i + at_once].T
        wide = b1 - b0
        size = (a1 - a0) * wide
        owner = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        a = a0[owner] + k // wide[owner]
        b = b0[owner] + k % wide[owner]
        hit = popcount(left[a] ^ right[b]) <= max_bits
        if same:
            hit &= a < b
        if hit.any():
            yield a[hit], b[hit]


def _rotate(fp, left: int):
    """The 64 bits rotated to the left (as a column)."""
    return fp if not left else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def links(fps: DataFrame, max_bits: int = MAX_BITS, forest: bool = False) -> DataFrame:
    """``(a, b)`` with a < b: ids of distinct fingerprints within ``max_bits`` bits.

    ``fps``: distinct ``(id, fp)``.  With ``forest``, each task returns no more links than
    hold its linked ids together, which keeps a large group from giving all its pairs.  Nodes of over ``NODE_ROWS`` fingerprints are dealt out
    in parts; each two parts meet in one task, so no task holds more than two parts.
    """
    blocks = max_bits + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    rotated = None
    for i in range(blocks):
        width = cuts[i + 1] - cuts[i]
        r = _rotate(F.col("fp"), cuts[i])
        part = fps.select("id", F.lit(i).alias("block"), F.lit(width).alias("width"), r.alias("rot"),
                          F.shiftrightunsigned(r, 64 - width).alias("node"))
        rotated = part if rotated is None else rotated.unionByName(part)
    crowded = (rotated.groupBy("block", "node").agg(F.count("*").alias("n")).where(F.col("n") > NODE_ROWS)
               .select("block", "node", F.ceil(F.col("n") / NODE_ROWS).cast("int").alias("parts")))
    dealt = (rotated.join(crowded, ["block", "node"], "left")
             .withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("rot"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("id", "rot", "width", "block", "node", "parts", "own",
                     F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    keys = ["block", "node", "lo", "hi"]
    ready = dealt.repartition(*keys).sortWithinPartitions(*keys, "own", F.expr("rot ^ (-9223372036854775807 - 1)"))

    def run(batches):
        kept = None  # rows of the last task's work, which may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            key = _keys(t)
            cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            kept = t.slice(cut).combine_chunks()
            if cut:
                yield from _join_table(t.slice(0, cut), key[:cut], max_bits, forest)
        if kept is not None and kept.num_rows:
            yield from _join_table(kept, _keys(kept), max_bits, forest)

    return ready.mapInArrow(run, "a long, b long").distinct()


def _keys(t: pa.Table) -> np.ndarray:
    """Equal numbers for rows of the same work; the rows come sorted, so neighbours tell."""
    new = np.zeros(t.num_rows, dtype=np.int64)
    for c in ("block", "node", "lo", "hi"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _join_table(t: pa.Table, key: np.ndarray, max_bits: int, forest: bool):
    """Joins complete works: all uncrowded nodes of a block at once, parts of crowded ones by two."""
    ids, rot = t.column("id").to_numpy(), t.column("rot").to_numpy().view(np.uint64)
    block, width, parts = (t.column(c).to_numpy() for c in ("block", "width", "parts"))
    for k in np.unique(block):
        rows = np.flatnonzero((block == k) & (parts == 1))
        if len(rows):
            first = np.flatnonzero(np.append(True, key[rows][1:] != key[rows][:-1]))
            last = np.append(first[1:], len(rows))
            many = last - first > 1
            nodes = np.stack([first, last, first, last], axis=1)[many]
            if len(nodes):
                seg = rot[rows]  # nodes ascend, and fingerprints within them
                yield from _emit(ids[rows], join_nodes(seg, seg, nodes, int(width[rows[0]]), max_bits, True), forest)
    rows = np.flatnonzero(parts > 1)
    if len(rows):
        own, lo, hi = (t.column(c).to_numpy() for c in ("own", "lo", "hi"))
        for work in np.split(rows, np.flatnonzero(np.diff(key[rows])) + 1):
            s, e, w = int(work[0]), int(work[-1]) + 1, int(width[work[0]])
            if lo[s] == hi[s]:
                node = np.array([[0, e - s, 0, e - s]])
                yield from _emit(ids[s:e], join_nodes(rot[s:e], rot[s:e], node, w, max_bits, True), forest)
            else:
                m = s + int(np.searchsorted(own[s:e], hi[s]))
                if s < m < e:
                    pairs = join_nodes(rot[s:m], rot[m:e], np.array([[0, m - s, 0, e - m]]), w, max_bits, False)
                    yield from _emit(ids[s:e], ((a, b + (m - s)) for a, b in pairs), forest)


def _emit(ids, pairs, forest: bool):
    """Link rows: every pair, or a spanning forest of them, at most one row an id."""
    if forest:
        root = np.arange(len(ids))
        for a, b in pairs:
            _unite(root, a, b)
        below = np.flatnonzero(root != np.arange(len(ids)))
        pairs = [(below, root[below])] if len(below) else []
    for a, b in pairs:
        x, y = ids[a], ids[b]
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of each a and b; ``root`` holds the smallest member of each set, before and after."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while len(a):
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


# ---------------------------------------------------------------------------------
# Components
# ---------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every id in ``edges (a, b)``: the smallest id it can reach.

    Alternating large-star and small-star steps: each id hands its neighbours to the
    smallest of them, until nothing changes.  Only counts reach the driver, each round is a
    written table, and minima are partially aggregated, so a hub is no single task's work.
    """
    e = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_least.select("u", F.col("m").alias("v"))))
        e = stage(small.where(F.col("u") != F.col("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)


# ---------------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------------

def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """One row a document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Words are runs without ASCII blanks, A-Z in lower case; texts of fewer words than a
    shingle hash as a whole; empty and null texts have fingerprint zero, which links like
    any other.  Documents with the same fingerprint are one vertex, so copies cost nothing.
    Rows with a null doc_id get a fingerprint and the component of their equals, but are
    no vertex (null where no other row shares the fingerprint).  Repeated rows each give a
    row; further columns are not looked at; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle))
    distinct = stage(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("id")))
    comp = components(links(distinct, max_bits, forest=True))
    of_print = (distinct.join(comp, "id", "left")
                .select("fp", F.least("id", F.coalesce("component_id", "id")).alias("component_id")))
    out = prints.join(of_print, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
