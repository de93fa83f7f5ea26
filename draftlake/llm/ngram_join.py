"""N-gram Jaccard join by universe partition and pigeonhole, exact.

A text's set holds its distinct five-word shingles.  Two sets link when
``100 * intersection >= 75 * union``.  The steps:

1. One pass gives each text its set's size and digest.  Texts with one digest are one *node*.
2. Screen by pigeonhole: a set of size s with a partner has at most s // 4 elements of its
   own, so of any p elements at least p - s // 4 lie in another set too.  p = 0.3 s elements
   (the smallest hashes) are counted of each set, and a larger partner may count one fewer of the
   shared ones at a few sizes (SHORT); sets with too few shared ones cannot link.  The count
   is by hash bucket, each bucket small; a hash that many texts of one batch share is counted
   there and sent on twice only.
3. Join of what is left: sizes fall in bands.  For each band the universe of shingles is split
   by hash into m segments.  Every set indexes its own band's segments (the subset in each
   segment, and that subset without each one of its elements) and probes its own band and
   those below in reach.  If a pair differs in at most H elements and the probe's allowances
   v_i in {0, 1, 2} add up to H + 1 or more, some segment differs in at most v_i - 1
   elements.  The allowances go where they cost least, by signature counts in a sketch of
   fixed size; the index holds all, so a rough count costs time and never a link.
4. Each node is first checked, a few times, against one node of another component, the one that
   most of its signatures offer.  The checked links form components; only then are signatures
   expanded that still hold several components, and only across them.  A signature with few members on one
   side (FEW) gives its pairs; parities of the sets rule most of these out before the whole sets are joined.
   The members of all others meet by their differences (``by_differences``), so that neither copies nor
   near misses of one text ever make all their pairs.
5. Components by least-label propagation with short cuts, each round a written table.

Null and empty texts have size 0 and stand alone.  Repeated rows are kept, one result row
each; rows without id take part and give a null id.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import partitions, remove, save
from .sums import SUM_SCHEMA, sum_rows, summed

U = np.uint64
SKETCH = 1 << 19  # counters of the signature sketch, whatever the input
HOT = 4  # texts of one batch with one hash, above which the batch counts them itself
BROADCAST_ROWS = 500_000  # of node ids; above it the join shuffles
BAND = 1.25
EMPTY = 1e9  # cost of an empty subset: it comes last
SLICE = 2000  # rows that a task holds at once
HELD = 1 << 22  # bytes of whole sets that a task works on at once
#: Roles that each role meets, as bits: whole and reduced subsets of the index (0, 1), probes (2 to 4).
MEETS = np.array([0b11100, 0b01000, 0b00001, 0b00011, 0b00001], np.uint8)
TRIES = (1, 4, 8)  # nodes that each node is checked against, in turn, before signatures are expanded
LEAST_MARKS, MOST_MARKS = 512, 16384
FEW = 8  # pairs that a signature may give for each of its members
SALT = 16  # parts of a group that meet its base apart
VOTERS = 9  # members of a group whose sets give its base


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(W.mix(np.array([W.mix(s).sum(dtype=U) + U(len(s)) * U(0x9E3779B97F4A7C15)], U))[:1].view(np.int64)[0])


def screened(size: int) -> int:
    """How many of a set's elements are counted for the screen."""
    return min(size, (3 * size + 9) // 10 + 2)


def sure_hits(size: int, partner: int) -> int:
    """Counted elements of a set of this size that lie in the counted part of a linked set of the other size, at least."""
    both = -(-3 * (size + partner) // 7)
    return min(screened(size) - (size - both), screened(partner) - (partner - both))


def asked(size: int) -> int:
    """Hits that every set of this size with a partner has."""
    return min(sure_hits(size, t) for t in range(-(-3 * size // 4), 4 * size // 3 + 1))


#: Sizes at which a larger partner counts too few to ask for screened(size) - size // 4.  From size 99 on none is left:
#: a partner of size t counts 2 + 0.3 t - (4 t - 3 s) / 7 >= 2 + 0.06 s of the shared ones, the other side is at most 0.05 s + 3.65.
SHORT = {s: screened(s) - s // 4 - asked(s) for s in range(1, 99) if asked(s) < screened(s) - s // 4}


def band_of(size: int) -> int:
    b, low = 0, 1
    while size >= (high := band_end(low)):
        b, low = b + 1, high
    return b


def band_end(low: int) -> int:
    return max(low + 1, int(low * BAND))


def bands_for(size: int) -> list[tuple[int, int]]:
    """(band, its end) of the bands whose sets a set of this size probes: its own first, then those below in reach."""
    out, low, b = [], 1, 0
    while low <= size:
        high = band_end(low)
        if 4 * (high - 1) >= 3 * size:
            out.append((b, high))
        low, b = high, b + 1
    return out[::-1]


def segments(high: int) -> int:
    """Segments of the band that ends before high."""
    most = (high - 1 + 4 * (high - 1) // 3) // 7
    return max(1, (3 * (most + 1) + 3) // 4)


def signatures(s: np.ndarray, band: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-segment signatures (one a segment), then of each element: its segment and the signature without it."""
    m = segments(high)
    h = W.mix(s + U(band + 1) * U(0xD1342543DE82EF95))
    seg = (h >> U(33)) % U(m)
    order = np.argsort(seg, kind="stable")
    h, seg = h[order], seg[order].astype(np.int64)
    total = np.zeros(m, U)
    np.add.at(total, seg, h)
    salt = W.mix(np.arange(m, dtype=U) + U(band) * U(0x2545F4914F6CDD1D) + U(77))
    return W.mix(total ^ salt), seg, W.mix((total[seg] - h) ^ salt[seg])


def _cell(x: np.ndarray) -> np.ndarray:
    return (x & U(SKETCH - 1)).astype(np.int64)


_PACKED = "bucket int, keys binary, members binary, roles binary, nodes binary, sizes binary"


def _packed(key: np.ndarray, who: np.ndarray, role: np.ndarray, node: np.ndarray, size: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of key that has any: 32 bits of each key, its node's place in the row's own list, its role."""
    order = np.argsort(key)
    key, who, role = key[order], who[order], role[order]
    cut = np.searchsorted(key, np.arange(buckets, dtype=U) << U(65 - buckets.bit_length()))
    ends, rows = np.append(cut[1:], len(key)), {c: [] for c in ("bucket", "keys", "members", "roles", "nodes", "sizes")}
    low = (key >> U(64 - 31 - buckets.bit_length())).astype(np.uint32)
    for k in np.flatnonzero(ends > cut):
        part = slice(cut[k], ends[k])
        there, place = np.unique(who[part], return_inverse=True)
        for c, x in zip(rows, (k, low[part], place.astype(np.uint32), role[part].astype(np.uint8), node[there], size[there]), strict=True):
            rows[c].append(int(x) if c == "bucket" else x.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in rows.items()], names=list(rows))


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, node, size and role of all members of a bucket."""
    out = [[], [], [], []]
    for key, member, role, node, size in zip(*(table.column(c).to_pylist() for c in ("keys", "members", "roles", "nodes", "sizes")), strict=True):
        at = np.frombuffer(member, np.uint32)
        for o, x in zip(out, (np.frombuffer(key, np.uint32), np.frombuffer(node, np.int64)[at], np.frombuffer(size, np.int64)[at], np.frombuffer(role, np.uint8)), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def _pass_one(buckets: int, width: int, counted: Callable[[int], int]):
    """Rows of documents (doc_id, size, node), of hits counted at once (doc_id null, size the hits), and packed postings."""
    names = ["doc_id", "size", "node", "bucket", "keys", "members", "roles", "nodes", "sizes"]

    def plain(doc_id, size, node, bucket: int | None) -> pa.RecordBatch:
        n = len(node)
        first = [doc_id if doc_id is not None else pa.nulls(n, pa.int64()), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array([bucket] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(first + [pa.nulls(n, pa.binary())] * 5, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sizes, nodes, node, size, top = [], [], [], [], []
            seen = set()
            for s in W.shingle_sets(batch.column("text").to_pylist(), width):
                sizes.append(len(s))
                nodes.append(digest(s) if len(s) else None)
                if len(s) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    node.append(nodes[-1])
                    size.append(len(s))
                    top.append(s[: counted(len(s))].copy())
            yield plain(batch.column("doc_id").cast(pa.int64()), sizes, nodes, None)
            if top:
                # The screen takes the smallest hashes, so they are spread anew before they are dealt out.
                h, who = W.mix(np.concatenate(top)), np.repeat(np.arange(len(top)), [len(x) for x in top])
                order = np.argsort(h, kind="stable")
                h, who = h[order], who[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                count = np.diff(np.append(first, len(h)))
                own = (np.repeat(count, count) > HOT) & (np.arange(len(h)) - np.repeat(first, count) >= 2)
                node, size = np.array(node), np.array(size)
                if own.any():
                    there, hits = np.unique(who[own], return_counts=True)
                    yield plain(None, hits, node[there], -1)
                packed = _packed(h[~own], who[~own], np.zeros((~own).sum(), np.uint8), node, size, buckets)
                yield pa.RecordBatch.from_arrays([pa.nulls(packed.num_rows, pa.int64())] * 3 + packed.columns, names=names)

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket: how many of each node's hashes another node has too."""
    h, who, _, _ = _unpacked(table)
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])
    h, who = h[fresh], who[fresh]
    same = h[1:] == h[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    node, hits = np.unique(who[shared], return_counts=True)
    return pa.table({"node": pa.array(node, pa.int64()), "hits": pa.array(hits, pa.int64())})


def _node_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            wanted = batch.column("node").to_pylist()
            for at in range(0, len(wanted), 256):
                rows = [(digest(s), len(s), s.tobytes(), marks(s)) for s in W.shingle_sets(batch.column("text").slice(at, 256).to_pylist(), width)]
                rows = [r for r, node in zip(rows, wanted[at : at + 256], strict=True) if r[0] == node]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "size", "shingles", "mark"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of whole and of reduced signatures in the index, in two lines of SKETCH counters."""
    np.seterr(over="ignore")
    count = np.zeros(2 * SKETCH, np.int32)
    for batch in batches:
        for x in batch.column("shingles").to_pylist():
            s = np.frombuffer(x, U)
            own = bands_for(len(s))[0]
            whole, _, less = signatures(s, *own)
            np.add.at(count, _cell(whole), 1)
            np.add.at(count, SKETCH + _cell(less), 1)
    yield from sum_rows(count)


def allowances(whole: np.ndarray, seg: np.ndarray, less: np.ndarray, total: int, count: np.ndarray) -> np.ndarray:
    """v of each segment, adding up to total or all that there is, where the counts are least."""
    m = len(whole)
    size = np.bincount(seg, minlength=m)
    # Every set has empty subsets, and reduced ones of a single element are empty too.
    one = count[_cell(whole)] + EMPTY * (size == 0)
    two = count[SKETCH + _cell(whole)] + np.bincount(seg, count[_cell(less)] + 1.0, minlength=m) + 1.0 + EMPTY * (size <= 1)
    two = np.maximum(two, one)  # the second step of a segment never comes before its first
    cost = np.concatenate([one, two])
    best = np.lexsort((np.repeat([0, 1], m), cost))[: min(total, 2 * m)]
    return np.bincount(best % m, minlength=m)


def _signed(counts, buckets: int):
    """Packed signatures; role 0 and 1 index whole and reduced subsets, 2 to 4 probe them (2 and 3: whole, with allowance 1 and 2; 4: reduced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        count = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                node, size, sig, role, who = part.column("node").to_numpy(), [], [], [], []
                for k, x in enumerate(part.column("shingles").to_pylist()):
                    s = np.frombuffer(x, U)
                    size.append(len(s))
                    for own, (band, high) in enumerate(bands_for(len(s))):
                        whole, seg, less = signatures(s, band, high)
                        v = allowances(whole, seg, less, (min(high - 1, len(s)) + len(s)) // 7 + 1, count)
                        found = [(whole[v == 1], 2), (whole[v == 2], 3), (less[v[seg] == 2], 4)] + [(whole, 0), (less, 1)] * (own == 0)
                        for y, r in found:
                            sig.append(y)
                            role.append(np.full(len(y), r, np.uint8))
                            who.append(np.full(len(y), k, np.uint32))
                if sig:
                    yield _packed(np.concatenate(sig), np.concatenate(who), np.concatenate(role), node, np.array(size), buckets)

    return run


def _groups(table: pa.Table) -> pa.Table:
    """Of one bucket: the members of signatures with two nodes or more, an index and a probe.

    Signatures with the same members in the same roles give one group, named by its members.
    """
    np.seterr(over="ignore")
    sig, node, size, role = _unpacked(table)
    order = np.lexsort((role, node, sig))
    sig, node, size, role = sig[order], node[order], size[order], role[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]) | (role[1:] != role[:-1])])
    sig, node, size, role = sig[fresh], node[fresh], size[fresh], role[fresh]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    roles = np.repeat(np.bitwise_or.reduceat(np.left_shift(np.uint8(1), role), first), np.diff(np.append(first, len(sig))))
    met = (roles & MEETS[role]) > 0
    sig, node, size, role = sig[met], node[met], size[met], role[met]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
    count = np.diff(np.append(first, len(sig)))
    meet = np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first) if len(sig) else np.zeros(0, bool)
    name = np.add.reduceat(W.mix(W.mix(node.view(U)) + role.astype(U)), first) if len(sig) else np.zeros(0, U)
    once = np.zeros(len(first), bool)
    once[np.flatnonzero(meet)[np.unique(name[meet], return_index=True)[1]]] = True
    keep = np.repeat(once, count)
    _, of, times = np.unique(name, return_inverse=True, return_counts=True)
    weight = np.repeat(times[of], count)[keep]
    return pa.table({"sig": pa.array(np.repeat(name, count)[keep].view(np.int64)), "node": pa.array(node[keep]), "size": pa.array(size[keep]), "role": pa.array(role[keep].astype(np.int32)), "weight": pa.array(weight)})


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about HELD bytes."""
    for batch in batches:
        rows = max(1, batch.num_rows * HELD // max(HELD, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _light(batches):
            keep = []
            for x, y in zip(batch.column("left_set").to_pylist(), batch.column("right_set").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def marks(s: np.ndarray) -> bytes:
    """Parities of a set, as many as its size up to a power of two: two sets differ in at least as many elements as these do in bits."""
    bits = min(MOST_MARKS, max(LEAST_MARKS, 1 << (len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s >> U(40)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(data: list[bytes], size: int) -> np.ndarray:
    """Marks as rows of size bytes; longer ones are folded, which keeps their parities."""
    rows = np.frombuffer(b"".join(data), np.uint64).reshape(len(data), -1, size // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def _near_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(c).to_pylist() for c in ("left_mark", "right_mark"))
        lengths = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
        differ = np.zeros(len(left), np.int64)
        for m, n in np.unique(lengths, axis=0).tolist():
            at = np.flatnonzero((lengths == (m, n)).all(axis=1))
            x, y = (_folded([side[k] for k in at], min(m, n)) for side in (left, right))
            differ[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        most = (batch.column("left_size").to_numpy() + batch.column("right_size").to_numpy()) // 7
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(differ <= most, pa.bool_()))


def near_marks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose marks do not rule a link out; spares the join with whole sets."""
    for node, side in (("a", "left"), ("b", "right")):
        pairs = pairs.join(sets.select(F.col("node").alias(node), F.col("mark").alias(f"{side}_mark"), F.col("size").alias(f"{side}_size")), node)
    return pairs.select("a", "b", "left_mark", "right_mark", "left_size", "right_size").mapInArrow(_near_marks, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set")), "b")
    return both.select("a", "b", "left_set", "right_set").mapInArrow(_verified(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): each node of edges (a, b) with the least node that it reaches."""
    both = save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        step = save(step.join(jump, "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("next")), "label")
        moved = step.filter("next <> comp").limit(1).count()
        label = step.select("node", F.col("next").alias("comp"))
        if not moved:
            return label


def _role_ok(index: str, probe: str):
    """A reduced subset of one side meets a whole one of the other, and never a reduced one."""
    return ((F.col(index) == 0) & F.col(probe).isin(2, 3, 4)) | ((F.col(index) == 1) & (F.col(probe) == 3))


def _near_sizes(x: str, y: str):
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def linked_nodes(sets: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of sets (node, size, shingles) that have a link."""
    spark = sets.sparkSession
    count = summed(sets.select("shingles").mapInArrow(_sketch, SUM_SCHEMA), (2 * SKETCH,), np.int32)
    buckets = 1 << max(4, (partitions(spark) - 1).bit_length())
    packed = sets.select("node", "shingles").mapInArrow(_signed(spark.sparkContext.broadcast(count), buckets), _PACKED)
    groups = packed.groupBy("bucket").applyInArrow(_groups, "sig long, node long, size long, role int, weight long")
    met = save(groups.groupBy("sig", "node", "size", "role").agg(F.sum("weight").alias("weight")), "groups")
    tried = links = None
    comp = sets.select("node", F.col("node").alias("comp"))
    for turn, tries in enumerate(TRIES):
        pairs = best_pairs(met.join(comp, "node"), turn, tries)
        pairs = save(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "pairs")
        found = save(verify(pairs, sets), "links")
        tried, links = (tried.union(pairs), links.union(found)) if tried else (pairs, found)
        comp = sets.select("node").join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Signatures that still hold more than one component.
    named = met.join(comp, "node")
    sides = [F.count_if(F.col("role") <= 1).alias("n_index"), F.count_if(F.col("role") >= 2).alias("n_probe")]
    mixed = named.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *sides).filter("low < high")
    few = F.col("n_index") * F.col("n_probe") <= FEW * (F.col("n_index") + F.col("n_probe"))
    open_rows = save(named.join(mixed.select("sig", few.alias("few")), "sig"), "open")
    i, p = open_rows.filter("few AND role <= 1"), open_rows.filter("few AND role >= 2")
    i = i.select("sig", *(F.col(c).alias(f"i_{c}") for c in ("node", "size", "role", "comp")))
    more = i.join(p, "sig").filter((F.col("i_comp") != F.col("comp")) & _role_ok("i_role", "role") & _near_sizes("i_size", "size"))
    more = more.select(F.least("node", "i_node").alias("a"), F.greatest("node", "i_node").alias("b")).distinct()
    more = save(near_marks(more.join(tried, ["a", "b"], "left_anti"), sets), "pairs")
    links = links.union(save(verify(more, sets), "links"))
    return by_differences(grouped(open_rows.filter("NOT few")), sets, links)


def grouped(rows: DataFrame) -> DataFrame:
    """(g, node): the nodes of rows (sig, node, comp) in groups, one for each component that has most nodes of a signature."""
    most = rows.groupBy("sig", "comp").agg(F.countDistinct("node").alias("n")).groupBy("sig").agg(F.max_by("comp", F.struct("n", "comp")).alias("g"))
    return rows.select("sig", "node").join(most, "sig").select("g", "node").distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the elements of each group occur in a run of rows."""
    for batch in _light(batches):
        g, sets = batch.column("g").to_numpy(), batch.column("shingles").to_pylist()
        for at in np.unique(g):
            element, n = np.unique(np.concatenate([np.frombuffer(sets[k], np.int64) for k in np.flatnonzero(g == at)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), at)), pa.array(element), pa.array(n)], names=["g", "element", "n"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements in which each set differs from its group's base, in one row with their number."""
    for part in _light(batches):
        base, ends = part.column("base").flatten().to_numpy(), np.concatenate([[0], part.column("base").value_lengths().fill_null(0).to_numpy().cumsum()])
        apart = [np.setxor1d(np.frombuffer(x, np.int64), base[ends[k] : ends[k + 1]]) for k, x in enumerate(part.column("shingles").to_pylist())]
        columns = [part.column(c) for c in ("g", "node", "size")] + [pa.array([len(x) for x in apart], pa.int64()), pa.array([x.tobytes() for x in apart], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "node", "size", "e", "apart"])


def _apart(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (g, apart): the elements of all, the row of each, and the cell of each in the sketch of its group's elements."""
    rows = [np.frombuffer(x, U) for x in part.column("apart").to_pylist()]
    element, row = np.concatenate([np.zeros(0, U), *rows]), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    return element, row, _cell(W.mix(element ^ W.mix(part.column("g").to_numpy().view(U))[row]))


def _apart_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many differences of one group hold an element of each cell."""
    np.seterr(over="ignore")
    count = np.zeros(SKETCH, np.int32)
    for part in _light(batches):
        np.add.at(count, _apart(part)[2], 1)
    yield from sum_rows(count)


def _posted(counts):
    """Of each set's differences, from rare to common, the first (long) with their places (i), without those that no other set of the group holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        count = counts.value
        for part in _light(batches):
            element, row, cell = _apart(part)
            n = count[cell]
            order = np.lexsort((element, n, row))
            place = np.arange(len(row)) - np.searchsorted(row, row) + 1
            keep = (n[order] > 1) & (place <= part.column("long").to_numpy()[row])
            rows = part.drop_columns(["apart", "long"]).take(pa.array(row[keep]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(element[order][keep].view(np.int64)), pa.array(place[keep])], names=[*rows.schema.names, "element", "i"])

    return run


def by_differences(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int = 75, near: Callable[[DataFrame, DataFrame], DataFrame] = near_marks) -> DataFrame:
    """(node, comp) of all nodes with a link: components of links and of all links between members (g, node) of one group.

    Sets link whose differences are at most the sum of their sizes times p / q = (100 - percent) / (100 + percent).
    A group's base holds the elements of more than half of VOTERS of its sets; any base would give the same links, a good one
    leaves short differences.  All members are compared with it.  Let E be the elements in which a set
    differs from the base, and its slack q |E| less p times its size.  Sets x and y differ in |Ex| + |Ey| - 2 o elements, where o
    is how many of them Ex and Ey share, so:

    - if their slacks add up to 0 or less they link, and both link with the set of least slack, which makes one
      component of all such pairs;
    - other links share o >= (slack of x + slack of y) / 2q > 0 elements of E.  Sorted by rarity, a shared element is
      among the first |E| - o + 1 of each.  Sets linked with that of least slack (near ones) need only meet
      the others (far ones), so the o of each side is known from the least slack on the other side.

    Rarity is by counts in a sketch of fixed size; a rough count costs time and never a link.  A set's E travels in one row; only
    the elements by which it may meet others become rows, and none in groups without far sets.
    """
    p, q = (x // math.gcd(100 - percent, 100 + percent) for x in (100 - percent, 100 + percent))
    members = save(members, "members")
    with_sets = members.join(sets.select("node", "size", "shingles"), "node")
    voice = Window.partitionBy("g").orderBy(F.xxhash64("node"), "node")
    voters = save(members.withColumn("place", F.row_number().over(voice)).filter(F.col("place") <= VOTERS).select("g", "node"), "voters")
    total = voters.groupBy("g").agg(F.count(F.lit(1)).alias("total"))
    count = voters.join(sets.select("node", "shingles"), "node").select("g", "shingles").mapInArrow(_counted, "g long, element long, n long").groupBy("g", "element").agg(F.sum("n").alias("n"))
    core = save(count.filter("n > 1").join(total, "g").filter("2 * n > total").select("g", "element"), "core")
    base = core.groupBy("g").agg(F.collect_list("element").alias("base"))  # fewer than twice a set's elements
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    salted = with_sets.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(base.withColumn("salt", salts), ["g", "salt"], "left")
    apart = save(salted.select("g", "node", "size", "shingles", "base").mapInArrow(_differences, "g long, node long, size long, e long, apart binary"), "differences")
    known = apart.select("g", "node", "size", "e", (q * F.col("e") - p * F.col("size")).alias("slack"))
    least = known.groupBy("g").agg(F.min(F.struct("slack", "node")).alias("least")).select("g", F.col("least.slack").alias("low"), F.col("least.node").alias("centre"))
    known = save(known.join(least, "g").withColumn("far", F.col("slack") + F.col("low") > 0), "slacks")
    star = known.filter("NOT far AND node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    links = links.union(star)
    comp = components(links)

    far_low = known.filter("far").groupBy("g").agg(F.min("slack").alias("far_low"))
    known = known.join(far_low, "g").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = lambda low: F.col("e") - F.ceil((F.col("slack") + F.col(low)) / (2 * q)) + 1
    known = known.select("g", "node", "size", "comp", "e", "slack", "far", first("far_low").cast("long").alias("short"), F.when(F.col("far"), first("low")).otherwise(first("far_low")).cast("long").alias("long"))
    # Elements of one E only are its rarest; they have their places in it but are in no other, so only their number counts.
    counts = sets.sparkSession.sparkContext.broadcast(summed(apart.select("g", "apart").mapInArrow(_apart_counts, SUM_SCHEMA), (SKETCH,), np.int32))
    columns = "g long, node long, size long, comp long, e long, slack long, far boolean, short long"
    posted = save(known.join(apart.select("g", "node", "apart"), ["g", "node"]).mapInArrow(_posted(counts), f"{columns}, element long, i long"), "posted")
    need = F.ceil((F.col("x.slack") + F.col("y.slack")) / (2 * q))
    reach = F.least(F.col("x.e") - F.col("x.i"), F.col("y.e") - F.col("y.i")) + 1 >= need
    either = (~F.col("y.far")) | ((F.col("x.i") <= F.col("x.short")) & (F.col("y.i") <= F.col("y.short")) & (F.col("x.node") < F.col("y.node")))
    met = posted.filter("far").alias("x").join(posted.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.element") == F.col("y.element")))
    met = met.filter((F.col("x.comp") != F.col("y.comp")) & either & reach & (need <= F.least("x.e", "y.e")) & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")))
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = save(near(pairs, sets), "pairs")
    return components(links.union(save(verify(pairs, sets, percent), "links")))


def best_pairs(members: DataFrame, turn: int, tries: int) -> DataFrame:
    """For each node pairs (a, b) with the nodes of other components that most of its signatures offer.

    A signature offers one member each of the least and of the greatest component in the index,
    the least node in turn 0 and any other in later ones.
    """
    at = F.struct("comp", (F.xxhash64("node", "sig", F.lit(turn)) if turn else F.col("node")).alias("order"), "node")
    ends = [f(F.when(F.col("role") == role, at)).alias(name) for role, kind in ((0, "whole"), (1, "less")) for f, name in ((F.min, f"{kind}_low"), (F.max, f"{kind}_high"))]
    offered = members.filter("role >= 2").join(members.groupBy("sig").agg(*ends), "sig")

    def other(kind: str):
        low, high = F.col(f"{kind}_low"), F.col(f"{kind}_high")
        return F.when(low["comp"] != F.col("comp"), low["node"]).when(high["comp"] != F.col("comp"), high["node"]).alias("other")

    probes = offered.select("node", "weight", other("whole")).union(offered.filter("role = 3").select("node", "weight", other("less")))
    shared = probes.filter("other IS NOT NULL").groupBy("node", "other").agg(F.sum("weight").alias("n"))
    most = Window.partitionBy("node").orderBy(F.desc("n"), "other")
    best = shared.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= tries)
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def least_hits(size: Column) -> Column:
    """asked() of a set's size."""
    fewer = F.coalesce(F.create_map(*(F.lit(x).cast("long") for pair in SHORT.items() for x in pair))[size], F.lit(0))
    counted = F.least(size, F.floor((3 * size + 9) / 10).cast("long") + 2)
    return counted - F.floor(size / 4) - fewer


def screened_sets(docs: DataFrame, width: int, counted: Callable[[int], int], least: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (doc_id, text): each row's set (doc_id, size, node), each node (node, first, size, n_copies), and whole sets
    (node, size, shingles, mark) of the nodes of which at least least(size) of the counted(size) smallest hashes lie in other sets too."""
    spark = docs.sparkSession
    buckets = 1 << max(8, (4 * partitions(spark) - 1).bit_length())
    passed = save(docs.mapInArrow(_pass_one(buckets, width, counted), f"doc_id long, size long, node long, {_PACKED}"), "postings", "lz4")
    rows = save(passed.filter("bucket IS NULL").select("doc_id", "size", "node"), "sets")
    hits = passed.filter("bucket >= 0").drop("doc_id", "size", "node").groupBy("bucket").applyInArrow(_count_bucket, "node long, hits long")
    hits = hits.union(passed.filter("bucket = -1").select("node", F.col("size").alias("hits"))).groupBy("node").agg(F.sum("hits").alias("hits"))
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n_copies"))
    nodes = save(nodes, "nodes")
    kept = save(nodes.join(hits, "node").filter(F.col("hits") >= least(F.col("size"))).select("node", "first"), "kept")
    for path in {f.rsplit("/", 1)[0] for f in passed.inputFiles()}:
        remove(spark, path)
    n = kept.count()
    wanted = kept.select("node", F.col("first").alias("doc_id"))
    wanted = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    sets = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "text").mapInArrow(_node_sets(width), "node long, size long, shingles binary, mark binary")
    return rows, nodes, save(sets.dropDuplicates(["node"]), "node_sets")


def with_components(rows: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies of each row, from the components (node, comp) of nodes."""
    named = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = named.join(least, "comp").select("node", "component_id", "n_copies")
    found = rows.join(named, "node", "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reached by links, own included), n_copies (rows with the same set)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, nodes, sets = screened_sets(docs, 5, screened, least_hits)
    return with_components(rows, nodes, linked_nodes(sets))
