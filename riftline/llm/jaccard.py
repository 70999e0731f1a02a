"""Exact n-gram Jaccard join by metric-space partitioning.

Distances between texts crowd near 1, where a pivot that is itself a text tells
nothing; so pivots of three kinds are used, each with its triangle inequality.

1. Rings around the empty set. In the symmetric-difference metric a set's
   distance to the empty set is its size, and a link needs |A| >= t |B|: sets are
   cut into rings of sizes, and a set near the upper border of its ring is
   replicated into the next one (its window).
2. Projections. Inside a ring a linked pair differs in at most d elements. The
   universe is cut into d + 1 parts by hash; on one part at least the pair's
   projections coincide, at distance 0. The projections that occur are the
   pivots, and the sets projected on a pivot are its Voronoi region. Empty
   projections tell nothing: with d + 1 + e parts at least 1 + e coincide, so a
   set with e empty ones at most can leave them out; the empty parts of others
   are refined by a second partition of the whole universe, and so on
   recursively.
   Regions of the same sets count once. Inside a region, the parities of hash
   classes, some one for each element, bound the symmetric difference from below
   (an element of it changes one parity) and cut off pairs that can't link; what
   remains gives clusters, and every link lies inside one.
3. Clusters. Here pivots are documents. A cluster that outgrows a block is cut by
   rounds of the plan: some of its sets are pivots, and sets within the link radius
   r of a pivot are linked to it. Pivots that share such a set have one region, of
   the sets linked to them, which need not be compared with each other any more.
   A set x outside is replicated into a region (its window) if it is within 2 r of
   one of the region's pivots p: for y in the region d(x, y) <= r and d(y, p) <= r
   give d(x, p) <= 2 r. What no pivot reaches is left for the next round, with
   pivots of its own, until it fits a block; so a group of near copies costs its
   size times the pivots, and not its square. Where a round reaches few sets, what
   is left is a loose crowd, and its sets are compared inside the regions of step 2
   that they share.
   Inside a block each set belongs to the region of its nearest pivot, and is
   replicated to region j while d(x, p_j) <= d(x, p_nearest) + 2 r, without which
   no set of region j can be within r. Regions are joined recursively; small ones
   by counting common shingles of all their pairs.

Equal sets are one point throughout. What still outgrows a block is cut into
blocks, and each pair of blocks is a task; a task returns a spanning forest of
the links it found, never all pairs. Components of the forests' union are the
components of all links.

Map tasks combine: of the sets of one task that fall into the same region only
one travels to find further members elsewhere, so a hot region costs a row per
task.

Defined results: null, empty and blank texts have no shingles, are linked with
nothing and are their own component; a text of fewer words than a shingle is one
shingle of all its words; equal texts (and texts with equal shingle sets) share a
component at once; rows that repeat an id share its smallest component; an empty
table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import with_maybe
from .components import components
from .words import mix64, shingle_sets
from .workspace import Scratch, fresh, keyed, release_shuffles, stage

#: Hash classes of a sketch: a power of two from the first to the last of these, not below the set's size up to there.
CLASSES = (64, 1 << 15)
RING = 1.25
DEPTH = 12
LEAST_PERCENT = 80
#: Signatures combined in a map task before they are sent on.
COMBINE = 1_000_000
BLOCK = 512
BLOCK_SHINGLES = 1_500_000
LEAF = 192
PIVOTS = 8
#: Pivots of a cluster in a round of the plan, and rounds before what is left is cut into blocks.
ROUND_PIVOTS, ROUNDS = 24, 3

U = np.uint64


class Threshold:
    """A link: 100 |A and B| >= percent |A or B|."""

    def __init__(self, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            # below, parts hold so few elements that refining the empty ones doesn't end
            raise ValueError(f"similarities of {LEAST_PERCENT} to 100 percent are supported, not {percent}")
        self.percent = percent
        # Some twice the share of parts that the smallest sets of a ring leave empty.
        self.spare = 2.2 * np.exp(-percent / 100 * (100 + percent) / (2 * RING * (100 - percent))) + 0.01 if percent < 100 else 0.0
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RING)))
        self.edges = np.array(edges)

    def most_apart(self, total):
        """The largest symmetric difference of a linked pair whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def may_link(self, apart, a, b):
        """Whether sets of ``a`` and ``b`` elements can be linked that differ in ``apart`` or more."""
        return np.maximum(apart, np.abs(a - b)) <= self.most_apart(a + b)

    def linked(self, common, a, b):
        return (100 + self.percent) * common >= self.percent * (a + b)

    def rings(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, ring): each set's own ring and those its partners can be in above it."""
        own = np.searchsorted(self.edges, sizes, "right") - 1
        last = np.searchsorted(self.edges, sizes * 100 // self.percent, "right") - 1
        rows = np.repeat(np.arange(len(sizes)), last - own + 1)
        first = np.cumsum(last - own + 1) - (last - own + 1)
        return rows, own[rows] + np.arange(len(rows)) - first[rows]


def signatures(sizes: np.ndarray, h: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): equal for two linked sets at least once, unless the sets are equal."""
    begin = np.cumsum(sizes) - sizes
    rows, ring = threshold.rings(sizes)
    parts = threshold.most_apart(2 * (threshold.edges[ring + 1] - 1)) + 1
    real = (parts > 1) & (sizes[rows] > 0)  # with one part only equal sets link
    spare = np.ceil(parts * threshold.spare - 0.3).astype(np.int64)
    parts = parts + spare
    spare = spare[real]
    rows, parts, prefix = rows[real], parts[real], mix64(ring[real].astype(np.uint64) + U(77))
    out_rows, out_sig = [], []
    for depth in range(DEPTH):
        if not len(rows):
            break
        # in runs, as each set is expanded once for each of its rings or poor parts
        again = []
        cost = np.cumsum(sizes[rows] + parts)
        cuts = np.searchsorted(cost, np.arange(0, cost[-1], 1_000_000)[1:])
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
            if lo == hi:
                continue
            r, m, p, e = rows[lo:hi], parts[lo:hi], prefix[lo:hi], spare[lo:hi]
            n = sizes[r]
            job = np.repeat(np.arange(len(r)), n)
            x = h[np.arange(len(job)) - (np.cumsum(n) - n)[job] + begin[r][job]]
            salted = mix64(x ^ U((0x51ED27 + 0x9E3779B97F4A7C15 * (depth + 1)) & (2**64 - 1)))
            base = np.cumsum(m) - m
            cell = base[job] + ((salted >> U(32)) * m[job].astype(np.uint64) >> U(32)).astype(np.int64)
            total = int(m.sum())
            count = np.bincount(cell, minlength=total)
            order = np.argsort(cell, kind="stable")
            sums = np.zeros(total, np.uint64)
            filled = np.flatnonzero(count)
            if len(filled):
                sums[filled] = np.add.reduceat(salted[order] * U(0xD6E8FEB86659FD93), np.cumsum(count)[filled] - count[filled])
            of = np.repeat(np.arange(len(r)), m)
            sig = mix64(mix64(sums + count.astype(np.uint64)) + p[of] + (np.arange(total) - base[of]).astype(np.uint64) * U(0x9E3779B97F4A7C15))
            empty = count == 0
            refine = empty & (np.add.reduceat(empty.astype(np.int64), base) > e)[of]
            send = ~empty if depth < DEPTH - 1 else ~empty | refine
            out_rows.append(r[of[send]])
            out_sig.append(sig[send])
            of = of[refine]
            again.append((r[of], m[of], sig[refine], e[of]))
        rows, parts, prefix, spare = (np.concatenate(x) for x in zip(*again)) if again else (rows[:0],) * 4
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out_sig)


def set_ids(sizes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set, in two halves."""
    halves, filled = [], np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[filled]
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        out = np.zeros(len(sizes), np.uint64)
        if len(filled):
            out[filled] = np.add.reduceat(mix64(h ^ U(salt)), begin)
        halves.append(mix64(out + sizes.astype(np.uint64)))
    return halves[0], halves[1]


def sketches(sizes: np.ndarray, h: np.ndarray) -> pa.Array:
    """The parities of a set's hash classes, as bits: as many differ as elements differ, or fewer."""
    classes = np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), *CLASSES)
    begin = np.cumsum(classes) - classes
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = (mix64(h ^ U(0xA0761D6478BD642F)) >> U(40)).astype(np.int64) & (classes[row] - 1)
    bits = np.packbits((np.bincount(begin[row] + place, minlength=int(classes.sum())) & 1).astype(np.uint8), bitorder="little")
    ends = np.concatenate([[0], np.cumsum(classes // 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(bits)])


class Parities:
    """Sketches of a column. Those of fewer classes are the others' with classes added up."""

    def __init__(self, column):
        rows = column.to_pylist()
        self.words = np.frombuffer(b"".join(rows), np.uint64)
        self.length = np.array([len(x) // 8 for x in rows], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """A row of ``width`` words for each of ``rows``, none of which has fewer."""
        out = np.empty((len(rows), width), np.uint64)
        for n in np.unique(self.length[rows]):
            at = np.flatnonzero(self.length[rows] == n)
            words = self.words[self.begin[rows[at]][:, None] + np.arange(n)]
            out[at] = np.bitwise_xor.reduce(words.reshape(len(at), -1, width), axis=1)
        return out

    def pairs_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of rows a number not above their sets' symmetric difference."""
        out, width = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        for w in np.unique(width):
            k = np.flatnonzero(width == w)
            out[k] = np.bitwise_count(self.folded(a[k], w) ^ self.folded(b[k], w)).sum(1)
        return out

    def among(self, lo: int, hi: int):
        """(i, others) -> the same for rows of ``lo`` .. ``hi``, counted from ``lo``."""
        rows = self.folded(np.arange(lo, hi), int(self.length[lo:hi].min()))
        return lambda i, others: np.bitwise_count(rows[i] ^ rows[others]).sum(1).astype(np.int64)


def binary(rows: np.ndarray) -> pa.Array:
    """A row of a 2-d byte array to a value."""
    width = rows.shape[1]
    flat = np.ascontiguousarray(rows).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.py_buffer(flat)])


PROFILE = "kind int, doc_id long, n long, h long, sid binary, sketch binary, bucket int, blob binary"
PROFILE_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("sid", pa.binary()), ("sketch", pa.binary()), ("bucket", pa.int32()), ("blob", pa.binary())])
#: Kinds of rows: a document; signatures of a bucket, as (signature, set) pairs; members of regions already known to have two.
DOC, SIGS, MULTI = 0, 1, 2


def profile_batch(kind: int, size: int, **cols) -> pa.RecordBatch:
    arrays = [pa.array(np.full(size, kind, np.int32)) if f.name == "kind" else cols.get(f.name, pa.nulls(size, f.type)) for f in PROFILE_ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=PROFILE_ARROW)


def pairs_blob(pairs: np.ndarray) -> bytes:
    """(signature, set) pairs in some 8 bytes each: 48 bits of the signature, which with the
    bucket tell enough of them apart (a chance agreement only adds a pair to be refuted), and
    the set's place in a list."""
    names, place = np.unique(pairs[:, 1], return_inverse=True)
    wide = len(names) > 1 << 16
    low, high = pairs[:, 0].astype(np.uint32), (pairs[:, 0] >> U(32)).astype(np.uint16)
    head = np.array([len(pairs), len(names), wide], "<i8")
    return b"".join(x.tobytes() for x in (head, names, low, high, place.astype(np.uint32 if wide else np.uint16)))


def read_pairs(blob: bytes) -> np.ndarray:
    n, k, wide = np.frombuffer(blob, "<i8", 3)
    at, out = 24, np.empty((n, 2), np.uint64)
    names = np.frombuffer(blob, np.uint64, k, at)
    at += 8 * k
    low = np.frombuffer(blob, np.uint32, n, at)
    high = np.frombuffer(blob, np.uint16, n, at + 4 * n)
    out[:, 0] = low | high.astype(np.uint64) << U(32)
    out[:, 1] = names[np.frombuffer(blob, np.uint32 if wide else np.uint16, n, at + 6 * n)]
    return out


def region_key(sig: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return mix64((sig & U((1 << 48) - 1)) + bucket * U(0x9E3779B97F4A7C15)).view(np.int64)


def split_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From distinct (signature, set) pairs: (one pair of each signature, the pairs of signatures that have several)."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if len(pairs):
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:, 0] != pairs[:-1, 0]
    many = ~first
    many[:-1] |= ~first[1:]
    return pairs[first], pairs[many]


def profiles(docs: DataFrame, width: int, percent: int, buckets: int, id_col: str, text_col: str, sets: bool) -> DataFrame:
    """The documents with their sets' names and sketches (``sets``), or their signatures.

    The two are read at different times; hashing the texts twice costs less than a written copy of all signatures.
    """
    threshold = Threshold(percent)

    def batches(it):
        held, count = [], 0

        def flush():
            one, many = split_pairs(np.concatenate(held))
            where = (one[:, 0] >> U(48)) % U(buckets)
            order = np.argsort(where, kind="stable")
            one, borders = one[order], np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(borders))
            blobs = [pairs_blob(one[borders[b] : borders[b + 1]]) for b in used]
            yield profile_batch(SIGS, len(used), bucket=pa.array(used.astype(np.int32)), blob=pa.array(blobs, pa.binary()))
            # h: the set; n: the signature
            yield profile_batch(MULTI, len(many), h=pa.array(many[:, 1].view(np.int64)), n=pa.array(region_key(many[:, 0], (many[:, 0] >> U(48)) % U(buckets))))

        for batch in it:
            for first, sizes, h in shingle_sets(batch.column(1), width):
                a, b = set_ids(sizes, h)
                if sets:
                    sid = np.stack([a, b], 1).view(np.uint8)
                    ids = batch.column(0).slice(first, len(sizes))
                    yield profile_batch(DOC, len(sizes), doc_id=ids, n=pa.array(sizes), h=pa.array(a.view(np.int64)), sid=binary(sid), sketch=sketches(sizes, h))
                    continue
                rows, sig = signatures(sizes, h, threshold)
                held.append(np.stack([sig, a[rows]], 1))
                count += len(sig)
                if count >= COMBINE:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, PROFILE)


def shared_signatures(it):
    """(bucket, blob, sig, h) by bucket -> members of regions: those known to have two, and those of which several tasks sent one."""
    held, bucket = [], None

    def flush():
        _, many = split_pairs(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(region_key(many[:, 0], np.full(len(many), bucket, np.uint64))), pa.array(many[:, 1].view(np.int64))], ["sig", "h"])

    for batch in it:
        known = batch.column(1).is_null()
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(known) for k in (2, 3)], ["sig", "h"])
        batch = batch.filter(pc.invert(known))
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and b != bucket:
                yield flush()
                held = []
            bucket = b
            held.append(read_pairs(blob.as_py()))
    if held:
        yield flush()


def whole_groups(it, keys: int):
    """Batches sorted by their first ``keys`` columns -> (table, borders of its groups), each group whole."""
    rest = None
    for batch in it:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        change = np.zeros(max(0, len(table) - 1), bool)
        for k in range(keys):
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        borders = np.concatenate([[0], np.flatnonzero(change) + 1])
        last = int(borders[-1])
        if last:
            yield table.slice(0, last), borders
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def forest(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0..n-1; ``near(i, others)`` says which of ``others`` are linked to ``i``."""
    label, out = np.arange(n), []
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(others):
            for j in others[near(i, others)]:
                if label[j] != label[i]:
                    out.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return out


def region_forests(threshold: Threshold):
    """(sig, i, j, h, n, sketch), sorted by the first three -> (a, b): forests of pairs that may link, by their sketches."""

    def batches(it):
        for table, borders in whole_groups(it, 3):
            h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
            parities, sizes = Parities(table.column("sketch")), np.diff(borders)
            a = borders[:-1][sizes == 2]
            a = a[(h[a] != h[a + 1]) & threshold.may_link(parities.pairs_apart(a, a + 1), n[a], n[a + 1])]
            left, right = [h[a]], [h[a + 1]]
            for k in np.flatnonzero(sizes > 2):
                s, apart = borders[k], parities.among(int(borders[k]), int(borders[k] + sizes[k]))
                own = forest(int(sizes[k]), lambda i, others, s=s, apart=apart: threshold.may_link(apart(i, others), n[s + i], n[s + others]))
                if own:
                    pairs = s + np.array(own)
                    left.append(h[pairs[:, 0]])
                    right.append(h[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return batches


def region_groups(threshold: Threshold):
    """(sig, i, j, h, n, sketch), sorted by the first three -> (cluster, h): inside each region, the sets that may link, under their least name.

    A set's regions hold much the same sets; by their least one they fall together.
    """

    def batches(it):
        for table, borders in whole_groups(it, 3):
            h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
            parities = Parities(table.column("sketch"))
            names, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(borders[:-1], borders[1:]):
                if hi - lo < 2:
                    continue

                def may(i, j, lo=lo, apart=parities.among(int(lo), int(hi))):
                    return threshold.may_link(apart(i, j), n[lo + i], n[lo + j])

                label = np.arange(hi - lo)
                for i, j in forest(hi - lo, may):
                    label[label == label[j]] = label[i]
                _, label, size = np.unique(label, return_inverse=True, return_counts=True)
                least = np.full(len(size), np.iinfo(np.int64).max)
                np.minimum.at(least, label, h[lo:hi])
                keep = size[label] > 1
                names.append(least[label[keep]])
                sets.append(h[lo:hi][keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(sets))], ["cluster", "h"])

    return batches


class Metric:
    """The links among a few sets: rows of ``sizes``, shingles one after another in ``h``."""

    def __init__(self, sizes: np.ndarray, h: np.ndarray, threshold: Threshold, leaf: int = LEAF):
        self.sizes, self.threshold, self.leaf = sizes, threshold, leaf
        self.begin = np.cumsum(sizes) - sizes
        self.radius = 1 - threshold.percent / 100
        self.names, self.ids = np.unique(h, return_inverse=True)
        self.label = np.arange(len(sizes))
        self.edges: list[tuple[int, int]] = []

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.begin[i] : self.begin[i] + self.sizes[i]]

    def link(self, i: int, j: int):
        if self.label[i] != self.label[j]:
            self.edges.append((i, j))
            self.label[self.label == self.label[j]] = self.label[i]

    def common(self, i: int, members: np.ndarray) -> np.ndarray:
        """How many elements each member shares with set ``i``."""
        mark = np.zeros(len(self.names), np.int32)
        mark[self.of(i)] = 1
        take, row = self.ragged(members)
        return np.bincount(row, mark[take], len(members)).astype(np.int64)

    def ragged(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[members]
        row = np.repeat(np.arange(len(members)), n)
        return self.ids[np.arange(len(row)) - (np.cumsum(n) - n)[row] + self.begin[members][row]], row

    def join(self, members: np.ndarray):
        if len(members) < 2:
            return
        if len(np.unique(self.label[members])) == 1:
            return
        if len(members) <= self.leaf:
            return self.pairs(members)
        # Pivots spread over the members; distances to each, and the links found on the way.
        pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
        d = np.empty((len(members), len(pivots)))
        for k, p in enumerate(pivots):
            c = self.common(int(p), members)
            a, b = self.sizes[members], self.sizes[p]
            d[:, k] = 1 - c / (a + b - c)
            for j in members[self.threshold.linked(c, a, b)]:
                self.link(int(p), int(j))
        nearest = d.min(1)
        owner = d.argmin(1)
        for k in range(len(pivots)):
            window = (owner == k) | (d[:, k] <= nearest + 2 * self.radius + 1e-9)
            if not (owner == k).any():
                continue
            region = members[window]
            # a region that isn't smaller gains nothing from more pivots
            (self.join if len(region) <= 0.7 * len(members) else self.pairs)(region)
            if len(region) == len(members):
                break

    def pairs(self, members: np.ndarray):
        """All pairs of a region, by common elements: a product of incidence matrices, some columns at a time."""
        ids, row = self.ragged(members)
        seen, col, df = np.unique(ids, return_inverse=True, return_counts=True)
        keep = df[col] > 1
        rank = np.cumsum(df > 1) - 1
        col, row = rank[col[keep]], row[keep]
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        n, width = len(members), 2048
        both = np.zeros((n, n), np.float32)
        for a in range(0, int((df > 1).sum()), width):
            lo, hi = np.searchsorted(col, (a, a + width))
            x = np.zeros((n, width), np.float32)
            x[row[lo:hi], col[lo:hi] - a] = 1
            both += x @ x.T
        s = self.sizes[members]
        ok = self.threshold.linked(both.astype(np.int64), s[:, None], s[None, :])
        for i, j in zip(*np.nonzero(np.triu(ok, 1))):
            self.link(int(members[i]), int(members[j]))


def whole_sets(texts: pa.Array, wanted: np.ndarray, width: int):
    """(sizes, shingles, name halves, rows to use): one row of each set, and only rows whose text is the set that was asked for."""
    runs = list(shingle_sets(texts, width))
    sizes, h = np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs])
    a, b = set_ids(sizes, h)
    _, once = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
    once = np.sort(once)
    return sizes, h, np.stack([a, b], 1), once[a[once].view(np.int64) == wanted[once]]


def cluster_links(threshold: Threshold, width: int, leaf: int):
    """(cluster, i, j, h, text), sorted by the first three -> (a, b): forests of the links, by set names."""

    def batches(it):
        for table, borders in whole_groups(it, 3):
            texts = table.column("text").combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            wanted = table.column("h").to_numpy()
            for lo, hi in zip(borders[:-1], borders[1:]):
                if hi - lo < 2:
                    continue
                sizes, h, names, once = whole_sets(texts.slice(lo, hi - lo), wanted[lo:hi], width)
                metric = Metric(sizes, h, threshold, leaf)
                metric.join(once[np.argsort(sizes[once], kind="stable")])
                if metric.edges:
                    pair = np.array(metric.edges)
                    sid = names.view(np.uint8)
                    yield pa.RecordBatch.from_arrays([binary(sid[pair[:, 0]]), binary(sid[pair[:, 1]])], ["a", "b"])

    return batches


NEAR = "cluster long, h long, n long, text string, name binary, linked array<int>, window array<int>, pivots array<binary>"


def pivot_distances(threshold: Threshold, width: int):
    """(cluster, salt, k, h, n, text), sorted by the first three, with pivots (k >= 0) before the others of a group.

    -> every set with its name, the pivots it is linked to (with their names), and those within twice the radius.
    """

    def batches(it):
        for table, borders in whole_groups(it, 2):
            texts = table.column("text").combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            wanted, number = table.column("h").to_numpy(), table.column("k").to_numpy()
            for lo, hi in zip(borders[:-1], borders[1:]):
                part = table.slice(lo, hi - lo)
                runs = list(shingle_sets(texts.slice(lo, hi - lo), width))
                sizes, h = np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs])
                a, b = set_ids(sizes, h)
                right = a.view(np.int64) == wanted[lo:hi]
                pivots = np.flatnonzero((number[lo:hi] < SET) & right)
                members = np.flatnonzero((number[lo:hi] == SET) & right)
                if not len(members):
                    continue
                metric = Metric(sizes, h, threshold)
                common = np.stack([metric.common(int(p), members) for p in pivots]) if len(pivots) else np.zeros((0, len(members)), np.int64)
                total = sizes[members][None, :] + sizes[pivots][:, None]
                linked = threshold.linked(common, total, 0)
                # 1 - J <= 2 r in integers: 100 J >= 100 - 2 (100 - percent)
                window = 100 * common >= (2 * threshold.percent - 100) * (total - common)
                names = np.stack([a, b], 1)
                ks = number[lo:hi][pivots]
                sid = [bytes(x) for x in names[pivots].view(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("cluster").combine_chunks().take(pa.array(members)),
                        pa.array(wanted[lo:hi][members]),
                        pa.array(sizes[members]),
                        texts.slice(lo, hi - lo).take(pa.array(members)),
                        binary(names[members].view(np.uint8)),
                        pa.array([ks[x].tolist() for x in linked.T], pa.list_(pa.int32())),
                        pa.array([ks[x].tolist() for x in window.T], pa.list_(pa.int32())),
                        pa.array([[sid[p] for p in np.flatnonzero(x)] for x in linked.T], pa.list_(pa.binary())),
                    ],
                    ["cluster", "h", "n", "text", "name", "linked", "window", "pivots"],
                )

    return batches


#: Numbers a set that isn't a pivot, after all pivots.
SET = 1 << 20


def split_by_pivots(rows: DataFrame, counts: DataFrame, threshold: Threshold, width: int, block: int, turn: int, scratch: Scratch):
    """One round on clusters that outgrow a block: (sets no pivot reaches, rows of tasks, pairs of linked names).

    ``rows``: cluster, h, n, text; ``counts``: cluster, _blocks.
    """
    salted = rows.join(counts, "cluster")
    # the least name of each of so many hash classes: as good as drawn sets
    draw = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(ROUND_PIVOTS)).cast("int").alias("k")
    chosen = salted.groupBy("cluster", draw).agg(F.min("h").alias("h"))
    pivots = salted.join(chosen, ["cluster", "h"]).dropDuplicates(["cluster", "h"])
    pivots = pivots.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("salt"), "k", "h", "n", "text")
    members = salted.select("cluster", F.pmod(F.xxhash64("h"), F.col("_blocks")).alias("salt"), F.lit(SET).alias("k"), "h", "n", "text")
    both = pivots.unionByName(members).repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "k", "h")
    near = scratch.stage(both.mapInArrow(pivot_distances(threshold, width), NEAR), "jaccard-pivots")

    # pivots that share a linked set are one region, named by the smallest of them: few rows, pairs of neighbours in a list
    pairs = near.where("size(linked) > 1").select("cluster", F.explode(F.expr("transform(sequence(1, size(linked) - 1), i -> struct(linked[i - 1] as p, linked[i] as q))")).alias("e"))
    pairs = pairs.select("cluster", "e.*").distinct()
    to_name = lambda c: F.struct("cluster", c)
    region = components(pairs.select(to_name(F.col("p").alias("k")).alias("a"), to_name(F.col("q").alias("k")).alias("b")), scratch)
    region = region.select("node.cluster", F.col("node.k").alias("k"), F.col("component.k").alias("region"))
    regions = region.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("k", "region"))).alias("_m"))  # a pivot a row
    near = near.join(regions, "cluster", "left")
    of = lambda c: F.array_distinct(F.transform(c, lambda k: F.coalesce(F.try_element_at(F.col("_m"), k), k)))
    near = near.withColumn("_own", F.get(of("linked"), F.lit(0))).withColumn("_seen", of("window"))

    open_sets = near.where("_own is null").select("cluster", "h", "n", "text")
    visits = near.withColumn("region", F.explode("_seen")).where("_own is null or region <> _own").select("cluster", "h", "n", "text", "region")
    homes = near.where("_own is not null").select("cluster", "h", "n", "text", F.col("_own").alias("region"))
    size = F.greatest(F.ceil(F.count("*") / (block // 2 + 1)), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = lambda df, name: df.groupBy("cluster", "region").agg(size.alias(name))
    met = sizes(visits, "_v").join(sizes(homes, "_o"), ["cluster", "region"])
    met = scratch.stage(met, "jaccard-visits")
    key = F.xxhash64("cluster", "region", F.lit(turn))

    def tasks(df, own, other, first):
        mine = F.pmod(F.xxhash64("h"), F.col(own))
        df = df.join(met, ["cluster", "region"]).withColumn("_mine", mine).withColumn("_theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        i, j = ("_mine", "_theirs") if first else ("_theirs", "_mine")
        return df.select(key.alias("cluster"), F.col(i).alias("i"), F.col(j).alias("j"), "h", "text")

    found = tasks(homes, "_o", "_v", True).unionByName(tasks(visits, "_v", "_o", False))
    links = near.select(F.col("name").alias("a"), F.explode("pivots").alias("b")).where("a <> b")
    return open_sets, found, links


def in_blocks(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``i``, ``j``: for each pair of blocks of its key's rows, those of the two. ``counts``: key, _blocks."""
    rows = rows.join(counts, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("h"), F.col("_blocks"))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return rows.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_blocks", "_own", "_other")


def regions_of(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Members of signatures' regions (sig, h) with their sketches, sorted by region and pair of blocks."""
    hot = members.groupBy("sig").count().where(F.col("count") > block).select("sig", F.ceil(F.col("count") / block).alias("_blocks"))
    regions = in_blocks(members, hot, "sig").join(sets.select("h", "n", "sketch"), "h").select("sig", "i", "j", "h", "n", "sketch")
    return regions.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "h")


def distinct_regions(members: DataFrame) -> DataFrame:
    """(sig, h) with one region for all that hold the same sets: texts that share a passage share many parts.

    A region is named by its sets; two that agree by chance are only compared as one.
    """
    whole = members.groupBy("sig").agg(F.bit_xor(F.xxhash64("h")).alias("_sets"), F.count("*").alias("_n")).where("_n > 1")
    return members.join(whole, "sig").select(F.xxhash64("_sets", "_n").alias("sig"), "h").distinct()


def cluster_components(docs: DataFrame, clusters: DataFrame, members: DataFrame, sets: DataFrame, threshold: Threshold, width: int, id_col: str, text_col: str, scratch: Scratch, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """node, component (set names) of the sets linked inside clusters. ``clusters``: cluster, h, n, _doc; ``members``: sig, h."""
    size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    large = lambda df: df.groupBy("cluster").agg(size.alias("_blocks"), F.count("*").alias("_size")).where("_blocks > 1")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # few texts are in clusters: the filter keeps most others out of the shuffle, and the join settles the rest
    texts = with_maybe(texts, F.col("_id"), clusters, "_doc").where("_maybe").drop("_maybe")
    # One plan at every size: the texts meet their clusters by a sort-merge join, which moves each text once.
    rows = texts.join(clusters.hint("merge"), F.col("_id").eqNullSafe(F.col("_doc"))).select("cluster", "h", "n", "text")
    rows = scratch.stage(rows, "jaccard-texts")
    release_shuffles(scratch.spark)
    whole = lambda df: df.select("cluster", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "h", "text")
    hot = scratch.stage(large(rows), "jaccard-large")
    tasks, links = whole(rows.join(hot, "cluster", "left_anti")), None
    # a group of near copies shows as a region larger than a block; a loose crowd has none, and pivots would reach few of it
    crowded = members.groupBy("sig").count().where(F.col("count") > block).select("sig")
    dense = members.join(crowded, "sig", "left_semi").select("h").distinct().join(clusters.select("h", "cluster"), "h").select("cluster").distinct()
    dense = scratch.stage(dense, "jaccard-dense")
    stuck = rows.join(hot.join(dense, "cluster", "left_anti"), "cluster", "left_semi")
    hot = scratch.stage(hot.join(dense, "cluster", "left_semi"), "jaccard-large")
    left = rows.join(hot, "cluster", "left_semi")
    for turn in range(ROUNDS):
        if hot.isEmpty():
            break
        left, found, pairs = split_by_pivots(left, hot.drop("_size"), threshold, width, block, turn, scratch)
        left = scratch.stage(left, "jaccard-left")
        tasks = tasks.unionByName(found)
        links = pairs if links is None else links.unionByName(pairs)
        now = large(left)
        tasks = tasks.unionByName(whole(left.join(now, "cluster", "left_anti")))
        # where pivots reach few sets, more of them gain nothing
        shrinks = F.col("now._size") <= 0.8 * F.col("was._size")
        now = scratch.stage(now.alias("now").join(hot.alias("was"), "cluster").select("cluster", "now._blocks", "now._size", shrinks.alias("_go")), "jaccard-large")
        over = left.join(now.where("not _go") if turn + 1 < ROUNDS else now, "cluster", "left_semi")
        stuck = stuck.unionByName(over)
        hot = scratch.stage(now.where("_go").drop("_go"), "jaccard-large")
        left = left.join(hot, "cluster", "left_semi")
    # sets far from all pivots can link only inside the regions they share with each other
    stuck = scratch.stage(stuck, "jaccard-stuck")
    inner = regions_of(members.join(stuck.select("h").distinct(), "h").select("sig", "h"), sets, block)
    inner = scratch.stage(inner.mapInArrow(region_groups(threshold), "cluster long, h long").distinct(), "jaccard-groups")
    release_shuffles(scratch.spark)
    inner = inner.join(stuck.select("h", "n", "text"), "h")
    tasks = tasks.unionByName(in_blocks(inner, large(inner).drop("_size"), "cluster").select("cluster", "i", "j", "h", "text"))
    tasks = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "h")
    found = tasks.mapInArrow(cluster_links(threshold, width, leaf), "a binary, b binary")
    return components(found if links is None else found.unionByName(links), scratch)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``. ``block``: sets compared in a task; ``leaf``: sets compared without pivots."""
    spark = docs.sparkSession
    threshold = Threshold(percent)
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch = Scratch(spark)
    made = lambda sets: profiles(docs, width, percent, buckets, id_col, text_col, sets)
    rows = scratch.stage(made(True).select("doc_id", "n", "h", "sid", "sketch"), "jaccard-sets")
    sets = rows.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("n", "sketch")).alias("s")).select("h", "doc_id", "s.n", "s.sketch")

    sent = made(False).select(F.coalesce("bucket", F.pmod("n", F.lit(buckets)).cast("int")).alias("bucket"), "blob", F.col("n").alias("sig"), "h")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    shared = scratch.stage(sent.mapInArrow(shared_signatures, "sig long, h long").distinct(), "jaccard-regions")
    release_shuffles(spark)
    members = scratch.stage(distinct_regions(shared), "jaccard-regions")
    scratch.drop(shared)
    release_shuffles(spark)
    near = components(regions_of(members, sets, block).mapInArrow(region_forests(threshold), "a long, b long"), scratch)

    clusters = near.select(F.col("node").alias("h"), F.col("component").alias("cluster"))
    clusters = scratch.stage(clusters.join(sets.select("h", "n", F.col("doc_id").alias("_doc")), "h"), "jaccard-clusters")
    scratch.drop(near)
    labels = cluster_components(docs, clusters, members, sets, threshold, width, id_col, text_col, scratch, block, leaf)

    # sets without links are their own class
    named = rows.join(labels, F.col("sid") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "sid").alias("_class"))
    named = stage(named, "jaccard-named")
    scratch.clear()
    # written, so that a hot class can be split in the join that follows
    least = stage(named.where("n > 0").groupBy("_class").agg(F.min("doc_id").alias("_least")), "jaccard-least")
    out = named.join(least, "_class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, any one of equal ids. Blank texts all stay."""
    rows, row = keyed(docs, "jaccard-rows")
    scratch = Scratch(docs.sparkSession)
    found = jaccard_components(rows, width, percent, row, text_col)
    # the join goes by row, as ids may be null or repeated
    ids = rows.select(F.col(row).alias("doc_id"), F.col(id_col).cast("long").alias("_id"))
    found = scratch.stage(found.join(ids, "doc_id").select("doc_id", "component_id", "_id"), "jaccard-found")
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("doc_id")))
    groups = found.groupBy("component_id").agg(first.alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = scratch.stage(groups.select("component_id", F.col("_first.doc_id").alias("_first")), "jaccard-groups")
    gone = found.join(groups, "component_id").where("doc_id <> _first").select(F.col("doc_id").alias(row))
    gone = stage(gone, "jaccard-dropped")
    scratch.drop(found, groups)
    release_shuffles(docs.sparkSession)
    # most rows pass the filter and aren't moved; the others are settled by a join
    maybe = fresh(rows, "_maybe")
    split = with_maybe(rows, F.col(row), gone, row, maybe)
    kept = split.where(~F.col(maybe)).unionByName(split.where(maybe).join(gone.hint("merge"), row, "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


QUERY = "op4_jaccard_metric_join"
ORACLE = None


def query(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)
