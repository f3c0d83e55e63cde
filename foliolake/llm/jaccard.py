"""Near-duplicate groups by an exact Jaccard join on word shingles: size-aware, light by subsets, heavy by inverted lists.

Equal sets fall into one class, and one text stands for each. Small sets are joined by equal 2-subsets of their first ``n - o + 2`` shingles,
``o`` being the least overlap a set of n can have with a partner. Large sets are joined through inverted lists. The lists
are kept over a part of all shingles (by hash; the smaller the sets, the larger the part): two linked sets miss at most ``n - o`` of each other's shingles there
too, so with the rarest first, they meet among the first ``n - o + 1``, and the smaller one of a pair within the first ``(n + 1) * (1 - t) / (1 + t)`` or so.
Shingles that no other text has cost a place and make no list, which leaves few lists besides those of near copies. Should
a set have so few shingles in its part that this could fail, the part becomes the whole for all. A cost model over the sizes sets the boundary between small and large; it changes speed, not results.

Lists are dealt by range on (key, size, set), so a long one lies over many tasks, and cut into blocks of at most ``BLOCK``. Within one, pairs are counted out by size and by a
parity bitmap, which bounds the symmetric difference from below, so a pair that it rejects cannot link. Pairs aren't emitted: each set offers its most alike predecessor in its
block; of a list with several blocks, the first and last members of each form a list again, which ties the blocks. These links are checked on
the whole sets, and components are formed. Only pairs that still cross components are then checked, all of them, so no link between components is lost: in a list of several
blocks, the members outside the list's most frequent component meet all others.

Hot keys. Shingles that many documents share are counted while sets are made; their rows need no counting in one place and are dealt by document. Members of a class meet
it by a salted join, and nothing else is keyed by class or component.

Defined cases. A null text or one without words is an empty set, linked with nothing. Repeated rows are copies. Rows that share an id are one
document: it links where any of its texts does. A null id gets no component. Extra columns are ignored; an empty table gives no rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import entered, slices, written
from .components import components
from .shingles import _mixed, shingle_set

#: Bits of a parity bitmap; members of a block of a list; the largest size that subsets are made for.
BITS, BLOCK, LIGHT = 1024, 1024, 96
#: Members at each end of a block that stand for it; members up to which a list of such is read in one task.
ENDS, FEW = 4, 200_000
#: Shingles that are known to be frequent, at most (others are counted in one task each); one in how many documents of a batch has a frequent one; parts that a class is dealt into.
OFTEN, SHARE, SALTS = 20_000, 64, 16
#: Ids whose texts are fetched through a broadcast, at most; beyond it they are joined by a shuffle.
IDS = 1_000_000
#: The least percent: below it, sets of under four shingles link with others, sets link across bands, and blocks of lists meet that are left apart here.
LEAST = 80
#: Bands of sizes: the largest size and the part of all shingles that the band's lists are kept over.
BANDS = ((96, 1.0), (256, 0.6), (1 << 62, 0.4))


def least_overlap(n, percent: int):
    """Of a set of n with any partner at the threshold."""
    return -((-percent * n) // 100)


def _bitmap(h: np.ndarray) -> bytes:
    odd = np.bincount((h.view(np.uint64) >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _parts(h: np.ndarray, percent: int, bands) -> list[tuple[int, np.ndarray]]:
    """(band, the set's part there): in its own band, and in the next one if the set has partners there."""
    n = len(h)
    own = next(i for i, (top, _) in enumerate(bands) if n <= top)
    up = own + 1 < len(bands) and n * 100 >= percent * (bands[own][0] + 1)
    return [(b, h if bands[b][1] >= 1 else h[h.view(np.uint64) < np.uint64(int(bands[b][1] * 2**64))]) for b in range(own, own + 1 + up)]


def _frequent(parts: list[np.ndarray], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, documents) of those that one in ``SHARE`` documents of a batch has."""
    least = max(16, docs // SHARE)
    every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(every) < least:
        return every[:0], every[:0]
    place = (every.view(np.uint64) >> np.uint64(44)).astype(np.int64)
    every = every[np.bincount(place, minlength=1 << 20)[place] >= least]
    s, n = np.unique(every, return_counts=True)
    return s[n >= least], n[n >= least]


def _part_rows(docs: DataFrame, size: int, percent: int, bands, least: int, often: np.ndarray) -> DataFrame:
    """(s, doc_id, band) of the parts of all sets of ``least`` shingles or more; s tells bands apart. A shingle of ``often`` has its place there in
    ``band``, from 16 up, and a number of its own and the document's as ``s``."""

    def run(batches):
        for b in slices(batches):
            s, doc, band = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int32)]
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingle_set(text, size)
                if len(h) >= least:
                    for i, part in _parts(h, percent, bands):
                        part = part + np.int64(i)
                        kind = np.full(len(part), i, np.int32)
                        if len(often):
                            at = np.minimum(np.searchsorted(often, part), len(often) - 1)
                            hot = often[at] == part
                            kind[hot] += 16 * (at[hot] + 1).astype(np.int32)
                            part[hot] = _mixed(part[hot].view(np.uint64) + np.uint64(d & (1 << 64) - 1)).view(np.int64)
                        s.append(part)
                        band.append(kind)
                        doc.append((d, len(part)))
            n = [k for _, k in doc]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s)), pa.array(np.repeat(np.array([d for d, _ in doc], np.int64), n)), pa.array(np.concatenate(band))], names=["s", "doc_id", "band"])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "s long, doc_id long, band int")


def _signatures(docs: DataFrame, size: int, percent: int, bands) -> DataFrame:
    """(doc_id, n, c1, c2, bits, first, b0, z0, b1, z1, often, counts): c1 and c2 name the set; first is the prefix for subsets (small sets only);
    z0 is the size of the set's part in its band b0, z1 of that in the next one if it has partners there. The first row of a batch has the batch's frequent shingles."""

    def run(batches):
        import xxhash

        shape = [("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bits", pa.binary()), ("first", pa.list_(pa.int64())), ("b0", pa.int32()), ("z0", pa.int32()), ("b1", pa.int32()), ("z1", pa.int32()), ("often", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
        for b in slices(batches):
            rows, every = [], []
            for text in b.column(1).to_pylist():
                h = shingle_set(text, size)
                n = len(h)
                c = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8")
                parts = _parts(h, percent, bands)
                first = h[: n - int(least_overlap(n, percent)) + 2] if n <= LIGHT else None
                more = [(b, len(p)) for b, p in parts] + [(None, None)]
                every += [p + np.int64(i) for i, p in parts]
                rows.append((n, int(c[0]), int(c[1]), _bitmap(h), first, *more[0], *more[1], None, None))
            if rows:
                rows[0] = (*rows[0][:-2], *_frequent(every, len(rows)))
            cols = list(zip(*rows)) if rows else [()] * len(shape)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, shape))], names=["doc_id", *(n for n, _ in shape)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, c1 long, c2 long, bits binary, first array<long>, b0 int, z0 int, b1 int, z1 int, often array<long>, counts array<long>")


def _boundary(signed: DataFrame, percent: int, bands) -> int:
    """The largest size that is joined by subsets: where the rows made for subsets and those made for lists cost least together."""
    sizes = {r["n"]: r["c"] for r in signed.where((F.col("n") > 3) & (F.col("n") <= LIGHT)).groupBy("n").agg(F.count("*").alias("c")).collect()}
    cost = at = 0
    best = 0.0
    for n in sorted(sizes):
        p = n - least_overlap(n, percent) + 2
        share = next(s for t, s in bands if n <= t)
        cost += sizes[n] * (p * (p - 1) / 2 - 1.5 * share * n)
        if cost <= best:
            best, at = cost, n
    return at


def _keys(signed: DataFrame, rows: DataFrame, reps: DataFrame, small: int, percent: int, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(key, rep, n, near): what two linked sets have in common; near: it counts if the set is the smaller of the two."""
    pairs = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.xxhash64(x, y))))
    light = signed.where((F.col("n") > 3) & (F.col("n") <= small)).select(F.col("doc_id").alias("rep"), "c1", "c2", "n", F.explode(pairs).alias("key"))
    light = light.join(reps, ["rep", "c1", "c2"], "left_semi").select("key", "rep", "n", F.lit(True).alias("near"))
    shared = rows.repartition("s").sortWithinPartitions("s").mapInArrow(lambda it: _shared(it, often, counts), "doc_id long, band int, df int, s long")
    # The sets that have shared shingles, with these from the rarest on.
    own = shared.groupBy("doc_id", "band").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))
    known = signed.where("n > 3").join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "c1", "c2"], "left_semi")
    known = known.select("doc_id", "n", F.explode(F.array(F.struct(F.col("b0").alias("band"), F.col("z0").alias("size")), F.struct(F.col("b1").alias("band"), F.col("z1").alias("size")))).alias("x")).where("x.band is not null")
    found = own.join(known.select("doc_id", "n", F.col("x.band").alias("band"), F.col("x.size").alias("size")), ["doc_id", "band"])
    alone = F.col("size") - F.size("shared")
    larger = F.floor(F.lit(100 - percent) * F.col("n") / 100).cast("int") + 1 - alone
    smaller = F.floor(F.lit(100 - percent) * F.col("n") / (100 + percent)).cast("int") + 1 - alone
    first = found.where(larger > 0).select("doc_id", "n", smaller.alias("within"), F.posexplode(F.slice("shared", 1, larger)).alias("i", "x"))
    heavy = first.select(F.col("x.s").alias("key"), F.col("doc_id").alias("rep"), "n", (F.col("i") < F.col("within")).alias("near"))
    return light.unionByName(heavy)


def _shared(batches, often: np.ndarray, counts: np.ndarray):
    """Rows (s, doc_id, band) in order -> (doc_id, band, df, s) of every s that two rows or more have; the frequent ones are known to."""
    entered("lists")
    for t in _grouped(batches, 1):
        s, band = t.column(0).to_numpy(), t.column(2).to_numpy()
        place = (band >> 4) - 1
        new = np.r_[True, s[1:] != s[:-1]]
        n = np.where(place < 0, np.diff(np.r_[np.flatnonzero(new), len(s)])[np.cumsum(new) - 1], 0)
        if len(often):
            n, s = np.where(place < 0, n, counts[place]), np.where(place < 0, s, often[place])
        keep = n > 1
        if keep.any():
            yield pa.RecordBatch.from_arrays([t.column(1).filter(pa.array(keep)), pa.array(band[keep] & 15), pa.array(np.minimum(n[keep], 2**31 - 1).astype(np.int32)), pa.array(s[keep])], names=["doc_id", "band", "df", "s"])


def _grouped(batches, columns: int):
    """Sorted rows -> record batches that end where a key (the first ``columns`` columns) ends. Rows are copied once, however many a key has."""
    held: list[pa.RecordBatch] = []  # all of one key, but for the first batch

    def same(x, i, y, j) -> bool:
        return all(x.column(c)[i] == y.column(c)[j] for c in range(columns))

    for b in batches:
        if not b.num_rows:
            continue
        if held and same(held[-1], -1, b, 0) and same(b, 0, b, -1):
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0] if held else b
        last = np.logical_and.reduce([k == k[-1] for k in (t.column(i).to_numpy() for i in range(columns))])
        n = len(last) - (int(np.argmin(last[::-1])) or len(last))
        if n:
            yield t.slice(0, n)
        held = [t.slice(n)]
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(batches, edges: bool, block: int):
    """Rows (key, n, rep, near) in order -> (key, blk, rep, n, near, more, lead): members of keys with two members or more, one of them near, in blocks.

    ``more``: the list has more blocks, or (with ``edges``) may go on in another partition; such a list keeps all its members. ``lead``: the member is at an end of its block."""
    from pyspark import TaskContext

    entered("lists")
    context = TaskContext.get()
    blk = (context.partitionId() if context else 0) << 40
    first = True
    waiting = None

    def blocks(t, end: bool):
        nonlocal blk, first
        key, n, rep = (t.column(i).to_numpy() for i in range(3))
        near = t.column(3).to_numpy(zero_copy_only=False)
        new = np.r_[True, key[1:] != key[:-1]]
        group, start = np.cumsum(new) - 1, np.flatnonzero(new)
        m = np.diff(np.r_[start, len(key)])
        open_ = np.zeros(len(m), bool)
        if edges:
            open_[0] |= first
            open_[-1] |= end
        m = np.where(np.logical_or.reduceat(near, start) & (m > 1) | open_, m, 0)
        i = np.arange(len(key)) - start[group]
        parts = -(-m // block)
        number = blk + (np.cumsum(parts) - parts)[group] + i // block
        blk += int(parts.sum())
        more = (parts > 1) | open_
        size = np.minimum(block, m[group] - i // block * block)  # of the member's block
        lead = more[group] & ((i % block < ENDS) | (i % block >= size - ENDS))
        first = False
        keep = pa.array(m[group] > 0)
        cols = [pa.array(c).filter(keep) for c in (key, number, rep, n, near, more[group], lead)]
        return pa.RecordBatch.from_arrays(cols, names=["key", "blk", "rep", "n", "near", "more", "lead"])

    for t in _grouped(batches, 1):
        if waiting is not None:
            yield blocks(waiting, False)
        waiting = t
    if waiting is not None:
        yield blocks(waiting, True)


def _pairs(batches, percent: int, cross: bool):
    """Rows (key, blk, home, side, rep, n, label, bits) in order -> (a, b, apart, key, blk). Members of one side meet each other, or those of the two sides.

    ``cross``: all pairs of different labels that may link; else each rep's most alike predecessor in a block."""
    entered("lists")
    step = 50_000

    def fitting(x, y, n, label, bits):
        """Of row pairs (x, y): those that may link, with the later rep first, and how far apart they are at least."""
        a, b, d = [], [], []
        for s in range(0, len(x), step):
            i, j = x[s : s + step], y[s : s + step]
            total = n[i] + n[j]
            room = total - 2 * (-((-percent * total) // (100 + percent)))
            ok = np.abs(n[i] - n[j]) <= room
            if cross:
                ok &= label[i] != label[j]
            i, j, room = i[ok], j[ok], room[ok]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            ok = apart <= room
            a.append(i[ok]), b.append(j[ok]), d.append(apart[ok])
        return np.concatenate(a), np.concatenate(b), np.concatenate(d)

    def chosen(found, group, start, key, i, rep):
        """Of row pairs found: each rep's most alike predecessor in a block, or every pair once."""
        x, y, apart = (np.concatenate(c) for c in zip(*found))
        a, b = np.maximum(rep[x], rep[y]), np.minimum(rep[x], rep[y])
        ok = a != b
        a, b, apart, g = a[ok], b[ok], apart[ok], group[x[ok]]
        order = np.lexsort((b, a) if cross else (b, apart, a, g))
        a, b, apart, g = a[order], b[order], apart[order], g[order]
        keep = np.r_[True, (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) if cross else (g[1:] != g[:-1]))][: len(a)]
        first = start[g[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a[keep], b[keep], apart[keep], key[first], i[first])], names=["a", "b", "apart", "key", "blk"])

    for t in _grouped(batches, 3):
        key, i, j, side, rep, n, label = (t.column(c).to_numpy() for c in range(7))
        bits = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        start = np.flatnonzero(new)
        m = np.diff(np.r_[start, len(key)])
        group = np.cumsum(new) - 1
        left = m[group] - (np.arange(len(key)) - start[group]) - 1  # rows of the group that follow
        found = []
        small = np.flatnonzero(m[group] <= 64)
        for lag in range(1, 64):
            x = small[left[small] >= lag]
            if not len(x):
                break
            found.append(fitting(x, x + lag, n, label, bits))
        if found:
            yield chosen(found, group, start, key, i, rep)
        # The pairs of one large group are held at a time.
        for g in np.flatnonzero(m > 64):
            rows = np.arange(start[g], start[g] + m[g])
            found = []
            if side[rows[0]] == side[rows[-1]]:
                for r in range(len(rows) - 1):
                    found.append(fitting(np.full(len(rows) - r - 1, rows[r]), rows[r + 1 :], n, label, bits))
            else:
                other = rows[side[rows] == 1]
                for r in rows[side[rows] == 0]:
                    found.append(fitting(np.full(len(other), r), other, n, label, bits))
            yield chosen(found, group, start, key, i, rep)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets link."""
    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    few = pairs.limit(IDS + 1).count() <= IDS
    texts = docs.join(F.broadcast(asked) if few else asked, "doc_id").select("a", "b", "doc_id", "text")

    def sets(batches):
        for t in slices(batches):
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array([shingle_set(x, size).tobytes() for x in t.column(3).to_pylist()], pa.binary())], names=["a", "b", "doc_id", "s"])

    def check(batches):
        entered("lists")
        for t in _grouped(batches, 2):
            a, b, doc = (t.column(c).to_pylist() for c in range(3))
            held: dict[tuple, tuple[list, list]] = {}
            for x, y, d, s in zip(a, b, doc, t.column(3).to_pylist()):
                held.setdefault((x, y), ([], []))[int(d == y)].append(np.frombuffer(s, "<i8"))
            good = [k for k, (xs, ys) in held.items() if any(_link(x, y, percent) for x in xs for y in ys)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in good], pa.int64()), pa.array([k[1] for k in good], pa.int64())], names=["a", "b"])

    whole = texts.mapInArrow(sets, "a long, b long, doc_id long, s binary")
    return whole.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(check, "a long, b long")


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _sent(keys: DataFrame) -> DataFrame:
    """A row for each of some lists: sent to the members where there are at most ``IDS``, so that long lists aren't dealt by key."""
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.limit(IDS + 1).count() <= IDS else keys


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands=BANDS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row: class_id is the smallest id with an equal set, component_id the smallest that links reach."""
    if percent < LEAST:
        raise ValueError(f"percent is from {LEAST} up")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(_signatures(docs, size, percent, bands), "signatures")
    missed = F.floor(F.lit(100 - percent) * F.col("n") / 100)
    if any(s < 1 for _, s in bands) and signed.where((F.col("n") > 3) & ((F.col("z0") <= missed) | (F.col("z1") <= missed))).limit(1).count():
        return near_duplicates(docs, size, percent, bands=tuple((t, 1.0) for t, _ in bands))
    reported = signed.where("often is not null").select(F.explode(F.arrays_zip("often", "counts")).alias("x")).groupBy("x.often").agg(F.sum("x.counts").alias("n"))
    top = sorted((r["often"], r["n"]) for r in reported.orderBy(F.desc("n"), "often").limit(OFTEN).collect())
    often, counts = np.array([s for s, _ in top], np.int64), np.array([n for _, n in top], np.int64)
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # One row for each class; sets of under four shingles link with equal ones only.
    classes = written(known.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    reps = classes.select("rep", "c1", "c2")
    small = _boundary(known, percent, bands)
    least = max(4, int(least_overlap(small + 1, percent)))
    keys = written(_keys(known, _part_rows(docs, size, percent, bands, least, often), reps, small, percent, often, counts).select("key", "n", "rep", "near"), "keys")
    bits = known.select(F.col("doc_id").alias("rep"), "n", "bits")
    place = ["key", "blk", "home"]
    columns = [*place, "side", "rep", "n", "label", "bits"]
    lists, level = [], keys
    while level is not None:
        few = bool(lists) and level.limit(FEW + 1).count() <= FEW
        dealt = level.repartition(1) if few else level.repartitionByRange("key", "n", "rep")
        blocks = dealt.sortWithinPartitions("key", "n", "rep").mapInArrow(lambda it, few=few, block=BLOCK: _lists(it, not few, block), "key long, blk long, rep long, n long, near boolean, more boolean, lead boolean")
        lists.append(written(blocks, "lists"))
        level = lists[-1].where("lead").select("key", "n", "rep", F.lit(True).alias("near"))
        level = None if level.isEmpty() else level
    first = None
    for each in lists:
        near = each.join(bits, ["rep", "n"]).withColumn("label", F.lit(0).cast("long")).withColumn("home", F.col("blk")).withColumn("side", F.lit(0)).select(*columns)
        part = near.repartition("key", "blk").sortWithinPartitions(*place, "rep").mapInArrow(lambda it: _pairs(it, percent, False), "a long, b long, apart long, key long, blk long")
        first = part if first is None else first.unionByName(part)
    first = written(first, "first")
    best = first.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    links = written(_verified(written(best.select("a", "b"), "pairs"), docs, size, percent), "verified")
    # The texts of one id are one document.
    twice = known.select("doc_id", "c1", "c2").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    own = known.join(twice, "doc_id", "left_semi").select("doc_id", "c1", "c2").distinct().join(classes, ["c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(own)
    found = written(components(links), "found")
    # Blocks in which some pair may link, and lists of several blocks, whose members lie in two components or more.
    live = lists[0].where("not more").join(first.select("key", "blk").distinct(), ["key", "blk"], "left_semi").unionByName(lists[0].where("more"))
    labelled = written(live.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).select("key", "blk", "rep", "n", "more", "label"), "labelled")
    mixed = _sent(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"))
    open_ = labelled.join(mixed, "key", "left_semi")
    one = open_.where("not more").select("key", "blk", F.col("blk").alias("home"), F.lit(0).alias("side"), "rep", "n", "label")
    long = open_.where("more")
    major = _sent(long.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("major")))
    minor = long.join(major, "key").where("label <> major").drop("major")
    # Members outside the most frequent component visit the blocks whose sizes they can meet.
    span = lambda d, *by: d.groupBy("key", *by).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    visits = span(minor, "blk").select("key", F.col("blk").alias("home"), F.col("low").alias("l"), F.col("high").alias("h")).join(span(long, "blk"), "key")
    visits = visits.where((F.col("high") * 100 >= F.col("l") * percent) & (F.col("h") * 100 >= F.col("low") * percent)).select("key", "blk", "home")
    guests = minor.withColumnRenamed("blk", "home").join(visits, ["key", "home"]).withColumn("side", F.lit(0))
    hosts = long.join(visits, ["key", "blk"]).withColumn("side", F.lit(1))
    cross = one.unionByName(guests.select(*one.columns)).unionByName(hosts.select(*one.columns)).join(bits, ["rep", "n"]).select(*columns)
    rest = cross.repartition(*place).sortWithinPartitions(*place, "side", "rep").mapInArrow(lambda it: _pairs(it, percent, True), "a long, b long, apart long, key long, blk long")
    more = written(_verified(written(rest.select("a", "b").distinct(), "pairs"), docs, size, percent), "verified")
    found = components(links.unionByName(more))
    # What a class belongs to; classes of one document need no join, members of the others are dealt into parts.
    of = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), "last")
    single = of.where("class_id = last").select(F.col("last").alias("doc_id"), "c1", "c2", "class_id", "component_id")
    many = of.where("class_id < last").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = known.select("doc_id", "c1", "c2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
    of = single.unionByName(members.join(many, ["c1", "c2", "salt"]).select("doc_id", "c1", "c2", "class_id", "component_id"))
    out = signed.select("doc_id", "n", "c1", "c2").join(of, ["doc_id", "c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
