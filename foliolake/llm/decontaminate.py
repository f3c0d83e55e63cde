"""Benchmark items inside documents, within an edit distance in words.

Long items are cut into segments of at most ``LONG`` words, of which one keeps to the rate if the item does. A segment, and the window of a document that begins at a word, are
embedded by random walks (Chakraborty, Goldenberg and Koucky): a walk reads a word at each step and a random function of step and word says whether
it moves on, so walks that fall apart at an edit meet again and edits become few differing steps. A repetition samples ``BITS`` steps; their words are
the bucket, and a window that shares a bucket with a segment is a candidate. The number of repetitions of each class of lengths is measured on made segments at the limit
of edits, until ``target`` of them meet (``repetitions``; no cap). Candidates are settled by exact edit distance over the whole region.

Windows are embedded only where they can hold anything: ``k`` edits spoil at most ``3 k`` of a segment's ``m - 2`` word trigrams, so a window with fewer trigrams of any item
than are left is passed over, which loses nothing; where none need be left (higher rates), every window is embedded.

Defined cases. Words are lower-cased runs of letters, digits and marks. A null or empty document matches nothing, nor does a null or empty item. Items of under ``SHORT``
words must occur exactly, and those of under three words are left out. Items that repeat are reported under each id. Repeated rows and null ids of documents are
reported as they come. Extra columns are ignored. Items go to the workers in groups of at most about ``ITEMS`` and ``CHARS``; more of them take more passes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import entered
from .shingles import _mixed, _words

#: Items of a pass, and about how many characters of them; words below which an item must occur exactly.
ITEMS, CHARS, SHORT = 60_000, 60_000_000, 8
#: Words of the longest segment; steps that a repetition samples; repetitions that share a walk.
LONG, BITS, SHARE = 32, 2, 4
#: The least length of each class of segments. Those under ``SHORT`` are sampled whole, once.
CLASSES = (3, 4, 5, 6, 7, 8, 10, 13, 17, 22, 27)
#: Empty places behind each text.
GAP = 2 * LONG
_TABLE = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: Whether bytes may hold other characters beyond ASCII than Latin letters (U+00C0 to U+02BF).
_BEYOND = re.compile(rb"[\xc2\xcb-\xff]|\xc3[\x97\xb7]").search


class _Letters(dict):
    """Characters beyond ASCII that are no letters, digits or marks become spaces."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = out = code if code < 128 or c.isalnum() or unicodedata.category(c)[0] == "M" else 32
        return out


_letters = _Letters()


def word_ids(text: str | None) -> np.ndarray:
    text = (text or "").lower()
    raw = text.encode()
    if _BEYOND(raw):
        raw = text.translate(_letters).encode()
    ws = raw.translate(_TABLE).split()
    return np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))


def _trigrams(w: np.ndarray) -> np.ndarray:
    return _mixed(w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9))


def edits(n: int, rate: float) -> int:
    """The distance up to which a window of an item of n words counts."""
    return int(rate * n) if n >= SHORT else 0


def left_whole(n: int, rate: float) -> int:
    """Trigrams of n words that the edits can't reach."""
    return max(0, n - 2 - 3 * edits(n, rate))


def distance(item: np.ndarray, region: np.ndarray) -> int:
    """The least edit distance in words between the item and any window of the region."""
    before = np.zeros(len(region) + 1, np.int64)
    ramp = np.arange(len(region) + 1)
    for i, x in enumerate(item):
        now = np.empty_like(before)
        now[0] = i + 1
        now[1:] = np.minimum(before[:-1] + (region != x), before[1:] + 1)
        before = np.minimum.accumulate(now - ramp) + ramp
    return int(before.min())


def _top(low: int) -> int:
    """The greatest length of the class that begins at ``low``."""
    i = CLASSES.index(low)
    return CLASSES[i + 1] - 1 if i + 1 < len(CLASSES) else LONG


def _samples(low: int, r: int) -> tuple[int, np.ndarray]:
    """(walk, steps) of a class's repetition: steps that most walks take before the segment ends."""
    if low < SHORT:
        return 0, np.arange(low)
    rng = np.random.default_rng([low, r])
    return r // SHARE, np.sort(rng.choice(int(1.5 * low), BITS, replace=False))


def _buckets(flat: np.ndarray, starts: np.ndarray, plan: list[tuple[int, np.ndarray]]):
    """For each repetition in turn the bucket of the window at each start. ``flat`` has ``GAP`` places behind the last start."""
    held, words = -1, {}
    for r, (walk, steps) in enumerate(plan):
        if walk != held:
            held, words = walk, {}
            moves = _mixed(flat + np.uint64((walk + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            wanted = {int(j) for w, s in plan if w == walk for j in s}
            at = starts.copy()
            for j in range(max(wanted) + 1):
                if j in wanted:
                    words[j] = flat[at]
                at = at + ((moves[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
        key = np.full(len(starts), np.uint64(r + 1))
        for j in steps:
            key = _mixed(key + words[int(j)])
        yield key


@lru_cache(maxsize=64)
def repetitions(low: int, rate: float, target: float, made: int = 1500) -> int:
    """How many repetitions a class needs: made segments at the limit of edits are embedded until ``target`` of them share a bucket with their edited copy."""
    if low < SHORT:
        return 1
    rng = np.random.default_rng(low)
    flat, a, b = [], [], []
    size = 0
    for i in range(made):
        m = low + i % (_top(low) - low + 1)
        w = rng.integers(1, 1 << 62, m).astype(np.uint64)
        edited, k = [], edits(m, rate)
        at = set(rng.choice(m, k, replace=False).tolist())
        for j, x in enumerate(w):
            kind = int(rng.integers(3)) if j in at else 3
            edited += [[np.uint64(rng.integers(1, 1 << 62))], [], [np.uint64(rng.integers(1, 1 << 62)), x], [x]][kind]
        for x, places in ((w, a), (np.array(edited + rng.integers(1, 1 << 62, 8).tolist(), np.uint64), b)):
            places.append(size)
            flat += [x, np.zeros(GAP, np.uint64)]
            size += len(x) + GAP
    flat, a, b = np.concatenate(flat), np.array(a), np.array(b)
    met, r = np.zeros(made, bool), 0
    while met.mean() < target:
        plan = [_samples(low, i) for i in range(r, r + SHARE)]
        for x, y in zip(_buckets(flat, a, plan), _buckets(flat, b, plan)):
            met |= x == y
        r += SHARE
    return r


class Items:
    """What a worker needs of a group of items."""

    def __init__(self, ids: list[int], words: list[np.ndarray], rate: float, target: float = 0.999):
        self.ids, self.words, self.rate = ids, words, rate
        self.size = np.array([len(w) for w in words], np.int64)
        self.edits = np.array([edits(len(w), rate) for w in words], np.int64)
        self.own = grams = [np.sort(_trigrams(w)) for w in words]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        base, flat = np.cumsum([0, *(len(w) + GAP for w in words)]), np.zeros(sum(len(w) + GAP for w in words) + GAP, np.uint64)
        item, offset, size = [], [], []
        for i, w in enumerate(words):
            flat[base[i] : base[i] + len(w)] = w
            cuts = np.linspace(0, len(w), -(-len(w) // LONG) + 1).astype(int)
            item += [i] * (len(cuts) - 1)
            offset += cuts[:-1].tolist()
            size += np.diff(cuts).tolist()
        self.item, self.offset = np.array(item, np.int64), np.array(offset, np.int64)
        place, size = base[self.item] + self.offset, np.array(size, np.int64)
        #: (trigrams that must be left, words within which, plan, for each repetition the sorted buckets and their segments)
        self.classes = []
        for low in CLASSES:
            own = np.flatnonzero((size >= low) & (size <= _top(low)))
            if not len(own):
                continue
            plan = [_samples(low, r) for r in range(repetitions(low, rate, target))]
            tables = []
            for key in _buckets(flat, place[own], plan):
                order = np.argsort(key, kind="stable")
                tables.append((key[order], own[order]))
            lengths = np.unique(size[own])
            self.classes.append((min(left_whole(int(m), rate) for m in lengths), max(int(m) + edits(int(m), rate) for m in lengths), plan, tables))

    def candidates(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, segment) of the windows of ``flat`` (words, 0 between texts, ``GAP`` of them at the end) that share a bucket with a segment."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(flat) > GAP and len(self.grams):
            t = _trigrams(flat)
            at = np.flatnonzero(self.maybe[(t & np.uint64((1 << 20) - 1)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.grams, t[at]), len(self.grams) - 1)
            upto = np.zeros(len(flat) + 1, np.int32)
            upto[at[self.grams[i] == t[at]] + 1] = 1
            np.cumsum(upto, out=upto)
            last = len(flat) - GAP
            for need, within, plan, tables in self.classes:
                end = np.minimum(np.arange(last) + max(within - 2, 1), len(flat))
                starts = np.flatnonzero((flat[:last] != 0) & (upto[end] - upto[:last] >= need))
                if not len(starts):
                    continue
                # Only what the walks from these starts can read is hashed.
                near = np.zeros(len(flat) + 1, np.int32)
                np.add.at(near, starts, 1)
                np.add.at(near, starts + GAP, -1)
                read = np.cumsum(near[:-1]) > 0
                small, new = flat[read], np.cumsum(read) - 1
                for key, (known, segment) in zip(_buckets(small, new[starts], plan), tables):
                    a, b = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                    hit = np.flatnonzero(b > a)
                    n = (b - a)[hit]
                    s = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append((starts[np.repeat(hit, n)], segment[s]))
        both = np.unique(np.concatenate([a * max(1, len(self.item)) + b for a, b in found]))
        return both // max(1, len(self.item)), both % max(1, len(self.item))

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(position in ``docs``, item id, distance) of the items that documents hold."""
        base = np.cumsum([0, *(len(d) + GAP for d in docs)])
        flat = np.zeros(int(base[-1]) + GAP, np.uint64)
        for b, d in zip(base, docs):
            flat[b : b + len(d)] = d
        start, segment = self.candidates(flat)
        item = self.item[segment]
        doc = np.searchsorted(base, start, "right") - 1
        first = start - base[doc] - self.offset[segment]  # where the item would begin
        order = np.lexsort((first, item, doc))
        doc, item, first = doc[order], item[order], first[order]
        n, k = self.size[item], self.edits[item]
        # Candidates whose regions meet are settled together.
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(first) > (n + 3 * k)[1:])][: len(first)]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(first)][: len(begin)] - 1
        best: dict[tuple[int, int], int] = {}
        for d, i, low, high in zip(doc[begin].tolist(), item[begin].tolist(), (first - k)[begin].tolist(), (first + n + 2 * k)[end].tolist()):
            region = docs[d][max(0, low) : max(0, high)]
            # An exact check before the distance: what the edits leave whole of the item must be there.
            if len(region) < 3:
                continue
            own, t = self.own[i], _trigrams(region)
            if (own[np.minimum(np.searchsorted(own, t), len(own) - 1)] == t).sum() < left_whole(len(self.words[i]), self.rate):
                continue
            apart = distance(self.words[i], region)
            if apart <= self.edits[i]:
                key = (d, self.ids[i])
                best[key] = min(apart, best.get(key, apart))
        return [(d, i, k) for (d, i), k in sorted(best.items())]


def _groups(docs: DataFrame, benchmark: DataFrame, rate: float) -> list:
    """The items, broadcast in groups."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    groups = max(1, math.ceil(size["n"] / (ITEMS * 0.8)), math.ceil(size["chars"] / CHARS))
    out = []
    for g in range(groups):
        rows = [(r["item_id"], word_ids(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id").collect()]
        rows = [(i, w) for i, w in rows if len(w) >= 3]
        out.append(docs.sparkSession.sparkContext.broadcast(Items([i for i, _ in rows], [w for _, w in rows], rate)))
    return out


#: Texts whose windows are embedded together.
STEP = 250


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance) of every document and item of which a window is within ``rate`` times the item's words."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for held in _groups(docs, benchmark, rate):

        def run(batches, held=held):
            entered("decontamination")  # what the stage before left is given back before the items are read
            known = held.value
            for b in batches:
                for a in range(0, b.num_rows, STEP):
                    part = b.slice(a, STEP)
                    ids = part.column(0).to_pylist()
                    hits = known.matches([word_ids(t) for t in part.column(1).to_pylist()])
                    cols = [[ids[d] for d, _, _ in hits], [i for _, i, _ in hits], [k for _, _, k in hits]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance"])

        part = own.mapInArrow(run, "doc_id long, item_id long, distance int")
        found = part if found is None else found.unionByName(part)
    return found


def without_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item, whatever their id; dropped in the pass that reads the texts, without a shuffle."""
    at = docs.columns.index(text_col)
    for held in _groups(docs, benchmark, rate):

        def run(batches, held=held):
            entered("decontamination")  # what the stage before left is given back before the items are read
            known = held.value
            for b in batches:
                for a in range(0, b.num_rows, STEP):
                    part = b.slice(a, STEP)
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, _, _ in known.matches([word_ids(t) for t in part.column(at).to_pylist()])]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
