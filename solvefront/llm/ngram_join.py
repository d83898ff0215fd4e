"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

1. Each text becomes its set of n-word shingles (64-bit hashes); texts of one
   set are one class from here on.
2. A first pass over few shingles.  In the order of their hashes, a set of n
   has the 2 (n - ceil(n num / den)) first ones as its head; two sets that link
   share a known number of head shingles (see :func:`head_sizes`).  Rows
   (shingle, class) meet by shingle, sorted, so a task streams over them; a set
   with fewer shared head shingles in all can link to nothing and goes here.
3. Global order, over the sets left.  Rows of all their shingles meet in the
   same way and the classes of each are counted.  A shingle of a single class
   can be in no intersection and goes; the others get a place in the global
   order: frequent ones first, by a class of their count, then by hash.  Rows
   meet again by class.  A set of n that links to another shares
   ceil(n num / den) shingles with it; one with fewer shared shingles goes.  Of
   the others, m shared shingles each, the rarest m - ceil(n num / den) + 1 are
   the prefix, and two sets that link have a prefix shingle in common.  Sets
   that meet in one are joined to blocks.
4. Within a block, each prefix group is joined through a trie of its sets, most
   frequent shingles first, so near copies share long paths.  A traversal
   carries the overlap of a path, shared by all sets below it, and leaves a
   subtree when the lengths that remain cannot reach the overlap needed, or
   when all sets below are already in the asking set's component.  A block too
   large for one task is joined length band by length band, and a band too
   large for one task by every pair of its chunks, so none of its links is lost.
5. The links found span every component; their components are the result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import give_back, rows_of, sealed, stage, unstage
from solvefront.llm.components import connected_components

SHINGLE = 3
NUM, DEN = 90, 100
SLICE_BYTES = 1 << 20
SEEN = 500_000
REPS = 32
#: Counts above it are one class of the order, so that a run of any length streams by.
HOT = 1 << 16
#: Bits for each text that the second pass wants, and at most (2^30 bits are 128 MB): beyond it the pass reads more texts than it must.
MARK_BITS = 16
MOST_BITS = 1 << 30
BLOCK_SHINGLES = 2_000_000
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(1 << 12, np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word of some bytes in lower case."""
    solid = ~_SPACE[buf]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    begin, over = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    length = over - begin
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    turn = (place >> 12).astype(np.uint64)  # words over 4096 bytes reuse the powers, mixed with the turn
    word = np.add.reduceat((_BYTE[buf[solid]] + turn * np.uint64(0xD6E8FEB86659FD93)) * _POWER[place & 4095], at)
    return begin, _mix(word + length.astype(np.uint64))


def shingle_sets(texts: list[bytes], n: int = SHINGLE, window: int = SLICE_BYTES) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than n are one shingle, no word is none.

    Words are hashed in windows of bytes, so a very long text takes some bytes a word, not some words a byte.
    """
    buf = _LOWER[np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)]
    begins, hashes, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while lo < len(buf):
        hi = min(len(buf), lo + window)
        while not _SPACE[buf[hi - 1]]:  # the last byte is a space
            after = np.flatnonzero(_SPACE[buf[hi : hi + window]])
            hi = hi + int(after[0]) + 1 if len(after) else min(len(buf), hi + window)
        begin, hashed = _word_hashes(buf[lo:hi])
        begins.append(begin + lo)
        hashes.append(hashed)
        lo = hi
    begin, word = np.concatenate(begins), np.concatenate(hashes)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n_words = np.bincount(np.searchsorted(np.cumsum(sizes), begin, side="right"), minlength=len(texts))
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    windows = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n):
        windows = _mix(windows * np.uint64(3) + word[i : len(word) - n + 1 + i]) if len(windows) else windows
    out, w = [], 0
    for k in n_words.tolist():
        if k >= n:
            out.append(np.unique(windows[w : w + k - n + 1]))
        elif k:
            short = np.uint64(k)
            for x in word[w : w + k]:
                short = _mix(np.array([short], np.uint64) * np.uint64(5) + x)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        w += k
    return out


def class_of(shingles: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(col: pa.Array) -> list[bytes]:
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


def bands(num: int = NUM, den: int = DEN, most: int = 1 << 40) -> list[int]:
    """First size of each length band; sets that link are in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return out


def least_overlap(n, num: int, den: int):
    """What a set of n shares at least with any set it links to."""
    return -(-n * num // den)


def head_sizes(n, num: int, den: int):
    """(head, least shared): a set's first shingles by hash, and how many of them it shares with the heads of others if it links.

    Let e(n) = n - ceil(n num / den), at least 1 where it is used as a length,
    and a head have n - ceil(n num / den) + e(n) shingles.  Of a common set of
    at least the larger ceil(n num / den), each head misses the last ones only,
    so both hold its first min(e) of them; a partner has ceil(n num / den)
    shingles or more, and e does not fall with n.
    """
    least = least_overlap(n, num, den)
    return n - least + np.maximum(1, n - least), np.maximum(1, least - least_overlap(least, num, den))


def runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Sorted batches as arrays cut between values of the first column; a run above ``most`` comes in parts, marked True."""
    give_back()
    held: list[list[np.ndarray]] = []
    size, want, hot = 0, 0, None
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(b.num_columns)]
        if not len(cols[0]):
            continue
        if hot is not None:
            k = int(np.searchsorted(cols[0], hot, side="right"))
            if k:
                yield [c[:k] for c in cols], True
                cols = [c[k:] for c in cols]
            if not len(cols[0]):
                continue
            hot = None
        held.append(cols)
        size += len(cols[0])
        if size < want:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols], False
        held, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
        want = 2 * size if most is None else min(2 * size, most + 1)  # a long run is not copied at each batch
        if most is not None and size > most:
            hot = held[0][0][0]
            yield held[0], True
            held, size, want = [], 0, 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)], False
    del held
    give_back()


def ordered(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places in the global order: 64 - 4 log2 of the count (up to :data:`HOT`), then 56 bits of the hash."""
    level = np.floor(4 * np.log2(np.minimum(counts, HOT))).astype(np.uint64)
    return ((np.uint64(64) - level) << np.uint64(56) | shingles.view(np.uint64) >> np.uint64(8)).view(np.int64)


class _Node:
    """low: least size below; high: most shared shingles below."""

    __slots__ = ("segment", "children", "ends", "low", "high", "reps")

    def __init__(self, segment: list[int]):
        self.segment = segment
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.low, self.high = 1 << 60, 0
        self.reps: list[int] = []


class TrieJoin:
    """Sets in a trie with compressed paths; ``add`` links a set to those before it, ``find`` gives components."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.root = _Node([])
        self.sizes: list[int] = []
        self.parent: list[int] = []
        self.visited = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def need(self, a: int, b: int) -> int:
        """Least overlap at which sets of these sizes link: num (a + b) / (num + den), rounded up."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def add(self, shingles: list[int], size: int | None = None) -> int:
        """shingles: distinct places in the global order, ascending; size: of the set with the shingles no other set has."""
        me = len(self.sizes)
        self.sizes.append(len(shingles) if size is None else size)
        self.parent.append(me)
        self._link(me, shingles)
        self._insert(me, shingles)
        return me

    def _same(self, node: _Node, me: int) -> bool:
        """Whether all sets below the node are known to be in this set's component."""
        if len(node.reps) > REPS:
            return False
        node.reps = list({self.find(r) for r in node.reps})
        return len(node.reps) == 1 and node.reps[0] == self.find(me)

    def _link(self, me: int, shingles: list[int]) -> None:
        mine = dict(zip(shingles, range(len(shingles)), strict=True))
        n, size = len(shingles), self.sizes[me]
        # Of each open node: its children still to visit, and the overlap, length and own shingles passed on its path.
        stack = [(self.root, self._order(self.root, mine), 0, 0, 0)]
        while stack:
            above, left, overlap, path, passed = stack[-1]
            node = next(left, None)
            if node is None or self._same(above, me):
                stack.pop()
                continue
            self.visited += 1
            if self._same(node, me):
                continue
            need, high = self.need(size, node.low), node.high
            alive = True
            for s in node.segment:
                path += 1
                k = mine.get(s)
                if k is not None:
                    overlap += 1
                    passed = k + 1
                elif overlap + min(high - path, n - passed) < need:
                    alive = False
                    break
            if not alive:
                continue
            passed = max(passed, bisect.bisect_right(shingles, node.segment[-1]))
            if overlap + min(high - path, n - passed) < need:
                continue
            for other in node.ends:
                if overlap >= self.need(size, self.sizes[other]):
                    self.union(me, other)
            if node.children:
                stack.append((node, self._order(node, mine), overlap, path, passed))

    @staticmethod
    def _order(node: _Node, mine: dict[int, int]) -> Iterator[_Node]:
        """Children that go on with a shingle of the asking set first: its links are likeliest there."""
        yield from (c for s, c in node.children.items() if s in mine)
        yield from (c for s, c in node.children.items() if s not in mine)

    def _insert(self, me: int, shingles: list[int]) -> None:
        node, at, n, size = self.root, 0, len(shingles), self.sizes[me]
        while True:
            node.low, node.high = min(node.low, size), max(node.high, n)
            if len(node.reps) <= REPS:
                node.reps.append(me)
                if len(node.reps) > REPS:
                    node.reps = list({self.find(r) for r in node.reps})
            if at == n:
                node.ends.append(me)
                return
            child = node.children.get(shingles[at])
            if child is None:
                leaf = _Node(shingles[at:])
                leaf.low, leaf.high = size, n
                leaf.reps, leaf.ends = [me], [me]
                node.children[shingles[at]] = leaf
                return
            seg = child.segment
            k, most = 1, min(len(seg), n - at)
            while k < most and seg[k] == shingles[at + k]:
                k += 1
            if k < len(seg):  # split the path
                upper = _Node(seg[:k])
                upper.low, upper.high, upper.reps = child.low, child.high, list(child.reps)
                child.segment = seg[k:]
                upper.children[seg[k]] = child
                node.children[shingles[at]] = upper
                child = upper
            node, at = child, at + k


def prefix_groups(sets: list[np.ndarray], sizes: np.ndarray, num: int = NUM, den: int = DEN) -> list[list[int]]:
    """Sets that share a prefix shingle, directly or through others, in groups of two or more.

    sets: each set's shared shingles in the global order, rare ones last;
    sizes: with those it has alone.
    """
    kept = np.array([len(x) for x in sets]) - least_overlap(sizes, num, den) + 1
    tokens = np.concatenate([x[len(x) - k :] for x, k in zip(sets, kept.tolist(), strict=True)])
    owner = np.repeat(np.arange(len(sets)), kept)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    meet = np.nonzero(tokens[1:] == tokens[:-1])[0]
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in np.unique(np.stack([owner[meet], owner[meet + 1]], axis=1), axis=0).tolist():
        parent[find(b)] = find(a)
    groups: dict[int, list[int]] = {}
    for x in range(len(sets)):
        groups.setdefault(find(x), []).append(x)
    return [g for g in groups.values() if len(g) > 1]


def join_block(sets: list[np.ndarray], sizes: np.ndarray, num: int = NUM, den: int = DEN) -> list[int]:
    """Component of each set (index of one of its members): a trie join in each prefix group."""
    roots = list(range(len(sets)))
    for group in prefix_groups(sets, sizes, num, den):
        trie = TrieJoin(num, den)
        group.sort(key=lambda i: sizes[i])
        for i in group:
            trie.add(sets[i].tolist(), int(sizes[i]))
        for k, i in enumerate(group):
            roots[i] = group[trie.find(k)]
    return roots


def digests(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, text_hash, n_shingles, v) of each row; v is the class of its set, null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, text, SLICE_BYTES):
            sets = shingle_sets(_texts(b.column(2)), shingle)
            v = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), v], names=["key", "text_hash", "n_shingles", "v"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, f"key {kind}, text_hash long, n_shingles long, v long")


def shingle_rows(df: DataFrame, text: str, shingle: int, *, head: tuple[int, int] | None = None, marked=None) -> DataFrame:
    """(shingle, v, n), dealt and sorted by shingle and class: all shingles, or the heads of sets; of all texts, or those whose ``_bit`` is marked."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(1).to_numpy()
                yield b.filter(pa.array(marked.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))

        seen: set[int] = set()  # a class goes out once a task, so a group of copies sends one set a task
        for b in rows_of(batches if marked is None else wanted(), text, SLICE_BYTES):
            sets, classes, sizes = [np.zeros(0, np.uint64)], [], []
            for s in shingle_sets(_texts(b.column(0)), shingle):
                v = class_of(s)
                if len(s) and v not in seen:
                    seen.add(v)
                    sets.append(s[: int(head_sizes(len(s), *head)[0])] if head else s)
                    classes.append(v)
                    sizes.append(len(s))
            if len(seen) > SEEN:
                seen.clear()
            each = np.array([len(s) for s in sets[1:]], np.int64)
            cols = np.concatenate(sets).view(np.int64), np.repeat(np.array(classes, np.int64), each), np.repeat(np.array(sizes, np.int32), each)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shingle", "v", "n"])

    rows = df.select(text, *(["_bit"] if marked is not None else [])).mapInArrow(cut, "shingle long, v long, n int")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "v")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shingle, v, n, classes of the shingle) of shingles with two classes or more."""
    for (s, v, n), hot in runs(batches, HOT):
        if hot:
            counts = np.full(len(s), HOT)
        else:
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])])
            s, v, n = s[new], v[new], n[new]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            each = np.diff(np.concatenate([first, [len(s)]]))
            counts = np.repeat(each, each)
        some = counts > 1
        yield s[some], v[some], n[some], counts[some]


def possible_classes(df: DataFrame, text: str, shingle: int, num: int, den: int) -> DataFrame:
    """(v): classes whose heads share as many shingles with others' as a link takes; all that link are among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v, n, _ in _counted(batches):
            classes, first, c = np.unique(v, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(n[first]), pa.array(c)], names=["v", "n", "c"])

    sums = shingle_rows(df, text, shingle, head=(num, den)).mapInArrow(count, "v long, n int, c long").groupBy("v").agg(F.first("n").alias("n"), F.sum("c").alias("c"))
    least = lambda n: F.floor((n.cast("long") * num + den - 1) / den)
    return sums.where(F.col("c") >= F.greatest(F.lit(1), least(F.col("n")) - least(least(F.col("n"))))).select("v")


def shared_shingles(df: DataFrame, text: str, shingle: int, marked=None) -> DataFrame:
    """(v, n, place): the shingles that two classes or more have, with their places in the global order; a pair may repeat."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, v, n, counts in _counted(batches):
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n), pa.array(ordered(s, counts))], names=["v", "n", "place"])

    return shingle_rows(df, text, shingle, marked=marked).mapInArrow(place, "v long, n int, place long")


def marks(spark: SparkSession, wanted: DataFrame):
    """(bits, broadcast bitmap) over a hash of (key, text_hash): what the second pass reads; made on the executors, in pieces of 4 KB."""
    bits = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(1 + MARK_BITS * wanted.count()))))
    bit = F.pmod(F.xxhash64("key", "text_hash"), F.lit(bits))
    made = wanted.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).toArrow()
    marked = np.zeros(bits // 8, np.uint8)
    for k, x in zip(made.column("bucket").to_pylist(), made.column("bits").to_pylist(), strict=True):
        marked[k * 4096 : (k + 1) * 4096] = np.frombuffer(x, np.uint8)
    return bits, spark.sparkContext.broadcast(marked)


def candidate_sets(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(v, n, m, places, prefix): sets with enough shared shingles to link, these in order, and their rarest ones."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (v, place, n), _ in runs(batches):
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (place[1:] != place[:-1])])
            v, place, n = v[new], place[new], n[new]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            m = np.diff(np.concatenate([first, [len(v)]]))
            spare = m - least_overlap(n[first].astype(np.int64), num, den)
            chosen = np.flatnonzero(spare >= 0)
            parts = [place[a : a + k] for a, k in zip(first[chosen].tolist(), m[chosen].tolist(), strict=True)]
            prefix = [x[len(x) - 1 - k :] for x, k in zip(parts, spare[chosen].tolist(), strict=True)]
            at = first[chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[at]), pa.array(n[at]), pa.array(m[chosen]), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["v", "n", "m", "places", "prefix"],
            )

    rows = shared.select("v", "place", "n").repartition("v").sortWithinPartitions("v", "place")
    return rows.mapInArrow(gather, "v long, n int, m long, places binary, prefix array<long>")


def blocks_of(spark: SparkSession, candidates: DataFrame) -> DataFrame:
    """(v, block): sets that meet in prefix shingles, directly or through others; sets that meet none do not occur."""
    postings = candidates.select("v", F.explode("prefix").alias("place"))
    least = postings.groupBy("place").agg(F.min("v").alias("least"), F.max("v").alias("_most")).where("least < _most").drop("_most")
    edges = postings.join(least, "place").where("v != least").select("v", "least")
    return connected_components(spark, edges, "v", "least", name="blocks").select(F.col("vertex").alias("v"), F.col("root").alias("block"))


def deal(candidates: DataFrame, blocks: DataFrame, num: int, den: int, block_shingles: int, size: int) -> DataFrame:
    """(block, v, n, places, task): small blocks several to a task; large ones a task for each length band, or for each pair of a band's chunks."""
    members = candidates.select("v", "n", "m").join(blocks, "v")
    weights = members.groupBy("block").agg(F.sum("m").alias("_weight"))
    # Sets that link are in one band or in neighbours, so each set of a large block is in two of them.
    edges = F.array(*[F.lit(b) for b in bands(num, den)])
    band = F.size(F.filter(edges, lambda b: b <= F.col("n")))
    large = F.col("_weight") > block_shingles
    spread = members.join(weights, "block").withColumn("_band", F.explode(F.when(large, F.array(band, band + 1)).otherwise(F.array(F.lit(0)))))
    heavy = spread.groupBy("block", "_band").agg(F.sum("m").alias("_heavy"))
    spread = spread.join(heavy, ["block", "_band"]).withColumn("_chunks", F.when(large, F.ceil(F.col("_heavy") / block_shingles)).otherwise(F.lit(1)).cast("long"))
    spread = spread.withColumn("_c", F.pmod(F.xxhash64("v"), F.col("_chunks") * 2))
    buckets = max(1, math.ceil(size * 16 / block_shingles))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_chunks") * 2 - 1), lambda c: c != F.col("_c"))
    pairs = F.transform(others, lambda c: F.xxhash64("block", "_band", F.least(c, F.col("_c")), F.greatest(c, F.col("_c"))))
    tasks = F.when(~large, F.array(F.pmod(F.xxhash64("block"), F.lit(buckets)))).when(F.col("_chunks") == 1, F.array(F.xxhash64("block", "_band"))).otherwise(pairs)
    return candidates.select("v", "n", "places").join(spread.select("v", "block", F.explode(tasks).alias("task")), "v")


def links_of(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that span the components within each task and block."""

    def link(t: pa.Table) -> pa.Table:
        by_block: dict[int, list[int]] = {}
        for i, x in enumerate(t.column("block").to_pylist()):
            by_block.setdefault(x, []).append(i)
        classes, raw, sizes = t.column("v").to_numpy(), t.column("places").to_pylist(), t.column("n").to_numpy().astype(np.int64)
        a, b = [], []
        for own in by_block.values():
            own.sort(key=lambda i: classes[i])
            for i, r in enumerate(join_block([np.frombuffer(raw[i], np.int64) for i in own], sizes[own], num, den)):
                if r != i:
                    a.append(classes[own[i]])
                    b.append(classes[own[r]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.select("block", "v", "n", "places", "task").groupBy("task").applyInArrow(link, "a long, b long")


def join_components(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, text_hash, n_shingles, component_id) per row; component_id is the least key reachable by links.

    Null, empty and wordless texts have no shingles and are linked with
    nothing.  Rows with a null key have a null component and lend no link.
    Repeated rows are copies of one another.  An empty table stays empty.
    """
    rows = stage(spark, digests(df, key, text, shingle), "digests")
    keyed = df.where(F.col(key).isNotNull())
    possible = stage(spark, possible_classes(keyed, text, shingle, num, den), "possible")
    one_each = rows.where("key is not null").join(possible, "v", "left_semi").groupBy("v").agg(F.min(F.struct("key", "text_hash")).alias("one")).select("one.*")
    wanted = stage(spark, one_each, "wanted")
    bits, marked = marks(spark, wanted)
    unstage(spark, possible, wanted)
    again = keyed.select(text, F.pmod(F.xxhash64(key, F.xxhash64(text)), F.lit(bits)).alias("_bit"))
    candidates = stage(spark, candidate_sets(shared_shingles(again, text, shingle, marked), num, den), "candidates")
    unstage(spark)
    size = candidates.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    blocks = stage(spark, blocks_of(spark, candidates), "blocks")
    links = stage(spark, links_of(deal(candidates, blocks, num, den, block_shingles, size), num, den), "links")
    unstage(spark, candidates, blocks)
    roots = connected_components(spark, links, name="linked")
    # The least key of each class, then of each component.
    classes = rows.where("key is not null and v is not null").groupBy("v").agg(F.min("key").alias("_k"))
    placed = classes.join(roots.withColumnRenamed("vertex", "v"), "v", "left").select("v", F.coalesce("root", "v").alias("root"), "_k")
    found = placed.join(placed.groupBy("root").agg(F.min("_k").alias("_component")), "root").select("v", "_component")
    component = F.when(F.col("n_shingles") == 0, F.col("key")).when(F.col("key").isNotNull(), F.col("_component"))
    return rows.join(found, "v", "left").select(F.col("key").alias(key), "text_hash", "n_shingles", component.alias("component_id"))


def keep_one(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one document of each component left: the one of the least key.

    Rows without shingles and rows with a null key stay.  Of repeated rows one
    stays.  Columns of any name pass through as they were.
    """
    box = sealed(df)
    key, text = box.name(key), box.name(text)
    judged = stage(spark, join_components(spark, box.df, key, text, **options), "judged")
    stays = judged.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_stay"), F.col("text_hash").alias("_stay_hash")).distinct()
    marked = box.df.withColumn("_hash", F.xxhash64(text))
    kept = marked.where(F.col(key).isNotNull()).join(stays, (F.col(key) == F.col("_stay")) & (F.col("_hash") == F.col("_stay_hash")), "left_semi").dropDuplicates([key, "_hash"])
    return box.open(kept.unionByName(marked.where(F.col(key).isNull())))
