"""SimHash near-duplicates: sharded BK-trees over 64-bit fingerprints."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

#: Shingles whose bits are counted at once.
STEP = 1 << 14


def fingerprint(text: bytes | None, width: int, seed: int = 42) -> int:
    """SimHash of word shingles: bit i is set where over half of the shingles' XXH64 values have it.

    A-Z are lower-cased; words are runs without ASCII white space, joined by one space. Fewer words
    than ``width``: the whole sequence is the one shingle. No word or null: 0. A text of any length
    is hashed whole, ``STEP`` shingles at a time.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, STEP):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(first[k : k + STEP], last[k : k + STEP], strict=True)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, fp)``; fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _split(free: tuple[int, ...], parts: int) -> list[tuple[int, tuple[int, ...]]]:
    """Blocks of the free bit positions as (mask, positions left)."""
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [(sum(1 << i for i in free[a:b]), free[:a] + free[b:]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_masks(radius: int, depth: int) -> dict[int, list[int]]:
    """Mask to the masks that refine it, ``depth`` times from 0.

    Fingerprints at most ``radius`` bits apart agree on one of radius + 1 blocks of whatever bits
    are left, so each refinement keeps every such pair together in some shard.
    """
    out: dict[int, list[int]] = {}
    level = {0: tuple(range(64))}
    for _ in range(depth):
        following = {}
        for mask, free in level.items():
            out[mask] = []
            for more, left in _split(free, radius + 1):
                out[mask].append(mask | more)
                following[mask | more] = left
        level = following
    return out


class ShardTree:
    """BK-tree of one shard: children are keyed by their distance to the parent; a search follows only edges within the radius.

    Groups of linked values are kept by union-find. A subtree known to lie in the searcher's own
    group is not entered again: its links add nothing to that group. So a dense group of near
    copies costs about one path per value rather than all pairs. ``linked`` has the last word on whether
    two values (by their numbers) within the radius link; it is asked only where that would join two groups.
    """

    def __init__(self, radius: int, linked: Callable[[int, int], bool] | None = None) -> None:
        self.linked = linked
        self.radius, self.value, self.kids, self.parent, self.mixed = radius, [], [], [], []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, value: int) -> None:
        r, me = self.radius, len(self.value)
        self.value.append(value)
        self.kids.append({})
        self.parent.append(me)
        self.mixed.append(False)
        if not me:
            return
        stack, seen = [0], []
        while stack:
            x = stack.pop()
            if not self.mixed[x] and self.find(x) == self.find(me):
                continue
            d = (self.value[x] ^ value).bit_count()
            if d <= r:
                a, b = self.find(x), self.find(me)
                if a != b and (self.linked is None or self.linked(x, me)):
                    self.parent[max(a, b)] = min(a, b)
            kids = self.kids[x]
            seen.append(x)
            if len(kids) <= 2 * r + 1:
                stack += [k for e, k in kids.items() if -r <= e - d <= r]
            else:
                stack += [kids[e] for e in range(d - r, d + r + 1) if e in kids]
        for x in reversed(seen):  # children come after their parents
            if self.mixed[x]:
                own = self.find(x)
                self.mixed[x] = any(self.mixed[k] or self.find(k) != own for k in self.kids[x].values())
        x, mine = 0, self.find(me)
        while True:
            if self.find(x) != mine:
                self.mixed[x] = True
            e = (self.value[x] ^ value).bit_count()
            if e not in self.kids[x]:
                self.kids[x][e] = me
                return
            x = self.kids[x][e]


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(shard: list[int]) -> tuple[list[int], list[int]]:
            tree = ShardTree(radius)
            for v in shard:
                tree.add(v & 0xFFFFFFFFFFFFFFFF)
            roots = [tree.find(i) for i in range(len(shard))]
            pairs = [(shard[r], v) for r, v, i in zip(roots, shard, range(len(shard)), strict=True) if r != i]
            return [a for a, _ in pairs], [b for _, b in pairs]

        open_key, shard = None, []
        for b in batches:
            mask, key, fp = (np.asarray(b.column(i)) for i in range(3))
            if not len(fp):
                continue
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            a_out, b_out = [], []
            # Shards of one value have no links; the last one of a batch may go on in the next.
            keep = (ends - starts > 1) | (ends == len(fp)) | (starts == 0)
            for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
                if s > 0 or (int(mask[s]), int(key[s])) != open_key:
                    for out, x in zip((a_out, b_out), links(shard), strict=True):
                        out += x
                    open_key, shard = (int(mask[s]), int(key[s])), []
                shard += fp[s:e].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
        a_out, b_out = links(shard)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 3, shard_rows: int = 65536) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct ``fp`` values at most ``radius`` bits apart.

    Each value goes to a bounded number of shards, (radius + 1) squared, of values that agree on
    the shard's bits; a BK-tree is built and searched in the task of its shard. All trees together
    grow with the corpus, so they travel by shuffle; nothing is broadcast. A shard over
    ``shard_rows`` is refined by another block of bits until at most 16 bits are free, which bounds
    any tree at 65,536 values. Linked values come out as one star per group and shard, not as pairs.
    """
    masks = shard_masks(radius, 5)
    second = [m for k in masks[0] for m in masks[k]]
    fp = F.col("fp")
    key = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("key"))
    shards = distinct.select("fp", F.explode(F.array(*[key(m) for m in second])).alias("s")).select("s.mask", "s.key", "fp")
    for _ in range(3):
        big = materialize(shards.groupBy("mask", "key").count().where(F.col("count") > shard_rows).select("mask", "key"), "big")
        if big.isEmpty():
            break
        finer = F.create_map(*[x for m, subs in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        split = shards.join(big, ["mask", "key"], "left_semi").select("fp", F.explode(finer[F.col("mask")]).alias("mask")).select("mask", fp.bitwiseAND(F.col("mask")).alias("key"), "fp")
        shards = shards.join(big, ["mask", "key"], "left_anti").unionByName(split)
    dealt = shards.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 3) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, fingerprint, component_id, class_id)``: one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, ``class_id`` the smallest doc_id with the same fingerprint, ``fingerprint`` 16 hex digits.
    Copies collapse to their fingerprint before any search. Null and empty texts have fingerprint
    zero and link like any other; rows with a null id are kept, without being anyone's smallest id.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), radius))
    classes = classes.join(roots, classes.fp == roots.node, "left").select("fp", "class_id", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    known = classes.join(least, "root").select("fp", "class_id", "component_id")
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_id")


#: 64-bit words of a wide fingerprint, and how many of them also give a least value to shard by.
WORDS, LEASTS = 16, 10
#: What is taken off the ends of a word before it is compared.
EDGES = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def shingle_hashes(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles. A-Z are lower-cased and ASCII punctuation goes from both ends of a word, unless it is the whole word."""
    import xxhash

    words = [w.strip(EDGES) or w for w in (text or b"").lower().split()]
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], 42) for i, j in zip(first, last, strict=True)], np.uint64))


def wide_fingerprint(base: np.ndarray) -> tuple[bytes, list[int]]:
    """SimHash of shingle hashes in ``64 * WORDS`` bits, and the least value of each of ``LEASTS`` hash functions.

    Word ``k`` of the fingerprint counts the bits of the k-th remixed hash of every shingle. No shingle: all zero.
    """
    if not len(base):
        return bytes(8 * WORDS), [0] * LEASTS
    counts = np.zeros(64 * WORDS, np.int64)
    least = np.full(LEASTS, np.iinfo(np.uint64).max, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, WORDS + 1, dtype=np.uint64)
    for at in range(0, len(base), STEP):
        x = base[at : at + STEP, None] + step
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        least = np.minimum(least, x[:, :LEASTS].min(axis=0))
        for k in range(0, len(x), 255):  # counts of 255 rows fit a byte
            bits = np.unpackbits(x[k : k + 255].view(np.uint8), axis=1)
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(base)).tobytes(), least.view(np.int64).tolist()


def text_key() -> Column:
    """16 bytes that stand for a whole text; null text is empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def set_key(base: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    import xxhash

    return xxhash.xxh3_128_digest(base.tobytes())


def wide_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, text_key, node, fp, least)`` of every row. ``text_key`` is the MD5 of the text, ``node`` stands for its set of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [shingle_hashes(t, width) for t in part.column(2).to_pylist()]
                made = [wide_fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(set_key, sets), pa.binary()), pa.array([f for f, _ in made], pa.binary()), pa.array([x for _, x in made], pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "fp", "least"])

    return docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, text_key binary, node binary, fp binary, least array<long>")


def shingle_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """``(node, shingles)`` of each ``text``: the sorted hashes of the distinct shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                sets = [shingle_hashes(t, width) for t in b.column(0).slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node binary, shingles binary")


def radius_for(similarity: float, slack: float = 6.5) -> int:
    """Differing bits of a wide fingerprint at a cosine of shingle sets, and ``slack`` standard deviations more.

    Three are enough for long texts; in sets of four and five shingles half of the bits are near ties.
    """
    n, p = 64 * WORDS, math.acos(similarity) / math.pi
    return round(n * p + slack * math.sqrt(n * p * (1 - p)))


def _stars(ids: list[bytes], tree: ShardTree) -> Iterator[pa.RecordBatch]:
    """The groups of a tree as links from each member to the group's first."""
    pairs = [(ids[root], node) for i, node in enumerate(ids) if (root := tree.find(i)) != i]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*pairs, strict=True)], ["a", "b"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in b.slice(k, 1024).columns), strict=True)


def _wide_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in groupby(_rows(batches), lambda r: r[:3]):
            tree, ids = ShardTree(radius), []
            for *_, node, fp in shard:
                tree.add(int.from_bytes(fp, "big"))
                ids.append(node)
            yield from _stars(ids, tree)

    return run


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the cosine of two sorted sets, shared over the root of the product of their sizes, is that high."""
    least = similarity * math.sqrt(len(a) * len(b)) - 1e-9
    return min(len(a), len(b)) >= least and len(np.intersect1d(a, b, assume_unique=True)) >= least


def _alike_links(radius: int, similarity: float):
    """Links of rows ``(key, part, node, fp, shingles)`` whose shingle sets are alike to ``similarity`` or more; trees find the pairs to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in groupby(_rows(batches), lambda r: r[:2]):
            ids, sets = [], []
            tree = ShardTree(radius, lambda i, j, sets=sets: alike(sets[i], sets[j], similarity))
            for *_, node, fp, shingles in shard:
                ids.append(node)
                sets.append(np.frombuffer(shingles, np.uint64))
                tree.add(int.from_bytes(fp, "big"))
            yield from _stars(ids, tree)

    return run


def in_block_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of groups of ``count`` dealt to blocks of half of ``limit``, once for each ``part``, a pair of blocks, so that any two rows meet."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("count") * 2 / limit)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).drop("blocks", "block", "other")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, shard_rows: int = 2048) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, text_key, node, group)``: texts whose sets of word shingles have a cosine of ``similarity`` or more.

    Cosine is what SimHash estimates: the share of differing bits is the angle of the sets over pi. For sets
    of one size 0.8 is a Jaccard similarity of two thirds. That is too many bits for shards that agree
    on bits, so fingerprints are wide and meet in shards that agree on two of ``LEASTS`` least shingle
    hashes: 1 in 1,500 pairs right at 0.8 share none. BK-trees of the shards give candidates within
    ``radius_for(similarity)``. What hangs together by them is brought together once more with its
    shingles, and only pairs that are alike by the sets themselves are linked. Groups of over
    ``shard_rows`` values, as of passages that many texts share, are dealt to pairs of blocks, so that every
    pair meets in one tree of bounded size. A value alone in its shard goes no further.

    ``text_key`` stands for the text, ``node`` for the set of its shingles and ``group`` for what is
    reachable over links. None depends on ids, so different texts of one id, or of none, keep apart.
    Texts with equal sets are copies; null and empty ones are copies of each other.
    """
    fps = materialize(wide_fingerprints(docs, width), "wide")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    known = materialize(fps.groupBy("node").agg(F.min("fp").alias("fp"), F.min("least").alias("least"), first), "wideclasses")
    pairs = [F.struct(F.lit(1 << i | 1 << j).alias("mask"), F.xxhash64(F.col("least")[i], F.col("least")[j]).alias("key")) for i, j in combinations(range(LEASTS), 2)]
    rows = known.select("node", F.explode(F.array(*pairs)).alias("s")).select("node", "s.mask", "s.key")
    shared = rows.groupBy("mask", "key").count().where("count > 1")
    rows = materialize(rows.join(shared, ["mask", "key"]).select("node", "mask", "key", "count"), "met")
    dealt = rows.where(F.col("count") <= shard_rows).select("node", "mask", "key", F.lit(0).cast("long").alias("part"))
    large = in_block_pairs(rows.where(F.col("count") > shard_rows), shard_rows).select("node", "mask", "key", "part")
    dealt = dealt.unionByName(large).join(known.select("node", "fp"), "node").select("mask", "key", "part", "node", "fp")
    links = dealt.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part", "node").mapInArrow(_wide_links(radius_for(similarity)), "a binary, b binary")
    # What hangs together by the estimate is brought together once more, with its shingles, and linked by those.
    groups = connected_components(links)
    groups = groups.join(groups.groupBy("root").count(), "root").select("node", F.col("root").alias("key"), "count")
    dealt = groups.where(F.col("count") <= shard_rows).select("node", "key", F.lit(0).cast("long").alias("part"))
    dealt = dealt.unionByName(in_block_pairs(groups.where(F.col("count") > shard_rows), shard_rows).select("node", "key", "part"))
    # One row of each set reads its text again.
    reads = known.join(groups.select("node"), "node", "left_semi").select(F.col("first.doc_id").alias("_i"), F.col("first.text_key").alias("_k"))
    read = docs.select("doc_id", "text", text_key().alias("_key")).join(reads, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left_semi")
    sets = shingle_sets(read, width).dropDuplicates(["node"])
    dealt = dealt.join(materialize(sets, "shingles"), "node").join(known.select("node", "fp"), "node").select("key", "part", "node", "fp", "shingles")
    links = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_alike_links(radius_for(similarity), similarity), "a binary, b binary")
    roots = connected_components(links)
    return fps.select("doc_id", "text_key", "node").join(roots, "node", "left").select("doc_id", "text_key", "node", F.coalesce("root", "node").alias("group"))
