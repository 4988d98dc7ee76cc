"""Repeated byte strings by a run-length index over the contexts that could hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize, table_mark

#: Bytes of the anchors that stand for windows, text positions handled at once, and bytes indexed together.
GRAM, STEP, BLOCK = 40, 1 << 22, 1 << 16
#: Contexts of one group that are indexed together in one task; larger groups are dealt anew by more of the bytes their windows share.
TOGETHER = 512
#: Windows of one piece when contexts are dealt anew, and when pieces are: at last a piece is one window.
PIECE = 20
#: Bits of the maps that spare shuffling rows without a partner (16 MB when all are in use).
MAP_BITS = 1 << 27


def gram_hashes(b: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while size < q:
        step = min(size, q - size)
        h = h[:-step] * np.uint64(pow(0xD1B54A32D192ED03, step, 1 << 64)) + h[step:]
        size += step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(first window, last window, place of the anchor, its hash, context digest) for runs of windows of ``length`` bytes that share an anchor.

    A window's anchor is its gram with the least hash, the leftmost of equals, so equal windows have
    equal anchors at equal places. The context of an anchor is all the bytes of its windows.
    """
    import xxhash

    whole = np.frombuffer(text, np.uint8)
    for base in range(0, max(0, len(text) - length + 1), STEP):
        part = whole[base : base + STEP + length - 1]
        h = gram_hashes(part, GRAM)
        low = np.uint64((1 << 24) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size, width = 1, length - GRAM + 1
        while size < width:
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [len(least)])) - 1
        at = (least[first] & low).astype(np.int64)
        digest = xxhash.xxh3_64_intdigest
        yield first + base, last + base, at + base, h[at], [digest(text[base + i : base + j + length], seed) for i, j, seed in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)]


def place(first, last, at):
    """A run of windows and its anchor as one number: fewer than 256 windows share an anchor."""
    return first << 16 | (last - first) << 8 | (at - first)


def windows_at(w: int) -> tuple[int, int, int]:
    """First window, last window and anchor of a ``place``."""
    return w >> 16, (w >> 16) + (w >> 8 & 255), (w >> 16) + (w & 255)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            for k in range(0, batch.num_rows, 64):
                rows = [(i, place(*x[:3]), *x[3:]) for i in range(k, min(k + 64, batch.num_rows)) for x in anchors(texts[i].as_py() or b"", length)]
                if rows:
                    take = pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]))
                    join = lambda c, kind: pa.array(np.concatenate([np.asarray(r[c], kind) for r in rows]).view(np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), join(1, np.int64), join(2, np.uint64), join(3, np.uint64)], ["doc_id", "dk", "w", "h", "c"])

    return run


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, with text positions sampled at both ends of every run.

    Suffixes are ordered to the end of their texts: a match that streams on from its seam is only found
    if neighbours have the longest match there is, not just one of some length. Suffixes of equal texts stand
    side by side before equal symbols, so equal texts are sorted once and lengthen the runs. What is kept are the
    runs: symbol and length of each, and at every seam between two the neighbouring text positions with
    what they have in common.
    """

    def __init__(self, texts: list[bytes]) -> None:
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
        sizes = np.fromiter(map(len, number), np.int64, len(number))
        starts = np.cumsum(sizes + 1) - sizes - 1
        copies = np.bincount(which, minlength=len(number))
        own = sizes[which]
        self.size, self.starts = int(own.sum()), np.cumsum(own) - own
        self._place = np.repeat(starts[which] - self.starts, own) + np.arange(self.size)
        # Zero ends each text; what follows it only decides between suffixes that are equal to their ends.
        data = np.frombuffer(b"\0".join([*number, b""]), np.uint8)
        ends, self._length = starts + sizes, len(data)
        there = np.bincount(data, minlength=256) > 0
        symbols = np.cumsum(there)[data]
        symbols[ends] = 0
        order, self._levels, self._key, self._bits = self._order(symbols, int(there.sum()).bit_length(), int(sizes.max(initial=0)))
        order = order[len(number) :]  # without the ends
        bwt = symbols[order - 1]
        # A text's first byte has nothing before it: such a row is a run of its own.
        heads = np.flatnonzero(np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)))[: len(bwt)])
        texts_at = np.repeat(np.arange(len(number)), sizes + 1)
        lengths = np.add.reduceat(copies[texts_at[order]], heads) if len(heads) else heads
        each = np.where(bwt[heads] == 0, lengths, 1)
        self.run_symbols, self.run_lengths = np.repeat(bwt[heads], each), np.repeat(lengths // np.maximum(each, 1), each)
        upper, lower = order[heads[1:] - 1], order[heads[1:]]
        room = np.minimum(ends[texts_at[upper]] - upper, ends[texts_at[lower]] - lower)
        twice = starts[copies > 1]  # the seam between a text and its copy
        self.upper, self.lower = np.concatenate((upper, twice)), np.concatenate((lower, twice))
        self.common = np.concatenate((np.minimum(self._common(upper, lower), room), sizes[copies > 1]))
        del self._levels, self._key

    @staticmethod
    def _order(symbols: np.ndarray, bits: int, longest: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray, int]:
        """Suffixes in order of at least ``longest`` symbols, ranks by fewer symbols as ``(symbols, how often to the next, ranks)``, the first symbols as numbers, and the bits of one.

        After the first sort only ties are sorted on, by the ranks of what follows, as many ranks as fit a number.
        """
        n, bits = len(symbols), max(1, bits)
        depth = 63 // bits
        key, have = symbols.astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)
            follows = np.zeros(n, np.int64)
            follows[: max(0, n - have)] = key[have:] >> bits * (have - step)
            key = key << bits * step | follows
            have += step
        order = np.argsort(key)
        in_order = key[order]
        fresh = np.concatenate(([True], in_order[1:] != in_order[:-1]))[:n]
        heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = heads
        slots = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))[:n]))
        width, levels = n.bit_length(), []
        ranks = max(2, 63 // width)
        while len(slots):
            levels.append((depth, ranks - 1, rank))
            if depth > longest:
                break
            tied = order[slots]
            old = rank[tied]
            sub = old
            for k in range(1, ranks):
                sub = sub << width | rank[np.minimum(tied + k * depth, n - 1)]
            new = np.argsort(sub)
            tied, sub = tied[new], sub[new]
            fresh = np.concatenate(([True], sub[1:] != sub[:-1]))
            order[slots] = tied
            rank = rank.copy()
            rank[tied] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
            depth *= ranks
        return order, levels, key, bits

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at pairs of positions, right as far as both texts go: by the ranks, then by the first symbols."""
        total, last = np.zeros(len(a), np.int64), len(self._key) - 1
        for depth, times, rank in reversed(self._levels):
            for _ in range(times):
                total += depth * (rank[np.minimum(a + total, last)] == rank[np.minimum(b + total, last)])
        differ = self._key[np.minimum(a + total, last)] ^ self._key[np.minimum(b + total, last)]
        return total + sum((differ < 1 << self._bits * k).astype(np.int64) for k in range(63 // self._bits))

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every position with any other position of the texts.

        Within a run, neighbours in suffix order continue a match that began one byte earlier, so
        matches are known at the seams and streamed from left to right, one byte shorter a step.
        """
        longest = np.zeros(self._length, np.int64)
        np.maximum.at(longest, self.upper, self.common)
        np.maximum.at(longest, self.lower, self.common)
        # max over earlier j of longest[j] - (i - j); a match never passes the end of its text
        step = np.arange(self._length)
        return np.maximum(np.maximum.accumulate(longest + step) - step, 0)[self._place]


def _index_rows(length: int):
    """Rows ``(g, c, side, ctx)``, groups together, to ``(g, c, from, to)``: the windows of each context that another one of its block holds as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts: list[tuple[pa.Array, pa.Array, list[bytes]]]) -> pa.RecordBatch:
            g, c = (pa.concat_arrays([p[k] for p in parts]) for k in (0, 1))
            index = RunIndex([ctx for p in parts for ctx in p[2]])
            # No match passes the end of its context, so the last windows' edges stay inside as well.
            long = (index.matching_statistics() >= length).view(np.int8)
            edge = np.flatnonzero(np.diff(long, prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)
            row = np.searchsorted(index.starts, edge[:, 0], "right") - 1
            at = edge - index.starts[row][:, None]
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([g.take(take), c.take(take), pa.array(at[:, 0]), pa.array(at[:, 1] - 1)], ["g", "c", "from", "to"])

        parts, size, last = [], 0, None
        for batch in batches:
            (g, c), texts, begin = batch.columns[:2], batch.column(3).to_pylist(), 0
            add = lambda a, b: parts.append((g.slice(a, b - a), c.slice(a, b - a), texts[a:b]))  # noqa: B023, E731
            group, upto = g.to_numpy(), np.cumsum([0, *map(len, texts)]).tolist()
            firsts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]).tolist()
            for a, b in zip(firsts, [*firsts[1:], len(group)], strict=True):
                if size >= BLOCK and group[a] != last:
                    add(begin, a)
                    yield solve(parts)
                    parts, size, begin = [], 0, a
                size += upto[b] - upto[a]
                last = group[a]
            add(begin, len(group))
        if size:
            yield solve(parts)

    return run


def _contexts(length: int, piece: int):
    """Cut wanted contexts out of texts, to ``(h, c, off, g, c2, side, ctx)``: whole (``piece`` 0), or by ``piece`` windows with the same distances to the anchor.

    All windows of a piece hold the ``length - piece + 1`` bytes that give its group ``g``, so equal windows
    are in pieces of one group. ``off`` is the piece's first window, counted from the context's.
    """
    import xxhash

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                out = [[] for _ in range(7)]
                for doc, dk, text, wanted in zip(*(c.slice(k, 16).to_pylist() for c in batch.columns), strict=True):
                    if (doc, dk) == last:  # a repeated row, next to its like
                        continue
                    last = (doc, dk)
                    for x in wanted:
                        lo, hi, at = windows_at(x["w"])
                        if piece:
                            parts = []
                            for p in range((at - hi) // piece, (at - lo) // piece + 1):
                                a, b = max(lo, at - piece * p - piece + 1), min(hi, at - piece * p)
                                core = text[at - piece * p : at - piece * p - piece + 1 + length]
                                ctx = text[a : b + length]
                                parts.append((a - lo, signed(xxhash.xxh3_64_intdigest(core, p)), signed(xxhash.xxh3_64_intdigest(ctx, at - a)), ctx))
                        else:
                            parts = [(0, x["h"], x["c"], text[lo : hi + length])]
                        for off, g, c2, ctx in parts:
                            for column, y in zip(out, (x["h"], x["c"], off, g, c2, x["side"], ctx), strict=True):
                                column.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(out[5], pa.int32()), pa.array(out[6], pa.binary())], ["h", "c", "off", "g", "c2", "side", "ctx"])

    return run


_PIECES = "h long, c long, off long, g long, c2 long, side int, ctx binary"


def _single_windows(length: int):
    """Pieces cut on to windows of their own, each in the group of its digest."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = [[] for _ in range(7)]
                for h, c, off, _, _, side, ctx in zip(*(x.to_pylist() for x in batch.slice(k, 256).columns), strict=True):
                    for i in range(len(ctx) - length + 1):
                        window = ctx[i : i + length]
                        g, c2 = np.frombuffer(xxhash.xxh3_128_digest(window), np.int64).tolist()
                        for column, y in zip(out, (h, c, off + i, g, c2, side, window), strict=True):
                            column.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(out[5], pa.int32()), pa.array(out[6], pa.binary())], ["h", "c", "off", "g", "c2", "side", "ctx"])

    return run


def _map(keys: DataFrame, *cols: str) -> DataFrame:
    """A bit map of the hashed keys, in pieces of 4 KB: at most ``MAP_BITS`` bits however many keys there are."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(MAP_BITS))
    return keys.select(F.floor(slot / 32768).cast("int").alias("_piece"), (slot % 32768).alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _perhaps(rows: DataFrame, bits: DataFrame, *cols: str) -> DataFrame:
    """Rows whose key may be in the map; an exact join decides afterwards. The map has a fixed largest size, so it is broadcast."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(MAP_BITS))
    found = rows.join(F.broadcast(bits), F.floor(slot / 32768).cast("int") == F.col("_piece"))
    byte = F.conv(F.hex(F.substring("_bits", ((slot % 32768) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return found.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))) != 0).drop("_piece", "_bits")


def _indexed(rows: DataFrame, length: int) -> DataFrame:
    """``(g, c, side, ctx)`` through run-length indexes, whole groups to a task."""
    dealt = rows.repartition("g").sortWithinPartitions("g", "c", "side").dropDuplicates(["g", "c", "side"])
    return dealt.sortWithinPartitions("g", "c", "side").mapInArrow(_index_rows(length), "g long, c long, from long, to long")


def _dealt_anew(pieces: DataFrame, length: int, further: bool) -> DataFrame:
    """``(h, c, off, g, c2, side, ctx)`` to ``(h, c, from, to)``. Pieces that are alike go to the index twice, as a repeat there is one there as well; groups of one piece go."""
    pieces = materialize(pieces, "pieces")
    one = pieces.groupBy("g", "c2").agg(F.count("*").alias("n"))
    groups = materialize(one.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("n > 1"), "groups")
    small = groups.where(F.col("k") <= TOGETHER).select("g") if further else groups.select("g")
    at = F.struct("h", "c", "off", "side")
    both = pieces.join(small, "g").groupBy("g", "c2").agg(F.min(F.struct(at, "ctx")).alias("a"), F.max(F.struct(at, "ctx")).alias("b"), F.count("*").alias("n"))
    rows = both.select("g", F.col("c2").alias("c"), F.posexplode(F.when(F.col("n") > 1, F.array("a.ctx", "b.ctx")).otherwise(F.array("a.ctx"))).alias("side", "ctx"))
    found = _indexed(rows, length).distinct().withColumnRenamed("c", "c2")
    out = pieces.select("h", "c", "off", "g", "c2").join(found, ["g", "c2"]).select("h", "c", (F.col("off") + F.col("from")).alias("from"), (F.col("off") + F.col("to")).alias("to"))
    if further:
        large = groups.where(F.col("k") > TOGETHER).select("g")
        if not large.isEmpty():
            finer = pieces.join(large, "g", "left_semi").select("h", "c", "off", "g", "c2", "side", "ctx").mapInArrow(_single_windows(length), _PIECES)
            out = out.unionByName(_dealt_anew(finer, length, False))
    return out


def repeated_ranges(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(doc_id, dk, text as bytes)`` to ``(doc_id, dk, a, b)``: byte ranges covered by windows that also start elsewhere.

    1. Windows are grouped by their anchors: one narrow row per run of windows, about one for 80 bytes.
    2. Anchors are counted, before and after the shuffle; those seen once hold no repeat and go.
    3. The distinct contexts of every other anchor are read and indexed together; of a context found more
       than once the last is read as well as the first, so the index finds that repeat too. Matching
       statistics mark the windows that another context holds.
    4. Anchors with more than ``TOGETHER`` contexts are cut into pieces of ``PIECE`` windows, grouped by the bytes
       that all windows of a piece share, and groups that are still that large into single windows. These
       go through the index like any other, so no task has an anchor of unbounded size to itself, and what is found is the same.

    Contexts are told apart by anchor hash and digest, 128 bits. Joins on frequent anchors are left to adaptive skew splitting.
    """
    spark, mark = docs.sparkSession, table_mark()
    rows = materialize(docs.mapInArrow(_anchor_rows(length), "doc_id long, dk binary, w long, h long, c long"), "anchors")
    seen = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "seen")
    again = materialize(_perhaps(rows, _map(seen, "h"), "h").join(seen, "h"), "again")
    drop_tables(spark, mark, keep=1)
    mark = table_mark()
    row = F.struct("doc_id", "dk", "w")
    contexts = again.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(row).alias("first"), F.max(row).alias("last"))
    sides = F.when(F.col("m") > 1, F.array("first", "last")).otherwise(F.array("first"))
    contexts = materialize(contexts.select("h", "c", F.posexplode(sides).alias("side", "x")).select("h", "c", "side", "x.*"), "contexts")
    large = materialize(contexts.groupBy("h").count().where(F.col("count") > TOGETHER).select("h"), "large")

    def cut(wanted: DataFrame, piece: int) -> DataFrame:
        per_doc = wanted.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("h", "c", "side", "w")).alias("wanted"))
        texts = _perhaps(docs, _map(wanted, "doc_id", "dk"), "doc_id", "dk")
        joined = texts.join(per_doc.withColumnsRenamed({"doc_id": "_i", "dk": "_k"}), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("dk") == F.col("_k")))
        return joined.select("doc_id", "dk", "text", "wanted").mapInArrow(_contexts(length, piece), _PIECES)

    whole = cut(contexts.join(large, "h", "left_anti"), 0).select("g", "c", "side", "ctx")
    found = _indexed(whole, length).withColumnRenamed("g", "h")
    if not large.isEmpty():
        found = found.unionByName(_dealt_anew(cut(contexts.join(large, "h", "left_semi"), PIECE), length, True))
    # Written down, so that the join is one of two plain shuffles, whose frequent keys can be split.
    found = materialize(found.groupBy("h", "c").agg(F.collect_set(F.struct("from", "to")).alias("hits")), "found")
    drop_tables(spark, mark, keep=1)
    part = again.join(found, ["h", "c"]).select("doc_id", "dk", F.shiftright("w", 16).alias("lo"), F.explode("hits").alias("x"))
    return part.select("doc_id", "dk", (F.col("lo") + F.col("x.from")).alias("a"), (F.col("lo") + F.col("x.to") + length).alias("b"))


def _cut_out(text: bytes, ranges: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal runs taken out."""
    spans: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join(kept) + text[at:], [(a, b) for a, b in spans]


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, spans, left = [], [], [], []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, cuts = _cut_out(text or b"", ranges)
            n.append(len(text or b""))
            removed.append(n[-1] - len(kept))
            spans.append([{"start": a, "end": b} for a, b in cuts])
            left.append(kept)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept)``.

    Each byte covered by a string of ``length`` bytes (40 to 224) that starts at another place too, in
    the same text or another, is removed; all are judged on the input. Matches never cross texts.
    ``spans`` are the maximal removed byte ranges, ``kept`` the remaining bytes (which need not be
    UTF-8). Rows are told apart by id and MD5 of the text, so different texts of one id, or of none, are
    judged each for itself. Null text is empty; a repeated row is a repeat; texts shorter than ``length`` stay.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("dk"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    mark = table_mark()
    ranges = materialize(repeated_ranges(d, length).distinct(), "ranges")
    drop_tables(docs.sparkSession, mark, keep=1)
    hit = _map(ranges, "doc_id", "dk")
    slot = F.pmod(F.xxhash64("doc_id", "dk"), F.lit(MAP_BITS))
    byte = F.conv(F.hex(F.substring("_bits", ((slot % 32768) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    near = d.join(F.broadcast(hit), F.floor(slot / 32768).cast("int") == F.col("_piece"), "left")
    near = near.withColumn("_hit", F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))) != 0, F.lit(False))).drop("_piece", "_bits")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    done = lambda x: x.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans", "kept")
    whole = near.where("not _hit").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), nothing.alias("spans"), F.col("text").alias("kept"))
    per_doc = ranges.groupBy(F.col("doc_id").alias("_i"), F.col("dk").alias("_k")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    cut = near.where("_hit").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("dk") == F.col("_k")), "left")
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    cut = cut.select("doc_id", "text", F.coalesce("ranges", empty).alias("ranges")).mapInArrow(_kept_rows, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return done(whole).unionByName(done(cut))
