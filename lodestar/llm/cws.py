"""Consistent weighted sampling of term counts, and the fingerprints of edited texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

#: Samples of a signature: the standard error of a likeness is at most 0.5 / sqrt(SAMPLES).
SAMPLES = 32
#: Ranges of text digests that one block number leaves room for.
SUBS = 1 << 20


def samples(term: Column, log_weights: list[Column], j: int) -> list[Column]:
    """Sample j of one term for each of some weights, as a long: the smallest over a document's terms is the document's sample.

    With r, c from Gamma(2, 1) and b uniform, all drawn from the term and j alone,
    t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The high bits hold ln a in fixed point,
    the low 21 bits of the term's draw and t, so two documents have one sample exactly where term and t agree,
    with probability equal to the generalised Jaccard similarity of their weights.
    """
    first, second = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    part = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * F.lit(2.0**-bits)  # noqa: E731  strictly between 0 and 1
    b = part(first, 0, 20)
    r, log_c = -F.log(part(first, 20, 22) * part(first, 42, 22)), F.log(-F.log(part(second, 0, 32) * part(second, 32, 32)))
    out = []
    for lw in log_weights:
        t = F.floor(lw / r + b)
        high = F.floor((log_c - r * (t - b + 1) + 100) * F.lit(2.0**35)).cast("long")
        out.append(F.shiftleft(high, 21).bitwiseOR(first.bitwiseXOR(t).bitwiseAND(F.lit(0x1FFFFF))))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")


def fingerprint(signature: Column) -> Column:
    """A signature as text: six hex digits a sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFF)))), 6, "0")), "")


def _blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows with ``digest``, ``block``, a range of ids, and ``guest`` 1 on the copy of each block's first document that the block before takes in.

    Blocks are numbered upwards by id; the order of documents goes down, by digest within an id, null ids last.
    Quantiles of the ids set the ranges. An id with more rows than two blocks should have, null among
    them, has ranges of digests of its own; there are at most half as many of those as blocks.
    """
    digest = F.conv(F.substring(F.md5("text"), 1, 13), 16, 10).cast("long")  # 52 bits
    docs = docs.withColumn("digest", digest)
    counts = docs.groupBy("doc_id").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    heavy = {r["doc_id"]: r["count"] for r in counts.where(F.col("count") * blocks > 2 * total).collect()} if blocks > 1 else {}
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [k / blocks for k in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    alone = [i - k for i in heavy if i is not None for k in (0, 1)]  # an id between two cuts has a range to itself
    cuts = sorted({max(-(1 << 63), int(c)) for c in [*cuts, *alone]})
    place = F.lit(0)
    if cuts:
        table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # one literal, however many cuts
        rounds = len(cuts).bit_length() + 1
        half = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(table, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < F.col("doc_id"), F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), half)["lo"]
    parts = lambda i: min(SUBS, math.ceil(heavy[i] * blocks / total)) if i in heavy else 1
    share = F.when(F.col("doc_id").isNull(), parts(None))
    for i in heavy:
        if i is not None:
            share = share.when(F.col("doc_id") == i, parts(i))
    share = share.otherwise(1)
    sub = share - 1 - F.floor(F.col("digest") * share / float(1 << 52)).cast("long")
    block = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place).cast("long") * SUBS + sub
    rows = docs.withColumn("block", block)
    heads = rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("down"), "digest")).alias("x"))
    order = Window.orderBy("block")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("block").alias("b"), F.when(~F.col("x.none"), (-F.col("x.down")).cast("long")).alias("head"), F.col("x.digest").alias("first"), F.coalesce(F.lead("block").over(order), F.first("block").over(every)).alias("to"))
    rows = rows.join(F.broadcast(heads), (F.col("block") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("digest") == F.col("first")), "left")
    both = F.array(F.struct("block", F.lit(0).alias("guest")), F.struct(F.col("to").alias("block"), F.lit(1).alias("guest")))
    return rows.select("doc_id", "text", "digest", F.explode(F.filter(both, lambda x: x["block"].isNotNull())).alias("x")).select("doc_id", "text", "digest", "x.block", "x.guest")


def fingerprint_edits(docs: DataFrame, blocks: int, k: int = SAMPLES) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    Weighted terms are a text's words with their counts. The edited text has its last floor(n/2)
    code points replaced by as many first ones of the next document by descending id; the smallest
    id is followed by the largest. Null text is empty; rows with one id follow in the order of the MD5 digests of
    their texts; null ids come last.

    Text is shuffled once, to blocks of neighbouring ids; a copy of each block's first document in
    the block before closes the seams. Counting, sampling and comparing keep that partitioning.
    What has to pass through the grouping by term rides along as rows of its own, so each group is
    a few longs.
    """
    d = _blocks(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), blocks)
    near = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "digest", "text")
    d = d.repartition("block").withColumns({"rn": F.row_number().over(near).cast("long"), "next": F.coalesce(F.lead("text").over(near), F.lit(""))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.when(F.col("guest") == 0, F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next").substr(F.lit(1), half))))
    sha = F.sha2("edited", 256)
    carried = F.array(F.col("doc_id").cast("string"), n.cast("string"), F.col("guest").cast("string"), *[F.substring(sha, 1 + 16 * i, 16) for i in range(4)])
    d = d.select("block", "rn", words("text").alias("a"), words("edited").alias("b"), carried.alias("c"))
    d = d.select("block", "rn", F.size("a").alias("na"), (F.size("a") + F.size("b")).alias("nb"), F.posexplode(F.concat("a", "b", "c")).alias("pos", "term"))
    word, slot = F.col("pos") < F.col("nb"), F.col("pos") - F.col("nb")
    key = F.when(word, F.xxhash64("term")).when(slot < 3, F.expr("try_cast(term as bigint)")).otherwise(F.expr("try_cast(conv(term, 16, -10) as bigint)"))
    d = d.select("block", (F.col("rn") * 16 + F.when(word, 0).otherwise(slot + 1)).alias("slot"), key.alias("key"), F.when(F.col("pos") < F.col("na"), F.lit(1)).when(word, F.lit(1 << 32)).otherwise(F.lit(0)).cast("long").alias("count"))
    d = d.groupBy("block", "slot", "key").agg(F.sum("count").alias("count"))
    log = lambda x: F.log(x.cast("double"))
    d = d.select("block", F.shiftright("slot", 4).alias("rn"), F.col("slot").bitwiseAND(F.lit(15)).alias("slot"), "key", F.col("count").bitwiseAND(F.lit(0xFFFFFFFF)).alias("wa"), F.shiftright("count", 32).alias("wb"))
    d = d.withColumns({"la": log(F.col("wa")), "lb": log(F.col("wb"))})
    sampled = [s for j in range(k) for s in samples(F.col("key"), [F.col("la"), F.col("lb")], j)]
    least = [F.min(s).alias(f"m{i}") for i, s in enumerate(sampled)]
    at = lambda i: F.max(F.when(F.col("slot") == i, F.col("key"))).alias(f"c{i}")
    d = d.groupBy("block", "rn").agg(*least, *[at(i) for i in range(1, 8)])
    sig = lambda side: F.array(*[F.coalesce(F.col(f"m{2 * j + side}"), F.lit(-1).cast("long")) for j in range(k)])
    d = d.select("block", "rn", *[f"c{i}" for i in range(1, 8)], sig(0).alias("own"), sig(1).alias("edit"))
    d = d.withColumn("after", F.lead("own").over(Window.partitionBy("block").orderBy("rn"))).where("c3 = 0")
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"c{i}")), 16, "0") for i in range(4, 8)])
    return d.select(
        F.col("c1").alias("doc_id"), F.col("c2").alias("n_chars"), digest.alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
