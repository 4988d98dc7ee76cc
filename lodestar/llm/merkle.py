"""WARC records and a Merkle fixity audit of two replicas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, table_mark

#: Children of a node, slots of one WARC file, and levels of nodes between a record and its file.
FANOUT, FILE_SLOTS, FILE_LEVELS = 16, 4096, 3


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """One response record as WARC/1.1 text; null parts are empty."""
    body, e = F.coalesce(html, F.lit("")), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), e(page_id), F.lit(">\r\nWARC-Target-URI: "), e(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """``(at, slot, page_id, file, offset, length, hash)``: one leaf per id; its file is named by ``at``, its offset counts the bytes before it in the file.

    Rows that share an id share a leaf, hashed from what does not depend on their order. Null ids share a
    leaf and a file of their own.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash"))
    # A sum of digests stands for the set of an id's records, so repeated ids need no list.
    same = rows.groupBy("page_id").agg(F.sum("length").alias("length"), F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("total"))
    one = same.select("page_id", "length", F.when(F.col("n") == 1, F.col("lo")).otherwise(F.sha2(F.concat_ws("|", "n", "lo", "hi", "total"), 256)).alias("hash"))
    file = F.floor(F.col("page_id") / FILE_SLOTS)
    one = one.withColumns({"file": file, "at": F.coalesce(file.cast("string"), F.lit("none")), "slot": F.coalesce(F.pmod("page_id", F.lit(FILE_SLOTS)), F.lit(0)).cast("string")})
    before = Window.partitionBy("at").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def level_up(nodes: DataFrame, at: Column, slot: Column) -> DataFrame:
    """Hash neighbouring nodes ``(at, slot, offset, length, hash)`` into their parents: each child's slot, byte range counted from the parent's first byte, and hash.

    Offsets that count from the parent keep a fault to its own branch: what follows in the file only moves.
    """
    kids = F.array_sort(F.collect_list(F.struct("offset", "slot", "length", "hash")))
    up = nodes.groupBy(at.alias("at"), slot.alias("slot")).agg(kids.alias("kids"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
    ranges = F.transform("kids", lambda k: F.struct(k["slot"].alias("slot"), (k["offset"] - F.col("offset")).alias("from"), k["length"].alias("length"), k["hash"].alias("hash")))
    return up.select("at", "slot", "offset", "length", F.sha2(F.to_json(ranges), 256).alias("hash"))


def _parent(level: int, depth: int) -> tuple[Column, Column]:
    """Key ``(at, slot)`` of the parent of a node at a level counted from the leaves; ``depth`` levels are between the files and the root."""
    at = F.col("at")
    if level < FILE_LEVELS:
        return at, F.floor(F.col("slot").cast("int") / FANOUT).cast("string")
    if level == FILE_LEVELS:  # files hang in a radix tree by the digest of their name
        return F.substring(F.md5(at), 1, depth), F.lit("")
    return F.substring(at, 1, depth - (level - FILE_LEVELS)), F.lit("")


def tree(base: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of a Merkle tree from leaves to the one root. A file's records form ``FILE_LEVELS`` levels in order; the ``depth`` levels above follow from the number of files, however large the ids."""
    levels = [base]
    for level in range(FILE_LEVELS + depth + 1):
        nodes = levels[-1]
        if level >= FILE_LEVELS:  # a child's name is its slot, and byte ranges of different files do not follow each other
            nodes = nodes.select("at", F.col("at").alias("slot"), F.lit(0).cast("long").alias("offset"), "length", "hash")
        levels.append(materialize(level_up(nodes, *_parent(level, depth)), "nodes"))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Rows ``(page_id, file, offset, length, primary_hash, replica_hash, fault)`` of records that differ.

    Both sides hash their own records into a radix-16 tree: records by slot into files, files by the
    digest of their number into a root. Node hashes cover their children's hashes and byte ranges. The roots
    are compared, and from there only the children of nodes that differ are read on the way down; where
    none differ the descent ends, so a sound replica costs one comparison. ``fault`` is ``altered``,
    ``missing`` or ``extra``. Every group is at most 16 nodes (of files, some more by chance). Empty tables give no rows.
    """
    spark, mark = primary.sparkSession, table_mark()
    bases = [materialize(leaves(x), "leaves") for x in (primary, replica)]
    files = max(x.select("at").distinct().count() for x in bases)
    depth = max(0, math.ceil(math.log(max(files, 1), FANOUT)) - 1)
    trees = [tree(x, depth) for x in bases]
    bad = None
    for level in range(FILE_LEVELS + depth + 1, -1, -1):
        cols = lambda x, p: x.select("at", "slot", *[F.col(c).alias(p + c) for c in x.columns if c not in ("at", "slot")])
        a, b = (t[level] for t in trees)
        if bad is not None:
            at, slot = _parent(level, depth)
            up = bad.select(F.col("at").alias("_at"), F.col("slot").alias("_slot"))
            a, b = (x.join(up, (at == F.col("_at")) & (slot == F.col("_slot")), "left_semi") for x in (a, b))
        bad = cols(a, "a_").join(cols(b, "b_"), ["at", "slot"], "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
        bad = materialize(bad, "differ")
        if bad.isEmpty():
            break
    if "a_page_id" not in bad.columns:  # the roots are alike
        bad = cols(bases[0], "a_").join(cols(bases[1], "b_"), ["at", "slot"]).where("false")
        return _faults(bad)
    drop_tables(spark, mark, keep=1)
    return _faults(bad)


def _faults(bad: DataFrame) -> DataFrame:
    fault = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "extra").otherwise("altered")
    pick = lambda c: F.coalesce(f"a_{c}", f"b_{c}").alias(c)
    return bad.select(pick("page_id"), pick("file"), pick("offset"), pick("length"), F.col("a_hash").alias("primary_hash"), F.col("b_hash").alias("replica_hash"), fault.alias("fault"))


def damaged_copy(pages: DataFrame, one_in: int = 97) -> DataFrame:
    """A replica derived from ``pages`` with faults at ids chosen by digest: a byte changed in the middle, the end cut, or the record lost."""
    pick = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("long")
    n = F.length("html")
    half = F.floor(n / 2).cast("int")
    html = (
        F.when((pick % one_in == 0) & (n > 0), F.concat(F.expr("left(html, int(length(html) / 2))"), F.when(F.col("html").substr(half + 1, F.lit(1)) == "#", "@").otherwise("#"), F.col("html").substr(half + 2, n)))
        .when((pick % one_in == 1) & (n > 0), F.col("html").substr(F.lit(1), n - 1))
        .otherwise(F.col("html"))
    )
    return pages.where(F.coalesce(pick % one_in != 2, F.lit(True))).withColumn("html", html)
