"""Merkle fixity audit of replicas of an archive.

A record's leaf hash covers its WARC header fields and payload. Records are laid out by key: an archive file is a range of
``FILE_KEYS`` keys, and a record's offset in it is the length of all records before. Inside a file, leaves are summed up in ranges
of ``FAN`` keys, those in ranges of ``FAN`` ranges, and so on up to one root over all files; each node hashes its children's hashes,
first offsets and lengths in order. A node has at most ``FAN`` children, whatever the archive's size, so lists stay short.

``audit`` compares the roots, then only the children of nodes that differ, level by level, and names the corrupt records with the
offset ranges they fill in either replica. Key ranges, unlike positions, stay put when a record is missing from one replica.

Defined cases: records without a key form a key of their own before all others; records that share a key are one leaf, the count and
sums of their hashes, so the order of repeats doesn't matter; NULL fields differ from empty ones; with one replica empty every key is
reported; two empty replicas agree; columns beyond the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossover.llm.common import NULL_ID, id_back, written

LOWER_LETTERS, UPPER_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FAN_BITS = 4
FILE_BITS = 8
FILE_KEYS = 1 << FILE_BITS


def record(url: Column, payload: Column) -> Column:
    """A WARC response record: header fields, a blank line, the payload. NULL fields are left out of the header."""
    length = F.octet_length(payload).cast("string")
    lines = [F.lit("WARC/1.0"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Target-URI: "), url),
             F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(payload, 256)), F.concat(F.lit("Content-Length: "), length)]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(k, n, size, hash): the records of each key. Repeats of a key are summed, combined before the shuffle."""
    raw = record(F.col(url).cast("string"), F.col(payload).cast("string"))
    rows = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("k"), F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("h"))
    limbs = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"h{i}") for i in range(4)]
    summed = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *limbs)
    return summed.select("k", "n", "size", F.sha2(F.concat_ws(",", "n", *[F.col(f"h{i}").cast("string") for i in range(4)]), 256).alias("hash"))


def with_offsets(leaf: DataFrame) -> DataFrame:
    """Adds the offset of a key's first record in its file; a file has at most FILE_KEYS keys."""
    before = Window.partitionBy(F.shiftright("k", FILE_BITS)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def parents(nodes: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """Nodes one level up: hash over the children's (key, start, size, hash) in order, and the range they fill."""
    child = F.concat_ws(":", "k", "start", "size", "hash")
    kids = F.array_sort(F.collect_list(F.struct("k", child.alias("c"))))
    grouped = nodes.groupBy(F.shiftright("k", bits).alias("p")).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("start").alias("start"), kids.alias("kids"))
    return grouped.select(F.col("p").alias("k"), "n", "size", F.sha2(F.concat_ws("|", F.col("kids.c")), 256).alias("hash"), "start")


def build_tree(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> list[DataFrame]:
    """Levels of the tree, leaves first; the last has the keys -1 and 0 (below and from zero) at most. Each level is a table."""
    levels = [written(with_offsets(leaves(pages, key, url, payload)), "fixity")]
    for _ in range(64 // FAN_BITS):
        levels.append(written(parents(levels[-1]), "fixity"))
        if levels[-1].where("k not in (-1, 0)").isEmpty():
            break
    return levels


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """Differing keys of two trees: key, kind, offsets and sizes in both. Only children of differing nodes are read up to the leaves."""
    top = max(len(left), len(right))
    for tree in (left, right):
        while len(tree) < top:
            tree.append(written(parents(tree[-1]), "fixity"))
    suspects = None
    for level in range(top - 1, -1, -1):
        a, b = left[level], right[level]
        if suspects is not None:
            up = F.shiftright("k", FAN_BITS).alias("p")
            a, b = (x.withColumn("p", up).join(suspects.select(F.col("k").alias("p")), "p", "left_semi").drop("p") for x in (a, b))
        columns = [F.col("k"), *[F.col(c).alias(f"{c}_a") for c in ("n", "start", "size", "hash")]]
        other = [F.col("k"), *[F.col(c).alias(f"{c}_b") for c in ("n", "start", "size", "hash")]]
        both = a.select(*columns).join(b.select(*other), "k", "full_outer")
        suspects = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if level:
            suspects = written(suspects, "suspects")
    kind = F.when(F.col("hash_a").isNull(), "extra").when(F.col("hash_b").isNull(), "missing").when(F.col("n_a") != F.col("n_b"), "count").otherwise("corrupt")
    return suspects.select(id_back("k").alias("page_id"), kind.alias("kind"), F.col("start_a").alias("offset_a"), F.col("size_a"), F.col("start_b").alias("offset_b"), F.col("size_b"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted faults: other letters or a lost one, another address, records that are missing or doubled."""
    fault = F.col("page_id") % 97
    html = F.when(fault == 5, F.translate("html", LOWER_LETTERS, UPPER_LETTERS)).when(fault == 6, F.expr("substring(html, 2)")).otherwise(F.col("html"))
    url = F.when(F.col("page_id") % 503 == 11, F.concat("url", F.lit("#"))).otherwise(F.col("url"))
    copy = pages.where("page_id % 211 <> 7").select("page_id", url.alias("url"), html.alias("html"))
    return copy.union(pages.where("page_id % 601 = 13").select("page_id", "url", "html"))
