"""Operator 10: short test items inside long documents, by size-partitioned MinHash containment.

Items are partitioned by the power of two of their shingle count. Within a partition each item is
represented by its m smallest shingle hashes, m following from the partition's largest item: a document
that contains a share `num / den` of an item's n shingles misses at most n - ceil(n num / den) of them, so it
holds at least m - n + ceil(n num / den) >= 2 of the m (or all, if the item has no more). Documents are long
and a sketch of them would lose such items, so all their shingle hashes are probed, against a table
whose size follows the items only. The pairs found are then checked on the shingles themselves.

Everything is DataFrame functions. The items' table is broadcast only after its rows were counted
(`broadcast_rows`); beyond that Spark shuffles both sides.

Defined results: words are runs of letters and digits, lower-cased; an item with fewer words than `width` is
one shingle of all its words, without words it is found nowhere; null texts hold nothing; rows of one
doc_id count as one document if they are equal and are reported each by its best otherwise; rows with a null
doc_id or item_id cannot be reported and take no part; repeated items with one item_id are one item, by
their smallest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(width: Column | int) -> Column:
    """The starts, from 0, of the runs of `width` words in the column `w`; none if there are too few words."""
    n = F.size("w") - F.lit(width)
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _strings(width: int) -> Column:
    return F.array_distinct(F.transform(_starts(width), lambda i: F.array_join(F.slice("w", i + 1, width), " ")))


def _hashes(width: int) -> Column:
    """Shingle hashes from word hashes in `h`: no strings are built on the way."""
    return F.transform(_starts(width), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(width)]))


def items_table(items: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, w, width of its shingles, shingle strings, n of them, and how many a document must hold."""
    rows = items.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item_id")).agg(F.min(text_col).alias("text"))
    rows = rows.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    own = F.least(F.lit(width), F.size("w"))
    strings = F.array_distinct(F.transform(_starts(own), lambda i: F.array_join(F.slice("w", i + 1, own), " ")))
    rows = rows.select("item_id", "w", own.alias("width"), strings.alias("strings"))
    n = F.size("strings")
    return rows.select("*", n.alias("n"), F.floor((n * num + den - 1) / den).cast("int").alias("need"))


def find_items(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 8, den: int = 10, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: pairs with n_shared / n_item >= num / den."""
    held = materialise(items_table(items, width, num, den, item_col, item_text), "items")
    widths = sorted(r[0] for r in held.select("width").distinct().collect())  # at most `width` of them
    # The sketch: partitions by size, their number of smallest hashes, and what a document must hold of them.
    top = held.groupBy(F.floor(F.log2("n")).alias("size_class")).agg(F.max(F.col("n") - F.col("need")).alias("missing"))
    sized = held.withColumn("size_class", F.floor(F.log2("n"))).join(top, "size_class")
    hashed = [sized.where(F.col("width") == k).withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("hs", F.array_sort(F.array_distinct(_hashes(k)))) for k in widths]
    keys = None
    for part in hashed:
        m = F.least(F.size("hs"), F.col("missing") + 2)
        own = part.select("item_id", "n", "need", F.slice("hs", F.lit(1), m).alias("sketch"))
        own = own.select("item_id", "need", F.greatest(F.lit(1), F.size("sketch") - F.col("n") + F.col("need")).alias("hits_needed"), F.explode("sketch").alias("key"))
        keys = own if keys is None else keys.union(own)
    rows = docs.where(F.col(doc_col).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    if keys is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_item"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)
    keys = materialise(keys, "sketch")
    if keys.count() <= broadcast_rows:
        keys = F.broadcast(keys)
    split = rows.select("doc_id", words(F.col("text")).alias("w"))
    spread = split.select("doc_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    probes = spread.select("doc_id", F.size("w").alias("n_words"), F.explode(F.concat(*[_hashes(k) for k in widths])).alias("key"))
    hits = probes.join(keys, "key").where(F.col("n_words") >= F.col("need"))
    pairs = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("key").alias("hits"), F.first("hits_needed").alias("hits_needed"))
    pairs = materialise(pairs.where("hits >= hits_needed").select("doc_id", "item_id"), "containment-pairs")
    # The check on whole shingles, of those documents only.
    item_side = held.select("item_id", "width", "strings", "n", "need")
    if held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= broadcast_rows:
        item_side = F.broadcast(item_side)
    texts = rows.join(pairs, "doc_id").select("doc_id", "item_id", words(F.col("text")).alias("w"))
    checked = None
    for k in widths:
        own = texts.join(item_side.where(F.col("width") == k), "item_id")
        own = own.select("doc_id", "item_id", "n", "need", F.size(F.array_intersect(_strings(k), "strings")).alias("n_shared"))
        checked = own if checked is None else checked.union(own)
    best = checked.where("n_shared >= need").groupBy("doc_id", "item_id").agg(F.first("n").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
