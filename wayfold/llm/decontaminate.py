"""Benchmark decontamination by size-partitioned MinHash containment search, on Spark functions only.

A test item is a few dozen words inside a document of thousands, so the likeness of the two
sets of shingles is tiny, and a signature of fixed length would miss it. Documents are
partitioned by size, and each partition has its own number of minima: the hash range is cut
into ``DENSITY`` times as many bins as the partition's largest document has shingles, and
the least hash of each bin is kept (one-permutation MinHash). An item is cut into the same
bins; a document with which it shares a minimum is a candidate. A shared shingle fails to
collide only if the document has a smaller hash in its bin, about one time in eight, and an
item contained to 0.8 shares most of its shingles. Items with fewer than ``SURE`` shingles,
where that could still lose one, are searched for by all shingles instead.

Candidates are verified by the exact containment of the item's shingles as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized
from .fingerprint import with_shingles, words_of

WORDS = 5
THRESHOLD = 0.8
DENSITY_BITS = 2  # four bins for each shingle of the largest document
SURE = 8
#: Bits of the hashes.
BITS = 63
#: Item shingles up to which their table is broadcast; beyond it the search is a shuffled join.
BROADCAST_SHINGLES = 1_000_000


def size_class(n: Column) -> Column:
    """The least c with n <= 2**c."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin((n - 1).cast("long")))).cast("int")


def _minima(hashes: str, shift: Column) -> Column:
    """The least hash of each bin; ``hashes`` are ascending, so the first of its bin."""
    before = F.concat(F.array(F.lit(-1).cast("long")), F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))))
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, shift)
    pairs = F.filter(F.arrays_zip(F.col(hashes).alias("h"), before.alias("b")), lambda z: (z["b"] < 0) | (bin_of(z["h"]) != bin_of(z["b"])))
    return F.filter(F.transform(pairs, lambda z: z["h"]), lambda h: h.isNotNull())


def _shift(c: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(BITS - DENSITY_BITS) - c).cast("int")


def _with_texts(df: DataFrame, text: str, out: str, words: int) -> DataFrame:
    """Add ``out``: the distinct word shingles of a text, as text."""
    w = f"{out}__w"
    df = df.withColumn(w, words_of(F.coalesce(F.col(text), F.lit(""))))
    n = F.size(w)
    long = F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: F.array_join(F.slice(w, i, words), " "))
    return df.withColumn(out, F.array_distinct(F.when(n >= words, long).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))).drop(w)


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col)))


def candidates(docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, item_id): documents (by the hash of id and text) and items that share a minimum."""
    sized_items = with_shingles(items.select("item_id", "text"), "text", "h", words)
    q = F.size("h")
    classes = F.sequence(F.lit(0), F.lit(40))
    # For each shingle of an item: the classes in which it is the least of its bin, as bits.
    each = sized_items.withColumn("c", F.explode(classes)).where(F.pow(F.lit(2), F.col("c")) >= q * F.lit(THRESHOLD))
    each = each.select("item_id", "c", q.alias("q"), F.explode(_minima("h", _shift(F.col("c")))).alias("v"))
    table = each.groupBy("item_id", "v").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c"))).alias("mask"), F.max("q").alias("q"))
    table = cut(table.select("item_id", "v", "mask", (F.col("q") < SURE).alias("tiny")), "item-minima")
    h = with_shingles(with_key(docs, id_col, text_col).select("__key", F.col(text_col).alias("text")), "text", "h", words)
    h = h.withColumn("c", size_class(F.size("h")))
    signed = h.select("__key", "c", F.explode(_minima("h", _shift(F.col("c")))).alias("v"))
    hits = signed.join(sized(table, BROADCAST_SHINGLES), "v").where(F.call_function("shiftrightunsigned", F.col("mask"), F.col("c")).bitwiseAND(F.lit(1)) == 1).select("__key", "item_id")
    tiny = table.where("tiny")
    if tiny.limit(1).count():
        hits = hits.unionByName(h.select("__key", F.explode(F.filter("h", lambda x: x.isNotNull())).alias("v")).join(sized(tiny, BROADCAST_SHINGLES), "v").select("__key", "item_id"))
    return hits.distinct()


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, doc_id, item_id, n_shared, n_item, containment) of items contained in documents.

    containment is the share of the item's distinct word shingles that the document has, at
    least ``threshold``. Words are lower-case runs of letters, marks and digits; a text with
    fewer words than a shingle is one shingle, so that such an item is found only in a
    document that is just it. Items without a word, null texts and empty tables match nothing;
    repeated rows of a document give repeated results; an item's rows count by item_id and text.
    """
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    found = cut(candidates(docs, items, words, id_col, text_col), "leak-candidates")
    by_doc = sized(found.groupBy("__key").agg(F.collect_list("item_id").alias("__items")), size=F.size("__items") * 8 + 16)
    mine = with_key(docs, id_col, text_col).select("__key", F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(by_doc, "__key")
    mine = _with_texts(mine, "text", "s", words).select("__key", "doc_id", "s", F.explode(F.array_distinct("__items")).alias("item_id"))
    theirs = sized(cut(_with_texts(items, "text", "t", words).select("item_id", "t"), "item-shingles"), 20_000, F.length(F.array_join("t", "")) + F.size("t") * 8)
    both = mine.join(theirs, "item_id").withColumn("n_shared", F.size(F.array_intersect("t", "s")))
    return both.select("__key", "doc_id", "item_id", "n_shared", F.size("t").alias("n_item"), (F.col("n_shared") / F.size("t")).alias("containment")).where(F.col("containment") >= threshold)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that contain a test item."""
    dirty = sized(cut(leaks(docs, items).select("__key").distinct(), "leaky"))
    return with_key(docs, "doc_id", "text").join(dirty, "__key", "left_anti").select(*docs.columns)
