"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

DataFrame operations only. A window that is as similar to an item as asked shares most of
its shingles, so windows are laid only where documents share enough shingles with some
item. They begin at a shared shingle: a window that does not is no better than the one that
begins at its first shared shingle (or ends with the text), which holds the same shared
ones. So neither rule loses a passage, moved or reordered as it may be.

Which items a window is like is then up to fingerprints alone. Each window and each item
gets a SimHash over its weighted shingles, cut into BLOCKS blocks. Two fingerprints within
the radius differ in at most radius // BLOCKS bits of some block; items stand in the index
under all values so near to each of their blocks, so an equality join on (place, value) of
the different fingerprints finds all items within the radius of a window. The exact
weighted Jaccard similarity of their shingles then decides.

At a similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average with a standard
deviation of 2.9, so a radius of 19 is over three deviations away. Where one shingle has
much of an item's weight there is no such law; such items (PEAK) skip the fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only

#: Blocks of a fingerprint, and the share of an item's weight from which one repeated shingle decides too many bits.
BLOCKS, PEAK = 5, 1 / 8
#: Rows up to which one side of a join is sent to every executor.
SMALL = 200_000


def _words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has been counted and found small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _shingles(words: Column, k: int | Column) -> Column:
    """All runs of k words, space-joined, with repeats."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k) if isinstance(k, int) else k), " "))


def _hashes(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def _fingerprints(shingled: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, fp) from rows (by, shingle, weight): a bit is 1 if over half the weight has it.

    32 sums hold two 32-bit counters each.
    """
    h = F.xxhash64("shingle")
    lanes = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0000000100000001)) * F.col("weight")).alias(f"s{j}") for j in range(32)]
    sums = shingled.groupBy(*by).agg(F.sum("weight").alias("n"), *lanes)
    fp = F.lit(0).cast("long")
    for j in range(32):
        for lane in (0, 1):
            count = F.shiftrightunsigned(F.col(f"s{j}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            fp = fp.bitwiseOR(F.when(2 * count > F.col("n"), F.shiftleft(F.lit(1).cast("long"), j + 32 * lane)).otherwise(F.lit(0).cast("long")))
    return sums.select(*by, "n", fp.alias("fp"))


def _blocks(fp: str, reach: int = 0) -> Column:
    """The blocks of a fingerprint as (place, value), under all values that differ in at most `reach` bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]

    def near(place: int, a: int, b: int) -> Column:
        value = F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int")
        flips = F.lit([m for m in range(1 << (b - a)) if m.bit_count() <= reach]).cast("array<int>")
        return F.transform(flips, lambda m: F.struct(F.lit(place).alias("place"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[near(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]))


def _places(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(row, n, it, len, k, at): where a text of n words has shingles of an item. Texts are read and cut into words once."""
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # 1 to words
    own = None
    for k in lengths:
        one = items.where(F.col("k") == k).select("it", "k", "len", F.explode(F.array_distinct(_hashes(F.col("w"), k))).alias("hash"))
        own = one if own is None else own.union(one)

    def found(k: int) -> Column:
        hashes = F.coalesce(_hashes(F.col("w"), k), F.array().cast("array<bigint>"))
        return F.transform(hashes, lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("hash")))

    if len(lengths) == 1:
        seen = texts.select("row", F.size("w").alias("n"), F.lit(lengths[0]).alias("k"), F.posexplode(_hashes(F.col("w"), lengths[0])).alias("pos", "hash"))
    else:
        seen = texts.select("row", F.size("w").alias("n"), F.explode(F.flatten(F.array(*map(found, lengths)))).alias("s")).select("row", "n", "s.k", "s.pos", "s.hash")
    met = seen.join(_small(own), ["k", "hash"])
    return met.groupBy("row", "n", "it", "len", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # no more places than the text has


def _matches(docs: DataFrame, benchmark: DataFrame, words: int, similarity: float, radius: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(row, id, item, start, n_words, similarity) of each similar pair, at its best window; row numbers docs."""
    items = benchmark.select(F.col(item_col).alias("item"), _words(item_text).alias("w")).where(F.size("w") > 0).distinct()
    # Rows and items are joined by number (it), which is never null as an id may be.
    items = cut(items.select("item", F.monotonically_increasing_id().alias("it"), "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(words)).alias("k")))
    if items.isEmpty():
        return docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("id"), F.lit(0).alias("item"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).limit(0)
    said = items.select("it", F.explode(_shingles(F.col("w"), F.col("k"))).alias("shingle"))
    weighted = cut(said.groupBy("it", "shingle").agg(F.count(F.lit(1)).alias("weight")))
    ids = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _words(text_col).alias("w"))
    texts = ids.select("row", "w")

    met = _places(texts, items)
    size = F.least("len", "n")
    # With a and b shingles, x of them shared: x / (a + b - x) reaches the similarity from here on. The margin is for rounding.
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (size + F.col("len") - 2 * F.col("k") + 2) - 1e-6).cast("int")
    met = met.select("row", F.col("n").alias("of"), "it", "k", "at", size.alias("size"), (F.col("n") - size).alias("last"), F.greatest(F.lit(1), least).alias("least")).where("size(at) >= least")
    dense = F.filter("at", lambda p, i: F.get("at", i + F.col("least") - 1) <= p + F.col("size") - F.col("k"))
    starts = met.select("row", "of", "it", "size", F.explode(F.array_distinct(F.transform(dense, lambda p: F.least(p, "last")))).alias("start"))
    starts = cut(starts.withColumn("k", F.least("size", F.lit(words))))

    by = ["row", "of", "start", "size", "k"]
    windows = texts.join(_small(starts.select(*by).distinct()), "row").select(*by, F.slice("w", F.col("start") + 1, F.col("size")).alias("w"))
    parts = windows.select(*by, F.explode(_shingles(F.col("w"), F.col("k"))).alias("shingle"))
    parts = cut(parts.groupBy(*by, "shingle").agg(F.count(F.lit(1)).alias("weight")))

    printed = cut(_fingerprints(parts, by).withColumnRenamed("n", "n_window"))
    marked = cut(_fingerprints(weighted, ["it"]).withColumnRenamed("n", "n_item"))
    index = marked.select("it", F.col("fp").alias("item_fp"), F.explode(_blocks("fp", radius // BLOCKS)).alias("block")).select("it", "item_fp", "block.*")
    asked = printed.select("fp").distinct().select("fp", F.explode(_blocks("fp")).alias("block")).select("fp", "block.*")
    near = (asked["place"] == index["place"]) & (asked["value"] == index["value"]) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = asked.join(_small(index), near).select("fp", "it").distinct()
    found = printed.join(near, "fp").select(*by, "n_window", "it")
    peaked = weighted.groupBy("it").agg(F.max("weight").alias("most"), F.sum("weight").alias("all")).where((F.col("most") > 1) & (F.col("most") > PEAK * F.col("all"))).select("it")
    found = found.union(starts.join(_small(peaked), "it").join(printed, by).select(*by, "n_window", "it")).distinct()
    found = found.join(_small(marked.select("it", "n_item")), "it")
    shared = parts.join(found, by).join(_small(weighted.select("it", "shingle", F.col("weight").alias("theirs"))), ["it", "shingle"])
    both = shared.groupBy(*by, "it", "n_window", "n_item").agg(F.sum(F.least("weight", "theirs")).alias("both"))
    alike = both.withColumn("similarity", F.col("both") / (F.col("n_window") + F.col("n_item") - F.col("both"))).where(F.col("similarity") >= similarity)
    # A window is as long as the item, or the whole of a shorter text.
    alike = alike.join(_small(items.select("it", "item", "len")), "it").where(F.col("size") == F.least("len", "of"))
    # Texts that share an item's id are one item; each text without an id is one of its own.
    best = alike.groupBy("row", "item", F.when(F.col("item").isNull(), F.col("it")).alias("own")).agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("best"))
    best = cut(best).join(ids.select("row", "id"), "row")
    return best.select("row", "id", "item", (-F.col("best.back")).alias("start"), F.col("best.size").alias("n_words"), "best.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 19, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, n_words, similarity): documents that hold a passage like an item.

    A passage is a window of as many words as the item has (or the whole of a shorter
    document); its weighted Jaccard similarity over shingles of `words` words is at least
    `similarity`. One row per document row and item, at the best window that begins at a
    shared shingle or ends with the text (the first of equal ones). An item of fewer words than a shingle is one shingle; items and texts without
    words (null or empty) match nothing. Repeated documents each have their row; repeated
    items count once; null ids, of documents or items, are carried and match by text like any other. Other columns are ignored. docs must be a
    stored table, whose rows are in the same places each time it is read.
    """
    found = _matches(docs, benchmark, words, similarity, radius, id_col, text_col, item_col, item_text)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "n_words", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 19, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() does not name."""
    rows = cut(_matches(docs, benchmark, words, similarity, radius, id_col, text_col, item_col, item_text).select(F.col("row").alias("__row")).distinct())
    return only(docs, _small(rows), "left_anti")
