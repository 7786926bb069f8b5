"""Benchmark decontamination, native DataFrame operations only.

A window is as many word shingles of a document as a benchmark item has. Windows and items have SimHash fingerprints (64 bits, each
shingle weighted by its count), cut into `radius` + 1 blocks of bits: two that differ in at most `radius` bits agree in at least one
block, so looking the blocks up finds every item within the radius of a window. What is found is verified by the exact weighted
similarity of the shingle multisets (sum of least counts over sum of greatest counts).

A window is as similar to an item as asked for only if it has enough positions with a shingle of the item. One join of all documents'
shingles with the items' gives these positions; all windows that have enough, at any start and in any order of the shingles, are
fingerprinted, and no others; each keeps its item. The items' shingles are broadcast up to `block` of them, else joined by shuffle, so
documents are read twice for a benchmark of any size. Equal texts are looked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = "[ \\t-\\r]+"
BLOCK = 1 << 20  # shingles of a benchmark that are broadcast, a few dozen bytes each
FEW = 100_000  # rows of (text, item) that are broadcast


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row; a plain projection could be inlined into each step of a lambda."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: str, width: int) -> Column:
    w = F.col(words)
    one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """Bit set if set in over half the shingles, repeats included. Counts of several bits share a long, in lanes that hold them without touching the sign."""

    def lanes(width: int) -> Column:
        mask = sum(1 << low for low in range(0, 64, width))
        mask = F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
        counted = lambda k: F.aggregate(shingles, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(mask))
        sums = [counted(k) for k in range(width)]
        bits = lambda c: reduce(lambda x, y: x.bitwiseOR(y), [bit_of(c, b, width, F.size(shingles)) for b in range(64)])
        return F.get(F.transform(F.array(F.array(*sums)), bits), F.lit(0))

    return F.when(F.size(shingles) < 128, lanes(8)).otherwise(lanes(32))


def bit_of(counts: Column, b: int, width: int, n: Column) -> Column:
    """Bit b, if its count among those of lanes of this width is over half of n."""
    one = F.shiftrightunsigned(F.get(counts, F.lit(b % width)), b // width * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.when(one * 2 > n, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))


def block_values(fp: Column, radius: int) -> Column:
    """The blocks of bits, in order."""
    n, low, out = radius + 1, 0, []
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append(F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1))
        low += width
    return F.array(*out)


def tagged(shingles: Column) -> Column:
    """One value for each occurrence, so that common values of two arrays are the common part of the multisets."""
    before = lambda i, h: F.size(F.filter(F.slice(shingles, 1, i), lambda y: y == h))
    plain, counted = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(0))), F.transform(shingles, lambda h, i: F.xxhash64(h, before(i, h)))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(counted)


def items_of(benchmark: DataFrame, shingle: int) -> DataFrame:
    """gw_i (hash of the text), gw_items (shingles), gw_width (their words) and gw_n of each distinct text with words.

    An item with fewer words than `shingle` has the whole sequence as its one shingle.
    """
    texts = benchmark.select("text").distinct()
    rows = bound(texts.select(F.xxhash64("text").alias("gw_i"), "text"), "gw_w", word_hashes(F.col("text"))).where(F.size("gw_w") > 0)
    width = F.least(F.size("gw_w"), F.lit(shingle))
    shingles = F.coalesce(*[F.when(width == k, shingle_hashes("gw_w", k)) for k in range(1, shingle + 1)])
    return rows.select("gw_i", width.alias("gw_width"), shingles.alias("gw_items")).withColumn("gw_n", F.size("gw_items"))


def starts(docs: DataFrame, items: DataFrame, width: int, least: float, block: int) -> DataFrame:
    """gw_text, gw_i and gw_starts of every text and item with a window of enough shared shingles for `least`.

    Of the rising positions of shared shingles, the one that is as many places on as shingles are needed, less one, has to be within
    the item's length; the starts that hold both are those of the windows.
    """
    rows = bound(docs.select(F.xxhash64("text").alias("gw_text"), "text"), "gw_w", word_hashes(F.col("text")))
    rows = rows.select("gw_text", (F.size("gw_w") - (width - 1)).alias("gw_m"), F.posexplode(shingle_hashes("gw_w", width)).alias("gw_p", "gw_h"))
    index = items.where(F.col("gw_width") == width).select("gw_i", "gw_n", F.explode(F.array_distinct("gw_items")).alias("gw_h"))
    index = F.broadcast(index) if index.count() <= block else index
    hits = rows.join(index, "gw_h").groupBy("gw_text", "gw_i", "gw_n", "gw_m").agg(F.collect_set("gw_p").alias("gw_p"))
    n, m = F.col("gw_n"), F.col("gw_m")
    need = F.greatest(F.ceil((F.least(n, m) + n) * least / (1 + least) - 1e-9).cast("int"), F.lit(1))
    hits = bound(hits.withColumn("gw_need", need).where(F.size("gw_p") >= F.col("gw_need")), "gw_at", F.array_sort("gw_p"))

    def span(c: Column, j: Column) -> Column:
        end = F.get(F.col("gw_at"), j + F.col("gw_need") - 1)
        return F.when(end - c < n, F.sequence(F.greatest(end - n + 1, F.lit(0)), F.least(c, F.greatest(m - n, F.lit(0))))).otherwise(F.array().cast("array<int>"))

    hits = bound(hits, "gw_starts", F.array_distinct(F.flatten(F.transform("gw_at", span))))
    return hits.where(F.size("gw_starts") > 0).select("gw_text", "gw_i", "gw_starts")


def matches_of(docs: DataFrame, items: DataFrame, width: int, radius: int, least: float, block: int) -> DataFrame:
    """gw_text, gw_i and best (similarity, aligned, -start) of every text and item of this width with a window that is similar enough."""
    found = written(starts(docs, items, width, least, block), "leak-starts")
    few = found.count() <= FEW
    hint = F.broadcast if few else lambda t: t
    own = docs.select(F.xxhash64("text").alias("gw_text"), "text").join(hint(found.select("gw_text").distinct()), "gw_text", "left_semi")
    own = own.groupBy("gw_text").agg(F.min("text").alias("text"))
    rows = bound(bound(own, "gw_w", word_hashes(F.col("text"))).drop("text"), "gw_s", shingle_hashes("gw_w", width)).drop("gw_w")
    table = bound(items.where(F.col("gw_width") == width).join(found.select("gw_i").distinct(), "gw_i", "left_semi"), "gw_ifp", simhash(F.col("gw_items")))
    table = bound(table, "gw_tags", tagged(F.col("gw_items")))
    rows = rows.join(hint(found), "gw_text").join(hint(table), "gw_i")
    window = lambda start: F.struct(start.alias("start"), (start >= F.size("gw_s") - F.col("gw_n")).alias("last"), F.slice(F.col("gw_s"), start + 1, F.col("gw_n")).alias("win"))
    rows = rows.select("gw_text", "gw_i", "gw_items", "gw_ifp", "gw_tags", F.explode(F.transform("gw_starts", window)).alias("w")).select("gw_text", "gw_i", "gw_items", "gw_ifp", "gw_tags", "w.*")
    rows = bound(rows, "fp", simhash(F.col("win")))
    looked_up = F.exists(F.zip_with(block_values(F.col("fp"), radius), block_values(F.col("gw_ifp"), radius), lambda x, y: x == y), lambda same: same)
    rows = rows.where(looked_up & (F.bit_count(F.col("fp").bitwiseXOR(F.col("gw_ifp"))) <= radius))
    rows = bound(rows, "gw_both", F.size(F.array_intersect(tagged(F.col("win")), "gw_tags")))
    rows = rows.withColumn("similarity", F.col("gw_both") / (F.size("win") + F.size("gw_items") - F.col("gw_both"))).where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", aligned().alias("aligned"), (-F.col("start")).alias("start")))
    return rows.groupBy("gw_text", "gw_i").agg(best.alias("best"))


def aligned() -> Column:
    """Whether a shared shingle of win has the same place in the item, as far as the document's bounds let the window go."""
    placed = lambda k, o: (k == o) | ((F.col("start") == 0) & (k <= o)) | (F.col("last") & (k >= o))
    of = lambda x, k: F.transform("gw_items", lambda y, o: (x == y) & placed(k, o))
    return F.exists(F.flatten(F.transform("win", of)), lambda hit: hit)


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 19, block: int = BLOCK) -> DataFrame:
    """Written gw_text, gw_i and best of every distinct text of docs and of the benchmark with a window that is similar enough."""
    items = written(items_of(benchmark, shingle), "leak-items")
    widths = sorted(r[0] for r in items.select("gw_width").distinct().collect())
    parts = [matches_of(docs, items, width, radius, least, block) for width in widths or [shingle]]
    return written(reduce(DataFrame.unionByName, parts), "leak-matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, gw_text (hash of the text), item_id, start_word and similarity of the best window, for every document and item with one.

    Of windows with equal similarity, one in which a shared shingle has its place in the item comes first, then the earlier.
    A text with fewer words than a shingle matches only items as short. Null and empty texts match nothing; repeated rows count once; null ids
    stay null. An empty documents or benchmark table gives no rows. Other columns are not read.
    """
    best = matches(docs, benchmark, **options)
    names = benchmark.select("item_id", F.xxhash64("text").alias("gw_i")).distinct()
    best = best.join(names, "gw_i").groupBy("gw_text", "item_id").agg(F.max("best").alias("best"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("gw_text")).distinct().join(best, "gw_text")
    return rows.select("doc_id", "gw_text", "item_id", (-F.col("best.start")).alias("start_word"), "best.similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns as they are, without those that hold a benchmark item; rows with equal texts go or stay together."""
    bad = matches(docs, benchmark, **options).select("gw_text").distinct()
    bad = F.broadcast(bad) if bad.count() <= FEW else bad
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["gw_text"], "left_anti")
