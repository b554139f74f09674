"""Benchmark decontamination on Spark columns only.

Every benchmark text becomes windows of consecutive words. One word of a window, its
longest, is its anchor. The anchors' hashes make a bit set of fixed size that travels with
the plan; each document keeps only the positions of words in that set, with the words
around them. These few candidates meet the windows by anchor and are compared word by
word, so a result never rests on a hash.

Texts are scanned once and never shuffled: what is shuffled is one narrow row per document
and one per candidate that held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainshift.llm.textnorm import CASED_GAP, PIECE, ascii_words

WIDTH = 13
#: Bits of the anchor set, whatever the size of the benchmark; 128 KiB.
SET_BITS = 1 << 20
#: Up to so many windows (a few hundred bytes each) the join broadcasts them.
BROADCAST_WINDOWS = 100_000


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                      width: int = WIDTH) -> DataFrame:
    """One row per distinct window: anchor, off (its place), win (words), items.

    An item of fewer words than the width is one window; an item without words has none.
    Null items and texts are allowed; a null item_id counts as the text 'null'.
    """
    w = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
                         ascii_words(F.col(text)).alias("words"))
    w = w.where(F.size("words") > 0).withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))))
    w = w.select("item", F.slice("words", F.col("start") + 1, F.lit(width)).alias("win"))
    w = w.groupBy("win").agg(F.collect_set("item").alias("items"))
    longest = F.array_max(F.transform("win", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"))))
    w = w.withColumn("off", -longest["i"])
    return w.select(F.element_at("win", F.col("off") + 1).alias("anchor"), "off", "win", "items")


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SET_BITS))


def _anchor_set(windows: DataFrame) -> Column:
    """A constant array of 64-bit words with a bit for every anchor's hash."""
    slot = windows.select(_slot(F.col("anchor")).alias("s"))
    bit = F.expr("shiftleft(1L, CAST(s % 64 AS INT))")
    words = {r["k"]: r["bits"] for r in slot.groupBy(F.expr("s div 64").alias("k"))
             .agg(F.bit_or(bit).alias("bits")).collect()}  # SET_BITS / 64 rows at most
    text = ",".join(str(words.get(k, 0)) for k in range(SET_BITS // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: doc, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans are the merged [start, end) word ranges inside occurring windows. Null and empty
    texts have no words and no hits. Rows that repeat both id and text give one row; rows
    of one id with different texts give one row each. An empty benchmark hits nothing.
    Other columns of either table are not read.
    """
    windows = benchmark_windows(benchmark, item, item_text, width)
    bits = _anchor_set(windows)
    if windows.count() <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)

    words = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"),
                        ascii_words(F.col(text)).alias("words"))
    in_set = lambda w: F.get(bits, F.floor(_slot(w) / 64).cast("int"))
    marked = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    held = F.filter(marked, lambda x: F.getbit(in_set(x["w"]), F.pmod(_slot(x["w"]), F.lit(64)).cast("int")) == 1)
    around = F.transform(held, lambda x: F.struct(
        x["w"].alias("w"), x["i"].alias("i"),
        F.least(x["i"], F.lit(width - 1)).alias("before"),
        F.slice(F.col("words"), F.greatest(x["i"] - (width - 2), F.lit(1)), F.lit(2 * width - 1)).alias("ctx")))
    rows = words.select("doc", "text_hash", F.size("words").cast("long").alias("n_words"),
                        F.explode_outer(around).alias("c"))
    rows = rows.select("doc", "text_hash", "n_words", F.col("c.w").alias("anchor"), F.col("c.i").alias("i"),
                       F.col("c.before").alias("before"), F.col("c.ctx").alias("ctx"))
    fits = (F.col("off") <= F.col("before")) & (
        F.slice("ctx", F.col("before") - F.col("off") + 1, F.size("win")) == F.col("win"))
    hits = rows.join(windows.withColumnRenamed("anchor", "w_anchor"),
                     (F.col("anchor") == F.col("w_anchor")) & fits, "left")
    start = F.col("i") - F.col("off")
    per = hits.groupBy("doc", "text_hash", "n_words").agg(
        F.collect_set(F.when(F.col("win").isNotNull(), F.struct(
            start.alias("s"), (start + F.size("win")).alias("e")))).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.array().cast("array<struct<s:int,e:int>>")
    merged = F.aggregate(F.array_sort("ranges"), zero, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(x))))
    per = per.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    per = per.withColumn("n_hit", n_hit)
    return per.select(
        F.col("doc").alias(doc), "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, report: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the report does not call contaminated, all columns as they were."""
    bad = report.where("contaminated").select(F.col(doc).alias("bad_doc"), F.col("text_hash").alias("bad_hash"))
    return docs.join(bad, docs[doc].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs[text]) == bad["bad_hash"]), "left_anti")


def cut_spans(docs: DataFrame, report: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with the hit words, and the gaps after them, cut out of the text."""
    spans = report.where("n_hit > 0").select(F.col(doc).alias("hit_doc"), F.col("text_hash").alias("hit_hash"),
                                             F.col("spans").alias("hit_spans"))
    pieces = F.regexp_extract_all(docs[text], F.lit(PIECE), F.lit(0))
    shift = F.when(F.regexp_like(docs[text], F.lit(r"\A" + CASED_GAP)), 1).otherwise(0)
    kept = F.filter(pieces, lambda p, i: ~F.exists(
        spans["hit_spans"], lambda s: (i >= s["s"] * 2 + shift) & (i < s["e"] * 2 + shift)))
    joined = docs.join(spans, docs[doc].eqNullSafe(spans["hit_doc"]) & (F.xxhash64(docs[text]) == spans["hit_hash"]), "left")
    cut = F.when(spans["hit_spans"].isNull(), docs[text]).otherwise(F.array_join(kept, "")).alias(text)
    return joined.select(*[cut if c == text else docs[c] for c in docs.columns])
