"""Quality rules as a ledger: every rule is evaluated once, policies are applied to its bits.

``ledger`` measures each whole text and sets bit i of ``fail_bits`` where rule i fails. The
ledger is a table to store; a policy is a named, versioned set of rules, so that applying,
comparing or ablating policies reads 8 bytes a document and never a text. All of it is
column expressions; nothing is shuffled but counts per distinct bit pattern.

A null text has no words and no lines, as the empty text. Rows with a null id, repeated rows
and ties are rows like any other; an empty table gives an empty ledger and no ablation rows.
Only the id, the text and the columns in ``keep`` are taken from the input, under the names
given, so further columns of any name do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in the order of their bits: what fails, over the measurements. New ones go to the end, so that stored bits keep their meaning.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
    "digits": "100 * n_digits > 50 * word_chars",
}
#: Policies by name and version: the rules that a document may not fail.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "prose-1": tuple(RULES),
}
SYMBOLS, CAPITALS, DIGITS = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
BLANK = "".join(map(chr, (32, 9, 10, 11, 12, 13)))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 3


def _of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(df: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """Number of words that lie in a window found twice or more in their own row.

    Windows are sorted with their places, so equal ones are neighbours; the places of those
    that have an equal neighbour, again in order, cover a union of short ranges. Rows whose
    windows all differ are not sorted.
    """
    at = F.sequence(F.lit(0), F.size(words) - window)
    gram = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(window)])
    grams = F.when(F.size(words) > window, F.transform(at, gram))
    df = df.withColumn("_grams", grams)
    placed = F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(placed)))
    twin = F.filter("_sorted", lambda x, k: (F.get("_sorted", k - 1)["g"] == x["g"]) | (F.get("_sorted", k + 1)["g"] == x["g"]))
    places = F.sort_array(F.transform(twin, lambda x: x["i"]))
    count = F.aggregate(
        places, F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(window), p - s["last"])).alias("n")), lambda s: s["n"])
    return df.withColumn(out, F.coalesce(count, F.lit(0).cast("long"))).drop("_grams", "_sorted")


def measure(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The measurements of every whole text."""
    rows = docs.select(F.col(doc).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    body, word = F.btrim("_text", F.lit(BLANK)), F.translate("_text", BLANK, "")
    rows = rows.withColumns({
        "_words": F.when(body != "", F.split(body, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>")),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: F.translate(x, BLANK, "") != "")})
    rows = repeated_words(rows, "_words", "n_repeat_words")
    return rows.select("doc_id", *keep, *[c.cast("long").alias(n) for n, c in {
        "n_words": F.size("_words"), "word_chars": F.length(word), "n_symbols": _of(F.col("_text"), SYMBOLS),
        "n_capitals": _of(F.col("_text"), CAPITALS), "n_digits": _of(F.col("_text"), DIGITS), "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": F.col("n_repeat_words")}.items()])


def ledger(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, the measurements and ``fail_bits`` (long), a row per row."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long") for i, rule in enumerate(RULES.values())]
    return measure(docs, doc, text, keep).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, given by its name or as rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def fails(policy: str | tuple[str, ...]) -> Column:
    """True where a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) != 0


def failed_rules(bits: Column) -> Column:
    """The names behind the bits, in their order."""
    names = F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(RULES)])
    return F.filter(names, lambda x: x.isNotNull())


def policy_counts(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, policy, n_docs, n_kept) for several policies from one pass over the bits."""
    each = rows.groupBy(*by, "fail_bits").agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).cast("long").alias("mask")) for p in policies])
    each = each.select(*by, "fail_bits", "n", F.inline(table))
    kept = F.when(F.col("fail_bits").bitwiseAND(F.col("mask")) == 0, F.col("n")).otherwise(0)
    return each.groupBy(*by, "policy").agg(F.sum("n").alias("n_docs"), F.sum(kept).alias("n_kept"))


def ablation(rows: DataFrame, policy: str | tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """What each rule of a policy does: n_docs, n_kept, n_failed by it, n_alone (by no other), n_kept_without it.

    Documents are counted per distinct pattern of the policy's bits, at most 2^rules, before
    rules are set against patterns.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    each = rows.groupBy(*by, bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = POLICIES[policy] if isinstance(policy, str) else policy
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in names])
    each = each.select(*by, "bits", "n", F.inline(table))
    n = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy(*by, "rule").agg(
        F.sum("n").alias("n_docs"), n(bits == 0).alias("n_kept"), n(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        n(bits == bit).alias("n_alone"), n((bits == 0) | (bits == bit)).alias("n_kept_without"))
