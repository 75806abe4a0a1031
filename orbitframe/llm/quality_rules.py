"""Quality rules by distribution divergence, in native column expressions only.

A document's histogram of character classes and its histogram of its language's common words are compared to the language's
references, the sums of those histograms over all documents of the language, by Jensen-Shannon distance (base 2, so 0 to 1).
A document is kept if it passes the base rules and neither distance is above its threshold. Guards: a distance counts only from
MIN_CHARS characters and MIN_TOKENS words on, and the word distance only for a language with a word list.

A null text counts as empty: all counts are 0, base_failed is true. A null language is a language of its own without word list.
Rows with equal ids are judged one by one. Nothing is shuffled but one row per task and language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import SPACE, let, stored

#: Frequent function words.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "with", "on", "be", "are", "this"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
#: Classes of characters, in the order in which they are deleted and counted; what is left is the rest.
CHARACTER_CLASSES = ["[a-z]+", f"[{SPACE}]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", r"[#*$%&|<>@^~_=+/\\{}\[\]`]+"]
#: Counted by themselves, in what is left after two classes.
SYMBOLS = "[#*$%&|<>]+"
MIN_CHARS, MIN_TOKENS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.28
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Positions below this are packed with 42 bits of a hash into one long; longer texts sort pairs instead.
PACK_BITS = 22


def words_of(text: Column) -> Column:
    """The words; only an empty text has an empty part, which goes."""
    return F.array_remove(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+"), "")


def repeated_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. words and n must be plain columns.

    Windows are sorted by hash; neighbours with equal hash and equal words are repeats. Their positions, sorted again, cover
    min(3, distance to the next) words each.
    """
    mask = (1 << PACK_BITS) - 1

    def word(i: Column) -> Column:
        return F.get(words, i)

    def hashed(first: Column, i: Column) -> Column:
        return F.xxhash64(first, word(i + 1), word(i + 2))

    def equal(p: Column, q: Column) -> Column:
        return (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))

    def covered(positions: Column) -> Column:
        steps = let(F.sort_array(positions), lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.get(p, i + 1) - x)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(keys: Column, near: Callable[[Column, Column], Column]) -> Column:
        def flagged(s: Column) -> Column:
            return F.filter(s, lambda x, i: near(F.get(s, i + 1), x) | near(F.get(s, i - 1), x))

        return let(F.sort_array(keys), flagged)

    firsts = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    packed = F.transform(firsts, lambda x, i: hashed(x, i).bitwiseAND(F.lit(-mask - 1)).bitwiseOR(i.cast("long")))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask).cast("long")).cast("int")

    def near_packed(a: Column, b: Column) -> Column:
        return F.coalesce((F.shiftright(a.bitwiseXOR(b), PACK_BITS) == 0) & equal(place(a), place(b)), F.lit(False))

    def near_pair(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & equal(a["i"], b["i"]), F.lit(False))

    pairs = F.transform(firsts, lambda x, i: F.struct(hashed(x, i).alias("h"), i.alias("i")))
    short = covered(F.transform(repeats(packed, near_packed), place))
    long_ = covered(F.transform(repeats(pairs, near_pair), lambda x: x["i"]))
    return F.when(n < 3, 0).when(n <= mask, short).otherwise(long_).cast("long")


def character_counts(text: Column) -> Column:
    """[symbols, a count per class..., the rest]: each class is deleted from what the one before has left, ever less text."""

    def step(left: Column, k: int, before: list[Column]) -> Column:
        if k == len(CHARACTER_CLASSES):
            return F.array(*before, F.length(left))
        if k == 2:
            before = [F.length(left) - F.length(F.regexp_replace(left, SYMBOLS, "")), *before]
        return let(F.regexp_replace(left, CHARACTER_CLASSES[k], ""), lambda rest: step(rest, k + 1, [*before, F.length(left) - F.length(rest)]))

    return step(text, 0, [])


def common_counts(words: Column, n: Column, lang: Column) -> Column:
    """A count per common word of the language, then the other words; null without word list. Words count in lower case."""
    lists, every = F.lit(None).cast("array<string>"), sorted({w for listed in COMMON_WORDS.values() for w in listed})
    for name, listed in COMMON_WORDS.items():
        lists = F.when(lang == name, F.array(*[F.lit(f" {w} ") for w in listed])).otherwise(lists)
    longest = max(map(len, every))
    found = F.transform(F.filter(words, lambda x: (F.length(x) <= longest) & F.lower(x).isin(every)), F.lower)
    line = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
    counts = let(line, lambda t: F.transform(lists, lambda w: ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("int")))
    return let(counts, lambda c: F.concat(c, F.array(n - F.aggregate(c, F.lit(0), lambda a, x: a + x))))


def histograms(docs: DataFrame, key: str, column: str, lang: str) -> DataFrame:
    """One row per document: base counts, `chars` (a count per class, the rest last) and `common` (a count per common word,
    the other words last)."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), text.alias("text")).withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = rows.select(
        "key",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        dup_lines.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        F.length("text").alias("n_chars"),
        character_counts(F.col("text")).alias("counts"),
        common_counts(F.col("words"), F.col("n"), F.col("lang")).alias("common"),
    )
    counts = F.col("counts")
    return rows.select("key", "lang", "n_words", (F.col("n_chars") - counts[2]).cast("long").alias("word_chars"), counts[0].cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "n_chars", F.slice(counts, 2, len(CHARACTER_CLASSES) + 1).alias("chars"), "common")


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is null or sums to 0."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(F.lit(0.0))

    def divergence(x: Column, y: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(x, y, lambda p, q: term(p / total(x), q / total(y)))) / 2))

    return F.when((total(a) > 0) & (total(b) > 0), divergence(a, b))


def references(rows: DataFrame) -> DataFrame:
    """One row per language: the sums of the histograms of all its documents."""
    n = len(CHARACTER_CLASSES) + 1
    m = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(m)]
    listed = F.col("w0").isNotNull()
    return rows.groupBy("lang").agg(*sums).select(F.col("lang").alias("lang_"), F.array(*[F.col(f"c{i}") for i in range(n)]).alias("chars_"), F.when(listed, F.array(*[F.col(f"w{i}") for i in range(m)])).alias("common_"))


def judged(docs: DataFrame, key: str = "doc_id", column: str = "text", lang: str = "lang", max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    rows = stored(histograms(docs, key, column, lang))
    joined = rows.join(references(rows), F.col("lang").eqNullSafe(F.col("lang_")), "left")
    doubles = [F.transform(c, lambda x: x.cast("double")).alias(c) for c in ("chars", "chars_", "common", "common_")]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    n_tokens = F.aggregate("common", F.lit(0.0), lambda a, x: a + x)
    out = joined.select("key", *counts, "n_chars", *doubles)
    out = out.withColumns({
        "char_distance": F.when(F.col("n_chars") >= MIN_CHARS, F.round(distance(F.col("chars"), F.col("chars_")), 6)),
        "word_distance": F.when(n_tokens >= MIN_TOKENS, F.round(distance(F.col("common"), F.col("common_")), 6)),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))
    return out.select(F.col("key").alias(key), *counts, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")
