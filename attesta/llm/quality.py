"""Quality rules in Spark SQL functions only: base counts, and divergence from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import sealed, text_of, unsealed
from attesta.plans.lineage import cut

_SPACE = "[ \\t-\\r]"
SYMBOLS = "#*$%&|<>"

#: Character classes as Java patterns, each counted in what the ones before leave; the last class is what none matches.
CLASSES = {
    "lower": "\\p{Ll}+",
    "blank": "[ \\t-\\r]+",
    "upper": "\\p{Lu}+",
    "stop": "[.,;:!?'\"()-]+",
    "symbol": "[#*$%&|<>]+",
    "digit": "\\p{N}+",
    "letter": "\\p{L}+",
}

def _bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


#: Bits for a window's place in its text, beside the bits of its hash.
_PLACE = 20


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, the first included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only texts with a repeated window sort theirs: by hash
    and place in one number, or, where the bits do not do (a clash, or a text of a million words), by a pair.
    """
    hashes = _bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, window))),
    )

    def length(starts: Column) -> Column:
        return _bind(
            F.sort_array(F.filter(starts, lambda i: i.isNotNull())),
            lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b),
        )

    def packed(h: Column) -> Column:
        runs = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, _PLACE).bitwiseOR(i.cast("long"))))
        place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
        alike = lambda x, y: F.shiftright(x, _PLACE) == F.shiftright(y, _PLACE)

        def counted(s: Column) -> Column:
            clash = F.exists(F.zip_with(s, F.slice(s, 2, F.size(s) - 1), lambda x, y: alike(x, y) & (F.get(h, place(x)) != F.get(h, place(y)))), lambda c: c)
            starts = F.transform(s, lambda x, i: F.when(alike(F.get(s, i - 1), x) | alike(F.get(s, i + 1), x), place(x)))
            return F.when(F.coalesce(clash, F.lit(False)), paired(h)).otherwise(length(starts))

        return _bind(runs, counted)

    def paired(h: Column) -> Column:
        runs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return length(_bind(runs, lambda s: F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))))

    counted = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).when(F.size(h) < 1 << _PLACE, packed(h)).otherwise(paired(h)))
    return F.when(F.size(words) > window, counted).otherwise(0).cast("long")


def _peeled(text: Column, patterns: list[str]) -> Column:
    """Characters left before each pattern and after the last one, as each takes its own away."""
    if not patterns:
        return F.array(F.length(text))
    return F.concat(F.array(F.length(text)), _bind(F.regexp_replace(text, patterns[0], ""), lambda rest: _peeled(rest, patterns[1:])))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE + "+"), "")


def common_words(docs: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(_word_lang, _words): the ``most`` words that most documents of each language have, ties by the word.

    Each text counts a word once, so a spammed word does not become common. Counts are summed before they are shuffled, and
    each task passes on its ``most`` best words of a language only.
    """
    words = docs.select(_lang(lang_col), F.explode(F.array_distinct(_words(text_of(text_col)))).alias("word"))
    counts = words.groupBy("_lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("place", place).where(F.col("place") <= most)
    return best.groupBy(F.col("_lang").alias("_word_lang")).agg(F.array_sort(F.collect_list("word")).alias("_words"))


#: Languages whose common words are one set of the plan; with more of them each text's words are looked up in its own language's.
LANGUAGES = 1000


def _is_common(known: DataFrame):
    """Whether a word is common in the text's language (or in any, which costs time only)."""
    if known.count() > LANGUAGES:
        return lambda w: F.array_contains("_words", w)
    listed = sorted({w for r in known.collect() for w in r["_words"]})
    return lambda w: w.isin(listed) if listed else F.lit(False)


def _lang(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang")


def measures(docs: DataFrame, text_col: str, lang_col: str, drop_text: bool = False, most: int = 30) -> DataFrame:
    """Adds the base counts, and the histograms ``_chars`` and ``_common`` (of the language's common words), to ``docs``."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    known = cut(common_words(docs, text_col, lang_col, most))
    split = docs.withColumns({"_text": text_of(text_col), "_lang": _lang(lang_col)}).join(known, F.col("_lang") == F.col("_word_lang"), "left").withColumn("_split", _words(text))
    words = F.col("_split")
    chars = _bind(_peeled(text, list(CLASSES.values())), lambda left: F.transform(left, lambda x, i: (x - F.coalesce(F.get(left, i + 1), F.lit(0))).cast("long")))
    # hits between blanks of their own: a word's count is what its removal shortens them by
    split = split.withColumn("_hits", F.concat(F.lit(" "), F.array_join(F.filter(words, _is_common(known)), "  "), F.lit(" ")))
    listed = [F.get("_words", F.lit(k)) for k in range(most)]
    common = [((F.octet_length("_hits") - F.octet_length(F.replace(F.col("_hits"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("long") for w in listed]
    counted = split.select(
        *[c for c in docs.columns if not drop_text or c != text_col],
        "_lang",
        F.size(words).cast("long").alias("_n_words"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("_n_dup_lines"),
        repeated_words(words).alias("_n_repeat_words"),
        chars.alias("_chars"),
        F.filter(F.array(*common), lambda x: x.isNotNull()).alias("_common"),
        F.length(text).cast("long").alias("_n_chars"),
    )
    at = {name: F.get(F.col("_chars"), k) for k, name in enumerate(CLASSES)}
    return counted.withColumns({"_word_chars": F.col("_n_chars") - at["blank"], "_n_symbols": at["symbol"]})


def _js_distance(doc: Column, ref: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count arrays; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def distance(t: Column) -> Column:
        def one(x: Column, y: Column) -> Column:
            p, q = x / t["d"], y / t["r"]
            return term(p, (p + q) / 2) + term(q, (p + q) / 2)

        return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(doc, ref, one)) / 2))

    return _bind(F.struct(total(doc).alias("d"), total(ref).alias("r")), lambda t: F.when((t["d"] > 0) & (t["r"] > 0), distance(t)))


def judge(
    docs: DataFrame,
    *,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_char_distance: float = 0.34,
    min_chars: int = 100,
    max_word_distance: float = 0.75,
    min_words_for_distance: int = 100,
    common: int = 30,
    min_common_share: float = 0.1,
    drop_text: bool = False,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``docs`` with counts, distances and the verdict ``_kept``.

    A base failure is fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in repeated windows.
    Else a document goes whose character classes are further than ``max_char_distance`` from its language's (given at least
    ``min_chars`` characters), or its common words further than ``max_word_distance`` (given ``min_words_for_distance`` words):
    the guards keep short texts, whose histograms say little. A language's reference is the sum of the histograms of all its
    documents without a base failure; null languages share one with the empty name. Its common words are the ``common`` ones that
    most of its documents have. Words decide only where these are common indeed, ``min_common_share`` of the language's words at
    least, which they are not in a script without blanks; a document without any is then as far as can be. Null and empty texts have no words and fail. Every row
    gives one row, repeated ones alike; very long texts are measured whole; an empty table gives an empty one. With ``drop_text``
    the texts are not carried along.
    """
    docs, named = sealed(docs)
    out = _judged(docs, min_words, max_repeat_percent, max_char_distance, min_chars, max_word_distance, min_words_for_distance, common, min_common_share, drop_text, named[text_col], named[lang_col])
    new = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_char_distance", "_word_distance", "_kept"]
    return unsealed(out, named, dict(zip(new, new, strict=True)))


def references(measured: DataFrame, common: int = 30) -> DataFrame:
    """The summed histograms of each language, and its words: one row a language."""
    sums = [F.sum(F.get(c, k)).alias(f"{c}{k}") for c, n in (("_chars", len(CLASSES) + 1), ("_common", common)) for k in range(n)]
    added = measured.where(~F.col("_base_failed")).groupBy("_lang").agg(F.sum("_n_words").alias("_ref_words"), *sums)
    listed = F.filter(F.array(*[f"_common{k}" for k in range(common)]), lambda x: x.isNotNull())
    return added.select(F.col("_lang").alias("_ref_lang"), "_ref_words", F.array(*[f"_chars{k}" for k in range(len(CLASSES) + 1)]).alias("_ref_chars"), listed.alias("_ref_common"))


def _judged(docs: DataFrame, min_words: int, max_repeat_percent: int, max_char_distance: float, min_chars: int, max_word_distance: float, min_words_for_distance: int, common: int, min_common_share: float, drop_text: bool, text_col: str, lang_col: str) -> DataFrame:
    measured = measures(docs, text_col, lang_col, drop_text, common)
    measured = measured.withColumn("_base_failed", (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > max_repeat_percent * F.col("_n_words")))
    if drop_text:  # narrow: written once; with texts they are measured twice rather than written
        measured = cut(measured)
    out = measured.join(cut(references(measured, common)), F.col("_lang") == F.col("_ref_lang"), "left")
    out = out.withColumns({"_char_distance": _js_distance(F.col("_chars"), F.col("_ref_chars")), "_word_distance": _js_distance(F.col("_common"), F.col("_ref_common"))})
    far_chars = (F.col("_n_chars") >= min_chars) & (F.coalesce("_char_distance", F.lit(0.0)) > max_char_distance)
    listed = F.aggregate("_ref_common", F.lit(0).cast("long"), lambda a, b: a + b)
    spoken = F.coalesce((listed > 0) & (listed >= min_common_share * F.col("_ref_words")), F.lit(False))
    far_words = spoken & (F.col("_n_words") >= min_words_for_distance) & (F.coalesce("_word_distance", F.lit(1.0)) > max_word_distance)
    return out.withColumn("_kept", ~F.col("_base_failed") & ~far_chars & ~far_words)


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, as they were.

    The verdict follows from text and language, so texts are judged without being carried along, and the rejected ones are left
    out by the hash and the length of the text and the language.
    """
    plain, named = sealed(docs)
    text, lang = F.col(named[text_col]), F.col(named[lang_col])
    key = {"_h": F.xxhash64(text_of(named[text_col])), "_l": F.octet_length(F.coalesce(text, F.lit(""))), "_g": F.coalesce(lang.cast("string"), F.lit(""))}
    judged = judge(plain.select(text.alias("text"), lang.alias("lang"), *[c.alias(k) for k, c in key.items()]), drop_text=True, **options)
    bad = judged.where(~F.col("_kept")).select(*key).distinct()
    return unsealed(plain.withColumns(key).join(bad, list(key), "left_anti"), named)
