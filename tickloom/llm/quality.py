"""Quality rules: base counts of each text and its divergence from language references.

Native: DataFrame operations only; every count is made inside its row, so no word is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, let, text_or_empty

# Common words of each language whose use is compared.
COMMON_WORDS = {
    "en": "the of and to in a is that for it on was with be as by this are at from or an not have he his but they which you".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il sont avec ce ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como mas o pero sus le ha".split(),
}
LEXICON = sorted({w for words in COMMON_WORDS.values() for w in words})
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "wide")


def _without(text: Column, pattern: str) -> Column:
    """Number of characters that `pattern` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that come twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes of their words. Texts without a
    repeated window, the most, stop at the distinct count.
    """

    def covered(grams):
        def by_gram(pairs):
            def twice(x, i):
                before = F.when(i > 0, F.get(pairs, i - 1)["g"] == x["g"]).otherwise(F.lit(False))
                return before | F.coalesce(F.get(pairs, i + 1)["g"] == x["g"], F.lit(False))

            return F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["i"]))

        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        steps = let(let(pairs, by_gram), lambda p: F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(5), F.get(p, i + 1) - x), F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))  # each word is hashed once, not once a window
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))
    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) >= 6, found).otherwise(F.lit(0)).cast("long")


def word_runs(words: Column) -> Column:
    """array of (w, n): how often each common word comes."""
    common = F.filter(F.transform(words, F.lower), lambda w: w.isin(LEXICON))

    def runs(c):
        ends = F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: F.coalesce(F.get(c, i) != F.get(c, i - 1), F.lit(True)))
        return let(ends, lambda e: F.transform(e, lambda x, k: F.struct(F.get(c, x - 1).alias("w"), (x - F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0))).cast("long").alias("n"))))

    empty = F.array().cast("array<struct<w:string,n:bigint>>")
    return let(F.sort_array(common), lambda c: F.when(F.size(c) > 0, runs(c)).otherwise(empty))


def text_profile(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Base counts, character classes and common words of every whole text, one row per row of `docs`."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text_or_empty(text_col).alias("t"))
    d = d.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    t, words = F.col("t"), F.col("words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    upper, digit, wide = _without(t, "[A-Z]+"), _without(t, "[0-9]+"), _without(t, "[^\\x00-\\x7F]+")
    punctuation = _without(t, "[.,;:!?'\"()-]+")
    d = d.select(
        "doc_id", "lang",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        F.length(t).alias("n_chars"), upper.alias("upper"), digit.alias("digit"), punctuation.alias("punctuation"), wide.alias("wide"),
        _without(t, "[\\x00-\\x1F\\x21-\\x7F&&[^\\x09-\\x0DA-Za-z0-9.,;:!?'\"()-]]+").alias("symbol"),
        word_runs(words).alias("runs"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    lower = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("punctuation") - F.col("wide") - F.col("symbol")
    counts = {"lower": lower, "space": space}
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "runs",
        F.array(*[counts.get(c, F.col(c)).cast("long") for c in CLASSES]).alias("classes"),
    )


def language_references(profile: DataFrame) -> DataFrame:
    """(lang, ref_texts, ref_classes, ref_words, ref_n): shares over all texts of a language. One row per language."""
    sums = profile.groupBy("lang").agg(F.count("*").alias("ref_texts"), *[F.sum(F.get("classes", F.lit(i))).alias(c) for i, c in enumerate(CLASSES)])
    total = sum((F.col(c) for c in CLASSES), F.lit(0))
    classes = sums.select("lang", "ref_texts", F.array(*[F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in CLASSES]).alias("ref_classes"))
    words = (
        profile.select("lang", F.explode("runs").alias("r"))
        .groupBy("lang", F.col("r.w").alias("w")).agg(F.sum("r.n").alias("n"))
        .groupBy("lang").agg(F.collect_list(F.struct("w", "n")).alias("e"), F.sum("n").alias("ref_n"))
        .select("lang", "ref_n", F.map_from_entries(F.transform("e", lambda x: F.struct(x["w"], x["n"] / F.col("ref_n")))).alias("ref_words"))
    )
    return classes.join(words, "lang", "left")


def _half(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence in bits."""
    part = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", min_words: int = 20, min_common: int = 25, min_texts: int = 20, class_limit: float = 0.28, word_limit: float = 0.80) -> DataFrame:
    """One row per row of `docs`: base counts, both distances, base_failed and kept.

    Distances are square roots of the Jensen-Shannon divergence in bits from
    the shares over all texts of the row's language (null: a language of its
    own). A text of fewer than `min_words` words, or in a language of fewer
    than `min_texts` texts, is not judged by character classes, and one with
    fewer than `min_common` common words, or in a language with fewer, is
    not judged by words: its distance is null and doesn't count against it.
    Null and empty texts have no words and fail the base rule. Rows that
    share an id are judged each; other columns of `docs` play no part.

    The references are a table of one small row per language, which Spark
    sends to every task while it is below the session's broadcast size, and
    beyond that joins with hot languages split.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    profile = scratch.table(text_profile(docs, id_col, lang_col, text_col))
    d = profile.join(scratch.table(language_references(profile)), "lang", "left")
    d = d.withColumn("n_common", F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = F.aggregate(F.zip_with(F.transform("classes", lambda x: x / n_chars), "ref_classes", _half), F.lit(0.0), lambda a, x: a + x)
    seen = F.transform("runs", lambda r: F.struct((r["n"] / F.col("n_common")).alias("p"), F.coalesce(F.try_element_at("ref_words", r["w"]), F.lit(0.0)).alias("q")))
    by_word = let(seen, lambda s: F.aggregate(s, F.lit(0.5), lambda a, x: a + _half(x["p"], x["q"]) - x["q"] / 2))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    d = d.withColumn("class_distance", F.when((F.col("n_words") >= min_words) & (F.col("ref_texts") >= min_texts), root(by_class)))
    d = d.withColumn("word_distance", F.when((F.col("n_common") >= min_common) & (F.col("ref_n") >= min_common), root(by_word)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance",
    )
