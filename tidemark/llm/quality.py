"""Quality rules: counts of a text and the divergence of its histograms from its language's; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut, shielded, words, written

SYMBOLS = "#*$%&|<>"
#: Common words of a language that its histogram counts: the most frequent ones, in lower case, of any length.
TOP_WORDS = 16
#: Languages whose references are sent to all tasks; more are joined by a shuffle.
SENT_LANGS = 20_000
#: Guards: the divergences count only from so many words and letters on.
MIN_WORDS = 50
MIN_CHARS = 200
#: Jensen-Shannon distances (0 to 1) above which a text is too unlike its language.
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.45
_POS_BITS = 24
_CLASSES = ("__lower", "__space", "__upper", "__digit", "__other")


def _classes(docs: DataFrame, text: str) -> DataFrame:
    """Code points of each class: lower-case and caseless letters, spaces, capitals, digits, the rest."""
    return (
        docs.withColumn("__r1", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[a-z\p{Ll}\p{Lo}]+", ""))
        .withColumn("__r2", F.translate("__r1", SPACE, ""))
        .withColumn("__r3", F.regexp_replace("__r2", r"[A-Z\p{Lu}]+", ""))
        .withColumn("__r4", F.regexp_replace("__r3", r"\d+", ""))
        .withColumn("__lower", F.coalesce(F.length(text), F.lit(0)) - F.length("__r1"))
        .withColumn("__space", F.length("__r1") - F.length("__r2"))
        .withColumn("__upper", F.length("__r2") - F.length("__r3"))
        .withColumn("__digit", F.length("__r3") - F.length("__r4"))
        .withColumn("__other", F.length("__r4"))
    )


def references(features: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """Rows (__lang, __ref_chars, __common, __ref_words): each language's shares of the character classes, its most
    frequent words, and their shares and the rest's. features are those of _features; counts are over all documents.
    """
    sums = features.filter("__lang IS NOT NULL").groupBy("__lang").agg(F.sum("__n").alias("n"), *[F.sum(c).alias(c) for c in _CLASSES]).filter("n > 0")
    each = features.filter("__lang IS NOT NULL AND __n > 0").select("__lang", F.explode(F.split("__words", "\n\n")).alias("w"))
    counts = each.groupBy("__lang", F.btrim(F.col("w"), F.lit("\n")).alias("w")).agg(F.count(F.lit(1)).alias("c"))
    best = Window.partitionBy("__lang").orderBy(F.desc("c"), "w")
    top = counts.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= top_words)
    top = top.groupBy("__lang").agg(F.sort_array(F.collect_list(F.struct("k", "w", "c"))).alias("t"))  # top_words rows
    total = sum((F.col(c) for c in _CLASSES[1:]), F.col(_CLASSES[0])).cast("double")
    shares = F.transform("t", lambda x: x["c"] / F.col("n"))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))
    return sums.join(top, "__lang").select("__lang", F.array(*[F.col(c) / total for c in _CLASSES]).alias("__ref_chars"), F.transform("t", lambda x: x["w"]).alias("__common"), F.concat(shares, F.array(rest)).alias("__ref_words"))


def _js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of shares."""
    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)))


def _features(docs: DataFrame, text_col: str, lang_col: str, keep: list[str]) -> DataFrame:
    """Counts of each text, and its words in lower case, each between two line feeds."""
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"), lang.alias("__lang"), words(text).alias("__w"))
    d = _classes(d, "__text").withColumn("__n", F.size("__w"))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    # Hashes of windows of five from hashes of words, pairs and fours; each step reads what the one before it stored.
    d = d.withColumn("__h1", F.transform("__w", lambda x: F.xxhash64(x)))

    def joined(left: str, right: str, step: int, size: int) -> Column:
        n = F.col("__n") - (size - 1)
        return F.when(n > 0, F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))

    d = d.withColumn("__h2", joined("__h1", "__h1", 1, 2)).withColumn("__h4", joined("__h2", "__h2", 2, 4)).withColumn("__h", joined("__h4", "__h1", 4, 5))
    # Texts that repeat a window: hashes cut to 40 bits and followed by positions, in order, show candidates; the few
    # candidates are then compared in full, as strings of hash and position.
    d = d.withColumn("__again", F.size(F.array_distinct("__h")) < F.size("__h"))
    cut40 = F.sort_array(F.transform("__h", lambda x, i: F.shiftleft(F.shiftright(x, _POS_BITS), _POS_BITS).bitwiseOR(i.cast("long"))))
    d = d.withColumn("__c", F.when(F.col("__again") & (F.col("__n") < (1 << _POS_BITS)), cut40).when(F.col("__again"), F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long") - 5)).otherwise(F.array().cast("array<bigint>")))
    c, h, none = F.col("__c"), F.col("__h"), F.lit("")
    top = lambda x: F.shiftright(x, _POS_BITS)
    near = F.filter(c, lambda x, j: (F.col("__n") >= (1 << _POS_BITS)) | (top(x) == top(F.get(c, j - 1))) | (top(x) == top(F.get(c, j + 1))))
    d = d.withColumn("__c2", F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << _POS_BITS) - 1).cast("long")).cast("int")))
    d = d.withColumn("__s", F.sort_array(F.transform("__c2", lambda i: F.concat(F.lpad(F.hex(F.get(h, i)), 16, "0"), F.lpad(i.cast("string"), 10, "0")))))
    s = F.col("__s")
    same = lambda x, y: F.substring(x, 1, 16) == F.substring(F.coalesce(y, none), 1, 16)
    marked = F.filter(F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), F.substring(x, 17, 10).cast("int"))), lambda x: x.isNotNull())
    d = d.withColumn("__p", F.sort_array(marked))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)
    return d.select(
        *[F.col(f"`{c}`") for c in keep], "__lang", "__n", *_CLASSES,
        (F.length("__text") - F.col("__space")).cast("long").alias("__word_chars"),
        (F.col("__other") - F.length(F.translate("__r4", SYMBOLS, ""))).cast("long").alias("__n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        F.when(F.size(p) > 0, covered).otherwise(F.lit(0)).cast("long").alias("__n_repeat_words"),
        F.concat(F.lit("\n"), F.lower(F.array_join("__w", "\n\n")), F.lit("\n")).alias("__words"),
    )


@shielded
def quality(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    keep: list[str] | None = None,
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Columns of keep (all by default) and __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words,
    __base_failed, __char_distance, __word_distance, __kept for each row.

    A text fails the base rules with under 10 words or over a fifth of them in repeated windows of five words. It fails
    the divergence rule if it has min_words words and min_chars code points and its histogram of character classes or
    of its language's common words lies farther from the language's (Jensen-Shannon distance) than allowed.

    Nulls: a null text has no words and fails; a null language is held against the pooled characters only. A row counts
    by itself, repeated or not. An empty table gives no rows.

    One pass reads the texts; its counts and words are stored, and the references and verdicts come from them.
    """
    keep = docs.columns if keep is None else keep
    d = written(_features(docs, text_col, lang_col, keep))
    pooled = d.agg(*[F.sum(c).alias(c) for c in _CLASSES]).first()
    refs = cut(references(d))
    d = d.join(F.broadcast(refs) if refs.count() <= SENT_LANGS else refs, "__lang", "left")
    all_chars = F.array(*[F.lit(x / (sum(pooled) or 1)) for x in pooled]) if pooled[0] is not None else F.lit(None).cast("array<double>")
    n, s, size = F.col("__n").cast("double"), F.col("__words"), F.octet_length("__words")
    count = lambda c: (size - F.octet_length(F.replace(s, F.concat(F.lit("\n"), c, F.lit("\n")), F.lit("")))) / (F.octet_length(c) + 2)
    d = d.withColumn("__counts", F.transform(F.coalesce("__common", F.array().cast("array<string>")), count))
    rest = n - F.aggregate("__counts", F.lit(0.0), lambda a, b: a + b)
    shares = F.transform(F.concat("__counts", F.array(rest)), lambda x: x / n)
    total = sum((F.col(c) for c in _CLASSES[1:]), F.col(_CLASSES[0])).cast("double")
    guard = (F.col("__n") >= min_words) & (total >= min_chars)
    chars = F.array(*[F.col(c) / total for c in _CLASSES])
    base = (F.col("__n") < 10) | (F.lit(100) * F.col("__n_repeat_words") > F.lit(20) * F.col("__n"))
    d = d.withColumn("__char_distance", F.when(guard, _js_distance(chars, F.coalesce("__ref_chars", all_chars))))
    d = d.withColumn("__word_distance", F.when(guard, _js_distance(shares, F.coalesce("__ref_words", F.array(F.lit(1.0))))))
    far = (F.coalesce("__char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("__word_distance", F.lit(0.0)) > max_word_distance)
    return d.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__n").cast("long").alias("__n_words"), "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words",
        base.alias("__base_failed"), "__char_distance", "__word_distance", (~base & ~far).alias("__kept"),
    )
