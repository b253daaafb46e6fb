"""Quality rules: a table of thresholds compiled into one projection.

Everything is a built-in function over one row: no shuffle, no user function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.staging import documents

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec",
    "es": "de la que el en y los se del las por un no con su una para es al lo",
}
#: (name, statistic, low, high): a document within all bounds is kept. A bound of
#: None is open; so is any bound where the statistic is null.
THRESHOLDS = [
    ("mean_word_chars", "mean_word_chars", 2.5, 12.0),
    ("symbol_ratio", "symbol_ratio", None, 0.25),
    ("stop_word_ratio", "stop_word_ratio", 0.05, None),
    ("duplicate_line_ratio", "dup_line_ratio", None, 0.5),
    ("shouted_word_ratio", "shout_ratio", None, 0.5),
    ("table_line_ratio", "table_line_ratio", None, 0.5),
]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def window_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(w[i - 1], w[i], w[i + 1])


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first included.

    Each window is hashed; where all hashes differ, as in most texts, nothing repeats. Else each window becomes one long: its
    hash above, its place below, as many bits as the text needs. Sorted, equal windows are neighbours; windows without a neighbour
    of equal hash go, and the others are compared word by word. Where two neighbours of equal hash are different windows, all
    that are left are looked through for an equal one.
    """
    n = F.size(w)
    bits = F.length(F.bin(n)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: window_hash(w, i))
    alike = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)) == 0
    at = lambda x: x.bitwiseAND(mask).cast("int")

    def same(x: Column, y: Column) -> Column:
        i, j = at(x), at(y)
        return (w[i - 1] == w[j - 1]) & (w[i] == w[j]) & (w[i + 1] == w[j + 1])

    def paired(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(alike(x, F.get(s, k + 1)), F.lit(False)) | F.coalesce(alike(x, F.get(s, k - 1)), F.lit(False)))

    def found(s: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            above, below = F.get(s, k + 1), F.get(s, k - 1)
            else_ = F.exists(s, lambda y: (y != x) & alike(x, y) & same(x, y))
            return F.when(alike(x, above), F.when(same(x, above), True).otherwise(else_)).when(alike(x, below), F.when(same(x, below), True).otherwise(else_)).otherwise(False)

        twice = F.filter(s, again)
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(at(x), at(x) + 2)))))

    def counted(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, k: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR((k + 1).cast("long"))))
        within = F.transform(F.array(packed), lambda s: F.transform(F.array(paired(s)), found)[0])[0]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(within)

    return F.when(n < 4, F.lit(0)).otherwise(F.transform(F.array(hashes), counted)[0]).cast("long")


def statistics(text: Column, w: Column) -> dict[str, Column]:
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_table_lines": F.size(F.filter(lines, lambda x: x.contains(" | "))).cast("long"),
        "n_shouted": F.regexp_count(body, F.lit("(?=\\p{Lu})(?<![^ \\t-\\r])[\\p{Lu}]{2,}[^\\p{Ll} \\t-\\r]*(?![^ \\t-\\r])")).cast("long"),
        "n_stop_words": F.size(
            F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?\"'()#*$%&"))).isin(sorted({s for v in STOP_WORDS.values() for s in v.split()})))
        ).cast("long"),
        "n_repeat_words": repeated_words(w),
    }


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "shout_ratio": ("n_shouted", "n_words"),
    "table_line_ratio": ("n_table_lines", "n_lines"),
}


def verdict(rules=THRESHOLDS) -> Column:
    """The table as one boolean over the columns of ``statistics``; null ratios pass."""

    def rule(stat: str, low, high) -> Column:
        top, bottom = RATIOS[stat]
        r = F.try_divide(F.col(top), F.col(bottom))
        tests = ([r >= low] if low is not None else []) + ([r <= high] if high is not None else [])
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(True))

    return reduce(lambda a, b: a & b, [rule(*x[1:]) for x in rules], F.lit(True))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=THRESHOLDS, lang_col: str | None = None) -> DataFrame:
    """Statistics of each whole text, base_failed and kept, one row per input row.

    A null or empty text has no words and fails. Repeated rows each get their
    own result, whatever their identifiers; an empty table gives an empty one; other columns are ignored.
    A text of any length is read as a whole, in one row's memory. Where ``lang_col`` names a language that STOP_WORDS
    has no list for, the stop-word ratio is null, so its rule is open; without the column or its value it is judged by all lists.
    """
    unlisted = F.lit(False) if lang_col is None else F.coalesce(~F.col(lang_col).isin(*STOP_WORDS), F.lit(False))
    # Words come out of a generator of one row: a filter on the result isn't pushed below it, where each look at a word would split the text anew.
    base = docs.select(F.col(id_col), F.col(text_col).alias("_text"), unlisted.alias("_unlisted"), F.explode(F.array(words(F.col(text_col)))).alias("_w"))
    stats = statistics(F.col("_text"), F.col("_w"))
    stats["n_stop_words"] = F.when(~F.col("_unlisted"), stats["n_stop_words"])
    s = base.select(id_col, *[c.alias(k) for k, c in stats.items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.select("*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), lang_col="lang")


_STOP = ", ".join("'" + s + "'" for s in sorted({s for v in STOP_WORDS.values() for s in v.split()}))
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang NOT IN ('en', 'de', 'fr', 'es'), FALSE) AS unlisted, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(l, lambda x: contains(x, ' | ')))::BIGINT AS n_table_lines,
         len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{Lu}}{{2,}}[^\\p{{Ll}}]*')))::BIGINT AS n_shouted,
         CASE WHEN NOT unlisted THEN len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"''()#*$%&')) IN ({_STOP})))::BIGINT END AS n_stop_words,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.25
          AND coalesce(n_stop_words / n_words >= 0.05, TRUE) AND n_dup_lines / n_lines <= 0.5 AND n_shouted / n_words <= 0.5
          AND n_table_lines / n_lines <= 0.5 AS kept
FROM f
"""
