"""Quality rules by line-first cleaning (operator 7). DataFrame functions only.

Every line is judged by itself: punctuation, navigation, boilerplate. Lines that fail are
removed; a document that loses too much of its text is rejected. The counts of the base rules
are taken from the whole text as it came.

All of it is a projection of one row, so nothing is shuffled and no group can be hot. Arrays used
inside a lambda are bound by an outer lambda, otherwise they would be computed once per element.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Characters between the entries of a menu.
SEPARATORS = "|›»•"
#: What a line of boilerplate says.
BOILERPLATE = ["all rights reserved", "privacy policy", "terms of use", "terms of service",
               "cookie policy", "accept cookies", "enable javascript", "skip to content",
               "sign up for our newsletter", "lorem ipsum"]
#: Marks other than letters that a line may have per word, menu separators per word.
MOST_MARKS, MOST_SEPARATORS = 1 / 3, 1 / 4
#: Share of a document's word characters that may be lost.
MOST_LOST = 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def line_passes(line: Column) -> Column:
    """Does a line with a word pass the rules of punctuation, navigation and boilerplate?"""
    words = F.regexp_count(line, F.lit(WORD))
    marks = F.length(line) - F.length(without(line, SYMBOLS + "!"))
    separators = F.length(line) - F.length(without(line, SEPARATORS))
    sentence = line.rlike(r"[.!?…。！？][\"'”’»)]*([\x20\x09-\x0D]|$)")
    said = F.lower(line)
    boilerplate = said.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boilerplate |= said.contains(phrase)
    return let(words, lambda n: sentence & (marks <= n * MOST_MARKS)
               & (separators <= n * MOST_SEPARATORS) & ~boilerplate)


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, from the array of words."""
    def covered(starts: Column) -> Column:
        """Words covered by windows at the sorted ``starts``."""
        steps = F.transform(starts, lambda s, k: F.least(
            F.lit(3), F.coalesce(F.get(starts, k + 1), s + 3) - s))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(pairs: Column) -> Column:
        """Sorted starts of windows that have an equal neighbour in hash order."""
        return F.array_sort(F.transform(F.filter(pairs, lambda x, k: (
            (k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])) | F.coalesce(
                F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(
            h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(pairs, lambda p: let(repeated(p), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(windows, count))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, kept_lines, lost.

    ``kept_lines`` are the lines that pass, joined again; ``lost`` is the share of word
    characters in the others. ``kept`` is false where the base rules fail or more than half of
    the text is lost. Null and empty texts have no words and fail. Repeated rows are judged
    alike. Only doc_id and text are read.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda line: without(line, BLANKS) != "")
    first = docs.select("doc_id", text.alias("t")).select(
        "doc_id", "t", F.length(without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        F.struct(
            let(lines, lambda own: F.struct(
                (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("dup"),
                F.array_join(F.filter(own, line_passes), "\n").alias("kept"))).alias("lines"),
            let(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda own: F.struct(
                F.size(own).cast("long").alias("count"),
                _repeated_words(own).cast("long").alias("repeat"))).alias("words")).alias("m"))
    failed = (F.col("m.words.count") < 50) | (
        100 * F.col("m.words.repeat") > 50 * F.col("m.words.count"))
    lost = F.when(F.col("word_chars") == 0, 1.0).otherwise(
        1 - F.length(without(F.col("m.lines.kept"), BLANKS)) / F.col("word_chars"))
    return first.select(
        "doc_id", F.col("m.words.count").alias("n_words"), "word_chars",
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.col("m.lines.dup").alias("n_dup_lines"), F.col("m.words.repeat").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & (lost <= MOST_LOST)).alias("kept"),
        F.col("m.lines.kept").alias("kept_lines"), lost.alias("lost"))
