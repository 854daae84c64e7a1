"""License scans by an exact set-similarity join (operator 6). DataFrame functions only.

Phrases are found as words that stand consecutively. Templates are found by containment: a block
holds at least ``threshold`` of the distinct tokens of a template. Blocks are the lines, and for each
template overlapping windows of words across lines, so that wrapped notices are found: any run of
words a quarter longer than the template stands in a window whole. Documents that hold too few
tokens of every template have no such block and are left out first. Tokens are ordered by
their frequency in the corpus, rarest first. A block and a template that meet the threshold share a
token among the first ones of each (prefix filter); the block must have enough tokens (length
filter), and enough of them must follow the shared one (positional filter); what is left is
verified on whole sets. Only tokens of templates can match, so blocks are cut to those.

The templates are a fixed, short table, so their tokens stand in the plan and their join
is a broadcast one; blocks are never compared with blocks.
"""
from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pulsegate.llm.common import staged

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices by which licenses are commonly named, and their labels.
TEMPLATES = [
    ("mit", "released under the MIT license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache-2", "licensed under the Apache license version 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("gpl-3", "licensed under the GNU general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the Mozilla public license"),
]

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def spaced(text: Column) -> Column:
    """Lower-cased words joined by one blank."""
    return F.trim(F.regexp_replace(folded(text), _GAPS, " "))


def _finder(phrase: list[str]) -> Callable[[Column], Column]:
    """Function of an array of words to the places where ``phrase`` stands in it."""
    def starts(words: Column) -> Column:
        def here(at: Column) -> Column:
            found = F.get(words, at) == phrase[0]
            for n, word in enumerate(phrase[1:], 1):
                found &= F.get(words, at + n) == word
            return found
        last = F.greatest(F.size(words) - len(phrase), F.lit(0))
        return F.filter(F.sequence(F.lit(0), last), here)
    return starts


def _base(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                        spaced(text).alias("plain"))
    padded = F.concat(F.lit(" "), "plain", F.lit(" "))
    none = F.array().cast("array<int>")
    found = {phrase: F.when(
        padded.contains(f" {phrase} "),
        # bound once: a lambda would split the text again for each word
        F.flatten(F.transform(F.array(F.split("plain", " ")), _finder(phrase.split())))
    ).otherwise(none) for phrase in phrases}
    words = F.when(F.col("plain") == "", 0).otherwise(
        F.length("plain") - F.length(F.translate("plain", " ", "")) + 1).cast("long")
    rows = plain.select("doc_id", "text_key", words.alias("n_words"),
                        *(places.alias(f"_{n}") for n, places in enumerate(found.values())))
    each = [F.col(f"_{n}") for n in range(len(found))]
    every = F.concat(*each)
    labels = F.array_compact(F.array(*(F.when(F.size(places) > 0, F.lit(label))
                                       for places, label in zip(each, phrases.values()))))
    return rows.select("doc_id", "text_key", "n_words", F.size(every).cast("long").alias("n_base"),
                       F.array_min(every).cast("long").alias("first_word"),
                       F.array_max(every).cast("long").alias("last_word"),
                       F.array_distinct(labels).alias("base_list"))


def template_hits(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                  threshold: float = 0.9) -> DataFrame:
    """``doc_id, text_key, label, containment`` of every block that meets the threshold.

    One row per block and template; blocks are the lines of the whole text, numbered from 0, and
    windows of words, numbered -1 - first word. Null and empty texts have none. Lines that
    repeat give a row each.
    """
    sets = [(label, sorted(set(_plain(text)))) for label, text in templates]
    spans = [math.ceil(1.25 * len(_plain(text))) for _, text in templates]
    vocabulary = sorted({token for _, tokens in sets for token in tokens})
    known = F.array(*map(F.lit, vocabulary))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.array_intersect(
        known, F.split(spaced(F.col("text")), " ")).alias("held"))
    enough = F.lit(False)
    for _, tokens in sets:
        enough |= F.size(F.array_intersect("held", F.array(*map(F.lit, tokens)))) >= math.ceil(
            threshold * len(tokens) - 1e-9)
    # texts are written only where a block can match
    read = staged(own.withColumn("text", F.when(enough, F.col("text"))), "licenses")
    seen = read.select(F.explode("held").alias("token")).groupBy("token").count()
    # a row per token of the templates at most
    frequency = dict.fromkeys(vocabulary, 0) | {row[0]: row[1] for row in seen.collect()}
    order = sorted(vocabulary, key=lambda token: (frequency[token], token))
    prepared, index = [], []
    for number, (label, tokens) in enumerate(sets):
        ranked = sorted(tokens, key=order.index)
        least = math.ceil(threshold * len(ranked) - 1e-9)
        prepared.append((label, ranked, least))
        # lines, span 0, meet all templates, windows those of their span
        index += [(ranked[at], at, number, label, len(ranked), least, ranked, span)
                  for at in range(len(ranked) - least + 1) for span in (0, spans[number])]
    fewest = min(least for *_, least in prepared)
    prefixes = F.broadcast(docs.sparkSession.createDataFrame(
        index, "token string, t_at int, template int, label string, t_size int, least int, "
               "t_tokens array<string>, span int"))
    first_tokens = sorted({row[0] for row in index})
    texts = read.filter(F.col("text").isNotNull())
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split(folded(F.col("text")), "\n", -1))
                         .alias("block", "line"))
    # the prefix filter on raw text: a block without any prefix token matches nothing
    likely = F.col("line").rlike("|".join(first_tokens))
    ranked = F.array(*map(F.lit, order))
    lines = lines.filter(likely).select(
        "doc_id", "text_key", "block", F.lit(0).alias("span"),
        F.split(F.regexp_replace("line", _GAPS, " "), " ").alias("words"))
    # windows of two spans, one span apart
    apart = texts.select("doc_id", "text_key", F.split(spaced(F.col("text")), " ").alias("all"),
                         F.explode(F.array(*map(F.lit, sorted(set(spans))))).alias("span"))
    windows = apart.select("doc_id", "text_key", "span", "all", F.explode(F.sequence(
        F.lit(0), F.size("all") - 1, F.col("span"))).alias("first")).select(
        "doc_id", "text_key", (-1 - F.col("first")).alias("block"), "span",
        F.slice("all", F.col("first") + 1, 2 * F.col("span")).alias("words"))
    blocks = lines.unionByName(windows).select(
        "doc_id", "text_key", "block", "span", F.array_intersect(ranked, "words").alias("tokens")
    ).filter(F.size("tokens") >= fewest)  # length filter; ``ranked`` first keeps its order
    opened = blocks.select("*", F.posexplode(F.slice(
        "tokens", F.lit(1), F.size("tokens") - fewest + 1)).alias("b_at", "token"))
    rest = F.least(F.col("t_size") - F.col("t_at"), F.size("tokens") - F.col("b_at"))
    matched = opened.join(prefixes, ["token", "span"]).filter(
        (F.size("tokens") >= F.col("least")) & (rest >= F.col("least") - F.least("t_at", "b_at")))
    shared = F.size(F.array_intersect("tokens", "t_tokens"))
    return matched.filter(shared >= F.col("least")).select(
        "doc_id", "text_key", "block", "template", "label",
        (shared / F.col("t_size")).alias("containment")).distinct()


def _plain(text: str) -> list[str]:
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split()


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES,
                  templates: list[tuple[str, str]] = TEMPLATES,
                  threshold: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all beyond ASCII. ``n_base`` counts all places
    of phrases, ``first_word`` and ``last_word`` are their smallest and largest start, null
    without any. ``labels`` adds those of templates; lists are distinct, sorted and joined by
    commas. ``score`` is 1 with a phrase, else the best containment, else 0. Null and empty
    texts have no words; repeated rows get equal results. Only doc_id and text are read.
    """
    base = _base(docs, phrases)
    hits = staged(template_hits(docs, templates, threshold).groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")), "licenses")
    found = hits.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"),
                        "more", "best")
    rows = base.join(found, base["doc_id"].eqNullSafe(found["h_id"])
                     & (base["text_key"] == found["h_key"]), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
