"""The pipeline against a plain chain of the five stages, row by row."""
import collections
import itertools
import math
import re

import public_tokenizers
from tokenizers import Tokenizer

from pulsegate.llm import language, pipeline

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def near_dedup(docs):
    """Five-word shingles, similarity 0.8; the smallest id of a component stays."""
    sets = {}
    for n, text in docs.items():
        own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[n] = {tuple(own[i:i + 5]) for i in range(max(len(own) - 4, 1))} if own else set()
    group = {n: n for n in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = sorted((group[a], group[b]))[::-1]
            group = {n: new if g == old else g for n, g in group.items()}
    return {n: text for n, text in docs.items() if group[n] == n}


def substring_dedup(docs):
    """Words of 35-word windows that start elsewhere, too, go."""
    seen = collections.Counter(tuple(own[i:i + 35]) for own in map(words, docs.values())
                               for i in range(len(own) - 34))
    out = {}
    for n, text in docs.items():
        own = words(text)
        keep = [True] * len(own)
        for i in range(len(own) - 34):
            if seen[tuple(own[i:i + 35])] > 1:
                keep[i:i + 35] = [False] * 35
        out[n] = text if all(keep) else " ".join(itertools.compress(own, keep))
    return out


def decontaminate(docs, items):
    """Documents with a window like a benchmark item, by weighted shingles, go."""
    def cut(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())

    def shingles(part):
        return {tuple(part[i:i + 5]) for i in range(max(len(part) - 4, 1))}

    tests = [(len(own), shingles(own)) for own in map(cut, items) if own]
    rarity = collections.Counter(s for _, own in tests for s in own)

    def weight(own):
        return sum(math.log(1 + len(tests) / max(rarity[s], 1)) for s in own)

    def leaks(text):
        own = cut(text)
        every = shingles(own) if own else set()
        for size, item in tests:
            # what shares too little as a whole shares too little in a window
            if weight(every & item) < 0.8 * weight(item) - 1e-9:
                continue
            for at in range(max(len(own) - size + 1, 1)):
                part = shingles(own[at:at + size])
                if weight(part & item) >= (0.8 - 1e-12) * weight(part | item):
                    return True
        return False

    return {n: text for n, text in docs.items() if not leaks(text)}


def test_pipeline_is_a_chain_of_its_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    # a trained model has no brute force: its predictions are given
    docs = {r.doc_id: r.text for r in language.identify(table).collect()
            if r.language.lang_pred != "und"}
    assert len(docs) <= table.count()
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = near_dedup(docs)
    cut = substring_dedup(near)
    clean = decontaminate(cut, items)
    assert len(docs) > len(near) > len(clean) and cut != near
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {n: library.encode(text, add_special_tokens=False).ids for n, text in clean.items()}
    got = pipeline.run(spark, SF).collect()
    assert len(got) == len(want)
    for row in got:
        assert list(row.text_ids) == want[row.doc_id]
        assert row.decoded == library.decode(want[row.doc_id], skip_special_tokens=False)
