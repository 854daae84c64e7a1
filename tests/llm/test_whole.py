"""Checks that no term, item, line break or language is left out."""
import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pulsegate.llm import decontamination, language, licenses, toxicity


def test_toxicity_uses_every_term(spark):
    """Words of two rows only, which tell little each, still find the nearest examples."""
    rnd, data = random.Random(4), []
    for n in range(60):
        own = [f"word{n // 2}x{i}" for i in range(6)] + [rnd.choice("pqrs") for _ in range(4)]
        data.append((n, " ".join(own)))
    labels = [(n, (n // 2) % 2) for n in range(60)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = toxicity.score_toxicity(
        frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    taught = set(model.index.ids.tolist())

    def terms(text):
        out = collections.Counter()
        for word in text.split():
            out.update([word, *(word[:n] + "*" for n in toxicity.BEGINNINGS if len(word) >= n)])
        return out

    found = {n: terms(text) for n, text in data}
    rows = collections.Counter(t for own in found.values() for t in own)
    known = {t for n in taught for t in found[n]}

    def vector(own):
        out = {t: (1 + math.log(c)) * (math.log(61 / (1 + rows[t])) + 1)
               for t, c in own.items() if t in known}
        length = math.sqrt(sum(w * w for w in out.values()))
        return {t: w / length for t, w in out.items()}

    vectors = {n: vector(own) for n, own in found.items()}
    assert len(taught) > 30
    for row in got:
        own = vectors[row.doc_id]
        want = sorted(((round(sum(w * vectors[n].get(t, 0) for t, w in own.items()), 12), -n)
                       for n in taught), reverse=True)[:3]
        assert [e.similarity for e in row.toxicity.evidence] == pytest.approx(
            [s for s, _ in want], abs=1e-9)
        assert row.toxicity.evidence[0].doc_id == -want[0][1]


def test_nearest_with_rare_terms(monkeypatch):
    """Block maxima and postings of terms outside the matrix give what brute force gives."""
    monkeypatch.setattr(toxicity, "DENSE", 5)
    rnd = np.random.default_rng(2)
    vectors = rnd.random((300, 40)) * (rnd.random((300, 40)) < 0.2)
    vectors /= np.maximum(np.sqrt((vectors ** 2).sum(axis=1, keepdims=True)), 1e-9)
    index = toxicity.BlockMaxIndex(vectors, np.arange(300), np.zeros(300, int))
    for skip in range(-1, 50):
        columns = np.sort(rnd.choice(40, 6, replace=False))
        weights = rnd.random(6)
        similar = np.round(index.vectors[:, columns] @ weights, 12)
        order = [p for p in np.lexsort((index.ids, -similar)) if similar[p] > 0 and p != skip][:10]
        assert index.nearest(columns, weights, 10, skip)[0].tolist() == order


def leaks_of(spark, texts, items):
    """(doc_id, item_id) -> leak, and what brute force over whole documents gives."""
    def cut(text):
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        return own, lambda part: {tuple(part[i:i + 5]) for i in range(max(len(part) - 4, 1))}

    sets = [(n, len(own), make(own)) for n, (own, make) in ((n, cut(t)) for n, t in items)]
    rarity = collections.Counter(s for *_, own in sets for s in own)

    def weight(shingles):
        return sum(math.log(1 + len(items) / max(rarity[s], 1)) for s in shingles)

    want = {}
    for n, text in texts:
        own, make = cut(text)
        for item_id, size, item in sets:
            for at in range(max(len(own) - size + 1, 1)):
                part = make(own[at:at + size])
                value = weight(part & item) / weight(part | item)
                if value >= 0.8 and value > want.get((n, item_id), 0):
                    want[n, item_id] = value
    found = decontamination.find_leaks(
        spark.createDataFrame(texts, "doc_id long, text string").repartition(2),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, leak.item_id): leak for r in found for leak in r.leaks}, want


def phrase(seed, count):
    rnd = random.Random(seed)
    return [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 10 ** 6)}" for _ in range(count)]


def test_decontamination_of_templated_items(spark):
    """Items that share a light preamble and differ in a heavy shingle, similarity 0.834."""
    preamble = " ".join(phrase(1, 104))
    items = [(n, f"{preamble} item{n}") for n in range(1000)]
    got, want = leaks_of(spark, [(n, f"{preamble} doc{n}") for n in range(4)], items)
    assert len(want) == 4000 and set(got) == set(want)


def test_decontamination_of_shorter_documents(spark):
    """An item less one or two words at its ends, and what is too short for the similarity."""
    item, short = phrase(2, 51), phrase(3, 5)
    texts = [(1, item[1:]), (2, item[:-1]), (3, item[1:-1]), (4, item[:30]), (5, short[1:]),
             (6, item), (7, item[:1]), (8, item[2:] + short)]
    got, want = leaks_of(spark, [(n, " ".join(own)) for n, own in texts],
                         [(1, " ".join(item)), (2, " ".join(short))])
    assert set(got) == set(want) and {(1, 1), (2, 1), (3, 1), (6, 1)} <= set(got)
    assert all(got[key].similarity == pytest.approx(value) for key, value in want.items())
    assert (got[3, 1].start, got[3, 1].n_words) == (0, 49)


def test_decontamination_is_the_same_in_passes(spark, monkeypatch):
    """Similarities don't depend on how many passes the benchmark takes."""
    head = phrase(4, 40)
    items = [(n, " ".join(head[:20 + n % 20] + phrase(50 + n, 8))) for n in range(40)]
    texts = [(n, f"{text} more words") for n, text in items]
    texts += [(40 + n, text.rsplit(" ", 1)[0] + f" other{n}") for n, text in items] + [(80, "")]
    got, want = leaks_of(spark, texts, items)
    assert len(want) > 40 and set(got) == set(want)
    monkeypatch.setattr(decontamination, "PASS_WORDS", 300)
    again, _ = leaks_of(spark, texts, items)
    assert again == got
    assert all(got[key].similarity == pytest.approx(value) for key, value in want.items())


def test_wrapped_licenses(spark):
    """Notices broken over lines, with comment marks, far into the text, and words that scatter."""
    mit = ("Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this "
           "software and associated\n# documentation files (the \"Software\"), to deal")
    bsd = (" * Redistribution and use in source and binary forms, with or without\n * modification, "
           "are permitted provided that the following\n *\n * conditions are met:")
    filler = " ".join(f"w{n}" for n in range(203))
    scattered = filler.join(["permission is hereby granted free of charge", "to any person obtaining",
                             "a copy of this software and", "associated documentation files"])
    texts = ["# " + mit, bsd, f"{filler}\n{mit}\n{filler}\n{bsd}", "released under\nthe MIT license",
             scattered.replace(" ", "\n")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[n].labels for n in range(5)] == ["mit", "bsd", "bsd,mit", "mit", ""]
    assert got[0].score == got[1].score == 1.0 and got[4].score == 0.0


def test_every_language_is_learned(spark):
    """250 languages of three rows, one of them only in the rows that calibrate the others."""
    import zlib

    def alphabet(k):
        return [chr(0x4E00 + 5 * k + n) for n in range(5)]

    free = iter(n for n in range(10 ** 6) if zlib.crc32(str(n).encode()) % 5 not in (0, 1))
    late = iter(n for n in range(10 ** 6) if zlib.crc32(str(n).encode()) % 5 == 1)
    data, rnd = [], random.Random(6)
    for k in range(250):
        ids = [next(late if k == 100 else free) for _ in range(3)]
        for n in ids:
            data.append((n, "".join(rnd.choices(alphabet(k), k=60)), f"l{k:03d}"))
    data += [(2 * 10 ** 6 + k, "".join(rnd.choices(alphabet(k), k=60)), None) for k in range(250)]
    got = {r.doc_id: r.language.lang_pred for r in language.identify(spark.createDataFrame(
        data, "doc_id long, text string, lang string").repartition(4)).collect()}
    right = [got[2 * 10 ** 6 + k] == f"l{k:03d}" for k in range(250)]
    assert right[100] and sum(right) >= 245


def test_toxicity_tokens():
    """Terms summed over the UTF-8 buffer are those of a plain split; empty rows have none."""
    apart = re.compile("[\x00-\x20\x7f!-/:-@\\[-`{-~\u0080-¿ -‿]+")
    probe = [None, "", " !!", "a", "Über «naïve»—ok…", "x" * 9000 + " yy", "日本語テキスト abc",
             "don't stop", "end’s €5 ¿qué", "a", "no" + " " * 6000 + "now"]
    rows, hashes = toxicity.tokens(pa.array(probe, pa.large_string()))
    terms = set()
    for n, text in enumerate(probe):
        want = collections.Counter()
        for word in filter(None, apart.split((text or "").lower())):
            want.update([word, *(word[:b] + "*" for b in toxicity.BEGINNINGS if len(word) >= b)])
        got = collections.Counter(hashes[rows == n].tolist())
        assert sorted(got.values()) == sorted(want.values()), text
        terms.update(want)
    assert len(set(hashes.tolist())) == len(terms)
    assert len(toxicity.tokens(pa.array([None, ""], pa.large_string()))[0]) == 0


def test_toxicity_opens_less_than_half_of_the_blocks(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    texts = table.filter("doc_id % 20 = 0").select("text").toArrow()["text"].combine_chunks()
    model.scores(texts)
    assert 0 < model.index.opened < model.index.met / 2


def test_toxicity_sample_is_bounded_in_text(spark):
    rows = [(n, "word " * (1000 if n % 7 == 0 else 10)) for n in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels, sample_bytes=4000)
    assert 2 <= len(model.index.ids) <= 80
    assert toxicity.score_toxicity(frame, labels, sample_bytes=4000).count() == 200
