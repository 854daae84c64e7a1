"""Exact dedup, whitening and the conversation trie against brute force."""
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pulsegate.llm import conversation_trie, exact, whitening
from pulsegate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# exact dedup

def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(1)
    texts = [None, "", "A", "a", "É é", "é É", "x" * 5000, "X" * 5000, "\0a", "\0\0a"]
    texts += ["".join(rnd.choice("abAB ") for _ in range(rnd.randint(0, 9))) for _ in range(200)]
    texts += ["ab" * 700, "aB" * 700, "ba" * 700]
    return [(n if n % 17 else None, text, n) for n, text in enumerate(texts)] + [
        (5, "A", 0), (5, "A", 0)]


@pytest.mark.parametrize("settings", [(), (16,), (1 << 20, 251), (16, 3)])
def test_exact_duplicates(spark, copies, settings):
    """In parts of 16 bytes, and with so small a prime that most fingerprints collide, too."""
    groups = collections.defaultdict(list)
    for n, text, _ in copies:
        groups[folded(text)].append(n)
    want = []
    for n, text, _ in copies:
        own = groups[folded(text)]
        keep = max((i for i in own if i is not None), default=None)
        raw = folded(text).encode()
        want.append((n, len(raw), keep, len(own), hashlib.sha256(raw).hexdigest(), n == keep))
    frame = spark.createDataFrame(copies, "doc_id long, text string, piece int").repartition(3)
    got = exact.exact_duplicates(frame, *settings).select(
        "doc_id", "n_bytes", "keep_id", "group_size", "text_sha256", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact.exact_duplicates(frame.limit(0), *settings).count() == 0


def test_fingerprints_compose():
    rnd, hashes = random.Random(2), exact.Hasher()
    data = np.frombuffer(rnd.randbytes(5000), np.uint8)

    def of(part):
        return hashes(part, np.array([0, len(part)]))[0]

    value = 0
    for byte in data.tolist():
        value = (value * exact._BASES[1] + byte) % exact.PRIME
    assert of(data)[1] == value
    for cut in (0, 1, 255, 256, 257, 4999, 5000):
        assert (exact.combine(of(data[:cut]), of(data[cut:]), 5000 - cut) == of(data)).all()


# whitening

def spectra(size):
    rng = np.random.default_rng(size)
    random_part = rng.standard_normal((size, size))
    turn, _ = np.linalg.qr(random_part)
    thin = rng.standard_normal((size, max(size // 4, 1)))
    yield random_part @ random_part.T
    yield np.eye(size) * 3
    yield np.zeros((size, size))
    yield turn @ np.diag(np.repeat([5.0, 2.0], [(size + 1) // 2, size // 2])) @ turn.T
    yield thin @ thin.T
    yield turn @ np.diag(10.0 ** -np.arange(size).clip(0, 15)) @ turn.T


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 64])
def test_spectrum(size):
    for a in spectra(size):
        a = (a + a.T) / 2
        values, vectors = whitening.spectrum(a)
        scale = max(np.linalg.norm(a), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * scale


def whitened_by_hand(x, count):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return (n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values),
            values / np.trace(covariance))


def test_whitening_query(spark):
    """All rows of the table against a dense eigensolver."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(np.array([r.embedding for r in table], float) * 256).astype(np.int64)
    n, deviation, white, explained = whitened_by_hand(x, 4)
    got = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, SF).collect()}
    assert len(got) == 4 * len(table)
    for k in range(4):
        own = [got[r.vec_id, k + 1] for r in table]
        sign = np.sign(own[0].whitened * white[0, k])
        assert np.abs([r.whitened for r in own] - sign * white[:, k]).max() < 1e-9
        assert [r.deviation for r in own] == deviation.tolist()
        assert {r.n for r in own} == {n} and own[0].explained == pytest.approx(explained[k])
        assert own[0].identity_error < 1e-10


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    good = [rng.standard_normal(3).astype(float).tolist() for _ in range(30)]
    bad = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0],
           [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = [(n, v, n) for n, v in enumerate(good + bad)] + [(0, good[0], 0), (None, good[1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int")
    got = whitening.whiten(frame.repartition(3)).collect()
    assert len(got) == 32 and {r.vec_id for r in got} == {None, *range(30)}
    n, deviation, white, _ = whitened_by_hand(
        np.floor(np.array(good) * 256).astype(np.int64), 3)
    assert {r.n for r in got} == {30}
    for r in got:
        place = 1 if r.vec_id is None else r.vec_id
        assert r.deviation == deviation[place]
        assert np.abs(r.whitened) == pytest.approx(np.abs(white[place]))


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error)
            for r in one.collect()] == [(1, 0, [None, None], [None, None], None)] * 2
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema), 2)
    assert [(abs(r.whitened[0]), r.whitened[1], r.explained) for r in flat.collect()] == [
        (pytest.approx(1.0), None, [1.0, 0.0])] * 2
    for rows in ([], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    model = whitening.Whitening(1, 10 ** 9, [0], np.ones(1), np.ones((1, 1)), 1.0)
    assert whitening._deviations(np.array([[2], [3], [4]]), model) == [4 * 10 ** 18,
                                                                       9 * 10 ** 18, None]


# conversation trie

def trie_by_hand(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), key, (role, text)))
    told = {conv: tuple(k[2] for k in sorted(own)) for conv, own in turns.items()}
    built = {}
    for conv in told:
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = told.get(conv - int(math.fmod(conv, 100)), ())[:h] + told[conv][h:]
    members = collections.defaultdict(list)
    for conv, own in built.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(conv)
    children = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    for node, own in members.items():
        ends = ",".join(str(conv) for conv in sorted(own) if built[conv] == node)
        yield (min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
               children[node], leaves[node], saved[node],
               hashlib.sha256(ends.encode()).hexdigest())


@pytest.fixture(scope="module")
def talk():
    rnd, rows = random.Random(3), []
    for conv in [*range(60), *range(100, 160), *range(205, 230), -5, -100, -130]:
        for turn in range(rnd.choice([1, 2, 3, 4, 6, 9])):
            rows.append((conv, turn, rnd.choice(["user", None, "a"]),
                         rnd.choice(["hi", "yo é日", "", None, "long " * 3])))
    rows += [(7, None, "x", "y"), (7, None, "x", "z"), (None, 1, "a", "b"), (8, 0, "user", "hi"),
             (8, 0, "user", "hi")]
    for conv, length in ((300, 150), (301, 170), (302, 100), (303, 64), (304, 65)):
        rows += [(conv, turn, "u", f"t{turn % 7}" if conv != 302 or turn < 64 else "q")
                 for turn in range(length)]
    rnd.shuffle(rows)
    return rows


def test_conversation_trie(spark, talk):
    """Turnless, long, repeated and tied turns, null cells, conversations below 0."""
    frame = spark.createDataFrame(
        [(*row, 1) for row in talk],
        "conv_id long, turn long, role string, text string, node int").repartition(3)
    got = conversation_trie.prefix_trie(frame).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, trie_by_hand(talk)))
    assert conversation_trie.prefix_trie(frame.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, None, None)], frame.drop("node").schema)
    assert [tuple(r) for r in conversation_trie.prefix_trie(blank).collect()] == list(
        trie_by_hand([(1, 0, "a", "b"), (1, 1, None, None)]))


def test_double_array():
    """What was put in is found, what was not is not, and no cell has two parents."""
    rng = np.random.default_rng(7)
    for wide in (3, 40, 2000):
        codes = rng.integers(0, wide, (300, 5))
        for row, length in enumerate(rng.integers(1, 6, 300)):
            codes[row, length:] = -1
        codes = codes[np.lexsort(codes.T[::-1])]
        trie = conversation_trie.DoubleArray(codes)
        named = {}
        for row, path in zip(codes, trie.paths):
            for d in range(5):
                if row[d] >= 0:
                    assert named.setdefault(int(path[d]), tuple(row[:d + 1])) == tuple(row[:d + 1])
        assert len(named) == len({tuple(r[:d + 1]) for r in codes for d in range(5) if r[d] >= 0})
        known = {tuple(own) for own in named.values()}
        states = trie.walk(np.zeros(wide, np.int64), np.arange(wide))
        assert [(c,) in known for c in range(wide)] == (states >= 0).tolist()


def test_shards_hold_names_with_nul_bytes():
    turns = [[{"depth": 1, "turn": b"a" * 15 + b"\0", "node": b"n" * 16, "chars": 1}],
             [{"depth": 1, "turn": b"a" * 15 + b"\1", "node": b"m" * 16, "chars": 1}]]
    batch = pa.RecordBatch.from_pydict({
        "conv_id": pa.array([4, 3]), "start": [conversation_trie.ROOT] * 2, "turns": turns})
    assert conversation_trie.shard_nodes(batch).column("n_convs").to_pylist() == [1, 1]
