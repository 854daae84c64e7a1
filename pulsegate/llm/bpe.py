"""BPE encoding and decoding by dynamic programming over prefixes (operator 5).

For every prefix of a word there is exactly one token that the merge order can leave at its end.
It is found without running merges: an automaton of the vocabulary gives all tokens that end at a
prefix, longest first, and the one that may follow the last token of the prefix before it is
stored. Back-pointers from the end give the ids. Whether two tokens may stand side by side
depends on the pair alone: they may, unless a merge across their border would come before the
merges that built them.

Words repeat, so their ids are kept in a dictionary of bounded size per worker; what doesn't
fit is computed again.
"""
from __future__ import annotations

import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pulsegate.llm.common import arrow_rows

#: Words and token pairs a worker remembers.
MEMORY = 250_000
#: Stands for the suffix that marks the end of a word; no byte is written as this character.
_END = "\0"


def byte_letters() -> dict[int, str]:
    """Printable letter of each byte: itself where Latin-1 has one, else the next above 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + n) for n, b in enumerate(rest)}}


class Bpe:
    """Encoder and decoder of one vocabulary file with word-end suffixes."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocabulary = model["vocab"]
        self.words = [""] * (1 + max(*vocabulary.values(), *(
            token["id"] for token in spec["added_tokens"])))
        for token, number in vocabulary.items():
            self.words[number] = token
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        for token, number in self.special.items():
            self.words[number] = token
        self.merges = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair, made = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.merges.setdefault(pair, rank)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, rank
        self.automaton = ahocorasick.Automaton()
        stands: dict[int, bool] = {}
        for token, number in vocabulary.items():
            if not self._stands(number, stands):
                continue
            ends = token.endswith(suffix) and len(token) > len(suffix)
            letters = token.removesuffix(suffix) + _END if ends else token
            self.automaton.add_word(letters, (len(letters), number))
        self.automaton.make_automaton()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = {b: letter for b, letter in byte_letters().items()}
        # split() takes these for blanks, the pattern does not
        self.odd_blanks = regex.compile("[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one edge of ``token`` and the rank of the merge that took each of them."""
        out, until = [(token, float("inf"))], None
        while token in self.parts:
            until = self.rank[token]
            token = self.parts[token][side]
            out.append((token, until))
        return out

    def _crossed(self, left: int, right: int, itself: bool) -> bool:
        """Does a merge across the border come first? ``itself``: but for the pair's own."""
        for i, (x, x_until) in enumerate(self._spine(left, 1)):
            for j, (y, y_until) in enumerate(self._spine(right, 0)):
                rank = self.merges.get((x, y))
                # of equal merges the leftmost runs first
                if rank is not None and rank < x_until and rank <= y_until and not (
                        itself and i == j == 0):
                    return True
        return False

    def _stands(self, token: int, known: dict[int, bool]) -> bool:
        """Is ``token`` what its own letters are encoded to?"""
        if token not in known:
            left, right = self.parts.get(token, (None, None))
            known[token] = left is None or (
                self._stands(left, known) and self._stands(right, known)
                and not self._crossed(left, right, True))
        return known[token]

    def encode_word(self, word: str) -> bytes:
        """Ids (as 32-bit integers) of one match of the split pattern."""
        text = word.encode().decode("latin-1").translate(self.letters) + _END
        last = [-1] * (len(text) + 1)
        back = [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(text):
            stop = end + 1
            start = stop - length
            if last[stop] >= 0:
                continue
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = not self._crossed(before, token, False)
                    if len(pairs) >= MEMORY:
                        pairs.clear()
                    pairs[key] = fits
                if not fits:
                    continue
            last[stop], back[stop] = token, start
        ids, at = array("i"), len(text)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no tokens for {word!r}")
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids.tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        """Ids of a piece without blanks: of all its words."""
        out = []
        for word in self.pattern.findall(piece):
            ids = self.known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                self._remember(word, ids)
            out.append(ids)
        found = b"".join(out)
        if len(out) > 1:
            self._remember(piece, found)
        return found

    def _remember(self, piece: str, ids: bytes) -> None:
        if len(self.known) >= MEMORY:
            self.known.clear()
        if len(piece) < 100:
            self.known[piece] = ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; strings of special tokens in it are those tokens."""
        out = []
        for number, part in enumerate(self.split.split(text or "")):
            if number % 2:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            # each letter by itself: no final form of sigma
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if self.odd_blanks.search(plain):
                out.append(self._encode_piece(plain))
                continue
            pieces = plain.split()
            found = list(map(self.known.get, pieces))
            if None in found:
                found = [self._encode_piece(piece) if ids is None else ids
                         for piece, ids in zip(pieces, found)]
            out += found
        return b"".join(out)

    def decode(self, ids) -> str:
        """The file has no decoder, so the tokens are joined by blanks as they are."""
        return " ".join([self.words[n] for n in ids])


_loaded: dict[str, Bpe] = {}


def _load(content: str) -> Bpe:
    """The encoder of ``content``, built once per worker."""
    if content not in _loaded:
        _loaded.clear()
        _loaded[content] = Bpe(content)
    return _loaded[content]


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_ids (array of int) and decoded.

    ``vocabulary`` is the path of the tokenizer file on the driver; its content (a fixed
    size) goes to the workers. Whole texts are encoded; null and empty texts have no ids and
    decode to ''. Repeated rows are encoded alike. Only doc_id and text are read.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _load(shared.value)
        encoded = [model.encode(text.as_py()) for text in batch.column("text")]
        bounds = np.cumsum([0, *(len(ids) // 4 for ids in encoded)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(
            pa.array(bounds), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
        decoded = [model.decode(np.frombuffer(ids, np.int32).tolist()) for ids in encoded]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())],
                                          names=["doc_id", "text_ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs.select("doc_id", "text"), make,
                      f"doc_id {id_type}, text_ids array<int>, decoded string", "text")
