"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a byte string ends in exactly one token, its *last token*; dropping that token leaves the encoding of
the remaining prefix.  So one last token per trie node holds the encodings of all prefixes on the way from the root.  The
distinct words of a block of documents are put in order, which lays their trie out depth first: a word branches off its
predecessor where their common prefix ends, and only nodes below the branch are computed.  A node tries the vocabulary's
tokens that end there, longest first, until one fits the last token of the prefix before it.

Two tokens fit if BPE, run over their joined bytes, never merges across the border.  That is decided on the two chains
of pieces that touch the border while it runs (``_fits``), and remembered per pair.

Each Spark task works through its Arrow batches in blocks of bounded size; nothing shuffles.  Words already encoded
are kept per Python worker in two tables of bounded size; when the newer is full it replaces the older.

Defined results: null text counts as empty; an empty text has no tokens and decodes to the empty text; the strings of
added tokens are those tokens, as the library reads them; very long texts are split into words once and never cut; repeated
rows repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern of this vocabulary, with white space as the Unicode property.
_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same words where a text is ASCII only, which the standard library finds faster.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_NEVER = 1 << 60


def _find_words(text: str) -> list[str]:
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TrieEncoder:
    """Encodes words with the vocabulary and merges of a ``tokenizers`` JSON file."""

    def __init__(self, path: str, cache_words: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.id_of: dict[bytes, int] = {b: i for i, b in self.token_bytes.items()}
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a << 20 | b] = r
            self.made.setdefault(c, (r, a, b))
        # every byte string that ends a token: the token itself, or -1 where it is only the end of longer ones
        self.ending = {b[k:]: -1 for b in self.id_of for k in range(1, len(b))} | self.id_of
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        self._fit: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._cache_words = cache_words

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at a token's left (1) or right (2) edge, from single byte to whole token, with the rank of each."""
        chain = []
        while token in self.made:
            chain.append((self.made[token][0], token))
            token = self.made[token][side]
        chain.append((-1, token))
        return chain[::-1]

    def _fits(self, a: int, b: int) -> bool:
        """Whether the encoding of ``a``'s bytes followed by ``b``'s is just ``a``, ``b``."""
        left, right, rank = self._edge(a, 2), self._edge(b, 1), self.rank
        i = j = 0
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1][0] if j + 1 < len(right) else _NEVER
            across = rank.get(left[i][1] << 20 | right[j][1], _NEVER)
            # of equal ranks the leftmost pair merges first
            if across < next_left and across <= next_right and across != _NEVER:
                return False
            if next_left == _NEVER and next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, token ids) of distinct words, in byte order; every shared prefix is computed once."""
        ending, fit = self.ending, self._fit
        last: list[int] = [-1]  # last[n]: last token of the current word's prefix of n bytes
        start: list[int] = [0]  # start[n]: where that token begins
        before = b""
        for word in sorted(words):
            n = min(len(before), len(word))
            shared = 0
            if word[:n] == before[:n]:
                shared = n
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = []
                for at in range(end - 1, -1, -1):
                    token = ending.get(word[at:end])
                    if token is None:
                        break
                    if token >= 0:
                        found.append((at, token))
                for at, token in reversed(found):
                    if at == 0:
                        break
                    pair = last[at] << 20 | token
                    ok = fit.get(pair)
                    if ok is None:
                        if len(fit) >= 300_000:
                            fit.clear()
                        ok = fit[pair] = self._fits(last[at], token)
                    if ok:
                        break
                last.append(token)
                start.append(at)
            ids = []
            end = len(word)
            while end:
                ids.append(last[end])
                end = start[end]
            yield word, ids[::-1]
            before = word

    def pieces(self, text: str) -> list[str]:
        """The words of a text; strings of added tokens stand alone."""
        if self.added_split is None or not any(t in text for t in self.added):
            return _find_words(text)
        out, at = [], 0
        for m in self.added_split.finditer(text):
            out += _find_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + _find_words(text[at:])

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self._words) > self._cache_words:
            self._older, self._words = self._words, {}
        known, older = self._words, self._older
        fresh = set().union(*split).difference(known)
        for word in fresh & self.added.keys():
            known[word] = np.array([self.added[word]], "<u4").tobytes()
        for word in fresh & older.keys():
            known[word] = older[word]
        for word, ids in self.encode_words(w.encode() for w in fresh - known.keys()):
            known[word.decode()] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, p)) for p in split]

    def decode(self, ids: bytes) -> str:
        """The text of token ids; bytes that are not UTF-8 become replacement characters."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """The encoder of a vocabulary file, loaded once per Python worker."""
    return TrieEncoder(path)


def _blocks(column: pa.Array, chars: int = 3_000_000) -> Iterator[list[str]]:
    """Consecutive texts of a column, about ``chars`` characters at a time."""
    block, size = [], 0
    for value in column:
        t = value.as_py() or ""
        block.append(t)
        size += len(t)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids and the decoded text.

    ``vocabulary`` is a ``tokenizers`` JSON file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for b in batches:
            counts, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for block in _blocks(b.column(1)):
                for ids in tool.encode_texts(block):
                    text = tool.decode(ids)
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        decoded.append(text)
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                cols |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
