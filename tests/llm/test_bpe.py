import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spotloom.llm.bpe import encode_decode, encoder

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)
LETTERS = "abc the ing'sT  \n\t\x1c\x1f\x85\xa0éü漢字١²½​ 😀᠎!?.#0123́"
EDGES = [None, "", " ", "\n\n  a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|", "don't we'LL", "x" * 30_000, "the cat " * 4_000, "�"]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library_s():
    texts = [t or "" for t in EDGES] + random_texts(1, 3000)
    got = encoder(PATH).encode_texts(texts)
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    for text, ids, w in zip(texts, got, want, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids
        assert encoder(PATH).decode(ids) == LIBRARY.decode(w.ids, skip_special_tokens=False) == text


def test_decodes_broken_sequences_like_the_library():
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(1, 12))]
        assert encoder(PATH).decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_small_word_tables_change_nothing():
    from spotloom.llm.bpe import TrieEncoder

    small, texts = TrieEncoder(PATH, cache_words=20), random_texts(3, 400)
    for i in range(0, 400, 10):
        assert small.encode_texts(texts[i : i + 10]) == encoder(PATH).encode_texts(texts[i : i + 10])


@pytest.mark.parametrize("with_ids", [False, True])
def test_table(spark, docs_of, with_ids):
    rows = list(enumerate(EDGES + random_texts(4, 50))) + [(3, EDGES[3]), (None, "null id")]
    docs = docs_of(rows).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "ids")
    got = encode_decode(docs, PATH, with_ids=with_ids).collect()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert encode_decode(docs_of([]), PATH, with_ids=with_ids).collect() == []
