from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, with_clashes
from pagetide.llm import bpe
from pagetide.llm.queries import tokenizer

PATH, PATTERN = tokenizer()


@pytest.fixture(scope="module")
def both():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


ODD = ["a", "aa", " ", "  ", "\n", "é", "漢", "字", "😀", "\x1c", "​", "　", "1", "٣", "'s", "'ll", "the", "ing", "\x85",
       "%%%", "ß", "Ü", "'", "\t", "\r\n", "-", "_", "½", "é"]


def test_equals_the_library_on_odd_texts(both):
    own, library = both
    split = bpe.split_pattern(PATTERN)
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 50)))
        ids = own.encode(text, split)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_every_entry_and_long_runs(both):
    own, library = both
    split = bpe.split_pattern(PATTERN)
    for text in ("a" * 5000, " " * 3000 + "x", "ab" * 5000, "thethe" * 900, "\n" * 999):
        assert np.frombuffer(own.encode(text, split), "<u4").tolist() == library.encode_ordinary(text)
    for rank in list(own.bytes_of)[::97]:
        assert own.encode_piece(own.bytes_of[rank]) == library._core_bpe.encode_single_piece(own.bytes_of[rank])


def test_given_documents(spark, sf_dir, both):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " x"), (-3, " x"), (None, "null id")], DOCS)
    docs = with_clashes(docs.select("doc_id", "text").union(extra))
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    want = []
    for doc_id, text in texts:
        ids = np.array(both[1].encode_ordinary(text), dtype="<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.digest(docs, PATH, PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    packed = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in packed)
    assert bpe.digest(spark.createDataFrame([], DOCS), PATH, PATTERN).count() == 0
