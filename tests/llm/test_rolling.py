"""Fingerprints against whole numbers, and strings built to collide modulo powers of two."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import minhash, quality, rolling, sentence_pieces, suffix_dedup, token_counts
from docloom.llm.queries import vocabulary

from test_llm import counts, docs


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def twins(n, a="a", b="b"):
    """Two different strings of n letters that agree modulo 2^64 for every odd base, from n = 1,024."""
    t = thue_morse(n)
    return "".join((a, b)[x] for x in t), "".join((b, a)[x] for x in t)


@pytest.mark.parametrize("piece", [1 << 22, 700])
def test_ranges_are_polynomials(monkeypatch, piece):
    monkeypatch.setattr(rolling, "_PIECE", piece)
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 3000).astype(np.uint8)
    data[2000:2090] = data[100:190]
    start = r.integers(0, 3000, 60)
    end = np.array([r.integers(a, 3001) for a in start])
    ranges = rolling.Ranges(data)
    want = [sum((int(data[k]) + 1) * pow(rolling._BASE, int(k - a), rolling.P) for k in range(a, b)) % rolling.P for a, b in zip(start, end)]
    assert ranges.raw(start, end).tolist() == want
    a, b, n = np.array([100, 100, 5]), np.array([2000, 2001, 9]), np.array([90, 90, 0])
    assert ranges.same(a, b, n, 50).tolist() == [True, False, True]


def test_classes_compare_bytes(monkeypatch):
    monkeypatch.setattr(rolling.Ranges, "of", lambda self, start, end: np.zeros(len(start), np.uint64))  # all collide
    data = np.frombuffer(b"abcabdabcx", np.uint8)
    first, which = rolling.Ranges(data).classes(np.array([0, 3, 6, 9, 2]), np.array([3, 6, 9, 10, 3]))
    assert [first[k] for k in which] == [0, 1, 0, 3, 4]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_twins_differ_everywhere(spark, n):
    x, y = twins(n)
    texts = [f"{x}\n{y}\n", f"{x} {y} {x} {y} c {y} {x} {x}", f"{x}\n{x}\n", x, y]
    df = docs(spark, texts)
    assert {r[0]: tuple(r)[1:6] for r in quality.quality_verdicts(df).collect()} == {i: counts(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, [x, y, f"{x} b c", f"{y} b c", f"{x} b c"])).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for pair in ([x, y], [y, x]):
        got = [r["n_tokens"] for r in token_counts.token_counts(docs(spark, pair), vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()]
        assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in pair]
    assert all(r["lossless"] for r in sentence_pieces.sample_pieces(docs(spark, [x, y, f"{y} {x}"]), vocabulary("piece_bpe_32k.model")).collect())


def test_strings_built_for_the_old_hash_stay(spark):
    filler = "".join(chr(97 + i % 23) for i in range(144))
    words = ["abcd", "efgh"]
    t = thue_morse(64)
    x, y = (filler + "".join(words[i ^ k] for i in t) for k in (0, 1))
    texts = [x, y, x[:399], y[:399]]
    for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect():
        text = texts[r["doc_id"]].encode()
        assert (r["n_removed"], r["kept_sha256"]) == (0, hashlib.sha256(text).hexdigest())
