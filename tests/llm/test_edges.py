"""Long texts, clashing names, empty tables, repeated rows and hostile inputs of the operators."""

import time

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from docloom.llm import ann, html_text, linear, minhash, mixing, pii, quality, sentence_pieces, suffix_dedup, token_counts, toxicity
from docloom.llm.queries import vocabulary

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def operators():
    """Every operator over documents, by name."""
    return {
        "pieces": lambda d: sentence_pieces.sample_pieces(d, vocabulary(PIECES)),
        "copies": lambda d: sentence_pieces.sample_copies(d, vocabulary(PIECES)),
        "tokens": lambda d: token_counts.token_counts(d, vocabulary(BPE)),
        "pii": pii.pii_report,
        "redact": pii.redact,
        "repeats": suffix_dedup.remove_repeats,
        "quality": quality.quality_verdicts,
        "near": minhash.near_duplicates,
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_clashing_names_repeats_and_empty(spark, name):
    columns = "doc_id long, text string, lang string, source string, id long, kept boolean, text_ string, spans string, chunk int, n_bytes int"
    rows = [(1, "some words here, a@b.cd", "en", "s", 9, True, "x", "y", 1, 2)] * 2 + [(2, None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 1, False, "", "", 0, 0)]
    docs = spark.createDataFrame(rows, columns)
    got = operators()[name](docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3]
    if name != "copies":  # which draws each copy by itself
        assert len({str(r.asDict()) for r in got if r.doc_id == 1}) == 1
    assert operators()[name](docs.limit(0)).count() == 0


def test_long_text_in_every_operator(spark):
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(3000)]
    long = " ".join(words[i] for i in r.integers(0, 3000, 700_000))  # more than two Arrow batches
    docs = spark.createDataFrame([(1, long, "en"), (2, "short text", "en")], "doc_id long, text string, lang string")
    count = {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs, vocabulary(BPE)).collect()}
    assert count[1] == len(tokenizers.Tokenizer.from_file(vocabulary(BPE)).encode(long, add_special_tokens=False).ids)
    assert all(x.lossless for x in sentence_pieces.sample_pieces(docs, vocabulary(PIECES)).collect())
    assert {x.doc_id: x.n_words for x in quality.quality_verdicts(docs).collect()} == {1: 700_000, 2: 2}
    assert {x.doc_id: (x.n_bytes, x.n_removed) for x in suffix_dedup.remove_repeats(docs).collect()} == {1: (len(long), 0), 2: (10, 0)}
    twice = spark.createDataFrame([(1, long), (2, long + " tail")], "doc_id long, text string")
    assert [x.n_removed for x in suffix_dedup.remove_repeats(twice).orderBy("doc_id").collect()] == [len(long)] * 2
    assert {x.component_id for x in minhash.near_duplicates(twice).collect()} == {1}


def test_dense_matches_take_linear_time(spark):
    one = spark.range(1)
    docs = one.select("id", F.repeat(F.lit("a1@b.cd "), 100_000).alias("text"))
    start = time.time()
    assert pii.pii_report(docs, "id").collect()[0].n_email == 100_000
    assert pii.redact(docs).collect()[0].text == "[EMAIL] " * 100_000
    assert time.time() - start < 60


def test_marks_survive_redaction(spark):
    docs = spark.createDataFrame([(1, "\x01 a@b.cd \x03\x04 \x01\x05 end"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["\x01 [EMAIL] \x03\x04 \x01\x05 end", None]


def test_hostile_pages_take_linear_time():
    pages = ["<a " * 200_000, "<div>" * 100_000 + "x" * 50, "<p><div>" + "<b>" * 50_000 + "<p>hello</p>" * 50_000, "<b><article>" + "<i>" * 50_000 + "</b>" * 50_000, "<!" * 200_000, "<a b='>" * 50_001]
    start = time.time()
    for page in pages:
        html_text.extract_blocks(page)
    assert time.time() - start < 20


def test_names_of_paragraphs_are_no_boilerplate():
    page = '<article><p>one, two three four five six seven eight nine ten</p><p title="the hidden cost">kept text of some length, with commas</p><p id="social-policy">another paragraph, which stays</p><h2 id="search-results">Heading</h2><p>a <math><mi>x</mi></math> b</p><div class="related-posts">more</div><p hidden>unseen</p></article>'
    assert html_text.extract_blocks(page) == ["one, two three four five six seven eight nine ten", "kept text of some length, with commas", "another paragraph, which stays", "Heading", "a x b"]


def test_neighbours_of_mixed_lengths_and_repeated_ids(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(4 if i % 3 else 6).tolist()) for i in range(60)] + [(0, r.standard_normal(6).tolist()), (7, None), (8, [0.0] * 4), (None, [1.0] * 4)]
    rows = [x for x in rows if x[0] not in (7, 8) or x[1] is None or not any(x[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5).collect()
    x = {}
    for i, v in rows:
        if i is not None and v and any(v):
            x[i] = min(x[i], v) if i in x else v
    for q in (0, 20, 40):
        near = sorted(((-float(np.dot(x[q], v)), i) for i, v in x.items() if i != q and len(v) == len(x[q])))[:5]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g.vec_id for g in mine] == [i for _, i in near] and np.allclose([g.score for g in mine], [-s for s, _ in near])


def test_clustered_vectors_score_a_small_part():
    r = np.random.default_rng(0)
    centres = r.standard_normal((200, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = centres[r.integers(0, 200, 8192)] + 0.05 * r.standard_normal((8192, 64))
    ask = x[:200]
    q, row, scored = ann.Forest(x).nearest(ask, 20)
    near = np.argsort(-(ask @ x.T), 1)[:, :20]
    found = [set(row[q == i]) & set(near[i]) for i in range(200)]
    assert np.mean([len(f) / 20 for f in found]) >= 0.9
    assert scored.mean() < 0.2 * len(x)


def test_training_rows_stay_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} word{i % 5}") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] * 2, "doc_id long, toxic int")
    assert linear.training_rows(docs, labels, ["toxic"], 2).count() == 2
    nulls = spark.createDataFrame([(1, None), (2, "some text")], "doc_id long, text string")
    chain = toxicity.fit_chain(nulls, labels, ["toxic"])
    assert toxicity.score(nulls, chain).count() == 2


def test_bins_never_rule_out_a_link():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(5, 400))
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 20], r.integers(0, 2**63, n // 20, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        bins = [np.bincount((x % minhash.BINS).astype(int), minlength=minhash.BINS) for x in (a, b)]
        if minhash.linked(a, b, 85):
            assert minhash.can_link(np.array([len(a)]), bins[0][None], len(b), bins[1], 85)[0]


def test_rates_equal_a_dense_solver():
    r = np.random.default_rng(1)
    p = r.dirichlet([2, 1, 1], 40)
    tokens, target = r.integers(10, 100, 40).astype(float), np.array([1500.0, 900.0, 300.0])
    _, x = mixing.descend(tokens, p, target, 0.5, 1e-7, 20_000, 3.0)
    dense = np.full(40, 1.0)
    step = 1 / np.linalg.eigvalsh((tokens[:, None] * p).T @ p).max()
    for _ in range(200_000):
        dense = np.clip(dense - step * (p @ ((tokens * dense) @ p - target)), 0.5, 3.0)
    assert np.allclose((tokens * x) @ p, (tokens * dense) @ p, rtol=1e-3) and x.min() >= 0.5 and x.max() <= 3.0
