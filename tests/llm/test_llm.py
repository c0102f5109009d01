"""The operators against brute force, round trips and held-out rows, with the edge cases of their docstrings."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, graph, html_text, minhash, mixing, pii, quality, sentence_pieces, suffix_dedup, token_counts, toxicity
from docloom.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [None, "", " \n\t ", "a", "a b", "Ärger über Öl 😀 中文　x", "a▁b", "x" * 5000, "w " * 3000, "one two three " * 30]


def docs(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for c in ("lang", "source"):
        df = df.withColumn(c, F.lit("en"))
    if extra:  # names that operators use themselves
        for c in ("id", "N_words", "kept", "spans_", "group_", "text_", "tokens_", "P0_"):
            df = df.withColumn(c, F.lit(c))
    return df


def prose(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "and", "house", "river", "stone", "walks", "over", "green", "hill", "with", "some", "late", "light"]
    return [" ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(60, 120))) for _ in range(n)]


# --- quality rules


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def test_quality_counts(spark):
    texts = [*EDGES, "a\nb\na\n\n \nb\n", "x y z x y z", "# $ <b>|"]
    got = {r[0]: tuple(r)[1:6] for r in quality.quality_verdicts(docs(spark, texts)).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_quality_filter_keeps_prose_and_columns(spark):
    good = prose(60)
    bad = [" ".join(w.upper() + "!!" for w in p.split()) for p in prose(3, 2)] + ["same words here " * 40, None, ""]
    df = docs(spark, good + bad, extra=True)
    out = quality.quality_filter(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(60))
    assert quality.quality_filter(df.limit(0)).count() == 0


def symbol_junk(n, seed):
    r = random.Random(seed)
    return [" ".join(w + r.choice("&#$%*") * 3 for w in p.split()) for p in prose(n, seed)]


def test_references_withstand_junk(spark):
    good = prose(240, 5)
    spread = docs(spark, good + symbol_junk(120, 6))  # a third of the rows, all distinct, in the same source
    assert {r.doc_id for r in quality.quality_filter(spread).collect()} == set(range(240))
    copies = docs(spark, good[:80] + symbol_junk(1, 7) * 200)  # one text many times counts once
    assert {r.doc_id for r in quality.quality_filter(copies).collect()} == set(range(80))
    hot = docs(spark, good[:80] + symbol_junk(160, 8)).withColumn("source", F.when(F.col("doc_id") >= 80, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    assert {r.doc_id for r in quality.quality_filter(hot).collect()} == set(range(80))
    assert {r.doc_id for r in quality.quality_filter(docs(spark, good[:80]).drop("source")).collect()} == set(range(80))
    failed = docs(spark, good[:80] + ["&&& ### " * 60] * 5 + [f"&&&{i}" for i in range(200)])  # what the base rule rejects is no measure
    left, ref = docs(spark, good[:80]), quality.language_references(failed).collect()[0].reference
    assert np.allclose(ref, quality.language_references(left).collect()[0].reference) and len(ref) == quality.N_CLASSES + quality.N_COMMON + 1


def test_common_words_reject_tables_and_other_languages(spark):
    r = random.Random(21)
    common = {"en": "the of and to in is that it for was".split(), "de": "der die das und ist von den zu mit sich".split()}

    def text(lang, n, share=0.24):
        other = ["".join(r.choice("bdgklmnrstaeiou") for _ in range(r.randint(4, 9))) for _ in range(n)]
        return " ".join(r.choice(common[lang]) if r.random() < share else w for w in other)

    lengths = [50, 60, 80, 120, 200, 400, 1000, 2000]
    good = [(lang, text(lang, n)) for lang in common for n in lengths * 10]
    bad = [(lang, text(lang, n, 0)) for lang in common for n in lengths[2:]]
    bad += [("en" if lang == "de" else "de", text(lang, n)) for lang in common for n in lengths[2:]]
    df = spark.createDataFrame([(i, *x, "s") for i, x in enumerate(good + bad)], "doc_id long, lang string, text string, source string")
    out = quality.quality_verdicts(df).collect()
    assert not any(r.base_failed for r in out)
    assert {r.doc_id for r in out if not r.kept and r.doc_id < len(good)} == set()
    assert {r.doc_id for r in out if r.kept and r.doc_id >= len(good)} == set()


def test_js_distance():
    p, q = np.array([[2.0, 0.0], [1.0, 1.0]]), np.array([0.0, 1.0])
    assert quality.js_distance(p, q)[0] == pytest.approx(1.0)
    m = [0.25, 0.75]
    want = math.sqrt((0.5 * math.log2(0.5 / m[0]) + 0.5 * math.log2(0.5 / m[1]) + math.log2(1 / m[1])) / 2)
    assert quality.js_distance(p, q)[1] == pytest.approx(want)


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(q) > 255 for q in m[0].split("."))) or (kind == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    out.sort()
    return [sum(o[1] == k for o in out) for k in range(4)], ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in out)


PII = [*EDGES, "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 00012.1.1.1", "4111 1111-1111 1111 5", "4111 1111 1111 1111", "\x01a@b.co\x01 +49 (030) 123-45678.", "1" * 20000 + " 4111111111111111", "1 2 3 4 5 6 7 8 9 " * 500, "é+1 (487) 555-7209x", "😀 x@y.z 10.0.0.1"]


def test_pii_base_spans(spark):
    for r in pii.pii_report(docs(spark, PII)).collect():
        n, spans = base_spans(PII[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, r
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_pii_adds_and_redacts(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "iban DE88 3704 0044 0532 0130 00", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "mail a@b.co now", None]
    df = docs(spark, texts, extra=True)
    got = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert got[0] == "iban:5:32" and got[1] == "" and got[2] == "secret:9:49" and got[3] == ""
    out = pii.redact(df)
    assert out.columns == df.columns
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[0] == "iban [IBAN] ok" and clean[2] == 'token = "[SECRET]"' and clean[4] == "mail [EMAIL] now" and clean[5] is None


def test_pii_plan_is_native(spark):
    plan = pii.pii_report(docs(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("Scan ExistingRDD")[0].split("*(1) Project")[0])


# --- token counts


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(5)
    letters = list("'''  \n\tsstmdrevl LLaA1 2?!é 　—😀")
    texts = [*EDGES, "a<|endoftext|>b  <|endoftext|><|endoftext|>", *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000))]
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {x.doc_id: x for x in token_counts.token_counts(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want[i], len((t or "").encode()), want[i] > 1024), t


def test_chunk_maps_compose():
    classes = np.random.default_rng(0).integers(0, 11, 10_000).astype(np.uint8)
    state, want = token_counts.FRESH, []
    for c in classes:
        want.append(state)
        state = token_counts._GO[c << 4 | state]
    assert token_counts.run_states(classes).tolist() == want


# --- sampled segmentation


def test_pieces_are_lossless_and_reproducible(spark):
    path = vocabulary("piece_bpe_32k.model")
    texts = [*EDGES, "Hello  world\n\n x", "träumen ▁ ok ", "ﬁ ½"]
    df = docs(spark, texts)
    first = {r.doc_id: r for r in sentence_pieces.sample_pieces(df, path).collect()}
    again = {r.doc_id: r.pieces for r in sentence_pieces.sample_pieces(df.repartition(3), path).collect()}
    other = {r.doc_id: r.pieces for r in sentence_pieces.sample_pieces(df, path, seed=1).collect()}
    assert all(r.lossless for r in first.values())
    assert {k: r.pieces for k, r in first.items()} == again
    assert other != again
    back = {r.doc_id: r.text for r in sentence_pieces.decode_pieces(sentence_pieces.sample_pieces(df, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_pieces_follow_their_weights():
    units = sentence_pieces.load(vocabulary("piece_bpe_32k.model"))
    p = units.pieces
    ids = {p.data[p.at[i] : p.at[i + 1]].tobytes(): i for i in p.id[p.id >= 0]}

    def paths(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest in paths(s[k:]):
                    yield (ids[s[:k]], *rest)

    every = list(paths(b" there"))
    weight = np.array([np.exp(p.weight[list(q)].sum()) for q in every])
    n = 20_000
    data, at = np.frombuffer(b"there" * n, np.uint8), np.arange(n + 1) * 5
    got, ptr = sentence_pieces.sample(data, at, np.random.default_rng(0).integers(0, 2**62, n), units)
    seen = Counter(tuple(got[a:b].tolist()) for a, b in zip(ptr[:-1], ptr[1:], strict=True))
    assert sum(seen[q] for q in every) == n
    assert max(abs(seen[q] / n - w) for q, w in zip(every, weight / weight.sum(), strict=True)) < 0.015


# --- repeated strings


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    c = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if c[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length", [1, 5, 14, 40])
def test_repeats_equal_brute_force(spark, length):
    r = random.Random(length)
    texts = [None, "", "x" * 100]
    for i in range(120):
        t = "".join(r.choice("abé ") for _ in range(r.randint(0, 120)))
        if r.random() < 0.4:
            o = r.choice(texts) or ""
            a = r.randint(0, len(o))
            t = t[:20] + o[a : a + 60] + t[20:]
        texts.append(t if i % 30 else texts[-1])
    got = {x[0]: tuple(x)[1:5] for x in suffix_dedup.remove_repeats(docs(spark, texts).repartition(4), min_length=length, chunk_bytes=1500, bucket_samples=200, bucket_bytes=2000).collect()}
    assert got == removed(texts, length)
    assert suffix_dedup.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0


def test_difference_covers():
    for v, d in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


# --- near-duplicates


def near_groups(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def edited(t, n, r):
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("width", "percent", "bands", "rows", "block"), [(3, 85, 24, 5, 16 << 20), (5, 80, 32, 4, 3000)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, percent, bands, rows, block):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    r = random.Random(7)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(40, 200))) for _ in range(12)]
    texts = [*EDGES, *base, *(edited(base[i % 3], r.randint(0, 9), r) for i in range(150)), base[5], base[5].upper(), "A", " a ", None]
    df = docs(spark, texts, extra=True)
    got = {x[0]: tuple(x)[1:] for x in minhash.near_duplicates(df, width, percent, bands, rows).collect()}
    want = near_groups(texts, width, percent)
    assert got == want
    kept = minhash.deduplicate(df, width=width, percent=percent, bands=bands, rows=rows)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == [i for i, w in want.items() if w[2]]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, "x y z u"), (5, text), (9, text), (None, text), (7, "q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False), (None, None, True)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (3, 3)], "u long, v long")
    got = {r.id: r.comp for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 45: 40, 50: 40}


# --- neighbours


def test_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 16)).round(3)
    x[100:140] = x[99]  # more equal vectors than results
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    out = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    hits = total = 0
    for q in range(0, 1500, 20):
        mine = sorted((o for o in out if o.query_id == q), key=lambda o: o["rank"])
        score = (x[q] * x).sum(1)
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-score[i], i))[:20]
        assert [o["rank"] for o in mine] == list(range(1, 21))
        assert all(o.score == pytest.approx(score[o.vec_id], abs=1e-12) for o in mine)
        assert [(-o.score, o.vec_id) for o in mine] == sorted((-o.score, o.vec_id) for o in mine)
        hits, total = hits + len({o.vec_id for o in mine} & set(want)), total + 20
    assert {o.query_id for o in out} == set(range(0, 1500, 20))
    assert hits / total >= 0.9
    assert ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


# --- main text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p><b>One, with\n some   text.<br><p>Two <i>more</i> words</p><!-- c --></article><footer>f</footer>", ["Head", "One, with some text.", "Two more words"]),
        ('<body><div class="ad">Buy</div><div id="content"><p>A long paragraph, with commas, and words that count for something.</p><p>Short</p><div class="comments"><p>First, I say, as a reader, this is long enough too.</p></div></div><aside>side</aside></body>', ["A long paragraph, with commas, and words that count for something.", "Short"]),
        ('<script>var t="</p>";</script><style>p{}</style><p>Only &quot;this&quot;', ['Only "this"']),
        ('<div class="main-nav"><p>Home, news, and all the other places, really.</p></div><div class="story"><div class="post-header"><h2>Title</h2></div><p>Words of the story, with commas, and an end to it.</p><div id="related-posts"><p>More, more, and more things to read here.</p></div></div>', ["Title", "Words of the story, with commas, and an end to it."]),
        ("<article><p>a > b < c &nbsp; d</p><form>no</form></article>", ["a > b < c d"]),
    ],
)
def test_main_text(page, want):
    assert html_text.extract_blocks(page) == want


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p><p>y</p></article>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [tuple(r) for r in html_text.main_texts(pages).orderBy("page_id").collect()] == [(1, "u", "x\n\ny", 4), (2, None, "", 0)]


# --- classifiers


def labelled(spark, n=400):
    r = random.Random(11)
    texts, rows = prose(n, 4), []
    for i in range(n):
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            texts[i] += " " + r.choice(["rotten", "nasty", "awful"]) + " " + r.choice(["rotten", "nasty", "awful"])
        if poor:
            texts[i] += " | click | here"
        rows.append((i, int(not poor), int(toxic)))
    return docs(spark, texts, extra=True), spark.createDataFrame([*rows, (9999, None, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")


def test_chain_on_held_out_rows(spark):
    df, labels = labelled(spark)
    chain = toxicity.fit_chain(df, labels.filter("doc_id % 2 = 0"), ["quality", "toxic"])
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    held = [i for i in range(400) if i % 2]
    assert np.mean([got[i].toxic == (i % 5 == 0) for i in held]) > 0.97
    assert np.mean([(got[i].p_quality < 0.5) == (i % 7 == 0) for i in held]) > 0.97
    assert len(chain.weights[1]) == len(chain.buckets[1]) + 2  # intercept and the earlier category


def test_chain_without_labels(spark):
    df, labels = labelled(spark, 30)
    chain = toxicity.fit_chain(df, labels.limit(0), ["quality", "toxic"])
    assert {(r.p_quality, r.p_toxic, r.toxic) for r in toxicity.score(df, chain).collect()} == {(0.0, 0.0, False)}
    assert toxicity.score(df.limit(0), chain).count() == 0


def test_mixing_reaches_its_targets(spark):
    df, labels = labelled(spark)
    weights = {"clean": 0.6, "low": 0.3, "toxic": 0.1}
    got = mixing.mixing_rates(df, labels, weights).collect()
    total = np.array([sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS])
    assert min(r.rate for r in got) >= 0
    assert total / total.sum() == pytest.approx([weights[d] for d in mixing.DOMAINS], abs=1e-4)
    assert total.sum() == pytest.approx(sum(r.n_tokens for r in got), rel=1e-4)


def test_mixing_repeats_but_drops_nothing(spark):
    df, labels = labelled(spark)
    out = mixing.apply_rates(df, df, labels, {"clean": 0.6, "low": 0.3, "toxic": 0.1})
    assert out.columns == df.columns
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == set(range(400))
    assert sum(times[i] for i in range(0, 400, 7)) > 1.5 * 58
    assert mixing.apply_rates(df.limit(0), df, labels).count() == 0


def shares_of(table, rate):
    out = np.array(table.select("t", "a", "b", "c", rate.alias("r")).collect(), float)
    got = (out[:, :1] * out[:, 4:] * out[:, 1:4]).sum(0)
    return got, out


@pytest.mark.parametrize("kind", ["clean", "half", "soft"])
def test_bounded_rates_reach_the_brute_force_optimum(spark, kind):
    r, n, target = np.random.default_rng(3), 3000, np.array([0.8, 0.12, 0.08])
    middle = {"clean": [0.97, 0.02, 0.01], "half": [0.45, 0.5, 0.05], "soft": [0.7, 0.2, 0.1]}[kind]
    p = r.dirichlet(np.array(middle) * {"clean": 6, "half": 2, "soft": 20}[kind], n)
    tokens = r.integers(50, 900, n).astype(float)
    table = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p)], "t long, a double, b double, c double")
    got, out = shares_of(table, mixing.fit_rates(table, ["t", "a", "b", "c"], target, lower=1.0))
    want = target * max(tokens @ p / target)
    a = (tokens[:, None] * p).T
    x, free = np.zeros(n), np.zeros(n, bool)  # rates above 1 by the active-set method: the best one enters until none helps
    while ((slope := a.T @ (want - a.sum(1) - a @ x))[~free] > 1e-9 * want.sum() * tokens.max()).any():
        free[np.argmax(np.where(free, -np.inf, slope))] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], want - a.sum(1), rcond=None)[0]
            if z[free].min() > 0:
                break
            down = free & (z <= 0)
            x += (x[down] / np.maximum(x[down] - z[down], 1e-300)).min() * (z - x)
            free &= x > 1e-12
        x = z
    best = a.sum(1) + a @ x
    assert out[:, 4].min() >= 1
    assert np.linalg.norm(got - want) <= np.linalg.norm(best - want) + 1e-3 * want.sum()
    assert got / got.sum() == pytest.approx(best / best.sum(), abs=2e-3)


def test_missed_targets_are_told(spark):
    table = spark.createDataFrame([(10, 0.9, 0.1), (10, 0.5, 0.5)], "t long, a double, b double")
    with pytest.warns(UserWarning, match="misses its targets"):
        mixing.fit_rates(table, ["t", "a", "b"], np.array([0.0, 1.0]), lower=1.0)


def test_rates_stay_nonnegative_when_targets_are_out_of_reach(spark):
    table = spark.createDataFrame([(10, 0.9, 0.1), (10, 0.5, 0.5), (0, 0.5, 0.5)], "t long, a double, b double")
    rate = mixing.fit_rates(table, ["t", "a", "b"], np.array([0.0, 1.0]))
    rates = [r[0] for r in table.select(rate).collect()]
    assert min(rates) >= 0 and rates[0] < 0.2 and rates[1] > 0.5
