"""Source divergence against a plain version; its SQL twin runs on the tables."""

import random
import re
from collections import Counter
from itertools import product

import pytest

from docloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, most=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs, out = {}, {}, []
    for text, lang, source in rows:
        words = Counter(TERM.findall(text.translate(LOWER)))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(words)
        docs.setdefault(lang, Counter()).update(words.keys())
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, upto in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:upto]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)]
    return sorted(out)


def rows_of(n, sources, seed=1):
    r = random.Random(seed)
    words = ["The", "river", "ÄRger", "über", "x1y", "a", "b-c", "naïve", "中文", "The_end", "stone's", "ß", "z w", *(f"w{chr(97 + i)}{chr(97 + j)}" for i, j in product(range(5), range(5)))]
    text = lambda k: " ".join(r.choice(words[k % 7 :]) for _ in range(r.randint(0, 25)))
    return [(text(k), r.choice(["en", "en", "de", None]), f"s{r.choice(range(sources))}") for k in range(n)] + [(None, "en", None), ("", "xx", "only"), ("... 12", "yy", "a"), ("", "yy", "b"), ("word word", "yy", "c")]


@pytest.mark.parametrize("sources,entries", [(4, 1 << 20), (9, 40)])
def test_divergence_equals_a_plain_version(spark, monkeypatch, sources, entries):
    monkeypatch.setattr(divergence, "SOURCES", 4)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rows = rows_of(300, sources)
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "'x' AS Number", "2 AS n")
    got = [tuple(r) for r in divergence.source_divergence(df, least_docs=8, most_terms=5).collect()]
    assert sorted(got) == expected(rows, 8, 5)


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = rows_of(60, 3, 2) + [("long word " * 50_000, "en", "s1")]
    got = [tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=3).collect()]
    assert sorted(got) == expected(rows, 3)


def test_no_documents(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
