"""Work that must not grow with documents times names, rows of a batch or the like."""

import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.catalog import ORACLE_SQL, QUERIES
from docloom.functions import prompt
from docloom.jobs import classify, queries
from docloom.operators import geometry

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["polling_loop", "classify_and_apply", "classify_dry_run"])
def test_no_prompt_is_made_that_no_model_reads(spark, monkeypatch, name):
    monkeypatch.setattr(prompt, "names_json", lambda names: F.raise_error(F.lit("a prompt was made")))
    assert QUERIES[name](spark, SMALL).count() > 0


def test_plans_of_the_job_read_each_table_once_and_broadcast_none_whole(spark, monkeypatch):
    plans, real = {}, classify.written
    monkeypatch.setattr(classify, "written", lambda df, name: plans.update({name: plan(df)}) or real(df, name))
    docs, current = (real(df, "given") for df in queries._job_documents(spark, SMALL))
    out = queries._job(spark, SMALL, docs, current)
    leaves = {name: p.count("Relation [") for name, p in plans.items()}
    assert leaves["answers"] == 1 and leaves["outcomes"] == 2  # no taxonomy; the judged rows and the patches
    assert sum(leaves.values()) <= 22 and plan(out.tags).count("Relation [") == 4
    for df in queries._job_documents(spark, SMALL):
        assert "(p_partkey#" in plan(df) and "<= 200)" in plan(df) and "<= 10)" in plan(df)


def test_names_are_joined_once_and_not_once_a_document(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\nc"), (2, " ")], "doc_id long, text string")
    dims = spark.createDataFrame([(["T"], ["S", "R"], ["A"])], "document_types array<string>, correspondents array<string>, content_tags array<string>")
    read = classify.ask(docs, dims, F.upper)
    assert plan(read).index("Join") < plan(read).rindex("array_join") and "array_join" not in plan(read)[: plan(read).index("Join")]
    got = {r.doc_id: (r.user_prompt, r.raw, r.asked) for r in read.collect()}
    want = 'Describe the document below.\nTypes: ["T"]\nSenders: ["S", "R"]\nTags:\nA\n\na\n\nb\nc'
    assert got == {1: (want, want.upper(), True), 2: (None, None, False)}
    assert "array_join" not in plan(classify.ask(docs, dims).select("doc_id", "raw"))  # the stub reads only the content
    assert [r.raw for r in classify.classify(docs, dims).collect()] == ['{"title": "b", "document_type": "", "correspondent": "", "tags": [], "created": ""}']


def test_the_stub_query_agrees_with_its_sql_on_long_contents(spark, tmp_path):
    texts = ["a" * 40_000, "b" * 40_001, " \n", "x\n\n" + "c" * 39_000, " " * 9 + "d" * 40_000 + "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("part", "supplier"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["classify_stub"](spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(ORACLE_SQL["classify_stub"]).fetchall()) and [r[0] for r in got] == [0, 3, 4]


def test_prompts_are_hashed_without_being_whole(spark):
    docs = spark.createDataFrame([(k, f"tëxt {k}" if k % 5 else None) for k in range(300)], "doc_id long, text string").repartition(3)
    dims = spark.createDataFrame([(["ü", "b"],)], "tags array<string>")
    template, shared = "{{ DOCUMENT_ID }}: {{ TAGS_JSON }}|{{ DOCUMENT_TEXT }}|{{ TAGS_LINES }}.", {"TAGS_JSON": prompt.names_json(F.col("tags")), "TAGS_LINES": F.array_join("tags", "\n")}
    pieces = prompt.fragments(template, dims, shared)
    rows = prompt.addressed(docs, template, prompt.document_values(docs.columns, F.coalesce("text", F.lit(""))), pieces).select("doc_id", "parts")
    want = {r.doc_id: (r.n, r.h) for r in prompt.assembled(rows, pieces).select("doc_id", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("h")).collect()}
    got = prompt.digested(rows, pieces)
    assert {r.doc_id: (r.prompt_chars, r.prompt_sha256) for r in got.collect()} == want and len(want) == 300
    assert prompt.digested(rows.limit(0), pieces).count() == 0
    assert "transform(parts" not in plan(got)  # no row is joined with what the taxonomy fills
    assert got.groupBy().agg(F.max("prompt_chars")).first()[0] == max(n for n, _ in want.values())


def test_elements_in_blocks_are_those_of_one_line_at_a_time(spark, monkeypatch):
    """Left edges equal the sums word by word, and blocks of any size give the same rows."""
    rng = np.random.default_rng(5)
    lines = [" ".join("x" * int(n) for n in rng.integers(1, 12, k)) for k in (1, 2, 3, 64, 65, 700)]
    left, right = rng.uniform(0, 50, len(lines)), rng.uniform(0, 900, len(lines))
    sizes, lengths = np.array([len(x.split()) for x in lines]), np.array([len(w) for x in lines for w in x.split()])
    want = [a for x, u, v in zip(lines, left, right, strict=True) for _, a, _ in geometry.estimated(x, u, v)]
    assert geometry._left_edges(sizes, lengths, left, right).tolist() == want
    word = lambda t: {"text": t, "left": 1.0, "top": 2.0, "right": 3.0, "bottom": 4.0}
    line = lambda t, words: {"text": t, "score": 0.5, "left": 1.0, "top": 2.0, "right": 90.0, "bottom": 4.0, "words": words}
    rows = [(k, 9.0 * (k % 7 > 0), 8.0, 1.0, k, [line("a bc" * (k % 3), [word(f"w{k}"), None, word(" ")] if k % 2 else None), line(f"d {k}", [])] if k % 5 else None) for k in range(60)]
    kind = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("score", *geometry.SIDES)), ("words", pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in geometry.SIDES)])))])
    names = ["k", "width", "height", "dpi", "page_number", "lines"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.float64()] * 3, pa.int32(), pa.list_(kind)), strict=True)], names=names)
    whole = list(zip(*(a.to_pylist() for a in geometry._elements(batch)), strict=True))
    parts = [(r[0] + k, *r[1:]) for k in range(60) for r in zip(*(a.to_pylist() for a in geometry._elements(batch.slice(k, 1))), strict=True)]
    assert whole == parts and sum(r[3] == "ocr_page" for r in whole) == sum(k % 7 > 0 for k in range(60)) and any(r[4] == "w11" for r in whole)
    tokens = pa.array([[{"token": t, **dict.fromkeys(geometry.SIDES, float(i))} for i, t in enumerate(list("ab c  de" * (k % 4)))] if k % 6 else None for k in range(50)], pa.list_(pa.struct([("token", pa.string()), *((c, pa.float64()) for c in geometry.SIDES)])))
    once, calls, one = geometry._words(tokens).to_pylist(), [], geometry._block_words
    monkeypatch.setattr(geometry, "TOKENS", 40)
    monkeypatch.setattr(geometry, "_block_words", lambda x: calls.append(len(x.flatten())) or one(x))
    assert geometry._words(tokens).to_pylist() == once and len(calls) > 5 and max(calls) <= 40 + 24
    assert geometry._words(tokens[:0]).to_pylist() == []


def test_pages_are_read_without_an_expression_a_token(spark):
    """Odd pages give what the column expressions give region by region, in one block or many."""
    polygons = [[1, 2, 3, 4], [4, 3, 2, 1.5], [1, 2, 3, "4"], [1, 2, True, 4], [1, None, 3, 4], "[1,2,3,4]", [[1, 2], [3, "9"], None, {"a": 1}, [5], [0, 7, 1], [2, 2]], [[1, 2]] * 3, [], None, {"a": [1]}, 7]
    texts = [" two　words", "\x1f x ", 5, None, "a", "b c", "d", "e", "f", "g", "h", "i"]
    page = {"rec_texts": texts, "rec_scores": [*range(9), "0.5", "x", None], "rec_polys": polygons, "text_word": [["q", " ", "r"], "s", None, [], ["t", None, "u", 8]], "text_word_boxes": None, "text_word_region": [polygons[:2], polygons, polygons, polygons, [polygons[6], polygons[0]]]}
    pages = [page, page | {"rec_texts": "x"}, page | {"rec_scores": [1]}, page | {"text_word_boxes": [polygons] * 6}, page | {"text_word": [texts] * 12, "text_word_boxes": [polygons[::-1]] * 12}, None, page | {"rec_polys": [page["rec_polys"][0]] * 12}]
    rows = [(k, json.dumps({"width": 9, "height": 9, "page": p})) for k, p in enumerate(pages * 3)]
    raws = spark.createDataFrame(rows, "k int, raw string").coalesce(1)
    read = geometry.read_pages(raws, ["k"])
    boxed = raws.select("k", F.posexplode(F.expr("try_variant_get(parse_json(raw), '$.page.rec_polys', 'array<variant>')")).alias("at", "v")).select("k", "at", geometry.box(geometry.points(F.col("v"))).alias("b"))
    want = {(r.k, r.at): tuple(r.b) for r in boxed.collect()}
    got = {r.k: r.lines for r in read.collect()}
    words = lambda x: "".join(map(str, (x if x is not None else "",))).strip()
    for k, p in enumerate(pages * 3):
        some = min((len(v) if isinstance(v, list) else 0 for v in ((p or {}).get(n) for n in ("rec_texts", "rec_scores", "rec_polys"))), default=0)
        expected = [(words(p["rec_texts"][i]), want[k, i]) for i in range(some) if words(p["rec_texts"][i]) and want[k, i][0] is not None]
        assert (got[k] is None) == (not some) and [(x.text, (x.left, x.top, x.right, x.bottom)) for x in got[k] or []] == expected
    assert "MapInArrow" in plan(read) and "schema_of_variant(lambda" not in plan(read)
