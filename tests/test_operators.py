"""Golden rows of the document-metadata operators."""

import datetime
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import configs, prompt, response, text
from docloom.jobs import classify
from docloom.operators import bridge, geometry, ocr, recovery, reviews, taxonomy, writeback
from docloom.sources import records
from docloom.streaming import retry

EDGES = ["", None, "Straße ﬁn", "A B\u001f c", "x́y", "ΣΑΣ", "a_b-c 1½", "{{TAGS_JSON}}", "😀 ok"]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def exact(v):
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", v or "").casefold()))


def test_exact_normalisation(spark):
    assert column(spark, EDGES, text.normalize_words_exact) == [exact(v) for v in EDGES]
    assert column(spark, ["  STRASSE\t 1 "], text.name_key_exact) == ["strasse 1"]


def test_native_normalisation(spark):
    plain = ["Straße Nr. 5", "", None, "one,two"]
    assert column(spark, plain, text.normalize_words) == [exact(v) for v in plain]
    words = " ".join(f"W{i}" for i in range(200))
    assert column(spark, [words, "-- a b", None], text.word_prefix) == [" ".join(f"w{i}" for i in range(96)), "a b", ""]


def test_white_space(spark):
    assert column(spark, [" \u001fx y ", None], text.strip) == ["x y", None]
    assert column(spark, [" a \n b ", None], text.collapse) == ["a b", ""]


def test_compact(spark):
    cut = column(spark, ["  " + "a" * 8 + "b" * 8 + "  ", "short", None], lambda c: prompt.compact(c, 10, 0.57)[0])
    assert cut == ["a" * 5 + prompt.CUT_MARK + "b" * 5, "short", ""]


def test_render_is_single_pass(spark):
    out = column(spark, ["{{ B }} x"], lambda c: prompt.render("[{{ A }}|{{B}}]", {"A": c, "B": F.lit("b")}))
    assert out == ["[{{ B }} x|b]"]
    with pytest.raises(ValueError, match="C"):
        prompt.render("{{ C }}", {})


def test_created(spark):
    given = ["2024-02", "2025-02", " 2024-05 ", "2024-13", "0000-02", "2024-02-30", "", None]
    assert column(spark, given, response.last_day_of_month) == ["2024-02-29", "2025-02-28", "2024-05-31", "2024-13", "0000-02", "2024-02-30", "", None]


def verdict(spark, raw):
    names = lambda n: spark.createDataFrame([(n,)], "name string")
    rows = spark.createDataFrame([(1, raw)], "k int, raw string")
    return response.with_errors(rows, ["k"], names("Invoice"), names("Example Ltd"), names("Money"), 2).collect()[0].errors


@pytest.mark.parametrize(
    ("raw", "errors"),
    [
        ('{"title":"T","document_type":"Invoice","correspondent":"Example Ltd","tags":["Money"],"created":"2026-03-31"}', []),
        ('{"title":"T","document_type":"","correspondent":"","tags":["Money","Money"],"created":""}', []),
        ('{"title":" ","document_type":"Other","correspondent":"x","tags":["a","b","c"],"created":"x"}', ["title_missing", "document_type_invalid", "correspondent_invalid", "tags_too_many", "tags_unknown", "created_format"]),
        ('{"title":1,"tags":"Money","created":3}', ["title_missing", "document_type_invalid", "correspondent_invalid", "tags_not_a_list", "created_not_a_string"]),
        ('{"title":"T","document_type":"","correspondent":"","tags":[7],"created":"2024-02-30"}', ["tags_unknown", "created_not_a_date"]),
        ("[]", ["not_an_object"]),
        ("nothing", ["not_an_object"]),
        (None, ["not_an_object"]),
    ],
)
def test_metadata_verdicts(spark, raw, errors):
    assert verdict(spark, raw) == errors


def test_correspondent_verdicts(spark):
    given = ['{"correspondent":"A"}', '{"correspondent":""}', '{"correspondent":"a","tags":[]}', '{"correspondent":1}', '{"correspondent":"%s"}' % ("x" * 255), '{"correspondent":"%s"}' % ("x" * 256), "[]", "{}"]
    assert column(spark, given, response.correspondent_errors) == [[], [], ["fields"], ["not_a_string"], [], ["too_long"], ["not_an_object"], ["fields"]]


def test_matching_fails_closed(spark):
    head = " ".join(f"w{i}" for i in range(96))
    docs = spark.createDataFrame([(10, head + " one"), (11, head + " two"), (20, "same"), (21, "same"), (30, "lone")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, head + " TWO"), (2, head + " three"), (3, "same"), (4, "lone"), (5, "new")], "doc_id long, text string")
    got = {r.doc_id: (r.matched_document_id, r.match) for r in reviews.match_records(reviews.sign(asked), reviews.review_records(docs)).collect()}
    assert got == {1: (11, "prompt_content_signature"), 2: (None, "content_signature ambiguous (2)"), 3: (None, "prompt_content_signature ambiguous (2)"), 4: (30, "prompt_content_signature"), 5: (None, "no review record")}
    live = reviews.sign(docs).select(F.col("doc_id").alias("document_id"), "prompt_content_signature")
    solved = {r.doc_id: r.matched_document_id for r in reviews.resolve_ambiguous(reviews.sign(asked), reviews.review_records(docs), live).collect()}
    assert solved == {1: 11, 2: None, 3: None}


def test_routing(spark):
    known = spark.createDataFrame([(1, "ACME  Ltd"), (2, "Acme ltd"), (3, "Other")], "id long, name string")
    rows = spark.createDataFrame([(1, " acme\tLTD "), (2, "New"), (3, " "), (4, None)], "k int, candidate string")
    got = {r.k: (r.candidate_kind, r.matched_existing, r.pending) for r in taxonomy.route_candidates(rows, known).collect()}
    assert got == {1: ("existing", "Acme ltd", ""), 2: ("new", None, "New"), 3: ("none", None, ""), 4: ("none", None, "")}


def test_missing_names(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r[0] for r in taxonomy.missing_names(names("a", "b", "c"), names("a:latest", "b")).collect()] == ["c"]


def test_names_in_order(spark):
    lists = spark.createDataFrame([(1, [2, 1, 2, 9]), (2, [])], "k int, ids array<long>")
    dims = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    assert {r.k: r.names for r in taxonomy.names_in_order(lists, dims, ["k"]).collect()} == {1: ["two", "one", "two"], 2: []}


def test_final_tags(spark):
    row = spark.createDataFrame([([5, 1, 7, 9], [1, 2], [2, 3], [9])], "t array<long>, m array<long>, c array<long>, s array<long>")
    assert row.select(writeback.final_tags(F.col("t"), F.col("m"), F.col("c"), F.col("s"))).collect()[0][0] == [2, 3, 5, 7]


def test_identity_and_merge(spark):
    find = lambda c: bridge.document_identity(c, "Classify", "Filename:", "Content (")
    got = column(spark, ["Classify\nFilename: a/b.pdf\nContent (cut): Hello: x ", "Classify Content (", "Filename: a Content (b): c"], find)
    assert got[0].filename == "a/b.pdf" and got[0].content == "Hello: x" and got[1:] == [None, None]
    merged = column(spark, [" new  one ", "OLD", ""], lambda c: bridge.merge_candidate(F.array(F.lit("Old")), c, F.lit(None)))
    assert merged == [["Old", "new one"], ["Old"], ["Old"]]


def test_tokens_to_words(spark):
    tokens = [(t, b, b, b and b + 1, b and b + 1) for t, b in [(" ", 0.0), ("He", 1.0), ("llo", None), ("o", 3.0), (" ", 0.0), ("bad", None), (" ", 0.0), ("x", 9.0), ("", 1.0)]]
    rows = spark.createDataFrame([(1, tokens), (2, []), (3, None), (4, [("a", 1.0, 1.0, 1.0, 1.0)]), (5, tokens[2:3])], "line int, tokens array<struct<token: string, left: double, top: double, right: double, bottom: double>>")
    got = {r.line: r.words and [(w.at, w.word, w.left, w.right) for w in r.words] for r in rows.select("line", geometry.merge_tokens(F.col("tokens")).alias("words")).collect()}
    assert got == {1: [(1, "Heo", 1.0, 4.0), (7, "x", 9.0, 10.0)], 2: [], 3: None, 4: [(0, "a", 1.0, 1.0)], 5: []}
    assert column(spark, ["He llo", "one"], lambda c: ocr.prefer_line_words(F.array(F.lit("a"), F.lit("b")), c)) == [["He", "llo"], ["a", "b"]]


def test_word_boxes(spark):
    lines = spark.createDataFrame([(1, "ab c  defg", 0.0, 70.0), (2, "", 0.0, 5.0), (3, "aaaa b", 0.0, 0.5)], "k int, line string, left double, right double")
    got = [(r.k, r.word, r.left, r.right) for r in geometry.estimate_boxes(lines, ["k"], "line").orderBy("k", "at").collect()]
    assert got == [(1, "ab", 0.0, 20.0), (1, "c", 20.0, 30.0), (1, "defg", 30.0, 70.0), (3, "aaaa", 0.0, 0.5), (3, "b", 0.5, 0.5)]


def test_geometry_and_languages(spark):
    assert column(spark, [[1.0, 2.0, 3.0, 4.0], [1.0]], ocr.polygon, "array<double>") == [[[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]], None]
    assert column(spark, ["deu", "eng,deu", "eng", ""], lambda c: ocr.language_matches(c, F.lit("de"))) == [True, True, False, True]
    assert column(spark, ["x std::bad_alloc", "ValueError: invalid image", None], ocr.is_transient) == [True, False, False]
    dpi = column(spark, ["[300, 288]", "300", "[300]", '["x", 90]', "[]", '"300"', None], lambda c: geometry.dots_per_inch(F.try_parse_json(c)))
    assert dpi == [294.0, 300.0, 300.0, 90.0, None, None, None]


def test_polygons_of_any_shape(spark):
    read = lambda c: F.transform(geometry.points(F.try_parse_json(c)), lambda p: F.array(p["x"], p["y"]))
    square = [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]]
    values = ["[1,2,3,4]", "[[1,2],[3,2],[3,4],[1,4]]", '[[1,2],"x",[3,2,9],[3],null,["3","4"],[1,null],[1,4]]', "[1,2,3]", "{}", None, '[1,2,3,"4"]']
    assert column(spark, values, read) == [square, square, square, [], [], [], []]
    around = lambda c: geometry.box(geometry.points(F.try_parse_json(c)))
    assert [tuple(b) for b in column(spark, [values[0], "[[5,1],[0,9],[2,2]]"], around)] == [(1.0, 2.0, 3.0, 4.0), (None,) * 4]


def elements(spark, *pages):
    raws = spark.createDataFrame([(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(pages)], "k int, raw string")
    read = geometry.read_pages(raws, ["k"]).persist()
    errors = {r.k: r.error for r in read.collect() if r.error}
    return errors, [tuple(r) for r in geometry.element_rows(read, ["k"]).orderBy("k", F.asc_nulls_first("line_no"), F.asc_nulls_first("word_no"), "ocr_class").collect()]


def test_engine_pages_as_elements(spark):
    page = {
        "rec_texts": [" two words ", "", "short", "fi ne", "lone", "no score"],
        "rec_scores": [1.7, 0.5, 0.5, "high", None, -3],
        "rec_polys": [[0, 5, 80, 9], [0, 0, 1, 1], [[0, 0], [1, 1], [2, 2]], [[10, 1], [30, 1], "bad", [30, 4], [10, 4]], [0, 0, 9, 9], [0, 0, 8, 8]],
        "text_word": [[], [], [], ["\ufb01", " ", "n", "e"], ["lo", "ne"], [" "]],
        "text_word_boxes": [[], [], [], [[10, 1, 12, 4], [12, 1, 13, 4], [13, 1, 20, 4], [[1, 2]]], [[[0, 0]], None], [[0, 0, 1, 1]]],
    }
    errors, rows = elements(spark, {"width": 100, "height": 50, "dpi": [300, 100], "page_number": 4, "page": page}, {"width": 0, "height": 5, "page": page}, "no json", {"width": 9, "height": 9}, {"width": 9, "height": 9, "page": {"rec_texts": "x"}})
    assert errors == {1: "page_size", 2: "no_json"}
    assert [r for r in rows if r[3] == "ocr_page"] == [(k, None, None, "ocr_page", None, None, 0.0, 0.0, *size, *rest) for k, size, rest in [(0, (100.0, 50.0), (200.0, 4)), (3, (9.0, 9.0), (None, None)), (4, (9.0, 9.0), (None, None))]]
    words = [(r[1], *r[4:10]) for r in rows if r[3] == "ocrx_word"]
    assert words == [
        (0, "two", 1.0, 0.0, 5.0, 30.0, 9.0),
        (0, "words", 1.0, 30.0, 5.0, 80.0, 9.0),
        (1, "fi", 0.0, 10.0, 1.0, 12.0, 4.0),  # the line's own spelling; a token without box is left out
        (1, "ne", 0.0, 13.0, 1.0, 20.0, 4.0),
        (2, "lone", 0.0, 0.0, 0.0, 9.0, 9.0),  # no token has a box
        (3, "no", 0.0, 0.0, 0.0, pytest.approx(8 * 2 / 7), 8.0),
        (3, "score", 0.0, pytest.approx(8 * 2 / 7), 0.0, 8.0, 8.0),
    ]
    assert sum(r[3] == "ocr_line" for r in rows) == sum(r[3] == "ocr_carea" for r in rows) == 4


def test_given_words_that_fail_leave_the_line(spark):
    word = "text: string, left: double, top: double, right: double, bottom: double"
    lines = [("a b", 0.5, 0.0, 0.0, 9.0, 9.0, [(" ", 0.0, 0.0, 1.0, 1.0), ("x", None, None, None, None)]), ("c d", 0.5, 0.0, 0.0, 9.0, 9.0, [(" y ", 1.0, 1.0, 2.0, 2.0)])]
    pages = spark.createDataFrame([(1, 9.0, 9.0, None, None, lines), (2, 9.0, None, None, None, lines), (3, 9.0, 9.0, None, None, None)], f"k int, width double, height double, dpi double, page_number int, lines array<struct<text: string, score: double, left: double, top: double, right: double, bottom: double, words: array<struct<{word}>>>>")
    rows = geometry.element_rows(pages, ["k"]).collect()
    assert [(r.k, r.text, r.left, r.right) for r in rows if r.text] == [(1, "a b", 0.0, 9.0), (1, "y", 1.0, 2.0)]
    assert [r.k for r in rows if r.ocr_class == "ocr_page"] == [1, 3]


KINDS = ["error"] * 6 + ["view", "error", "signup", "error"]
WANT = [(1, "waiting", 15), (2, "waiting", 60), (3, "waiting", 300), (4, "waiting", 600), (5, "failed", None), (1, "waiting", 15), (2, "idle", None), (1, "waiting", 15), (2, "failed", None), (1, "waiting", 15)]


def attempts(spark):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + datetime.timedelta(minutes=i), 7, k) for i, k in enumerate(KINDS)], "event_id long, ts timestamp, user_id long, event_type string")


def test_retry_in_batch(spark):
    out = recovery.retry_schedule(attempts(spark), "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup")
    assert [(r.attempt, r.status, r.retry_after_seconds) for r in out.orderBy("event_id").collect()] == WANT


def test_retry_as_stream(spark, tmp_path):
    rows = attempts(spark).withColumn("value", F.lit(0.0)).withColumn("props", F.lit(""))
    for k in range(3):  # state goes on from batch to batch
        rows.filter(F.floor(F.col("event_id") / 4) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    work = retry.retry_batches(str(tmp_path / "out"), str(tmp_path / "state"), F.col("event_type") == "error", F.col("event_type") == "signup")
    twice = lambda batch, n: (work(batch, n), work(batch, n))  # noqa: E731  a batch that is run again changes nothing
    retry.run_available(retry.read_events(spark, str(tmp_path / "in"), 1), twice, str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()
    assert [(r.attempt, r.status, r.retry_after_seconds) for r in got] == WANT


def test_newest_failures(spark):
    rows = spark.range(30).withColumn("ts", F.col("id"))
    assert [r.id for r in recovery.newest_failures(rows, "ts", "id", 3).collect()] == [29, 28, 27]


def test_dismissed_failure(spark):
    failures = spark.createDataFrame([("a",), ("b",)], "id string")
    state = spark.createDataFrame([("failed", "a"), ("failed", "b"), ("idle", None)], "status string, failure_id string")
    left, now = recovery.dismiss_failure(failures, state, "a")
    assert [r.id for r in left.collect()] == ["b"]
    assert sorted((tuple(r) for r in now.collect()), key=str) == [("failed", "b"), ("idle", None), ("idle", None)]


def test_wait_ends_once(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    given = spark.createDataFrame([(1, at(0), 7, "error"), (2, at(20), 7, "error"), (3, at(100), 7, "error"), (4, at(0), 8, "error")], "event_id long, ts timestamp, user_id long, event_type string")
    asked = spark.createDataFrame([(7, at(5)), (7, at(6)), (7, at(15)), (7, at(90)), (7, at(999))], "user_id long, ts timestamp")
    scheduled = recovery.retry_schedule(given, "user_id", "ts", "event_id", F.col("event_type") == "error", F.lit(False))
    ended = {r.event_id: (r.ended_at, r.ended_by) for r in recovery.waits(scheduled, asked, "user_id", "ts", "event_id").collect()}
    assert ended == {1: (at(5), "trigger"), 2: (at(80), "deadline"), 3: (at(400), "deadline"), 4: (at(15), "deadline")}


def test_models_have_a_default(spark):
    blank = spark.createDataFrame([(" ",), (None,)], "m string")
    assert [r.model for r in configs.models(blank, "m", "d").collect()] == ["d"]
    assert [r.model for r in configs.models(spark.createDataFrame([(" a ",), ("a",)], "m string"), "m", "d").collect()] == ["a"]


def test_delays(spark):
    assert column(spark, [45, 310, 7500], recovery.human_delay, "int") == ["45 s", "5 m 10 s", "2 h 5 m"]
    assert column(spark, ["15, 60", " ", "x", "1,"], recovery.parse_delays) == [[15, 60], [], None, None]


def test_downsampling(spark):
    row = spark.range(1).select(ocr.downsampled(F.lit(3100), F.lit(100), F.lit(300), 3000).alias("s")).select("s.*").collect()[0]
    assert tuple(row) == (3000, 96, 290, 288)


def test_configs(spark):
    parse = lambda f: lambda c: f(F.try_parse_json(c))
    good = '{"url":"https://x.y/","queue_tag":"q","poll_seconds":5,"max_side_pixels":3000,"retry_delays":[15]}'
    assert column(spark, [good, "{}", None], parse(configs.config_errors)) == [[], [r.path for r in configs.RULES], [r.path for r in configs.RULES]]
    delays = ['{"retry_delays":[]}', '{"retry_delays":[0]}', '{"retry_delays":7}', '{"retry_delays":[1,2]}', "{}"]
    assert column(spark, delays, parse(configs.lenient_delays)) == [[], [15, 60, 300, 600], [15, 60, 300, 600], [1, 2], [15, 60, 300, 600]]
    sides = ["null", "true", "1999", "4001", '"3200"', "2500"]
    assert column(spark, [f'{{"max_side_pixels":{v}}}' for v in sides], parse(configs.lenient_side)) == [3000, 3000, 3000, 3000, 3200, 2500]
    assert column(spark, ['{"a":1,"b":2}'], lambda c: configs.unknown_keys(c, ["a"])) == [["b"]]
    history = spark.createDataFrame([("s", 1, '{"a":1,"z":2}', "save"), ("s", 2, '{"a":2}', "save")], "section string, version long, config string, source string")
    new, gone = configs.restore(history, spark.createDataFrame([("s", 1), ("s", 9)], "section string, version long"), ["a"])
    assert [(r.version, r.config, r.source) for r in new.orderBy("version").collect()][-1] == (3, '{"a":1}', "restore")
    assert [tuple(r) for r in gone.collect()] == [("s", 9)]


def test_profiles(spark):
    assert [(r.detection is None, r.error) for r in column(spark, ["small", "huge"], ocr.profile_models)] == [(False, None), (True, "unknown_profile")]


def job(spark, answers, dry_run=False, names_now=("T",)):
    """The job over documents 1.. with the given raw answers; document 1000 has no content. Tags 98 and 99 steer."""
    names = lambda *n: spark.createDataFrame(list(enumerate(n, 1)), "id long, name string")
    rows = [(k, f"Letter {k}", a) for k, a in enumerate(answers, 1)] + [(1000, " \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer string")
    dims = spark.createDataFrame([(["T", "U"], ["S"], ["A"])], "document_types array<string>, correspondents array<string>, content_tags array<string>")
    current = docs.select("doc_id", F.array(F.lit(1), F.lit(50), F.lit(98), F.lit(99)).cast("array<long>").alias("tag_ids"))
    model, sender = (lambda p: F.when(p.isNotNull(), F.col("answer"))), (lambda p: F.lit('{"correspondent":"s "}'))
    return classify.run(docs, dims, names("T", "U"), names("S"), names("A"), current, model, sender, 99, 98, dry_run=dry_run, generated_at=F.lit("2024-05-01T00:00:00Z"), types_now=names(*names_now))


def answer(created="", kind="", tags=("A",)):
    return json.dumps({"title": " X ", "document_type": kind, "correspondent": "", "tags": list(tags), "created": created})


def test_answers_are_normalised_before_the_verdict(spark):
    out = job(spark, [answer("2024-02"), answer(" 2024-02-03 "), answer("2023-2"), answer("2024-13"), answer("0000-01")])
    assert {r.doc_id: r.validation_errors for r in out.reports.collect()} == {1: "", 2: "", 3: "created_format", 4: "created_format", 5: "created_format"}
    assert {r.doc_id: r.created for r in out.patches.collect()} == {1: "2024-02-29", 2: "2024-02-03"}


def test_every_document_ends_with_one_list_of_tags(spark):
    answers = [answer(), answer(tags=["B"]), answer(kind="U"), "no json", "", None, "[1]"]
    out = job(spark, answers)
    assert {r.doc_id: (r.outcome, r.tag_ids) for r in out.tags.collect()} == {
        1: ("success", [1, 50]),
        2: ("invalid", [1, 50, 98]),
        3: ("name_gone", [1, 50, 98]),  # U has gone since the prompt
        4: ("model_failed", [1, 50, 98]),
        5: ("model_failed", [1, 50, 98]),
        6: ("model_failed", [1, 50, 98]),
        7: ("invalid", [1, 50, 98]),
        1000: ("empty_content", [1, 50, 98]),
    }
    assert sorted(r.doc_id for r in out.reports.collect()) == [1, 2, 3, 7]
    assert [(r.doc_id, r.title, r.correspondent_id, r.tag_ids) for r in out.patches.collect()] == [(1, "X", 1, [1, 50])]
    assert [(r.document_id, r.generated_at) for r in out.records.collect()] == [(1, "2024-05-01T00:00:00Z")]


def test_dry_run_leaves_the_queue_and_nothing_else(spark):
    out = job(spark, [answer(), answer(tags=["B"])], dry_run=True)
    assert {r.doc_id: (r.outcome, r.tag_ids) for r in out.tags.collect()} == {1: ("dry_run", [1, 50]), 2: ("invalid", [1, 50, 98]), 1000: ("empty_content", [1, 50, 98])}
    assert out.reports.count() == 2 and not out.patches.count() and not out.records.count()


def test_the_jobs_records_can_be_stored(spark):
    new = job(spark, [answer(), answer()]).records
    old = new.filter("document_id = 1").withColumn("generated_at", F.lit("2024-01-01")).withColumn("correspondent_suggestion", F.lit("old"))
    stored = reviews.upsert(old, new)
    assert {(r.document_id, r.generated_at, r.correspondent_suggestion) for r in stored.collect()} == {(1, "2024-05-01T00:00:00Z", ""), (2, "2024-05-01T00:00:00Z", "")}
    assert set(stored.columns) == set(reviews.STORED)


def test_senders_collapse_before_their_length_counts(spark):
    wide = json.dumps({"correspondent": "a" + " " * 300 + "b"})
    assert column(spark, [wide, json.dumps({"correspondent": "a" * 256})], response.correspondent_errors) == [[], ["too_long"]]


def test_record_files_have_their_errors(spark, tmp_path):
    good = {"version": 4, "document_id": "7", "generated_at": "2024-01-02", "content_signature": "c", "prompt_content_signature": "p", "correspondent_suggestion": "S"}
    files = {
        "7": json.dumps(good, indent=2),
        "old": json.dumps({**good, "generated_at": "2024-01-01", "correspondent_suggestion": "old"}),
        "three": json.dumps({"version": 3, "document_id": 8, "content_signature": "c", "document_signature": "d"}),
        "three_less": json.dumps({"version": 3, "document_id": 8, "content_signature": "c"}),
        "four_less": json.dumps({**good, "prompt_content_signature": 5}),
        "foreign": json.dumps({**good, "version": 9}),
        "text": json.dumps({**good, "version": "4"}),
        "nameless": json.dumps({**good, "document_id": "x"}),
        "unsigned": json.dumps({**good, "content_signature": None}),
        "list": "[4]",
        "broken": '{"version": 4',
    }
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(content)
    (tmp_path / "bytes.json").write_bytes(b'{"version": "\xff"}')
    (tmp_path / "other.txt").write_text("{}")
    read = records.read_records(records.record_files(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1][:-5]: r.error for r in read.collect()} == {
        "7": None, "old": None, "three": None, "three_less": "document_signature", "four_less": "prompt_content_signature", "foreign": "version", "text": "version",
        "nameless": "document_id", "unsigned": "content_signature", "list": "version", "broken": "unreadable", "bytes": "unreadable",
    }
    newest = records.newest(read)
    assert {(r.document_id, r.version, r.correspondent_suggestion) for r in newest.collect()} == {(7, 4, "S"), (8, 3, None)}
    stored = reviews.upsert(newest, job(spark, [answer()]).records)
    assert {r.document_id for r in stored.collect()} == {1, 7, 8}


def test_names_before_a_colon_are_present(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    gone = taxonomy.missing_names(names("a:b", "a:bc", "a", "a:b:c", "b", "c:", "x"), names("a:b:c", "c:", "xy", None))
    assert {r.required_name for r in gone.collect()} == {"a:bc", "b", "x"}


def test_missed_names_are_looked_up_once_more(spark):
    dim = lambda rows: spark.createDataFrame(rows, "id long, name string")
    lists = spark.createDataFrame([(1, [2, 1, 2]), (2, [1, 3, 9, 1]), (3, []), (4, None), (5, [9]), (6, [None, 1])], "k int, ids array<long>")
    got = taxonomy.names_in_order(lists, dim([(1, "a"), (2, "b")]), ["k"], refreshed=dim([(1, "A"), (3, "C")]))
    assert {r.k: r.names for r in got.collect()} == {1: ["b", "a", "b"], 2: ["A", "C", "A"], 3: [], 4: [], 5: [], 6: ["a"]}
    assert {r.k: r.names for r in taxonomy.names_in_order(lists, dim([(1, "a")]), ["k"]).collect()}[2] == ["a", "a"]


def test_prompts_by_fragments(spark):
    template = "{{ DOCUMENT_TEXT }}a{{ TAGS_LINES }}b{{ DOCUMENT_ID }}{{ CURRENT_TITLE }}{{ TAGS_JSON }}"
    dims = spark.createDataFrame([(["x", "{{ DOCUMENT_ID }}"],)], "tags array<string>")
    shared = {"TAGS_LINES": F.array_join("tags", "\n"), "TAGS_JSON": prompt.names_json(F.col("tags"))}
    docs = spark.createDataFrame([(1, "{{ TAGS_LINES }}", None), (2, None, "T")], "doc_id long, text string, title string")
    own = prompt.document_values(docs.columns, F.coalesce("text", F.lit("")))
    pieces = prompt.fragments(template, dims, shared)
    rows = prompt.addressed(docs, template, own, pieces)
    assert {len(r.parts) for r in rows.collect()} == {5} and pieces.count() == 2
    assert "x" not in str([p.text for r in rows.collect() for p in r.parts])
    got = {r.doc_id: r.prompt for r in prompt.assembled(rows.select("doc_id", "parts"), pieces).collect()}
    names = 'ax\n{{ DOCUMENT_ID }}b%s["x", "{{ DOCUMENT_ID }}"]'
    assert got == {1: "{{ TAGS_LINES }}" + names % "1", 2: names % "2T"}
    whole = docs.crossJoin(dims).select("doc_id", prompt.render(template, own | shared).alias("p"))
    assert got == {r.doc_id: r.p for r in whole.collect()}


def test_stored_prompts_do_not_grow_with_the_taxonomy(spark, tmp_path):
    template, sizes = "{{ TAGS_JSON }}: {{ DOCUMENT_TEXT }}", []
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string").coalesce(1)
    for n in (10, 5000):
        dims = spark.createDataFrame([([f"name {k}" for k in range(n)],)], "tags array<string>")
        pieces = prompt.fragments(template, dims, {"TAGS_JSON": prompt.names_json(F.col("tags"))})
        prompt.addressed(docs, template, {"DOCUMENT_TEXT": F.col("text")}, pieces).select("doc_id", "parts").write.parquet(f"{tmp_path}/{n}")
        sizes.append(sum(f.stat().st_size for f in (tmp_path / str(n)).glob("*.parquet")))
    assert sizes[1] < 1.1 * sizes[0]
