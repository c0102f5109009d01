"""Pages of an OCR engine as elements: polygons of any shape, words from tokens or by estimate, element trees as rows.

Results are parsed in the JVM, as variants, and their fields read as arrays of numbers and strings; lines, boxes, words and
trees are made from these in Arrow batches: Spark interprets nested array lambdas item by item, which took many times
as long. What is no point is skipped, what has less than four is no box.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrays import let

SIDES = ("left", "top", "right", "bottom")
BOX = "left:double,top:double,right:double,bottom:double"
WORDS = f"array<struct<at:int,word:string,{BOX}>>"
CLASSES = ["ocr_page", "ocr_carea", "ocr_par", "ocr_line", "ocrx_word"]
#: Characters that count as white space at the ends of a text.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters and lines whose elements are made at once, as far as pages allow.
CHARS = 400_000
#: Tokens that are merged at once, as far as lines allow.
TOKENS = 200_000


# --- results of the engine


def _items(value: Column) -> Column:
    """A list as an array of variants; anything else is an empty one."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def points(value: Column) -> Column:
    """array<struct<x, y>> of a variant: four plain numbers are a rectangle, else a list of points; bad points are skipped."""
    plain = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def of(items: Column) -> Column:
        x0, y0, x1, y1 = (_number(F.get(items, F.lit(i))) for i in range(4))
        rectangle = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
        listed = F.transform(items, lambda p: point(F.try_variant_get(p, "$[0]", "double"), F.try_variant_get(p, "$[1]", "double")))
        return F.when((F.size(items) == 4) & F.forall(items, plain), rectangle).otherwise(F.filter(listed, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))

    return let(_items(value), of)


def box(corners: Column) -> Column:
    """struct(left, top, right, bottom) around points; its sides are null for less than four points."""
    side = lambda best, c: F.when(F.size(corners) >= 4, best(F.transform(corners, lambda p: p[c])))
    return F.struct(side(F.array_min, "x").alias("left"), side(F.array_min, "y").alias("top"), side(F.array_max, "x").alias("right"), side(F.array_max, "y").alias("bottom"))


def dots_per_inch(value: Column) -> Column:
    """A number, or the mean of the numbers among the first two of a list; else null."""
    numbers = F.filter(F.transform(F.slice(_items(value), 1, 2), lambda v: F.when(F.schema_of_variant(v) != "STRING", _number(v))), lambda v: v.isNotNull())
    mean = lambda z: F.when(F.size(z) > 0, F.aggregate(z, F.lit(0.0), lambda a, x: a + x) / F.size(z))
    alone = F.when(F.schema_of_variant(value) != "STRING", _number(value))
    return F.coalesce(alone, let(numbers, mean))


def _filled(lists: Column, kind: str, depth: int) -> Column:
    """Lists of lists, depth levels of them, with empty ones for null ones: Spark's Arrow writer goes over a run of null lists again for each row."""
    inner = F.transform(lists, lambda x: _filled(x, kind, depth - 1)) if depth > 1 else lists
    return F.coalesce(inner, F.array().cast("array<" * depth + kind + ">" * depth))


def _engine_columns(value: Column) -> list[Column]:
    """What the lines of an engine's page (result.page of a variant) are made of, each field read whole: interpreted lambdas
    over items took most of the time. Regions come as text, as numbers and as points; see _around."""
    field = lambda name, kind: F.try_variant_get(value, f"$.page.{name}", kind)
    given = field("text_word_boxes", "variant")
    boxes = F.when(given.isNull() | F.is_variant_null(given), field("text_word_region", "variant")).otherwise(given)

    def lists(get, kind: str, depth: int) -> Column:  # noqa: ANN001
        return _filled(get("array<" * depth + kind + ">" * depth), kind, depth)

    def points(get, depth: int) -> Column:  # noqa: ANN001
        listed = lambda x, level: F.filter(x, lambda p: p.isNotNull()) if level == 1 else F.transform(x, lambda y: listed(y, level - 1))
        return _filled(listed(get("array<" * (depth + 2) + "double" + ">" * (depth + 2)), depth + 1), "array<double>", depth + 1)

    columns = [lists(lambda k: field("rec_texts", k), "string", 1).alias("texts"), lists(lambda k: field("rec_scores", k), "double", 1).alias("scores"), lists(lambda k: field("text_word", k), "string", 2).alias("tokens")]
    for name, depth, get in (("line", 1, lambda k: field("rec_polys", k)), ("token", 2, lambda k: F.try_variant_get(boxes, "$", k))):
        columns += [lists(get, "string", depth).alias(f"{name}_shown"), lists(get, "double", depth + 1).alias(f"{name}_numbers"), points(get, depth).alias(f"{name}_points")]
    return columns


def _sizes(lists: pa.Array) -> np.ndarray:
    """The lengths of lists; null ones are empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _heads(lists: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The first items of each list, as many as sizes has, list after list; null beyond a list's end."""
    own = _sizes(lists)
    if np.array_equal(own, sizes):
        return lists.flatten()
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(of)) - _firsts(sizes)[of]
    return lists.values.take(pa.array(lists.offsets.to_numpy()[:-1][of] + place, pa.int64(), mask=place >= own[of]))


def _around(shown: pa.Array, numbers: pa.Array, listed: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The sides of the boxes around regions, and which regions have one; as box(points) gives them.

    shown: their JSON, which tells four plain numbers from strings and truth values (numbers beyond the range of doubles
    are written as strings and make no rectangle); numbers: their items as numbers; listed: their items as points.
    """
    n = len(numbers)
    sides, flat, sizes = [np.full(n, np.nan) for _ in SIDES], numbers.flatten(), _sizes(numbers)
    filled = np.bincount(np.repeat(np.arange(n), sizes)[flat.is_valid().to_numpy(zero_copy_only=False)], minlength=n)
    quoted = pc.fill_null(pc.match_substring_regex(shown, '["ul]'), True).to_numpy(zero_copy_only=False)
    plain = (sizes == 4) & (filled == 4) & ~quoted
    at, values = _firsts(sizes)[plain], flat.to_numpy(zero_copy_only=False)
    for i, side in enumerate(sides):
        side[plain] = (np.fmin if i < 2 else np.maximum)(values[at + i % 2], values[at + i % 2 + 2])  # NaN is greater than all
    points = listed.flatten()
    pairs = np.flatnonzero(_sizes(points) >= 2)
    start, given = points.offsets.to_numpy()[:-1][pairs], points.values.is_valid().to_numpy(zero_copy_only=False)
    good = given[start] & given[start + 1]
    of, start = np.repeat(np.arange(n), _sizes(listed))[pairs[good]], start[good]
    count = np.bincount(of, minlength=n)
    values, some = points.values.to_numpy(zero_copy_only=False), np.flatnonzero(count)
    enough = count[some] >= 4
    for i, side in enumerate(sides):
        if len(some):
            side[some[enough]] = (np.fmin if i < 2 else np.maximum).reduceat(values[start + i % 2], _firsts(count)[some])[enough]
    return sides, plain | (count >= 4)


def _engine_lines(batch: pa.RecordBatch) -> pa.Array:
    """The lines of each page, array<struct<text, score, box sides, words>>, null for a page without any.

    Texts, scores and polygons are taken side by side as far as all three go, tokens and their boxes as far as both; lines
    without text or box are left out, a score that is no number is 0.
    """
    c = batch.column
    some = np.minimum(np.minimum(_sizes(c("texts")), _sizes(c("scores"))), _sizes(c("line_shown")))
    heads = lambda name: _heads(c(name), some)
    texts = pc.utf8_trim(pc.fill_null(heads("texts"), ""), characters=WHITE)
    sides, boxed = _around(heads("line_shown"), heads("line_numbers"), heads("line_points"))
    kept = np.flatnonzero(boxed & (pc.binary_length(texts).to_numpy() > 0))
    page = np.repeat(np.arange(batch.num_rows), some)[kept]
    of_kept = lambda name: heads(name).take(pa.array(kept))
    texts, given, shown = texts.take(pa.array(kept)), of_kept("tokens"), of_kept("token_shown")
    count = np.minimum(_sizes(given), _sizes(shown))
    around, placed = _around(_heads(shown, count), _heads(of_kept("token_numbers"), count), _heads(of_kept("token_points"), count))
    token = pa.StructArray.from_arrays([_heads(given, count), *(pa.array(s, mask=~placed) for s in around)], names=["token", *SIDES])
    offsets = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    words = _line_words(texts, pa.ListArray.from_arrays(offsets(count), token, mask=pa.array(count == 0)))
    lines = pa.StructArray.from_arrays([texts, pc.fill_null(of_kept("scores"), 0.0), *(pa.array(s[kept]) for s in sides), words], names=["text", "score", *SIDES, "words"])
    return pa.ListArray.from_arrays(offsets(np.bincount(page, minlength=batch.num_rows)), lines, mask=pa.array(some == 0))


def read_pages(raws: DataFrame, key: list[str], raw_col: str = "raw") -> DataFrame:
    """key, page_number, width, height, dpi, text, lines and error of every page.

    raw: JSON with width, height, dpi, text, page_number and page, the engine's result. lines: array<struct<text, score,
    box sides, words>>, what element_rows takes. Sizes that are not above 0 make an error and no lines.
    """
    v = F.col("variant_")
    number = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    sized = (number("width", "double") > 0) & (number("height", "double") > 0)
    error = F.when(v.isNull(), "no_json").when(~F.coalesce(sized, F.lit(False)), "page_size")
    parsed = raws.select(*key, F.try_parse_json(raw_col).alias("variant_")).withColumn("error", error)
    kept = [*key, "page_number", "width", "height", "dpi", "text", "error"]
    plain = [number("page_number", "int").alias("page_number"), *(number(s, "double").alias(s) for s in ("width", "height")), dots_per_inch(F.try_variant_get(v, "$.dpi", "variant")).alias("dpi"), number("text", "string").alias("text")]
    sound = F.when(F.col("error").isNull(), v)  # pages with an error have no lines
    rows = parsed.select(*key, *plain, "error", sound.alias("variant_")).select(*kept, *_engine_columns(v))
    line = f"struct<text:string,score:double,{BOX},words:array<struct<text:string,{BOX}>>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept) + f", lines array<{line}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tokens = batch.column("texts").offsets.to_numpy(), batch.column("tokens")
            block = (texts + tokens.values.offsets.to_numpy()[tokens.offsets.to_numpy()])[1:] // TOKENS
            starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for start, end in zip(starts, starts[1:]):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), _engine_lines(part)], names=[*kept, "lines"])

    names = [*key, "page_number", "width", "height", "dpi", "text", "lines", "error"]
    return rows.mapInArrow(run, schema).select(*names)


# --- words from tokens


def _words(tokens: pa.Array) -> pa.Array:
    """Runs of tokens that aren't white space, list by list: place, text and box of each. Lists are taken in blocks, as the work needs several times their room."""
    block = tokens.offsets.to_numpy()[1:] // TOKENS if len(tokens) else np.zeros(0)
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(tokens)]
    return pa.concat_arrays([_block_words(tokens.slice(a, b - a)) for a, b in zip(starts, starts[1:])])


def _block_words(tokens: pa.Array) -> pa.Array:
    sizes = np.diff(tokens.offsets.to_numpy())
    sizes[tokens.is_null().to_numpy(zero_copy_only=False)] = 0
    flat = tokens.flatten()
    codes = flat.field("token").fill_null("").dictionary_encode()
    kinds = np.array([2 if s.isspace() else 1 if s else 0 for s in codes.dictionary.to_pylist()] or [0], np.int8)
    kind = kinds[codes.indices.to_numpy()] if len(flat) else np.zeros(0, np.int8)
    row = np.repeat(np.arange(len(tokens)), sizes)
    there = np.flatnonzero(kind)  # empty tokens count nowhere
    row, kind = row[there], kind[there]
    place = np.arange(len(there)) - np.searchsorted(row, row)
    solid = kind == 1
    opens = solid.copy()
    opens[1:] &= ~(solid[:-1] & (row[1:] == row[:-1]))
    run = np.cumsum(opens)
    sides = [flat.field(s).to_numpy(zero_copy_only=False)[there] for s in SIDES]
    good = np.flatnonzero(solid & ~np.any([np.isnan(s) for s in sides], axis=0))  # bad boxes end no word
    first = np.flatnonzero(np.diff(run[good], prepend=-1)) if len(good) else np.zeros(0, np.int64)
    texts = flat.field("token").take(pa.array(there[good])).cast(pa.large_string())
    ends = np.append(first, len(good))
    _, offsets, data = texts.buffers() if len(texts) else (None, None, None)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1][ends] if len(texts) else np.zeros(1, np.int64)
    joined = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.ascontiguousarray(at)), data or pa.py_buffer(b"")).cast(pa.string())
    fold = lambda best, s: best.reduceat(s[good], first) if len(first) else np.zeros(0)
    boxes = [fold(best, s) for best, s in zip((np.minimum, np.minimum, np.maximum, np.maximum), sides, strict=True)]
    words = pa.StructArray.from_arrays([pa.array(place[good[first]].astype(np.int32)), joined, *(pa.array(b) for b in boxes)], names=["at", "word", *SIDES])
    per_row = np.bincount(row[good[first]], minlength=len(tokens))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), words, mask=tokens.is_null())
    return lists


def merge_tokens(tokens: Column) -> Column:
    """The words of a line: runs of tokens that aren't white space, each with its place and the box around it.

    tokens: array<struct<token, left, top, right, bottom>> in order (null sides: a bad box, whose token is left out
    without ending the word; a word of such tokens only is left out). The result is an array of structs at (the
    first token's index among the tokens that aren't empty), word, left, top, right, bottom; null for null.
    """
    return F.arrow_udf(_words, WORDS)(tokens)


def _line_words(lines: pa.Array, tokens: pa.Array) -> pa.Array:
    """For each line the words of its tokens, under the line's own spelling where their number agrees; null for null tokens."""
    words = _words(tokens)
    n = np.diff(words.offsets.to_numpy())
    texts = words.values.field("word").to_pylist()
    at = words.offsets.to_pylist()
    for k, line in enumerate(lines.to_pylist()):
        own = (line or "").split() if n[k] else []
        if n[k] and len(own) == n[k]:
            texts[at[k] : at[k + 1]] = own
    named = pa.StructArray.from_arrays([pa.array(texts, pa.string()), *(words.values.field(s) for s in SIDES)], names=["text", *SIDES])
    return pa.ListArray.from_arrays(words.offsets, named, mask=words.is_null())


# --- element trees


def estimated(line: str, left: float, right: float) -> list[tuple[str, float, float]]:
    """The words of a line with left and right edge: they share its width by their length, at least 1 each; the last ends at the right edge."""
    words = line.split()
    if not words:
        return []
    total, width = sum(map(len, words)), max(1.0, right - left)
    edges = [min(right, e) for e in accumulate((max(1.0, width * len(w) / total) for w in words[:-1]), initial=left)]
    return list(zip(words, edges, [*edges[1:], right], strict=True))


def _left_edges(sizes: np.ndarray, lengths: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The left edges that estimated gives, for many lines at once. sizes: words of each line, in order; lengths: of all words.

    Lines of about as many words make a matrix, so that each is summed up word by word as there.
    """
    line = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(line)) - first[line]
    total = np.maximum(1, np.bincount(line, lengths, len(sizes)))
    share = np.fmax(1.0, np.fmax(1.0, right - left)[line] * lengths / total[line])
    steps = np.append(0.0, share[:-1])
    steps[place == 0] = left[line[place == 0]]
    edges = np.empty(len(line))
    kind = np.ceil(np.log2(np.maximum(1, sizes))).astype(np.int64)
    for k in np.unique(kind[sizes > 0]).tolist():
        of = np.flatnonzero(kind[line] == k)
        rows, row = np.unique(line[of], return_inverse=True)
        table = np.zeros((len(rows), 1 << k))
        table[row, place[of]] = steps[of]
        edges[of] = np.cumsum(table, axis=1)[row, place[of]]
    return np.fmin(right[line], edges)


def _elements(batch: pa.RecordBatch) -> list[pa.Array]:
    """The columns of element_rows after the key, before them each row's page."""
    numbers = lambda a: a.to_numpy(zero_copy_only=False).astype(float)
    floats = lambda a: pa.array(a, pa.float64(), from_pandas=True)
    width, height = numbers(batch.column("width")), numbers(batch.column("height"))
    column = batch.column("lines")
    page = np.repeat(np.arange(batch.num_rows), np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy())))
    flat = column.flatten()
    number = np.arange(len(page)) - np.searchsorted(page, page)
    sized = (width > 0) & (height > 0)
    there = sized[page] & flat.field("left").is_valid().to_numpy(zero_copy_only=False)
    given = flat.field("words")
    spans = given.offsets.to_numpy() if len(given) else np.zeros(1, np.int64)
    own = given.values.slice(spans[0], spans[-1] - spans[0])  # values are those of the whole batch
    spans, texts, valid = (spans - spans[0]).tolist(), own.field("text").to_pylist(), own.is_valid().to_pylist()
    boxes_of = [own.field(c).to_pylist() for c in SIDES]
    kept, sizes, words, found = [], [], [], []  # found: words with boxes of their own, by their number
    for k, (line, some, good) in enumerate(zip(flat.field("text").to_pylist(), given.is_valid().to_pylist(), there.tolist(), strict=True)):
        line = (line or "").strip()
        if not line or not good:
            continue
        kept.append(k)
        if some and spans[k] < spans[k + 1]:
            placed = [j for j in range(spans[k], spans[k + 1]) if valid[j] and (texts[j] or "").strip() and boxes_of[0][j] is not None]
            found += [(len(words) + i, *(b[j] for b in boxes_of)) for i, j in enumerate(placed)] or [(len(words), *(flat.field(c)[k].as_py() for c in SIDES))]
            fresh = [texts[j].strip() for j in placed] or [line]
        else:
            fresh = line.split()
        sizes.append(len(fresh))
        words += fresh
    kept, sizes = np.array(kept, np.int64), np.array(sizes, np.int64)
    line = np.repeat(np.arange(len(kept)), sizes)
    place = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[line]
    left, top, right, bottom = (numbers(flat.field(c))[kept] for c in SIDES)
    edges = _left_edges(sizes, np.fromiter(map(len, words), np.int64, len(words)), left, right)
    ends = np.where(place == sizes[line] - 1, right[line], np.append(edges[1:], 0.0)) if len(words) else edges
    sides = [edges, top[line], ends, bottom[line]]
    if found:
        at, *own_sides = zip(*found, strict=True)
        for side, values in zip(sides, own_sides, strict=True):
            side[list(at)] = np.array(values, float)
    # A page's row, then for each line three rows and its words.
    on = page[kept]
    per_page = sized + np.bincount(on, sizes + 3, batch.num_rows).astype(np.int64)
    page_at = np.cumsum(per_page) - per_page
    rank = np.cumsum(sizes + 3) - (sizes + 3)
    line_at = page_at[on] + 1 + rank - rank[np.searchsorted(on, on)] if len(kept) else rank
    word_at = line_at[line] + 3 + place
    n, own_page = int(per_page.sum()), np.flatnonzero(sized)

    def spread(values_page, values_line, values_word, kind):  # noqa: ANN001, ANN202  None: null in these rows
        out, null = np.zeros(n, kind), np.ones(n, bool)
        for at, values in ((page_at[own_page], values_page), *((line_at + i, values_line) for i in range(3)), (word_at, values_word)):
            if values is not None:
                out[at], null[at] = values, False
        return out, null

    class_of = spread(0, None, 4, np.int8)[0]
    for i in range(3):
        class_of[line_at + i] = i + 1
    score = np.fmax(0.0, np.fmin(1.0, numbers(pc.fill_null(flat.field("score"), 0.0))[kept]))
    at, no_word = spread(None, None, np.arange(len(words)), np.int64)
    first_row, no_page = spread(own_page, None, None, np.int64)
    of_page = pa.array(first_row, mask=no_page)
    masked = lambda pair, kind: pa.array(pair[0], kind, mask=pair[1])
    return [
        pa.array(np.repeat(np.arange(batch.num_rows), per_page)),
        masked(spread(None, number[kept], number[kept][line], np.int32), pa.int32()),
        masked(spread(None, None, place, np.int32), pa.int32()),
        pa.array(CLASSES).take(pa.array(class_of)),
        pa.array(words, pa.string()).take(pa.array(at, mask=no_word)),
        masked(spread(None, score, score[line], float), pa.float64()),
        *(floats(spread(a, b, c, float)[0]) for a, b, c in zip((0.0, 0.0, width[own_page], height[own_page]), (left, top, right, bottom), sides, strict=True)),
        batch.column("dpi").take(of_page),
        batch.column("page_number").take(of_page),
    ]


def element_rows(pages: DataFrame, key: list[str]) -> DataFrame:
    """The element tree of each page as rows: key, line_no (null for the page), word_no (null above words), ocr_class, text,
    confidence, the box left, top, right, bottom, and for the page dpi and page_number.

    pages: key, width, height, dpi, page_number and lines, array<struct<text, score, left, top, right, bottom, words>>
    with words, array<struct<text, left, top, right, bottom>>. The page's box is its size; a page without a size above
    0 has no elements. Lines without text or box make none. An area, a paragraph and a line have the line's box. Given
    words count if they have text and box; a line without given words gets estimated ones, and one whose words
    all fail is one word.
    """
    kinds = [f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key]
    schema = ", ".join([*kinds, "line_no int, word_no int, ocr_class string, text string, confidence double, left double, top double, right double, bottom double, dpi double, page_number int"])
    names = ["line_no", "word_no", "ocr_class", "text", "confidence", *SIDES, "dpi", "page_number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("lines")
            chars = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column.flatten().field("text")), 0).to_numpy(zero_copy_only=False)))
            last = np.cumsum(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy())))
            cuts = np.append(-1, (chars[last] + last) // CHARS)
            starts = [*np.flatnonzero(np.diff(cuts)).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                out = _elements(batch.slice(start, end - start))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, end - start).take(out[0]) for k in key), *out[1:]], names=[*key, *names])

    return pages.select(*key, "width", "height", "dpi", "page_number", "lines").mapInArrow(run, schema)


def estimate_boxes(lines: DataFrame, key: list[str], line_col: str, left: str = "left", right: str = "right") -> DataFrame:
    """key, at, word, left and right of the words of each line, by estimate."""
    edges = "array<struct<at:int,word:string,left:double,right:double>>"

    def run(texts: pa.Array, x0: pa.Array, x1: pa.Array) -> pa.Array:
        rows = [[{"at": i, "word": w, "left": a, "right": b} for i, (w, a, b) in enumerate(estimated(t or "", u, v))] for t, u, v in zip(texts.to_pylist(), x0.to_pylist(), x1.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string()), ("left", pa.float64()), ("right", pa.float64())])))

    words = F.arrow_udf(run, edges)(F.col(line_col), F.col(left).cast("double"), F.col(right).cast("double"))
    return lines.select(*key, F.inline(words))
