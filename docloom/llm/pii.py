"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame expressions. Each pattern marks its leftmost non-overlapping matches once; the parts between
the marks give the code-point offsets, summed up in blocks so that the time grows with the text and not with the
square of its matches. Digit patterns use possessive loops, so that digit runs of any length neither recurse nor
backtrack. Words within CONTEXT_CHARS before or after a span raise its score.

Nulls and edge cases: a null text counts as empty and has no spans; repeated rows are judged row by row; an
empty table gives an empty result; `redact` carries all further columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrays import let, sums_before

#: Marks around a match; texts that hold one get another control character of the same length first.
_MARK, _OTHER = "\x01", "\x03"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")

_PATTERNS = {
    # A local part starts at the start of its run or where the last match ended.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])",
}
#: Cheap tests that a text with a match passes.
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "secret": lambda t: t.rlike(r"[A-Fa-f0-9]{32}"),
}


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN whose letters count 10 to 35 and whose first four characters go last."""
    plain = F.translate(text, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: (r * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _n_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


_CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda m: _n_digits(m).between(12, 19) & F.call_function("luhn_check", F.translate(m, " -", "")),
    "phone": lambda m: _n_digits(m).between(9, 15),
    "iban": lambda m: F.length(F.translate(m, " ", "")).between(15, 34) & (_mod97(m) == 1),
    "secret": lambda m: F.lit(True),
}
#: Score without context, and the words that raise it by CONTEXT_BONUS, as whole words near the span.
_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.3}
_CONTEXT = {
    "email": "e?mails?|contact|write|adress|address|correo|courriel",
    "ip": "ip|ipv4|host|server|address|client|login",
    "card": "cards?|visa|mastercard|credit|payment|karte|kreditkarte|tarjeta|carte",
    "phone": "phone|telephone|call|tel|mobile|fax|anruf|telefon|teléfono|téléphone",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "secret": "token|secret|key|apikey|password|passwd|auth",
}
CONTEXT_BONUS, CONTEXT_CHARS = 0.3, 40
#: A span of a kind outside BASE_KINDS counts from this score, and a span of any kind as likely from LIKELY.
MIN_SCORE, LIKELY = 0.5, 0.8

_SPAN = "struct<start:int,kind:int,end:int,score:double>"


def _parts(text: Column, kind: str) -> Column:
    """What lies before the first match, the match, what lies before the next one, and so on; text holds no mark."""
    return F.split(F.regexp_replace(text, _PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK, -1)


def _score(parts: Column, i: Column, kind: str) -> Column:
    before, after = F.right(F.get(parts, i - 1), F.lit(CONTEXT_CHARS)), F.left(F.get(parts, i + 1), F.lit(CONTEXT_CHARS))
    near = F.lower(F.concat_ws(" ", before, after)).rlike(rf"(?<!\p{{L}})(?:{_CONTEXT[kind]})(?!\p{{L}})")
    return F.least(F.lit(1.0), F.round(F.lit(_SCORES[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0), 3))


def _spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order."""
    n = KINDS.index(kind)

    def spans(parts: Column) -> Column:
        starts = sums_before(F.transform(parts, lambda p: F.length(p)), F.lit(0))

        def one(part: Column, start: Column, i: Column) -> Column:
            span = F.struct(start.alias("start"), F.lit(n).alias("kind"), (start + F.length(part)).alias("end"), _score(parts, i, kind).alias("score"))
            return F.when((i % 2 == 1) & _CONFIRM[kind](part), span)

        found = let(starts, lambda at: F.transform(parts, lambda p, i: one(p, F.get(at, i), i)))
        return F.filter(found, lambda s: s.isNotNull() & (F.lit(kind in BASE_KINDS) | (s["score"] >= MIN_SCORE)))

    return F.when(_MAY[kind](text), let(_parts(text, kind), spans)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def pii_spans(text: Column) -> Column:
    """All spans of a text by start, then kind: array<struct<start, kind, end, score>>; kind is an index into KINDS."""
    clean = F.coalesce(text, F.lit(""))
    clean = F.when(F.contains(clean, F.lit(_MARK)), F.translate(clean, _MARK, _OTHER)).otherwise(clean)
    return let(clean, lambda t: F.array_sort(F.concat(*(_spans_of(t, k) for k in KINDS))))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text, the highest score and the number of likely spans of every text."""
    found = docs.select(F.col(id_col), pii_spans(F.col(text_col)).alias("found_"))
    spans = F.col("found_")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(k))).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE_KINDS))
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in KINDS[len(BASE_KINDS) :]),
        F.array_max(F.transform(spans, lambda s: s["score"])).alias("max_score"),
        F.size(F.filter(spans, lambda s: s["score"] >= LIKELY)).cast("long").alias("n_likely"),
    )


def redact(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs with every span of min_score or more replaced by its kind in brackets; a null text stays null.

    Kinds are replaced one after the other, in the order of KINDS: each is sought in what the ones before left.
    """

    def without(text: Column, kind: str) -> Column:
        def replaced(parts: Column) -> Column:
            gone = lambda p, i: (i % 2 == 1) & _CONFIRM[kind](p) & (_score(parts, i, kind) >= min_score)
            return F.array_join(F.transform(parts, lambda p, i: F.when(gone(p, i), f"[{kind.upper()}]").otherwise(p)), "")

        return let(text, lambda t: F.when(_MAY[kind](t), let(_parts(t, kind), replaced)).otherwise(t))

    text = F.col(f"`{text_col}`")
    # The mark is spelled otherwise meanwhile, by characters that no pattern holds.
    spelled = [(_OTHER, _OTHER + "\x04"), (_MARK, _OTHER + "\x05")]
    marked = F.contains(text, F.lit(_MARK))
    new = text
    for a, b in spelled:
        new = F.replace(new, F.lit(a), F.lit(b))
    new = F.when(marked, new).otherwise(text)
    for kind in KINDS:
        new = without(new, kind)
    back = lambda t: F.replace(F.replace(t, F.lit(spelled[1][1]), F.lit(spelled[1][0])), F.lit(spelled[0][1]), F.lit(spelled[0][0]))
    new = let(new, lambda t: F.when(marked, back(t)).otherwise(t))
    return docs.select(*(new.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns))
