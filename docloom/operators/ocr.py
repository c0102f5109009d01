"""OCR: rectangles, page texts and sizes, languages, errors. What an engine returns is read in geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text

#: Language codes and what they stand for. Fixed values.
LANGUAGES = {
    "de": "de", "deu": "de", "ger": "de",
    "en": "en", "eng": "en",
    "it": "it", "ita": "it",
    "fr": "fr", "fra": "fr", "fre": "fr",
    "es": "es", "spa": "es",
    "pt": "pt", "por": "pt",
    "nl": "nl", "nld": "nl", "dut": "nl",
}
#: Parts of error texts that mean the failure may pass. Fixed values.
TRANSIENT = ("out of memory", "memoryerror", "cannot allocate memory", "failed to allocate", "std::bad_alloc", "bad allocation")


#: Patterns of error texts and the area that they point to, after memory. Fixed values.
ADVICE = {
    "language": "ocr_language_mismatch|language mismatch",
    "token": "unauthorized|401|403",
    "reachability": "connection refused|failed to establish|service unavailable|connectionerror|name or service not known|temporary failure in name resolution",
}


def polygon(rect: Column) -> Column:
    """Four numbers (left, top, right, bottom) as four corners."""
    x0, y0, x1, y1 = (rect[i].cast("double") for i in range(4))
    return F.when(F.size(rect) == 4, F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)))


def bounds(poly: Column) -> Column:
    """struct(left, top, right, bottom) around the points."""
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def prefer_line_words(words: Column, line: Column) -> Column:
    """The line's own words in place of token texts where their number agrees."""
    own = F.filter(F.split(text.collapse(line), " "), lambda w: w != "")
    return F.when(F.size(own) == F.size(words), own).otherwise(words)


#: Model names by profile: detection and recognition. Fixed values.
PROFILES = {
    "medium": ("PP-OCRv6_medium_det", "PP-OCRv6_medium_rec"),
    "small": ("PP-OCRv6_small_det", "PP-OCRv6_small_rec"),
    "tiny": ("PP-OCRv6_tiny_det", "PP-OCRv6_tiny_rec"),
}


def profile_models(profile: Column) -> Column:
    """struct(detection, recognition, error) of a profile; an unknown one has an error."""
    known = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, models in PROFILES.items() for x in (name, models[k]))), profile)
    return F.struct(known(0).alias("detection"), known(1).alias("recognition"), F.when(known(0).isNull(), "unknown_profile").alias("error"))


def page_text(lines: Column, own: Column | None = None) -> Column:
    """The page's own text if it has one, else its stripped lines that aren't empty, one below the other."""
    joined = F.array_join(F.filter(F.transform(lines, text.strip), lambda t: t != ""), "\n")
    return joined if own is None else F.when(F.length(text.strip(F.coalesce(own, F.lit("")))) > 0, text.strip(own)).otherwise(joined)


def source_name(path: Column, most: int = 300) -> Column:
    """The last part of a path, clipped."""
    return F.substring(F.element_at(F.split(path, "/"), -1), 1, most)


def downsampled(width: Column, height: Column, dpi: Column, limit: int) -> Column:
    """struct(width, height, dpi_x, dpi_y) of an image whose longer side must not exceed limit; whole numbers are cut, not rounded."""
    longest = F.greatest(width, height)
    w, h = (F.greatest(F.lit(1), F.floor(x * limit / longest)).cast("int") for x in (width, height))
    scaled = lambda new, old: F.floor(dpi * new / old).cast("int")
    fits = longest <= limit
    return F.struct(F.when(fits, width).otherwise(w).alias("width"), F.when(fits, height).otherwise(h).alias("height"), F.when(fits, dpi).otherwise(scaled(w, width)).alias("dpi_x"), F.when(fits, dpi).otherwise(scaled(h, height)).alias("dpi_y"))


def language(code: Column) -> Column:
    short = F.substring_index(F.replace(F.lower(text.strip(code)), F.lit("_"), F.lit("-")), "-", 1)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(known, short), short)


def language_matches(requested: Column, configured: Column) -> Column:
    """Whether the configured language is among the requested ones; no request matches all."""
    wanted = F.transform(F.filter(F.split(requested, ","), lambda x: text.strip(x) != ""), language)
    return (text.strip(requested) == "") | F.array_contains(wanted, language(configured))


def is_transient(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    out = F.lit(False)
    for part in TRANSIENT:
        out = out | F.contains(low, F.lit(part))
    return out


def advice(error: Column) -> Column:
    """The area that an error text points to; the first that fits."""
    low = F.lower(F.coalesce(error, F.lit("")))
    area = F.when(is_transient(error) | F.contains(low, F.lit("bad_alloc")), "memory")
    for name, pattern in ADVICE.items():
        area = area.when(low.rlike(pattern), name)
    return area.otherwise("")
