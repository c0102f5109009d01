"""Text normalisation as column expressions, with exact Arrow variants where the JVM's rules differ."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that the weak signature covers, and characters that the strong one covers.
SIGNATURE_WORDS, PROMPT_CHARS = 96, 4000
_WORD = r"[\p{L}\p{N}_]"
#: Every character that counts as white space when text is stripped or split.
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def fold_case(text: Column) -> Column:
    """Lower case with ß as ss: equal to full case folding on text without rarer special letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_words(text: Column) -> Column:
    """The words of a text, case folded and joined by one blank; null counts as empty."""
    return F.array_join(F.regexp_extract_all(fold_case(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD}+)"), 1), " ")


def word_prefix(text: Column, words: int = SIGNATURE_WORDS) -> Column:
    """The first words of the normalised text; only the part of the text that holds them is normalised."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), rf"^(?:(?!{_WORD}).)*+(?:{_WORD}++(?:(?!{_WORD}).)*+){{0,{words}}}".replace("(?!" + _WORD + ").", r"[^\p{L}\p{N}_]"), 0)
    return F.array_join(F.slice(F.split(normalize_words(head), " "), 1, words), " ")


def content_signature(text: Column) -> Column:
    """Weak signature: the digest of the first 96 normalised words."""
    return F.sha2(word_prefix(text), 256)


def prompt_content_signature(text: Column) -> Column:
    """Strong signature: the digest of the normalised first 4000 characters; they are cut before normalising."""
    return F.sha2(normalize_words(F.substring(text, 1, PROMPT_CHARS)), 256)


def document_signature(filename: Column, text: Column) -> Column:
    """Signature of older records: file name and word prefix."""
    return F.sha2(F.concat(normalize_words(filename), F.lit("\0"), word_prefix(text)), 256)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def collapse(text: Column) -> Column:
    """White-space runs become one blank, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " "))


def name_key(name: Column) -> Column:
    """Key under which names are equal: white space collapsed, case folded; punctuation stays."""
    return fold_case(collapse(name))


@F.pandas_udf(StringType())
def normalize_words_exact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As normalize_words, with compatibility normalisation and full case folding."""
    for texts in parts:
        yield texts.map(lambda t: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold())))


@F.pandas_udf(StringType())
def name_key_exact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As name_key, with full case folding."""
    for names in parts:
        yield names.map(lambda n: " ".join((n or "").split()).casefold())
