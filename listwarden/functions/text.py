"""String building blocks as Column expressions (all JVM-side unless said otherwise)."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from listwarden.functions.trie import longest_word, overlaps_itself

#: Every character that counts as white space at the ends of a value.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
#: A character that continues a word (letters and digits of any script, underscore).
WORD = r"[\p{L}\p{N}_]"

#: At most so many words are searched one by one.
FEW_WORDS = 24

# Words that only say what kind of legal entity a business is.
LEGAL_WORDS = ("llc", "inc", "co", "corp", "ltd", "company", "companies", "group",
               "services", "solutions", "associates")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def clean_cell(value: Column) -> Column:
    """A cell as rules see it: text, never null, no surrounding white space."""
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def whole_word(pattern: str) -> str:
    """``pattern`` bounded on both sides by something that is not a word character."""
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words, first listed wins at a position; '' if none."""
    return "|".join(re.escape(word) for word in words)


def normalize_text(value: Column, full_nfkd: bool = False) -> Column:
    """Lower-case words separated by single spaces; accents split their word.

    Compatibility decomposition is done with built-in functions. With ``full_nfkd`` an
    Arrow UDF does it instead, with the tables of Python in place of those built in here.
    """
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    text = decompose_arrow(text) if full_nfkd else decompose(text)
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def decompose(text: Column) -> Column:
    """Base characters, each followed by a blank where an accent was split off."""
    accented, plain_from, plain_to, several, _ = _decompositions()
    is_ascii = F.octet_length(text) == F.length(text)
    expanded = F.when(text.rlike(rf"[{several}\x{{ac00}}-\x{{d7a3}}]"), _expand(text)).otherwise(text)
    # The look-ahead spares ASCII characters the walk through all ranges.
    spread = F.regexp_replace(expanded, rf"(?=[^\x00-\x7F])([{accented}])", "$1 ")
    return F.when(is_ascii, text).otherwise(F.translate(spread, plain_from, plain_to))


def _expand(text: Column) -> Column:
    """Characters that stand for several base characters, and Hangul syllables, spelled out."""
    _, _, _, several, spelled = _decompositions()
    table = F.str_to_map(F.lit(spelled), F.lit("\x02"), F.lit("\x01"))
    # First letters, vowels and last letters of syllables, in code order.
    leads, vowels, tails = ("".join(map(chr, range(low, low + n))) for low, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def pick(letters: str, place: Column) -> Column:
        return F.substr(F.lit(letters), place.cast("int"), F.lit(1))

    def one(c: Column) -> Column:
        number = F.ascii(c) - 0xAC00
        tail = F.when(number % 28 > 0, pick(tails, number % 28)).otherwise(F.lit(""))
        syllable = F.concat(
            pick(leads, F.floor(number / 588) + 1), pick(vowels, F.floor(number % 588 / 28) + 1), tail)
        return F.when(c.between("\uac00", "\ud7a3"), syllable).when(
            c.rlike(f"[{several}]"), F.try_element_at(table, c)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


@cache
def _decompositions() -> tuple[str, str, str, str, str]:
    """Regex class of characters with accents, their one-to-one base mapping (two strings),
    regex class of characters with several bases, and those as key, \\x01, value, \\x02, ..."""
    accented, plain_from, plain_to, several, spelled = [], [], [], [], []
    for code in range(0xA0, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFKD", chr(code))
        if parts == chr(code) or 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        base, rest = parts[0], parts[1:]
        if all(unicodedata.category(mark).startswith("M") for mark in rest):
            plain_from.append(chr(code))
            plain_to.append(base)
            if rest:
                accented.append(code)
        else:
            several.append(code)
            spelled.append(f"{chr(code)}\x01{parts}")
    return _ranges(accented), "".join(plain_from), "".join(plain_to), _ranges(several), "\x02".join(spelled)


def _ranges(codes: list[int]) -> str:
    out: list[str] = []
    start = previous = None
    for code in [*codes, None]:
        if previous is not None and code == previous + 1:
            previous = code
            continue
        if start is not None:
            out.append(rf"\x{{{start:x}}}-\x{{{previous:x}}}")
        start = previous = code
    return "".join(out)


@F.pandas_udf(StringType())
def decompose_arrow(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD")


def strip_legal_words(name: Column) -> Column:
    """Drop legal-entity words; a gap they leave inside the name stays."""
    return F.trim(F.regexp_replace(name, whole_word("|".join(LEGAL_WORDS)), ""))


def name_key(name: Column, full_nfkd: bool = False) -> Column:
    """Business name reduced to what near-duplicates are judged by."""
    return strip_legal_words(normalize_text(name, full_nfkd))


def count_substring(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty ``part``."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.floor(removed / F.nullif(F.length(part), F.lit(0))).cast("int")


def repeated_words(text: Column, words: Sequence[str], times: int) -> Column:
    """Those of some words, in their order, that occur so often without overlapping themselves.

    Few words are searched one by one in the bytes of the text, as far as the place that decides.
    Of many words, one pass over the text finds the longest at each place; shorter ones that it
    begins with occur there as well. Only words that can overlap themselves are counted once more,
    and only where they have enough places.
    """
    if not words:
        return F.array().cast("array<string>")
    if len(words) <= FEW_WORDS:
        return F.array_compact(F.array(*[
            F.when(_occurs(text, word, times), F.lit(word)) for word in words]))
    firsts = "".join(sorted({re.escape(word[0]) for word in words}))
    # the first character alone is taken, and the word looked at from before it
    at_words = f"[{firsts}](?<=(?=({longest_word(words)}))[{firsts}])"
    places = F.regexp_extract_all(text, F.lit(at_words), F.lit(1))
    overlapping = [word for word in words if overlaps_itself(word)]

    def chosen(runs: Column) -> Column:
        def often(word: Column) -> Column:
            count = F.aggregate(runs, F.lit(0), lambda sum_, run: sum_ + F.when(
                F.startswith(run["value"], word), run["n"]).otherwise(0))
            enough = count >= times
            if overlapping:
                enough &= ~word.isin(overlapping) | (count_substring(text, word) >= times)
            return enough
        return F.filter(F.array(*[F.lit(word) for word in words]), often)

    return let(run_lengths(places), chosen)


def _occurs(text: Column, word: str, times: int) -> Column:
    """Whether a text has a word so often, overlaps not counted."""
    if overlaps_itself(word):
        often = count_substring(text, F.lit(word)) >= times
    else:  # all of the text stands before an occurrence that is missing
        before = F.substring_index(text, word, times)
        often = F.octet_length(before) < F.octet_length(text)
    return F.contains(text, F.lit(word)) & often


def run_lengths(values: Column) -> Column:
    """How often each value of an array occurs: structs of value and n, in order of the values."""
    def runs(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda value, at: F.when(
            (at == 0) | (value != F.get(ordered, at - 1)),
            F.struct(value.alias("value"), at.alias("at"))))
        return let(F.filter(marked, lambda start: start.isNotNull()), lambda starts: F.transform(
            starts, lambda start, at: F.struct(
                start["value"].alias("value"),
                (F.coalesce(F.get(starts, at + 1)["at"], F.size(ordered)) - start["at"]).alias("n"))))

    return let(F.sort_array(values), runs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when used inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(value: Column) -> Column:
    """``'text'`` in quotes, double ones only if the text has an apostrophe."""
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(escape))
    apostrophe, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    single_quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(
        apostrophe & ~double, F.concat(F.lit('"'), text, F.lit('"'))
    ).otherwise(single_quoted)


def list_text(values: Column) -> Column:
    """``['a', 'b']``"""
    return F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))


def join_nonempty(separator: str, *parts: Column) -> Column:
    """Parts joined in order, skipping nulls and empty strings."""
    return F.concat_ws(separator, *[F.nullif(part, F.lit("")) for part in parts])
