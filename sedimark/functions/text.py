"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense, as the inside of a character class.
SPACE = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def _accented() -> dict[str, str]:
    """Letters of the Latin blocks that canonical decomposition splits into one letter and marks, and that letter."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all("\u0300" <= m <= "\u036f" for m in marks):
            out[chr(code)] = base
    return out


ACCENTED, PLAIN = map("".join, zip(*_accented().items(), strict=True))


def fold(text: Column) -> Column:
    """Lower case without accents; ligatures stay. Text of as many bytes as characters has none."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(_fold(text))


def _fold(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[\\u0300-\\u036f]", ""))


def flat(text: Column) -> Column:
    """Folded, without white space."""
    return F.regexp_replace(fold(text), "\\s+", "")


def compact(text: Column) -> Column:
    """Folded, a-z and 0-9 only."""
    return F.regexp_replace(fold(text), "[^a-z0-9]", "")


def brand_words(text: Column) -> Column:
    """Folded words; a possessive s is glued to its word."""
    glued = F.regexp_replace(fold(text), "(\\p{L})['\\u2019]s(?!\\p{L})", "$1s")
    return F.filter(F.split(glued, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}]", ""))


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def erratic_case(text: Column) -> Column:
    """A run of letters goes from lower to upper case more than once."""
    return text.rlike("\\p{Ll}\\p{Lu}\\p{L}*\\p{Ll}\\p{Lu}")


def nameable(text: Column) -> Column:
    """Fit to be a merchant's name: enough letters, few digits, no markup, orderly case."""
    return (letters(text) >= 3) & (digits(text) <= 6) & (letters(text) > digits(text)) & ~text.rlike("[<>]|=\"") & ~erratic_case(text)


# Kinds of street after a civic number, folded.
STREET_WORDS = ["rue", "av", "ave", "avenue", "boul", "bd", "blvd", "boulevard", "ch", "chem", "chemin", "rang", "route", "rte", "montee", "cote", "place", "pl", "promenade"]
POSTAL_CODE = f"\\b[a-z]\\d[a-z][{SPACE}]?\\d[a-z]\\d\\b"
_PROVINCE = f"(?:^|[{SPACE},])qc(?:[{SPACE},.]|$)"
_CIVIC = f"^\\d+[a-z]?[{SPACE},]+(?:[^{SPACE}]+[{SPACE}]+)?(?:{'|'.join(STREET_WORDS)})\\b"


def address(text: Column) -> Column:
    """Postal code, province alone, or, at the beginning, a civic number, at most one word and a kind of street."""
    return fold(text).rlike(f"{POSTAL_CODE}|{_PROVINCE}|{_CIVIC}")


def field_label(text: Column) -> Column:
    """Begins with a short label and a colon."""
    return text.rlike(f"^[\\p{{L}}{SPACE}.']{{1,24}}:")


# Sites of payment, delivery and social media, which name no shop.
PLATFORMS = ["clover", "square", "squareup", "moneris", "paypal", "facebook", "instagram", "google", "uber", "ubereats", "doordash", "skipthedishes", "tripadvisor"]


def site_name(text: Column) -> Column:
    """Name of a web site in a text, without www and suffix; null for platforms, mail addresses and none."""
    folded = fold(text)
    name = F.regexp_extract(F.when(folded.contains("www.") | folded.contains("http"), folded), "(?:https?://|www\\.)(?:www\\.)?([a-z0-9-]+)\\.(?:com|ca|net|org|quebec)\\b", 1)
    return F.when((name != "") & ~name.isin(PLATFORMS), name)


def ngrams(words: Column, size: int) -> Column:
    """Phrases of ``size`` adjacent words."""
    out = words
    for n in range(1, size):
        later = F.when(F.size(words) > n, F.slice(words, n + 1, F.size(words))).otherwise(F.array().cast("array<string>"))
        out = F.zip_with(out, later, lambda a, b: F.concat(a, F.lit(" "), b))  # null where the words end
    return F.array_compact(out) if size > 1 else out


def print_name(name: Column, width: int, upper: bool = True, accents: bool = False) -> Column:
    """A name as a till prints it: single spaces, cut to ``width``."""
    out = name if accents else F.translate(name, ACCENTED, PLAIN)
    out = F.upper(out) if upper else out
    return F.trim(F.substring(F.regexp_replace(F.trim(out), "\\s+", " "), 1, width))


def wrap(text: Column, width: int) -> Column:
    """Greedy word wrap into lines of at most ``width`` characters; longer words stand alone."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        fits = (acc["line"] != "") & (F.length(acc["line"]) + 1 + F.length(w) <= width)
        lines = F.when(fits | (acc["line"] == ""), acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"])))
        return F.struct(lines.alias("lines"), F.when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w).alias("line"))

    return F.aggregate(words, start, add, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))))
