"""Text expressions: trimming, normalization keys and header keys.

Everything here is a Catalyst expression. One linear search tells text that has nothing to
tidy (visible ASCII, single inner spaces), the common case, from text that needs more.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
#: The same set as the inside of a regular expression class.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Found in text that is not visible ASCII separated by single spaces.
_UNTIDY = r"[^ -~]|  |^ | \z"
# The block of combining marks that is dropped from keys.
FIRST_MARK, LAST_MARK = 0x0300, 0x036F
# Fixed value: characters of a cell quoted in a message.
QUOTE_LENGTH = 40


def trim_ws(text: Column) -> Column:
    return F.when(text.rlike(_UNTIDY), F.btrim(text, F.lit(WHITE_SPACE))).otherwise(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@cache
def _accents() -> tuple[str, str]:
    """The characters that lose an accent and what is left of each, from the Unicode database.

    Characters that vanish come last, as ``translate`` wants them. A character that would
    become several (Hangul syllables, some Indic letters) stays as it is written, so only its
    composed and decomposed spellings keep different keys.
    """
    kept, gone = {}, []
    for code in range(0x80, 0x110000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not FIRST_MARK <= ord(c) <= LAST_MARK)
        if not base:
            gone.append(chr(code))
        elif base != chr(code) and len(base) == 1:
            kept[chr(code)] = base
    return "".join([*kept, *gone]), "".join(kept.values())


def without_accents(text: Column) -> Column:
    """Canonical decomposition with the combining marks dropped."""
    source, target = _accents()
    return F.when(is_ascii(text), text).otherwise(F.translate(text, source, target))


def normalize_text(text: Column) -> Column:
    """The key under which two spellings are the same value."""
    spaced = F.regexp_replace(without_accents(text), f"[{WS}]+", " ")
    return F.when(text.rlike(_UNTIDY), F.lower(F.trim(spaced))).otherwise(F.lower(text))


def literal_key(text: str) -> str:
    """``normalize_text`` of a value known while planning, such as a listed option."""
    source, target = _accents()
    table = str.maketrans(source[: len(target)], target, source[len(target) :])
    return re.sub(f"[{WS}]+", " ", text.translate(table)).strip(" ").lower()


def header_key(text: Column) -> Column:
    """Normalized header: letters and digits joined by single underscores."""
    return F.btrim(F.regexp_replace(normalize_text(text), "[^a-z0-9]+", "_"), F.lit("_"))


def text_length(text: Column) -> Column:
    """Length in UTF-16 units, as spreadsheets count it."""
    return F.when(is_ascii(text), F.octet_length(text)).otherwise(
        F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    )


def quoted(text: Column) -> Column:
    """A cell cut to the length that fits a message."""
    return F.when(
        F.length(text) > QUOTE_LENGTH, F.concat(F.substring(text, 1, QUOTE_LENGTH), F.lit("..."))
    ).otherwise(text)
