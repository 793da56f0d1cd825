"""Text functions on columns: terms, query compilation, trimming, hashing."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of the Latin blocks and their base letters, by canonical decomposition.
_LATIN = [chr(c) for c in range(0xC0, 0x250)]
ACCENTED = "".join(c for c in _LATIN if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)

HAN = r"\p{IsHan}"
WORDS = rf"{HAN}+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"
#: White space as the text rules see it: Unicode spaces and the byte-order mark.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def fold(word: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(word), ACCENTED, PLAIN)


def adjacent_pairs(characters: Column) -> Column:
    """Each element joined with the next one; empty for fewer than two."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(characters) - 1), lambda i: F.concat(characters[i - 1], characters[i]))
    return F.when(F.size(characters) > 1, pairs).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Index terms in order: words folded; a run of Han characters gives its characters, then its adjacent pairs.

    Texts without Han characters, most of all plain ASCII ones, are folded whole and cut by
    one expression; only the others go word by word. (One capital letter grows when it is
    lowered, so texts with it go word by word as well.)
    """
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def expand(word: Column) -> Column:
        characters = F.split(word, "")
        return F.when(word.rlike(HAN), F.concat(characters, adjacent_pairs(characters))).otherwise(F.array(fold(word)))

    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    folded = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(~text.rlike(r"[^\x00-\x7F]"), plain).when(~text.rlike(rf"[{HAN}\u0130]"), folded).otherwise(F.flatten(F.transform(words, expand)))


def search_terms(*parts: Column) -> Column:
    """Terms of several parts, empty and null ones left out."""
    return terms(F.concat_ws(" ", *parts))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as the chunk target counts."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass(frozen=True)
class Phrase:
    """Terms that must follow one another."""

    words: tuple[str, ...]


def compile_query(query: str) -> list[list[Phrase]]:
    """Alternatives of a keyword query; each is a list of phrases that must all occur.

    A run of Han characters asks for all its adjacent pairs (one character: for itself); any
    other run of letters, digits and underscores is one phrase. No runs: no alternatives.
    """
    table = str.maketrans(ACCENTED, PLAIN)
    found: list[list[Phrase]] = []
    for piece in regex.findall(r"\p{Script=Han}+|(?:(?!\p{Script=Han})[\p{L}\p{N}_])+", query):
        if regex.match(r"\p{Script=Han}", piece):
            pairs = [a + b for a, b in zip(piece, piece[1:], strict=False)]
            found.append([Phrase((u,)) for u in pairs or [piece]])
        elif words := regex.findall(r"[\p{L}\p{N}]+", piece):
            found.append([Phrase(tuple(w.lower().translate(table) for w in words))])
    return found
