"""Column expressions on text: cleaning, segmenting, tokenising, script tests.

Everything stays in the JVM but for Unicode normalisation, which Spark has no
function for. Patterns start with ``(?U)`` where Python's ``\\s``, ``\\d`` and
``\\b`` are meant, since Java's are ASCII otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

SPACE = r"[\s\x1c-\x1f]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def char_class(chars: str) -> str:
    """The body of a regex character class matching exactly ``chars``."""
    return "".join("\\" + c if c in r"\^]-[&~" else c for c in chars)


# ---------------------------------------------------------------- tokens

def tokens(col: Column | str) -> Column:
    """White-space tokens without empty strings."""
    return F.filter(F.split(_c(col), f"(?U){SPACE}+"), lambda t: t != "")


def word_count(col: Column | str) -> Column:
    return F.size(tokens(col))


# The characters SPACE matches, for trimming without a regex.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(col: Column | str) -> Column:
    return F.btrim(_c(col), F.lit(SPACE_CHARS))


def collapse_space(col: Column | str) -> Column:
    return strip_space(F.regexp_replace(_c(col), f"(?U){SPACE}+", " "))


def strip_chars(col: Column | str, chars: str) -> Column:
    """Trim a set of characters from both ends."""
    return F.btrim(_c(col), F.lit(chars))


# The marks that become tokens of their own. The backslash is
# one of them.
PUNCTUATION_MARKS = "\u0964\u0965,.!?\u201c\u201d\u2018\u2019\"()\\[]:;"


def tokenize_punct(col: Column | str, marks: str = PUNCTUATION_MARKS) -> Column:
    """White-space tokens after spacing out every punctuation mark."""
    return tokens(F.regexp_replace(_c(col), f"([{char_class(marks)}])", " $1 "))


# ---------------------------------------------------------------- Unicode

@F.pandas_udf(ST.StringType())
def _nfc_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(col: Column | str) -> Column:
    """Canonical composition.

    No character below U+0300 changes under composition or combines with
    another such, so rows without a higher one reach the Python worker as null.
    """
    text = _c(col)
    needs = F.when(text.rlike(r"[^\x00-\u02ff]"), text)
    return F.coalesce(_nfc_udf(needs), text)


# ---------------------------------------------------------------- markup

@dataclass(frozen=True)
class MarkupRules:
    """Prefixes that discard a line, then (pattern, replacement) steps in order."""

    discard: tuple[str, ...] = ()
    steps: tuple[tuple[str, str], ...] = ()


# The markers of the scripture markup and the order of removal.
SCRIPTURE_MARKUP = MarkupRules(
    discard=(
        "\\id", "\\h", "\\toc1", "\\toc2", "\\toc3", "\\mt1",
        "\\c ", "\\s1", "\\r ", "\\ip", "\\io1", "\\io2",
    ),
    steps=(
        (r"(?s)\\em.*?\\em\*", ""),
        (r"\\bd\*", ""),
        (r"\\em\*", ""),
        (r"(?U)\\bd\b", ""),
        (r"(?U)^\\v \d+\s*", ""),
        (r"(?U)^\\[pm]\s*", ""),
    ),
)


def clean_markup(col: Column | str, rules: MarkupRules = SCRIPTURE_MARKUP) -> Column:
    """Cleaned text of one marked-up line, '' when the line is discarded."""
    line = strip_space(col)
    out = line
    for pattern, replacement in rules.steps:
        out = F.regexp_replace(out, pattern, replacement)
    out = strip_space(nfc(out))
    if rules.discard:
        drop = F.lit(False)
        for prefix in rules.discard:
            drop = drop | F.startswith(line, F.lit(prefix))
        out = F.when(drop, F.lit("")).otherwise(out)
    return out


# ---------------------------------------------------------------- sentences

DANDA = "\u0964\u0965"


def split_sentences(col: Column | str, terminators: str = DANDA) -> Column:
    """Pieces ending after a terminator, trimmed, empties dropped."""
    pieces = F.split(_c(col), f"(?<=[{char_class(terminators)}])")
    return F.filter(F.transform(pieces, strip_space), lambda s: s != "")


def segments(col: Column | str, terminators: str = DANDA, min_tokens: int = 3) -> Column:
    """Sentence pieces of at least ``min_tokens`` white-space tokens."""
    return F.filter(split_sentences(col, terminators), lambda s: F.size(tokens(s)) >= min_tokens)


# A Unicode noncharacter marks the cut; text never holds one.
_CUT = "\ufdd0"

# Quotation marks whose inside hides terminators.
QUOTE_PAIRS = ("\u201c\u201d", "\u2018\u2019", '""')


def split_quoted(col: Column | str, terminators: str = DANDA + "?!", quotes: tuple[str, ...] = QUOTE_PAIRS) -> Column:
    """Sentence pieces where a terminator inside an open quotation does not cut.

    An opening mark hides terminators up to its closing mark, or to the end of
    the text if it is never closed; a closing mark without opening is plain.
    The text is cut into quoted blocks, terminators and the rest, one linear
    pass; there is no fold that would copy a growing buffer.
    """
    opens = char_class("".join(q[0] for q in quotes))
    ends = char_class(terminators)
    blocks = "|".join(f"{re.escape(q[0])}[^{char_class(q[1])}]*+{re.escape(q[1])}?" for q in quotes)
    pattern = f"{blocks}|[{ends}]|[^{opens}{ends}]++"
    pieces = F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(0))
    is_end = [F.lit(t) for t in terminators]
    marked = F.transform(pieces, lambda p: F.when(p.isin(*is_end), F.concat(p, F.lit(_CUT))).otherwise(p))
    cut = F.split(F.array_join(marked, ""), _CUT)
    return F.filter(F.transform(cut, strip_space), lambda s: s != "")


# ---------------------------------------------------------------- script

# The script block that counts as native, and the joiner.
DEVANAGARI_RANGES = (("\u0900", "\u097f"), ("\u200d", "\u200d"))
LATIN_RANGES = (("\u00c0", "\u024f"),)


def _ranges(ranges) -> str:
    return "".join(f"{a}-{b}" for a, b in ranges)


def non_space_count(col: Column | str) -> Column:
    return F.length(F.translate(_c(col), " \t\n", ""))


def foreign_count(col: Column | str, ranges=DEVANAGARI_RANGES) -> Column:
    """Characters above ASCII and outside the ranges; ASCII is never foreign."""
    return F.length(F.regexp_replace(_c(col), f"[\\x00-\\x7f{_ranges(ranges)}]+", ""))


def native_count(col: Column | str, ranges=DEVANAGARI_RANGES) -> Column:
    return F.length(F.regexp_replace(_c(col), f"[^{_ranges(ranges)}]+", ""))


def script_ratio(col: Column | str, ranges=DEVANAGARI_RANGES) -> Column:
    """Foreign share of the non-space characters, null on text without any."""
    total = non_space_count(col)
    return F.when(total > 0, foreign_count(col, ranges) / total)


def passes_script(col: Column | str, ranges=DEVANAGARI_RANGES, max_foreign: float = 0.20) -> Column:
    return F.coalesce(script_ratio(col, ranges) <= max_foreign, F.lit(False))


# ---------------------------------------------------------------- transcripts

@dataclass(frozen=True)
class TranscriptRules:
    """Character classes (regex class bodies) that drive transcript cleaning."""

    keep: str
    letter: str
    digit: str
    colon: str
    terminal: str
    max_name_words: int = 3
    reference: str = field(init=False, default="")

    def __post_init__(self):
        verse = f"[{self.digit}]+[{self.colon}][{self.digit}]+"
        object.__setattr__(
            self,
            "reference",
            f"(?U)(?:[{self.digit}]+[ ]+)?"
            f"(?:[{self.letter}]+[ ]+){{0,{self.max_name_words}}}"
            f"{verse}(?:[;,][ ]*(?:{verse}|[{self.digit}]+))*",
        )


# Letters without digits and terminators, both digit scripts,
# both colons, and what is trimmed from a recovered book name.
DEVANAGARI_TRANSCRIPT = TranscriptRules(
    keep="\u0900-\u097f\u200d",
    letter="\u0900-\u0963\u0970-\u097f\u200d",
    digit="\u0966-\u096f\\d",
    colon=":\uff1a",
    terminal="\u0964.\u0965 ",
)

LATIN_TRANSCRIPT = TranscriptRules(
    keep="A-Za-z\u00c0-\u024f0-9.",
    letter="A-Za-z\u00c0-\u024f",
    digit="0-9",
    colon=":",
    terminal=". ",
)


def digit_token(rules: TranscriptRules) -> str:
    """A token that holds a digit; it is looked for from its first character only, so a long word costs its length."""
    return f"(?U)(?<!\\S)[^\\s{rules.digit}]*+[{rules.digit}]\\S*+"


def without_references(text: Column, rules: TranscriptRules) -> Column:
    """Each reference as a space. Its words are tried only where digits stand on both sides of a colon."""
    verse = f"(?U)[{rules.digit}][{rules.colon}][{rules.digit}]"
    return F.when(text.rlike(verse), F.regexp_replace(text, rules.reference, " ")).otherwise(text)


def clean_transcript(col: Column | str, rules: TranscriptRules = DEVANAGARI_TRANSCRIPT, normalise: bool = True) -> Column:
    """STRUCT<text, dropped>: references out, script kept, digit tokens dropped and counted."""
    text = nfc(col) if normalise else _c(col)
    text = without_references(text, rules)
    text = F.regexp_replace(text, f"(?U)[^{rules.keep}{SPACE[1:-1]}]", " ")
    dropped = F.regexp_count(text, F.lit(digit_token(rules)))
    text = F.regexp_replace(text, digit_token(rules), " ")
    text = strip_space(F.regexp_replace(text, " {2,}", " "))
    return F.struct(text.alias("text"), dropped.cast("long").alias("dropped"))


def strip_numerals(col: Column | str, rules: TranscriptRules = DEVANAGARI_TRANSCRIPT, normalise: bool = True) -> Column:
    """STRUCT<text, removed>: tokens holding a digit dropped, white space collapsed."""
    text = nfc(col) if normalise else _c(col)
    removed = F.regexp_count(text, F.lit(digit_token(rules)))
    kept = F.regexp_replace(text, digit_token(rules), " ")
    return F.struct(collapse_space(kept).alias("text"), removed.cast("long").alias("removed"))


def book_line(col: Column | str, rules: TranscriptRules = DEVANAGARI_TRANSCRIPT) -> Column:
    """One to three words and a period, nothing else.

    A word is made of any character of the script block, digits and
    terminators included.
    """
    word = f"[{rules.keep.replace('.', '')}]+"
    return strip_space(col).rlike(f"(?U)^{word}(?:\\s+{word}){{0,{rules.max_name_words - 1}}}\\.\\s*$")


def chapter_line(col: Column | str, rules: TranscriptRules = DEVANAGARI_TRANSCRIPT) -> Column:
    return strip_space(col).rlike(f"(?U)^[{rules.digit}]+\\.\\s*$")


# ---------------------------------------------------------------- inventories

def adaptation_policy(missing: list[str], danda: str = "", overrides: dict[str, str] | None = None) -> dict[str, str]:
    """What stands for a missing character: nothing for the joiner, ``danda`` for sentence ends, then the overrides."""
    plain = {"\u200d": "", "।": danda, "॥": danda}
    return {c: t for c, t in plain.items() if c in missing} | (overrides or {})


def adapt_text(col: Column | str, missing: list[str], policy: dict[str, str] | None = None, default: str = "") -> Column:
    """Replace each missing character by its policy text, one without a policy by ``default`` (empty: delete)."""
    if not missing:
        return collapse_space(col)
    policy = policy or {}
    deleted = [c for c in missing if policy.get(c, default) == ""]
    mapped = {c: policy.get(c, default) for c in missing if policy.get(c, default) != ""}
    out = _c(col)
    if deleted:
        out = F.regexp_replace(out, f"[{char_class(''.join(deleted))}]", "")
    if mapped:
        table = F.create_map(*[F.lit(x) for kv in mapped.items() for x in kv])
        out = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(table[c], c)), "")
    return collapse_space(out)


def skip_reason(text: Column | str, source_missing: Column, min_words: int = 3) -> Column:
    """Why a record cannot be used, null if it can; the first reason wins."""
    text = _c(text)
    return (
        F.when(source_missing, "source file missing")
        .when(F.coalesce(text, F.lit("")) == "", "empty transcript")
        .when(word_count(text) < min_words, f"under {min_words} words after cleaning")
    )
