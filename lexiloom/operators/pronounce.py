"""Pronunciation by rule table, as string functions on distinct words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T


@dataclass(frozen=True)
class SoundRules:
    """Letters and marks of an abugida and the phones they stand for."""

    independent_vowels: dict[str, str]
    matras: dict[str, str]
    consonants: dict[str, str]
    virama: str = ""
    joiner: str = ""
    nukta: str = ""
    nukta_suffix: str = "Q"
    nasal_marks: tuple[str, ...] = ()
    nasal_suffix: str = "N"
    visarga: str = ""
    visarga_phone: str = "H"
    inherent: str = "a"
    strip: str = ""
    # one private character per kind of letter
    kinds: dict[str, str] = field(init=False, default_factory=dict)

    def __post_init__(self):
        for kind, chars in (
            ("\ue000", self.consonants), ("\ue001", self.matras), ("\ue002", self.independent_vowels),
            ("\ue003", self.virama), ("\ue004", self.nukta), ("\ue005", self.nasal_marks),
            ("\ue006", self.visarga), ("\ue007", self.joiner),
        ):
            for ch in chars:
                self.kinds[ch] = kind


# The Devanagari rule table.
DEVANAGARI_SOUNDS = SoundRules(
    virama="्",
    joiner="\u200d",
    nukta="़",
    nukta_suffix="Q",
    nasal_marks=("ं", "ँ"),
    nasal_suffix="N",
    visarga="ः",
    visarga_phone="H",
    independent_vowels={
        "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    },
    matras={"ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"},
    consonants={
        "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng",
        "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ny",
        "ट": "tt", "ठ": "tth", "ड": "dd", "ढ": "ddh", "ण": "nn",
        "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
        "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
        "य": "y", "र": "r", "ल": "l", "व": "v",
        "श": "sh", "ष": "ssh", "स": "s", "ह": "h", "ळ": "ll",
    },
    strip="।॥.,;:!?\"'()[]—-",
)

_C, _M, _I, _V, _N, _X, _S, _J, _BAD = (chr(0xE000 + i) for i in range(9))


def unmapped(word: Column | str, rules: SoundRules) -> Column:
    """ARRAY<STRUCT<idx, ch>> of the characters without a sound, counted from 0.

    That is every character outside the table, and a virama or nukta with no
    consonant before it (letters without a sound in between do not count).
    """
    word = F.col(word) if isinstance(word, str) else word
    kinds = F.translate(word, "".join(rules.kinds), "".join(rules.kinds.values()))
    kinds = F.regexp_replace(kinds, f"[^{_C}-{_J}]", _BAD)
    # a consonant with its nuktas, joiners and letters without a sound, then one virama; or any other character
    runs = F.regexp_extract_all(kinds, F.lit(f"(?s){_C}[{_N}{_J}{_BAD}]*+{_V}?|."), F.lit(0))
    kinds = F.array_join(F.transform(runs, lambda r: F.when(r.isin(_N, _V), _BAD).otherwise(r)), "")
    marked = F.transform(
        F.split(word, ""), lambda ch, i: F.struct(i.alias("idx"), ch.alias("ch"), F.substring(kinds, i + 1, F.lit(1)).alias("k"))
    )
    bad = F.filter(marked, lambda x: (x["k"] == _BAD) & (x["ch"] != ""))
    return F.transform(bad, lambda x: F.struct(x["idx"].alias("idx"), x["ch"].alias("ch")))


def _any(chars) -> str:
    chars = "".join(chars)
    return f"[{T.char_class(chars)}]" if chars else "(?!)"


def phones(word: Column | str, rules: SoundRules) -> Column:
    """ARRAY<STRING> of the phones of a fully mapped word.

    The word is cut into syllable parts (consonant with its marks, free vowel,
    free mark) and every part is looked up on its own.
    """
    word = F.col(word) if isinstance(word, str) else word
    plain = F.translate(word, rules.joiner, "") if rules.joiner else word
    c, m, i = _any(rules.consonants), _any(rules.matras), _any(rules.independent_vowels)
    v, n, x, s = _any(rules.virama), _any(rules.nukta), _any(rules.nasal_marks), _any(rules.visarga)
    parts = F.regexp_extract_all(plain, F.lit(f"{c}{n}*+(?:{v}|{m}?+{x}?+)|{m}{x}?+|{i}{x}?+|{x}|{s}"), F.lit(0))
    lookup = lambda d: F.create_map(*[F.lit(y) for kv in d.items() for y in kv]) if d else F.create_map().cast("map<string,string>")
    heads, vowels = lookup(rules.consonants), lookup({**rules.matras, **rules.independent_vowels})

    def sound(part: Column) -> Column:
        first = F.substring(part, 1, 1)
        bare = F.regexp_replace(F.regexp_replace(part, f"{n}|{v}", ""), x, "")
        nasal = F.when(part.rlike(f"{x}$"), rules.nasal_suffix).otherwise("")
        head = F.concat(heads[first], F.repeat(F.lit(rules.nukta_suffix), F.regexp_count(part, F.lit(n))))
        vowel = F.coalesce(vowels[F.substring(bare, 2, 1)], F.lit(rules.inherent))
        return (
            F.when(part.rlike(f"^{c}{n}*{v}$"), F.array(head))
            .when(part.rlike(f"^{c}"), F.array(head, F.concat(vowel, nasal)))
            .when(part.rlike(f"^{s}"), F.array(F.lit(rules.visarga_phone)))
            .when(part.rlike(f"^{x}"), F.array(F.lit(rules.nasal_suffix)))
            .otherwise(F.array(F.concat(vowels[first], nasal)))
        )

    return F.flatten(F.transform(parts, sound))


def pronounce(vocab: DataFrame, rules: SoundRules = DEVANAGARI_SOUNDS, word: str = "word") -> DataFrame:
    """Add ``unmapped`` and ``phones``; phones are null as soon as one character has no sound."""
    out = vocab.withColumn("unmapped", unmapped(word, rules))
    return out.withColumn("phones", F.when(F.size("unmapped") == 0, phones(word, rules)))


def pronunciation_vocabulary(df: DataFrame, text: str = "text", rules: SoundRules = DEVANAGARI_SOUNDS) -> DataFrame:
    """Distinct composed words without boundary punctuation."""
    each = df.select(F.explode(T.tokens(T.nfc(text))).alias("t")).distinct()
    return each.select(T.strip_chars("t", rules.strip).alias("word")).where(F.col("word") != "").distinct()


def unmapped_report(spoken: DataFrame) -> DataFrame:
    """(word, chars) with each offending character as U+XXXX(c)@index."""
    from lexiloom.operators.profile import code_point_label

    label = F.transform("unmapped", lambda u: F.concat(code_point_label(u["ch"]), F.lit("("), u["ch"], F.lit(")@"), u["idx"].cast("string")))
    return spoken.where(F.col("phones").isNull()).select("word", F.array_join(label, ", ").alias("chars"))


def lexicon_summary(spoken: DataFrame) -> DataFrame:
    """One row: words, mapped, unmapped, coverage_pct."""
    return spoken.agg(
        F.count(F.lit(1)).alias("words"), F.count("phones").alias("mapped"),
        F.count_if(F.col("phones").isNull()).alias("unmapped"),
    ).withColumn("coverage_pct", F.try_divide(F.lit(100) * F.col("mapped"), F.col("words")))


def phone_inventory(spoken: DataFrame) -> DataFrame:
    return spoken.select(F.explode("phones").alias("phone")).groupBy("phone").agg(F.count(F.lit(1)).alias("n"))


def check_no_leak(spoken: DataFrame, rules: SoundRules = DEVANAGARI_SOUNDS) -> None:
    """Raise if a control character became a phone."""
    control = [c for c in (rules.virama, rules.joiner, rules.nukta) if c]
    leaked = phone_inventory(spoken).where(F.col("phone").isin(control)).collect()  # at most three
    if leaked:
        raise ValueError(f"control characters among the phones: {[r.phone for r in leaked]}")
