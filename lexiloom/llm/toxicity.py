"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import arrow_rows
from lexiloom.llm.minhash import near_duplicates
from lexiloom.session import cut_lineage

# Letters that look like Latin ones and do not decompose to them, by script, and digits and signs written for letters.
CYRILLIC = dict(zip("авезикмнопрстухьѕіјԁһӏԛԝ", "abeeukmhonpctyxbsijdhlqw", strict=True))
GREEK = dict(zip("αβγεζηικνοπρτυχω", "abyeznikvonptuxw", strict=True))
LATIN = dict(zip("ıɩłøđħŧƒʀɢɴʟʙꜱɡɑ", "iilodhtfrgnlbsga", strict=True))
SUBSTITUTES = dict(zip("013457@$€£", "oieastasel", strict=True))
INVISIBLE = dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad", "")
FOLD = str.maketrans(CYRILLIC | GREEK | LATIN | SUBSTITUTES | INVISIBLE)
# Accents and other marks that stay when letters are decomposed.
MARKS = {c: None for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Me")}
# Signs for letters inside a word, and letters of a word with one sign between each two.
BAR = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
APART = re.compile(r"(?<![^\W_])[^\W_](?:([.\-_*·])[^\W_](?:\1[^\W_])+)(?![^\W_])")

WORD = re.compile(r"[^\W_]+")
PREFIXES = range(3, 9)
SAMPLE_ROWS = 20_000  # labelled rows of each label that the model is fitted on
LEAST_DOCS = 3  # toxic rows that hold a pattern
LEAST_WEIGHT = 1.0
LEAST_GAIN = 15.0  # log-likelihood ratio of a pattern, chi-squared with one degree of freedom
LEXICON_SIZE = 5_000
THRESHOLD = 0.3


def fold(text: str) -> str:
    """Lower-cased text with look-alike and decorated letters, digits and signs as the plain letters they stand for.

    Letters are decomposed (full width, mathematical and circled ones, accents) and marks dropped; letters of other
    scripts, digits and signs are replaced; ``!`` and ``|`` between letters are i; single letters with one sign
    between each two are joined. Places in the folded text are not those of the text.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(MARKS)
    text = text.lower().translate(FOLD)
    if "!" in text or "|" in text:
        text = BAR.sub("i", text)
    return APART.sub(lambda m: m[0].replace(m[1], ""), text)


def neighbours(folded: str, begin: int) -> tuple[str | None, str | None, str | None]:
    """The word that begins at a place, and the words before and after it, however far they are."""
    here = WORD.match(folded, begin)
    if not here:
        return None, None, None
    after = WORD.search(folded, here.end())
    end = begin
    while end and not WORD.match(folded[end - 1]):
        end -= 1
    start = end
    while start and WORD.match(folded[start - 1]):
        start -= 1
    return folded[start:end] or None, here[0], after[0] if after else None


def matches(folded: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, float, str]]:
    """(place, weight, pattern) wherever a pattern meets a word: whole, or a beginning of a longer word, as they are counted."""
    for end, (size, whole, start) in automaton.iter(folded) if len(automaton) else ():
        begin = end - size + 1
        if begin and folded[begin - 1].isalnum():
            continue
        closed = end + 1 == len(folded) or not folded[end + 1].isalnum()
        weight = whole if closed else start
        if weight:
            yield begin, weight, folded[begin:end + 1] + ("" if closed else "*")


@dataclass
class Lexicon:
    """Patterns with weights: whole words, or beginnings of words written with a final ``*``;
    phrases of two words in which a match does not count; and the scale from sums to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    bias: float = -6.0
    slope: float = 1.0
    length_slope: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        by_text: dict[str, list] = {}
        for pattern, weight in self.weights.items():
            by_text.setdefault(pattern.removesuffix("*"), [0.0, 0.0])[pattern.endswith("*")] = weight
        for text, (whole, start) in by_text.items():
            out.add_word(text, (len(text), whole, start))
        if len(out):
            out.make_automaton()
        return out

    def features(self, text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float]:
        """(log of the weight sum, weight per root of words): each matched word counts its heaviest pattern."""
        if not text or not len(automaton):
            return 0.0, 0.0
        folded = fold(text)
        words: dict[int, float] = {}
        for begin, weight, _ in matches(folded, automaton):
            words[begin] = max(weight, words.get(begin, 0.0))
        if self.exceptions and words:
            words = {b: w for b, w in words.items() if not self._excepted(folded, b)}
        total = sum(words.values())
        return math.log1p(total), total / math.sqrt(len(folded.split()) + 20)

    def _excepted(self, folded: str, begin: int) -> bool:
        before, here, after = neighbours(folded, begin)
        return f"{here} {after}" in self.exceptions or f"{before} {here}" in self.exceptions

    def score(self, features: tuple[float, float]) -> float:
        z = self.bias + self.slope * features[0] + self.length_slope * features[1]
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. A null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def patterns_of(text: str) -> set[str]:
    """Whole words of a folded text and beginnings of words, the latter with a final star."""
    out = set(WORD.findall(text))
    return out | {w[:n] + "*" for w in out for n in PREFIXES if len(w) > n}


def sample_texts(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic, half): labelled texts to learn from, one of each group of near-copies with one label."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = chosen.where("toxic = 1").orderBy(order, "doc_id").limit(sample_rows).unionAll(chosen.where("toxic = 0").orderBy(order, "doc_id").limit(sample_rows))
    # at most 2 * sample_rows ids
    rows = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL"), "labelled")
    groups = near_duplicates(rows, width=2, percent=80).select("doc_id", "component_id").distinct()
    rows = rows.join(groups, "doc_id").groupBy("toxic", "component_id").agg(F.min("text").alias("text"))
    return cut_lineage(rows.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "sample")


def fit_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn a lexicon from labelled texts.

    Of each label at most ``sample_rows`` rows are read, chosen by a hash of their ids among
    all that are not held out; of copies and near-copies (similarity 0.8 on their sets of two-word shingles,
    ``minhash.near_duplicates``) with one label one is read, or any word of a text copied often would seem
    telling. A row labelled both ways is read under both labels. A pattern is taken when its counts in toxic and clean rows
    differ by more than chance (LEAST_GAIN); its weight is the log of how much oftener toxic rows
    hold it, less one standard error. Both are then taken again from the rows in which it is the heaviest
    pattern of some word, as only that one counts, so a beginning does not live on the one telling word it begins. Matches followed or preceded by one word in several
    clean rows and in no toxic row become exception phrases. The scale from sums to a score is a
    logistic fit on the sample, each half being measured with the lexicon of the other half.
    """
    rows = sample_texts(docs, labels, sample_rows)
    n = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = rows.mapInArrow(_count_patterns, "pattern string, half int, toxic bigint, clean bigint")
    sums = [F.coalesce(F.sum(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "clean")]
    counted = cut_lineage(counted.groupBy("pattern").agg(*sums), "patterns")

    def number(label: int, halves: tuple[int, ...]) -> float:
        return float(sum(n.get((h, label), 0) for h in halves))

    def learned(*halves: int) -> Lexicon:
        total = lambda c: sum((F.col(f"{c}{h}") for h in halves), F.lit(0))
        return Lexicon(weights=_weights(counted.select("pattern", total("toxic").alias("toxic"), total("clean").alias("clean")), number(1, halves), number(0, halves)))

    send = rows.sparkSession.sparkContext.broadcast

    def settled(*halves: int) -> Lexicon:
        lexicon = learned(*halves)
        credited = rows.where(F.col("half").isin(*halves)).mapInArrow(_count_heaviest(send(lexicon)), "pattern string, toxic bigint, clean bigint")
        credited = credited.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        return Lexicon(weights=_weights(credited, number(1, halves), number(0, halves)))

    lexicon, others = settled(0, 1), {0: settled(1), 1: settled(0)}
    contexts = rows.mapInArrow(_count_contexts(send(lexicon)), "phrase string, toxic bigint, clean bigint").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared = contexts.where((F.col("toxic") == 0) & (F.col("clean") >= LEAST_DOCS)).orderBy(F.desc("clean"), "phrase").limit(LEXICON_SIZE).collect()
    lexicon.exceptions = {r["phrase"] for r in spared}

    # at most 2 * sample_rows pairs of numbers
    measured = rows.mapInArrow(_measure(send(others)), "x double, y double, toxic int").collect()
    measured.sort(key=lambda r: (r["x"], r["y"], r["toxic"]))
    if any(r["toxic"] for r in measured):
        lexicon.bias, lexicon.slope, lexicon.length_slope = _logistic(
            np.array([[r["x"], r["y"]] for r in measured]), np.array([r["toxic"] for r in measured], dtype=float))
    return lexicon


def _weights(counted: DataFrame, toxic_rows: float, clean_rows: float) -> dict[str, float]:
    """Weight of each telling pattern, at most LEXICON_SIZE of them."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = F.lit(toxic_rows / max(1.0, toxic_rows + clean_rows))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    odds = F.log((a + 0.5) / (toxic_rows + 1)) - F.log((b + 0.5) / (clean_rows + 1))
    weight = odds - F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    top = counted.where(a >= LEAST_DOCS).withColumns({"gain": gain, "weight": weight}).where((F.col("gain") >= LEAST_GAIN) & (F.col("weight") >= LEAST_WEIGHT))
    return {r["pattern"]: r["weight"] for r in top.orderBy(F.desc("gain"), "pattern").limit(LEXICON_SIZE).collect()}


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = (Counter(), Counter()), (Counter(), Counter())

    def counts():
        for half in (0, 1):
            out = _counts("pattern", toxic[half], clean[half])
            yield pa.RecordBatch.from_arrays(
                [out.column(0), pa.array([half] * out.num_rows, pa.int32()), out.column(1), out.column(2)], names=["pattern", "half", "toxic", "clean"])
            toxic[half].clear()
            clean[half].clear()

    for text, label, half in arrow_rows(batches, "text", "toxic", "half"):
        (toxic if label else clean)[half].update(patterns_of(fold(text)))
        if sum(map(len, (*toxic, *clean))) > 100_000:
            yield from counts()
    yield from counts()


def _counts(name: str, toxic: Counter, clean: Counter) -> pa.RecordBatch:
    keys = list(toxic | clean)
    return pa.RecordBatch.from_pydict({
        name: pa.array(keys, pa.string()), "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})


def _count_heaviest(sent):
    def count(batches):
        automaton, toxic, clean = sent.value.automaton(), Counter(), Counter()
        for text, label in arrow_rows(batches, "text", "toxic"):
            words: dict[int, tuple[float, str]] = {}
            for begin, weight, pattern in matches(fold(text), automaton):
                words[begin] = max((weight, pattern), words.get(begin, (0.0, "")))
            (toxic if label else clean).update({pattern for _, pattern in words.values()})
        yield _counts("pattern", toxic, clean)

    return count


def _count_contexts(sent):
    def count(batches):
        automaton, toxic, clean = sent.value.automaton(), Counter(), Counter()
        for text, label in arrow_rows(batches, "text", "toxic"):
            folded, phrases = fold(text), set()
            for begin, _, _ in matches(folded, automaton):
                before, here, after = neighbours(folded, begin)
                if here and after:
                    phrases.add(f"{here} {after}")
                if here and before:
                    phrases.add(f"{before} {here}")
            (toxic if label else clean).update(phrases)
        yield _counts("phrase", toxic, clean)

    return count


def _measure(sent):
    def measure(batches):
        lexicons = {h: (x, x.automaton()) for h, x in sent.value.items()}
        for batch in batches:
            rows = [(*lexicons[h][0].features(t, lexicons[h][1]), y) for t, y, h in arrow_rows([batch], "text", "toxic", "half")]
            x, y, label = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(label, pa.int32())], names=["x", "y", "toxic"])

    return measure


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """Newton steps for a logistic fit with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    ridge = penalty * len(y) * np.diag([0.0, 1.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(3), design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1]), float(beta[2])


def toxicity_score(lexicon: Lexicon, spark, text: Column) -> Column:
    """The score of a text column, 0 to 1; null and empty texts score as a text without matches."""
    sent = spark.sparkContext.broadcast(lexicon)
    state: dict = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        lexicon = sent.value
        if "automaton" not in state:
            state["automaton"] = lexicon.automaton()
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([lexicon.score(lexicon.features(t, state["automaton"])) for (t,) in arrow_rows([batch], "text")], pa.float64())

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; predicted is 1 from THRESHOLD on.

    Only the whole text enters a score. Cases: null and empty texts score as texts without a
    match; repeated rows and null ids each give a row; an empty table gives an empty one;
    without toxic labels the lexicon is empty and every score is the same low one.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scored = rows.select("id", toxicity_score(lexicon, docs.sparkSession, F.col("text")).alias("score"))
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
