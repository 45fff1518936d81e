"""Secrets in texts: fixed patterns, and literals that an assignment gives to a sensitive name."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.assignments import assigned_literals
from lexiloom.llm.common import arrow_rows

# The base patterns. Shorter matches take up their place and are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

# Weights of name parts. A name's score is the largest weight among its parts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9, "bearer": 0.8, "auth": 0.6, "pass": 0.7, "pin": 0.5, "salt": 0.5, "key": 0.5,
}
# Every name with a sensitive part holds one of these, whatever stands between the words of a pair.
SENSITIVE_STEM = re.compile("(?i)pass|pwd|secret|token|key|credential|bearer|auth|pin|salt")
PLACEHOLDER = re.compile(r"(?i)^(?:changeme|example.*|placeholder|your[-_ ].*|x{3,}|\*{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|none|null|true|false|test|todo)$")
LEAST_SCORE = 1.3
# Names of less weight would need literals of three kinds of characters for that: they have a least score
# that their own literals reach, for literals with a digit (hexadecimal, digits) and without one.
LEAST_WITH_DIGIT = {"pin": 0.8, "key": 1.0, "salt": 1.0, "pass": 1.0, "auth": 0.9}
LEAST_WITHOUT = {"pass": 1.07, "auth": 1.0}
DIGIT = re.compile("[0-9]")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

SCHEMA = "id bigint, spans array<struct<start:int,end:int,kind:string,name:string,score:double>>"


def _sensitive_parts(name: str) -> list[str]:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    return [p for p in [*parts, *map("".join, zip(parts, parts[1:]))] if p in SENSITIVE]


def name_score(name: str) -> float:
    """How sensitive a target name is, by its words and pairs of neighbouring words."""
    return max((SENSITIVE[p] for p in _sensitive_parts(name)), default=0.0)


def literal_score(value: str) -> float:
    """Up to 1: long and mixed as a random string is. Placeholders and short values score 0."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    return min(1.0, bits / 4.0) * (0.5 + 0.25 * min(kinds - 1, 2))


def _is_message(value: str) -> bool:
    """Whether a literal with blanks is a sentence, a label or a command rather than a phrase that opens something."""
    words = re.split(r"\s+", value)
    return value[-1] in ".!?:," or any(_sensitive_parts(w) for w in words) or (words[0].istitle() and all(w.isalpha() for w in words))


def pair_score(name: str, value: str, quoted: bool = True) -> float:
    """Weight of the name and randomness of the literal, 0 if no part of the name reaches its least score with it.

    Literals with blanks count for names of full weight, in quotes, where they are no message.
    """
    parts = _sensitive_parts(name)
    if not parts or (re.search(r"\s", value) and not (quoted and name_score(name) == 1.0 and not _is_message(value))):
        return 0.0
    random = literal_score(value)
    least = LEAST_WITH_DIGIT if DIGIT.search(value) else LEAST_WITHOUT
    if random and any(SENSITIVE[p] + random >= least.get(p, LEAST_SCORE) for p in parts):
        return name_score(name) + random
    return 0.0


def _literals(text: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals given to a sensitive name, directly or through constants."""
    if ("=" not in text and ":" not in text) or not SENSITIVE_STEM.search(text):
        return
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, literal in assigned_literals(text):
        score = pair_score(name, literal.text, literal.quoted) if SENSITIVE_STEM.search(name) else 0.0
        for span in literal.spans if score else ():
            if score > best.get(span, (0.0, ""))[0]:
                best[span] = (score, name)
    for (start, end), (score, name) in best.items():
        yield start, end, name, score


def scan_text(text: str) -> list[tuple[int, int, str, str | None, float | None]]:
    """(start, end, kind, name, score) of every span, by start, then kind."""
    spans: list[tuple[int, int, str, str | None, float | None]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(*m.span(), "assign", m[1], None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(*m.span(), "access", None, None) for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex", None, None) for m in HEX.finditer(text)]
    spans += [(s, e, "literal", name, score) for s, e, name, score in _literals(text)]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; a span is (start, end, kind, name, score) in code points, end exclusive.

    Kinds ``assign``, ``access`` and ``hex`` are the base patterns. Kind ``literal`` comes from
    lexing (``assignments``): assignments of program and settings syntax become (name, literal) pairs, a
    name given to another name passes its literal on, and a literal is kept when the
    sensitivity of the name and the randomness of the literal reach the name's least score together. A
    joined literal is one span where it stands in one place, else a span for each of its pieces.

    Cases. Null and empty texts have no spans; texts are scanned whole, however long; repeated
    rows and null ids each give a row; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scan, SCHEMA).withColumnRenamed("id", id_col)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("score", pa.float64())]))
    fields = ("start", "end", "kind", "name", "score")
    for batch in batches:
        ids, spans = [], []
        for id_, text in arrow_rows([batch], "id", "text"):
            ids.append(id_)
            spans.append([dict(zip(fields, s, strict=True)) for s in scan_text(text or "")])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], names=["id", "spans"])


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        id_col, count("assign"), count("access"), count("hex"), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined("spans").alias("spans"), count("literal"))
