"""Subword vocabularies, encoding, and training examples from id sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lexiloom.functions.hashing import uniform
from lexiloom.operators.ordered import ordered_scan
from lexiloom.session import cut_lineage, drop_shuffles

SPACE_MARK = "▁"

# Reserved ids, user symbols, share of characters kept, and the
# range of pieces per word that counts as healthy.
SPECIALS = ("<pad>", "<unk>", "<s>", "</s>")
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
USER_SYMBOLS = ("[MASK]", "[PAD]")
CHARACTER_COVERAGE = 0.9995
FERTILITY_RANGE, FERTILITY_MIDDLE = (2.5, 4.0), 3.25

MAX_BROADCAST_PIECES = 2_000_000
# Fixed value: ids decoded at once; a longer sequence is decoded alone.
DECODED_AT_ONCE = 1 << 16
# Fixed value: characters of words worked on at once in a round of EM.
PLACES_AT_ONCE = 1 << 15
# Pieces that are trained on the driver's side and shared with all tasks, and words in a bucket where there are more.
SHARED_PIECES, BUCKET_WORDS = 1 << 17, 1 << 14


# ---------------------------------------------------------------- induction

def marked_words(vocab: DataFrame) -> DataFrame:
    """(token, n) with the word-start mark in front."""
    return vocab.select(F.concat(F.lit(SPACE_MARK), "token").alias("token"), "n")


def kept_characters(vocab: DataFrame, coverage: float = CHARACTER_COVERAGE) -> DataFrame:
    """(ch, n): the most frequent characters that make up ``coverage`` of the text.

    The inventory cannot exceed Unicode, so one window over it is bounded.
    """
    from pyspark.sql import Window

    chars = vocab.select("n", F.explode(F.split("token", "")).alias("ch")).where(F.col("ch") != "").groupBy("ch").agg(
        F.sum("n").alias("n")
    )
    before = Window.orderBy(F.desc("n"), "ch").rowsBetween(Window.unboundedPreceding, -1)
    ranked = chars.withColumn("__b", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = chars.agg(F.sum("n")).scalar()
    return ranked.where(F.col("__b") < coverage * total).select("ch", "n")


def seed_substrings(vocab: DataFrame, max_chars: int = 16, min_count: int = 2) -> DataFrame:
    """(piece, n): substrings of 2..max_chars characters weighted by word count, and their score n * length."""
    size = F.length("token")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(2), F.least(F.lit(max_chars), size - i + 1)), lambda l: F.substring("token", i, l))))
    pieces = vocab.where(size >= 2).select(
        "n", F.explode(F.filter(spans, lambda s: F.length(s) >= 2)).alias("piece")
    )
    return (
        pieces.groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        .withColumn("score", F.col("n") * F.length("piece"))
    )


class _Pieces:
    """Pieces as a tree of characters in sorted arrays, walked for many words at once."""

    def __init__(self, scores: dict[str, float]):
        self.pieces = list(scores)
        self.scores = np.array([scores[p] for p in self.pieces])
        self.longest = max(map(len, self.pieces))
        nodes, ends = {"": 0}, [-1]
        for number, piece in enumerate(self.pieces):
            for i in range(1, len(piece) + 1):
                if piece[:i] not in nodes:
                    nodes[piece[:i]] = len(ends)
                    ends.append(-1)
            ends[nodes[piece]] = number
        edges = sorted((nodes[name[:-1]] << 21 | ord(name[-1]), node) for name, node in nodes.items() if name)
        self.edges, self.targets = (np.array(side, np.int64) for side in zip(*edges))
        self.ends = np.array(ends, np.int64)

    def at(self, chars: np.ndarray) -> np.ndarray:
        """[word, start, length - 1]: the number of the piece that stands there, or -1, for words as rows of code points."""
        n, size = chars.shape
        found = np.full((n, size, min(self.longest, size)), -1, np.int64)
        word, start = (side.ravel() for side in np.indices((n, size)))
        node = np.zeros(len(word), np.int64)
        for d in range(found.shape[2]):
            inside = start + d < size
            word, start, node = word[inside], start[inside], node[inside]
            step = node << 21 | chars[word, start + d]
            edge = np.minimum(np.searchsorted(self.edges, step), len(self.edges) - 1)
            on = self.edges[edge] == step
            word, start, node = word[on], start[on], self.targets[edge[on]]
            found[word, start, d] = self.ends[node]
        return found


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Logarithm of the sum of exponentials of equal-shaped arrays; -inf where all are."""
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    safe = np.where(np.isneginf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stacked - safe).sum(axis=0))


def _expected(words: list[str], counts: np.ndarray, pieces: _Pieces) -> tuple[np.ndarray, float]:
    """Expected uses of each piece over all segmentations of the words, and the log likelihood.

    Words of one length go forward and backward together. A word that no pieces spell counts for nothing.
    """
    used, likelihood = np.zeros(len(pieces.pieces)), 0.0
    lengths = np.array([len(w) for w in words])
    for size in np.unique(lengths[lengths > 0]):
        # bounds the places that are worked on at once
        same = np.flatnonzero(lengths == size)
        for some in np.array_split(same, -(-len(same) * int(size) // PLACES_AT_ONCE)):
            chars = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.int64)
            found = pieces.at(chars)
            score = np.where(found >= 0, pieces.scores[found], -np.inf)
            widest = found.shape[2]
            ahead, back = (np.full((size + 1, len(some)), -np.inf) for _ in range(2))
            ahead[0] = back[size] = 0.0
            for j in range(1, size + 1):
                ahead[j] = _log_sum([ahead[i] + score[:, i, j - i - 1] for i in range(max(0, j - widest), j)])
                i = size - j
                back[i] = _log_sum([back[k] + score[:, i, k - i - 1] for k in range(i + 1, min(size, i + widest) + 1)])
            spelled = ~np.isneginf(ahead[size])
            n = counts[some]
            likelihood += float((n[spelled] * ahead[size][spelled]).sum())
            whole = np.where(spelled, ahead[size], 0.0)
            for length in range(1, widest + 1):
                at = np.arange(size - length + 1)
                through = ahead[at].T + score[:, at, length - 1] + back[at + length].T - whole[:, None]
                here = (found[:, at, length - 1] >= 0) & spelled[:, None]
                used += np.bincount(found[:, at, length - 1][here], weights=(n[:, None] * np.exp(through))[here], minlength=len(used))
    return used, likelihood


LIKELIHOOD = "﷑"


def em_round(words: DataFrame, scores: dict[str, float]) -> DataFrame:
    """(piece, uses): expected uses summed over the word table; row ``LIKELIHOOD`` holds the log likelihood."""
    shared = words.sparkSession.sparkContext.broadcast(_Pieces(scores))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        used, likelihood = np.zeros(len(pieces.pieces)), 0.0
        for batch in batches:
            more, part = _expected(batch.column("token").to_pylist(), batch.column("n").to_numpy().astype(np.float64), pieces)
            used, likelihood = used + more, likelihood + part
        # a task passes on its sums, once
        some = np.flatnonzero(used > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(pieces.pieces[i] for i in some), LIKELIHOOD], pa.string()), pa.array(np.append(used[some], likelihood))], names=["piece", "uses"])

    return words.select("token", "n").mapInArrow(expect, "piece string, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))


def wide_round(words: DataFrame, held: DataFrame, pieces: DataFrame, alphabet: DataFrame) -> tuple[DataFrame, float]:
    """(piece, score) after a round of EM over any number of pieces, and the log likelihood entering it.

    ``words`` and ``held``, the pieces in them, lie in buckets; a bucket is given the scores of its own pieces only.
    """
    scored = held.join(pieces, "piece")

    def expect(rows: pa.Table, known: pa.Table) -> pa.Table:
        names, used, likelihood = [], np.zeros(0), 0.0
        if known.num_rows and rows.num_rows:
            table = _Pieces(dict(zip(known["piece"].to_pylist(), known["score"].to_pylist())))
            names = table.pieces
            used, likelihood = _expected(rows["token"].to_pylist(), rows["n"].to_numpy().astype(np.float64), table)
        some = np.flatnonzero(used > 0)
        return pa.table({"piece": pa.array([*(names[i] for i in some), LIKELIHOOD], pa.string()), "uses": pa.array(np.append(used[some], likelihood))})

    found = words.groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(expect, "piece string, uses double")
    counts = cut_lineage(found.groupBy("piece").agg(F.sum("uses").alias("uses")), "uses")
    kept = counts.where((F.col("piece") != LIKELIHOOD) & ((F.col("uses") >= 0.5) | (F.length("piece") == 1)))
    floor = alphabet.select(F.col("ch").alias("piece"), F.lit(1e-3).alias("uses"))
    kept = cut_lineage(kept.unionByName(floor).groupBy("piece").agg(F.max("uses").alias("uses")), "pieces")
    drop_shuffles(words.sparkSession)
    return scored_by_uses(kept), counts.where(F.col("piece") == LIKELIHOOD).first()["uses"]


def scored_by_uses(kept: DataFrame) -> DataFrame:
    total = kept.agg(F.sum("uses")).first()[0]
    return kept.select("piece", F.log(F.col("uses") / total).alias("score"))


def _held(words: DataFrame, pieces: DataFrame, max_chars: int) -> DataFrame:
    """(bucket, piece): the pieces inside the words of each bucket."""

    def inside(rows: pa.Table) -> pa.Table:
        found = {w[i:j] for w in rows["token"].to_pylist() for i in range(len(w)) for j in range(i + 1, min(len(w), i + max_chars) + 1)}
        return pa.table({"bucket": pa.array(np.full(len(found), rows["bucket"][0].as_py() if found else 0, np.int32)), "piece": pa.array(list(found), pa.string())})

    return words.groupBy("bucket").applyInArrow(inside, "bucket int, piece string").join(pieces.select("piece"), "piece", "left_semi")


def _likeliest(pieces: DataFrame, n: int) -> DataFrame:
    """The ``n`` likeliest pieces of several characters, of those alike the first, and all single characters."""
    several = pieces.where(F.length("piece") > 1).withColumn("__s", -F.col("score"))
    placed = ordered_scan(several, [], ["__s", "piece"], [F.floor(F.col("__s") * 64)], __i=("number",))
    return placed.where(F.col("__i") <= n).select("piece", "score").unionByName(pieces.where(F.length("piece") == 1))


def train_unigram(
    vocab: DataFrame,
    size: int,
    seed_size: int | None = None,
    rounds: int = 2,
    shrink: float = 0.75,
    max_chars: int = 16,
    coverage: float = CHARACTER_COVERAGE,
) -> tuple[DataFrame, list[float]]:
    """Unigram pieces (piece_id, piece, score) from a (token, n) word table, and the log likelihoods.

    Words, not sentences, are the rows: each EM round reads the word table
    once. It starts from all substrings that occur twice, or the best ``seed_size`` of them. While there are more than
    SHARED_PIECES, they stay in tables and are dealt with the words (``wide_round``); fewer go through the driver.
    Single characters are never pruned; what coverage leaves out is
    spelled in bytes when encoding. Ids: specials, user symbols, 256 byte
    pieces, then pieces by falling score.
    """
    spark = vocab.sparkSession
    reserved = [*SPECIALS, *USER_SYMBOLS, *[f"<0x{b:02X}>" for b in range(256)]]
    room = size - len(reserved)
    words = cut_lineage(marked_words(vocab).repartition(spark.sparkContext.defaultParallelism, "token"))
    chars = kept_characters(words, coverage)
    alphabet = {r.ch for r in chars.select("ch").collect()}
    if room < len(alphabet):
        raise ValueError(f"size {size} cannot hold {len(reserved)} reserved pieces and {len(alphabet)} characters")
    seeds = seed_substrings(words, max_chars)
    if seed_size is not None:
        seeds = seeds.orderBy(F.desc("score"), "piece").limit(seed_size)
    pieces = scored_by_uses(cut_lineage(seeds.select("piece", F.col("n").cast("double").alias("uses")).unionByName(
        chars.select(F.col("ch").alias("piece"), F.col("n").cast("double").alias("uses"))
    ), "pieces"))
    drop_shuffles(spark)

    def shared() -> dict[str, float] | None:
        """Scores of the pieces if they are few enough to be shared."""
        return None if pieces.count() > SHARED_PIECES else {r.piece: r.score for r in pieces.collect()}

    scores = shared()
    if scores is None:
        letters = spark.createDataFrame([(c,) for c in sorted(alphabet)], "ch string")
        buckets = words.count() // BUCKET_WORDS + 1
        dealt = words.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        held = cut_lineage(_held(dealt, pieces, max_chars), "held")
        drop_shuffles(spark)
    history: list[float] = []
    target = room - len(alphabet)
    while True:
        for _ in range(rounds):
            if scores is None:
                pieces, likelihood = wide_round(dealt, held, pieces, letters)
                history.append(likelihood)
                scores = shared()
                continue
            uses = em_round(words, scores)
            counts = {r.piece: r.uses for r in uses.collect()}
            history.append(counts.pop(LIKELIHOOD))
            kept = {p: u for p, u in counts.items() if u >= 0.5 or p in alphabet}
            kept.update({c: max(kept.get(c, 0.0), 1e-3) for c in alphabet})
            total = sum(kept.values())
            scores = {p: math.log(u / total) for p, u in kept.items()}
        if scores is None:
            many = pieces.where(F.length("piece") > 1).count()
            if many <= target:
                break
            keep = max(target, int(many * shrink))
            pieces = cut_lineage(_likeliest(pieces, keep), "pieces")
            scores = shared()
        else:
            multi = sorted((p for p in scores if p not in alphabet), key=lambda p: (-scores[p], p))
            if len(multi) <= target:
                break
            keep = max(target, int(len(multi) * shrink))
            scores = {p: scores[p] for p in [*multi[:keep], *alphabet]}
        if keep == target:
            break
    if scores is None:
        # no more than ``size`` are left
        scores = {r.piece: r.score for r in pieces.collect()}
    ordered = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))
    rows = [(i, p, 0.0) for i, p in enumerate(reserved)]
    rows += [(len(reserved) + i, p, float(s)) for i, (p, s) in enumerate(ordered)]
    return spark.createDataFrame(rows, "piece_id int, piece string, score double"), history


# ---------------------------------------------------------------- encoding

def _best_path(word: str, scores: dict[str, float], longest: int, penalty: float) -> list[str]:
    """The highest-scoring pieces; a character no piece covers becomes its UTF-8 byte pieces."""
    best = [(-math.inf, 0, ())] * (len(word) + 1)
    best[0] = (0.0, 0, ())
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            s = scores.get(word[i:j])
            if s is not None and best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, i, (word[i:j],))
        if best[j][0] == -math.inf:
            spelled = tuple(f"<0x{b:02X}>" for b in word[j - 1].encode("utf-8"))
            best[j] = (best[j - 1][0] + penalty, j - 1, spelled)
    out: list[str] = []
    at = len(word)
    while at:
        out[:0] = best[at][2]
        at = best[at][1]
    return out


def encoder(vocab: DataFrame):
    """Column function text -> (pieces, ids) for a checked, broadcast vocabulary.

    Encoding stays inside the row: no token ever crosses a shuffle, and each
    task remembers the words it has already split, of which each is split once for both.
    """
    rows = vocab.select("piece_id", "piece", "score").limit(MAX_BROADCAST_PIECES + 1).collect()
    if len(rows) > MAX_BROADCAST_PIECES:
        raise ValueError(f"more than {MAX_BROADCAST_PIECES} pieces")
    ids = {r.piece: r.piece_id for r in rows}
    hidden = {*SPECIALS, *USER_SYMBOLS, *[f"<0x{b:02X}>" for b in range(256)]}
    scores = {r.piece: r.score for r in rows if r.piece not in hidden}
    shared = vocab.sparkSession.sparkContext.broadcast(
        (ids, scores, max(map(len, scores)), min(scores.values()) - 10.0)
    )

    @F.pandas_udf("pieces array<string>, ids array<int>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, table, longest, penalty = shared.value
        memo: dict = {}
        for texts in batches:
            pieces, numbers = [], []
            for text in texts:
                if text is None:
                    pieces.append(None)
                    numbers.append(None)
                    continue
                out: list[str] = []
                for word in text.split():
                    if word not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[word] = _best_path(SPACE_MARK + word, table, longest, penalty)
                    out += memo[word]
                pieces.append(out)
                numbers.append([known.get(p, UNK_ID) for p in out])
            yield pd.DataFrame({"pieces": pieces, "ids": numbers})

    return split


def encode(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pieces`` and ``ids``."""
    both = df.withColumn("__e", encoder(vocab)(text))
    return both.withColumn("pieces", F.col("__e.pieces")).withColumn("ids", F.col("__e.ids")).drop("__e")


def tokeniser_report(encoded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fertility and unknown rate from rows (n, n_pieces, n_unk): a word, how often, its pieces."""
    sums = encoded.groupBy(*(by or [])).agg(
        F.sum("n").alias("words"),
        F.sum(F.col("n") * F.col("n_pieces")).alias("pieces"),
        F.sum(F.col("n") * F.col("n_unk")).alias("unks"),
    )
    return sums.withColumn("fertility", F.coalesce(F.try_divide("pieces", "words"), F.lit(0.0))).withColumn(
        "unk_rate", F.coalesce(F.try_divide("unks", "pieces"), F.lit(0.0))
    )


def choose_vocab(report: DataFrame) -> DataFrame:
    """One row (vocab_size, fertility, reason): two or more healthy -> the smallest of them, one -> it, none -> nearest the middle."""
    lo, hi = FERTILITY_RANGE
    healthy = F.col("fertility").between(lo, hi)
    row = F.struct("vocab_size", "fertility")
    one = report.agg(
        F.count_if(healthy).alias("k"),
        F.min_by(row, F.when(healthy, F.col("vocab_size"))).alias("small"),
        F.min_by(row, F.struct(F.abs(F.col("fertility") - FERTILITY_MIDDLE), "vocab_size")).alias("near"),
    )
    pick = F.when(F.col("k") >= 1, F.col("small")).otherwise(F.col("near"))
    why = F.when(F.col("k") >= 2, "several_in_range").when(F.col("k") == 1, "one_in_range").otherwise("nearest_middle")
    return one.select(pick["vocab_size"].alias("vocab_size"), pick["fertility"].alias("fertility"), why.alias("reason"))


# ---------------------------------------------------------------- joint ids

# The six shared ids of the joint space and the native ids each side gives up.
JOINT_SPECIALS = ("<pad>", "<unk>", "<s>", "</s>", "<2b>", "<2a>")
TO_B_ID, TO_A_ID = 4, 5
NATIVE_SPECIALS = 4


def joint_offsets(size_a: int) -> dict[str, int]:
    return {"a": len(JOINT_SPECIALS), "b": len(JOINT_SPECIALS) + size_a - NATIVE_SPECIALS}


def joint_vocab(a: DataFrame, b: DataFrame) -> DataFrame:
    """(joint_id, side, native_id, piece): shared specials, then a's pieces, then b's."""
    spark = a.sparkSession
    specials = spark.createDataFrame(
        [(i, "special", None, p) for i, p in enumerate(JOINT_SPECIALS)], "joint_id int, side string, native_id int, piece string"
    )
    offsets = joint_offsets(a.count())
    side = lambda df, name: df.where(F.col("piece_id") >= NATIVE_SPECIALS).select(
        (F.col("piece_id") - NATIVE_SPECIALS + offsets[name]).cast("int").alias("joint_id"),
        F.lit(name).alias("side"), F.col("piece_id").cast("int").alias("native_id"), "piece",
    )
    return specials.unionByName(side(a, "a")).unionByName(side(b, "b"))


def to_joint(ids: Column | str, offset: int) -> Column:
    """Native ids in the joint space; a native special becomes unknown."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(ids, lambda i: F.when(i < NATIVE_SPECIALS, UNK_ID).otherwise(i - NATIVE_SPECIALS + offset).cast("int"))


def _spell(pieces: list[str]) -> str:
    """Pieces as text, with runs of byte pieces put back together as UTF-8."""
    out, held = [], bytearray()
    for piece in pieces:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            held.append(int(piece[3:5], 16))
            continue
        out.append(held.decode("utf-8", "replace"))
        held.clear()
        out.append(piece)
    out.append(held.decode("utf-8", "replace"))
    return "".join(out).replace(SPACE_MARK, " ").lstrip(" ")


def decode_ids(df: DataFrame, joint: DataFrame, key: list[str], ids: str = "ids", side: str = "side") -> DataFrame:
    """(key, text, dropped): the row's side decides which ids are pieces.

    Shared specials are skipped, ids of the other side dropped and counted,
    and a row left without pieces reads ``(empty output)``. The vocabulary is
    checked and broadcast, so no id crosses a shuffle.
    """
    rows = joint.select("joint_id", "side", "piece").limit(MAX_BROADCAST_PIECES + 1).collect()
    if len(rows) > MAX_BROADCAST_PIECES:
        raise ValueError(f"more than {MAX_BROADCAST_PIECES} pieces")
    sides: dict[str, dict[int, str]] = {}
    for r in rows:
        sides.setdefault(r.side, {})[r.joint_id] = r.piece
    shared = joint.sparkSession.sparkContext.broadcast(sides)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = shared.value
        for batch in batches:
            long = pc.fill_null(pc.list_value_length(batch.column("__ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = (np.cumsum(long) - long) // DECODED_AT_ONCE
            borders = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for i, j in zip(borders, borders[1:]):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                texts, dropped = [], []
                for mine, sequence in zip(part.column("__side").to_pylist(), part.column("__ids")):
                    known = sides.get(mine, {})
                    content = [x for x in sequence.values.to_numpy(zero_copy_only=False).tolist() if x >= len(JOINT_SPECIALS)]
                    pieces = [p for p in map(known.get, content) if p is not None]
                    texts.append(_spell(pieces) if pieces else "(empty output)")
                    dropped.append(len(content) - len(pieces))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in key), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=[*key, "text", "dropped"])

    placed = df.select(*key, F.col(side).alias("__side"), F.col(ids).alias("__ids"))
    types = {f.name: f.dataType.simpleString() for f in placed.schema}
    return placed.mapInArrow(decode, ", ".join(f"`{k}` {types[k]}" for k in key) + ", text string, dropped long")


def decoded_text(text: Column | str, dropped: Column | str) -> Column:
    """Decoded text with the note on dropped ids behind two spaces."""
    text, dropped = (F.col(c) if isinstance(c, str) else c for c in (text, dropped))
    note = F.format_string("  [%d out-of-range token(s) dropped]", dropped)
    return F.when(dropped > 0, F.concat(text, note)).otherwise(text)


# ---------------------------------------------------------------- examples

def wrap(ids: Column | str, max_len: int, begin: int = BOS_ID, end: int = EOS_ID) -> Column:
    """Begin and end ids around the sequence, cut at ``max_len`` as a whole."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end))), F.lit(1), F.lit(max_len))


def pad(ids: Column, width: Column, filler: int = PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(filler), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def pack(df: DataFrame, ids: str = "ids", max_len: int = 128, bucket: int = 16) -> DataFrame:
    """Wrapped, cut and padded ``input`` with its ``attention`` mask.

    Rows are padded to the next multiple of ``bucket`` (at most ``max_len``):
    rows of one length bucket form batches of equal width without any shuffle.
    """
    wrapped = wrap(ids, max_len)
    width = F.least(F.ceil(F.size(wrapped) / bucket) * bucket, F.lit(max_len))
    out = df.withColumn("input", pad(wrapped, width))
    return out.withColumn("attention", F.transform("input", lambda i: F.when(i == PAD_ID, 0).otherwise(1)))


IGNORED_LABEL = -100


def mask_examples(
    df: DataFrame,
    key: list[str],
    vocab_size: int,
    mask_id: int,
    ids: str = "input",
    seed: int = 42,
    epoch: int = 0,
    probability: float = 0.15,
    mask_ratio: float = 0.8,
    random_ratio: float = 0.1,
) -> DataFrame:
    """Add ``masked`` and ``labels``; the draws depend on key, position, seed and epoch only.

    Padding, begin and end ids are never chosen. Of the chosen positions,
    ``mask_ratio`` become the mask, ``random_ratio`` a random id from 4 up,
    the rest stay.
    """
    stamp = f"{seed}:{epoch}"
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    draw = lambda pos, what: uniform(name, pos.cast("string"), seed=f"{stamp}:{what}")
    special = lambda i: i.isin(PAD_ID, BOS_ID, EOS_ID)
    chosen = F.transform(ids, lambda i, p: (~special(i)) & (draw(p, "pick") < probability))
    steps = df.withColumn("__chosen", chosen)
    masked = F.transform(ids, lambda i, p: F.when(
        ~F.get("__chosen", p), i
    ).when(draw(p, "kind") < mask_ratio, F.lit(mask_id)).when(
        draw(p, "kind") < mask_ratio + random_ratio,
        (F.floor(draw(p, "id") * (vocab_size - 4)) + 4).cast("int"),
    ).otherwise(i))
    labels = F.transform(ids, lambda i, p: F.when(F.get("__chosen", p), i).otherwise(IGNORED_LABEL))
    return steps.withColumn("masked", masked).withColumn("labels", labels).drop("__chosen")


def shift_examples(df: DataFrame, ids: str = "input") -> DataFrame:
    """Next-token ``source`` (all but the last id) and ``labels`` (all but the first, padding ignored)."""
    body = F.size(ids) - 1
    labels = F.transform(F.slice(ids, F.lit(2), F.greatest(body, F.lit(0))), lambda i: F.when(i == PAD_ID, IGNORED_LABEL).otherwise(i))
    return df.withColumn("source", F.slice(ids, F.lit(1), F.greatest(body, F.lit(0)))).withColumn("labels", labels)


def bilingual_examples(pairs: DataFrame, size_a: int, max_len: int, source: str = "source_ids", target: str = "target_ids") -> DataFrame:
    """Direction-tagged ``src`` and wrapped ``tgt`` in the joint space from doubled pairs of native ids.

    ``direction`` is a2b or b2a; both sequences are cut at ``max_len``.
    """
    offsets = joint_offsets(size_a)
    forward = F.col("direction") == "a2b"
    first = F.when(forward, to_joint(source, offsets["a"])).otherwise(to_joint(source, offsets["b"]))
    second = F.when(forward, to_joint(target, offsets["b"])).otherwise(to_joint(target, offsets["a"]))
    tag = F.when(forward, TO_B_ID).otherwise(TO_A_ID)
    return pairs.withColumn("src", F.slice(F.concat(F.array(tag), first), F.lit(1), F.lit(max_len))).withColumn(
        "tgt", wrap(second, max_len)
    )
