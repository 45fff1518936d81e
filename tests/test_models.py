import collections
import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import joins as J
from lexiloom.operators import metrics as Q
from lexiloom.operators import mining as M
from lexiloom.operators import ngrams as L
from lexiloom.operators import parallel as A
from lexiloom.operators import profile as P
from lexiloom.operators import pronounce as G
from lexiloom.operators import splits as S
from lexiloom.operators import subword as U
from lexiloom.operators import vectors as E


# ---- pronunciation

def test_pronunciations(spark):
    words = ["अन्‍काल", "अब्राहाम", "लोव़", "कं", "अः", "का?ख@", "्क", "़", "कंं", "क्ं", "ं", "क़्", "का्"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: (r.phones, [(u.idx, u.ch) for u in r.unmapped]) for r in G.pronounce(df).collect()}
    assert got["अन्‍काल"] == (["a", "n", "k", "aa", "l", "a"], [])
    assert got["अब्राहाम"] == (["a", "b", "r", "aa", "h", "aa", "m", "a"], [])
    assert got["लोव़"] == (["l", "o", "vQ", "a"], [])
    assert got["कं"] == (["k", "aN"], [])
    assert got["अः"] == (["a", "H"], [])
    assert got["का?ख@"] == (None, [(2, "?"), (4, "@")])
    assert got["्क"] == (None, [(0, "्")])
    assert got["़"] == (None, [(0, "़")])
    assert got["कंं"] == (["k", "aN", "N"], [])
    assert got["क्ं"] == (["k", "N"], [])
    assert got["ं"] == (["N"], [])
    assert got["क़्"] == (["kQ"], [])
    assert got["का्"] == (None, [(2, "्")])
    spoken = G.pronounce(df)
    G.check_no_leak(spoken)
    assert G.unmapped_report(spoken.where("word = 'का?ख@'")).first().chars == "U+003F(?)@2, U+0040(@)@4"
    assert G.lexicon_summary(spoken).first().mapped == 9


# ---- parallel corpus

def test_marks_far_from_their_consonant(spark):
    """A virama belongs to its consonant however many joiners stand between them, and to none after another virama."""
    words = ["\u0915" + "\u200d" * 250 + "\u094d", "\u0915\u094d\u094d", "\u094d\u0915"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")
    rules = G.DEVANAGARI_SOUNDS
    bad = {r.i: [u.idx for u in r.u] for r in df.select("i", G.unmapped("word", rules).alias("u")).collect()}
    assert bad == {0: [], 1: [2], 2: [0]}


def test_verse_units(spark):
    lines = [
        r"\id ACT x", r"\c 1", "stray", r"\p", r"\v 1 one \em note\em* here", "wrapped \\bd strong\\bd* line", r"\v 2-3 bridge",
        r"\s1 head", r"\c 2", r"\v 1 next",
    ]
    df = spark.createDataFrame([("f", i, l) for i, l in enumerate(lines)], "file string, line_no long, line string")
    for chunk in (2, 1000):
        rows = A.verse_units(df, "a", chunk).orderBy("chapter", "verse_from").collect()
        assert [tuple(r) for r in rows] == [
            ("ACT", 1, 1, 1, "one  here wrapped  strong line"), ("ACT", 1, 2, 3, "bridge"), ("ACT", 2, 1, 1, "next")]
    verses = A.expand_bridges(A.verse_units(df, "a"))
    assert sorted((r.chapter, r.verse) for r in verses.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_ratio_bounds(spark):
    rows = [(1, "a" * 29, "b" * 100), (2, "a" * 30, "b" * 100), (3, "a" * 300, "b" * 100), (4, "a" * 301, "b" * 100)]
    kept, out = A.ratio_filter(spark.createDataFrame(rows, "id int, a_text string, b_text string"))
    assert sorted(r.id for r in kept.collect()) == [2, 3] and sorted(r.id for r in out.collect()) == [1, 4]


def brute(a, b, c, s2):
    """Least cost by trying every chain."""
    fee = {k: -math.log(p) for k, p in A.PRIORS.items()}
    def cost(i, j):
        if i == len(a) and j == len(b):
            return 0.0
        best = math.inf
        for (di, dj), f in fee.items():
            if i + di <= len(a) and j + dj <= len(b):
                x, y = np.array([float(sum(a[i:i + di]))]), np.array([float(sum(b[j:j + dj]))])
                best = min(best, f + A._match_cost(x, y, c, s2)[0] + cost(i + di, j + dj))
        return best
    return cost(0, 0)


@pytest.mark.parametrize("a, b", [([20, 30], [52]), ([10], [4, 7]), ([5, 50, 8], [52]), ([], [4, 5]), ([9], []), ([12, 33, 40, 9], [11, 35, 20, 22, 10])])
def test_alignment_is_optimal(a, b):
    chain = A.align_lengths(a, b, 1.03, 9.5)
    total, at = 0.0, (0, 0)
    for i0, i1, j0, j1 in chain:
        assert (i0, j0) == at
        at = (i1, j1)
        x, y = np.array([float(sum(a[i0:i1]))]), np.array([float(sum(b[j0:j1]))])
        total += -math.log(A.PRIORS[i1 - i0, j1 - j0]) + A._match_cost(x, y, 1.03, 9.5)[0]
    assert at == (len(a), len(b)) and total == pytest.approx(brute(a, b, 1.03, 9.5))


def test_align_sentences(spark):
    rows = [(1, ["aaa", "bb"], ["xxx", "yy"]), (2, ["a" * 20, "b" * 30], ["x" * 52]), (3, [], ["only"])]
    df = spark.createDataFrame(rows, "v int, a_sentences array<string>, b_sentences array<string>")
    out = A.align_sentences(df, ["v"], 1.0, 9.0)
    got = sorted((r.v, r.pos, r.alignment_type) for r in out.collect())
    assert got == [(1, 0, "1:1"), (1, 1, "1:1"), (2, 0, "2:1"), (3, 0, "0:1")]
    assert A.unmatched(out).count() == 1 and A.matched(out).where("v = 2").first().a_sentence == "a" * 20 + " " + "b" * 30


def test_word_alignment_learns_and_improves(spark):
    rows = [(1, ["the", "house"], ["das", "haus"]), (2, ["the", "book"], ["das", "buch"]), (3, ["a", "book"], ["ein", "buch"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    cells = A.alignment_cells(df, ["id"], F.col("a"), F.col("b"))
    table, history = A.translation_table(cells, ["id"], 5)
    assert all(y >= x - 1e-9 for x, y in zip(history, history[1:]))
    best = {r.s: r.t for r in table.groupBy("s").agg(F.max_by("t", "p").alias("t")).collect()}
    assert best == {"the": "das", "house": "haus", "book": "buch", "a": "ein"}
    links = {(r.source, r.target): r.frequency for r in A.best_links(cells, table, ["id"]).collect()}
    assert links == {("the", "das"): 2, ("house", "haus"): 1, ("book", "buch"): 2, ("a", "ein"): 1}


def test_word_alignment_in_buckets_equals_joins(spark, monkeypatch):
    rng = random.Random(3)
    side = lambda letter, n: [f"{letter}{min(rng.randrange(1, 40), rng.randrange(1, 40))}" for _ in range(n)]
    rows = [(i, side("s", rng.randrange(1, 9)), side("t", rng.randrange(1, 30))) for i in range(120)]
    rows += [(200, [], ["t1"]), (201, ["s1"], []), (202, None, ["t1"]), (203, ["s1"] * 30, ["t1"] * 30), (204, ["é", "z"], ["\U0001f600", "z"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    cells = A.alignment_cells(df, ["id"], F.col("a"), F.col("b")).cache()
    table, likelihood = A.translation_table(cells, ["id"], 3)
    expected = {(r.source, r.target): r.frequency for r in A.best_links(cells, table, ["id"]).collect()}
    written, keep = [], A.cut_lineage

    def recorded(frame, name="stage"):
        written.append((name, keep(frame, name)))
        return written[-1][1]

    monkeypatch.setattr(A, "cut_lineage", recorded)
    for size, cut, many in ((1 << 21, 1 << 20, False), (2000, 12, True)):
        written.clear()
        links, history = A.align_words(df, ["id"], F.col("a"), F.col("b"), 3, size, cut)
        assert {(r.source, r.target): r.frequency for r in links.collect()} == expected
        assert history == pytest.approx(likelihood)
        rounds = [frame for name, frame in written if name == "round"]
        assert len(rounds) == 3 and (rounds[0].select("bucket").distinct().count() > 1) == many
        # only word pairs that several buckets have are sent again
        sent = rounds[0].where("t IS NOT NULL").groupBy("s", "t").count()
        several = sent.where("count > 1").agg(F.sum("count")).first()[0] or 0
        assert [r.where("t IS NOT NULL").count() for r in rounds[1:]] == [several] * 2
    empty = df.where("id = 202")
    links, history = A.align_words(empty, ["id"], F.col("a"), F.col("b"), 3)
    assert links.count() == 0 and history == [None, None]


def test_turns_are_split_once_for_alignment(spark):
    from lexiloom.plans import parallel_queries as P

    plan = P.aligned(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "Join" not in plan


def test_lexicon(spark):
    pairs = spark.createDataFrame([("a", "x", 5), ("b", "y", 3), ("c", "z", 2), (",", "।", 9), (",", "w", 3), ("d", "q", 1)], "source string, target string, frequency long")
    ref = spark.createDataFrame([("a", ["x"]), ("b", ["n"]), ("h", ["i"])], "headword string, glosses array<string>")
    assert {(r.threshold, r.pairs) for r in A.threshold_sweep(pairs).collect()} == {(2, 4), (3, 3), (5, 1)}
    kept = A.filter_lexicon(pairs)
    assert {r.source: r.status for r in J.judge_lexicon(kept, ref).collect()} == {"a": "agree", "b": "disagree", ",": "not_in_ref"}
    q = A.lexicon_quality(kept, ref).first()
    assert (q.pairs, q.in_reference, q.agree, q.precision_pct, q.headwords, q.covered) == (3, 2, 1, 50.0, 3, 2)


def test_scores(spark):
    rows = [("d", 1, "the cat sat on the mat .", "the cat sat on the mat ."), ("e", 1, "abc def", "xyz uvw"), ("f", 1, "the cat sat on mat  [1 out-of-range token(s) dropped]", "the cat sat on the mat")]
    df = spark.createDataFrame(rows, "direction string, id int, hyp string, ref string")
    bleu = {r.direction: r.bleu for r in A.corpus_bleu(df, ["direction", "id"]).collect()}
    chrf = {r.direction: r.chrf for r in A.corpus_chrf(df, ["direction", "id"]).collect()}
    assert bleu["d"] == pytest.approx(100) and chrf["d"] == pytest.approx(100)
    assert bleu["e"] == 0 and chrf["e"] == 0
    # precisions 5/5, 3/4, 2/3, 1/2 and brevity exp(1 - 6/5)
    assert bleu["f"] == pytest.approx(100 * math.exp(1 - 6 / 5) * (1 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    short = spark.createDataFrame([(1, "the cat", "the cat")], "id int, hyp string, ref string")
    assert A.sentence_scores(short, ["id"]).first().bleu == pytest.approx(100)
    assert A.direction_average(spark.createDataFrame([(2.0,), (4.0,)], "bleu double"), ["bleu"]).first().bleu == 3.0


def test_ngrams_are_counted_inside_the_row(spark):
    rng = random.Random(5)
    line = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, line("ab c", i), line("ab d", 40 - i)) for i in range(40)] + [(40, None, "abc"), (41, "", ""), (42, "é\U0001f600é x", "x é\U0001f600"), (43, None, None)]
    # so many characters that six of them and the row do not fit 63 bits
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    rows += [(50 + i, many[:500 * i] + line(many, 300), many[200:] + line("ab", 9)) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, hyp string, ref string")

    def brute(a, b, n):
        grams = lambda x: Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))
        x, y = grams(a), grams(b)
        return sum((x & y).values()), sum(x.values()), sum(y.values())

    for hyp, ref, split, orders in (
        (A.score_characters("hyp"), A.score_characters("ref"), lambda t: "".join((t or "").split()), 6),
        (T.tokens("hyp"), T.tokens("ref"), lambda t: (t or "").split(), 4),
    ):
        out = A.ngram_overlap(df, ["id"], hyp, ref, orders)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
        got = {r.id: list(zip(r.m, r.h, r.r)) for r in out.collect()}
        assert got == {i: [brute(split(a), split(b), n) for n in range(1, orders + 1)] for i, a, b in rows}


def test_tokeniser_13a(spark):
    df = spark.createDataFrame([("It's 3.5, or 1,000-2 (ok).\nNew&quot;line",)], "t string")
    assert df.select(A.score_tokens("t").alias("x")).first().x == ["It's", "3.5", ",", "or", "1,000", "-", "2", "(", "ok", ")", ".", "New", '"', "line"]


# ---- subwords and examples

def test_unigram_training(spark):
    words = [("unhappy", 10), ("happy", 20), ("unhappily", 5), ("happily", 9), ("undo", 8), ("do", 30)]
    vocab = spark.createDataFrame(words, "token string, n long")
    pieces, history = U.train_unigram(vocab, 290, seed_size=60, rounds=3)
    assert pieces.count() <= 290 and all(math.isfinite(h) for h in history)
    assert [r.piece for r in pieces.orderBy("piece_id").limit(6).collect()] == ["<pad>", "<unk>", "<s>", "</s>", "[MASK]", "[PAD]"]
    text = spark.createDataFrame([(1, "unhappily undo é")], "id int, text string")
    row = U.encode(text, pieces).first()
    assert "".join(row.pieces).startswith("▁unhappily▁undo") and row.pieces[-2:] == ["<0xC3>", "<0xA9>"]
    assert U.UNK_ID not in row.ids


def test_em_likelihood_does_not_fall(spark):
    words = spark.createDataFrame([("▁abab", 5), ("▁ab", 9), ("▁ba", 4)], "token string, n long")
    scores = {p: math.log(1 / 6) for p in ("▁", "a", "b", "ab", "ba", "▁ab")}
    history = []
    for _ in range(4):
        used = {r.piece: r.uses for r in U.em_round(words, scores).collect()}
        history.append(used.pop(U.LIKELIHOOD))
        total = sum(used.values())
        scores = {p: math.log(u / total) for p, u in used.items() if u > 0}
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))


@pytest.mark.parametrize("report, want", [
    ([(8000, 3.0), (16000, 2.6)], (8000, "several_in_range")), ([(8000, 4.4), (16000, 3.9)], (16000, "one_in_range")),
    ([(8000, 1.36), (16000, 1.2)], (8000, "nearest_middle")), ([(4000, 4.6), (8000, 3.0), (16000, 2.6)], (8000, "several_in_range")),
])
def test_choose_vocab(spark, report, want):
    row = U.choose_vocab(spark.createDataFrame(report, "vocab_size int, fertility double")).first()
    assert (row.vocab_size, row.reason) == want


def test_joint_ids(spark, monkeypatch):
    side = lambda ps: spark.createDataFrame([(i, p) for i, p in enumerate(["<pad>", "<unk>", "<s>", "</s>", *ps])], "piece_id int, piece string")
    joint = U.joint_vocab(side(["▁a", "b"]), side(["▁x"]))
    assert [(r.joint_id, r.side, r.piece) for r in joint.where("joint_id > 5").orderBy("joint_id").collect()] == [(6, "a", "▁a"), (7, "a", "b"), (8, "b", "▁x")]
    rows = [(1, "a", [6, 7, 8, 3, 6]), (2, "b", [6, 7]), (3, "b", [8]), (4, "a", [])]
    got = U.decode_ids(spark.createDataFrame(rows, "id int, side string, ids array<int>"), joint, ["id"]).orderBy("id").collect()
    assert [(r.text, r.dropped) for r in got] == [("ab a", 1), ("(empty output)", 2), ("x", 0), ("(empty output)", 0)]
    monkeypatch.setattr(U, "DECODED_AT_ONCE", 3)
    assert U.decode_ids(spark.createDataFrame(rows, "id int, side string, ids array<int>").coalesce(1), joint, ["id"]).orderBy("id").collect() == got
    df = spark.createDataFrame([("a2b", [4, 5, 1], [4])], "direction string, source_ids array<int>, target_ids array<int>")
    row = U.bilingual_examples(df, 6, 10).first()
    assert row.src == [4, 6, 7, 1] and row.tgt == [2, 8, 3]


def test_examples(spark):
    df = spark.createDataFrame([(1, [7, 8, 9]), (2, []), (3, list(range(10, 40)))], "key int, ids array<int>")
    packed = U.pack(df, max_len=16, bucket=8)
    rows = {r.key: r for r in packed.collect()}
    assert rows[1].input == [2, 7, 8, 9, 3, 0, 0, 0] and rows[1].attention == [1] * 5 + [0] * 3
    assert rows[2].input == [2, 3] + [0] * 6 and rows[3].input == [2, *range(10, 25)]
    shifted = {r.key: r for r in U.shift_examples(packed).collect()}
    assert shifted[1].source == [2, 7, 8, 9, 3, 0, 0] and shifted[1].labels == [7, 8, 9, 3, -100, -100, -100]
    many = spark.range(400).select(F.col("id").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i + 10).alias("input"))
    one = U.mask_examples(many, ["key"], 1000, 4)
    flat = one.select(F.explode(F.arrays_zip("input", "masked", "labels")).alias("x")).select("x.*")
    share = flat.agg(F.avg((F.col("labels") != -100).cast("int")), F.avg(F.when(F.col("labels") != -100, (F.col("masked") == 4).cast("int")))).first()
    assert share[0] == pytest.approx(0.15, abs=0.01) and share[1] == pytest.approx(0.8, abs=0.03)
    assert flat.where("labels = -100 AND masked <> input").count() == 0 and flat.where("labels <> -100 AND labels <> input").count() == 0
    assert one.exceptAll(U.mask_examples(many.repartition(17), ["key"], 1000, 4)).count() == 0
    assert one.exceptAll(U.mask_examples(many, ["key"], 1000, 4, epoch=1)).count() > 0


# ---- vectors, language model, mining, metrics, splits

def test_composed_vectors(spark):
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("cats", [0.0, 1.0])], "word string, vec array<double>")
    counts = spark.createDataFrame([("cat", 3), ("cats", 1)], "token string, n long")
    asked = spark.createDataFrame([("cats",), ("zzz",)], "word string")
    got = {r.word: r.vec for r in E.compose_vectors(asked, vectors, counts, 3, 3).collect()}
    # n-grams of <cats>: <ca, cat shared (3/4, 1/4), ats, ts> its own
    assert got == {"cats": pytest.approx([0.375, 0.625])}


def test_composed_in_buckets_of_words(spark, monkeypatch):
    # n-grams summed two words at a time, asked words in buckets: as computed plainly
    monkeypatch.setattr(E, "COMPOSED_WORDS", 3)
    monkeypatch.setattr(E, "WORDS_AT_ONCE", 2)
    rng = np.random.default_rng(7)
    known = {w: (rng.normal(size=3), int(rng.integers(1, 9))) for w in ["cat", "cats", "chat", "hat", "that", "héé", "aaaa"]}
    asked = ["cats", "hats", "aaaaa", "é", "zzzz", "chatty", "tha", "at"]
    grams = lambda w: {f"<{w}>"[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n)}
    weight, total = {}, {}
    for w, (v, n) in known.items():
        for g in grams(w):
            weight[g], total[g] = weight.get(g, 0) + n, total.get(g, 0) + n * v
    want = {w: np.mean([total[g] / weight[g] for g in grams(w) if g in total], axis=0) for w in asked if any(g in total for g in grams(w))}
    vectors = spark.createDataFrame([(w, v.tolist()) for w, (v, _) in known.items()], "word string, vec array<double>").coalesce(1)
    counts = spark.createDataFrame([(w, n) for w, (_, n) in known.items()], "token string, n long")
    out = E.compose_vectors(spark.createDataFrame([(w,) for w in [*asked, "cats"]], "word string"), vectors, counts, 2, 3)
    got = [(r.word, r.vec) for r in out.collect()]
    assert len(got) == len(want) and "zzzz" not in want
    assert dict(got) == {w: pytest.approx(v.tolist()) for w, v in want.items()}


def test_vectors_trained_in_shards(spark, monkeypatch):
    from lexiloom.operators import skipgram

    # two topics whose words never meet; the word said once is left out, null and empty texts have none
    rng = np.random.default_rng(5)
    topics = [[f"{t}{i}" for i in range(6)] for t in "ab"]
    texts = [(" ".join(rng.choice(topics[i % 2], 30)),) for i in range(400)] + [("once a0 b0",), (None,), ("",)]
    df = spark.createDataFrame(texts, "text string")
    monkeypatch.setattr(skipgram, "SHARD_WORDS", 4000)
    got = {r.word: r.vec for r in E.train_vectors(df, dim=8, iterations=3, partitions=2).collect()}
    assert set(got) == {w for t in topics for w in t}
    vec = {w: np.array(v) / np.linalg.norm(v) for w, v in got.items()}
    inside = np.mean([vec[p] @ vec[q] for t in topics for p in t for q in t if p != q])
    across = np.mean([vec[p] @ vec[q] for p in topics[0] for q in topics[1]])
    assert inside > across + 0.5


def test_shard_pairs_stay_inside_a_text():
    from lexiloom.operators import skipgram

    # a word alone in its text has no pair, so only the noise side could move it, and that starts at zero
    first = np.ones((3, 4), np.float32)
    second = np.zeros_like(first)
    skipgram.train_shard(np.array([0, 1, 1, 2]), np.array([0, 1, 1, 2]), first, second, 5, [1], 0.0, 1.0)
    assert (first[[0, 2]] == 1).all() and np.abs(second[1]).max() > 0


def test_nearest_in_slices(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 5))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "word int, vec array<double>").repartition(5)
    queries = vectors.where("word < 10").withColumnRenamed("word", "query")
    got = {(r["query"], r["rank"]): r["word"] for r in E.nearest(queries, vectors, 3, slice_rows=4).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(10):
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(-(unit @ unit[q]))[:3])


def test_nearest_refuses_repeated_ids(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "word int, vec array<double>")
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "query int, vec array<double>")
    with pytest.raises(ValueError, match="repeated"):
        E.nearest(twice, vectors, 2, slice_rows=1)


def test_pool_moves_a_vector_once_for_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(E, "POOLED_BYTES", 400)
    vectors = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(9)], "word string, vec array<float>")
    texts = [(i % 50, " ".join(f"w{(i * 7 + j * j) % 12}" for j in range(i % 30))) for i in range(60)] + [(None, "w1 w2"), (70, None), (71, "x y")]
    out = E.pool(spark.createDataFrame(texts, "id int, text string"), vectors, "id")
    want = {}
    for i, t in texts:
        want.setdefault(i, []).extend(int(w[1:]) for w in (t or "").split() if w[0] == "w" and int(w[1:]) < 9)
    got = {r.id: r["mean"] for r in out.collect()}
    assert got == {i: pytest.approx([sum(x) / len(x), 1.0]) for i, x in want.items() if x}
    # words that share a vector, one of them a vector that is not there
    shared = spark.createDataFrame([(f"w{i}", i % 3) for i in range(9)], "word string, name int")
    few = spark.createDataFrame([(0, [1.0]), (1, [5.0])], "name int, vec array<float>")
    got = {r.id: r["mean"] for r in E.pool(spark.createDataFrame(texts, "id int, text string"), few, "id", shared=shared).collect()}
    values = {i: [(1.0, 5.0)[n % 3] for n in x if n % 3 < 2] for i, x in want.items()}
    assert got == {i: [pytest.approx(sum(x) / len(x))] for i, x in values.items() if x}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_pool_drops_unknown(spark):
    docs = spark.createDataFrame([(1, "a b zz"), (2, "zz")], "id int, text string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    assert {r.id: r["mean"] for r in E.pool(docs, vectors, "id").collect()} == {1: [2.0, 3.0]}


def test_spread_join_equals_join(spark):
    big = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = J.spread_join(big, small, ["k"], how, spread_by=["id"])
        assert got.select("id", "k", "v").exceptAll(big.join(small, ["k"], how).select("id", "k", "v")).count() == 0
        assert got.count() == big.join(small, ["k"], how).count()


def test_language_model(spark):
    df = spark.createDataFrame([("a b c",), ("a b d",), ("a b c",)], "text string")
    model = L.ngram_model(df, T.tokens("text"), 2)
    top = {(r.context, r["rank"]): (r.next, r.p) for r in L.top_next(model, 2).collect()}
    assert top["b", 1] == ("c", pytest.approx(2 / 3)) and top["<s>", 1] == ("a", 1.0)
    prompts = spark.createDataFrame([(1, "x a"), (2, "zz"), (3, "")], "id int, text string")
    assert {r.id: r.continuation for r in L.continue_text(model, prompts, ["id"], T.tokens("text"), 2, 5).collect()} == {1: "b c", 2: "", 3: "a b c"}
    # vocabulary a, b, c, d, </s> and one unknown
    row = L.perplexity(model, spark.createDataFrame([("a q",)], "text string"), T.tokens("text"), 2).first()
    assert row.events == 3 and row.uniform == 6.0
    assert row.perplexity == pytest.approx(math.exp(-(math.log(4 / 9) + math.log(1 / 9) + math.log(1 / 6)) / 3))


def test_idf_jaccard_is_exact(spark):
    rng = np.random.default_rng(5)
    bags = {i: sorted({f"w{int(x)}" for x in rng.zipf(1.6, 8) if x < 60} | {"common"}) for i in range(60)}
    df = spark.createDataFrame([(i, g) for i, g in bags.items()], "entry int, glosses array<string>")
    idf = {w: math.log(60 / sum(w in g for g in bags.values())) for g in bags.values() for w in g}
    scores = {}
    for a, ga in bags.items():
        for b, gb in bags.items():
            both = sum(idf[w] for w in set(ga) & set(gb))
            union = sum(idf[w] for w in set(ga) | set(gb))
            if a < b and both > 0:
                scores[a, b] = both / union
    assert any(s == 1 for s in scores.values())
    for least in (0.0, 0.3):
        want = {k: s for k, s in scores.items() if s >= least}
        rows = M.idf_jaccard(df, min_score=least).collect()
        got = {(r.a, r.b): r.score for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_same_stem_and_dictionary(spark):
    df = spark.createDataFrame([("walking", "walked"), ("cat", "dog"), ("abc", "abx")], "word1 string, word2 string")
    assert [tuple(r) for r in M.exclude_same_stem(df).collect()] == [("cat", "dog")]
    entries = spark.createDataFrame([("*ab", ["x"]), ("*a", ["x"]), ("a1b", ["x"]), ("cd", []), ("ef", None)], "headword string, glosses array<string>")
    assert [r.headword for r in M.filter_dictionary(entries, "*").collect()] == ["ab"]


def test_stems_merge_joiner_variants(spark):
    vocab = spark.createDataFrame([("बाक्‍चा", 9), ("बाक्‍ब", 7), ("बाक्शो", 6)], "token string, n long")
    rows = M.stem_clusters(vocab).where("stem = 'बाक्'").collect()
    assert {r.suffix: r.form for r in rows} == {"चा": "बाक्‍चा", "ब": "बाक्‍ब", "शो": "बाक्शो"}


def test_dtw(spark):
    rows = [("same", [[0.0], [1.0], [2.0]], [[0.0], [1.0], [2.0]]), ("slow", [[0.0], [1.0], [2.0]], [[0.0], [0.0], [1.0], [2.0], [2.0]])]
    pairs = spark.createDataFrame(rows, "clip string, ref array<array<double>>, syn array<array<double>>")
    path = Q.dtw(pairs, ["clip"])
    got = {c: [(r.i, r.j) for r in path.where(F.col("clip") == c).orderBy("pos").collect()] for c in ("same", "slow")}
    assert got == {"same": [(0, 0), (1, 1), (2, 2)], "slow": [(0, 0), (0, 1), (1, 2), (2, 3), (2, 4)]}
    rows = Q.on_path(path, pairs, ["clip"], a_i="ref", b_j="syn")
    assert {r.mcd_db for r in Q.aligned_db(rows, ["clip"], "a_i", "b_j").collect()} == {0.0}
    f0 = spark.createDataFrame([("a", 3.0, 6.0), ("a", 0.0, 9.0), ("b", 0.0, 1.0)], "clip string, x double, y double")
    scored = Q.voiced_rmse(f0, ["clip"], "x", "y")
    assert {r.clip: r.f0_rmse_hz for r in scored.collect()} == {"a": 3.0, "b": None}
    assert tuple(Q.clip_summary(scored, ["f0_rmse_hz"]).first()) == (2, 3.0)


def test_splits(spark):
    df = spark.range(3000).select("id", (F.col("id") % 20).cast("string").alias("g"))
    split = S.split_rows(df, ["id"], 0.1)
    assert split.where("split = 'test'").count() == pytest.approx(300, abs=60)
    assert split.exceptAll(S.split_rows(df.repartition(17), ["id"], 0.1)).count() == 0
    frac = S.split_groups_frac(df, "g", 0.1)
    assert frac.where("split = 'validation'").select("g").distinct().count() == 2 and frac.count() == 3000
    with pytest.raises(ValueError):
        S.split_groups(df, "g", ["0", "nope"])


def test_leakage_with_many_copies(spark):
    same = [(i, "one two three four five six seven") for i in range(300)]
    near = [(1000 + i, f"a b c d e f g h i j k l m n o p q r s t u v w x{i}") for i in range(20)]
    lone = [(2000, "nothing like any other text here at all")]
    df = S.split_rows(spark.createDataFrame(same + near + lone, "id int, text string"), ["id"], 0.3)
    test = df.where("split = 'test'")
    flags = {r.id: r.leaked for r in S.leakage(df.where("split = 'train'"), test, "id").collect()}
    assert len(flags) == test.count() and all(v for k, v in flags.items() if k < 2000)


def test_leakage_meets_only_pairs_that_may_reach_the_threshold(spark, monkeypatch):
    # a few common lines in all texts, own words, and copies with some words changed
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    lines = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = [" ".join([lines[i % 4], *(word() for _ in range(60)), lines[(i + 1) % 4]]) for i in range(160)]
    for i in range(60):
        words = texts[i].split()
        for at in rng.sample(range(len(words)), i % 6):
            words[at] = word()
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("held", F.col("id") % 3 == 0)
    monkeypatch.setattr(S, "COUNTED_IN", 1)
    written = {}
    plain = S.cut_lineage

    def kept(frame, name="stage"):
        written[name] = plain(frame, name)
        return written[name]

    monkeypatch.setattr(S, "cut_lineage", kept)
    got = {r.id: r.leaked for r in S.leakage(df.where("NOT held"), df.where("held"), "id").collect()}
    grams = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    close = lambda i: any(len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) for j in range(len(texts)) if j % 3)
    assert got == {i: close(i) for i in range(0, len(texts), 3)}
    assert 0 < sum(got.values()) < len(got) and written["candidates"].count() <= 40


def test_coverage_and_expected(spark):
    chars = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "ch string, n long")
    inv = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("z", "q")], "candidate string, ch string")
    got = {r.candidate: (r.covered, r.total, r.missing_kinds) for r in P.coverage(chars, inv).collect()}
    assert got == {"x": (9, 10, 1), "y": (1, 10, 2), "z": (0, 10, 3)}
    missing = {(r.candidate, r.ch) for r in P.missing_characters(chars, inv, ["x", "y", "z"]).collect()}
    assert missing == {("x", "c"), ("y", "a"), ("y", "b"), ("z", "a"), ("z", "b"), ("z", "c")}
    books = spark.createDataFrame([("MAT", 3)], "book string, n int")
    left = spark.createDataFrame([("MAT", 1), ("MAT", 2)], "book string, num int")
    right = spark.createDataFrame([("MAT", 2), ("MAT", 9)], "book string, num int")
    assert tuple(J.inventory_counts(J.expected_present(books, left, right)).first()) == (3, 1, 2, 1, 2)


def test_hot_words_give_the_same_results(spark):
    """One source word, one context and one pair's word hold nearly all rows."""
    counts = spark.range(3000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("s"), F.concat(F.lit("t"), "id").alias("t"), (F.col("id") % 7 + 1).cast("double").alias("c"))
    rows = counts.collect()
    total = {}
    for r in rows:
        total[r.s] = total.get(r.s, 0.0) + r.c
    got = {(r.s, r.t): r.p for r in A.normalise(counts).collect()}
    assert len(got) == 3000 and all(got[r.s, r.t] == pytest.approx(r.c / total[r.s]) for r in rows)

    pairs = counts.select(F.col("s").alias("source"), F.col("t").alias("target"))
    ref = spark.createDataFrame([("hot", ["t1", "t2"]), ("s0", ["t0"]), ("s50", ["x"])], "headword string, glosses array<string>")
    judged = {(r.source, r.target): r.status for r in J.judge_lexicon(pairs, ref).collect()}
    assert len(judged) == 3000 and [judged["hot", "t1"], judged["hot", "t3"], judged["s0", "t0"], judged["s50", "t50"], judged["s100", "t100"]] == ["agree", "disagree", "agree", "disagree", "not_in_ref"]

    words = [f"hot w{i % 400}" for i in range(2000)] + ["cold end"]
    text = spark.createDataFrame([(w,) for w in words], "text string")
    model = L.ngram_model(text, T.tokens("text"), 2)
    m = {(tuple(r.context) if isinstance(r.context, list) else r.context, r.next): r.n for r in model.collect()}
    row = L.perplexity(model, text, T.tokens("text"), 2).first()
    size, contexts = len({k[1] for k in m}) + 1, {}
    for (c, _), n in m.items():
        contexts[c] = contexts.get(c, 0) + n
    log = sum(n * math.log((n + 1) / (contexts[c] + size)) for (c, _), n in m.items())
    assert row.events == sum(m.values()) and row.perplexity == pytest.approx(math.exp(-log / row.events))


def test_last_report_row_by_its_order(spark):
    report = spark.createDataFrame([("s", "c1", "high", "", 5), ("s", "c2", "low", "x", 9), ("s", "c3", "low", "y", 7)], "segment string, chapter string, confidence string, reason string, line int")
    empty = spark.createDataFrame([], "stem string, path string")
    analysis = spark.createDataFrame([("s",)], "segment string")
    for rows in (report, report.repartition(5, "line"), report.orderBy(F.desc("line"))):
        got = J.enrich_segments(analysis, rows, empty, empty, empty, "line").first()
        assert (got.chapter, got.segmentation_confidence, got.segmentation_reason) == ("c2", "low", "x")


def test_score_divergence_scores_once(spark):
    scores = spark.range(40).select("id", (F.col("id") % 2).cast("string").alias("direction"), (F.col("id") * 7 % 40).cast("double").alias("chrf"), F.lit(3.0).alias("bleu"))
    got = [(r.direction, r.side, r["rank"], r.id) for r in A.score_divergence(scores, ["id"], k=2).collect()]
    want = []
    for d in "01":
        rows = sorted((r for r in scores.collect() if r.direction == d), key=lambda r: (-r.chrf, r.id))
        want += [(d, "chrf_high", i + 1, r.id) for i, r in enumerate(rows[:2])]
        rows.sort(key=lambda r: (r.chrf, r.id))
        want += [(d, "bleu_high", i + 1, r.id) for i, r in enumerate(rows[:2])]
    assert sorted(got) == sorted(want)


def test_ngrams_are_counted_before_they_meet(spark, monkeypatch):
    """n-grams leave their batch counted, whatever the slices; nulls and empty texts are as before."""
    texts = ["a b " * 500, None, "", "b", "a b a c", "c " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want, blanks = collections.Counter(), collections.Counter()
    for t in texts:
        if t is not None:
            p = ["<s>", "<s>", *t.split(), "</s>"]
            want.update((f"{x} {y}", z) for x, y, z in zip(p, p[1:], p[2:]))
            blanks.update((x, z, y) for x, y, z in zip(p[1:], p[2:], p[3:]))
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(L, "COUNTED_AT_ONCE", at_once)
        assert {(r.context, r.next): r.n for r in L.ngram_model(df, T.tokens("text"), 3).collect()} == want
        assert {(r.left, r.right, r.middle): r.n for r in L.blank_model(df, T.tokens("text")).collect()} == blanks
        assert L._gram_counts(df, T.tokens("text"), 2).count() < 20


def test_pairs_in_order_read_their_input_once(spark):
    """Rows of equal counts pair up without the Python step of the others; both routes name the same columns."""
    rows = [(1, ["a b", "c"], ["x", "y z"]), (2, ["a"], ["x", "y"]), (3, [], []), (4, None, ["x"]), (5, None, None)]
    pairs = spark.createDataFrame(rows, "id int, a_sentences array<string>, b_sentences array<string>")
    even = A.align_in_order(pairs, ["id"])
    assert [tuple(r) for r in even.orderBy("id", "pos").collect()] == [(1, 0, "a b", "x", "1:1", "length_only"), (1, 1, "c", "y z", "1:1", "length_only")]
    assert even.columns == A.align_sentences(pairs, ["id"], 1.0, 6.8).columns
    assert "MapInPandas" not in even._jdf.queryExecution().optimizedPlan().toString()


def test_expected_uses_of_many_words_at_once(monkeypatch):
    # words of several lengths, one beyond the basic plane, one that no pieces spell, in parts of a few places: as by all segmentations
    monkeypatch.setattr(U, "PLACES_AT_ONCE", 8)
    scores = {p: math.log(w) for p, w in {"a": 0.2, "b": 0.1, "ab": 0.3, "ba": 0.15, "aba": 0.05, "𐍈": 0.1, "b𐍈": 0.1}.items()}
    words, counts = ["ab", "ba", "aab", "abab", "b𐍈a", "zz", "aza", "", "a", "abaabab"], np.array([3, 1, 2, 5, 4, 9, 1, 7, 2, 6], float)

    def splits(word):
        if not word:
            yield ()
        for i in range(1, len(word) + 1):
            if word[:i] in scores:
                yield from ((word[:i], *rest) for rest in splits(word[i:]))

    want, likelihood = dict.fromkeys(scores, 0.0), 0.0
    for word, n in zip(words, counts):
        weights = {s: math.exp(sum(scores[p] for p in s)) for s in splits(word)}
        if weights and word:
            likelihood += n * math.log(sum(weights.values()))
            for s, weight in weights.items():
                for p in s:
                    want[p] += n * weight / sum(weights.values())
    pieces = U._Pieces(scores)
    used, got = U._expected(words, counts, pieces)
    assert got == pytest.approx(likelihood) and dict(zip(pieces.pieces, used)) == pytest.approx(want)


def test_shards_of_a_task_are_added_up_before_they_move(spark, monkeypatch):
    """Shards trained in groups give the vectors of shards trained apart; fewer rows move, and none of them is written first."""
    from lexiloom.operators import skipgram

    rng = np.random.default_rng(8)
    texts = [(" ".join(f"w{i}" for i in rng.integers(0, 30, 40)),) for _ in range(300)] + [("once w0",), (None,), ("",)]
    df = spark.createDataFrame(texts, "text string").coalesce(1)
    monkeypatch.setattr(skipgram, "SHARD_WORDS", 1000)
    written, moved, keep, means = [], [], skipgram.cut_lineage, skipgram.weighted_means
    monkeypatch.setattr(skipgram, "cut_lineage", lambda frame, name="stage": (written.append((name, keep(frame, name))), written[-1][1])[1])
    monkeypatch.setattr(skipgram, "weighted_means", lambda rows, *rest: (moved.append(rows.count()), means(rows, *rest))[1])
    got = []
    for many in (1, 6):
        monkeypatch.setattr(skipgram, "GROUP_SHARDS", many)
        got.append({r.word: r.vec for r in E.train_vectors(df, dim=4, iterations=2, partitions=2).collect()})
    assert set(got[0]) == {f"w{i}" for i in range(30)}
    assert got[0] == {w: pytest.approx(v, abs=1e-5) for w, v in got[1].items()}
    assert moved == [13 * 30] * 2 + [3 * 30] * 2 and "passed" not in {name for name, _ in written}
    # tokens are gone once they are numbered
    assert not any(os.path.exists(f.removeprefix("file://")) for name, frame in written if name == "tokens" for f in frame.inputFiles())


def test_packed_numbers():
    from lexiloom.functions.blocks import packed, unpacked

    for values in (np.array([], np.int32), np.array([-1, 0, 1 << 40]), np.array([0.5, -np.inf]), np.arange(1000, dtype=np.int32)):
        back = unpacked(packed(values), values.dtype)
        assert back.dtype == values.dtype and (back == values).all()


def test_ngrams_are_summed_by_task_and_only_asked_ones_move_on(spark, monkeypatch):
    """However many n-grams a task holds, vectors are the same; the sums are not written, and leave a task once where it can hold them."""
    words = [f"{a}{b}ing" for a in "abcdefgh" for b in "klmnop"]
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(words)], "word string, vec array<double>").coalesce(1)
    counts = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(words)], "token string, n long")
    asked = spark.createDataFrame([("akingly",), ("singing",), ("zzzz",)], "word string")
    written, keep = [], E.cut_lineage
    monkeypatch.setattr(E, "cut_lineage", lambda frame, name="stage": (written.append(name), keep(frame, name))[1])
    monkeypatch.setattr(E, "WORDS_AT_ONCE", 5)
    got = []
    for held in (1 << 19, 3):
        monkeypatch.setattr(E, "GRAMS_HELD", held)
        got.append({r.word: r.vec for r in E.compose_vectors(asked, vectors, counts, 3, 4).collect()})
    assert set(got[0]) == {"akingly", "singing"} and got[0] == {w: pytest.approx(v) for w, v in got[1].items()}
    assert written == ["asked"] * 2
    sums, part = E._GramSums(), lambda ws: E._gram_sums(
        pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([2.0] * len(ws), pa.float64()), pa.array([[1.0, 3.0]] * len(ws), pa.list_(pa.float64()))], names=["word", "n", "vec"]), 3, 3)
    for some in (["cat", "cats"], [], ["cat"]):
        sums.add(part(some))
    rows = {g: (n, v) for b in sums.given() for g, n, v in zip(*(b.column(c).to_pylist() for c in ("gram", "n", "vec")))}
    assert rows == {"<ca": (6.0, [6.0, 18.0]), "cat": (6.0, [6.0, 18.0]), "at>": (4.0, [4.0, 12.0]), "ats": (2.0, [2.0, 6.0]), "ts>": (2.0, [2.0, 6.0])}
    assert list(sums.given()) == []


def test_blanks_move_once_and_packed(spark, monkeypatch):
    """One shuffle of packed trigrams; words with any marks, missing words and counts over four bytes come back whole."""
    rows = [(["a", "\x01", "c"],), (["a", "\x01", "c"],), (["a", "\x02é", "c"],), (["a", None, "c"],), ([None, "b", "c"],), (None,), ([],)]
    df = spark.createDataFrame(rows, "w array<string>")
    counts = Counter()
    for (w,) in rows:
        if w is not None:
            p = ["<s>", *w, "</s>"]
            counts.update(zip(p, p[2:], p[1:]))
    out = L.fill_mask(L.blank_model(df, F.col("w")), 2)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1
    for at_once in (L.PACKED_AT_ONCE, 1):
        monkeypatch.setattr(L, "PACKED_AT_ONCE", at_once)
        model = L.blank_model(df, F.col("w"))
        assert {(r.left, r.right, r.middle): r.n for r in model.collect()} == counts
    top = {(r.left, r.right, r["rank"]): (r.middle, r.n, r.p) for r in out.collect()}
    assert top["a", "c", 1] == ("\x01", 2, 0.5) and top["a", "c", 2] == (None, 1, 0.25) and ("a", "c", 3) not in top
    big = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array(["y"]), pa.array(["z"]), pa.array([(1 << 32) + 5])], names=["g0", "g1", "g2", "n"])
    assert sum(sum(b.column("n").to_pylist()[0]) for b in L._packed_blanks(big, 4)) == (1 << 32) + 5


def test_all_seeds_are_trained(spark, monkeypatch):
    """However many seeds there are, all take part; in tables they give the vocabulary they give on the driver."""
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "tur", "pe"]
    words = Counter("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 6))) for _ in range(900))
    vocab = spark.createDataFrame(list(words.items()), "token string, n long")
    plain, likelihood = U.train_unigram(vocab, 300, rounds=2, shrink=0.5)
    want = {r.piece: r.score for r in plain.collect()}
    seen, wide = [], U.wide_round
    monkeypatch.setattr(U, "wide_round", lambda words, held, pieces, letters: (seen.append(pieces.count()), wide(words, held, pieces, letters))[1])
    monkeypatch.setattr(U, "BUCKET_WORDS", 100)
    for shared in (200, 0):
        seen.clear()
        monkeypatch.setattr(U, "SHARED_PIECES", shared)
        pieces, history = U.train_unigram(vocab, 300, rounds=2, shrink=0.5)
        assert {r.piece: r.score for r in pieces.collect()} == pytest.approx(want) and history == pytest.approx(likelihood)
        chars = U.kept_characters(U.marked_words(vocab)).count()
        assert seen[0] == U.seed_substrings(U.marked_words(vocab)).count() + chars > 200
        assert len(seen) == len(history) if shared == 0 else len(seen) < len(history)


def test_query_keeps_all_seeds(spark, monkeypatch):
    from lexiloom.plans import example_queries as X

    asked = {}
    monkeypatch.setattr(X.U, "train_unigram", lambda vocab, size, **given: asked.update(given, size=size))
    X.trained(spark, "/root/testdata/sf0.001")
    assert asked["size"] == 2000 and not {"seed_size", "max_chars"} & set(asked)


def test_alignment_rounds_move_packed_numbers(spark, monkeypatch):
    """Rounds are written with numbers for words, and no row of a round is moved for itself."""
    rows = [(i, [f"s{j}" for j in range(i % 5 + 1)], [f"t{j}" for j in range(i % 7 + 1)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    written, keep = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda frame, name="stage": (written.append((name, frame)), keep(frame, name))[1])
    monkeypatch.setattr(A, "SENT_AT_ONCE", 50)
    links, _ = A.align_words(df, ["id"], F.col("a"), F.col("b"), 3, 100, 20)
    cells = A.alignment_cells(df, ["id"], F.col("a"), F.col("b"))
    want = A.best_links(cells, A.translation_table(cells, ["id"], 3)[0], ["id"])
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, want.collect()))
    rounds = [frame for name, frame in written if name == "round"]
    assert all(frame.schema["s"].dataType.simpleString() == "bigint" for frame in rounds)
    assert not any("Window" in frame._jdf.queryExecution().executedPlan().toString() for frame in rounds)
