"""Every query of the training-data operators on whole small tables, against brute force or SQL."""

import hashlib
import itertools
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lexiloom.llm import queries, spotsigs, toxicity
from tests import oracle
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()]


@pytest.fixture(scope="module")
def texts(tables):
    return {r["doc_id"]: r["text"] or "" for r in tables("documents")}


def result(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()]


def by(rows, key, *columns):
    out = {r[key]: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def test_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), queries.SQL[name]) is None


def test_warc(spark, tables):
    got = by(result(spark, "op1_warc_round_trip"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.warc({r["page_id"]: r["html"] for r in tables("pages")})


def test_near_duplicates(spark, texts):
    got = by(result(spark, "op3_near_duplicates"), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(texts, 2)


def test_decontamination(spark, tables, texts):
    got = by(result(spark, "op5_decontamination"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(texts, [(r["item_id"], r["text"]) for r in tables("benchmark")])


def test_toxicity_held_out(spark):
    """Learned on three quarters of the labels at a scale where they suffice, held against the last quarter."""
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_toxicity"](spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in got.items())
    assert all(r["predicted"] == (r["score"] >= toxicity.THRESHOLD) for r in got.values())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[k], r["predicted"]) for k, r in got.items() if r["held_out"] and k in labels]
    hits = sum(y and p for y, p in held)
    assert hits >= 0.85 * sum(y for y, _ in held) and hits >= 0.9 * sum(p for _, p in held)


def test_toxicity_scores(spark, texts):
    """The score of every text of a whole table under a lexicon with whole words, beginnings and exceptions."""
    words = sorted({w for t in texts.values() for w in toxicity.WORD.findall(toxicity.fold(t))}, key=lambda w: hashlib.sha256(w.encode()).hexdigest())
    lexicon = toxicity.Lexicon({w: 1.0 + i % 7 / 3 for i, w in enumerate(words[:60])} | {w[:4] + "*": 2.5 + i % 5 for i, w in enumerate(words[60:100])}, bias=-3.0, slope=1.5, length_slope=0.7)
    follow = {f"{a} {b}" for t in texts.values() for a, b in itertools.pairwise(toxicity.WORD.findall(toxicity.fold(t))) if a in lexicon.weights}
    lexicon.exceptions = set(sorted(follow)[::3])
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.read.parquet(f"{FOLDER}/documents.parquet"), lexicon).collect()}
    want = {k: lexicon.score(brute.toxic_features(t, lexicon.weights, lexicon.exceptions, toxicity.fold)) for k, t in texts.items()}
    assert got == pytest.approx(want, abs=1e-12) and len({round(v, 6) for v in want.values()}) > 50


def test_filter_audit(spark, tables):
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDIT] for r in result(spark, "op11_filter_audit")}
    want = brute.audit([(r["doc_id"], r["text"], r["lang"]) for r in tables("documents")], [(r["doc_id"], r["quality"], r["toxic"]) for r in tables("labels")])
    assert got == want


def test_whitening(spark, tables):
    out = result(spark, "op12_whitening")
    n, rows, shares = brute.whitened({r["vec_id"]: r["embedding"] for r in tables("embeddings")})
    assert len(out) == 4 * len(rows) and {r["n"] for r in out} == {n}
    for c in range(1, 5):
        mine = [r for r in out if r["component"] == c]
        sign = 1 if mine[0]["whitened"] * rows[mine[0]["vec_id"]][1][c - 1] > 0 else -1
        assert all(r["deviation"] == rows[r["vec_id"]][0] for r in mine)
        assert all(r["whitened"] == pytest.approx(sign * rows[r["vec_id"]][1][c - 1], abs=1e-9) for r in mine)
        assert all(r["explained"] == pytest.approx(shares[c - 1], rel=1e-9) and 0 <= r["identity_error"] < 1e-9 for r in mine)


def test_substring_dedup(spark, texts):
    got = by(result(spark, "op13_substring_dedup"), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.without_repeats(texts) and any(r[1] for r in got.values())


def test_sharding(spark, texts):
    got = {r["doc_id"]: r for r in result(spark, "op7_sharding")}
    assert set(got) == set(texts)
    sizes, slots, order = defaultdict(int), defaultdict(list), sorted(texts)
    for k in order:
        data = texts[k].encode()
        assert (got[k]["size"], got[k]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sizes[got[k]["shard"]] += len(data) + 1
        slots[got[k]["shard"]].append(got[k]["slot"])
    assert [got[k]["shard"] for k in order] == sorted(got[k]["shard"] for k in order)
    assert all(v == list(range(len(v))) for v in slots.values())
    largest = max(len(t.encode()) + 1 for t in texts.values())
    assert all(abs(s - sum(sizes.values()) / 16) <= largest for s in sizes.values())


def test_secret_scan(spark, texts):
    got = by(result(spark, "op8_secret_scan"), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == {k: brute.base_secrets(t) for k, t in texts.items()}


def test_token_files(spark, texts):
    got = by(result(spark, "op9_token_files"), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == brute.token_rows(texts, Tokenizer.from_file(queries.word_tokenizer()))


def test_spotsigs(spark, texts):
    got = {r["doc_id"]: r for r in result(spark, "op10_spotsigs")}
    anchors = set(spotsigs.common_words(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    down = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, k in enumerate(down):
        text, after = texts[k], down[(i + 1) % len(down)]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        own, changed, other = (brute.signatures(t, anchors) for t in (text, edited, texts[after]))
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[k]["near_edited"] == pytest.approx(brute.jaccard(own, changed), abs=1e-6)
        assert got[k]["near_next"] == pytest.approx(brute.jaccard(own, other), abs=1e-6)
        assert len(got[k]["fingerprint"]) == 8 * len(own) and len(got[k]["edited_fingerprint"]) == 8 * len(changed)
