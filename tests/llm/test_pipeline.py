"""The corpus pipeline, each stage on what the one before it kept, against brute force."""

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexiloom.llm import queries, toxicity
from tests.llm import brute
from tests.llm.test_edges import NULL_AND_REPEATED, TEXTS, frame

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """{stage: rows}, with the rows of ``documents`` under ``input``."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(root / name))
        docs = out[name] = spark.read.parquet(str(root / name))
    return out


def texts(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_stage_order():
    assert list(STAGES) == ["toxicity", "near_duplicates", "decontamination", "mixing_sources", "token_output"]


def test_columns(kept):
    assert all(kept[name].columns == kept["input"].columns for name in list(STAGES)[:-1])


def test_toxicity(spark, kept):
    lexicon = toxicity.fit_lexicon(kept["input"], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    automaton = lexicon.automaton()
    assert texts(kept["toxicity"]) == {k: t for k, t in texts(kept["input"]).items() if lexicon.score(lexicon.features(t, automaton)) < toxicity.THRESHOLD}


def test_near_duplicates(kept):
    given = texts(kept["toxicity"])
    classes = brute.near_duplicates(given, 5)
    assert texts(kept["near_duplicates"]) == {k: t for k, t in given.items() if classes[k][2]}
    assert len(kept["near_duplicates"].collect()) < len(given)


def test_decontamination(spark, kept):
    given = texts(kept["near_duplicates"])
    found = brute.contamination(given, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    assert texts(kept["decontamination"]) == {k: t for k, t in given.items() if not found[k][4]}
    assert any(f[4] for f in found.values())


def test_mixing(kept):
    given = kept["decontamination"].toPandas()
    con = duckdb.connect()
    con.register("documents", given)
    drawn = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op4_mixing']}) WHERE drawn").fetchall()}
    assert texts(kept["mixing_sources"]) == {k: t for k, t in texts(kept["decontamination"]).items() if k in drawn}
    assert 0.7 * len(given) < len(drawn) < len(given)


def test_token_output(kept):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in kept["token_output"].collect()}
    assert got == brute.token_rows(texts(kept["mixing_sources"]), Tokenizer.from_file(queries.word_tokenizer()))


def test_run(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, kept["token_output"].collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_rows(spark, name):
    """Nulls in any column, repeated rows, clashing columns and an empty table."""
    docs = frame(spark, more=NULL_AND_REPEATED)
    out = STAGES[name](spark, docs, FOLDER)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    if name in ("toxicity", "token_output"):
        assert len(rows) == len(TEXTS) + 4
    if name == "near_duplicates":
        # of repeated rows and copies one stays; null ids are linked with nothing
        want = brute.near_duplicates(TEXTS, 5)
        assert sorted(i for i in ids if i is not None) == sorted(k for k in TEXTS if want[k][2]) and ids.count(None) == 2
    if name != "token_output":
        assert out.columns == docs.columns
    assert STAGES[name](spark, frame(spark, {}), FOLDER).count() == 0


def test_stages_read_small_batches(spark, monkeypatch):
    # whole texts in Python: stages get small Arrow batches, and the session's setting is as before afterwards
    setting = corpus_pipeline.BATCH_SETTING
    before, seen = spark.conf.get(setting), []

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(setting)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert seen == [corpus_pipeline.BATCH_ROWS] * 2 and spark.conf.get(setting) == before


def test_rows_of_a_batch_in_slices(monkeypatch):
    import pyarrow as pa

    from lexiloom.llm import common

    monkeypatch.setattr(common, "ROWS_AT_ONCE", 3)
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n)), "b": [str(i) for i in range(n)]}) for n in (0, 3, 7)]
    assert list(common.arrow_rows(batches, "a", "b")) == [(i, str(i)) for n in (0, 3, 7) for i in range(n)]
