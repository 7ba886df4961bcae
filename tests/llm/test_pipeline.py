"""The pipeline's stages on planted cases, and the named queries against SQL."""

import hashlib
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from made import prose
from redgreen.llm import bpe
from redgreen.llm.oracle import ORACLE
from redgreen.llm.queries import QUERIES, RANKS

SF_DIR = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good prose, junk, exact and near copies, and a passage that two documents share."""
    passage = prose(900, 70)
    rows = [(i, prose(i, 120 + i), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(i, " ".join([prose(i, 1)] * 80), "en", "src1", 0) for i in range(60, 90)]  # junk
    rows += [(200, rows[5][1], "en", "src0", 0), (201, rows[6][1] + " more", "en", "src0", 0), (202, None, "en", "src0", None), (202, None, "en", "src0", None)]
    rows += [(210 + i, prose(300 + i, 40) + " " + passage + " " + prose(400 + i, 40), "en", "src2", 0) for i in range(2)]
    rows = [(i, t, l, s, len(t) if t else None) for i, t, l, s, _ in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(90) if i % 3]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r for r in rows}, passage


def test_stages_in_their_order(spark, corpus):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "bpe"]
    good = STAGE["quality"](spark, docs, folder)
    assert good.dtypes == docs.dtypes
    ids = {r.doc_id for r in good.collect()}
    assert set(range(60)) <= ids and not ids & set(range(60, 90))
    apart = STAGE["near_duplicates"](spark, docs, folder)
    assert apart.dtypes == docs.dtypes
    kept = sorted(r.doc_id for r in apart.collect())
    assert not {200, 201} & set(kept) and set(range(60)) <= set(kept) and {210, 211} <= set(kept) and kept.count(202) == 1
    cut = STAGE["repeated_passages"](spark, apart, folder)
    assert cut.dtypes == docs.dtypes and cut.count() == apart.count()
    for r in cut.collect():
        if r.doc_id in (210, 211):
            assert passage not in r.text and r.n_chars == len(r.text) and r.text.startswith(prose(90 + r.doc_id, 40)[:40])
        elif r.doc_id < 60:
            assert r.text == rows[r.doc_id][1]
    mixed = STAGE["mixing"](spark, cut, folder)
    assert mixed.dtypes == docs.dtypes and 0 < mixed.count()
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in STAGE["bpe"](spark, mixed, folder).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_run_applies_all_stages(spark, corpus):
    folder, rows, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in got.collect()}
    assert ids <= set(range(60)) | {202, 210, 211} and len(ids) > 30


def test_odd_rows_and_clashing_names_through_all_stages(spark, tmp_path):
    """Nulls, empty, blank and very long texts, repeated rows, and columns named like those that stages derive."""
    clash = ["_row", "_k1", "_k2", "_spans", "_kept", "_t", "_tree", "_plan", "_key", "_epoch", "_upto", "_leaf", "TEXT", "ids", "other5", "component_id"]
    rows = [(i, prose(i, 60 + i % 9), "en", f"src{i % 3}") for i in range(40)]
    rows += [(50, prose(3, 63), "en", "src0"), (51, None, None, None), (52, "", "en", "src1"), (53, " \n", "en", "src1"), (None, prose(80, 70), "en", "src2")]
    rows += [(54, prose(90, 30_000), "en", "src0"), (55, "x" * 300_000, "en", "src0"), (5, prose(5, 65), "en", "src2"), (5, prose(5, 65), "en", "src2")]
    data = [(*r, len(r[1]) if r[1] else None, *[f"{c}-{n}" for c in clash]) for n, r in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in clash)
    docs = spark.createDataFrame(data, schema)
    labels = spark.createDataFrame([(i, int(i < 38), 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own = {r[5]: r for r in map(tuple, docs.collect())}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        # Only the last stage adds a column that is there already.
        places = [docs.columns.index(c if c != "ids" or name != "bpe" else "ids_") for c in clash]
        for r in map(tuple, docs.collect()):
            number = r[places[0]].removeprefix("_row-")
            assert [r[p] for p in places] == [f"{c}-{number}" for c in clash] and r[0] == own[f"_row-{number}"][0]
    assert docs.count() > 20


def test_an_empty_corpus(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).isEmpty()


def test_near_copies_are_judged_by_row(spark):
    """Rows that share an id stay if their texts differ, and near copies without an id go."""
    rows = [(7, prose(500 + i, 60)) for i in range(6)] + [(3, prose(500, 60) + " end"), (8, prose(600, 60)), (8, prose(601, 60)), (9, prose(600, 60))]
    rows += [(None, prose(700, 60)), (None, prose(700, 60) + " end"), (12, ""), (12, None), (12, " "), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in STAGE["near_duplicates"](spark, docs, "").collect()]
    want = [r for r in rows if r not in [(7, prose(500, 60)), (9, prose(600, 60)), (None, prose(700, 60) + " end")]]
    lone = [r for r in kept if r[0] is None and r[1]]  # either of the two copies
    assert len(lone) == 1 and lone[0][1].startswith(prose(700, 60))
    assert sorted(map(str, (r for r in kept if r not in lone))) == sorted(map(str, (r for r in want if r[0] is not None or not r[1])))


@tables
@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    got = QUERIES[name](spark, SF_DIR)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"select {columns} from ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_thirteen_queries():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLE) < set(QUERIES)
