"""The pipeline's stages against plain versions, each on its own input."""

import brute
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as P

    from tallyframe.llm.common import materialize, table

    docs, out = table(spark, SF, "documents"), []
    for name, f in P.STAGES:
        got = materialize(f(spark, docs, SF), name)
        out.append((docs, got))
        docs = got
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(stages):
    assert all(got.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, got in stages[:-1])


def test_language_keeps_clean_documents(stages):
    docs, got = stages[0]
    assert got.count() >= 0.97 * docs.count()


def test_one_of_each_group_stays(stages):
    docs, got = stages[1]
    groups = brute.similar_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 8, 10)
    assert sorted(ids(got)) == sorted({c for _, c in groups.values()})


def test_no_passage_is_left(spark, stages):
    _, got = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, _ = stages[2]
    dirty = {x[0] for x in brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items) if x[5]}
    assert dirty
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.collect():
        assert (r["text"] == before[r["doc_id"]]) == (r["doc_id"] not in dirty)


def test_records_hold_the_mix(stages):
    docs, got = stages[4]
    assert got.count() == docs.count() and set(got.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
