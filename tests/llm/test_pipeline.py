"""run() against a brute-force version of its five stages."""

import hashlib
import re

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from glyphql.llm import language_id, piece_encoding  # noqa: E402

from .test_text_operators import PIECES, brute_components, lower  # noqa: E402

ITEM = "one two three four five six seven eight nine ten eleven"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    base = "the cat and the dog went to the house with their many good friends on a quiet day in spring and stayed there until the evening came"
    texts = [base, base.upper(), base + " again", "another text that has nothing to do with the others but is long enough", "12345 ??", None, f"some words {ITEM} after it", "third text about something else entirely, with other words"]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_run_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    profiles = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ranks = language_id.Ranks(profiles, language_id.SIZE)
    docs = [(i, t) for i, t in docs if (p := ranks.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    last = {lower(t): i for i, t in sorted(docs)}
    docs = [(i, t) for i, t in docs if last[lower(t)] == i]
    stays = {i for i, _, c in brute_components(docs, 5, 80) if i == c}
    docs = [(i, re.sub(re.escape(ITEM), "", t)) for i, t in docs if i in stays]
    m = piece_encoding.PieceModel(PIECES)
    want = sorted((i, m.encode_fast(t)[1] + 1, hashlib.sha256(m.encode_fast(t)[2].encode()).hexdigest()) for i, t in docs)
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and [i for i, *_ in got] == [1, 3, 6, 7]


def test_stages_keep_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
