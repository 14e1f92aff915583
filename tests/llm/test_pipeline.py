import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from postmatch.llm import decontaminate, pieces, pii, quality  # noqa: E402
from postmatch.llm.queries import piece_model  # noqa: E402
from tests.llm import odd_tables as samples  # noqa: E402
from tests.llm.test_decontaminate import plain_shingles  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_print  # noqa: E402


@pytest.fixture
def folder(spark, tmp_path):
    samples.documents(spark, n=30).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, samples.texts(5, 30)[7]), (2, "none of these words occurs"), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_run_matches_brute_force(spark, folder):
    squeeze = quality.zstandard.ZstdCompressor(level=3).compress
    rows = [r for r in samples.rows(n=30) if quality.judged((r[1] or "").encode(), quality.Bands(), squeeze)[-1]]
    parts = plain_components([r[0] for r in rows], [plain_print(r[1]) for r in rows])
    rows = [r for r, c in zip(rows, parts) if r[0] is None or r[0] == c]
    rows = list({repr(r): r for r in rows}.values())
    item = plain_shingles(samples.texts(5, 30)[7])
    rows = [r for r in rows if 5 * len(item & plain_shingles(r[1])) < 4 * len(item)]
    own = pieces.PieceModel(piece_model())
    want = sorted(repr((r[0], own.encode(pii.redacted(r[1])))) for r in rows)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(repr((r.doc_id, list(r.ids))) for r in got.collect()) == want
    assert decontaminate.PERCENT == 80 and len(want) > 10
