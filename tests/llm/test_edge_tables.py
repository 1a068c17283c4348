"""All queries and the pipeline on empty tables, and on tables with nulls, ties, repeats and further columns."""

import pytest

import corpus_pipeline
from tapewatch.llm import queries
from tests.llm.cases import LONG, TEXTS

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {
    "documents": (DOCS, [(*r, None) for r in TEXTS] + [(20 + i, f"line {i} here\n" + LONG[: 500 * i], "en", "a", 3) for i in range(12)]),
    "labels": ("doc_id bigint, quality int, toxic int", [(i, i % 2, 0) for i in range(1, 14)] + [(1, 1, 0), (1, 1, 0), (None, 1, None), (2, None, None), (999, 0, 0), (5, 7, 1)]),
    "pages": ("page_id bigint, url string, html string", [(1, None, None), (None, "u", ""), (2, "u", "<article><p>a b</p></article>"), (2, "u", "<article><p>a b</p></article>")]),
    "conversations": ("conv_id bigint, turn bigint, role string, text string", [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "y"), (2, 5, "assistant", "z" * 9000)]),
    "benchmark": ("item_id bigint, text string", [(1, "quick fox"), (1, "one"), (None, "line here"), (2, None), (3, "")]),
    "embeddings": ("vec_id bigint, embedding array<float>, label int", [(1, None, 1), (2, [], 1), (3, [0.5] * 64, None), (4, [0.5] * 64, 1), (None, [1.0, None, float("nan")], 1)]),
}


@pytest.fixture(scope="module", params=["empty", "odd"])
def tables(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    for name, (ddl, rows) in TABLES.items():
        spark.createDataFrame(rows if request.param == "odd" else [], ddl).selectExpr("*", "'x' as id", "1 as score", "'y' as fp", "2 as block").coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return request.param, str(path)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    kind, path = tables
    rows = queries.QUERIES[name](spark, path).collect()
    source = {"op1": "embeddings", "op5": None, "op6": "pages", "op12": None, "op13": None}.get(name.split("_")[0], "documents")
    if kind == "empty":
        assert len(rows) == (name == "op5_chat")  # the contract's own conversation
    elif source and name not in ("op4_mixing", "op8_packing"):
        assert len(rows) == len(TABLES[source][1])
    elif name == "op12_ranked_search":
        assert {r.item_id for r in rows} == {1, None} and [r.rank for r in rows if r.item_id is None] == list(range(1, 13 + 1))
    elif name == "op13_turn_repair":
        assert {r.conv_id for r in rows} == {1, 2, None} and len(rows) == 3
    elif name == "op5_chat":
        assert {r.conv_id: r.n_turns for r in rows} == {-7: 2, 1: 3, 2: 1, None: 1}


def test_pipeline(spark, tables):
    kind, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    assert kind == "odd" or corpus_pipeline.run(spark, path).count() == 0
