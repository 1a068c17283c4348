"""The pipeline against the same stages in plain Python, and its stages' contracts."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from tapewatch.llm import line_crf, mixing, packing, rules, simhash
from tests.llm.cases import TEXTS, documents
from tests.llm.test_mixing import brute_count
from tests.llm.test_rules_chat import brute
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_token_ops import check_packing


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_pipeline_equals_plain_python(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = line_crf.fit_model(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    good = [d for d in docs if line_crf.text_scores([d["text"]], model)[0][0] >= 0.3]
    table = spark.createDataFrame([tuple(d.values()) for d in good], spark.read.parquet(f"{sf}/documents.parquet").schema)
    kept = {r.doc_id for r in rules.quality_rules(table).collect() if r.kept}
    assert not any(brute(d["text"])[-1] for d in good if d["doc_id"] in kept)
    ruled = [d for d in good if d["doc_id"] in kept]
    roots = brute_components([brute_fingerprint(d["text"]) for d in ruled])
    least = defaultdict(lambda: 1 << 60)
    for d, r in zip(ruled, roots):
        least[r] = min(least[r], d["doc_id"])
    single = [d for d, r in zip(ruled, roots) if least[r] == d["doc_id"]]
    sizes = Counter(d["source"] for d in single)
    whole = sum(n**0.5 for n in sizes.values())
    texts = [(d["doc_id"], d["text"]) for d in single for _ in range(brute_count(d["doc_id"], d["source"], len(single) * sizes[d["source"]] ** 0.5 / whole / sizes[d["source"]]))]
    rows = corpus_pipeline.run(spark, sf).collect()
    n, lower = check_packing(rows, texts, 4096)
    assert n <= lower + 1
    assert zlib and packing and mixing


def test_filters_on_cases(spark):
    docs = documents(spark)
    model = line_crf.fit([(*line_crf.line_measures(t), int(i % 2)) for i, (_, t, *_) in enumerate(TEXTS)])
    assert line_crf.filter_documents(docs, model).columns == docs.columns
    assert rules.filter_documents(docs).count() == sum(r.kept for r in rules.quality_rules(docs).collect())
    left = simhash.first_of_each_class(docs).collect()
    assert sorted(r.doc_id for r in left) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect() if r.component_id is not None}) if all(r.doc_id is not None for r in left) else left
    lone = documents(spark, [(None, "only these words are here", "en", "a"), (None, "only these words are here", "en", "a"), (1, "quite another text is this one", "en", "a")])
    assert simhash.first_of_each_class(lone).count() == 3
    empty = documents(spark, [])
    assert rules.filter_documents(empty).count() == line_crf.filter_documents(empty, model).count() == simhash.first_of_each_class(empty).count() == 0
