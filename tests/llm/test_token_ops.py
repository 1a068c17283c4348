"""Token counts and packing against the libraries on whole texts."""

import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapewatch.llm import packing, queries, token_counts
from tests.llm.cases import TEXTS, documents

MODEL, WORDS, BYTES = map(public_tokenizers.path, ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [MODEL, WORDS, BYTES])
def test_counts_equal_whole_text_encoding(spark, sf, path):
    if path == MODEL:
        one = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(t))
    else:
        one = lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(documents(spark), path, limit=5).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or -1, len((t or "").encode()), one(t or ""), one(t or "") > 5) for i, t, *_ in TEXTS)


def test_long_texts_are_split_where_no_token_crosses(sf, spark):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for _, t, *_ in TEXTS]
    for size in (7, 50, 500):
        assert token_counts.count_texts(texts, MODEL, split_chars=size) == [len(m.encode(t)) for t in texts]


def test_op10_query(spark, sf):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r.doc_id: len(m.encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, sf).collect()} == want


def check_packing(rows, texts, capacity):
    tok = Tokenizer.from_file(WORDS)
    want = sorted((i if i is not None else -1, p, 4 * 0 + at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for i, t in texts for ids in [[*tok.encode(t or "", add_special_tokens=False).ids, 1]] for p, (at, part) in enumerate((a, ids[a : a + capacity]) for a in range(0, len(ids), capacity)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing_cases(spark):
    rows = packing.pack_documents(documents(spark), WORDS, 64).collect()
    n, least = check_packing(rows, [(i, t) for i, t, *_ in TEXTS], 64)
    assert least <= n <= least + 3
    assert packing.pack_documents(documents(spark, []), WORDS).count() == 0


def test_op8_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = check_packing(queries.op8_packing(spark, sf).collect(), texts, 4096)
    assert n <= least + 1


@pytest.mark.parametrize("case", ["mixed", "halves", "tiny", "one"])
def test_sweeps_fill_like_best_fit_decreasing(spark, case):
    rng, cap = np.random.default_rng(5), 64
    lengths = {"mixed": lambda: rng.integers(1, cap + 1, 900), "halves": lambda: rng.integers(20, 41, 700), "tiny": lambda: rng.integers(1, 4, 3000), "one": lambda: np.full(130, 7)}[case]().tolist()
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else cap) - x)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "i int, length bigint")
    bins = defaultdict(list)
    rows = packing.pack_best_fit(df, cap, rows_per_salt=100, block=64).collect()
    assert sorted(r.i for r in rows) == list(range(len(lengths)))
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(bins) <= len(gaps) * 1.02 + 1
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap


def test_a_sweep_gives_each_gap_the_longest_piece_below_it():
    out = packing.sweep([(5, False, 0, 2), (9, False, 0, 1), (6, True, 0, 1), (10, True, 1, 2), (4, True, 3, 1)], 10)
    placed = {(o[1], o[2], o[5], o[6]) for o in out if o[0] == packing.PLACED}
    assert placed == {(5, 0, 0, 4), (9, 0, 1, 0), (5, 1, 2, 0)}
    assert sorted(o[1:4] for o in out if o[0] == packing.GAP) == [(1, 0, 1), (1, 1, 1), (4, 3, 1), (5, 2, 1)]


def test_ids_equal_whole_text_encoding_for_letters_that_normalisation_changes():
    tok, rng = Tokenizer.from_file(WORDS), np.random.default_rng(8)
    odd = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and (len(chr(c).lower()) > 1 or len(unicodedata.normalize("NFC", chr(c))) > 1)]
    texts = [f"x{c}. {c}, a{c}b!" for c in odd]
    letters = [*"abcXYZ", "\u00e9", "e\u0301", "\u00df", "\u0130", "\u03a3", "\u0958", "\u4e2d", "1", "'s", "\u200b", "\u00a0", *odd]
    texts += ["".join(rng.choice([*letters, " ", ".", ",", "!", "###", "|", "\n"]) for _ in range(20)) for _ in range(4000)]
    assert len(odd) > 50
    for text, raw in zip(texts, packing.encode_texts([t.encode() for t in texts], WORDS)):
        assert np.frombuffer(raw, "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1], text
