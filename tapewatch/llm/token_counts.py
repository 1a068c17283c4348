"""Operator 10: token counts by batch encoding in Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import by_bytes

#: Bytes of text in a batch given to the tokenizer, and characters above which a text is split.
BATCH_BYTES, SPLIT_CHARS = 1 << 20, 16_384


@lru_cache(maxsize=2)
def _sentencepiece(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    # Merges never cross from a character to a following space if no piece does.
    return model, not any("▁" in p.lstrip("▁") for p in pieces)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def split_at_spaces(text: str, size: int) -> list[str]:
    """Parts of about size characters; each cut stands before a single space that parts two letters.

    The space is dropped, because the tokenizer puts one before every text that it is given.
    """
    parts, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and not (text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    parts.append(text[start:])
    return parts


def balanced(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Batches of texts with about the same number of characters."""
    batch, held = [], 0
    for t in texts:
        batch.append(t)
        held += len(t)
        if held >= limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def count_texts(texts: list[str], path: str, split_chars: int = SPLIT_CHARS) -> list[int]:
    """Tokens of each text, without begin, end or added special tokens."""
    counts = [0] * len(texts)
    if path.endswith(".model"):
        model, splittable = _sentencepiece(path)
        owner, parts = [], []
        for i, t in enumerate(texts):
            for part in split_at_spaces(t, split_chars) if splittable and len(t) > split_chars else (t,):
                owner.append(i)
                parts.append(part)
        at = 0
        for batch in balanced(parts, BATCH_BYTES):
            for ids in model.encode(batch, num_threads=1):
                counts[owner[at]] += len(ids)
                at += 1
        return counts
    tok, at = _tokenizer(path), 0
    for batch in balanced(texts, BATCH_BYTES):
        for e in tok.encode_batch_fast(batch, add_special_tokens=False):
            counts[at] = len(e)
            at += 1
    return counts


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows each give a
    row; an empty table gives none; other columns of docs, whatever their names, are not read. Long
    texts are split only where no token can cross (for .model files: before a single space between
    letters or digits, as no piece of the vocabulary holds a space after another character).
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    out_type = pa.int64()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            counts = count_texts(texts, tokenizer_path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, out_type), pa.array(counts, out_type)], names=["id", "n_bytes", "n_tokens"])

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lengths, schema)
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
