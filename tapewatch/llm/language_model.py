"""Operator 9: scoring texts with a weighted backoff automaton over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import doc_fold, keep

#: Hash of the token that ends a text, and the order of the model: a state is up to ORDER - 1 tokens.
END = np.uint64(xxhash.xxh64_intdigest(b" "))
ORDER = 3
#: Smoothing mass of the states before each order's arcs: what a failure arc weighs against the state's own counts.
MASSES = {2: 300.0, 3: 50.0}
#: Bits of an n-gram's hash that are compared, bytes of text after which a block ends, and bytes of text for each key range.
KEY_BITS = 56
DROP = np.uint64(64 - KEY_BITS)
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 1 << 24


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer, so that keys made of two others are spread evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the number of tokens of each text, its end included."""
    digest, parts, lengths, end = xxhash.xxh64_intdigest, [], [], np.array([END], np.uint64)
    for t in texts:
        words = (t or b"").lower().split()
        parts += [np.fromiter(map(digest, words), np.uint64, len(words)), end]
        lengths.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(lengths, np.int64)


def grams(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, keys, positions, lengths) of the n-grams of each order up to ORDER.

    Before the first token of a text stands the end of the one before; n-grams that would reach
    further back don't exist, so an n-gram of order k > 2 ends at the text's token k - 1 or later.
    """
    one, lengths = tokens(texts)
    index = np.arange(len(one)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys, every = one, np.arange(len(one))
    yield 1, keys >> DROP, every, lengths
    for order in range(2, ORDER + 1):
        before = np.concatenate([[END], keys[:-1]]).astype(np.uint64) if len(keys) else keys
        with np.errstate(over="ignore"):
            keys = _mix(before * np.uint64(0x9E3779B97F4A7C15) + one)
        at = every if order == 2 else np.flatnonzero(index >= order - 2)
        yield order, keys[at] >> DROP, at, lengths


def planes(x: np.ndarray) -> bytes:
    """Compressed bytes by significance: neighbouring values share their high bytes."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def narrow(x: np.ndarray) -> tuple[bytes, int]:
    """planes of x in the narrowest unsigned type that holds it, and that type's bytes."""
    kind = np.min_scalar_type(x.max(initial=0))
    return planes(x.astype(kind)), kind.itemsize


def slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of sorted keys that fall into each of equal key ranges."""
    of = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(keys)]):
        if b > a:
            yield int(of[a]), int(a), int(b)


def checksum(keys: np.ndarray) -> int:
    return int(keys.sum(dtype=np.uint64).view(np.int64))


def in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches (row number, learn, text, ...) with their block: the number of its first row.

    A block ends after size bytes of text, so the same rows always give the same blocks.
    """
    block, held = None, 0
    for b in batches:
        start = 0
        for i, n in enumerate(pa.compute.binary_length(b.column(2)).to_pylist()):
            if block is None:
                block = b.column(0)[i].as_py()
            held += n or 0
            if held >= size:
                yield block, b.slice(start, i + 1 - start)
                start, block, held = i + 1, None, 0
        if start < b.num_rows:
            yield block, b.slice(start)


def block_counts(texts: list[bytes | None], learn: list[bool], buckets: int) -> Iterator[tuple[int, int, bytes, bytes, int]]:
    """(order, bucket, keys, counts, checksum): the block's distinct n-grams, and how often texts to learn from hold them."""
    for order, keys, at, lengths in grams(texts):
        counted = np.repeat(np.array(learn, bool), lengths)[at]
        distinct, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse[counted], minlength=len(distinct)).astype(np.uint32)
        del inverse, counted
        for bucket, a, b in slices(distinct, buckets):
            yield order, bucket, planes(np.diff(distinct[a:b], prepend=np.uint64(0))), planes(counts[a:b]), checksum(distinct[a:b])


def traverse(texts: list[bytes | None], totals: dict[int, np.ndarray], checks: dict[int, int], n: int, v: int, masses: dict[int, float]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and model score of each text.

    The state before a token is the longest learned n-gram of fewer than ORDER tokens that ends
    there. It has an arc for each token that was learned after it; any other token takes the
    failure arc, which costs the state's failure weight, to the state that is one token shorter,
    down to the empty state, which has an arc for every token. Learned arcs carry the share of
    the shorter state's weight that their own counts leave (Dirichlet smoothing), so the weights
    of a state add up to one. A text is passed once, left to right, and the logarithms of its
    weights are added up; the states of all positions of a block are one array each. totals holds
    the learned counts of the block's distinct keys, in key order.
    """
    known = base = weight = state = None
    for order, keys, at, lengths in grams(texts):
        distinct, inverse = np.unique(keys, return_inverse=True)
        got = totals.pop(order, np.zeros(0, np.uint32))
        if len(got) != len(distinct) or checks.get(order, 0) != checksum(distinct):
            raise RuntimeError("the documents changed between the two passes; give a written table or materialize=True")
        arc = np.zeros(len(inverse) if order == 1 else len(weight))
        arc[at] = got[inverse]
        del inverse, distinct, keys, got
        if order == 1:
            owner = np.repeat(np.arange(len(lengths)), lengths)
            known, base = arc > 0, (arc + 0.5) / (n + 0.5 * (v + 1))
            weight = base.copy()
            # The state before a text's first token is the end of a text.
            state = np.concatenate([arc[lengths[0] - 1 : lengths[0]], arc[:-1]]) if len(arc) else arc
            continue
        mass = masses[order]
        failure = np.where(state > 0, mass / (state + mass), 1.0)
        weight = np.where(arc > 0, arc / (state + mass) + failure * weight, failure * weight)
        first = np.zeros(len(arc), bool)
        first[np.cumsum(lengths) - lengths] = True
        state = np.where(first, 0.0, np.concatenate([[0.0], arc[:-1]])) if len(arc) else arc
    add = lambda x: np.bincount(owner, x, len(lengths))
    return lengths, add(known), add(np.log10(base)), add(np.log10(weight))


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", masses: dict[int, float] | None = None, materialize: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id_col, learned, n_tokens, n_known, train_tokens, base_score, score for every row.

    learn is a boolean column: the rows that the model is learned from. Blocks of rows count
    their distinct n-grams of up to ORDER tokens; the counts meet in key ranges, each n-gram's total
    goes back to the blocks that hold it, and each block then traverses its texts with just the
    states and arcs that these need. No table of the model is ever in one place, no word's
    n-grams have to meet in one task, and there are as many key ranges as the bytes of all texts
    need, so a range takes the same memory whatever the size of the corpus.

    docs must give the same rows in the same order twice (a scan does, and it is checked);
    otherwise materialize=True writes them first. Null and empty texts are one end token; a text
    longer than a block is a block of its own; null ids and repeated rows each give a row; an empty
    table gives none; further columns are not read. With nothing to learn from, all tokens are unknown.
    """
    masses = masses or MASSES
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").cast("binary").alias("text"))
    if materialize:
        rows = keep(rows)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, -(-size // bucket_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "learn", "text", "id")
    key_names = ["block", "ord", "bucket", "keys", "counts", "sum"]
    total_names = ["block", "ord", "bucket", "totals", "width", "sum", "types", "tokens"]
    text_names = ["block", "sizes", "texts", "learn", "id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, learned, at = [], [], None

        def done() -> Iterator[pa.RecordBatch]:
            got = list(block_counts(texts, learned, buckets))
            for i in range(0, len(got), 16):
                order, bucket, keys, counts, check = zip(*got[i : i + 16])
                ints = [pa.array(x, t) for x, t in ((order, pa.int32()), (bucket, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(order), pa.int64()), *ints, pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(check, pa.int64())], names=key_names)

        for block, part in in_blocks(batches, block_bytes):
            if block != at:
                yield from done()
                texts, learned, at = [], [], block
            learned += part.column(1).to_pylist()
            texts += part.column(2).to_pylist()
        yield from done()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each slice of a block, with its texts compressed."""
        for block, part in in_blocks(batches, block_bytes):
            texts = [t or b"" for t in part.column(2).to_pylist()]
            one = pa.array([0, part.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, c) for c in (pa.array(list(map(len, texts)), pa.int64()), part.column(1), part.column(3))]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists[0], pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary()), *lists[1:]], names=text_names)

    def total(group: pa.Table) -> pa.Table:
        held = [np.cumsum(unplanes(k, np.uint64), dtype=np.uint64) for k in group["keys"].to_pylist()]
        ends = np.cumsum([len(k) for k in held])
        distinct, inverse = np.unique(np.concatenate(held), return_inverse=True)
        counts = np.concatenate([unplanes(c, np.uint32) for c in group["counts"].to_pylist()])
        sums = np.bincount(inverse, counts, len(distinct)).astype(np.uint64)
        back, widths = zip(*(narrow(sums[inverse[e - len(k) : e]]) for k, e in zip(held, ends)))
        first = [1] + [0] * (len(back) - 1)
        types, learned = ([int(x) * f for f in first] for x in ((sums > 0).sum(), sums.sum(dtype=np.int64)))
        return pa.table([group["block"], group["ord"], group["bucket"], pa.array(back, pa.binary()), pa.array(widths, pa.int32()), group["sum"], pa.array(types, pa.int64()), pa.array(learned, pa.int64())], names=total_names)

    counted = rows.drop("id").mapInArrow(count, "block bigint, ord int, bucket int, keys binary, counts binary, sum bigint")
    totals = counted.groupBy("ord", "bucket").applyInArrow(total, "block bigint, ord int, bucket int, totals binary, width int, sum bigint, types bigint, tokens bigint")
    totals = keep(totals)
    known = totals.filter("ord = 1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    v, n = int(known[0]), int(known[1])

    def score(texts: pa.Table, sums: pa.Table) -> pa.Table:
        order = np.lexsort((sums["bucket"].to_numpy(), sums["ord"].to_numpy()))
        parts, checks = {}, {}
        for o, t, width, check in zip(*(sums[c].take(order).to_pylist() for c in ("ord", "totals", "width", "sum"))):
            parts.setdefault(o, []).append(unplanes(t, f"u{width}"))
            checks[o] = (checks.get(o, 0) + check + 2**63) % 2**64 - 2**63
        found = []
        for sizes, raw in zip(texts["sizes"].to_pylist(), texts["texts"].to_pylist()):
            whole, at = zstandard.decompress(raw), 0
            for k in sizes:
                found.append(whole[at : at + k])
                at += k
        got = traverse(found, {o: np.concatenate(p) for o, p in parts.items()}, checks, n, v, masses)
        cols = [pa.array(x.astype(np.int64), pa.int64()) for x in got[:2]] + [pa.array(x, pa.float64()) for x in got[2:]]
        flat = [pa.compute.list_flatten(texts[c].combine_chunks()) for c in ("id", "learn")]
        return pa.table([*flat, *cols], names=["id", "learned", "n_tokens", "n_known", "base_score", "score"])

    # The slices of a block come in any order: its distinct keys, and so the totals, don't depend on it,
    # and the token before the first one of a text is the end of a text in any order.
    tagged = rows.mapInArrow(tag, f"block bigint, sizes array<bigint>, texts binary, learn array<boolean>, id array<{kind}>")
    scored = tagged.groupBy("block").cogroup(totals.select("block", "ord", "bucket", "totals", "width", "sum").groupBy("block"))
    out = scored.applyInArrow(score, f"id {kind}, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "learned", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def fold_scores(docs: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """score_texts learned from the documents outside the held-out fold of their ids."""
    out = score_texts(docs, doc_fold(F.col("doc_id")) != held_out_fold)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
