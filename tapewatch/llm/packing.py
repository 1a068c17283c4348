"""Operator 8: best-fit packing of token sequences."""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapewatch.llm.common import by_bytes, keep
from tapewatch.llm.token_counts import _tokenizer

#: Words whose ids a Python worker remembers, bytes of text encoded at a time, and new words put to the tokenizer as one text.
MEMO_WORDS, CHUNK_BYTES, JOINED = 800_000, 1 << 22, 64
#: Punctuation that a word may end with.
TAIL = b".,!%$#&*|"

#: Rows of the packing rounds, and the ranges of sizes in the first of them.
PIECE, GAP, PLACED = 0, 1, 2
RANGES = 4

_memo: dict[str, dict[bytes, bytes]] = {}


@lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """For each id, whether its token ends a word."""
    vocab = _tokenizer(path).get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return ends


def unchanged_letters(s: str) -> bool:
    """Whether s is letters alone, of scripts whose letters are old ones, that normalisation and lower-casing leave."""
    return s.isalpha() and max(s) < "\u0590" and s == s.lower() and unicodedata.is_normalized("NFC", s)


def encode_joined(words: list[str], path: str) -> Iterator[list[bytes] | None]:
    """The ids of JOINED words at a time, encoded as one text and cut after tokens that end a word.

    Words of letters that normalisation leaves as they are have one such token each; where the
    numbers of words and ends differ, the answer is None.
    """
    groups, ends = [words[i : i + JOINED] for i in range(0, len(words), JOINED)], word_ends(path)
    for group, e in zip(groups, _tokenizer(path).encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        cuts, raw = [0, *(4 * np.flatnonzero(ends[ids]) + 4).tolist()], ids.tobytes()
        yield [raw[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(group) + 1 and cuts[-1] == len(raw) else None


def encode_texts(texts: list[bytes], path: str, end_id: int = 1) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text and then end_id.

    This tokenizer lower-cases, never merges across white space, and never between letters and
    punctuation. So each distinct word is encoded once and remembered, and a new word of letters
    followed by TAIL characters is put together from its two parts, if normalisation leaves the
    letters as they are (others may gain a mark that goes with the punctuation). Texts that may hold the
    strings of added tokens keep their case.
    """
    tok, memo = _tokenizer(path), _memo.setdefault(path, {})
    end, at = np.array([end_id], "<u4").tobytes(), 0

    def learn(words: list[bytes]) -> None:
        plain, other = [], []
        for word in words:
            s = word.decode("utf-8", "replace")
            (plain if unchanged_letters(s) else other).append((word, s))
        for i in range(0, len(plain), 64 * JOINED):
            part = plain[i : i + 64 * JOINED]
            for k, found in enumerate(encode_joined([s for _, s in part], path)):
                group = part[k * JOINED : (k + 1) * JOINED]
                if found is None:
                    other += group
                else:
                    memo.update(zip([w for w, _ in group], found))
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for (word, _), e in zip(part, tok.encode_batch_fast([s for _, s in part], add_special_tokens=False)):
                memo[word] = array("I", e.ids).tobytes()

    while at < len(texts):
        chunk, held = [], 0
        while at < len(texts) and held < CHUNK_BYTES:
            text = texts[at]
            chunk.append((text if b"<|" in text else text.lower()).split())
            held += len(text)
            at += 1
        new = set().union(*chunk).difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = set().union(*chunk)
        whole, parted = [], []
        for word in new:
            core = word.rstrip(TAIL)
            if len(core) < len(word) and unchanged_letters(core.decode("utf-8", "replace")):
                parted.append((word, core, word[len(core) :]))
            else:
                whole.append(word)
        learn(whole)
        learn(list({x for _, core, tail in parted for x in (core, tail)}.difference(memo)))
        for word, core, tail in parted:
            memo[word] = memo[core] + memo[tail]
        for words in chunk:
            yield b"".join(map(memo.__getitem__, words)) + end


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32: every text's ids, cut only if longer than capacity."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")), T.StructField("piece", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            owner, starts, lengths, sums, pieces = [], [], [], [], []
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for i, ids in enumerate(encode_texts(texts, tokenizer_path)):
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(i)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    pieces.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)), pa.array(pieces, pa.int32())], names=schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sweep(events: list[tuple[int, bool, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """One successor sweep over a range of sizes: (kind, size, first, n, per_bin, first_bin, offset).

    events are runs (size, is_gap, first, n): n pieces of one length by rank, or n bins of one gap. In
    the order of sizes each gap takes the longest piece still waiting below it, so that a
    piece ends in the smallest gap that is left for it; of equal pieces those of the first ranks
    win. A gap of four or more lengths takes several equal pieces at once, up to half of it. Pieces
    without a gap and what is left of the gaps come back for the next round.
    """
    waiting: list[tuple[int, int, int]] = []
    out = []
    for size, is_gap, first, n in sorted(events):
        if not is_gap:
            waiting.append((size, first, n))
            continue
        while n and waiting:
            length, rank, left = waiting.pop()
            per = min(left, max(1, size // (2 * length)))
            bins = min(n, left // per)
            out.append((PLACED, length, rank, bins * per, per, first, capacity - size))
            if size > per * length:
                out.append((GAP, size - per * length, first, bins, 0, 0, 0))
            first, n = first + bins, n - bins
            if left > bins * per:
                waiting.append((length, rank + bins * per, left - bins * per))
        if n:
            out.append((GAP, size, first, n, 0, 0, 0))
    return out + [(PIECE, *run, 0, 0, 0) for run in waiting]


def best_fit_plan(lengths: DataFrame, capacity: int, ranges: int = RANGES) -> DataFrame:
    """length, _first, _n, _per, _bin, _offset: where the pieces of each length go, by their rank.

    lengths has length and n (the number of pieces). Bulk-synchronous best-fit: pieces and gaps
    are sorted into ranges of sizes, every range is swept by a task of its own, conflicts are
    resolved by rank, gaps are updated, and the next round has wider ranges, until no piece is
    left. Only pieces of at least half the longest one's length take part in a round, so that
    short ones stay for the last gaps. As many bins are opened at first as all tokens need; where
    a round over one range places nothing, those that its pieces need are added.

    Equal pieces and bins of equal gaps are kept as runs, so the tables have some ten thousand
    rows however many pieces there are; the driver sees one row of totals a round.
    """
    names = ("kind", "size", "first", "n", "per", "bin", "offset")
    schema = ", ".join(f"{c} bigint" for c in names)
    spark = lengths.sparkSession
    zero = F.lit(0).cast("long")
    is_piece, is_gap, is_placed = (F.col("kind") == k for k in (PIECE, GAP, PLACED))

    def run(group: pa.Table) -> pa.Table:
        kinds = (k == GAP for k in group["kind"].to_pylist())
        events = list(zip(group["size"].to_pylist(), kinds, group["first"].to_pylist(), group["n"].to_pylist()))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*sweep(events, capacity))], names=names)

    def total(df: DataFrame, which, *values) -> list[int]:
        return [x or 0 for x in df.filter(which).agg(*values).first()]

    tokens = F.sum(F.col("size") * F.col("n"))
    state = lengths.select(F.lit(PIECE).cast("long").alias("kind"), F.col("length").alias("size"), zero.alias("first"), "n", zero.alias("per"), zero.alias("bin"), zero.alias("offset"))
    rounds, n_bins, stuck = [spark.createDataFrame([], schema)], 0, True
    need, longest = total(state, is_piece, tokens, F.max("size"))
    while longest:
        least = longest // 2
        if stuck:
            more = -(-need // capacity)
            state = state.unionByName(spark.createDataFrame([(GAP, capacity, n_bins, more, 0, 0, 0)], schema))
            n_bins += more
        at = F.floor((F.col("size") - 1) * ranges / capacity)
        swept = state.filter(F.col("size") >= least).groupBy(at.alias("range")).applyInArrow(run, schema)
        # A few ten thousand rows: as many files as ranges, so that rounds don't add up partitions.
        state = keep(swept.unionByName(state.filter(F.col("size") < least)).coalesce(RANGES))
        rounds.append(state.filter(is_placed))
        longest, done = total(state, ~is_gap, F.max(F.when(is_piece, F.col("size"))), F.count(F.when(is_placed, 1)))
        state, stuck, ranges = state.filter(~is_placed), ranges == 1 and not done, max(1, ranges // 2)
        need = total(state, is_piece & (F.col("size") >= longest // 2), tokens)[0] if stuck else 0
    plan = reduce(DataFrame.unionByName, rounds)
    return plan.select(F.col("size").alias("length"), *(F.col(c).alias(f"_{c}") for c in names[2:]))


def pack_best_fit(pieces: DataFrame, capacity: int, rows_per_salt: int = 20_000, block: int = 1 << 16) -> DataFrame:
    """pieces (with a column length of 1 to capacity) plus sequence_id and offset.

    Pieces are sorted into (length, salt) cells and ranked there; the cells' counts give each
    piece its rank within its length, without gathering a length in one task. best_fit_plan places
    the runs of ranks, and each piece finds the run that holds its rank by a join on length and
    block of ranks.
    """
    rows = keep(pieces.withColumn("_uid", F.monotonically_increasing_id()))
    n = rows.count()
    salt = F.pmod(F.xxhash64("_uid"), F.lit(max(1, -(-n // rows_per_salt)))).alias("_salt")
    cells = keep(rows.groupBy("length", salt).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    plan = best_fit_plan(cells.groupBy("length").agg(F.sum("_n").alias("n")), capacity)
    cells = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("_uid")
    ranked = rows.withColumn("_salt", salt).withColumn("_row", F.row_number().over(within) - 1).join(cells, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row")).withColumn("_block", F.expr(f"_rank div {block}"))
    plan = plan.withColumn("_block", F.explode(F.expr(f"sequence(_first div {block}, (_first + _n - 1) div {block})")))
    within_run = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n"))
    met = ranked.alias("r").join(plan.alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("r._block") == F.col("p._block")) & within_run)
    at = F.col("_rank") - F.col("_first")
    return met.select(
        *(F.col(f"r.{c}") for c in pieces.columns),
        (F.col("_bin") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_per")) * F.col("r.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset for all texts.

    A null or empty text is one piece holding the end id alone; a very long one is cut into pieces of
    capacity ids and a last one, and batches are sliced by bytes, so a task holds a few texts at a
    time. Repeated rows are packed each by
    itself, a null id stays null, an empty table gives an empty result, and columns of docs
    besides the id and the text are not read.
    """
    packed = pack_best_fit(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity)
    return packed.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
