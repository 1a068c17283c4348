"""Operator 12: ranked lexical search over document-sharded postings with integer impacts."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.llm.common import by_bytes, keep

#: Bytes of text in a shard, bytes of text that are cut into terms at once, and bytes of the items' terms in a block of queries.
SHARD_BYTES, CUT_BYTES, BLOCK_BYTES = 1 << 24, 1 << 20, 1 << 22
#: ASCII letters and digits make terms, as does everything beyond ASCII; A-Z are lowered.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SHARD = "n_docs bigint, terms binary, starts binary, docs binary, impacts binary, ids binary"


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about CUT_BYTES; no term is cut."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + CUT_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def sql_terms(text: Column) -> Column:
    """The same terms as an array column, for the short texts of queries."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != "")


def corpus_totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: N, the documents with a term, and L, all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = terms = 0
        for b in by_bytes(batches, 0):
            for t in b.column(0):
                n = sum(map(len, term_lists(t.as_py())))
                some, terms = some + (n > 0), terms + n
        yield pa.RecordBatch.from_pylist([{"N": some, "L": terms}])

    counts = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "N bigint, L bigint")
    return counts.agg(F.coalesce(F.sum("N"), F.lit(0)).alias("N"), F.coalesce(F.sum("L"), F.lit(0)).alias("L"))


class ShardBuilder:
    """Gathers documents and turns them into one row of SHARD."""

    def __init__(self, n_all: int, l_all: int) -> None:
        self.n_all, self.l_all, self.held = n_all, l_all, 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.seen: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # term, document, times

    def add(self, doc_id: int | None, text: str | None) -> None:
        seen, at, n, found = self.seen, len(self.ids), 0, []
        for terms in term_lists(text):
            n += len(terms)
            found.append(np.unique(np.fromiter((seen.setdefault(t, len(seen)) for t in terms), np.int32, len(terms)), return_counts=True))
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.held += len(text or "") + 64
        if found:
            term, times = found[0]
            if len(found) > 1:
                term, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                times = np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)
            self.parts.append((term, np.full(len(term), at, np.int32), times))

    def row(self) -> dict:
        """Documents by ascending id (null first), terms in the order in which they came, each term's documents ascending."""
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, known))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        term, doc, tf = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for k in range(3))
        doc = place[doc.astype(np.int64)]
        by_term = np.lexsort((doc, term))
        term, doc, tf = term[by_term], doc[by_term], tf[by_term].astype(np.int64)
        length = np.array(self.lengths, np.int64)[order]
        norm = 50 + (50 * length * self.n_all) // max(self.l_all, 1)
        impact = (1_000_000_000 * tf) // np.maximum(1000 * tf + 20 * norm[doc], 1)
        starts = np.searchsorted(term, np.arange(len(self.seen) + 1)).astype(np.int64)
        ids_column = pa.array(ids[order], pa.int64(), mask=~known[order])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
            w.write_batch(pa.record_batch([ids_column], ["id"]))
        return {"n_docs": len(ids), "terms": b" ".join(self.seen), "starts": starts.tobytes(), "docs": doc.astype(np.int32).tobytes(), "impacts": impact.astype(np.int32).tobytes(), "ids": sink.getvalue().to_pybytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs: a row of SHARD for each shard of documents, with N and L.

    A shard holds about shard_bytes of text, whatever part of the table its task reads, and a longer
    document is a shard of its own; no text is shuffled. Its postings are in compressed sparse rows:
    by term, the documents that hold it and their impacts (1e9 tf) div (1000 tf + 20 m), which fit 32 bits
    as they stay below a million. Only the corpus' two totals come from beforehand. Null texts have no
    terms; rows that repeat an id are documents of their own; further columns are not read. Write
    the result as a table to search it again.
    """
    totals = corpus_totals(docs, text_col).first()
    n_all, l_all = totals["N"], totals["L"]
    schema = f"{SHARD}, N bigint, L bigint"
    kinds = pa.schema([(f.split()[0], {"bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder(n_all, l_all)
        out = lambda: pa.RecordBatch.from_pylist([{**shard.row(), "N": n_all, "L": l_all}], kinds)
        for b in by_bytes(batches, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                shard.add(doc_id, text.as_py())
                if shard.held >= shard_bytes:
                    yield out()
                    shard = ShardBuilder(n_all, l_all)
        if shard.ids:
            yield out()

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest positive scores, highest first; of equal ones the smaller places."""
    hit = np.flatnonzero(scores > 0)
    if len(hit) > k:
        own = scores[hit]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k]]  # the k-th highest
        above = hit[own > least]
        hit = np.concatenate([above, hit[own == least][: k - len(above)]])  # hit ascends, so ties go to the smaller places
    return hit[np.lexsort((hit, -scores[hit]))]


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: each term of an item once; rows that repeat an item are one item."""
    return items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.explode(sql_terms(F.col(f"`{text_col}`").cast("string"))).alias("term")).distinct()


def document_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: in how many documents of the index each of a block's terms occurs (at least once)."""
    block = terms.agg(F.collect_set("term").alias("wanted"))  # one row, bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        wanted: set[bytes] = set()
        for b in batches:
            for i in range(b.num_rows):
                if not wanted:
                    wanted = {t.encode() for t in b.column(2)[i].as_py()}
                starts = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                for k, t in enumerate(b.column(0)[i].as_py().split(b" ")):
                    if t in wanted:
                        total[t] = total.get(t, 0) + int(starts[k + 1] - starts[k])
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "df"])

    found = index.filter("length(terms) > 0").select("terms", "starts").join(F.broadcast(block)).mapInArrow(run, "term string, df bigint")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


def term_weight(n_all: int, df: int) -> int:
    return floor(1000 * log((2 * n_all + 2) / (2 * df + 1)))


def search_block(index: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: each task's k best documents of each item of a block."""
    counted = terms.join(document_counts(index, terms), "term")
    asked = counted.groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    asked = keep(asked.agg(F.collect_list(F.struct("item", "terms")).alias("asked")))  # one row, bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[dict] | None = None
        held: dict[int, tuple] = {}  # item's number: scores and ids so far
        for b in batches:
            for i in range(b.num_rows):
                if items is None:
                    items, n_all = b.column(7)[i].as_py(), b.column(6)[i].as_py()
                    weighed = [[(t["term"].encode(), term_weight(n_all, t["df"])) for t in x["terms"]] for x in items]
                    needed = {t for x in weighed for t, _ in x}
                at = {t: n for n, t in enumerate(b.column(1)[i].as_py().split(b" ")) if t in needed}
                starts, docs, impacts = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int32), (4, np.int32)))
                ids = pa.ipc.open_stream(b.column(5)[i].as_buffer()).read_all().column(0).to_pylist()
                for n, x in enumerate(weighed):
                    scores = np.zeros(len(ids), np.int64)
                    for t, weight in x:  # term at a time; a term's documents are distinct
                        place = at.get(t)
                        if place is not None:
                            span = slice(starts[place], starts[place + 1])
                            scores[docs[span]] += weight * impacts[span].astype(np.int64)
                    top = best(scores, k)
                    if len(top):
                        found = [*held.get(n, ()), *((-int(scores[d]), ids[d] is not None, ids[d] or 0) for d in top)]
                        held[n] = tuple(sorted(found)[:k])
        rows = [{"item": items[n]["item"], "doc_id": i if known else None, "score": -s} for n, found in held.items() for s, known, i in found]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    shards = index.filter("length(terms) > 0").select("n_docs", "terms", "starts", "docs", "impacts", "ids", "N")
    return shards.join(F.broadcast(asked)).mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(index: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    Items are dealt by hash into blocks of about block_bytes of terms, and each block is held against all shards: a
    shard is a dense array of scores, to which each term's impacts times its weight are added one
    term at a time. Shards give their best k, tasks merge theirs, and the last merge ranks them;
    equal scores go by ascending doc_id (null first), so every document that could be among the k best gets there. An item
    without terms (null, empty) or without a hit gives no row, and so does an empty index.
    """
    terms = keep(item_terms(items, item_col, text_col))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / block_bytes))
    found = None
    for b in range(blocks):
        part = search_block(index, terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
