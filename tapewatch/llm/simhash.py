"""Operator 2: near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.llm.common import by_bytes, join_small_keys, keep
from tapewatch.operators.components import component_labels

BITS, SEED = 64, 42
#: Entries of a bucket from which it is joined through its components.
HOT = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the lower-cased text's word shingles, as a signed 64-bit number."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
        starts = [0, *(e + 1 for e in ends)]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id_col and fp (signed long) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t or b"", shingle) for t in texts], pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def ball(width: int, radius: int) -> list[int]:
    """All masks of width bits with at most radius ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def segment_plan(n: int, distance: int = 4, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment, chosen for n fingerprints.

    If the radii plus one add up to distance + 1, two fingerprints that differ in at most distance
    bits differ in at most radius bits within some segment. Among such plans the one with the
    least work (probes, and matches expected of unrelated fingerprints) is taken; any plan finds
    every pair.
    """
    best = None
    for m in range(1, distance + 2):
        base, extra = divmod(distance + 1, m)
        radii = [base + (i < extra) - 1 for i in range(m)]
        for lead in range(-8, 17, 4):  # segments with a larger radius may be wider
            wide = [bits // m + (lead if r == max(radii) and len(set(radii)) > 1 else 0) for r in radii]
            wide[-1] += bits - sum(wide)
            if min(wide) < 8:
                continue
            probes = [sum(_choose(w, k) for k in range(r + 1)) for w, r in zip(wide, radii)]
            work = sum(p * n * (1 + n / 2.0**w / 4) for p, w in zip(probes, wide))
            if max(probes) <= 2000 and (best is None or work < best[0]):
                best = (work, wide, radii)
    _, wide, radii = best
    return [(sum(wide[:i]), w, r) for i, (w, r) in enumerate(zip(wide, radii))]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def fingerprint_labels(fps: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """node, label: the components of the distinct fingerprints in fp under links of at most distance differing bits.

    Each fingerprint enters a table for each segment and probes it with the small Hamming ball around
    its own segment; whole distances are verified in the join. A bucket of more than HOT entries holds a
    class of near copies, or a segment that many share. There every probe is first verified
    against the bucket's smallest fingerprint alone, which joins a class by links in proportion
    to its size, and then only what these components leave apart is compared: entries outside of
    the bucket's most frequent component with all probes, and the others with probes outside of it. So
    no link between different components is lost, and no class is paired with itself.
    """
    plan = segment_plan(max(n, 2), distance)
    value = lambda shift, width: F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    segments = F.array(*(F.struct(F.lit(i).alias("seg"), value(s, w).alias("v")) for i, (s, w, _) in enumerate(plan)))

    def entered(df: DataFrame) -> DataFrame:
        return df.withColumn("e", F.explode(segments)).select(*df.columns, "e.seg", "e.v")

    def probing(df: DataFrame) -> DataFrame:
        parts = []
        for i, (s, w, r) in enumerate(plan):
            masks = F.array(*(F.lit(m).cast("long") for m in ball(w, r)))
            one = df.withColumns({"seg": F.lit(i), "v0": value(s, w)}).withColumn("m", F.explode(masks))
            parts.append(one.select(*df.columns, "seg", F.col("v0").bitwiseXOR(F.col("m")).alias("v")))
        return reduce(DataFrame.unionByName, parts)

    def met(probes: DataFrame, entries: DataFrame, *more) -> DataFrame:
        near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("e.fp"))) <= distance
        on = (F.col("p.seg") == F.col("e.seg")) & (F.col("p.v") == F.col("e.v")) & (F.col("p.fp") != F.col("e.fp")) & near
        both = probes.alias("p").join(entries.alias("e"), reduce(Column.__and__, more, on))
        return both.select(F.greatest("p.fp", "e.fp").alias("a"), F.least("p.fp", "e.fp").alias("b"))

    entries = keep(entered(fps.select("fp")))
    hot = keep(entries.groupBy("seg", "v").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("seg", "v", "first"))
    if not hot.limit(1).count():
        return component_labels(keep(met(probing(fps.select("fp")), entries).distinct()))
    cold = met(probing(fps.select("fp")), entries.join(hot, ["seg", "v"], "left_anti"))
    star = keep(met(probing(fps.select("fp")), hot.withColumnRenamed("first", "fp")).unionByName(cold).distinct())
    labels = component_labels(star).withColumnRenamed("node", "fp")
    named = keep(fps.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))  # read once a segment
    inside = keep(entered(named).join(hot.select("seg", "v"), ["seg", "v"]))
    counts = inside.groupBy("seg", "v", "label").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("seg", "v").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    inside = inside.join(most, ["seg", "v"])
    probes = keep(probing(named).join(most, ["seg", "v"]))
    apart = F.col("p.label") != F.col("e.label")
    rest = met(probes, inside.filter("label != most"), apart).unionByName(met(probes.filter("label != most"), inside.filter("label = most"), apart))
    rest = keep(rest.distinct())
    return component_labels(star.unionByName(rest)) if rest.limit(1).count() else labels.withColumnRenamed("fp", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """id_col, fp, fingerprint (hex), component_id (smallest id reachable by links).

    Equal fingerprints are one node, so copies are never paired with each other. Null and empty
    texts have fingerprint 0 and link like any other; very long texts are hashed whole, batches
    being sliced by bytes; rows with a null id are returned and take part, but a null id never
    names a component unless it has no other. Repeated rows each give a row, an empty table none,
    and further columns are not read.
    """
    return _classes(docs, id_col, text_col, shingle, distance).drop("label")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    """near_duplicates, and label: a number of the component's own, also where two share their smallest id."""
    rows = keep(fingerprints(docs, id_col, text_col, shingle))
    nodes = keep(rows.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n_rows")))
    total, n = nodes.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count(F.lit(1))).first()
    labels = fingerprint_labels(nodes.select("fp"), n, distance).withColumnRenamed("node", "fp")  # only nodes that have a link
    known = nodes.join(labels, "fp", "left").select("fp", "rep", "n_rows", F.coalesce("label", "fp").alias("label"))
    smallest = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    values = keep(known.join(smallest, "label").select("fp", "n_rows", "component_id", "label"))
    out = join_small_keys(rows, values, "fp", "n_rows", total)
    return out.select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "label")


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of docs, all columns unchanged, with the smallest id of their near-duplicate class.

    Of rows that repeat an id only the smallest stays in each class. Rows with a null id can't be told
    apart and go, unless no row of their class has an id; then they all stay. No column name of docs can clash.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    found = _classes(docs, "id", "text", shingle, distance)
    first = found.filter(F.col("id") == F.col("component_id")).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    named = docs.join(first.filter("rows = 1"), "id", "left_semi").select("row")
    again = first.filter("rows > 1").select("id")
    if again.limit(1).count():
        marked = fingerprints(docs.join(again, "id", "left_semi"), "row", "text", shingle).withColumn("id", F.col("row")[id_col])
        label = found.filter(F.col("id") == F.col("component_id")).select("id", "fp", "label").distinct()
        named = named.unionByName(marked.join(label, ["id", "fp"]).groupBy("id", "label").agg(F.min("row").alias("row")).select("row"))
    nameless = docs.filter(F.col("id").isNull())
    if nameless.limit(1).count():
        lone = found.filter(F.col("component_id").isNull()).select("fp").distinct()
        named = named.unionByName(fingerprints(nameless, "row", "text", shingle).join(lone, "fp", "left_semi").select("row"))
    return named.select("row.*")
