"""Operator 7: quality rules with thresholds from mergeable quantile sketches. DataFrame only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.llm.common import join_small_keys, keep, let, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Binary digits of a sketch's buckets, quartile distances between a quartile and its fence, share of the way from the
#: fence to the first TAILTH part of the rows beyond it, standard deviations of a count that its limit allows, and
#: rows' weight of the wider group in a group's limits.
DIGITS, FENCE, REACH, TAILTH, SIGMAS, PRIOR_ROWS = 9, 3.0, 0.25, 10, 4.0, 20.0
#: Measures: a count, what it is a rate of, and the parts of a whole that its rate is counted in.
MEASURES = {"symbols": ("n_symbols", "word_chars", 1_000_000), "dup_lines": ("n_dup_lines", "n_lines", 1_000_000), "word_length": ("word_chars", "n_words", 1000)}


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of size words found twice or more in the text.

    Windows are compared by 64-bit hashes. They are sorted, equal neighbours give the positions
    of repeated windows, and each position covers the words up to the next one, at most size.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def starts(s: Column) -> Column:
            h = lambda j: F.element_at(s, j)["h"]
            n = F.size(s)
            twice = lambda j: F.when(j > 1, h(j) == h(F.greatest(j - 1, F.lit(1)))).otherwise(False) | F.when(j < n, h(j) == h(F.least(j + 1, n))).otherwise(False)
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), n), twice), lambda j: F.element_at(s, j)["at"]))

        def total(p: Column) -> Column:
            step = lambda j: F.when(j < F.size(p), F.least(F.lit(size), F.element_at(p, F.least(j + 1, F.size(p))) - F.element_at(p, j))).otherwise(size)
            return F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0).cast("long"), lambda acc, j: acc + step(j))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(placed, starts), total))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(let(windows, covered))


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The counts of the rules for every row, and the group columns with null as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    rows = docs.select(
        F.col(id_col),
        *(F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_g{i}") for i, g in enumerate(groups)),
        by_words.alias("_w"), by_lines.alias("_l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        id_col, *(f"_g{i}" for i in range(len(groups))), F.col("_w.n_words").alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def sketch_bucket(value: Column) -> Column:
    """The smallest number with the same DIGITS leading binary digits: a whole number's bucket in its sketch."""
    drop = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def group_sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket, n: histograms of every measure for each group; sketches merge by adding up n.

    A sketch has 2 ** (DIGITS - 1) buckets at most for each doubling of the value, so it stays
    small however many rows it counts, its ranks are exact, and its values are at most one part in
    2 ** (DIGITS - 1) too low.
    """
    values = [F.struct(F.lit(m).alias("measure"), F.expr(f"{count} * {unit} div greatest({per}, 1)").alias("v")) for m, (count, per, unit) in MEASURES.items()]
    rows = measured.filter(~F.col("base_failed")).select(*keys, F.explode(F.array(*values)).alias("m"))
    return rows.groupBy(*keys, "m.measure", sketch_bucket(F.col("m.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sketch_limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, rows, high and low: where each merged sketch's bulk ends and its tails begin.

    The bulk ends at fences FENCE quartile distances from the quartiles. The rows beyond a fence are its tail, and
    the limit lies REACH of the way from the fence to the tail's nearest tenth. So a measure that most rows of a group
    lack, whose quartiles are all 0, is limited by what the rows that have it look like, and a sketch without tail by its fences.
    """
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "measure")
    up_to = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(up_to)).withColumn("rows", F.sum("n").over(whole))
    at = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * quarter, F.col("bucket"))).over(whole)
    fenced = ranked.withColumn("q1", at(1)).withColumn("q3", at(3))
    distance = FENCE * (F.col("q3") - F.col("q1"))
    fenced = fenced.withColumn("top", F.col("q3") + distance).withColumn("bottom", F.col("q1") - distance)
    beyond = lambda outside: F.sum(F.when(outside, F.col("n")).otherwise(0)).over(whole)
    above, below = F.col("bucket") > F.col("top"), F.col("bucket") < F.col("bottom")
    tails = fenced.withColumn("above", beyond(above)).withColumn("below", beyond(below))
    out = tails.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"), F.max("top").alias("top"), F.max("bottom").alias("bottom"),
        F.min(F.when(above & ((F.col("upto") - F.col("rows") + F.col("above")) * TAILTH >= F.col("above")), F.col("bucket"))).alias("over"),
        F.max(F.when(below & ((F.col("below") - F.col("upto") + F.col("n")) * TAILTH >= F.col("below")), F.col("bucket"))).alias("under"),
    )
    limit = lambda fence, tail: (F.col(fence) + F.coalesce(F.col(tail) - F.col(fence), F.lit(0.0)) * REACH).cast("double")
    return out.select(*keys, "measure", "rows", limit("top", "over").alias("high"), limit("bottom", "under").alias("low"))


def adaptive_limits(measured: DataFrame, n_groups: int = 2) -> DataFrame:
    """_g0 ..., _rows and _limit (a struct of each measure's high and low) for every group of measured.

    A group's limits come from its own sketch, drawn towards those of the merged sketch of its
    first column (the language) as if PRIOR_ROWS of the group's rows were from there, and these
    likewise towards those of all rows. So no limit depends on whether a group is large or small.
    """
    keys = [f"_g{i}" for i in range(n_groups)]
    sketches = keep(group_sketches(measured, keys))

    def drawn(df: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
        wider = wider.select(*on, F.col("high").alias("_high"), F.col("low").alias("_low"))
        blend = lambda c: ((F.col("rows") * F.col(c) + PRIOR_ROWS * F.col(f"_{c}")) / (F.col("rows") + PRIOR_ROWS)).alias(c)
        return df.join(wider, on).select(*df.columns[:-2], blend("high"), blend("low"))

    every = sketch_limits(sketches, [])
    first = drawn(sketch_limits(sketches, keys[:1]), every, ["measure"])
    own = drawn(sketch_limits(sketches, keys), first, [keys[0], "measure"])
    groups = measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    flat = lambda df, on: df.groupBy(*on).agg(*(F.max(F.when(F.col("measure") == m, F.struct("high", "low"))).alias(m) for m in MEASURES))
    # A group all of whose rows fail the base rules has no sketch, and needs no limits.
    return groups.join(flat(own, keys), keys, "left").select(*keys, "_rows", F.struct(*MEASURES).alias("_limit"))


def within_limits() -> Column:
    """Whether no count is further from what its group's limits give for the text's size than chance allows.

    A count expected to be m varies by about sqrt(m), and one that is rare by about 1; so the
    same limits serve short and long texts.
    """
    ok = F.lit(True)
    for m, (count, per, unit) in MEASURES.items():
        most = F.col(f"_limit.{m}.high") * F.col(per) / F.lit(float(unit))
        ok &= F.col(count) <= most + SIGMAS * F.sqrt(most + 1)
        if m == "word_length":
            least = F.greatest(F.col(f"_limit.{m}.low"), F.lit(0.0)) * F.col(per) / F.lit(float(unit))
            ok &= F.col(count) >= least - SIGMAS * F.sqrt(least + 1)
    return ok


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Kept rows pass the base rules and stay within their group's adaptive limits on symbols,
    repeated lines and the length of words. Sketches are exact counts, so every run gives the same
    verdicts. Null and empty texts have no words and fail the base rules; very long texts are
    measured whole, in one row's arrays; a null language or source is a group of its own; null ids
    and repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    measured = keep(text_measures(docs, id_col, text_col, groups))
    keys = [f"_g{i}" for i in range(len(groups))]
    limits = adaptive_limits(measured, len(groups)).withColumn("_key", F.struct(*keys)).drop(*keys)
    rows = measured.withColumn("_key", F.struct(*keys))
    met = join_small_keys(rows, keep(limits), "_key", "_rows", measured.count())
    kept = ~F.col("base_failed") & F.coalesce(within_limits(), F.lit(True))
    return met.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs, all columns unchanged, that quality_rules keeps.

    Rows with the same id and the same words share their verdict, so rows are matched by id and
    a hash of the text; a null id matches itself. No column name of docs can clash.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    key = F.xxhash64(text(id_col), F.col(f"`{id_col}`").isNull(), text(text_col), *map(text, groups))
    kept = quality_rules(docs.select(key.alias("_key_of_row"), F.col(f"`{text_col}`").alias("_text"), *(F.col(f"`{g}`").alias(f"_group{i}") for i, g in enumerate(groups))), "_key_of_row", "_text", tuple(f"_group{i}" for i in range(len(groups))))
    verdict = kept.filter("kept").select(F.col("_key_of_row").alias("key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return rows.join(verdict, "key", "left_semi").select("row.*")
