"""Benchmark decontamination: training texts that hold windows of test items.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one
window).  Every occurrence of a window of L words covers one block of
``(L + 1) div 2`` words that begins at a multiple of that length, so the hash
set that is broadcast holds all word runs of that length inside test windows,
and a text is scanned block by block: one probe for every five words.  A hit is
verified on whole windows: the starts that the block stands for are rebuilt as
normalised text and joined with the distinct windows by equality.

The main path is DataFrame functions only and one pass over the texts.  A text
gives one row for itself and one for each verified window; they are grouped
by (id, hash of the text, input partition), so no group is larger than what
one input partition holds, and texts never shuffle.

The set of run hashes is counted first.  Up to ``SET_ROWS`` hashes are
broadcast; beyond that the set is cut into parts of this size and the texts are
scanned once for each part.  The windows are broadcast up to ``SET_ROWS`` rows
and joined by a shuffle of the candidates beyond.

Normalisation lower-cases A to Z alone.  Run hashes are made of fully
lower-cased text, which is cheaper and never tells equal words apart; the
verification uses A to Z exactly.

Cases: null, empty and wordless texts have no words and no hits; very long
texts give more rows, not larger ones; rows that repeat id and text are all
returned with the same result; null ids are kept as null; equal windows of
several items count for each of them; a null item id is listed as an empty
string; an empty table of documents gives an empty result and an empty table
of items no hit; other columns, whatever their names, pass through ``remove_spans``
and ``remove_documents`` untouched.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import stage

WINDOW = 10
#: Rows of a broadcast set.
SET_ROWS = 1_000_000
#: Fixed value: what stands between words (before lower-casing).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SPAN = "array<struct<s:int,e:int>>"


def words_of(text: Column) -> Column:
    """The words of a text in their own case; of null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def _run(words: Column, at: Column, n) -> Column:
    """``n`` words from position ``at`` (from 0), joined by one space."""
    return F.concat_ws(" ", F.slice(words, at + 1, F.lit(n)))


def _key(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lower(_run(words, at, n)), F.lit(n))


def _steps(count: Column) -> Column:
    """0, 1, ... below ``count`` (none below one)."""
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, run): the distinct windows of each item, ``run`` as
    normalised text."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         F.transform(words_of(F.col(text_col)), _lower).alias("words")).where(F.size("words") > 0)
    length = F.least(F.lit(window), F.size("words"))
    return (words.withColumn("length", length)
            .select("item", "words", "length", F.explode(_steps(F.size("words") - F.col("length") + 1)).alias("at"))
            .select("item", "length", F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("length"))).alias("run"))
            .distinct())


def _block(length: int) -> int:
    return (length + 1) // 2


def _set_of_runs(runs: DataFrame, lengths: list[int]) -> DataFrame:
    """The hashes of all word runs, of the block length, inside windows."""
    keys, words = None, F.split("run", " ")
    for n in lengths:
        b = _block(n)
        part = runs.where(F.col("length") == n).select(
            F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - b)), lambda at: _key(words, at, b))).alias("key"))
        keys = part if keys is None else keys.unionByName(part)
    return keys.distinct()


def _scan(texts: DataFrame, keys: DataFrame, runs: DataFrame, lengths: list[int], own: bool) -> DataFrame:
    """(doc_id, digest, part, n_words, s, e, items): a row of each text
    (``own``), and one for each window that it holds."""
    words = F.col("words")
    probes = [F.transform(_steps(F.floor(F.size(words) / b)), lambda i: F.struct(
        (i * b).alias("at"), F.lit(b).alias("b"), _key(words, i * b, b).alias("key")))
        for b in sorted({_block(n) for n in lengths})]
    none = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("b"), F.lit(None).cast("long").alias("key"))
    # the first element stands for the text itself and meets no key
    each = texts.select("doc_id", "digest", "part", "words", F.explode_outer(F.concat(F.array(none), *probes)).alias("p"))
    met = (each.select("doc_id", "digest", "part", "words", "p.at", "p.b", "p.key")
           .join(keys.select("key", F.lit(True).alias("hit")), "key", "left").where((F.col("at") < 0) | F.col("hit")))
    at, size = F.col("at"), F.size("words")
    # a block stands for the starts after the block before it
    tries = [F.when(F.col("b") == _block(n), F.transform(
        F.filter(F.sequence(at - (_block(n) - 1), at), lambda s: (s >= 0) & (s + n <= size)),
        lambda s: F.struct(s.alias("s"), (s + n).alias("e"), _lower(_run(words, s, n)).alias("run"))))
        for n in lengths]
    typed = "array<struct<s:int,e:int,run:string>>"
    one = F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"),
                           # no window has this character; distinct, so that a shuffle spreads these rows
                           F.concat(F.lit("\x00"), F.col("digest").cast("string")).alias("run")))
    some = F.concat(*[F.coalesce(t, F.array().cast(typed)) for t in tries])
    tried = (met.select("doc_id", "digest", "part", F.when(at < 0, size).alias("n_words"),
                        F.explode_outer(F.when(at < 0, one).otherwise(some)).alias("t"))
             .select("doc_id", "digest", "part", "n_words", "t.s", "t.e", "t.run"))
    found = tried.join(runs, "run", "left").where(F.col("items").isNotNull() | (F.col("s") < 0))
    if not own:
        found = found.where("s >= 0")
    return found.select("doc_id", "digest", "part", "n_words", F.when(F.col("s") >= 0, F.struct("s", "e")).alias("span"), "items")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  set_rows: int = SET_ROWS) -> DataFrame:
    """(doc_id, digest, n_words, spans, items) of every row: the occurrences
    of test windows as word positions [s, e), and the sorted ids of the items
    they belong to.  ``digest`` is ``xxhash64`` of the text."""
    found = stage(windows(items, window, item_col, item_text), "windows")
    lengths = [r[0] for r in found.select("length").distinct().orderBy("length").collect()]  # at most ``window``
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"),
                        F.spark_partition_id().alias("part"), words_of(F.col(text_col)).alias("words"))
    if lengths:
        runs = found.groupBy("run").agg(F.collect_set("item").alias("items"))
        if runs.count() <= set_rows:
            runs = F.broadcast(runs)
        keys = stage(_set_of_runs(found.select("length", "run").distinct(), lengths), "runs")
        parts = max(1, -(-keys.count() // set_rows))
        rows = None
        for k in range(parts):
            own = keys if parts == 1 else keys.where(F.pmod("key", F.lit(parts).cast("long")) == k)
            scanned = _scan(texts, F.broadcast(own), runs, lengths, own=k == 0)
            rows = scanned if rows is None else rows.unionByName(scanned)
    else:
        rows = texts.select("doc_id", "digest", "part", F.size("words").alias("n_words"),
                            F.lit(None).cast("struct<s:int,e:int>").alias("span"),
                            F.lit(None).cast("array<string>").alias("items"))
    whole = rows.groupBy("doc_id", "digest", "part").agg(
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))
    # rows that repeat id and text within one input partition come back as many
    return (whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", "digest", "n_words", F.col("spans").cast(_SPAN).alias("spans"),
                    F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")))


def n_covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["e"]).alias("end"),
        (acc["n"] + F.greatest(x["e"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n")), lambda acc: acc["n"])


def merged(spans: Column) -> Column:
    """Sorted spans without overlaps."""
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
        last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e"))))
    return F.aggregate(spans, F.array().cast(_SPAN), lambda acc, x: F.when(
        (F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1))["e"] >= x["s"], F.lit(False)),
        joined(acc, x)).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))))


def _beside(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, **options):
    """The rows of ``docs`` under neutral names, and the keys and spans of the
    contaminated ones."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    hit = (contamination(docs, items, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0)
           .groupBy(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).agg(F.first("spans").alias("hit_spans")))
    return names, flat, hit, own.eqNullSafe(F.col("hit_id")) & (F.xxhash64(text) == F.col("hit_digest")), text


def remove_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no test window."""
    names, flat, hit, match, _ = _beside(docs, items, id_col, text_col, **options)
    return flat.join(hit, match, "left_anti").toDF(*names)


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with contaminated texts reduced to their other words, joined
    by one space; clean texts stay as they are."""
    names, flat, hit, match, text = _beside(docs, items, id_col, text_col, **options)
    spans = merged(F.col("hit_spans"))
    kept = F.filter(words_of(text), lambda w, i: ~F.exists(F.col("hit_merged"), lambda s: (i >= s["s"]) & (i < s["e"])))
    at = names.index(text_col)
    joined = flat.join(hit, match, "left").withColumn("hit_merged", F.when(F.col("hit_spans").isNotNull(), spans))
    return joined.withColumn(f"c{at}", F.when(F.col("hit_merged").isNotNull(), F.array_join(kept, " ")).otherwise(
        F.col(f"c{at}"))).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
