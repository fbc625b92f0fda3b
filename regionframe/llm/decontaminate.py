"""Benchmark decontamination, in DataFrame operations alone.

The windows of the benchmark (WINDOW consecutive words, or all words of a shorter item) are known by their heads: the hash of
a window's first PREFIX words, or of all if it has fewer.  The heads are a hash set of longs that is broadcast, at most HEADS at once; a larger set
goes in blocks, one scan a block.  Documents are cut into overlapping pieces of STEP word positions, the hash of the next words of every position is probed in
the set, and at the few positions that pass the window's words are written out and joined with the benchmark's windows, so that
a hit is a hit of strings, not of hashes, whatever the size of the benchmark.

A text's hits depend on the text alone, so they are kept by its digest: copies share them, and whole rows are never shuffled to find them.

Defined cases: null text has no words and no hit; texts of any length are scanned whole; items without words have no window; an empty benchmark hits nothing;
a repeated row is reported as often as it occurs; a null item id counts as the string ``null``; an empty table gives an empty result; other columns are
ignored (``decontaminate`` passes them through) whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fits_broadcast, lower_ascii

WINDOW = 13
PREFIX = 5
STEP = 256
HEADS = 2_000_000
TEXTS = 1_000_000
WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), BREAKS), "")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _head(w: str, i: str, p: int) -> str:
    """Hash of the ``p`` words of ``w`` from place ``i`` (SQL); past the end there are fewer."""
    return f"xxhash64({p}, " + ", ".join(f"get({w}, {i} + {k})" for k in range(p)) + ")"


def benchmark_windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, length, head, items): each distinct window with the ids of its items."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = items.select("item", size.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("ws"))
    head = F.lit(None).cast("long")
    for p in range(1, PREFIX + 1):
        head = F.when(F.col("length") >= p, F.expr(_head("ws", "0", p))).otherwise(head)
    return each.groupBy(F.concat_ws(" ", "ws").alias("window"), "length", head.alias("head")).agg(F.collect_set("item").alias("items"))


def text_hits(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", heads: int = HEADS, **columns) -> DataFrame:
    """(digest, hit, items) of the texts with hits: their digest, the places of their hit words and the ids of the items that hit them."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.write(benchmark_windows(benchmark, **columns), "decontaminate-windows")
    sizes = {r["p"]: sorted(r["lengths"]) for r in windows.groupBy(F.least("length", F.lit(PREFIX)).alias("p")).agg(F.collect_set("length").alias("lengths")).collect()}
    found = windows.select(F.col("head").alias("h")).distinct()
    blocks = -(-found.count() // heads)
    pieces = docs.select(_digest(F.col(text_col)).alias("digest"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    cut = f"transform(sequence(0, size(w) - 1, {STEP}), s -> struct(s as at, slice(w, s + 1, {STEP + WINDOW - 1}) as w))"
    pieces = pieces.select("digest", F.explode(F.expr(cut)).alias("piece")).select("digest", "piece.at", "piece.w")
    probes = [f"transform(slice(w, 1, {STEP}), (x, i) -> struct({p} as p, i as i, {_head('w', 'i', p)} as head))" for p in sorted(sizes)]
    hits = None
    for block in range(blocks):
        probed = pieces.select("digest", "at", "w", F.explode(F.expr(probes[0] if len(probes) == 1 else f"concat({', '.join(probes)})")).alias("probe"))
        passed = probed.join(F.broadcast(found.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block)), F.col("probe.head") == F.col("h"), "left_semi")
        lengths = F.create_map(*[x for p, n in sizes.items() for x in (F.lit(p), F.array(*map(F.lit, n)))])
        passed = passed.select("digest", "at", "probe.i", "w", F.explode(lengths[F.col("probe.p")]).alias("length")).where("i + length <= size(w)")
        passed = passed.select("digest", (F.col("at") + F.col("i")).alias("i"), "length", F.expr("concat_ws(' ', slice(w, i + 1, length))").alias("window"))
        hits = passed if hits is None else hits.unionByName(passed)
    if hits is None:
        hits = docs.limit(0).select(F.lit("").alias("digest"), F.lit(0).alias("i"), F.lit(0).alias("length"), F.lit("").alias("window"))
    hits = hits.join(windows, ["window", "length"])
    places = F.expr("array_distinct(flatten(transform(collect_set(struct(i, length)), h -> sequence(h.i, h.i + h.length - 1))))")
    hits = hits.groupBy("digest").agg(places.alias("hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hits = scratch.write(hits.select("digest", "hit", "items"), "decontaminate-hits")
    scratch.close("decontaminate-hits")
    return hits


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    hits = text_hits(docs, benchmark, text_col=text_col, **options).select(
        F.col("digest").alias("h_digest"), F.size("hit").cast("long").alias("hits"), F.size("items").cast("long").alias("found"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("sha")
    )
    rows = docs.select(F.col(doc_id).alias("d_id"), _digest(F.col(text_col)).alias("digest"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    met = rows.join(hits, F.col("digest") == F.col("h_digest"), "left").withColumn("n_hit", F.coalesce("hits", zero))
    return met.select(
        F.col("d_id").alias(doc_id), "n_words", "n_hit", F.coalesce("found", zero).alias("n_items"), F.coalesce("sha", none).alias("items_sha256"), _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) with the hit words of those taken out of the text.

    A span is cut from the text by the positions of its words: everything from the first to the last hit word of a run goes.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    hits = text_hits(docs, benchmark, text_col=text_col, **options).select(F.col("digest").alias("h_digest"), "hit")
    hint = F.broadcast if remove == "documents" and fits_broadcast(hits, TEXTS) else (lambda x: x)
    base = docs.select(F.struct("*").alias("row"), _digest(F.col(text_col)).alias("digest"))
    if remove == "documents":
        counted = hits.select("h_digest", F.size("hit").alias("n_hit"))
        met = base.join(hint(counted), F.col("digest") == F.col("h_digest"), "left")
        # Words are counted in texts with hits only.
        bad = F.when(F.col("n_hit") > 0, _contaminated(F.col("n_hit"), F.size(words(F.col(f"row.{text_col}"))))).otherwise(False)
        return met.where(~bad).select("row.*")
    met = base.join(hits, F.col("digest") == F.col("h_digest"), "left")
    text = F.col(f"row.{text_col}")
    # pieces[k] is what stands before word k, words[k] the word as written; the last piece stands after all words.
    met = met.withColumn("written", F.regexp_extract_all(text, F.lit(WRITTEN), F.lit(0))).withColumn("pieces", F.split(text, WRITTEN, -1))
    kept = F.expr("concat(array_join(transform(written, (x, k) -> if(array_contains(hit, k), if(array_contains(hit, k - 1), '', pieces[k]), concat(pieces[k], x))), ''), element_at(pieces, -1))")
    out = met.select("row", F.when(F.size("hit") > 0, kept).otherwise(text).alias("cut"))
    return out.select(F.col("row").withField(text_col, F.col("cut")).alias("row")).select("row.*")
