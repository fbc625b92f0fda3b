"""MinHash near-duplicate detection, whole and without all-pairs work inside groups.

1. A kernel turns each text into the 64-bit hashes of its distinct five-word shingles and keeps ROWS * BANDS universal hash
   minima: one hash per band and a sketch of one bit per minimum.
2. Texts with the same shingle set are one class (its smallest id stands for it), so exact copies never meet in a bucket.
3. In every bucket of a band the members are compared with the bucket's smallest member only (a star, not all pairs): first by their
   signatures' sketches, then on their full shingle sets, recomputed from the whole texts.
4. Verified links are contracted to components by alternating large-star and small-star, to the fixed point.
5. Buckets whose members are still in several components stay open.  Their members are not listed against each other: they meet
   by a rare shingle.  Two sets of similarity 0.75 share 3/4 of the larger one, so if all shingles are put in one order, the
   first floor(n / 4) + 1 shingles of either hold a common one, and the places of the first common one bound the overlap.  The order puts
   what many open members share (a passage, a licence, the base of a group of near copies) last, so members that agree in that alone
   make no candidate.  Any order gives all links; the counts only make it sharp, so the table of counts may be bounded: it holds the
   most frequent shingles, at most FREQUENT.  Candidates of different components are verified as in step 3 and contracted as in step 4.

A pair with similarity 0.75 shares none of the 32 bands of 4 rows with probability 5e-6; its sketches differ in more than 44 of 128 bits with
probability under 1e-9.  Members of a bucket that are in one component already need no comparison: a link cannot change the result.
Superseded tables are deleted as the next one is written; in the end only the result's table is left.

Defined cases: a null text or one without words has an empty set, is linked with nothing and is kept; fewer than five words are one shingle;
rows that share a document id are one node; a null id is its own component (null) and kept; repeated rows are all returned; a text of any length is
taken whole; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, segment_hashes, words8
from .common import Scratch, fits_broadcast

SHINGLE = 5
ROWS, BANDS = 4, 32
SKETCH_BITS = 44
FREQUENT = 1 << 18  # shingles in the table of counts, which is sent to all tasks (3 MB)
BROADCAST = 1_000_000  # rows of one or two longs
COUNTED = 1 << 21  # shingles that a task counts at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SEEDS = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = (_SEEDS[: ROWS * BANDS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS[ROWS * BANDS :] >> np.uint64(32)).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    space = np.concatenate([[True], _SPACE[buf], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    start, end = turns[0::2], turns[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    word = segment_hashes(mix(buf.astype(np.uint64) + np.uint64(1)), start, end)
    first = np.arange(max(1, len(word) - SHINGLE + 1))
    return np.unique(segment_hashes(word, first, np.minimum(first + SHINGLE, len(word))))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of (a * x + b) mod 2**32 over the set, for each (a, b)."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        np.minimum(out, (x[lo : lo + 512, None] * _MUL + _ADD).min(0), out=out)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = mix(np.arange(11, 11 + ROWS, dtype=np.uint64))
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingles(text.as_py())
            row = [doc, len(s), 0, 0, None, 0, 0]
            if len(s):
                m = signature(s)
                bands = mix((m.reshape(BANDS, ROWS).astype(np.uint64) * powers).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                bits = np.packbits((mix(m.astype(np.uint64) + np.uint64(77)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
                row[2:] = int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), bands.view(np.int64), int(bits[0]), int(bits[1])
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "n", "s1", "s2", "bands", "b1", "b2"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets reach the similarity."""
    last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
    for batch in batches:
        ok = []
        for ta, tb in zip(batch.column(2), batch.column(3)):
            a = ta.as_py()
            if a is not last[0] and a != last[0]:
                last = (a, shingles(a))
            x, y = last[1], shingles(tb.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, times) of the shingles that a task meets more than once, counted in pieces of bounded size."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        many = times > 1
        return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(times[many].astype(np.int64))], names=["shingle", "times"])

    for batch in batches:
        for text in batch.column(0):
            held.append(shingles(text.as_py()))
            size += len(held[-1])
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _prefixes(table: Broadcast):
    """The shingles by which a set can meet another: (shingle, doc, comp, n, place), rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = table.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                docs, comps, firsts = part.column(0).to_numpy(), part.column(1).to_numpy(), []
                sizes = []
                for text in part.column(2):
                    s = shingles(text.as_py())
                    seen = np.zeros(len(s), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        seen = np.where(known[at] == s, times[at], 0)
                    firsts.append(s[np.lexsort((s, seen))[: len(s) - -(-3 * len(s) // 4) + 1]])
                    sizes.append(len(s))
                many = np.array([len(x) for x in firsts], np.int64)
                places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                flat = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
                cols = (flat.view(np.int64), np.repeat(docs, many), np.repeat(comps, many), np.repeat(np.array(sizes, np.int32), many), places.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shingle", "doc", "comp", "n", "place"])

    return run


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "near-components") -> DataFrame:
    """(node, component): smallest node reachable over ``edges`` (a, b), by alternating large-star and small-star to the fixed point."""
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sums = _sums(now)
    while True:
        # Large star: every larger neighbour of a node is tied to the smallest node around.
        near = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = near.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the smaller neighbours of a node, and the node, are tied to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = down.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("x"), "m").where("x <> m").unionByName(low.select(F.col("u").alias("x"), "m"))
        now = scratch.write(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), name)
        before, sums = sums, _sums(now)
        if sums == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _only(texts: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``texts`` joined with ``ids``; up to BROADCAST ids are sent to the scan, so that the other texts do not travel."""
    return texts.join(F.broadcast(ids) if fits_broadcast(ids, BROADCAST) else ids, F.col("doc") == F.col(id_col))


def _verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that are links. Only texts of some pair travel."""
    involved = scratch.write(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "near-involved")
    held = scratch.write(_only(texts, involved, "id").select("id", "text"), "near-texts")
    right = pairs.join(held.select("id", F.col("text").alias("tb")), F.col("b") == F.col("id")).select("a", "b", "tb")
    full = right.join(held.select("id", F.col("text").alias("ta")), F.col("a") == F.col("id")).select("a", "b", "ta", "tb")
    links = scratch.write(full.mapInArrow(_similar, "a long, b long").distinct(), name)
    scratch.drop("near-texts", "near-involved")
    return links


def _sizes_allow(x: str, y: str) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * 75


def _alike(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave the similarity possible."""
    one = pairs.join(sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("b1").alias("y1"), F.col("b2").alias("y2")), "b")
    two = one.join(sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("b1").alias("x1"), F.col("b2").alias("x2")), "a")
    differ = F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2")))
    return two.where(_sizes_allow("na", "nb") & (differ <= SKETCH_BITS)).select("a", "b")


def _counts(bodies: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: all from the least power of two that leaves no more than ``limit``."""
    times = bodies.select("text").mapInArrow(_frequent, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    powers = F.floor(F.log2("times")).cast("int")
    tally = {r["power"]: r["count"] for r in times.groupBy(powers.alias("power")).count().collect()}
    least = 0
    while sum(n for p, n in tally.items() if p >= least) > limit:
        least += 1
    rows = times.where(F.col("times") >= 1 << least).toArrow()
    shingle = rows["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], rows["times"].to_numpy().astype(np.int64)[order]


def _rare_pairs(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) of ``members`` (rep, comp) of different components, by their rare shingles."""
    bodies = scratch.write(_only(texts, members, "rep").select("doc", "comp", "text"), "near-bodies")
    counts = members.sparkSession.sparkContext.broadcast(_counts(bodies))
    rare = scratch.write(bodies.mapInArrow(_prefixes(counts), "shingle long, doc long, comp long, n int, place int"), "near-rare")
    scratch.drop("near-bodies")
    # Most rare shingles stand in one text alone, or in texts of one component.
    several = rare.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(F.col("shingle").alias("s"))
    rare = scratch.write(rare.join(several, F.col("shingle") == F.col("s"), "left_semi"), "near-rare")
    side = lambda k: rare.select(F.col("shingle").alias(f"s{k}"), F.col("doc").alias(k), F.col("comp").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("place").alias(f"p{k}"))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # the overlap, if this is the first common shingle
    meet = (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (175 * most >= 75 * (F.col("na") + F.col("nb")))
    return side("a").join(side("b"), meet).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = scratch.write(texts.mapInArrow(_sign, "doc long, n long, s1 long, s2 long, bands array<long>, b1 long, b2 long"), "near-signatures")
    classes = signed.where("n > 0 and doc is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc", "bands", "b1", "b2")).alias("x"))
    reps = scratch.write(classes.select("n", "s1", "s2", F.col("x.doc").alias("rep"), "x.bands", "x.b1", "x.b2"), "near-classes")
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    tops = rows.groupBy("bucket").agg(F.min("rep").alias("top"), F.count("*").alias("members")).where("members > 1").select(F.col("bucket").alias("t_bucket"), "top")
    shared = scratch.write(rows.join(tops, F.col("bucket") == F.col("t_bucket")).select("bucket", "rep", "top"), "near-buckets")
    sketch = reps.select(F.col("rep").alias("id"), "n", "b1", "b2")
    stars = shared.where("rep <> top").select(F.col("top").alias("a"), F.col("rep").alias("b")).distinct()
    stars = scratch.write(_alike(stars, sketch), "near-pairs")
    links = _verify(stars, texts, scratch, "near-links")
    comps = components(links, scratch)
    # Buckets whose members are still in several components.
    placed = shared.select("bucket", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = scratch.write(placed, "near-placed")
    scratch.drop("near-buckets")
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(F.col("bucket").alias("o_bucket"))
    members = scratch.write(placed.join(open_, F.col("bucket") == F.col("o_bucket"), "left_semi").select("rep", "comp").distinct(), "near-open")
    scratch.drop("near-placed")
    if not members.isEmpty():
        more = scratch.write(_alike(_rare_pairs(members, texts, scratch), sketch), "near-pairs")
        more = _verify(more, texts, scratch, "near-more-links")
        if not more.isEmpty():
            comps = components(links.unionByName(more), scratch, "near-all-components")
    names = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("n").alias("c_n"), F.col("s1").alias("c_s1"), F.col("s2").alias("c_s2"), F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc", "n", "s1", "s2").join(names, (F.col("n") == F.col("c_n")) & (F.col("s1") == F.col("c_s1")) & (F.col("s2") == F.col("c_s2")), "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    out = scratch.write(out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept")), "near-result")
    scratch.close("near-result")
    return out


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of rows that repeat its id the one of least text digest. Rows without an id stay."""
    node = F.col(id_col).cast("long")
    marks = near_duplicates(docs, id_col=id_col, text_col=text_col).where("not kept").select(F.col(id_col).cast("long").alias("drop_id")).distinct()
    # Few enough marks are sent to the scan, so that the texts do not travel.
    rest = docs.join(F.broadcast(marks) if fits_broadcast(marks, BROADCAST) else marks, node == F.col("drop_id"), "left_anti")
    again = docs.groupBy(node.alias("again_id")).agg(F.count("*").alias("again_n")).where("again_n > 1 and again_id is not null").select("again_id")
    if again.isEmpty():
        return rest
    single = rest.join(again, node == F.col("again_id"), "left_semi").groupBy(node.alias("again_id")).agg(F.min_by(F.struct("*"), F.coalesce(F.md5(F.col(text_col)), F.lit(""))).alias("row")).select("row.*")
    return rest.join(again, node == F.col("again_id"), "left_anti").unionByName(single)
