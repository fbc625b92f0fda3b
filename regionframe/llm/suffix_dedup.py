"""Exact removal of repeated byte strings over the whole corpus.

Two equal strings of LENGTH bytes have their minimiser (the K-gram of least hash in them) at the same place, so equal strings meet if
every string goes where its minimiser goes.  Consecutive starts with one minimiser are one range; the bytes under a range are its context.

1. A kernel cuts each text into ranges: minimiser hash, context hash, start, number of starts.  A context that came before in the same
   batch is settled there, so that groups of copies shrink before they travel.
2. Ranges meet by minimiser.  In a group, equal contexts leave the first and cover the others; a minimiser with several
   contexts is contested.  A count made before (of what occurs OFTEN or more in CHUNK ranges of a task) names the crowded minimisers,
   those with CROWD ranges or more: their ranges meet by minimiser and context instead, so that no task gathers one, and are all contested.
3. The contested contexts travel as bytes, grouped by minimiser.  Candidate starts (by the hash of the LENGTH bytes) form runs; of
   the distinct runs the suffixes are sorted by column-wise construction of the Burrows-Wheeler transform with common prefixes in
   sequential files (``column_bwt``); starts whose common prefix is LENGTH or more are one class, in which all but the first are covered.
   A crowded minimiser, or one with more than HOT contexts, is not gathered: its strings meet one by one, by 128 bits of hash.
4. Covered starts come back to their texts, which are rewritten.

Running step 3's construction over all suffixes of the corpus is not feasible: see the README for figures.

Defined cases: a null text is empty; fewer than LENGTH bytes are never touched; documents are ordered by id, null ids last, texts of one id by their md5;
exact repetitions of a row count as one document and all get its result; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .bytehash import mix, powers, segment_hashes, words8
from .column_bwt import suffixes
from .common import materialise

LENGTH, K = 100, 24
WINDOW = LENGTH - K + 1
HOT = 4096
PIECE = 1 << 18  # bytes of a text that the kernel handles at once
OFTEN, CHUNK = 8, 1 << 22  # a minimiser below OFTEN ranges in every CHUNK of a task is not counted
CROWD = 1 << 16  # ranges of a crowded minimiser; more at over CROWD * CROWDS ranges, so that there are at most CROWDS of them
CROWDS = 1 << 20  # crowded minimisers that are broadcast, 8 bytes each
SHARE = 1 << 21  # ranges that a task of the meeting holds, 32 bytes each
_POS = np.uint64((1 << 20) - 1)


def _ranges(buf: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(minimiser, context, start, starts) of the ranges of ``buf``; strings that cross from one ``group`` to another are left out."""
    n = len(buf)
    m = mix(words8(buf) * np.uint64(0xD1342543DE82EF95) + np.uint64(12345))
    gram = mix(m[: n - K + 1] + np.uint64(3) * m[8 : n - K + 9] + np.uint64(0xA24BAED4963EE407) * m[16 : n - K + 17])
    least = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    step = 1
    while step * 2 <= WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if WINDOW > step:
        least = np.minimum(least[: step - WINDOW], least[WINDOW - step :])
    place = (least & _POS).astype(np.int64)
    cut = place[1:] != place[:-1]
    if group is not None:
        starts_in = group[: len(place)]
        cut |= starts_in[1:] != starts_in[:-1]
    first = np.flatnonzero(np.concatenate([[True], cut]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    if group is not None:
        # Of a range only the starts whose whole string lies in the group count.
        inside = group[: len(place)] == group[LENGTH - 1 : LENGTH - 1 + len(place)]
        good = np.concatenate([[0], np.cumsum(inside)])
        count = good[last + 1] - good[first]
        keep = count > 0
        first, count = first[keep], count[keep]
        last = first + count - 1
    at = place[first]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(m * up[:n], out=sums[1:])
    shape = (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (at - first).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    context = mix((sums[last + LENGTH - 7] - sums[first]) * down[first] + shape)
    return gram[at], context, first, last - first + 1


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, context, doc, place) of all ranges; place is start, number of starts (7 bits) and whether the range is settled."""
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        found: list[tuple[np.ndarray, ...]] = []
        part: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal part, owner, held
            if part:
                sizes = np.array([len(x) for x in part])
                group = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
                begin = np.cumsum(sizes) - sizes
                g, c, s, k = _ranges(np.concatenate(part), group)
                found.append((g, c, np.array(owner, np.int64)[group[s]], s - begin[group[s]], k))
            part, owner, held = [], [], 0

        for doc, text in zip(docs, texts):
            body = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            if len(body) < LENGTH:
                continue
            if len(body) > PIECE:
                for lo in range(0, len(body) - LENGTH + 1, PIECE):
                    g, c, s, k = _ranges(body[lo : lo + PIECE + LENGTH - 1])
                    found.append((g, c, np.full(len(s), doc, np.int64), s + lo, k))
                continue
            if held + len(body) > PIECE:
                flush()
            part.append(body)
            owner.append(doc)
            held += len(body)
        flush()
        if not found:
            continue
        gram, context, doc, pos, starts = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, doc, context, gram))
        gram, context, doc, pos, starts = (x[order] for x in (gram, context, doc, pos, starts))
        again = np.concatenate([[False], (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])])
        # Settled ranges need no meeting: they have no hashes, and place, number of starts and state are one word.
        gram[again] = context[again] = 0
        yield _batch(gram=gram.view(np.int64), context=context.view(np.int64), doc=doc, place=pos << 8 | starts << 1 | again)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _often(least: int):
    """(gram, ranges) of the minimisers that occur ``least`` times or more in a chunk; under null, the number of all ranges."""

    def chunk(grams: list[np.ndarray], total: int) -> pa.RecordBatch:
        gram, times = np.unique(np.concatenate(grams), return_counts=True)
        gram, times = gram[times >= least], times[times >= least]
        ids = pa.concat_arrays([pa.array(gram, pa.int64()), pa.nulls(1, pa.int64())])
        return pa.RecordBatch.from_arrays([ids, pa.array(np.append(times, total), pa.int64())], names=["gram", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in _cut(batches):
            gram, place = np.asarray(batch.column(0)), np.asarray(batch.column(3))
            held.append(gram[place & 1 == 0])
            total += len(gram)
            if total >= CHUNK:
                yield chunk(held, total)
                held, total = [], 0
        if held:
            yield chunk(held, total)

    return run


def _meet(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """All ranges of some minimisers -> (doc, pos, starts, gram, rivals): covered ranges (rivals 0) and contested ones (their number).

    Of a crowded minimiser (its places are complemented) only some contexts are here: its rivals are more than ``hot``.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    gram, context, doc, place = (np.concatenate([np.asarray(b.column(i)) for b in tables]) for i in range(4))
    del tables
    crowded = place < 0
    place = np.where(crowded, ~place, place)
    pos, starts, settled = place >> 8, (place >> 1 & 127).astype(np.int32), (place & 1).astype(bool)
    yield _batch(doc=doc[settled], pos=pos[settled], starts=starts[settled], gram=np.zeros(settled.sum(), np.int64), rivals=np.zeros(settled.sum(), np.int64))
    live = np.flatnonzero(~settled)
    order = live[np.lexsort((pos[live], doc[live], context[live], gram[live]))]
    if not len(order):
        return
    gram, context, doc, pos, starts, crowded = (x[order] for x in (gram, context, doc, pos, starts, crowded))
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new_context = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    number = np.cumsum(new_gram) - 1
    rivals = np.bincount(number, weights=new_context).astype(np.int64)[number]
    rivals[crowded] = hot + 1
    # A row that repeats the first of its context in id and place is the same text given twice.
    first = np.maximum.accumulate(np.where(new_context, np.arange(len(doc)), 0))
    covered = ~new_context & ((doc != doc[first]) | (pos != pos[first]))
    contested = new_context & (rivals > 1)
    for pick, n in ((covered, np.zeros_like(rivals)), (contested, rivals)):
        yield _batch(doc=doc[pick], pos=pos[pick], starts=starts[pick], gram=gram[pick], rivals=n[pick])


def _contexts(hot: bool, limit: int):
    """Bytes under the contested ranges of a text; for minimisers with more than ``limit`` contexts the hashes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for r in asked.as_py():
                    if (r["rivals"] > limit) != hot:
                        continue
                    piece = body[r["pos"] : r["pos"] + r["starts"] + LENGTH - 1]
                    if hot:
                        one, two = _string_hashes(piece, 2)
                        out[0] += one.view(np.int64).tolist()
                        out[1] += [doc] * len(one)
                        out[2] += range(r["pos"], r["pos"] + len(one))
                        out[3] += two.view(np.int64).tolist()
                    else:
                        for c, v in zip(out, (r["gram"], doc, r["pos"], piece)):
                            c.append(v)
            last = pa.array(out[3], pa.int64() if hot else pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), last], names=["gram", "doc", "pos", "piece"])

    return run


def _string_hashes(piece: bytes, kinds: int = 1) -> list[np.ndarray]:
    """Hashes of all strings of LENGTH bytes of ``piece``."""
    m = mix(words8(np.frombuffer(piece, np.uint8)) * np.uint64(0x9FB21C651E98DF25) + np.uint64(99))[: len(piece) - 7]
    first = np.arange(len(piece) - LENGTH + 1)
    return [segment_hashes(m if k == 0 else mix(m + np.uint64(k)), first, first + LENGTH - 7) for k in range(kinds)]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs of starts (doc, pos, starts) among contested contexts; all contexts of a minimiser are here."""
    cols = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()) for b in batches if b.num_rows]
    if not cols:
        return
    gram, doc, pos = (np.concatenate([c[i] for c in cols]) for i in range(3))
    pieces = [p for c in cols for p in c[3]]
    order = np.lexsort((pos, doc, gram))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) != 0, [True]]))
    lo = 0
    while lo < len(edges) - 1:
        hi = lo + 1
        while hi < len(edges) - 1 and edges[hi + 1] - edges[lo] <= 2500:
            hi += 1
        rows = order[edges[lo] : edges[hi]]
        lo = hi
        yield from _resolve_some(doc[rows], pos[rows], [pieces[r] for r in rows])


def _resolve_some(doc: np.ndarray, pos: np.ndarray, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
    counts = np.array([len(p) - LENGTH + 1 for p in pieces])
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(np.array([len(p) for p in pieces])) - np.array([len(p) for p in pieces])
    m = mix(words8(flat) * np.uint64(0x9FB21C651E98DF25) + np.uint64(99))
    row = np.repeat(np.arange(len(pieces)), counts)
    off = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = begin[row] + off
    h = segment_hashes(m, first, first + LENGTH - 7)
    by = np.argsort(h, kind="stable")
    equal = h[by][1:] == h[by][:-1]
    many = np.zeros(len(h), bool)
    many[by[1:][equal]] = True
    many[by[:-1][equal]] = True
    # Maximal runs of candidate starts, as strings; equal strings are one.
    begins = np.flatnonzero(many & np.concatenate([[True], ~many[:-1] | (row[1:] != row[:-1])]))
    ends = np.flatnonzero(many & np.concatenate([~many[1:] | (row[1:] != row[:-1]), [True]]))
    runs: dict[bytes, list[tuple[int, int, int]]] = {}
    for a, z in zip(begins.tolist(), ends.tolist()):
        r = row[a]
        runs.setdefault(pieces[r][off[a] : off[z] + LENGTH], []).append((int(doc[r]), int(pos[r] + off[a]), z - a + 1))
    if not runs:
        return
    strings = list(runs)
    owner = [min(v) for v in runs.values()]
    out = [o for v, own in zip(runs.values(), owner) for o in v if o[:2] != own[:2]]
    string, offset, lcp = suffixes(strings, LENGTH)
    left = np.array([len(s) for s in strings])[string] - offset
    # Suffixes of LENGTH or more that share LENGTH bytes stand together; shorter ones never come between.
    cls = np.cumsum(lcp < LENGTH)
    full = left >= LENGTH
    cls, string, offset = cls[full], string[full], offset[full]
    d = np.array([o[0] for o in owner])[string]
    p = np.array([o[1] for o in owner])[string] + offset
    by = np.lexsort((p, d, cls))
    head = np.concatenate([[True], cls[by][1:] != cls[by][:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    later = ~head & ((d[by] != d[by][lead]) | (p[by] != p[by][lead]))
    d, p = d[by][later], p[by][later]
    doc_out = np.concatenate([np.array([o[0] for o in out], np.int64), d])
    pos_out = np.concatenate([np.array([o[1] for o in out], np.int64), p])
    n_out = np.concatenate([np.array([o[2] for o in out], np.int32), np.ones(len(d), np.int32)])
    yield _batch(doc=doc_out, pos=pos_out, starts=n_out)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and the covered starts (two lists of structs) -> what is left."""
    for batch in batches:
        rows = []
        for doc, text, one, two in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
            body = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            change = np.zeros(len(body) + 1, np.int32)
            for part in (one, two):
                if part.is_valid and len(part):
                    flat = part.values
                    p, n = flat.field("pos").to_numpy(zero_copy_only=False), flat.field("starts").to_numpy(zero_copy_only=False)
                    np.add.at(change, p, 1)
                    np.add.at(change, p + n + LENGTH - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            kept = body[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            rows.append((doc, len(body), int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"])


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text) with ``doc`` unique among different texts and in the order of documents."""
    plain = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if plain.isEmpty():
        return docs.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    digest = F.md5(F.coalesce("text", F.lit("")))
    names = materialise(docs.select("doc_id", digest.alias("digest")).distinct(), "suffix-names")
    ranked = numbered(names.withColumn("none", F.col("doc_id").isNull()), ["none", "doc_id", "digest"], "doc")
    ranked = materialise(ranked.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "doc"), "suffix-order")
    return docs.withColumn("digest", digest).join(ranked, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))).select("doc", "doc_id", "text")


def _crowds(docs: DataFrame, often: int, crowd: int) -> tuple[DataFrame, int]:
    """The crowded minimisers (``crowded``), CROWDS at most, and the number of all ranges."""
    counted = materialise(docs.mapInArrow(_often(often), "gram long, ranges long"), "suffix-often")
    total = counted.where("gram is null").agg(F.sum("ranges")).first()[0] or 0
    sums = counted.where("gram is not null").groupBy("gram").agg(F.sum("ranges").alias("ranges"))
    return sums.where(F.col("ranges") >= max(crowd, -(-total // CROWDS))).select(F.col("gram").alias("crowded")), total


def removed_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT, often: int = OFTEN, crowd: int = CROWD
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept_bytes``).

    ``hot``, ``often`` and ``crowd`` settle where ranges and strings meet, never what is removed.
    """
    spark = docs.sparkSession
    base = _ordered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    texts = base.select("doc", "text")
    crowds, total = _crowds(texts, often, crowd)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE), 1)
    ranges = texts.mapInArrow(_cut, "gram long, context long, doc long, place long")
    ranges = ranges.join(F.broadcast(crowds), F.col("gram") == F.col("crowded"), "left")
    place = F.when(F.col("crowded").isNotNull() & (F.col("place") % 2 == 0), F.bitwise_not("place")).otherwise(F.col("place"))
    ranges = ranges.select("gram", "context", "doc", place.alias("place"))
    key = F.when(F.col("place") % 2 == 1, F.xxhash64("doc", "place")).when(F.col("place") < 0, F.xxhash64("gram", "context")).otherwise(F.col("gram"))
    met = ranges.repartition(n, key).mapInArrow(lambda batches: _meet(batches, hot), "doc long, pos long, starts int, gram long, rivals long")
    done, asked = F.struct("pos", "starts"), F.struct("gram", "pos", "starts", "rivals")
    per = met.groupBy("doc").agg(F.collect_list(F.when(F.col("rivals") == 0, done)).alias("done"), F.collect_list(F.when(F.col("rivals") > 0, asked)).alias("asked"))
    per = per.withColumnRenamed("doc", "p_doc")
    joined = base.join(per, F.col("doc") == F.col("p_doc"), "left")
    touched = F.col("p_doc").isNotNull()
    whole = F.coalesce("text", F.lit(""))
    state = joined.select(
        "doc", "doc_id", touched.alias("touched"), F.when(touched, F.col("text")).alias("text"), "done", "asked", F.octet_length(whole).cast("long").alias("n_bytes"),
        F.when(~touched, F.sha2(whole.cast("binary"), 256)).alias("sha"), *([F.when(~touched, whole.cast("binary")).alias("left_bytes")] if with_text else []),
    )
    state = materialise(state, "suffix-state")
    wanted = state.where("touched and size(asked) > 0").select("doc", "text", "asked")
    fragments = wanted.mapInArrow(_contexts(False, hot), "gram long, doc long, pos long, piece binary")
    settled = fragments.repartition(n, "gram").mapInArrow(_resolve, "doc long, pos long, starts int")
    strings = wanted.where(F.exists("asked", lambda r: r["rivals"] > hot)).mapInArrow(_contexts(True, hot), "h1 long, doc long, pos long, h2 long")
    strings = materialise(strings, "suffix-hot")
    firsts = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("own"), F.count("*").alias("times")).where("times > 1")
    firsts = firsts.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("own.doc").alias("own_doc"), F.col("own.pos").alias("own_pos"))
    later = strings.join(firsts, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where("doc <> own_doc or pos <> own_pos")
    settled = settled.unionByName(later.select("doc", "pos", F.lit(1).alias("starts")))
    more = settled.groupBy("doc").agg(F.collect_list(done).alias("more")).withColumnRenamed("doc", "m_doc")
    changed = state.where("touched").join(more, F.col("doc") == F.col("m_doc"), "left")
    ids = changed.select("doc_id", "text", "done", "more").mapInArrow(_rewrite, "doc long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string")
    extra = ["kept_bytes"] if with_text else []
    ids = ids.select(F.col("doc").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *extra)
    zero = F.lit(0).cast("long")
    same = state.where("not touched").select(F.col("doc_id").alias(id_col), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), *([F.col("left_bytes").alias("kept_bytes")] if with_text else []))
    return ids.unionByName(same)
