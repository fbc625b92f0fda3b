"""Document scores by masked pseudo-likelihood of a bidirectional window network trained in numpy.

Every word is predicted from the two words on either side, the word itself masked: position-wise projections of the neighbours'
embeddings are summed, go through tanh and a softmax over word classes; the word's share of its class comes from
corpus counts.  A document's score is the sum of the words' conditional log-probabilities.

* Word counts, the vocabulary (the VOCABULARY most frequent words, a bound of the network), class sizes and the shares of all words cover
  all documents and are counted in the cluster.  A word beyond the vocabulary belongs to one of RARE_CLASSES classes, which is all that the network
  sees of it; its share of the class is its own count, joined from the table of counts.
* The network starts from a few distinct texts of any length and is then trained on all documents: every partition runs stochastic gradient
  descent over every position of each of its texts, and the partitions' parameters are averaged in two levels (parameter averaging).
* Only the model, whose size is fixed, sums of it and the texts of the start reach the driver.

Words are split at white space and lower-cased.  Defined cases: null or empty text has no words and score 0; one word
is predicted from blanks; an empty table gives an empty result; repeated rows are scored each; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

VOCABULARY, FREQUENT_CLASSES, RARE_CLASSES = 8192, 64, 16
DIM, HIDDEN, REACH = 16, 32, 2
SIDES = 2 * REACH
PAD = VOCABULARY + RARE_CLASSES
IDS, CLASSES = PAD + 1, FREQUENT_CLASSES + RARE_CLASSES
SHAPES = {"embed": (IDS, DIM), "project": (SIDES, DIM, HIDDEN), "inner": (HIDDEN,), "out": (HIDDEN, CLASSES), "bias": (CLASSES,)}
OFFSETS = np.array([d for d in range(-REACH, REACH + 1) if d])
GAP = np.full(REACH, PAD, np.int32)
TOKENS = 1 << 10  # windows scored at once; their classes stay in the cache
WORDS = 1 << 22  # words counted at once
WARM_STEPS = 300


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    size = 0

    def flush() -> pa.RecordBatch:
        seen = pc.value_counts(pa.chunked_array(held, pa.large_string()))
        held.clear()
        return pa.RecordBatch.from_arrays([seen.field(0).cast(pa.string()), seen.field(1)], names=["word", "n"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            words = [word for text in batch.column(0).slice(lo, 128) for word in (text.as_py() or "").lower().split()]
            held.append(pa.array(words, pa.large_string()))
            size += len(words)
            if size > WORDS:
                yield flush()
                size = 0
    yield flush()


class Words:
    """Word -> id, class of each id, and log share of the word in its class; for rare words the share of one occurrence (``rare``: class -> occurrences)."""

    def __init__(self, words: list[str], counts: list[int], rare: dict[int, int]):
        self.ids = {w: k for k, w in enumerate(words)}
        n = np.array(counts, np.float64)
        mass = np.cumsum(n) - n / 2
        cls = np.minimum((mass / max(n.sum(), 1) * FREQUENT_CLASSES).astype(np.int64), FREQUENT_CLASSES - 1)
        self.cls = np.concatenate([cls, np.zeros(VOCABULARY - len(words), np.int64), FREQUENT_CLASSES + np.arange(RARE_CLASSES), [0]])
        sums = np.bincount(cls, weights=n, minlength=FREQUENT_CLASSES)
        self.share = np.zeros(IDS)
        self.share[: len(n)] = np.log(n / sums[cls])
        for k in range(RARE_CLASSES):
            self.share[VOCABULARY + k] = -np.log(max(rare.get(k, 1), 1))
        total = np.concatenate([sums, [rare.get(k, 0) for k in range(RARE_CLASSES)]]) + 1.0
        self.prior = np.log(total / total.sum()).astype(np.float32)

    def encode(self, text: str | None) -> np.ndarray:
        return self.numbers((text or "").lower().split())[0]

    def numbers(self, words: list[str]) -> tuple[np.ndarray, list[bytes]]:
        """Ids of words, and the words beyond the vocabulary."""
        out = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(out < 0)
        rare = list(map(str.encode, map(words.__getitem__, at.tolist())))
        if rare:
            out[at] = VOCABULARY + np.fromiter(map(crc32, rare), np.int64, len(rare)) % RARE_CLASSES
        return out, rare


def _hashes(words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)


def initial(words: Words, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in SHAPES.items()}
    p["inner"][:] = 0
    p["bias"] = words.prior.copy()
    p["out"] *= 0.1
    return p


def _logits(p: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden units with a column of ones, which carries the bias, and the logits; large logits are moved to a maximum of 0."""
    ones = np.empty((len(h), HIDDEN + 1), np.float32)
    np.tanh(h, out=ones[:, :HIDDEN])
    ones[:, HIDDEN] = 1
    out = np.concatenate([p["out"], p["bias"][None]])
    z = ones @ out
    if not (COLUMNS @ np.abs(out)).max() < 60:  # no logit is beyond this sum: smaller ones have exponentials in any case
        z -= z.max(1, keepdims=True)
    return ones, z


ROWS, COLUMNS, HEAD = np.ones(CLASSES, np.float32), np.ones(HIDDEN + 1, np.float32), np.zeros(1, np.int64)


def descend(p: dict[str, np.ndarray], sides: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of gradient descent on windows."""
    n = len(target)
    project = p["project"].reshape(SIDES * DIM, HIDDEN)  # a view: steps on it move the parameters
    x = p["embed"].take(sides.ravel(), axis=0).reshape(n, SIDES * DIM)
    h = x @ project
    h += p["inner"]
    ones, z = _logits(p, h)
    np.exp(z, out=z)
    z /= (z @ ROWS)[:, None]
    z.ravel()[np.arange(0, n * CLASSES, CLASSES) + target] -= 1
    back = z @ p["out"].T
    slope = ones * ones
    np.subtract(1, slope, out=slope)
    back *= slope[:, :HIDDEN]
    scale = np.float32(rate / n)
    turn = ones.T @ z
    turn *= scale
    p["out"] -= turn[:HIDDEN]
    p["bias"] -= turn[HIDDEN]
    into = back @ project.T
    project -= scale * (back.T @ x).T
    p["inner"] -= scale * (ones[:, HIDDEN] @ back)
    flat = sides.ravel().astype(np.int16)  # IDS fits; short integers are sorted by radix
    order = flat.argsort(kind="stable")
    flat = flat[order]
    heads = np.concatenate([HEAD, np.flatnonzero(flat[1:] != flat[:-1]) + 1])
    sums = np.add.reduceat(into.reshape(-1, DIM).take(order, axis=0).view(np.complex64), heads, axis=0).view(np.float32)  # two numbers at once
    sums *= np.float32(rate / np.sqrt(n))
    # Rare words would hardly move at the mean's rate: a word's step counts its own windows.
    p["embed"][flat[heads]] -= sums


def _windows(batches, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training windows of every position of every text, about 512 at once."""
    held, size = [GAP], 0

    def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = np.concatenate(held)
        at = np.flatnonzero(ids != PAD)
        for lo in range(0, len(at), 1024):
            a = at[lo : lo + 1024]
            yield ids[a[:, None] + OFFSETS], words.cls[ids[a]]

    for text in batches:
        ids = words.encode(text)
        if not len(ids):
            continue
        held += [ids, GAP]
        size += len(ids)
        if size >= 512:
            yield from steps()
            held, size = [GAP], 0
    if size:
        yield from steps()


def score(words: Words, p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Summed log-probabilities of texts given as ids, a rare word counting as if it occurred once in the corpus."""
    tables = [p["embed"] @ p["project"][s] for s in range(SIDES)]
    tables[0] += p["inner"]
    parts = [GAP]
    for ids in texts:
        parts += [ids, GAP]
    ids = np.concatenate(parts)
    at = np.flatnonzero(ids != PAD)
    log_p = words.share[ids[at]]
    for lo in range(0, len(at), TOKENS):
        a = at[lo : lo + TOKENS]
        h = tables[0].take(ids[a + OFFSETS[0]], axis=0)
        for t, d in zip(tables[1:], OFFSETS[1:]):
            h += t.take(ids[a + d], axis=0)
        z = _logits(p, h)[1]
        own = z[np.arange(len(a)), words.cls[ids[a]]]
        np.exp(z, out=z)
        log_p[lo : lo + TOKENS] += own - np.log(z @ ROWS)
    return np.bincount(np.repeat(np.arange(len(texts)), [len(x) for x in texts]), weights=log_p, minlength=len(texts))


def _pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32)


def _unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s).copy()
        at += int(np.prod(s))
    return out


CHUNK = 4096


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    weights: Counter[int] = Counter()
    for batch in batches:
        for chunk, weight, values in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(values, np.float64)
            weights[chunk] += weight
    rows = [(k, 0, weights[k], v.tobytes()) for k, v in sums.items()]
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.binary()))], names=["chunk", "salt", "weight", "data"])


def first_texts(texts: DataFrame, rows: int) -> list[str]:
    """The ``rows`` texts of least hash: copies count once, and no length is left out."""
    hashed = texts.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(rows).collect()]
    found = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.min("text").alias("text")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["h"])]


def fit(texts: DataFrame, *, warm_rows: int = 400, rate: float = 0.5) -> tuple[Words, dict[str, np.ndarray], DataFrame] | None:
    """Train on all rows of ``texts`` (column ``text``); the last result has the counts of the words beyond the vocabulary."""
    counts = texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lm-counts")
    top = counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY).collect()
    if not top:
        return None
    least = (top[-1]["n"], top[-1]["word"])
    beyond = counts.where((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("word") > least[1])))
    rare = {r["k"]: r["n"] for r in beyond.groupBy((F.crc32(F.col("word").cast("binary")) % RARE_CLASSES).alias("k")).agg(F.sum("n").alias("n")).collect()}
    words = Words([r["word"] for r in top], [r["n"] for r in top], rare)
    p = initial(words)
    warm, done, last = first_texts(texts, warm_rows), 0, -1
    while last < done < WARM_STEPS:  # a whole pass at least; more while steps are missing
        last, whole_pass = done, done == 0
        for step in _windows(warm, words):
            descend(p, *step, rate)
            done += 1
            if not whole_pass and done >= WARM_STEPS:
                break
    del warm
    start = texts.sparkSession.sparkContext.broadcast((words, p))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, own = start.value[0], {k: v.copy() for k, v in start.value[1].items()}
        used, name = 0, 0

        def bodies():
            nonlocal name
            for batch in batches:
                for t in batch.column(0):
                    text = t.as_py()
                    name ^= len(text or "") * 2654435761 & 0xFFFFFFFF
                    yield text

        for sides, target in _windows(bodies(), w):
            descend(own, sides, target, rate / 3)
            used += len(target)
        if used:
            flat = _pack(own).astype(np.float64) * used
            pieces = [flat[lo : lo + CHUNK] for lo in range(0, len(flat), CHUNK)]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int64()), pa.array([name % 64] * n, pa.int64()), pa.array([float(used)] * n, pa.float64()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["chunk", "salt", "weight", "data"]
            )

    shape = "chunk long, salt long, weight double, data binary"
    parts = texts.mapInArrow(refine, shape)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = parts.repartition(n, "chunk", "salt").mapInArrow(_sum_chunks, shape)
    whole = materialise(some.repartition(8, "chunk").mapInArrow(_sum_chunks, shape), "lm-parameters").orderBy("chunk").collect()
    if whole:
        p = _unpack(np.concatenate([np.frombuffer(bytes(r["data"]), np.float64) / r["weight"] for r in whole]).astype(np.float32))
    return words, p, beyond


def pseudo_likelihood(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_likelihood (summed), mean_log_likelihood (null without words) of every row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(base.select("text"))
    if model is None:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_likelihood"), F.lit(None).cast("double").alias("mean_log_likelihood"))
    words, p, beyond = model
    held = base.sparkSession.sparkContext.broadcast((words, p))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, p = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids, rare, ends = [], [], [0]
                for t in part.column(2):
                    own, beyond_it = words.numbers((t.as_py() or "").lower().split())
                    ids.append(own)
                    rare += beyond_it
                    ends.append(len(rare))
                n, sums = np.array([len(x) for x in ids]), score(words, p, ids)
                lists = pa.ListArray.from_arrays(np.array(ends, np.int32), pa.array(_hashes(rare)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), lists], names=["row", "id", "n", "sums", "rare"])

    numbered = base.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    scored = materialise(numbered.mapInArrow(run, f"row long, id {kind}, n long, sums double, rare array<long>"), "lm-scores")
    # The share of a word that occurs n times is n times that of one occurrence; words seen once are settled.
    repeated = beyond.where("n > 1").select(F.xxhash64("word").alias("word"), F.log("n").alias("more"))
    met = scored.select("row", F.explode("rare").alias("word")).join(repeated.hint("shuffle_hash"), "word")
    out = scored.drop("rare").join(met.groupBy("row").agg(F.sum("more").alias("more")), "row", "left")
    total = F.col("sums") + F.coalesce("more", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), total.alias("log_likelihood"), F.when(F.col("n") > 0, total / F.col("n")).alias("mean_log_likelihood"))
