"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the bag of its byte 1- to 4-grams (ASCII letters lower-cased, other ASCII and white space as one blank), each hashed to a row of
an embedding table.  The mean of the rows goes through a linear layer and a softmax.  Both layers are trained in numpy by
stochastic gradient descent, on at most about ``2 * per_lang`` labelled texts of each language, drawn by a hash of the id, and at most
``longest`` characters of each (the documented bounds of the fit; every text is predicted whole).  Since mean and linear layer commute, prediction
needs one table of hashed n-gram to score per language, which is sent with the plan; its size does not depend on the data.

The probability is calibrated by a temperature fitted on texts kept out of training.  A text whose best calibrated probability
is under ``reject`` is rejected by ``identified``, as is a text without letters.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; without labelled rows every text is ``und``; null
labels are not learned from; repeated rows are predicted each; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (1, 2, 3, 4)
BITS = 15
DIM = 16
CHUNK = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "


def grams(buf: np.ndarray) -> list[np.ndarray]:
    """Hash bucket of the n-gram that ends at each byte, for each order; the first ones reach back into blanks."""
    b = buf.astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in ORDERS:
        # The n-gram ending at i is the one of order n - 1 ending at i - 1 and byte i.
        h = np.concatenate([np.full(1, 32, np.uint32), h[:-1]]) * np.uint32(0x01000193) + b + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((mixed >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def eligible(doc_id: Column, lang: Column) -> Column:
    return lang.isNotNull() & (F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1)


class Model:
    """``table[order, bucket, lang]`` and ``bias``: scores of the languages; ``temperature`` calibrates them."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.temperature = langs, table, bias, temperature

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities; texts are folded."""
        sums = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts])
        at = 0
        while at < len(texts):
            stop, total = at, 0
            while stop < len(texts) and (total == 0 or total + sizes[stop] <= CHUNK):
                total += sizes[stop]
                stop += 1
            buf = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
            starts = np.concatenate([[0], np.cumsum(sizes[at:stop])[:-1]])
            for lo in range(0, len(buf), CHUNK):  # a text of any length in pieces of bounded memory
                hi = min(len(buf), lo + CHUNK)
                back = max(0, lo - len(ORDERS))
                inside = np.flatnonzero((starts < hi) & (starts + sizes[at:stop] > lo))
                cuts = np.maximum(starts[inside], lo) - lo
                for n, idx in enumerate(grams(buf[back:hi])):
                    sums[at + inside] += np.add.reduceat(self.table[n][idx[lo - back :]], cuts, axis=0)
            at = stop
        logits = sums / np.maximum(sizes, 1)[:, None] / len(ORDERS) + self.bias
        logits = (logits - logits.max(1, keepdims=True)) / self.temperature
        e = np.exp(logits)
        return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], *, steps: int = 400, batch: int = 128, rate: float = 40.0, seed: int = 7) -> Model | None:
    """Fit on (lang, text) rows, in the order given."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    label = {lang: k for k, lang in enumerate(langs)}
    by: list[list[bytes]] = [[] for _ in langs]
    for lang, text in rows:
        if len(f := fold(text)) > 2:
            by[label[lang]].append(f)
    by = [x or [b"  "] for x in by]
    held = [x[: len(x) // 5] or x for x in by]
    kept = [x[len(x) // 5 :] or x for x in by]

    def draw(pool: list[list[bytes]], n: int) -> tuple[list[bytes], np.ndarray]:
        """Cuttings of 1 to 60 words of random texts, languages in turn."""
        y = np.arange(n) % len(langs)
        out = []
        for k in y:
            words = pool[k][rng.integers(len(pool[k]))].split()
            n_words = int(min(len(words), np.ceil(60 ** rng.random())))
            first = int(rng.integers(len(words) - n_words + 1)) if words else 0
            out.append(b" " + b" ".join(words[first : first + n_words]) + b" ")
        return out, y

    rows_n = len(ORDERS) << BITS
    embed = (rng.standard_normal((rows_n, DIM)) * 0.1).astype(np.float32)
    weight, bias = (rng.standard_normal((DIM, len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32)
    for step in range(steps):
        lr = rate * (1 - step / steps)
        texts, y = draw(kept, batch)
        sizes = np.array([len(t) for t in texts])
        idx = np.stack([g + (n << BITS) for n, g in enumerate(grams(np.frombuffer(b"".join(texts), np.uint8)))], 1).ravel()
        owner = np.repeat(np.arange(batch), sizes * len(ORDERS))
        share = (1 / (sizes * len(ORDERS))).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(sizes * len(ORDERS))[:-1]])
        hidden = np.add.reduceat(embed[idx], starts, axis=0) * share[:, None]
        z = hidden @ weight + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        back = (p @ weight.T) * share[:, None]
        bias -= lr * 0.01 * p.sum(0)
        weight -= lr * 0.05 * (hidden.T @ p)
        order = np.argsort(idx, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(idx[order]) > 0])
        embed[idx[order[heads]]] -= lr * np.add.reduceat(back[owner[order]], heads, axis=0)
    model = Model(langs, (embed @ weight).reshape(len(ORDERS), 1 << BITS, -1), bias.astype(np.float64), 1.0)
    texts, y = draw(held, 1000)
    log_p = np.log(np.maximum(model.scores(texts), 1e-30))

    def loss(t: float) -> float:
        z = log_p / t
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    model.temperature = min((2.0 ** (k / 4) for k in range(-20, 13)), key=loss)
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, longest: int = 200_000) -> Model | None:
    """Train on rows whose crc32(id) mod 3 is not 1: per language about ``per_lang`` (at most twice that, plus chance) texts, picked by a hash of the id.

    Of a picked text of more than ``longest`` characters a cutting of that length is learned from, at a place that the hash decides.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(eligible(F.col("i"), F.col("l")))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    pick = F.lit(False)
    if counts:
        every = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(max(1, n // per_lang)))])
        pick = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit(""))), every[F.col("l")]) == 0
    start = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - longest, F.lit(0)) + 1).cast("int") + 1
    got = rows.where(pick & F.col("t").isNotNull()).select("i", "l", F.substring("t", start, F.lit(longest)).alias("t")).collect()
    return train([(r["l"], r["t"]) for r in sorted(got, key=lambda r: (str(r["i"]), r["l"], r["t"]))])


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) in one struct ``row``, with lang_pred and score."""
    kept = F.struct(*keep) if keep else F.struct("*")
    source = docs.select(kept.alias("row"), F.col(text_col).alias("body"))
    schema = T.StructType([source.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                body = part.column(1)
                letters = pc.fill_null(pc.match_substring_regex(body, r"\pL"), False).to_pylist()
                best, score = ["und"] * part.num_rows, [0.0] * part.num_rows
                at = [k for k, yes in enumerate(letters) if yes]
                if at and model is not None:
                    p = model.scores([fold(body[k].as_py()) for k in at])
                    for k, c, s in zip(at, p.argmax(1), p.max(1)):
                        best[k], score[k] = model.langs[c], float(s)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def language_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """id, held_out, lang_pred, score of every row."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    out = predict(docs, model, text_col=text_col, keep=(id_col,))
    held = F.coalesce(F.crc32(F.col(f"row.{id_col}").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select(F.col(f"row.{id_col}").alias(id_col), held.alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, *, text_col: str = "text", reject: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows whose language is rejected: no letter, or a calibrated probability under ``reject``."""
    model = fit(docs, text_col=text_col, **options)
    out = predict(docs, model, text_col=text_col)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= reject)).select("row.*")
