"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Every source gets a target number of words: the sources, in code point order with null last, share
``total`` times all words by cyclic ``weights``, no target passes ``cap`` times its source's words, and
what is over goes to the others by weight until none is above.  That fixed point is ``min(cap, level * weight)``
for one ``level``, found from running sums over the sources sorted by ``cap / weight``.

A source whose target is c times its words takes floor(c) whole copies of each document for certain.
The rest comes from a fixed-size Pareto order sample: documents are ranked by
odds(u) / odds(inclusion probability), u a keyed uniform number of the document, and the
smallest ranks are taken as long as the words stay within the target.  What is still missing is filled in further rounds
of the same rule from documents that fit into the gap; the last round also takes the document that crosses the
target if that comes nearer.

No source is ever gathered in one task: ranks fall into 65536 bins whose sums give the bin in which the cut
lies, and only the documents of that bin are sorted.  What a round takes is then a predicate on rank and cut, so
documents are not joined with what was taken.  The cuts of all rounds are one table, one row a source, which is sent along once if it has at
most SOURCES_BROADCAST rows: what the driver holds of a round does not grow with the rounds before.
Rows that agree in id, source and text are counted in one row, of which a cut may take a part.

Defined cases: null text has size 0 and takes 0; null source is a source, the last; an empty table gives an empty
result; equal ranks go by document id and then by text digest; repeated rows are separate documents; a text of any length is measured whole; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fits_broadcast, word_count

BINS = 65536
SOURCES_BROADCAST = 100_000


def uniform(seed: str, key: Column, digest: Column) -> Column:
    """A number in (0, 1), the same in every run: 48 bits of md5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), digest)
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, cap: float) -> DataFrame:
    """(source, source_size, target) of (source, size) rows."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * float(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))
    return ranked.select("source", "source_size", target.alias("target"))


def _same(x: str, y: str) -> Column:
    return F.col(x).eqNullSafe(F.col(y))


def _at() -> Column:
    return F.struct("rank", "id", "digest")


def _open(gap: Column, last: bool) -> Column:
    """Whether a round may take from the row; the last one may pass the target by less than it misses."""
    return F.coalesce(F.col("chance").isNotNull() & (gap > 0) & (F.col("size") > 0) & (F.col("size") <= gap * (2 if last else 1)), F.lit(False))


def _state(base: DataFrame, plan: DataFrame, done: int, rounds: int, hint) -> DataFrame:
    """``base`` with the plan of its source, rank, bin and ``extra``: how many of the equal rows the first ``done`` rounds take."""
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("chance")) / F.col("chance")
    out = base.join(hint(plan), _same("source", "s_source")).withColumn("rank", odds).withColumn("bin", F.floor(odds / (1 + odds) * BINS))
    extra = F.lit(0).cast("long")
    for k in range(done):
        here, cut = F.col("bin") == F.col(f"bin_{k}"), F.col(f"cut_{k}")
        whole = F.col(f"bin_{k}").isNull() | (F.col("bin") < F.col(f"bin_{k}")) | (here & cut.isNotNull() & (_at() < cut))
        edge = here & cut.isNotNull() & (_at() == cut)
        taken = F.when(_open(F.col(f"gap_{k}"), k == rounds - 1) & edge, F.col(f"part_{k}")).otherwise(0)
        extra = F.when(F.coalesce(_open(F.col(f"gap_{k}"), k == rounds - 1) & whole, F.lit(False)), F.col("m")).otherwise(extra + taken)
    return out.withColumn("extra", extra)


def _cuts(state: DataFrame, hint, last: bool) -> DataFrame:
    """One row a source: what is left before the cut (cut_bin, cut) is taken, and ``part`` of the rows at the cut, ``took`` words in all; without cut_bin all is."""
    open_ = state.withColumn("left", F.when(_open(F.col("gap"), last), F.col("m") - F.col("extra")).otherwise(0)).where("left > 0")
    bins = open_.groupBy("s_source", "bin", "gap").agg(F.sum(F.col("size") * F.col("left")).alias("words"))
    bins = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("s_source").orderBy("bin")))
    cuts = bins.groupBy("s_source").agg(
        F.min(F.when(F.col("upto") >= F.col("gap"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("cut"), F.max("upto").alias("words")
    ).select(F.col("s_source").alias("c_source"), F.col("cut.bin").alias("cut_bin"), F.coalesce("cut.before", "words").alias("before"))
    edge = open_.join(hint(cuts), _same("source", "c_source")).where("bin = cut_bin").withColumn("at", _at())
    words = F.col("size") * F.col("left")
    edge = edge.withColumn("start", F.sum(words).over(Window.partitionBy("s_source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - words + F.col("before"))
    part = F.least(F.col("left"), F.greatest(F.floor((F.col("gap") - F.col("start")) / F.col("size")), F.lit(0)).cast("long"))
    edge = edge.withColumn("part", part)
    if last:
        upto = F.col("start") + F.col("part") * F.col("size")
        nearer = (F.col("part") < F.col("left")) & (upto < F.col("gap")) & (upto + F.col("size") - F.col("gap") < F.col("gap") - upto)
        edge = edge.withColumn("part", F.col("part") + nearer.cast("long"))
    end = F.struct("at", "part", (F.col("start") + F.col("part") * F.col("size")).alias("took"))
    ends = edge.where("part > 0").groupBy("s_source").agg(F.max(end).alias("end")).select(F.col("s_source").alias("e_source"), F.col("end.at").alias("cut"), F.col("end.part").alias("part"), F.col("end.took").alias("took"))
    return cuts.join(ends, _same("c_source", "e_source"), "left").select("c_source", "cut_bin", "cut", "part", F.coalesce("took", "before").alias("took"))


def _decided(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], total: float, cap: float, seed: str, rounds: int
) -> DataFrame:
    """One row for all rows that agree in id, source and digest: their number ``m``, ``certain`` copies of each, ``extra`` for some of them."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.coalesce(F.md5(text), F.lit("")).alias("digest"))
    base = base.groupBy("id", "source", "size", "digest").agg(F.count("*").alias("m"))
    base = scratch.write(base.withColumn("u", uniform(seed, F.col("id"), F.col("digest"))), "mix-sizes")
    targets = source_targets(base.select("source", (F.col("size") * F.col("m")).alias("size")), weights, total, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chance = ratio - F.floor(ratio)
    plan = targets.select(F.col("source").alias("s_source"), "source_size", "target", F.floor(ratio).cast("long").alias("certain"), F.when(chance > 0, chance).alias("chance"), F.lit(0).cast("long").alias("got"))
    plan = scratch.write(plan, "mix-plan")
    small = fits_broadcast(plan, SOURCES_BROADCAST)
    hint = F.broadcast if small else (lambda x: x)
    gap = F.col("target") - F.col("certain") * F.col("source_size") - F.col("got")
    for n in range(rounds):
        plan = plan.withColumn("gap", gap)
        cuts = _cuts(_state(base, plan, n, rounds, hint), hint, n == rounds - 1)
        names = {"gap": f"gap_{n}", "cut_bin": f"bin_{n}", "cut": f"cut_{n}", "part": f"part_{n}"}
        plan = plan.join(hint(cuts), _same("s_source", "c_source"), "left").withColumn("got", F.col("got") + F.coalesce("took", F.lit(0)))
        plan = scratch.write(plan.drop("c_source", "took").withColumnsRenamed(names), "mix-plan")
    out = _state(base, plan, rounds, rounds, hint).select("id", "source", "size", "digest", "m", "extra", "certain", F.col("source_size").cast("long").alias("source_size"), "target")
    out = scratch.write(out, "mix-decided")
    scratch.close("mix-decided")
    return out


def pareto_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    total: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    rounds: int = 4,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's words), copies, taken."""
    out = _decided(docs, id_col, text_col, source_col, weights, total, cap, seed, rounds)
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    copies = F.col("certain") + (F.col("nth") <= F.col("extra")).cast("long")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "digest")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, one row each: id, text, source, size, source_size, target, copies (1 or more), taken."""
    settings = {"weights": (3, 1, 2), "total": 1.5, "cap": 2.0, "seed": "mix", "rounds": 4} | options
    decided = _decided(docs, id_col, text_col, source_col, **settings).where("certain > 0 or extra > 0")
    texts = docs.select(F.col(id_col).alias("t_id"), F.col(source_col).alias("t_source"), F.col(text_col).alias("text"), F.coalesce(F.md5(F.col(text_col)), F.lit("")).alias("t_digest"))
    met = lambda some: texts.join(some, _same("t_id", "id") & _same("t_source", "source") & (F.col("t_digest") == F.col("digest")))
    # Equal rows are one row of ``decided``: their text is taken once and comes back as often.
    several = decided.where("m > 1")
    several = met(F.broadcast(several) if fits_broadcast(several, SOURCES_BROADCAST) else several).dropDuplicates(["id", "source", "digest"])
    out = met(decided.where("m = 1")).unionByName(several).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    copies = F.col("certain") + (F.col("nth") <= F.col("extra")).cast("long")
    return out.select(F.col("id").alias(id_col), "text", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")).where("copies > 0")
