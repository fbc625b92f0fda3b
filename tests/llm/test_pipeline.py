"""Each stage on its own input: the first three against literal versions, personal data and the mix by their properties."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_corpus_operators import linked, low

from regionframe.llm import langid
from regionframe.llm.pareto_mix import pareto_mix

DATA = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def with_odd_rows(spark):
    """The documents of the test table with nulls, empty texts, a repeated row, a null id and columns of names that operators use inside."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [(9001, None, None, None, None), (9002, "", "en", "web", 0), (9003, " 12 !? ", "en", "web", 7), tuple(first), (None, first.text, first.lang, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return docs.withColumns({c: F.lit(1) for c in ("row", "key", "digest", "hit", "body", "id", "n")})


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def uncontaminated(text, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    w, covered = find(low(text or "")), set()
    for n, windows in items.items():
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                covered |= set(range(k, k + n))
    return not covered or 20 * len(covered) < len(w)


def test_stages_on_their_own_input(spark):
    docs = with_odd_rows(spark).cache()
    model = langid.fit(docs)
    sure = {t: bool(re.search(r"[^\W\d_]", t)) and model.scores([langid.fold(t)]).max() >= 0.5 for _, t in rows_of(docs) if t is not None}
    known = STAGE["language"](spark, docs, DATA).cache()
    assert rows_of(known) == Counter({x: n for x, n in rows_of(docs).items() if x[1] is not None and sure[x[1]]})
    assert not {9001, 9002, 9003} & {k for k, _ in rows_of(known)}

    before = rows_of(known)
    root, _ = linked(list(before))
    single = STAGE["near_duplicates"](spark, known, DATA).cache()
    assert rows_of(single) == Counter({x: n if x[0] is None else 1 for x, n in before.items() if x[0] is None or root[x[0]] == x[0]})
    assert 0 < single.count() < known.count()

    items, find = {}, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        v = find(low(r.text or ""))
        n = min(13, len(v))
        if n:
            items.setdefault(n, set()).update(tuple(v[k : k + n]) for k in range(len(v) - n + 1))
    clean = STAGE["decontamination"](spark, single, DATA).cache()
    assert rows_of(clean) == Counter({x: n for x, n in rows_of(single).items() if uncontaminated(x[1], items)})

    private = STAGE["personal_data"](spark, clean, DATA).cache()
    old, new = {k: t for k, t in rows_of(clean)}, {k: t for k, t in rows_of(private)}
    mail = re.compile(r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+")
    assert old.keys() == new.keys() and private.count() == clean.count()
    assert not {m for t in old.values() for m in mail.findall(t)} & {m for t in new.values() for m in mail.findall(t)}
    assert all(new[k] == t for k, t in old.items() if t == low(t) and not re.search(r"[\d@]", t))

    mixed = STAGE["mix"](spark, private, DATA).collect()
    sizes, most, taken = Counter(), Counter(), Counter()
    for r in private.collect():
        sizes[r.source] += len(r.text.split())
        most[r.source] = max(most[r.source], len(r.text.split()))
    for r in mixed:
        assert new[r.doc_id] == r.text and 1 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    goals = {r.source: r.target for r in mixed}
    assert all(abs(taken[s] - goals[s]) <= most[s] for s in goals) and abs(sum(goals.values()) - 1.5 * sum(sizes.values())) < 1


def test_stages_of_an_empty_table(spark):
    docs = with_odd_rows(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        rows = after.count()
        assert 0 < rows <= before
        docs, before = after, rows
    assert corpus_pipeline.run(spark, DATA).count() == before


def test_mix_returns_the_documents_it_takes(spark):
    rows = [(k, f"word{k} " * (k % 7 + 1), "xx", f"s{k % 4}", 1) for k in range(80)] + [(None, "no id", "xx", None, 1), (90, None, "xx", "s1", 0)]
    rows += [rows[5], rows[5], (5, "other text", "xx", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    every = [r for r in pareto_mix(docs).collect() if r.copies > 0]
    got = corpus_pipeline.mix(spark, docs, "").collect()
    assert 0 < len(every) < len(rows)
    texts = {(r[0], hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else ""): r[1] for r in rows}
    key = lambda *x: tuple(map(repr, x))
    assert sorted(key(r.doc_id, r.text, r.source, r.copies) for r in got) == sorted(key(r.doc_id, texts[r.doc_id, r.digest], r.source, r.copies) for r in every)
