"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regionframe.llm import chat_preferences, decontaminate, hnsw, langid, masked_lm, minhash_dedup, page_text, pareto_mix, pii_surrogates, suffix_dedup
from regionframe.llm.column_bwt import suffixes
from regionframe.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not clash.
CLASH = ["row", "hits", "key", "id", "doc", "body", "w", "n", "gaps", "a", "b"]


def test_conversations_of_one_opening_are_paired(spark):
    rng = random.Random(11)
    convs = {k: [("user", rng.choice(["hello", "hello", "what?", f"own {k}"]))] + [(rng.choice(["assistant", "user"]), rng.choice("xyz")) for _ in range(rng.randrange(5))] for k in range(300)}
    convs[400] = [("user", "hello"), ("assistant", "long " * 50_000)]
    rows = [(k, i, *t) for k, ts in convs.items() for i, t in enumerate(ts)] + [(None, 0, "user", "hello")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(9)).withColumn("conv", F.lit(1))
    groups, want = {}, {None: (None, None, 0)}
    for k in sorted(convs):
        groups.setdefault(convs[k][0], []).append(k)
    for g in groups.values():
        for a, b in zip(g[::2], [*g[1::2], None]):
            same = [x == y for x, y in zip(convs[a], convs.get(b, []))]
            want[a] = (a, b, (same + [False]).index(False))
    got = {r.pair_id: (r.chosen_id, r.rejected_id, r.n_prefix) for r in chat_preferences.opening_preferences(d).collect()}
    assert got == want and sum(n > 0 for _, _, n in want.values()) > 50
    assert chat_preferences.opening_preferences(d.limit(0)).count() == 0


def test_pseudo_likelihood_is_the_sum_of_conditionals(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randrange(0, 60), WORDS) + f" only{k} twice{k // 2}", "", "", 0) for k in range(40)] + [(90, None, "", "", 0), (91, " ", "", "", 0), (92, "word " * 30_000, "", "", 0)]
    d = documents(spark, rows)
    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(d).collect()}
    words, p, beyond = masked_lm.fit(d.select("text"))
    times = {r.word: r.n for r in beyond.collect()}
    assert set(got) == {r[0] for r in rows}
    for k, text, *_ in rows:
        tokens = (text or "").lower().split()
        assert got[k].n_tokens == len(tokens)
        if not tokens or len(tokens) > 1000:
            continue
        ids = [masked_lm.PAD] * masked_lm.REACH + words.encode(text).tolist() + [masked_lm.PAD] * masked_lm.REACH
        total = 0.0
        for i, word in enumerate(tokens):
            at = i + masked_lm.REACH
            near = [ids[at + o] for o in range(-masked_lm.REACH, masked_lm.REACH + 1) if o]
            h = np.tanh(sum(p["embed"][n].astype(float) @ p["project"][s].astype(float) for s, n in enumerate(near)) + p["inner"])
            z = h @ p["out"] + p["bias"]
            total += z[words.cls[ids[at]]] - np.log(np.exp(z).sum()) + words.share[ids[at]] + np.log(times.get(word, 1))
        assert got[k].log_likelihood == pytest.approx(total, rel=0.02)


def documents(spark, rows, clash=False):
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit(1) for c in CLASH}) if clash else d


def low(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = [a + b for a in "ba ke lo mi nu pa re so tu wi".split() for b in "ban kel lor mit nus par rel".split()]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(1, 120), WORDS), "xx", f"s{k % 3}", 1) for k in range(60)]
    base = rows[7][1].split() + prose(rng, 60, WORDS).split()
    for k in range(60, 75):  # near copies: a few words changed
        near = list(base)
        for _ in range(k % 5):
            near[rng.randrange(len(near))] = "zz"
        rows.append((k, " ".join(near), "xx", None, 1))
    rows += [(80, None, None, None, None), (81, "", "xx", "s1", 0), (82, " \t\n ", "xx", "s1", 0), (83, "one two", "xx", "s1", 1), (84, "One\ttwo", "xx", "s1", 1), (85, "é " * 3000, "xx", "s2", 1)]
    rows += [rows[3], (None, "lost words here", "xx", "s1", 1), (90, "Nd, " * 400, "xx", "s0", 1)]
    return rows


def test_chat(spark):
    t = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, None, None), (4, 0, "user", "x"), (None, 0, "user", "n"), (0, 1, "assistant", "a")]
    d = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(9)).withColumn("t", F.lit(1))
    out = {r.pair_id: r for r in chat_preferences.format_preferences(d, *chat_preferences.adjacent_pairs()).collect()}
    r = out[0]
    assert r.n_prefix == 1 and r.prompt == "<|user|>\nhi<|end|>\n" and r.rejected.startswith("<|assistant|>\nb<|end|>\n<|unknown|>\n")
    assert [r.chosen[int(a) : int(b)] for a, b in (s.split("-") for s in r.chosen_mask.split(","))] == ["a<|end|>", "a<|end|>"]
    assert out[2].rejected is None and out[2].chosen_id == 4 and out[None].chosen.startswith("<|user|>\nn")
    assert chat_preferences.format_preferences(d.limit(0), *chat_preferences.adjacent_pairs()).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Top</header><nav><a href=x>Menu</a></nav><div class="ad">Buy</div>
<article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b>
text<br>next &eacute;<p>Second<script>var x="</p>";</script><form>mail <input></form><aside>side</aside><!-- <p>no</p> --><ul><li>one<li>two</ul>
<section class="comments"><p>Nice!</p></section></article><div id="cookie-notice">Cookies</div><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    same = "<html><body><p>Welcome to the site</p><p>Story {} is here</p><p>All rights kept</p></body></html>"
    rows = [(1, "http://a.b/x", PAGE), (2, "http://a.b/y", None), (3, "http://h.c/n/1", same.format("one")), (4, "http://h.c/n/2", same.format("two")), (5, None, "<p>alone"), (1, "http://a.b/x", PAGE), (6, "u", "<p>cut <b")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("key", F.lit(2)).withColumn("lines", F.lit(3))
    out = [(r.page_id, r.text, r.n_chars) for r in page_text.main_text(d).collect()]
    main = "Title & more\n\nFirst bold text next é\n\nSecond\n\none\n\ntwo"
    assert sorted(out, key=str) == sorted([(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "Story one is here", 17), (4, "Story two is here", 17), (5, "alone", 5), (6, "cut", 3)], key=str)
    assert page_text.main_text(d.limit(0)).count() == 0
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = page_text.common(a, b)
        it = iter(b)
        assert len(got) == table[-1][-1] and all(a[i] in it for i in got)


def test_language(spark):
    rng = random.Random(3)
    kinds = {"aa": WORDS, "bb": [w[::-1] + "x" for w in WORDS]}
    rows = [(k, prose(rng, rng.randint(1, 30), kinds[lang]), lang, lang, 1) for k, lang in ((k, rng.choice(["aa", "bb"])) for k in range(200))]
    rows += [(900, None, "aa", "", 0), (901, "123 !!", "bb", "", 0), (902, "", None, "", 0), rows[0]]
    out = {r.doc_id: r for r in langid.language_of(documents(spark, rows, True), per_lang=100).collect()}
    held = [r for r in rows[:200] if out[r[0]].held_out]
    assert len(out) == 203 and 30 < len(held) < 110
    assert sum(out[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (900, 901, 902))
    kept = langid.identified(documents(spark, rows, True), per_lang=100)
    assert set(CLASH) < set(kept.columns) and {r.doc_id for r in kept.collect()}.isdisjoint({900, 901, 902})
    assert langid.language_of(documents(spark, [])).count() == 0
    m = langid.train([("aa", "x y"), ("bb", "z")], steps=3)
    whole = langid.fold("ab cd " * 400_000)  # more than a chunk: as if read at once
    assert np.allclose(m.scores([whole, b" q "])[0], m.scores([whole])[0])


def test_surrogates(spark):
    rows = [
        (1, "mail Ann.Lee@corp.com or +1 (499) 555-6503, card 4539578763621486.", "", "", 0), (2, "call +1 499 555 6503; ip 10.20.30.40; ann.lee@corp.com", "", "", 0),
        (3, 'token = "254a3ed195c502ef96b5857aa82e5fbcfb6b6856" Mr. John Smith met Mrs. Mary Jones', "", "", 0), (4, None, "", "", 0), (5, "", "", "", 0), (6, "clean words only", "", "", 0), (1, "mail Ann.Lee@corp.com or +1 (499) 555-6503, card 4539578763621486.", "", "", 0),
    ]
    out = pii_surrogates.replace_entities(documents(spark, rows, True), key="test", count_col="found")
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 7 and got[4].text is None and got[6].text == "clean words only" and got[1].found == 3 and got[3].found == 3
    one = re.fullmatch(r"mail (\S+@\S+) or (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{16})\.", got[1].text)
    two = re.fullmatch(r"call (\+1 \d{3} \d{3} \d{4}); ip (\d+\.\d+\.\d+\.\d+); (\S+)", got[2].text)
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(one[2]) == digits(two[1]) != "14995556503" and one[1].lower() == two[3].lower() != "ann.lee@corp.com"
    luhn = lambda s: sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(s))) % 10
    assert luhn("4539578763621486") == 0 == luhn(one[3]) and one[3] != "4539578763621486"
    three = re.fullmatch(r'token = "([0-9a-f]{40})" Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)', got[3].text)
    assert three and three[2] in pii_surrogates.GIVEN["latin", "m"] and three[4] in pii_surrogates.GIVEN["latin", "f"]
    assert pii_surrogates.replace_entities(documents(spark, []), key="test").count() == 0
    # Distinct in a tiny space: 90 addresses of one shape that can clash often.
    many = [(k, f"at 7.7.7.{k}", "", "", 0) for k in range(10, 100)]
    seen = [r.text for r in pii_surrogates.replace_entities(documents(spark, many), key="test").collect()]
    assert len(set(seen)) == 90 and not set(seen) & {r[1] for r in many}


def test_surrogates_never_run_out(spark):
    # 5000 of the 6561 addresses of single digits, and more one-word names than four syllables make.
    text = F.concat(F.lit("at "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.floor(F.col("id") / F.pow(F.lit(9), i)) % 9 + 1).cast("long").cast("string")), "."))
    name = F.concat(F.lit("Mr. Q"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), text.alias("text")).unionByName(spark.range(5000, 85000).select(F.col("id").alias("doc_id"), name.alias("text")))
    out = pii_surrogates.replace_entities(rows, key="test").toPandas()
    before = set(rows.toPandas()["text"])
    assert out["text"].nunique() == 85000 and not set(out["text"]) & before


def test_a_family_name_alone_is_the_same_person(spark):
    rows = [(1, "Mr. John Smith spoke.", "", "", 0), (2, "then Mr. Smith left with Mrs. Smith and Dr. John Brown", "", "", 0), (3, "x " * 200_000 + "Mr. Smith", "", "", 0)]
    got = {r.doc_id: r.text for r in pii_surrogates.replace_entities(documents(spark, rows), key="test").collect()}
    given, family = re.fullmatch(r"Mr\. (\w+) (\w+) spoke\.", got[1]).groups()
    other = re.fullmatch(r"then Mr\. (\w+) left with Mrs\. (\w+) and Dr\. (\w+) (\w+)", got[2]).groups()
    assert other[0] == other[1] == family and other[2] == given and other[3] not in (family, "Brown") and got[3] == "x " * 200_000 + f"Mr. {family}"
    again = {r.doc_id: r.text for r in pii_surrogates.replace_entities(documents(spark, rows), key="another").collect()}
    assert again[1] != got[1]


def hits(text, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    w = find(low(text or ""))
    covered, ids = set(), set()
    for item, body in items:
        v = find(low(body or ""))
        n = min(13, len(v))
        for s in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == s:
                    covered |= set(range(k, k + n))
                    ids.add(str(item))
    return len(w), len(covered), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(covered) and 20 * len(covered) >= len(w), covered


@pytest.mark.parametrize("heads", [decontaminate.HEADS, 20])
def test_decontamination(spark, corpus, heads):
    rng = random.Random(9)
    items = [(10, prose(rng, 30, WORDS)), (11, prose(rng, 4, WORDS)), (9, prose(rng, 13, WORDS)), (2, "Short ITEM é"), (3, None), (4, "!!"), (5, "solo")]
    rows = list(corpus) + [(200, f"x {items[0][1].upper()} y", "", "", 0), (201, "a short\nitem, É short item é; solo", "", "", 0), (202, prose(rng, 300, WORDS) + " " + items[1][1], "", "", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(documents(spark, rows, True), bench, heads=heads).collect()
    assert len(out) == len(rows)
    want = sorted(((r[0], *hits(r[1], items)[:5]) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out), key=str) == want
    kept = decontaminate.decontaminate(documents(spark, rows, True), bench, heads=heads)
    assert set(CLASH) < set(kept.columns) and kept.count() == sum(not x[5] for x in want)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(documents(spark, rows), bench, remove="spans", heads=heads).collect()}
    assert cut[200] == "x  y" and cut[85] == "é " * 3000
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
    assert decontaminate.contamination(documents(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_a_large_benchmark_and_a_long_text(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(100)]
    items = [(k, " ".join(rng.choice(words) for _ in range(412))) for k in range(500)]  # 200 000 windows
    long = prose(rng, 20_000, words)
    rows = [(k, f"{prose(rng, 30, words)} {' '.join(items[k][1].split()[40:60])}", "", "", 0) for k in range(20)] + [(50, f"{long} {' '.join(items[7][1].split()[:255])} {items[9][1]}", "", "", 0), (51, long, "", "", 0)]
    out = {r.doc_id: r for r in decontaminate.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all((out[k].n_hit, out[k].n_items) == (20, 1) for k in range(20))
    assert (out[50].n_words, out[50].n_hit, out[50].n_items, out[51].n_hit) == (20_667, 667, 2, 0)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1200, 16))
    v[100:400] = v[100]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (None, v[0].tolist()), (5, v[5].tolist()), (2200, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("row", F.lit(1)).withColumn("shard", F.lit(1))
    got = {}
    for r in hnsw.nearest(d, shard=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    right = 0
    assert sorted(got) == list(range(0, 1200, 50))
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = sorted(range(1200), key=lambda k: (-round(s[k], 9), k))[:5]
        right += len(set(best) & {k for k, _ in found})
        assert len(found) == 5 and all(abs(s[k] - x) < 1e-9 for k, x in found)
    assert right >= 0.95 * 5 * len(got)
    assert [k for k, _ in got[150]] == [100, 101, 102, 103, 104]
    assert hnsw.nearest(d.limit(0)).count() == 0
    assert hnsw.nearest(d.where("vec_id in (0, 1, 2)")).count() == 2


def test_masked_lm(spark, corpus):
    rng = random.Random(1)
    order = [WORDS[k : k + 7] for k in range(0, 70, 7)]
    rows = [(k, " ".join(order[(k + j) % 10][rng.randrange(7)] for j in range(200)), "", "", 0) for k in range(60)]
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    rows += [(100, " ".join(mixed), "", "", 0), (101, None, "", "", 0), (102, "", "", "", 0), (103, "lone", "", "", 0), rows[1]]
    out = masked_lm.pseudo_likelihood(documents(spark, rows, True)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[101].n_tokens == 0 and got[101].log_likelihood == 0 and got[102].mean_log_likelihood is None and got[103].n_tokens == 1
    assert got[0].log_likelihood > got[100].log_likelihood + 20  # order counts
    assert masked_lm.pseudo_likelihood(documents(spark, [])).count() == 0


def test_masked_lm_trains_on_every_position(spark):
    text = "a b " * 500
    words = masked_lm.Words(["a", "b"], [500, 500], {})
    seen = list(masked_lm._windows([text, None, "a"], words))
    assert sum(len(target) for _, target in seen) == 1001
    long = "long " * 30_000  # over 100 000 bytes
    got = masked_lm.first_texts(spark.createDataFrame([(long,), (None,), *[("same",)] * 50, ("other",)], "text string"), 3)
    assert sorted(got) == sorted([long, "same", "other"])


def test_masked_lm_kernels_against_literal_versions(monkeypatch):
    rng = np.random.default_rng(4)
    words = masked_lm.Words(["a", "b", "c"], [50, 30, 20], {})
    sides, target = rng.choice([0, 1, 2, masked_lm.PAD], (50, masked_lm.SIDES)), rng.integers(masked_lm.CLASSES, size=50)
    for bias in (0.0, 500.0):  # beyond the range of exponentials too
        p = masked_lm.initial(words)
        p["bias"][5] += bias
        q = {k: v.astype(np.float64) for k, v in p.items()}
        masked_lm.descend(p, sides, target, 0.1)
        x = q["embed"][sides]
        h = np.tanh(np.einsum("nsd,sdh->nh", x, q["project"]) + q["inner"])
        z = h @ q["out"] + q["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        z = z / z.sum(1, keepdims=True) - np.eye(masked_lm.CLASSES)[target]
        back = (z @ q["out"].T) * (1 - h * h)
        into = np.einsum("nh,sdh->nsd", back, q["project"])
        q["out"] -= 0.1 / 50 * h.T @ z
        q["bias"] -= 0.1 / 50 * z.sum(0)
        q["project"] -= 0.1 / 50 * np.einsum("nsd,nh->sdh", x, back)
        q["inner"] -= 0.1 / 50 * back.sum(0)
        np.subtract.at(q["embed"], sides, 0.1 / np.sqrt(50) * into)
        assert all(np.allclose(p[k], q[k], atol=2e-5) for k in q)
    monkeypatch.setattr(masked_lm, "WORDS", 5)
    texts = pa.RecordBatch.from_pydict({"text": ["B a\x1cb", None, "", "\u00e9 \u3000 a", *["a b"] * 300]})
    got = [(w, n) for out in masked_lm._count(iter([texts])) for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert len(got) > 3 and {w: sum(n for v, n in got if v == w) for w, _ in got} == {"a": 302, "b": 302, "\u00e9": 1}


def test_masked_lm_counts_of_words_beyond_the_vocabulary(spark):
    kind = lambda w: zlib.crc32(w.encode()) % masked_lm.RARE_CLASSES
    often = "öfter"
    once = next(w for w in (f"once{k}" for k in range(1000)) if kind(w) == kind(often))
    frequent = " ".join(f"w{k}" for k in range(masked_lm.VOCABULARY))
    rows = [(k, t, "", "", 0) for k, t in enumerate([" ".join([frequent] * 6), often, once, often, f"w1 {often} {often}"])]
    got = {r.doc_id: r.log_likelihood for r in masked_lm.pseudo_likelihood(documents(spark, rows)).collect()}
    assert abs(got[1] - got[2] - np.log(4)) < 1e-6 and abs(got[1] - got[3]) < 1e-6


def differenced(spark, rows):
    return {r.page_id: r.text for r in page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_beside_copies(spark):
    page = lambda *lines: "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"
    one, story = page("Welcome", "The only story of this host", "Rights"), [f"Paragraph {k} of a long story" for k in range(20)]
    rows = [(1, "http://copy.x/a", one), (2, "https://copy.x/a?q=1", one), (3, "http://copy.x/b", one)]
    rows += [(4, "http://more.x/n/1", one), (5, "http://more.x/n/1?v=2", one), (6, "http://more.x/n/2", one), (7, "http://more.x/n/3", page("Welcome", "Another one", "Rights"))]
    rows += [(8, "http://near.x/1", page(*story, "End")), (9, "http://near.x/2", page(*story, "Fin"))]
    got = differenced(spark, rows)
    assert all(got[k] == "Welcome\n\nThe only story of this host\n\nRights" for k in (1, 2, 3))
    assert all(got[k] == "The only story of this host" for k in (4, 5, 6)) and got[7] == "Another one"
    assert got[8] == "\n\n".join([*story, "End"]) and got[9] == "\n\n".join([*story, "Fin"])


def test_marked_pages_are_differenced_too(spark):
    page = "<body><div>Welcome</div>{}<div>Rights</div></body>"
    # A mark that holds no text: differencing decides.
    rows = [(k, f"http://script.x/{k}", page.format(f"<script>'<article>'</script><main></main><p>Story {k}</p>")) for k in range(4)]
    # A marked article keeps what it repeats, and its page is compared all the same.
    rows += [(k, f"http://marked.x/{k}", page.format(f"<nav>Menu</nav><article><p>Repeated passage</p><p>Story {k}</p></article>")) for k in range(10, 14)]
    rows += [(20, "http://alone.x/", page.format("<article>One</article>")), (21, "http://none.x/", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_shared) for r in page_text.main_text(d).collect()}
    assert got == {k: (f"Story {k}", 2) for k in range(4)} | {k: (f"Repeated passage\n\nStory {k}", 4) for k in range(10, 14)} | {20: ("One", 0), 21: ("", 0)}


def test_pages_of_a_large_host(spark):
    rows = [(k, f"http://big.x/en/{k:04d}", f"<p>Terms of section {k // 10}</p><p>Story {k} is told here</p>") for k in range(1200)]
    rows += [(k, f"http://copies.x/{k}", "<p>Same</p><p>text</p>") for k in range(5000, 5300)] + [(6000, "http://copies.x/60", "<p>Same</p><p>end of it</p>")]
    got = differenced(spark, rows)
    assert all(got[k] == f"Story {k} is told here" for k in range(1200))
    assert all(got[k] == "text" for k in range(5000, 5300)) and got[6000] == "end of it"


def test_carried_rows_are_those_of_the_whole_order():
    rng = random.Random(4)
    for _ in range(200):
        rows = sorted({(rng.choice("ab"), str(k), rng.randrange(2), True, ()) for k in range(rng.randrange(1, 12))})
        parts = [rng.randrange(4) for _ in rows]
        parts.sort()
        edges = []
        for p in set(parts):
            own = [r for r, q in zip(rows, parts) if q == p]
            for last, found in ((False, page_text._two(iter(own))), (True, page_text._two(reversed(own)))):
                edges += [dict(zip(("part", "last", "place", "host", "path", "content", "wanted", "lines"), (p, last, k, *r))) for k, r in enumerate(found)]
        got = []
        for p, (head, tail) in page_text._carried(edges).items():
            own = [r for r, q in zip(rows, parts) if q == p]
            got += [(p, r, o and o[:3]) for r, o in list(zip(own, page_text._others([*head, *own, *tail])[len(head) :]))]
        want = [(p, r, o and o[:3]) for p, r, o in zip(parts, rows, page_text._others(rows))]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_pages_without_marks_of_a_large_host(spark):
    body = "<html><body><p>Welcome to the site</p><p><a href=x>Story {0} has its own line</a></p><p>And number {0} a second</p><p>All rights kept</p></body></html>"
    rows = [(k, f"http://h.c/n/{k}", body.format(k)) for k in range(1500)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in page_text.main_text(d).collect()}
    assert out == {k: f"Story {k} has its own line\n\nAnd number {k} a second" for k in range(1500)}


def linked(rows):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(shingle(r[1]))
    root = {k: k for k in sets if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}, {k: sorted(len(s) for s in v) for k, v in sets.items()}


def test_recall_on_clusters_over_several_shards(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.standard_normal((60, 32)), 100, 0) + 0.05 * rng.standard_normal((6000, 32))
    d = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in hnsw.nearest(d, shard=1500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    right = sum(len(found[q] & set([x for x in np.argsort(-(unit @ unit[q]))[:6] if x != q][:5])) for q in range(0, 6000, 50))
    assert right >= 0.9 * 5 * 120


def test_near_duplicates(spark, corpus):
    root, sizes = linked(corpus)
    out = minhash_dedup.near_duplicates(documents(spark, corpus, True)).collect()
    assert len(out) == len(corpus) and len(set(root.values())) < len(root) - 10
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == root
    assert all(r.n_shingles in sizes[r.doc_id] and r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    kept = minhash_dedup.distinct_documents(documents(spark, corpus))
    assert {r.doc_id for r in kept.collect()} == {k for k, c in root.items() if k == c} | {None}
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_shared_passages_make_no_candidates(spark):
    rng = random.Random(3)
    words = [a + b + c for a in "ba ke lo mi nu".split() for b in "dra fen gor his jul".split() for c in "kat lem nip".split()]
    passage = prose(rng, 60, words)
    rows = [(k, f"{prose(rng, 20, words)} {passage} {prose(rng, 20, words)}", "", "", 0) for k in range(300)]
    near = rows[4][1].split()
    rows += [(500, " ".join([*near[:-1], "other"]), "", "", 0)]
    docs = documents(spark, rows).select(F.col("doc_id").alias("doc"), "text")
    members = docs.select(F.col("doc").alias("rep"), F.col("doc").alias("comp"))
    pairs = [tuple(r) for r in minhash_dedup._rare_pairs(members, docs, Scratch(spark)).collect()]
    assert (4, 500) in pairs and len(pairs) < 30
    out = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert out == {k: k for k in range(300)} | {500: 4}


def test_rows_that_repeat_an_id_leave_one(spark):
    rows = [(1, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (1, "other words stand here now", "", "", 0), (2, None, "", "", 0), (2, None, "", "", 0), (None, "x", "", "", 0), (None, "x", "", "", 0)]
    got = minhash_dedup.distinct_documents(documents(spark, rows)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, None, None]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (103, 102)]
    got = {r.node: r.component for r in minhash_dedup.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 104)}


def removed(rows):
    def key(r):
        return (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())

    seen, out = set(), {}
    for k in sorted({key(r): r for r in rows}.items()):
        b = (k[1][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[k[0]] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *out[key(r)]) for r in rows), key=str)


def test_repeats_of_a_text_longer_than_a_piece(spark):
    rng = random.Random(12)
    shared = prose(rng, 80, WORDS)
    long = prose(rng, 70_000, WORDS)
    assert len(long) > suffix_dedup.PIECE
    cut = suffix_dedup.PIECE - 200  # a repeat across the border of two pieces
    rows = [(1, long[:cut] + shared + long[cut:], "", "", 0), (2, f"x {shared} {long[5000:9000]} y", "", "", 0), (3, long[cut - 50 : cut] + shared, "", "", 0)]
    out = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_repeats(documents(spark, rows)).collect())
    assert out == removed(rows)


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("where", [{}, {"hot": 2}, {"often": 2, "crowd": 3}])
def test_repeats(spark, corpus, repeated, where):
    rng = random.Random(8)
    shared = prose(rng, 60, WORDS)
    rows = [r for r in corpus if r[0] is not None]
    rows = rows if repeated else list({r[0]: r for r in rows}.values())
    rows += [(300 + k, f"{prose(rng, 20, WORDS)} {shared} {prose(rng, 20, WORDS)}", "", "", 0) for k in range(12)]
    if repeated:
        rows += [(300, shared, "", "", 0), (None, shared, "", "", 0)]
    out = suffix_dedup.removed_repeats(documents(spark, rows, True), **where).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == removed(rows)
    assert suffix_dedup.removed_repeats(documents(spark, [])).count() == 0


def test_crowded_minimisers_are_spread(spark):
    rng = random.Random(31)
    phrase = "the one phrase that every document of this table holds"
    rows = [(k, f"{prose(rng, 30, WORDS)} {phrase} {prose(rng, 30, WORDS)}", "", "", 0) for k in range(200)] + [(500, f"{phrase} {phrase} {phrase} {phrase}", "", "", 0)]
    d = documents(spark, rows)
    crowds, total = suffix_dedup._crowds(d.select(F.col("doc_id").alias("doc"), "text"), 8, 100)
    assert crowds.count() > 0 and total > 1000
    got = suffix_dedup.removed_repeats(d, crowd=100).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == removed(rows)


def test_column_bwt():
    rng = random.Random(1)
    for _ in range(50):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        string, offset, lcp = suffixes(s, 7)
        want = sorted((s[i][k:], i, k) for i in range(len(s)) for k in range(len(s[i]) + 1))
        assert [(i, k) for _, i, k in want] == list(zip(string.tolist(), offset.tolist()))
        share = lambda x, y: next((n for n in range(7) if n >= min(len(x), len(y)) or x[n] != y[n]), 7)
        assert lcp.tolist() == [0] + [share(want[i - 1][0], want[i][0]) for i in range(1, len(want))]


def test_mix(spark, corpus):
    d = documents(spark, corpus, True)
    out = pareto_mix.pareto_mix(d).collect()
    again = pareto_mix.pareto_mix(d).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str) and len(out) == len(corpus)
    sums = {}
    for r in corpus:
        sums[r[3]] = sums.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(s for s in sums if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, goal = {s for s in names if sums[s]}, dict.fromkeys(names, 0.0)
    total = 1.5 * sum(sums.values())
    while True:
        level = (total - sum(goal[s] for s in names if s not in left)) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sums[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * sums[s]
        left -= over
    for s in left:
        goal[s] = level * weight[s]
    taken = dict.fromkeys(names, 0)
    for r in out:
        assert abs(r.target - goal[r.source]) < 1e-6 and r.source_size == sums[r.source] and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] + 3 for s in names)
    assert pareto_mix.pareto_mix(documents(spark, [])).count() == 0


def test_a_later_round_of_the_mix_joins_no_more_than_an_early_one(spark, corpus, monkeypatch):
    d, joins, write = documents(spark, corpus, True), [], Scratch.write

    def counted(self, df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", counted)

    def mix(rounds):
        """The most joins in one query of the mix, each of which the driver may have to send, and its rows."""
        joins.clear()
        rows = sorted(map(tuple, pareto_mix.pareto_mix(d, rounds=rounds).collect()), key=str)
        return max(joins), rows

    few, many = mix(2), mix(6)
    assert 0 < many[0] == few[0]
    monkeypatch.setattr(pareto_mix, "SOURCES_BROADCAST", 0)
    assert mix(6)[1] == many[1]
