"""Hand-computed results."""

import numpy as np
from pyspark.sql import functions as F

from regionframe.functions import scalars as S
from regionframe.operators import dedup, evalm, kernels, refplan, regions, series, vote
from regionframe.plans import catalogue


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_region_metrics(spark):
    rows = [(1, "A", "A", 20), (2, "C", "B", 5), (3, "bg", "bg", 30)]
    d = spark.createDataFrame(rows, "seg int, gt string, pred string, n int")
    m = evalm.region_metrics(d, [], F.col("gt") == F.col("pred"), F.col("gt") == "bg", F.col("pred") == "bg", "n", 10, F.lit(100)).first()
    assert abs(m.acc - 2 / 3) < 1e-12 and m.acc_thres == 1.0 and abs(m.pix_acc - 50 / 55) < 1e-12 and m.pix_acc_wobg == 0.8 and m.bmiou == 1.0 and m.pix_bmiou == 1.0


def test_vote_takes_sum_then_smallest(spark):
    d = spark.createDataFrame([(1, "X", 0.40), (1, "Y", 0.35), (1, "Y", 0.25), (2, "b", 0.5), (2, "a", 0.5)], "s int, c string, w double")
    assert {r.s: r.c for r in vote.weighted_vote(d, ["s"], "c", "w").collect()} == {1: "Y", 2: "a"}


def test_reference_plan(spark):
    d = spark.createDataFrame([(i, i in (0, 4)) for i in range(6)], "i long, gt boolean").withColumn("g", F.lit(0))
    n = refplan.nearest_anchor(d, ["g"], "i", F.col("gt")).withColumn("ref", refplan.step_toward(F.col("i"), F.col("nearest")))
    assert {r.i: r.ref for r in n.where("not gt").collect()} == {1: 0, 2: 1, 3: 4, 5: 4}


def test_mode_and_relabel(spark):
    d = spark.createDataFrame([(0, 255, 0, 0), (0, 255, 0, 0), (0, 0, 0, 255), (0, 0, 0, 255)], "k int, r int, g int, b int")
    m = regions.mode_per_group(d, ["k"], ["r", "g", "b"]).first()
    assert (m.r, m.g, m.b, m.n) == (0, 0, 255, 2)
    p = spark.createDataFrame([(0, 5, 7), (0, 2, 3), (4, 0, 9), (1, 1, 0)], "y int, x int, label int")
    assert {r.label: r.new_label for r in regions.relabel_by_first_pixel(p, []).collect()} == {3: 1, 7: 2, 9: 3}


def test_codec(spark):
    r = one(spark, S.pack_rgb(F.lit(1), F.lit(2), F.lit(3)).alias("p"), S.quantize(F.lit(0.0), -0.02, 0.02, 255).alias("q"), S.quantize(F.lit(0.02), -0.02, 0.02, 255).alias("t"), S.trailing_int(F.lit("a1b")).alias("n"))
    assert r.p == 66051 and r.q == 127 and r.t == 254 and r.n is None
    names = spark.createDataFrame([("f10",), ("f9",), ("f2",)], "s string").orderBy(S.natural_key(F.col("s")))
    assert [r.s for r in names.collect()] == ["f2", "f9", "f10"]


def test_series(spark):
    d = spark.createDataFrame([(0, k, v) for k, v in enumerate((1.0, 2.0, 4.0))], "g int, o long, v double")
    assert [r.smooth for r in series.ema(d, ["g"], "o", "v", 0.5).orderBy("o").collect()] == [1.0, 1.5, 2.75]
    d = spark.createDataFrame([(0, k, float(k)) for k in range(1, 5)], "g int, o long, v double")
    assert [r.average for r in series.timer_average(d, ["g"], "o", "v", 2).orderBy("o").collect()] == [1.0, 1.5, 2.0, 4.0]


def test_components_both_ways(spark):
    grid = ["1100", "0101", "0011", "1000"]
    cells = [(x, y) for y, row in enumerate(grid) for x, c in enumerate(row) if c == "1"]
    d = spark.createDataFrame(cells, "x long, y long")
    sizes = lambda diagonal: sorted(r["count"] for r in regions.components(d, [], diagonal).select(F.explode(F.sequence("x0", "x1")), "component").groupBy("component").count().collect())
    assert sizes(False) == [1, 3, 3] and sizes(True) == [1, 6]
    mask = np.array([[c == "1" for c in row] for row in grid])
    assert kernels.label4(mask).tolist() == [[1, 1, 0, 0], [0, 1, 0, 2], [0, 0, 2, 2], [3, 0, 0, 0]]


def test_thinning(spark):
    d = spark.createDataFrame([(x, 0, v) for x, v in enumerate((7, 0, 0, 9))], "x long, y long, label long")
    assert [r.label for r in regions.thin_round(d, [], strict_border=False).orderBy("x").collect()] == [7, 7, 9, 9]
    assert [r.label for r in regions.thin_round(d, []).orderBy("x").collect()] == [7, 0, 9, 9]


def test_greedy_and_hamming(spark):
    d = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 0xFF00)], "id long, h long")
    pairs = dedup.hamming_pairs(d, "id", "h", 16, 3)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (1, 2), (0, 2)}
    assert {r.id: r.key for r in dedup.greedy_keys(d.select("id"), pairs.select("a", "b")).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_greedy_keys_of_copies_and_crowds(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    for bits, limit in ((16, 3), (20, 2)):  # by a scan of all hashes, and by rounds
        rows = [(int(i), int(h)) for i, h in zip(rng.permutation(3000), rng.integers(1 << 9, size=3000) << 4)]
        keys, want = [], {}
        for i, h in sorted(rows):
            want[i] = next((k for k, g in keys if (g ^ h).bit_count() < limit), i)
            if want[i] == i:
                keys.append((i, h))
        d = spark.createDataFrame(rows, "id long, h long")
        assert {r.id: r.key for r in dedup.greedy_hash_keys(d, "id", "h", bits, limit).collect()} == want
    # 40 nodes that all pair: one key, not a round for each.
    rounds, cut = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: rounds.append(0) or cut(df))
    d = spark.range(40)
    pairs = d.select(F.col("id").alias("a")).join(d.select(F.col("id").alias("b"))).where("a < b")
    assert {r.key for r in dedup.greedy_keys(d, pairs).collect()} == {0} and len(rounds) < 10
    # The query never pairs copies; no vector has no bits.
    monkeypatch.setattr(dedup, "hamming_pairs", None)
    vectors = [(k, [1.0 if k % 5 == 4 else -1.0] * 16) for k in range(400)] + [(400, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.key for r in catalogue.QUERIES["near_dup_greedy"](spark, str(tmp_path)).collect()}
    assert got == {k: 4 if k < 400 and k % 5 == 4 else 0 for k in range(401)}


def test_best_of_all_events(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(20, 25)), "ab"[int(rng.integers(2))], float(rng.integers(20 + k // 40))) for k in range(900)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for k, _, kind, _ in rows:
        best = max((v, i) for i, _, other, v in rows[: k + 1] if other == kind)
        want.add((kind, k, *best))
    assert {tuple(r) for r in catalogue.QUERIES["best_so_far"](spark, str(tmp_path)).collect()} == want


def test_smoothing_of_all_users(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(15, 30)), "a", float(rng.integers(100))) for k in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    last, want = {}, {}
    for k, user, _, v in rows:
        last[user] = want[user, k] = v if user not in last else last[user] * 0.6 + v * 0.4
    got = {(r.user_id, r.event_id): r.smooth for r in catalogue.QUERIES["ema_smooth"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 20)).astype(np.float32)
    x[30:, :16] = x[:30, :16]  # equal signs in the first 16 dimensions
    x[45:, 16:] *= 20
    label = [k // 6 for k in range(60)]  # ids below 10 have two of ten labels
    rows = [(k, label[k], x[k].tolist()) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    x = x.astype(float)
    means = np.stack([x[np.array(label) == k].mean(0) for k in range(10)])
    assert {r.vec_id: r.near_label for r in run("nearest_centroid")} == {k: int(((means - x[k]) ** 2).sum(1).argmin()) for k in range(60)}
    g = {(r.i, r.j): r.g for r in run("gram")}
    assert len(g) == 400 and all(abs(g[i, j] - (x[:, i] * x[:, j]).mean()) < 2e-6 for i, j in g)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sign = x[:, :16] > 0
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if (sign[a] != sign[b]).sum() < 3}
    alike = {(a, b) for a, b in near if unit[a] @ unit[b] >= 0.2}
    assert {(r.a, r.b) for r in run("near_dup_pairs_checked")} == alike < near


def test_kernels():
    free = np.ones((9, 9), bool)
    free[4, :] = False
    free[4, 4] = True  # a gap that a ball of radius 1 cannot pass
    fill = kernels.trapped_ball(free, (1,))
    assert fill[0, 4] != fill[8, 4] and (fill[~free] == 0).all() and (fill[free] > 0).all()
    a = (np.arange(400).reshape(20, 20) % 251).astype(np.uint8)
    assert abs(kernels.ssim_window(a, a) - 1) < 1e-9


def test_region_sizes_and_gaps(spark):
    d = spark.createDataFrame([(1, 4), (2, 1), (3, 10)], "k long, n long")
    assert sorted(r.k for r in regions.keep_large(d, "n", "mean").collect()) == [3]
    got = regions.count_with_gaps(spark.createDataFrame([(1,), (1,), (3,)], "v long"), "v", 0, 3)
    assert {r.v: r.n for r in got.collect()} == {0: 0, 1: 2, 2: 0, 3: 1}
