"""Transport with potentials, chains, spanning trees, running sums, blocks of pairs and warping in columns, each against
plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isogloss import schemas
from isogloss.kernels import dtw, linkage, simplex, transport
from isogloss.operators import ancestry, evaluate, featurize, pairs, running, spanning
from isogloss.plans import matrix_queries
from isogloss.sources import files, readers, writers


@pytest.mark.parametrize("kind", ["random", "equal masses", "small whole costs", "empty masses"])
def test_simplex_proves_its_flow(kind):
    rng = np.random.default_rng(len(kind))
    for m, n in [(1, 1), (1, 5), (4, 1), (3, 2), (6, 6), (12, 30), (40, 40)]:
        cost = rng.integers(0, 4, (m, n)).astype(float) if kind == "small whole costs" else rng.random((m, n))
        p, q = (np.full(m, 1 / m), np.full(n, 1 / n)) if kind == "equal masses" else (rng.dirichlet(np.ones(m)), rng.dirichlet(np.ones(n)))
        if kind == "empty masses" and m > 2:
            p[:2] = 0
            p /= p.sum()
        q[-1] += p.sum() - q.sum()
        f, u, v = simplex.solve(p, q, cost)
        assert (f >= 0).all() and f.sum(1) == pytest.approx(p, abs=1e-12) and f.sum(0) == pytest.approx(q, abs=1e-12)
        assert (u[:, None] + v[None] <= cost + 1e-9).all() and (f * cost).sum() == pytest.approx(p @ u + q @ v)
        assert (np.count_nonzero(f) <= m + n - 1)


def test_rest_of_unequal_masses_stays_where_that_is_cheapest():
    p, q = np.array([0.5, 0.50004]), np.array([0.3, 0.7])
    f, u, v = transport.optimum(p, q, np.array([[1.0, 2.0], [3.0, 9.0]]))
    assert f.sum(0) == pytest.approx(q) and f.sum() == pytest.approx(1.0) and f.sum(1)[1] == pytest.approx(0.5)


def test_certificates_tell_good_plans_from_bad(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, rng.normal(size=2).tolist()) for g in range(5) for i in range(int(rng.integers(1, 9)))]
    other = [(g, 100 + i, rng.normal(size=2).tolist()) for g in range(5) for i in range(int(rng.integers(1, 9)))]
    left, right = (spark.createDataFrame(r, "g int, name long, point array<double>") for r in (rows, other))
    plans = evaluate.transport_plans(left, right, ["g"])
    found = {r.g: r for r in evaluate.certificates(plans, left, right, ["g"]).collect()}
    for g in range(5):
        x, y = (np.array([p for k, _, p in side if k == g]) for side in (rows, other))
        cost = transport.ground_costs(x, y)
        assert found[g].cost == pytest.approx(transport.emd(np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y)), cost))
        assert found[g].short == pytest.approx(0, abs=1e-12) and found[g].over < 1e-9 and found[g].gap == pytest.approx(0, abs=1e-9)
    worse = plans.withColumn("value", F.when((F.col("kind") == "left") & (F.col("g") == 2), F.col("value") + 1).when((F.col("kind") == "flow") & (F.col("g") == 3), F.col("value") * 2).otherwise(F.col("value")))
    told = {r.g: r for r in evaluate.certificates(worse, left, right, ["g"]).collect()}
    assert told[2].over > 0.9 and told[3].short > 0 and told[3].gap > 0 and told[1] == found[1]


def test_certificates_join_in_steps(spark):
    """What is left of the plan joins rows of groups only; a group without a flow costs nothing."""
    rows = [(g, i, [float(i), float(g)]) for g in range(3) for i in range(4)]
    left, right = (spark.createDataFrame(rows, "g int, name long, point array<double>") for _ in range(2))
    plans = evaluate.transport_plans(left, right.withColumn("point", F.reverse("point")), ["g"])
    found = evaluate.certificates(plans.filter("kind <> 'flow' or g <> 1"), left, right, ["g"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "point" not in plan
    assert {r.g: (r.cost, r.short) for r in found.collect()}[1] == (0.0, 0.25)


def test_costs_on_a_circle(spark):
    rng = np.random.default_rng(8)
    left = [("a", int(rng.integers(0, 2)), float(v)) for v in rng.integers(0, 28, 20) / 28] + [(None, 0, 0.9)]
    right = [(int(rng.integers(0, 3)), float(rng.random())) for _ in range(17)] + [(0, 0.0)]
    predicted, gold = spark.createDataFrame(left, "model string, label int, x double"), spark.createDataFrame(right, "label int, x double")
    got = {(r.model, r.i, r.j): r.cost for r in evaluate.line_costs(predicted, gold, ["model"], circle=True).collect()}
    for m, i in {(m, i) for m, i, _ in left}:
        for j in range(3):
            x, y = np.array([v for n, k, v in left if (n, k) == (m, i)]), np.array([v for k, v in right if k == j])
            cost = transport.ground_costs(x[:, None], y[:, None], "circle")
            assert got.pop((m, i, j)) == pytest.approx(transport.emd(np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y)), cost))
    assert not got
    assert evaluate.line_costs(predicted.filter("false"), gold, ["model"]).count() == 0


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "l"]])
def test_running_sums(spark, keys):
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else rng.choice("xyz"), i % 2, o, None if i % 7 == 0 else rng.randint(-5, 9)) for i, o in enumerate(rng.sample(range(5000), 900))]
    df = spark.createDataFrame(rows, "k string, l int, o long, v int").repartition(7)
    got = running.running_sums(df, keys, ["o"], {"s": F.col("v"), "n": F.lit(1)}, following="next")
    want = []
    for r in rows:
        own = sorted((x for x in rows if all(x["kl".index(c)] == r["kl".index(c)] for c in keys)), key=lambda x: x[2])
        upto = [x for x in own if x[2] <= r[2]]
        want.append((*r, sum(x[3] or 0 for x in upto), len(upto), next((x[2] for x in own if x[2] > r[2]), None)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert running.running_sums(df.filter("false"), keys, ["o"], {"s": F.col("v")}).count() == 0
    assert {r.ord for r in running.numbered(df, [], ["o"]).collect()} == set(range(900))
    # Windows are over ranges of rows, and over ranges' totals, never over the rows of a group.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition") and all("__range" in line for line in plan.split("\n") if line.strip(" :+-").startswith("Window "))


def recordings(spark):
    rng = np.random.default_rng(1)
    rows = [("m", 1, f"v{k % 4}" if k % 9 else None, f"w{k % 3}", f"r{k}", rng.normal(size=(int(rng.integers(1, 5)), 3)).tolist()) for k in range(40)]
    rows += [("m", 1, "v0", "w0", "empty", []), ("m", 1, "v1", "w0", "null", None), ("m", 2, "v1", "w0", "other", [[1.0, 2.0, 3.0]])]
    return rows, spark.createDataFrame(rows, "model string, layer int, village string, word string, recording string, frames array<array<double>>").repartition(3)


@pytest.mark.parametrize("blocks", [1, 2, 5])
@pytest.mark.parametrize("symmetric", [True, False])
def test_pairs_inside_blocks(spark, blocks, symmetric):
    rows, df = recordings(spark)
    got = sorted(((r.layer, r.a, r.b, r.word, None if r.distance is None else round(r.distance, 9)) for r in pairs.sequence_distances(df, blocks=blocks, symmetric=symmetric).collect()), key=repr)
    want = []
    for x, y in itertools.product(rows, rows):
        if x[1] == y[1] and x[3] == y[3] and (not symmetric or (x[2] is not None and y[2] is not None and x[2] <= y[2])):
            d = dtw.normalized_distance(np.array(x[5]), np.array(y[5])) if x[5] and y[5] else None
            want.append((x[1], x[2], y[2], x[3], None if d is None else round(d, 9)))
    assert got == sorted(want, key=repr)


def test_recordings_are_sent_once_for_each_block(spark):
    """No row of the plan holds two recordings, and no join makes one."""
    _, df = recordings(spark)
    found = pairs.sequence_distances(df, blocks=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "frames" in plan
    sent = found._jdf.queryExecution().optimizedPlan().children().head()
    assert sent.output().mkString(",").count("frames") == 1


def test_ground_cost_is_dealt_into_blocks(spark, tmp_path, monkeypatch):
    """No sort and no broadcast; blocks follow the largest label, and rows are all pairs of a label."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2).tolist(), 0 if i < 30 else 1 if i < 40 else None) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(a, b) for a, _, x in rows for b, _, y in rows if x is not None and x == y}
    for size, blocks in ((8, 4), (1000, 1)):
        monkeypatch.setattr(pairs, "POINT_ROWS", size)
        monkeypatch.setattr(pairs, "TASK_PAIRS", 100 if size == 8 else 1 << 20)
        assert pairs.point_blocks(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), ["label"]) == (blocks, 11 if size == 8 else 1)
        made = matrix_queries.ground_cost(spark, str(tmp_path))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan and "Broadcast" not in plan
        assert made.rdd.getNumPartitions() == (11 if size == 8 else 1)
        found = [(r.a, r.b) for r in made.collect()]
        assert len(found) == len(want) and set(found) == want


def test_all_distances_of_odd_points(spark, monkeypatch):
    """Equal points, equal and missing ids, places that are missing, no number or without end, in blocks and bands."""
    rng = np.random.default_rng(7)
    odd = [(None, 0.1, 0.2), (3, 0.1, 0.2), (3, 0.1, 0.2), (90, None, 0.1), (91, None, None), (92, math.nan, 0.1), (93, math.inf, 0.1), (94, math.inf, -math.inf), (95, 1e200, 0.0), (96, -5.0, 7.0)]
    rows = [(g, i, x, y) for g in ("p", None) for i, x, y in odd] + [("q", i, *(rng.normal(size=2) * 0.3).tolist()) for i in range(50)] + [("p", i, 0.5, 0.5) for i in range(20)] + [("r", 1, 0.0, 0.0)]
    monkeypatch.setattr(pairs, "POINT_ROWS", 4)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 300)
    found = pairs.point_distances(spark.createDataFrame(rows, "label string, id long, x double, y double"), ["label"])
    want = Counter()
    with np.errstate(all="ignore"):
        for g, a, x, y in rows:
            for h, b, v, w in rows:
                if g is not None and g == h:
                    far = None if None in (x, y, v, w) else float(np.rint(np.sqrt((x - v) * (x - v) + np.float64(y - w) * (y - w)) * 1e6) / 1e6)
                    want[a, b, str(far)] += 1
    assert Counter((r.a, r.b, str(r.cost)) for r in found.collect()) == want
    tasks = found.filter("cost < 1.9").groupBy(F.spark_partition_id()).agg(F.countDistinct(F.floor(F.col("cost") * 1e6 / pairs.BAND_VALUES)).alias("n"))
    assert tasks.count() > 5 and tasks.agg(F.avg("n")).first()[0] < 8


def test_all_distances_take_few_bytes(spark, tmp_path):
    """Pairs come so that ids repeat and distances follow once more as they are turned round; dealt by hashes of ids they took 2.4 bytes each."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.random(2) * 0.04).tolist(), 0) for i in range(1536)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    matrix_queries.ground_cost(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    made = spark.read.parquet(f"{tmp_path}/out")
    assert made.count() == made.distinct().count() == 1536**2
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2 * 1536**2


def test_warping_in_columns(spark):
    rows, df = recordings(spark)
    named = {r[4]: r[5] for r in rows}
    met = df.filter("layer = 1").select("recording", "frames").crossJoin(df.filter("recording in ('r1', 'r2', 'empty', 'null')").select(F.col("recording").alias("s"), F.col("frames").alias("g")))
    found = met.select("recording", "s", pairs.warping(F.col("frames"), F.col("g")).alias("d"))
    assert "Python" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        x, y = named[r.recording], named[r.s]
        assert r.d == (pytest.approx(dtw.normalized_distance(np.array(x), np.array(y))) if x and y else None)


@pytest.mark.parametrize("n, m", [(1, 1), (1, 6), (6, 1), (5, 8), (8, 5), (30, 41)])
def test_warping_by_diagonals(spark, n, m):
    rng = np.random.default_rng(n * m)
    x, y = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<array<double>>, y array<array<double>>")
    assert df.select(pairs.warping(F.col("x"), F.col("y"))).first()[0] == pytest.approx(dtw.normalized_distance(x, y))


@pytest.mark.parametrize("longest", [0, 2, 1000])
def test_words_of_long_recordings_go_to_the_kernel(spark, longest, monkeypatch):
    """Some words, all or none; the rows are those of sequence_distances."""
    monkeypatch.setattr(pairs, "COLUMN_FRAMES", longest)
    _, df = recordings(spark)
    some = df.filter("layer = 1 and village is not null and word is not null")

    def rows(made):
        return sorted(((r.a, r.b, r.word, None if r.distance is None else round(r.distance, 9)) for r in made.collect()), key=repr)

    assert rows(pairs.column_distances(some)) == rows(pairs.sequence_distances(some)) != []


def plain_merges(d, method, squared):
    w = np.tril(d, -1) + np.tril(d, -1).T
    root = squared and method in ("uc", "wc", "wm")
    w = w * w if root else w
    np.fill_diagonal(w, np.inf)
    size, out = np.ones(len(d), int), []
    for _ in range(len(d) - 1):
        a, b = divmod(int(np.argmin(w)), len(d))
        height, live = float(w[a, b]), np.isfinite(w[a]) & (np.arange(len(d)) != b)
        w[a, live] = w[live, a] = linkage._update(method, w[a, live], w[b, live], height, size[a], size[b], size[live])
        w[b, :] = w[:, b] = np.inf
        size[a] += size[b]
        out.append((a, b, np.sqrt(max(0.0, height)) if root else height, int(size[a])))
    return out


@pytest.mark.parametrize("method", linkage.METHODS)
def test_merges_are_those_of_plain_agglomeration(method):
    rng = np.random.default_rng(6)
    for trial in range(60):
        x = rng.normal(size=(int(rng.integers(1, 22)), 2))
        d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        d = np.round(d, 1) if trial % 3 == 0 else d
        for squared in (False, True):
            got, want = linkage.merges(d, method, squared), plain_merges(d, method, squared)
            assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
            assert [h for _, _, h, _ in got] == pytest.approx([h for _, _, h, _ in want])
        if method in linkage.REDUCIBLE and trial % 3 and len(x) > 1:
            w = d.copy()
            np.fill_diagonal(w, np.inf)
            assert linkage._by_chains(w, method) is not None


def test_spanning_trees_give_single_linkage(spark):
    rng = np.random.default_rng(2)
    cells, want = [], []
    for m, n in (("p", 1), ("q", 2), ("r", 37), ("s", 64)):
        x = rng.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        names = [f"n{k:03}" for k in range(n)]
        cells += [(m, names[i], names[j], float(d[i, j])) for i in range(n) for j in range(n)]
        want += [(m, s, names[a], names[b], pytest.approx(h), k) for s, (a, b, h, k) in enumerate(linkage.merges(d, "sl"))]
    df = spark.createDataFrame(cells, "model string, row_loc string, col_loc string, dist double").repartition(4)
    tree = spanning.spanning_edges(df, ["model"])
    assert sorted(map(tuple, spanning.single_linkage(tree, ["model"]).collect())) == want
    assert spanning.spanning_edges(df.filter("false"), ["model"]).count() == 0


@pytest.mark.parametrize("method", linkage.METHODS)
def test_ancestors_give_cophenetic_distances(spark, method):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for m, n in (("p", 2), ("q", 3), ("r", 17), ("chain", 40)):
        x = np.cumsum(np.arange(n) * 1.0)[:, None] if m == "chain" else rng.normal(size=(n, 2))
        tree = linkage.merges(np.sqrt(((x[:, None] - x) ** 2).sum(2)), method)
        names = [f"n{k:03}" for k in range(n)]
        rows += [(m, s, names[a], names[b], h, k) for s, (a, b, h, k) in enumerate(tree)]
        coph = linkage.cophenetic(n, tree)
        want |= {(m, names[i], names[j]): coph[i, j] for i in range(n) for j in range(n)}
    merges = spark.createDataFrame(rows, "model string, step int, a string, b string, height double, size int").repartition(3)
    asked = spark.createDataFrame([(*k, 7) for k in want] + [("q", "n000", "nobody", 7), ("none", "n000", "n001", 7)], "model string, row_loc string, col_loc string, digit_of_theirs int")
    got = {(r.model, r.row_loc, r.col_loc): r.coph for r in ancestry.cophenetic_heights(asked, merges, ["model"]).collect()}
    assert got.pop(("q", "n000", "nobody")) is None and got.pop(("none", "n000", "n001")) is None
    assert got == pytest.approx(want)
    places = [(r.model, r.pos) for r in ancestry.leaf_positions(merges, ["model"]).collect()]
    assert sorted(places) == sorted((m, k) for m, n in (("p", 2), ("q", 3), ("r", 17), ("chain", 40)) for k in range(n))
    plan = ancestry.cophenetic_heights(asked, merges, ["model"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_ancestors_of_no_trees(spark):
    merges = spark.createDataFrame([], "model string, step int, a string, b string, height double, size int")
    asked = spark.createDataFrame([("m", "a", "b")], "model string, row_loc string, col_loc string")
    assert ancestry.cophenetic_heights(asked, merges, ["model"]).first().coph is None
    assert ancestry.leaf_positions(merges, ["model"]).count() == 0


def triangle(names, rng):
    cells = [round(float(v), 3) for v in rng.random(len(names) * (len(names) - 1) // 2)]
    pairs = [(names[i], names[j]) for i in range(len(names)) for j in range(i)]
    return [str(len(names)), *names, *map(str, cells)], dict(zip(pairs, cells, strict=True))


def test_triangular_files_are_read_in_splits(spark, tmp_path):
    rng = np.random.default_rng(9)
    long, want = triangle([f"place {k}" for k in range(150)], rng)
    (tmp_path / "a.dif").write_text("\r\n".join(long))
    small, other = triangle(["x", "y", "z"], rng)
    (tmp_path / "b.dif").write_text("\n\n".join(small) + "\n")
    (tmp_path / "c.dif").write_text("1\nalone\n")
    (tmp_path / "d.dif").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert spark.read.text(str(tmp_path / "a.dif")).rdd.getNumPartitions() > 20
        rows = readers.dif(spark, str(tmp_path / "*.dif")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, cells in (("a", want), ("b", other), ("c", {}), ("d", {})):
        own = [r for r in rows if r.path.endswith(f"{name}.dif")]
        assert {(r.row_loc, r.col_loc): r.dist for r in own} == cells and len(own) == len(cells)


@pytest.mark.parametrize("text", ["3\na\nb\nc\n1\n2", "3\na\nb\nc\n1\n2\n3\n4", "many\na", "2\na"])
def test_triangular_files_of_wrong_length(spark, tmp_path, text):
    (tmp_path / "x.dif").write_text(text)
    with pytest.raises(Exception, match="not as many lines"):
        readers.dif(spark, str(tmp_path / "x.dif")).collect()


def test_many_matrices_in_one_write(spark, tmp_path):
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "d"]
    cells = [(m, n, x, y, round(float(rng.random()), 3)) for m in "pq" for n in (1, 2, 10) for x in names for y in names]
    df = spark.createDataFrame(cells, "model string, layer int, row_loc string, col_loc string, dist double").repartition(5)
    ords = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "locality string, ord int")
    writers.dif(df, ords, str(tmp_path / "dif"), ["model", "layer"])
    writers.matrix_csv(df, names, str(tmp_path / "csv"), ["model", "layer"])
    for kind, suffix in (("dif", "txt"), ("csv", "csv")):
        assert len(list((tmp_path / kind).glob(f"model=*/layer=*/part-*.{suffix}"))) == 6
    back = {(*r.path.split("/")[-3:-1], r.row_loc, r.col_loc): r.dist for r in readers.dif(spark, str(tmp_path / "dif")).collect()}
    assert back == {(f"model={m}", f"layer={n}", x, y): d for m, n, x, y, d in cells if x > y}
    one = readers.matrix_csv(spark, str(tmp_path / "csv" / "model=q" / "layer=10"))
    assert {(r.row_loc, r.col_loc): r.dist for r in one.collect()} == {(x, y): d for m, n, x, y, d in cells if (m, n) == ("q", 10)}


def test_tasks_write_files(spark, tmp_path):
    made = spark.createDataFrame([(f"d{k % 3}/f{k}.bin", bytes([k] * k)) for k in range(20)], "path string, content binary").repartition(6)
    files.write_files(made, str(tmp_path))
    files.write_files(made.filter("path like 'd1/%'").withColumn("content", F.lit(b"new")), f"file://{tmp_path}/")
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file() and p.suffix == ".bin"}
    assert found == {f"d{k % 3}/f{k}.bin": b"new" if k % 3 == 1 else bytes([k] * k) for k in range(20)}
    assert not [p for p in tmp_path.rglob("_temporary*")]
    with pytest.raises(Exception, match="not below the folder"):
        files.write_files(made.withColumn("path", F.when(F.col("path") == "d2/f5.bin", "../out.bin").otherwise(F.concat(F.lit("bad/"), "path"))), str(tmp_path))
    assert not (tmp_path / "bad").exists() and not (tmp_path.parent / "out.bin").exists()


def test_batches_give_the_frames_of_single_waveforms(spark):
    rng = np.random.default_rng(3)
    lengths = [0, 1, 399, 400, 401, 719, 720, 3000, 3100, 3700, 9000, 9000]
    rows = [(f"p{i}", f"v{i % 3}", f"w{i}", 16000, rng.normal(size=n).astype(np.float32).tolist()) for i, n in enumerate(lengths)]
    waves = spark.createDataFrame(rows, schemas.WAVEFORM).repartition(2)
    single = featurize.featurize(waves, "m", lambda _: featurize.spectral_featurizer((1, 3)))
    batched = featurize.featurize_batches(waves, "m", lambda _: featurize.spectral_batches((1, 3)), rows=4)
    assert [(f.name, f.dataType) for f in batched.schema] == [(f.name, f.dataType) for f in single.schema]
    want, got = ({(r.recording, r.layer, r.village, r.word, r.model): np.array(r.frames) for r in d.collect()} for d in (single, batched))
    assert got.keys() == want.keys() and len(got) == 2 * len(lengths)
    for key, frames in want.items():
        assert got[key].shape == frames.shape and np.allclose(got[key], frames, atol=1e-6)
    silent = featurize.featurize_batches(waves.withColumn("waveform", F.lit(None).cast("array<float>")), "m", lambda _: featurize.spectral_batches())
    assert {len(r.frames) for r in silent.collect()} == {1}
    assert featurize.featurize_batches(waves.limit(0), "m", lambda _: featurize.spectral_batches()).count() == 0
    assert [b.tolist() for b in featurize.batches_of_lengths(np.array([100, 0, 90, 0, 126, 99]), 3)] == [[1, 3], [2, 5, 0], [4]]


def test_models_without_layers_or_frames(spark):
    waves = spark.createDataFrame([("p", "v", "w", 16000, [1.0, 2.0])], schemas.WAVEFORM)
    assert featurize.featurize_batches(waves, "m", lambda _: lambda x, n: []).count() == 0
    none = featurize.featurize_batches(waves, "m", lambda _: lambda x, n: [(5, np.zeros((len(x), 0, 3)), np.zeros(len(x), int))])
    assert [(r.layer, r.frames) for r in none.collect()] == [(5, [])]
