import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from isogloss import dims, session
from isogloss.functions import natural_key, round_half_even
from isogloss.kernels import transport
from isogloss.operators import clustering, evaluate, featurize, lookup, matrix, pairs, select
from isogloss.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_dimensions(spark):
    names = dims.renames()
    assert len(names) == 124 and names["AALTEN"] == "Aalten Gl" and names["DEN-BRIEL"] == "Brielle ZH"
    table = dims.locality_table(spark)
    assert table.count() == 108 and table.filter("evaluated").count() == 106
    ordered = [r[0] for r in table.orderBy("ord").collect()]
    assert ordered == sorted(ordered) and ordered.index("IJmuiden NH") < ordered.index("Ingen Gl")
    assert dims.method_table(spark).count() == 7 and dims.model_table(spark).count() == 3


def test_rounding_ties(spark):
    df = spark.createDataFrame([(0.285,), (0.125,), (-0.125,), (2.5,), (1.005,)], "x double").select("x", round_half_even(F.col("x"), 2).alias("y"))
    assert all(y == round(float(np.round(x, 2)), 10) for x, y in df.collect())


def test_natural_order(spark):
    df = spark.createDataFrame([("layer-10",), ("layer-2",), ("LD",)], "l string")
    assert [r[0] for r in df.orderBy(*natural_key(F.col("l"))).collect()] == ["LD", "layer-2", "layer-10"]


def test_lookups(spark):
    df, dim = spark.createDataFrame([("a",), ("z",)], "k string"), spark.createDataFrame([("a", "A")], "key string, v string")
    assert rows(lookup.lookup_or_keep(df, dim, "k", "key", "v", "out")) == [("a", "A"), ("z", "z")]
    with pytest.raises(Exception, match="no entry for z"):
        lookup.lookup_strict(df, dim, "k", "key", "v", "out").collect()


def frames(spark):
    data = [("m", 1, "A", "w", "A1", [[0.0], [1.0]]), ("m", 1, "A", "w", "A2", [[2.0]]), ("m", 1, "B", "w", "B1", [[1.0]]), ("m", 1, "C", "other", "C1", [[1.0]])]
    return spark.createDataFrame(data, "model string, layer int, village string, word string, recording string, frames array<array<float>>")


@pytest.mark.parametrize("blocks", [1, 3])
def test_locality_distances(spark, blocks):
    d = pairs.locality_distances(frames(spark), blocks=blocks)
    got = {(r.row_loc, r.col_loc): (r.dist, r.n_pairs) for r in d.collect()}
    # Several takes: the diagonal is the mean over all ordered pairs of a village's own recordings.
    assert got[("A", "A")][1] == 4 and got[("A", "A")][0] > 0
    assert got[("A", "B")] == got[("B", "A")] and got[("A", "B")][1] == 2
    assert ("A", "C") not in got
    labels = spark.createDataFrame([("A",), ("B",), ("C",)], "locality string")
    whole = matrix.scaffold(d, labels)
    assert whole.count() == 9 and whole.filter("dist is null").count() == 4
    with pytest.raises(Exception, match="missing"):
        matrix.missing_is_error(whole).collect()


def test_plan_of_pairs_joins_by_word_without_a_nested_loop(spark):
    plan = pairs.locality_distances(frames(spark))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def square(spark, n=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    d = np.round(np.sqrt(((x[:, None] - x) ** 2).sum(2)), 4)
    names = [chr(65 + i) for i in range(n)]
    cells = [("m", 1, a, b, float(d[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(cells, "model string, layer int, row_loc string, col_loc string, dist double"), names


def test_matrix_round_trips(spark, tmp_path):
    cells, names = square(spark)
    plain = cells.select("row_loc", "col_loc", "dist")
    assert rows(matrix.long(matrix.wide(plain, names)).select("row_loc", "col_loc", "dist")) == rows(plain)
    labels = spark.createDataFrame(list(zip(names, range(6), strict=True)), "locality string, ord int")
    low = matrix.lower_triangle(plain, labels)
    assert low.count() == 15
    assert rows(matrix.full(low, labels).select("row_loc", "col_loc", "dist")) == rows(plain)
    assert matrix.without(plain, ["A", "C"]).count() == 16
    assert matrix.without(plain, []).count() == 36
    with pytest.raises(Exception, match="no such label: Z"):
        matrix.without(plain, ["A", "Z"]).count()
    writers.matrix_csv(plain, names, str(tmp_path / "csv"))
    assert rows(readers.matrix_csv(spark, str(tmp_path / "csv")).select("row_loc", "col_loc", "dist")) == rows(plain)
    writers.dif(plain, labels, str(tmp_path / "dif"))
    text = next((tmp_path / "dif").glob("part*")).read_text().split("\n")
    assert text[0] == "6" and text[1:7] == names and len(text) == 1 + 6 + 15 + 1
    assert rows(readers.dif(spark, str(tmp_path / "dif" / "part*")).select("row_loc", "col_loc", "dist")) == rows(low.select("row_loc", "col_loc", "dist"))
    writers.cophenetic_tab(plain.withColumnRenamed("dist", "coph"), names, str(tmp_path / "tab"))
    assert rows(readers.cophenetic_tab(spark, str(tmp_path / "tab"), names).select("row_loc", "col_loc", "coph")) == rows(plain)


def test_cells_that_are_not_numbers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("x,A,B,C\nA,0,NA,nan\nB,,0,N/A\n")
    assert [r.dist for r in readers.matrix_csv(spark, str(tmp_path / "m.csv")).orderBy("row_loc", "col_loc").collect()] == [0.0, None, None, None, 0.0, None]
    (tmp_path / "bad.csv").write_text("x,A\nA,0.1.2\n")
    with pytest.raises(Exception, match="not a number: 0.1.2"):
        readers.matrix_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_costs_on_a_line(spark):
    rng = np.random.default_rng(2)
    left = [(m, int(rng.integers(0, 3)), float(rng.integers(0, 9))) for m in ("a", "b", "b", "a", None) for _ in range(8)]
    right = [(int(rng.integers(0, 2)), float(rng.normal())) for _ in range(15)]
    predicted, gold = spark.createDataFrame(left, "model string, label int, x double"), spark.createDataFrame(right, "label int, x double")
    got = {(r.model, r.i, r.j): r.cost for r in evaluate.line_costs(predicted, gold, ["model"]).collect()}
    for m, i in {(m, i) for m, i, _ in left}:
        for j in (0, 1):
            x, y = [v for n, k, v in left if (n, k) == (m, i)], [v for k, v in right if k == j]
            assert got[(m, i, j)] == pytest.approx(transport.emd_line(np.array(x), np.array(y)))
    assert len(got) == 2 * len({(m, i) for m, i, _ in left})
    plan = evaluate.line_costs(predicted, gold, ["model"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_blocks_follow_counts(spark, monkeypatch):
    assert pairs.blocks_for(frames(spark)) == 1
    monkeypatch.setattr(pairs, "PAIR_ROWS", 1)
    assert pairs.blocks_for(frames(spark)) == 3
    words = {(r.row_loc, r.col_loc): r.words for r in pairs.locality_distances(frames(spark), words=True).collect()}
    assert words[("A", "B")] == words[("B", "A")] == ["w"] and words[("C", "C")] == ["other"]


def test_featurizer_modes():
    states = [np.full((2, 3), float(k), np.float32) for k in range(4)]
    parts = {"encode": lambda w, depth: states if depth < 0 else states[: depth + 1], "convolve": lambda w: np.ones((2, 5), np.float32), "project": lambda f: f[:, :3] * 2}
    modes = {layer: featurize.featurizer_of(**parts, layer=layer)(np.zeros(10)) for layer in (None, 0, 2, -1, -2)}
    assert [k for k, _ in modes[None]] == [0, 1, 2, 3] and modes[2][0][0] == 2 and modes[2][0][1][0, 0] == 2 and modes[0][0][1][0, 0] == 0
    assert modes[-1][0][1].shape == (2, 3) and modes[-2][0][1].shape == (2, 5)


def test_result_files(spark):
    paths = ["a/m/layer-3/x.dif.ga.initclust.n4", "a/other/layer-3/x.dif.ga.n4.x", "a/data-l04-106/layer-1/x.ga.initclust.n4", "a/transcription-distances/ld/ld.ga.initclust.n4", "a/b/c/d.ga.e.f"]
    got = readers.result_files(spark.createDataFrame([(p,) for p in paths], "path string"), models=["m", "data-l04-106"], method="ga")
    assert rows(got.select("kind", "model", "layer")) == [("layer", "ld", "layer-1"), ("layer", "m", "layer-3"), ("ld", "transcription-distances", "ld")]


def test_intermediate_tables_need_a_shared_folder(spark):
    class Elsewhere:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)


def test_clustering_and_partitions(spark, tmp_path):
    cells, names = square(spark)
    made = clustering.cluster(cells, 3)
    writers.merges(clustering.merge_rows(made).filter("method = 'ga'"), str(tmp_path / "merges"))
    lines = [line.split("\t") for line in next((tmp_path / "merges").glob("part*")).read_text().splitlines()]
    assert [int(x[0]) for x in lines] == list(range(5)) and lines[-1][2:4] == ["6", "A"]
    assert clustering.merge_rows(made).count() == 7 * 5
    assert clustering.cophenetic_rows(made).count() == 7 * 36
    part = clustering.partition_rows(made)
    assert [r[1] for r in rows(part.groupBy("method").agg(F.countDistinct("label")))] == [3] * 7
    one = part.filter("method = 'ga'").select("locality", "label")
    writers.partition(one, str(tmp_path / "n4"))
    back = readers.partitions(spark, str(tmp_path / "n4" / "part*"))
    assert rows(back.select("locality", "label")) == rows(one)
    with pytest.raises(Exception, match="missing"):
        clustering.cluster(cells.withColumn("dist", F.when(F.col("row_loc") != "C", F.col("dist")))).collect()


@pytest.mark.parametrize(("text", "expected"), [("a\nb\n\nc\n", [("a", 0), ("b", 0), ("c", 1)]), ("a\nb", [("a", 0), ("b", 0)]), ("a\n\n\nb\n\n", [("a", 0), ("b", 2)])])
def test_partition_files(spark, tmp_path, text, expected):
    (tmp_path / "p.n4").write_text(text)
    assert rows(readers.partitions(spark, str(tmp_path / "p.n4")).select("locality", "label")) == expected


def test_best_rows(spark):
    data = [("a", 1, 0.5), ("b", 1, 0.5), ("c", 1, float("nan")), ("d", 1, None), ("e", 2, float("nan"))]
    df = select.best_with_ties(spark.createDataFrame(data, "n string, g int, r double"), ["g"], "r")
    assert [r.n for r in df.filter("is_best").orderBy("n").collect()] == ["a", "b"]
    assert [r.max_r for r in select.marked(df).orderBy("n").collect()] == ["X", "X", "", "", ""]
    assert select.first_best(df, ["g"], ["n"]).count() == 2


def test_pearson_without_variance_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (2, None, 9.0)], "g int, a double, b double")
    assert [(g, None if r is None else round(r, 9)) for g, r in rows(select.pearson(df, ["g"], "a", "b"))] == [(1, None), (2, 1.0)]


def test_evaluation(spark):
    where = spark.createDataFrame([("p", [0.0, 0.0]), ("q", [0.0, 1.0]), ("r", [5.0, 5.0])], "locality string, point array<double>")
    gold = spark.createDataFrame([("p", 0), ("q", 0), ("r", 1)], "locality string, label int")
    both = spark.createDataFrame([("m", "p", 4), ("m", "q", 4), ("m", "r", 2), ("n", "p", 0), ("n", "q", 1), ("n", "r", 1)], "model string, locality string, label int")
    got = dict(rows(evaluate.cdistances(both, gold, where, ["model"])))
    assert got["m"] == pytest.approx(0) and 0 < got["n"] <= 1
    with pytest.raises(Exception, match="match"):
        evaluate.cdistances(both.filter("locality <> 'r'"), gold, where, ["model"]).collect()
    weights = evaluate.cluster_weights(gold, [])
    assert [(r.label, r.size) for r in weights.orderBy("label").collect()] == [(0, 2), (1, 1)]


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "gold.csv").write_bytes('﻿locality,label\r\n"Aalten Gl",0\r\n"Arum Fr",2'.encode())
    assert rows(readers.gold(spark, str(tmp_path / "gold.csv"))) == [("Aalten Gl", 0), ("Arum Fr", 2)]
    (tmp_path / "c.csv").write_text("Aalten Gl,6.58333,51.9333")
    assert rows(evaluate.points_of(readers.coordinates(spark, str(tmp_path / "c.csv")))) == [("Aalten Gl", [51.9333, 6.58333])]


def wav(samples, rate=16_000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}h", *samples))
    return out.getvalue()


def test_recordings_to_distances(spark, tmp_path):
    rng = np.random.default_rng(0)
    for village in ("AALTEN", "ARUM"):
        for word in ("een", "twee"):
            (tmp_path / f"{village.lower()}_{word}.wav").write_bytes(wav(rng.integers(-9000, 9000, 3000).tolist()))
    waves = readers.waveforms(readers.recordings(spark, str(tmp_path)))
    made = featurize.featurize(waves, "some-model", lambda _: featurize.spectral_featurizer((1, 2)))
    named = lookup.lookup_strict(made.withColumnRenamed("village", "key"), dims.rename_table(spark), "key", "village_key", "locality", "village")
    writers.features(named.select("model", "layer", "village", "word", "recording", "frames"), str(tmp_path / "out"))
    d = pairs.locality_distances(readers.features(spark, str(tmp_path / "out")))
    got = {(r.layer, r.row_loc, r.col_loc): r.dist for r in d.collect()}
    assert len(got) == 8 and got[(1, "Aalten Gl", "Aalten Gl")] == 0 and got[(1, "Aalten Gl", "Arum Fr")] > 0
    assert featurize.resolve_model("x") == "x" and featurize.resolve_model("wav2vec2-large-960h") == "facebook/wav2vec2-large-960h"
    (tmp_path / "bad").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.recordings(spark, str(tmp_path / "bad"))
    (tmp_path / "bad" / "A_b.wav").write_bytes(wav([1, 2], 8000))
    with pytest.raises(Exception, match="8000 samples"):
        readers.waveforms(readers.recordings(spark, str(tmp_path / "bad"))).collect()


def test_npy_features(spark, tmp_path):
    folder = tmp_path / "m" / "layer-3" / "AALTEN_een"
    folder.mkdir(parents=True)
    np.save(folder / "layer-03.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    r = readers.npy_features(spark, str(tmp_path / "m" / "layer-3" / "*")).first()
    assert (r.model, r.layer, r.village_key, r.word, len(r.frames)) == ("m", 3, "AALTEN", "een", 3)


def test_npy_features_round_trip(spark, tmp_path):
    made = frames(spark).withColumn("recording", F.concat_ws("_", "recording", "word"))
    writers.npy_features(made, f"file://{tmp_path}/npy")
    back = readers.npy_features(spark, str(tmp_path / "npy" / "*" / "*" / "*"))
    assert sorted(r.frames for r in back.collect()) == sorted(r.frames for r in made.collect())
    assert (tmp_path / "npy" / "m" / "layer-1" / "B1_w" / "layer-01.npy").exists()


def test_file_metadata(spark):
    df = spark.createDataFrame([("x/m/layer-4/m-layer-4.dif.ga.initclust.n4",)], "path string")
    r = readers.file_metadata(df).first()
    assert (r.model, r.layer, r.method) == ("m", "layer-4", "ga")


def test_score_files(spark, tmp_path):
    scores = spark.createDataFrame([("m", f"layer-{n}", "ga", n / 100, "X" if n > 9 else "") for n in (10, 2)], "model string, layer string, clustering string, r double, max_r string")
    writers.r_scores(scores, str(tmp_path / "r"))
    assert [line.split(",")[1] for line in next((tmp_path / "r").glob("part*")).read_text().split()[1:]] == ["layer-2", "layer-10"]
    writers.r_scores(scores, str(tmp_path / "best"), True)
    assert len(next((tmp_path / "best").glob("part*")).read_text().split()) == 2
    writers.c_scores(scores.select("model", "layer", "clustering", F.lit(0.285).alias("CDistance")), str(tmp_path / "c"))
    assert "0.28" in next((tmp_path / "c").glob("part*")).read_text()
