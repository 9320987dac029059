"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isogloss.llm import centroid_clusters, license_rules, license_scan, queries, vector_codes


def vectors(spark, n=400, width=8, seed=1, spread=3.0):
    """Clumps, equal vectors, repeated rows, ties and rows that take no part."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, width))
    rows = [(i, (heads[i % 5] * spread + rng.normal(size=width)).tolist(), i % 7 if i % 6 else None) for i in range(n)]
    rows += [(n + i, rows[3][1], 3) for i in range(n // 3)] + [rows[4], rows[4], (None, rows[5][1], None)]
    rows += [(n * 2 + i, [float((i >> b) & 1) - 0.5 for b in range(width)], 9) for i in range(40)]
    rows += [(5000, None, 1), (5001, [None] * width, 1), (5002, [float("nan")] * width, 1), (5003, [1.0, float("inf")] * (width // 2), 1), (5004, [1.0] * (width - 1), 1), (5005, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("x"), "v": F.lit(1), "x": F.lit(None).cast("string")}).repartition(5), rows


def usable(rows, width):
    return [(i, v, k) for i, v, k in rows if v is not None and len(v) == width and all(e is not None and np.isfinite(e) for e in v)]


def brute_clusters(rows, k, rounds, width, scale, seed):
    kept = usable(rows, width)
    x = np.floor(np.array([v for _, v, _ in kept]) * scale).astype(np.int64)
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"{seed}:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    c = x[order[:k]]
    for _ in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        last = c
        c = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    best = d.min(1)
    digest = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in last.tolist()]
    return sorted(((i, int(j), int(e), int(best[own == j].sum()), int(best.sum()), digest[j]) for (i, _, _), j, e in zip(kept, own, best, strict=True)), key=repr)


@pytest.mark.parametrize(("k", "rounds", "scale", "spread"), [(8, 10, 1024, 3.0), (20, 6, 16, 0.3), (1, 2, 4, 1.0), (600, 2, 64, 1.0)])
def test_clusters_are_those_of_full_scans(spark, k, rounds, scale, spread):
    df, rows = vectors(spark, spread=spread)
    got = centroid_clusters.cluster_vectors(df, k, rounds, 8, scale)
    assert sorted(map(tuple, got.drop("centroid").collect()), key=repr) == brute_clusters(rows, k, rounds, 8, scale, 3)


def test_bounds_spare_scans_and_certify():
    """After a small move few vectors are rescanned, lists may be cut, and all are where a full scan puts them."""
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (2000, 6)) + 3000 * rng.integers(0, 4, (2000, 1))
    c = x[:12].copy()
    near, bound, own = centroid_clusters.scan(x, c, 4)
    rescans = []
    for listed in (4, 4, 3, 3, 1, 1):
        new = np.array([x[near[:, 0] == j].sum(0) // max(1, (near[:, 0] == j).sum()) for j in range(12)])
        moved = np.nextafter(np.sqrt(((new - c) ** 2).sum(1)), np.inf)
        near, bound, own, need, rescanned = centroid_clusters.step(x, near, bound, new, moved, listed)
        c = new
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (near[:, 0] == d.argmin(1)).all() and (own == d.min(1)).all()
        root = np.sqrt(np.take_along_axis(d, near, 1))
        assert (bound[:, 1:-1] <= root[:, 1:]).all() and (bound[:, 0] >= root[:, 0]).all()
        rest = np.sqrt(np.where((near[:, :, None] == np.arange(12)).any(1), np.iinfo(np.int64).max, d).min(1))
        assert (bound[:, -1] <= rest).all() and near.shape[1] == listed + 1
        rescans.append(rescanned)
    assert rescans[-1] < len(x) // 2


def test_clusters_of_few_and_no_vectors(spark):
    df, _ = vectors(spark)
    assert centroid_clusters.cluster_vectors(df.filter("false"), width=8).count() == 0
    few = spark.createDataFrame([(7, [1.0, -0.001]), (7, [1.0, -0.001]), (8, [2.0, 5.0])], "vec_id long, embedding array<float>")
    got = centroid_clusters.cluster_vectors(few, width=2)
    assert sorted((r.vec_id, r.distance, tuple(r.centroid)) for r in got.collect()) == [(7, 0, (1024, -2)), (7, 0, (1024, -2)), (8, 0, (2048, 5120))]
    with pytest.raises(Exception, match="over"):
        centroid_clusters.cluster_vectors(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>"), width=2).collect()


def brute_codes(rows, parts, entries, rounds, scale, width):
    kept = usable(rows, width)
    x = np.floor(np.array([v for _, v, _ in kept]) * scale).astype(np.int64).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    book = x[order].transpose(1, 0, 2)
    for t in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None] - book[:, None]) ** 2).sum(3)
        code = d.argmin(2)
        if t < rounds:
            book = np.array([[x[code[p] == e, p].sum(0) // (code[p] == e).sum() if (code[p] == e).any() else book[p, e] for e in range(len(order))] for p in range(parts)])
    error = d.min(2).sum(0)
    total = {}
    for (_, _, k), e in zip(kept, error, strict=True):
        total[k] = total.get(k, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in code[:, r]), int(error[r]), total[k], digest) for r, (i, _, k) in enumerate(kept)), key=repr)


@pytest.mark.parametrize(("parts", "entries", "scale", "labels"), [(4, 16, 4096, 200_000), (8, 16, 2, 3), (2, 200, 16, 3), (1, 1, 64, 200_000)])
def test_codes_are_those_of_full_scans(spark, monkeypatch, parts, entries, scale, labels):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", labels)
    df, rows = vectors(spark)
    got = vector_codes.compress_vectors(df, parts, entries, 3, scale)
    assert sorted(map(tuple, got.drop("codes").collect()), key=repr) == brute_codes(rows, parts, entries, 3, scale, 8)


def test_annulus_spares_entries_and_keeps_ties():
    rng = np.random.default_rng(9)
    book = rng.integers(-40, 40, (64, 3)) * rng.integers(1, 30, (64, 1))
    book[7], book[30] = book[3], [0, 0, 5]
    x = np.vstack([rng.integers(-900, 900, (3000, 3)), book, [[0, 0, 0]], [[0, 5, 0]]])
    code, best, measured = vector_codes.Annulus(book).nearest(x)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
    assert measured < 0.6 * d.size


def test_codes_of_few_and_no_vectors(spark):
    df, _ = vectors(spark)
    assert vector_codes.compress_vectors(df.filter("false"), 4).count() == 0
    few = spark.createDataFrame([(2, [1.0, 2.0], "a"), (1, [0.5, -0.1], None)], "vec_id long, embedding array<float>, label string")
    assert [(r.vec_id, r.code, r.error) for r in vector_codes.compress_vectors(few, 2).orderBy("vec_id").collect()] == [(1, "0000", 0), (2, "0101", 0)]


TEXTS = [
    None,
    "",
    " ,.!",
    "Released under the MIT License. The mit-license; MIT LICENSE mit license",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3",
    "GNU Lesser General Public License v2.1 and GNU General Public License v2.1",
    "SPDX-License-Identifier: BSD-3-Clause and three-clause BSD; spdx-licence-identifier: gpl-2.0-or-later",
    "the Affero General Public License; apache; license mit general public",
    "cc by-nc 4.0 cc by 4.0 CC0 mitélicense mit\u00a0license mit license",
    "general public license " * 700,
    "licensed " * 3000 + "under the mit license",
    "x" * 200_000 + " mit license",
    "All rights reserved. " * 300 + "MIT No Attribution 0 License",
]


def brute_licenses(text, kinds):
    words = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    spaced = " " + "  ".join(words) + " "
    found = []
    for i, r in enumerate(kinds):
        for m in re.finditer(license_scan.pattern(r.expression), spaced):
            start = len([w for w in spaced[: m.start()].split(" ") if w])
            found.append((start, -(start + len([w for w in m.group().split(" ") if w])), r.level, i))
    found.sort()
    kept, ends = [], {}
    for d in found:
        if not any(level <= d[2] and end >= -d[1] for level, end in ends.items()):
            kept.append(d)
        ends[d[2]] = max(ends.get(d[2], 0), -d[1])

    def told(some):
        return [(kinds[i].label, s, -e, level) for s, e, level, i in some]

    return len(words), told([d for d in found if kinds[d[3]].base]), told(kept)


def test_licenses_are_those_of_every_rule_tried(spark):
    kinds = license_rules.rules()
    assert len(kinds) > 250
    rng = random.Random(3)
    pieces = [w for t in TEXTS[3:10] for w in t.split()] + ["with", "the", "or", "any", "later", "version", "3.0"]
    texts = TEXTS + [" ".join(rng.choices(pieces, k=60)) for _ in range(60)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "found": F.lit("x"), "base": F.lit(0)}).repartition(4)
    got = [(r.doc_id, r.n_words, [tuple(d) for d in r.base], [tuple(d) for d in r.found]) for r in license_scan.scan_licenses(df).collect()]
    want = [(i, *brute_licenses(t, kinds)) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert license_scan.scan_licenses(df.filter("false")).count() == 0


def sample(parsed, rng) -> str:
    """A random string that a parsed expression matches."""
    out = []
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out.append(chr(arg))
            case "NOT_LITERAL":
                out.append("w")
            case "IN":
                out.append("w" if str(arg[0][0]) == "NEGATE" else chr(rng.choice(arg)[1]))
            case "BRANCH":
                out.append(sample(rng.choice(arg[1]), rng))
            case "SUBPATTERN":
                out.append(sample(arg[-1], rng))
            case "MAX_REPEAT":
                low, high, body = arg
                out += [sample(body, rng) for _ in range(rng.randint(low, min(int(high), low + 3)))]
    return "".join(out)


def test_every_match_has_its_keywords():
    """The prefilter loses nothing: whatever a rule matches holds a keyword of each of its groups."""
    rng = random.Random(8)
    for r in license_rules.rules():
        parsed = re._parser.parse(r.expression)
        for _ in range(60):
            text = sample(parsed, rng)
            assert re.fullmatch(license_scan.pattern(r.expression), " " + text.replace(" ", "  ") + " "), (r, text)
            words = set(text.split())
            assert all(words & set(group) for group in r.words), (r, text)
            assert not re.search(r"[^a-z0-9 ]|  ", text), (r, text)


def test_license_query_columns(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op12_license_scan(spark, str(tmp_path)).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].base_labels) == (4, 3, 10, "mit")
    assert (rows[4].base_labels, rows[4].labels, rows[4].score) == ("apache", "apache,apache-2.0", 1.0)
    assert rows[6].labels == "gpl,gpl-2.0,lgpl-2.1"
    assert rows[10].n_base == 700 and rows[10].last_word == 3 * 699


def test_license_plan_is_one_narrow_stage(spark):
    plan = license_scan.scan_licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("regexp_extract_all") <= 3
