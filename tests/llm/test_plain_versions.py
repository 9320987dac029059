"""Rows of registered queries against plain versions of what they compute, text by text, on a whole table."""

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from isogloss.llm import language_id, queries, token_counts

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts_are_those_of_the_best_segmentation(spark):
    vocabulary = token_counts.read_vocabulary()
    longest = max(map(len, vocabulary.scores))

    @lru_cache(maxsize=None)
    def count(pre_token):
        word = pre_token.replace(" ", "▁")
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            score, less = best[end - 1]
            options = [(score + vocabulary.unknown, less - len(word[end - 1].encode()))]
            for start in range(max(0, end - longest), end):
                own = vocabulary.scores.get(word[start:end])
                if own is not None:
                    options.append((own + best[start][0], best[start][1] - 1))
            best.append(max(options))
        return -best[-1][1]

    known, rows = texts(spark), queries.QUERIES["op5_token_counts"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(known)
    for r in rows:
        words = token_counts.pre_tokens(known[r.doc_id])
        assert "".join(words) == known[r.doc_id]
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(map(count, words)))


def plain_features(text):
    kept = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    b = (b" " + kept + b" ").replace(b"  ", b" ")
    m0, m1, m2 = (int(m) for m in language_id._MIX)
    counts = Counter()
    for at in range(len(b)):
        x = b[at] * m0 % 2**32
        grams = [x] if b[at] != 32 else []
        if at + 1 < len(b):
            x ^= b[at + 1] * m1 % 2**32
            grams.append(x)
        if at + 2 < len(b):
            grams.append(x ^ b[at + 2] * m2 % 2**32)
        counts.update((g * 0x2C1B3C6D % 2**32) >> 20 for g in grams)
    out = np.zeros(language_id.WIDTH)
    for k, n in counts.items():
        out[k] = math.sqrt(n)
    return out / math.sqrt(sum(counts.values()))


def plain_prediction(model, text):
    if not any(c.isalpha() for c in text):
        return language_id.UNKNOWN, 0.0
    x = np.append(plain_features(text), 1.0)
    chance = lambda margin: 1 / (1 + math.exp(-2 * margin))
    margins = {f: float(x @ model.gates[:, k]) if model.gates.size else 1.0 for k, f in enumerate(model.families)}
    first, *others = sorted(margins.values(), reverse=True)
    family = max(margins, key=margins.get)
    won = {l: [0, 1.0] for l in model.languages if language_id.FAMILY.get(l, l) == family}
    for (i, j), machine in zip(model.pairs, model.machines.T, strict=True):
        p = chance(float(x @ machine))
        for name, wins, sure in ((model.languages[i], p > 0.5, p), (model.languages[j], p <= 0.5, 1 - p)):
            if name in won:
                won[name] = [won[name][0] + wins, min(won[name][1], sure)]
    name = max(won, key=lambda l: sum(won[l]))
    return name, chance(first - (others[0] if others else -1.0)) * won[name][1]


def test_languages_are_those_of_the_model_text_by_text(spark):
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    known, rows = texts(spark), queries.QUERIES["op6_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(known)
    for r in rows:
        name, score = plain_prediction(model, known[r.doc_id])
        assert r.lang_pred == name and r.score == pytest.approx(score, abs=1e-4)
