"""The fitted models against plain Python: n-gram counts, weights by FTRL, feature counts and noise."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import language, quality

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def plain_ngrams(text, bits):
    """Hashed n-grams of 1 to 3 characters, one by one."""
    c = [ord(x) for x in f" {text} ".lower()]
    out = []
    for i in range(len(c)):
        h = (c[i] * 0x9E3779B1 + 0x7F4A7C15) & M32
        for order in (1, 2, 3):
            if order > 1:
                if i + order > len(c):
                    break
                h = (((h ^ (h >> 15)) * 0x85EBCA77) + c[i + order - 1] * 0xC2B2AE3D) & M32
            out.append((((h ^ (h >> 13)) * 0x27D4EB2F) & M32) >> (32 - bits))
    return out


def test_ngrams_and_document_frequencies(spark):
    texts = ["The öak", "a", "der Baum, der Baum", "ß!"]
    for t in texts:
        got = Counter(np.concatenate(list(language.feature_parts(t, 18))).tolist())
        assert got == Counter(plain_ngrams(t, 18))
        ids, shares = language.features(t, 18)
        n = sum(got.values())
        assert {i: s for i, s in zip(ids.tolist(), shares.tolist())} == pytest.approx({i: 100 * k / n for i, k in got.items()}, rel=1e-6)
    df = language._document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), 18)
    want = Counter(i for t in texts for i in set(plain_ngrams(t, 18)))
    assert df[-1] == 4 and {int(i): int(df[i]) for i in np.flatnonzero(df[:-1])} == want


def test_weights_by_plain_ftrl():
    rng = np.random.default_rng(1)
    s, width = language.Settings(bits=6, epochs=2, l1=0.5), 64
    rows = [(np.sort(rng.choice(width, 5, replace=False)), rng.uniform(1, 30, 5), int(k % 3), k % 5 == 0) for k in range(30)]
    idf = rng.uniform(1, 3, width)
    got = language._fit(rows, idf, ["a", "b", "c"], s)
    z, n = np.zeros((width + 1, 3)), np.zeros((width + 1, 3))

    def weight(i, k):
        if abs(z[i, k]) <= s.l1:
            return 0.0
        return -(z[i, k] - math.copysign(s.l1, z[i, k])) / ((s.beta + math.sqrt(n[i, k])) / s.alpha + s.l2)

    train = [r for r in rows if not r[3]]
    order = np.random.default_rng(11)
    for _ in range(s.epochs):
        for at in order.permutation(len(train)):
            ids, share, y, _ = train[at]
            x = {**{int(i): float(v * idf[i]) for i, v in zip(ids, share)}, width: 1.0}
            w = {(i, k): weight(i, k) for i in x for k in range(3)}
            score = [sum(w[i, k] * v for i, v in x.items()) for k in range(3)]
            top = max(score)
            e = [math.exp(v - top) for v in score]
            for i, v in x.items():
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / s.alpha
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    for k in range(3):
        assert got.weights[k] == pytest.approx([weight(i, k) * idf[i] for i in range(width)], rel=1e-5, abs=1e-6)
        assert got.bias[k] == pytest.approx(weight(width, k))
    assert (got.weights == 0).sum() > 0  # the l1 penalty leaves zeros


def test_long_texts_are_represented_by_a_window(spark):
    long = "der die das und " * 5000
    rows = [(i, "the of and to in " * 30, "en") for i in range(20)] + [(100 + i, long, "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.train(docs, language.Settings(fit_chars=500))
    assert m.languages == ["de", "en"] and m.probabilities("und das der die").argmax() == 0 and m.probabilities("and of the").argmax() == 1


# ---------------------------------------------------------------- importance resampling


def plain_features(text, bits):
    """Words, pairs and shape pairs of a text, hashed one by one."""
    golden, base = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D

    def mix(h):
        h = ((h ^ (h >> 29)) * golden) & M64
        return h ^ (h >> 32)

    tokens = []
    for run in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text.encode()):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in run)
        h = mix(sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(low)) & M64)
        big, small, digit = (sum(x in r for x in run) for r in (range(65, 91), range(97, 123), range(48, 58)))
        word = re.match(rb"[0-9A-Za-z\x80-\xff]", run)
        tokens.append((h, (1 if digit == len(run) else 2 if big >= 2 and not small else 3) if word else h))
    out = [h for h, _ in tokens]
    for (a, s), (b, t) in zip(tokens, tokens[1:]):
        out.append(0x1234567 if a == b and t <= 3 else mix((a * 3 + b) & M64))
        out.append(mix((mix(s) * 5 + t) & M64))
    return [((h * golden) & M64) >> (64 - bits) for h in out]


def test_ratios_are_counts(spark):
    texts = ["The cat sat, the cat SAT!", "BUY now!! 100 $$", "été et hiver 12", "", None, "the the the"]
    s = quality.Settings(bits=10, smoothing=2.0)
    for t in texts[:4]:
        assert Counter(np.concatenate([np.zeros(0, np.uint64), *quality.feature_parts(t, 10)]).tolist()) == Counter(plain_features(t, 10))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    got = quality.log_ratios(docs, labels, s)
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(plain_features(t or "", 10))
        if i in (0, 2):
            target.update(plain_features(t, 10))
    n, m = sum(raw.values()), sum(target.values())
    want = [math.log((target[k] / m + 2 / n) / (raw[k] / n + 2 / n)) for k in range(1024)]
    assert got == pytest.approx(want)
    for r in quality.score(docs, got, s).collect():
        ids = plain_features(texts[r.doc_id] or "", 10)
        assert r.n_features == len(ids) and r.log_weight == pytest.approx(sum(want[k] for k in ids))


def test_noise_is_gumbel(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    noise = np.sort([r.gumbel_key for r in quality.score(docs, np.zeros(1 << 16)).collect()])
    for q in (0.1, 0.5, 0.9):
        assert noise[int(q * 6000)] == pytest.approx(-math.log(-math.log(q)), abs=0.12)
    assert noise.mean() == pytest.approx(0.5772, abs=0.06)
