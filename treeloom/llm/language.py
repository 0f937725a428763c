"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are n-grams of 1 to 3 lower-cased characters, hashed to ``2**bits`` columns; a feature's value is its share of
the text's n-grams in per cent times its inverse document frequency.  Document frequencies cover every training text.
Weights are fitted by follow-the-regularised-leader (proximal, per coordinate) with an elastic-net penalty on a bounded
sample of training texts, then one temperature is fitted on a part of the sample held back from the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import only, tidy, written

ORDERS = (1, 2, 3)
#: Characters of a text that are hashed at once.
PART_CHARS = 1 << 19


@dataclass(frozen=True)
class Settings:
    """``fit_docs``: expected size of the sample that weights and temperature are fitted on, shared evenly by languages.

    It never exceeds twice that number and one document for a language left out.  A text of more than ``fit_chars``
    characters is represented in the sample by a window of so many, at a place that its hash gives.

    Besides its whole text, each sampled document longer than two windows gives one of ``window`` characters, so that
    weights and temperature hold for short texts too.
    """

    bits: int = 18
    fit_docs: int = 2000
    fit_chars: int = 8_000
    window: int = 50
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.002


@dataclass
class Model:
    """``weights[feature, language]`` include the inverse document frequency."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for ids in feature_parts(text, self.bits):
            for k in range(len(self.languages)):
                total[k] += self.weights[k][ids].sum(dtype=np.float64)
            n += len(ids)
        z = (self.bias + (100.0 / n if n else 0.0) * total) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def feature_parts(text: str, bits: int):
    """Hashed n-grams of a whole text, part by part; parts overlap so that no n-gram is lost or counted twice."""
    text = " " + text + " "
    step, reach = PART_CHARS, max(ORDERS) - 1
    for at in range(0, len(text), step):
        c = np.frombuffer(text[at : at + step + reach].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        here = len(text[at : at + step].lower()) if at + step < len(text) else len(c)
        shift = np.uint32(32 - bits)
        h = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        for order in range(1, max(ORDERS) + 1):
            if order > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[order - 1 :] * np.uint32(0xC2B2AE3D)
            if order in ORDERS and len(h):
                yield ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> shift)[:here]


def _document_frequencies(texts: DataFrame, bits: int) -> np.ndarray:
    """Number of texts with each feature, and in the last place the number of texts."""
    width = 1 << bits

    def run(batches):
        df, seen, n = np.zeros(width, np.int64), np.zeros(width, bool), 0
        for b in batches:
            for t in b.column(0):
                for ids in feature_parts(t.as_py(), bits):
                    seen[ids] = True
                found = np.flatnonzero(seen)
                df[found] += 1
                seen[found] = False
                n += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, width), pa.int32()), pa.array(np.append(df[found], n))], names=["f", "n"])

    out = np.zeros(width + 1, np.int64)
    found = texts.mapInArrow(tidy(run), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # at most 2**bits + 1 rows
    out[found["f"].to_numpy()] = found["n"].to_numpy()
    return out


def _fit(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], idf: np.ndarray, languages: list[str], s: Settings) -> Model:
    """``rows``: feature ids, shares in per cent, language number, whether for the temperature."""
    k, width = len(languages), len(idf)
    z, n = np.zeros((width + 1, k)), np.zeros((width + 1, k))

    def weights(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    train = [r for r in rows if not r[3]] or rows
    rng = np.random.default_rng(11)
    for _ in range(s.epochs):
        for i in rng.permutation(len(train)):
            ids, share, y, _ = train[i]
            f, x = np.append(ids, width), np.append(share * idf[ids], 1.0)[:, None]
            zf, nf = z[f], n[f]
            w = weights(zf, nf)
            score = (w * x).sum(axis=0)
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            g = x * p
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / s.alpha * w
            n[f] = nf + g * g
    w = weights(z, n)
    held = [r for r in rows if r[3]] or rows
    logits = np.array([(share * idf[ids]) @ w[ids] + w[width] for ids, share, _, _ in held])
    ys = np.array([r[2] for r in held])

    def loss(log_t):
        a = logits / np.exp(log_t)
        a = a - a.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(ys)), ys]))

    low, high = np.log(0.2), np.log(20.0)
    for _ in range(60):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return Model(languages, np.ascontiguousarray((w[:width] * idf[:, None]).T.astype(np.float32)), w[width].copy(), float(np.exp(low)), s.bits)


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares of all its n-grams in per cent."""
    found, n = np.unique(np.concatenate(list(feature_parts(text, bits))), return_counts=True)
    return found.astype(np.int32), (100.0 * n / n.sum()).astype(np.float32)


def train(labelled: DataFrame, settings: Settings | None = None) -> Model | None:
    """Fit on ``labelled(doc_id, text, lang)``; rows with a null text or ``lang`` don't count.  None without any.

    Weights are fitted in one executor task, whose input is the bounded sample; the driver gets the weights that the
    penalty left, not the sample.
    """
    s = settings or Settings()
    rows = only(labelled, "doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    languages = sorted(sizes)
    df = _document_frequencies(rows.select("text"), s.bits)
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0
    quota = max(1, s.fit_docs // len(sizes))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, quota / n))) for lang, n in sizes.items()])
    # a long text is represented by a window at a place that its hash gives
    rows = rows.withColumn("mark", F.xxhash64(F.col("doc_id"), F.lit("fit")))
    at = (F.pmod("mark", F.greatest(F.lit(1), F.length("text") - s.fit_chars + 1)) + 1).cast("int")
    rows = rows.select("doc_id", F.substring("text", at, F.lit(s.fit_chars)).alias("text"), "lang", "mark")
    drawn = written(rows.where((F.pmod("mark", F.lit(1 << 20)) / float(1 << 20)) < share).orderBy("mark", "doc_id", "text").limit(2 * s.fit_docs), "drawn")
    sample = drawn
    if missing := set(sizes) - {r.lang for r in drawn.select("lang").distinct().collect()}:  # rare ones give one document each
        one = rows.where(F.col("lang").isin(sorted(missing))).groupBy("lang").agg(F.min_by(F.struct("doc_id", "text", "mark"), F.struct("mark", "doc_id")).alias("r"))
        sample = drawn.unionByName(one.select("r.doc_id", "r.text", "lang", "r.mark"))
    number = {lang: i for i, lang in enumerate(languages)}
    shared = sample.sparkSession.sparkContext.broadcast(idf)  # 2**bits numbers

    def fit(batches):
        texts = sorted((r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("mark", "lang", "text")])))
        if not texts:
            return
        cases = []
        for mark, lang, whole in texts:
            place = mark % max(1, len(whole) - s.window)
            for text in [whole[place : place + s.window], whole] if len(whole) > 2 * s.window else [whole]:
                ids, shares = features(text, s.bits)
                cases.append((ids, shares, number[lang], mark % 5 == 0))
        m = _fit(cases, shared.value, languages, s)
        for k in range(len(languages)):
            kept = np.flatnonzero(m.weights[k])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kept.astype("<i4").tobytes()]), pa.array([m.weights[k][kept].astype("<f4").tobytes()]), pa.array([float(m.bias[k])]), pa.array([m.temperature])], names=["k", "ids", "weights", "bias", "temperature"])

    weights, bias, temperature = np.zeros((len(languages), 1 << s.bits), np.float32), np.zeros(len(languages)), 1.0
    one_task = sample.select("mark", "lang", "text").repartition(1)
    for r in one_task.mapInArrow(tidy(fit), "k int, ids binary, weights binary, bias double, temperature double").collect():  # one row per language
        weights[r.k][np.frombuffer(r.ids, "<i4")] = np.frombuffer(r.weights, "<f4")
        bias[r.k], temperature = r.bias, r.temperature
    shared.destroy()
    return Model(languages, weights, bias, temperature, s.bits)


def predict(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text, ...)``; with ``keep`` after all its columns.

    Whole texts of any length are read.  ``und`` with score 0 where a text is null, empty or has no letter, and for
    all rows if the model is None (nothing was learned).  Repeated rows each come back; no rows give none.
    """
    spark = docs.sparkSession
    rows = docs if keep else only(docs, "doc_id", "text")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = rows.withColumn("treeloom letter", letter)
    shared = spark.sparkContext.broadcast(model)  # 2**bits floats per language
    at = rows.columns.index("text")
    names = [*(rows.columns[:-1] if keep else ["doc_id"]), "lang_pred", "score"]

    def run(batches):
        m = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                langs, scores = [], []
                for t, has in zip(part.column(at), part.column(part.num_columns - 1).to_pylist()):
                    if m is None or not has:
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        p = m.probabilities(t.as_py())
                        langs.append(m.languages[int(p.argmax())])
                        scores.append(float(p.max()))
                columns = part.columns[:-1] if keep else [part.column(0)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    from pyspark.sql import types as T

    fields = rows.schema.fields[:-1] if keep else [rows.schema["doc_id"]]
    return rows.mapInArrow(tidy(run), T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id):
    """Whether a document takes no part in training: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Train on the documents that are not held out (a null ``doc_id`` never trains) and predict all of them."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    out = predict(docs, train(known, settings))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """Rows of ``docs``, with their columns, whose language is told with a score of at least ``least``.

    Texts that are null, empty or without letters go.  Without a model no row can be told and all with letters stay.
    """
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = {c: f"treeloom {i}" for i, c in enumerate(docs.columns) if c in ("lang_pred", "score")}
    found = predict(docs.withColumnsRenamed(names), model, keep=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in names.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
