"""Operator 1: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and runs of one to three characters are hashed into
a fixed number of buckets. Document frequencies cover every labelled training document. The weights are fitted with
follow-the-regularised-leader steps under L1 and L2 penalties on a bounded sample of training documents, and a
temperature fitted on other sampled documents calibrates the probabilities. The model (buckets x languages) is small
whatever the corpus, and each task scores whole texts with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, small_batches

BUCKETS = 1 << 14
SAMPLE = 1500  # documents sampled for each language: the bound of what the driver fits on
TOTAL = 12_000  # and for all languages together
CLASSES = 256  # languages that are learned: the bound of the model that is broadcast
SAMPLE_CHARS = 4_000_000  # and of the code points sampled for each language
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    out, h = np.zeros(BUCKETS), np.zeros(len(codes), dtype=np.uint64)
    for n in (1, 2, 3):
        h = (h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if len(h):
            out += np.bincount((h >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
        else:
            break
    return out


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    seen: dict = field(default_factory=dict)

    def vector(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(c)
        x = np.log1p(c[at]) * self.idf[at]
        n = np.sqrt(x @ x)
        return at, x / n if n else x

    def logits(self, c: np.ndarray) -> np.ndarray:
        at, x = self.vector(c)
        return x @ self.weights[at]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            c = counts(text) if self.classes else None
            if c is None:
                langs.append("und")
                scores.append(0.0)
                continue
            p = _softmax(self.logits(c) / self.temperature)
            k = int(p.argmax())
            langs.append(self.classes[k])
            scores.append(float(min(1.0, p[k])))
        return langs, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.01, seed: int = 5) -> None:
    """Per-coordinate FTRL-proximal steps of the multinomial log loss with an elastic-net penalty."""
    k = len(model.classes)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    rng = np.random.default_rng(seed)

    def solved(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            zi, ni = z[at], n[at]
            w = solved(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    model.weights = solved(z, n)


def fit_temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature with the least log loss on rows that the weights were not fitted on."""
    if not rows:
        return
    logits = np.array([x @ model.weights[at] for at, x, _ in rows])
    y = np.array([r[2] for r in rows])
    losses = [(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean(), t) for t in np.geomspace(0.02, 5, 60)]
    model.temperature = float(min(losses)[1])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on rows of docs with a language and letters. Of each language at most `sample` rows, and of all at most TOTAL,
    are fitted on: those with the least hashes of key and text, so that repeated keys, null keys and repeated rows do not
    bring more. The CLASSES commonest languages are learned. Document frequencies cover all rows. No rows: a model that
    answers `und`."""
    small_batches(docs)
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("y"), F.xxhash64(F.col(key), F.col(text), F.lit(1)).alias("h")).filter("t is not null and y is not null")

    def frequencies(frames):
        df, total = np.zeros(BUCKETS, dtype=np.int64), 0
        for frame in frames:
            for t in frame["t"]:
                if (c := counts(t)) is not None:
                    df += c > 0
                    total += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], total)})

    found = rows.select("t").mapInPandas(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS)
    total = 0
    for r in found:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    # shares are of different hashes: rows that repeat pass or fail together, and the window bounds those that pass
    by_lang = rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c"), F.approx_count_distinct("h").alias("d"))
    per = {r["y"]: (r["d"], r["c"] * r["d"] / r["n"]) for r in by_lang.orderBy(F.col("n").desc(), "y").limit(CLASSES).collect()}
    model = Model(sorted(per), idf, np.zeros((BUCKETS, len(per))))
    if not per:
        return model
    sample = min(sample, TOTAL // len(per))
    shares = F.create_map(*[F.lit(v) for y, (d, c) in per.items() for v in (y, min(1.0, 1.2 * sample / d, SAMPLE_CHARS / max(1, c)))])
    nth = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    chosen = rows.filter(F.pmod("h", F.lit(1_000_003)) < F.try_element_at(shares, F.col("y")) * 1_000_003).withColumn("nth", nth).filter(F.col("nth") <= sample)

    def vectors(frames):
        for frame in frames:
            out = []
            for t, y, h in zip(frame["t"], frame["y"], frame["h"]):
                if (c := counts(t)) is not None:
                    at, x = model.vector(c)
                    out.append((h, y, at.astype("<i4").tobytes(), x.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["h", "y", "at", "x"])

    got = chosen.mapInPandas(vectors, "h long, y string, at binary, x binary").collect()
    got = sorted(got, key=lambda r: (r["h"], r["y"], bytes(r["at"])))
    number = {y: i for i, y in enumerate(model.classes)}
    fit = [(np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["x"], dtype="<f4").astype(float), number[r["y"]]) for r in got]
    held = [x for i, x in enumerate(fit) if i % 5 == 4]
    fit_ftrl(model, [x for i, x in enumerate(fit) if i % 5 != 4])
    fit_temperature(model, held)
    return model


def is_held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score. Null texts and texts without letters: `und`, 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages: bounded
    return map_texts(docs, text, lambda: lambda texts: shared.value.predict(texts), "lang_pred string, score double")


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from rows that are not held out (a null key is
    neither held out nor learned from); predictions see the text alone. An empty table gives an empty result."""
    model = train(docs.filter(~is_held_out(key) & F.col(key).isNotNull()), text, lang, key)
    rows = docs.select(F.col(key).alias("doc_id"), is_held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language the model tells with a score of `least` or more; columns of docs alone."""
    names = docs.columns
    model = train(docs.filter(~is_held_out("doc_id") & F.col("doc_id").isNotNull()))
    got = identify(docs.toDF(*[f"c{i}" for i in range(len(names))]), model, f"c{names.index('text')}")
    return got.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score").toDF(*names)
