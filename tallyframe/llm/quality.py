"""Operator 2: a quality classifier from weak labels.

Six heuristic labellers (native column expressions) vote good, bad or nothing on each document. Documents with the
same votes are one pattern (at most 3**6), so expectation-maximisation for each labeller's accuracies runs over counts
of patterns of the whole corpus: exact, and a few hundred numbers on the driver. The posterior of each pattern then
labels a bounded sample on which a hashed linear scorer is fitted, and the scorer judges every whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, small_batches

BUCKETS = 1 << 15
SAMPLE = 6000  # documents that the scorer is fitted on
PARTS = 64  # of the hashes' range, each of which gives as many of them
SAMPLE_CHARS = 20_000_000
LABELLERS = 6


def voted(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and votes: an array of 1 good, -1 bad, 0 none, by labeller: length, letters, mean word,
    repeats, lines, symbols.

    What the votes use more than once is a column of an earlier select, so Catalyst keeps it there and it is
    computed once a row.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    measures = {
        "m_n": F.length(t),
        "m_words": F.size(F.split(t, r"\s+")),
        "m_letters": F.length(F.regexp_replace(t, r"[^\p{L}\s]+", "")),
        "m_lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0),
        "m_symbols": F.length(t) - F.length(F.translate(t, "|#<>{}[]=~^*_\\$%&@", "")),
        "m_stops": F.length(t) - F.length(F.translate(t, ".!?", "")),
    }
    counted = docs.withColumns(measures).withColumns({"m_all": F.size("m_lines"), "m_own": F.size(F.array_distinct("m_lines"))})
    n, words, letters, symbols, stops, every, own = (F.col(f"m_{c}") for c in ("n", "words", "letters", "symbols", "stops", "all", "own"))

    def vote(good, bad):
        return F.when(bad, -1).when(good, 1).otherwise(0)

    found = F.array(
        vote(words >= 60, words < 12),
        vote(letters > 0.93 * n, (letters < 0.7 * n) | (n == 0)),
        vote((n > 4.0 * words) & (n < 9.5 * words), (n < 2.5 * words) | (n > 16.0 * words)),
        vote(own == every, own < 0.7 * every),
        vote((stops > 0) & (words < 45 * stops), stops * 250 < words),
        vote(symbols < 0.004 * n, symbols > 0.05 * n),
    )
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias("votes"))


def accuracies(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over patterns (rows of votes) with their counts: prior of good, vote table [labeller, class, vote], posterior.

    Labellers are taken as independent given the class. It starts from the majority vote, which also settles which of
    the two classes is good.
    """
    if not len(patterns):
        return 0.5, np.full((LABELLERS, 2, 3), 1 / 3), np.zeros(0)
    p = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])
        prior = (w[1].sum() + 1) / (n.sum() + 2)
        table = np.einsum("ci,ijv->jcv", w, hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("ijv,jcv->ic", hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            p = new
            break
        p = new
    return float(prior), table, p


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a whole text with damped counts, of length one."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(1, dtype=np.int64), np.ones(1)
    seen: dict[int, int] = {}
    for w in words:
        h = _bucket(w)
        seen[h] = seen.get(h, 0) + 1
    at = np.fromiter(seen.keys(), dtype=np.int64, count=len(seen))
    x = np.log1p(np.fromiter(seen.values(), dtype=float, count=len(seen)))
    return at, x / np.sqrt(x @ x)


_MEMO: dict[str, int] = {}


def _bucket(w: str) -> int:
    h = _MEMO.get(w)
    if h is None:
        import zlib

        if len(_MEMO) > 300_000:
            _MEMO.clear()
        h = _MEMO[w] = zlib.crc32(w.encode("utf-8", "replace")) % (BUCKETS - 1) + 1
    return h


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 4, rate: float = 2.0) -> np.ndarray:
    """Adagrad steps of the log loss against posterior labels; bucket 0 is the bias."""
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            e = 1 / (1 + np.exp(-np.clip(x @ w[at] + w[0], -30, 30))) - y
            g = e * x + 1e-6 * w[at]
            g2[at] += g * g
            w[at] -= rate * 0.1 * g / np.sqrt(g2[at])
            g2[0] += e * e
            w[0] -= rate * 0.1 * e / np.sqrt(g2[0])
    return w


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, posterior (of its votes), score (of the scorer), keep.

    keep is posterior or score at `least` or more: a document goes only if both its votes and its words speak against
    it. Null and empty texts get all bad or no votes and are not kept. An empty table gives an empty result; equal
    texts get equal results. The scorer is fitted on `sample` rows at most (rounded up to PARTS), those with the least hashes
    of key and text, whatever the keys are.
    """
    rows = voted(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")))
    h = F.xxhash64("doc_id", "text", F.lit(2))
    found = rows.groupBy("votes").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.approx_count_distinct(h).alias("d")).collect()
    patterns = np.array([r["votes"] for r in found], dtype=int).reshape(-1, LABELLERS)
    n = np.array([r["n"] for r in found], dtype=float)
    _, _, posterior = accuracies(patterns, n)
    known = {tuple(p): float(q) for p, q in zip(patterns.tolist(), posterior)}
    # a share of different hashes: rows that repeat pass or fail together, and the window bounds those that pass
    d = max(1.0, sum(r["d"] for r in found))
    share = min(1.0, 1.2 * sample / d, SAMPLE_CHARS / max(1.0, sum(r["c"] or 0 for r in found) * d / max(1.0, n.sum())))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("h"))
    some = rows.select("*", h.alias("h"), F.pmod(h, F.lit(PARTS)).alias("part")).filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    chosen = some.withColumn("nth", nth).filter(F.col("nth") <= -(-sample // PARTS))

    def vectors(frames):
        for frame in frames:
            got = [features(t) for t in frame["text"]]
            yield pd.DataFrame({"h": frame["doc_id"], "v": frame["votes"], "at": [a.astype("<i4").tobytes() for a, _ in got], "x": [x.astype("<f4").tobytes() for _, x in got]})

    small_batches(chosen)
    got = chosen.select(F.col("h").alias("doc_id"), "votes", "text").mapInPandas(vectors, "h long, v array<int>, at binary, x binary").collect()
    got = sorted(got, key=lambda r: (r["h"], tuple(r["v"])))
    weights = fit_scorer([(np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["x"], dtype="<f4").astype(float), known[tuple(r["v"])]) for r in got])
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed number of buckets

    def make():
        w = shared.value

        def run(texts):
            out = []
            for t in texts:
                at, x = features(t)
                out.append(float(1 / (1 + np.exp(-np.clip(x @ w[at] + w[0], -30, 30)))))
            return [out]

        return run

    code = F.aggregate("votes", F.lit(0), lambda a, v: a * 3 + v + 1)
    by_code = {sum((v + 1) * 3 ** (LABELLERS - 1 - i) for i, v in enumerate(p)): q for p, q in known.items()}
    table = F.array(*[F.lit(by_code.get(i, 0.5)) for i in range(3**LABELLERS)])
    scored = map_texts(rows.withColumn("posterior", F.element_at(table, code + 1)).select("doc_id", "posterior", "text"), "text", make, "score double")
    return scored.select("doc_id", "posterior", "score", ((F.col("posterior") >= least) | (F.col("score") >= least)).alias("keep"))
