"""Toxicity by a counterfactual-regularised linear classifier.

Features are all words of the training sample; how much a word tells of the label, by its document counts over all
labelled rows, says how far its weight is held back. A word that the sample lacks has the weight 0, where the penalty on
size has its minimum. In the labelled sentences of the training sample each identity term is swapped for others of its
group; the square of the change that a swap makes in the score is part of the loss, so that a mention of a group by itself
moves no score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Terms of a group may be swapped for each other.
IDENTITY_GROUPS = (
    ("men", "women", "boys", "girls", "trans", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
)
IDENTITY = {term: group for group in IDENTITY_GROUPS for term in group}

#: Rows and characters of each label in the training sample (they bound the driver's memory and the broadcast, as no other
#: words have weights), the weights of the penalties on swaps, on size and, for each row, on the bias, the log-likelihood
#: ratio below which a word's penalty on size grows, and steps of Newton's method and of the conjugate gradients within each.
SAMPLE_EACH, SAMPLE_CHARS, SWAP_PENALTY, RIDGE, BIAS_PENALTY, TELLING, STEPS, INNER = 6000, 24_000_000, 10.0, 1.0, 0.25, 12.0, 25, 60

#: Words are runs of letters: A-Z become a-z, other ASCII characters separate, bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_set(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(NORMAL).split())


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, text, toxic of the documents to learn from: crc32(doc_id as text) mod 5 isn't 0 and the label is 0 or 1.
    Where labels repeat an id, it counts as toxic if any of its rows does."""
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & (common.remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(common.remainder(F.col("doc_id"), 5) != 0)
    return texts.join(common.broadcast_if_small(marks), "doc_id")


def telling_words(rows: DataFrame, sample: DataFrame) -> dict[bytes, float]:
    """All words of the sample, and the identity terms, with how much the presence of each tells about the label: the
    log-likelihood ratio of its document counts over all labelled rows. In the order of the words."""

    def counted(batches):
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for word in word_set(text):
                    counts.setdefault(word, [0, 0])[toxic] += 1
            yield pd.DataFrame({"word": list(counts), "n0": [c[0] for c in counts.values()], "n1": [c[1] for c in counts.values()]})

    def words_of(batches):
        for batch in batches:
            yield pd.DataFrame({"word": list(set().union(*map(word_set, batch["text"])))})

    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    a, b = totals.get(0, 0), totals.get(1, 0)
    if not a or not b:
        return {}
    sampled = sample.select("text").mapInPandas(words_of, "word binary").distinct()
    counts = rows.select("text", "toxic").mapInPandas(counted, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = F.col("n0"), F.col("n1")
    share = (n0 + n1) / F.lit(float(a + b))

    def term(n, total):
        expected = share * float(total)
        absent, not_expected = float(total) - n, float(total) - share * float(total)
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0) + F.when(absent > 0, absent * F.log(absent / not_expected)).otherwise(0.0)

    found = counts.join(sampled, "word", "left_semi").select("word", (term(n0, a) + term(n1, b)).alias("told")).orderBy("word").toArrow()
    return dict(zip(found["word"].to_pylist(), found["told"].to_pylist())) | {t.encode(): TELLING for t in IDENTITY}


class Model:
    def __init__(self, words: list[bytes], weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(words, map(float, weights))), float(bias)

    known = property(lambda self: self.weights.keys())

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(map(self.weights.__getitem__, self.known & word_set(text))))
        return float(1 / (1 + np.exp(-min(max(z, -700.0), 700.0))))


def fit(rows: list[tuple[list[int], int]], words: dict[bytes, float], swap_penalty: float = SWAP_PENALTY, ridge: float = RIDGE, rate: float | None = None) -> Model:
    """rows: the numbers of the words that a document has, and its label; words: in the order of their numbers, with how
    much each tells. Newton's method on the logistic loss, the classes weighed alike, plus the penalties, which are
    quadratic in the weights; the less a word tells, the more its weight is held back. The bias starts from the log odds of
    rate, the share of toxic rows (that of rows by default), and is drawn to them: a text of unknown words is as likely
    toxic as any, not as one of two equal classes."""
    n, d = len(rows), len(words)
    rate = (sum(y for _, y in rows) + 1) / (n + 2) if rate is None else rate
    odds = np.log(rate / (1 - rate))
    if not n or not d:
        return Model([], np.zeros(0), odds)
    told, words = np.array(list(words.values())), list(words)
    place = {w.decode(): k for k, w in enumerate(words) if w.decode(errors="replace") in IDENTITY}
    # the entries of a sparse matrix of ones; its last column is the bias
    at = np.concatenate([np.repeat(np.arange(n), [len(p) for p, _ in rows]), np.arange(n)])
    word = np.concatenate([np.concatenate([np.array(p, int) for p, _ in rows]), np.full(n, d)])
    y = np.array([label for _, label in rows], float)
    own = np.append(ridge * np.maximum(1, TELLING / np.maximum(told, 0.05)) ** 2, BIAS_PENALTY * n)
    terms = set(place.values())
    swaps: dict[tuple[int, int], int] = {}
    for present, _ in rows:
        for j in terms.intersection(np.asarray(present).tolist()):
            for other in IDENTITY[words[j].decode()]:
                if other in place and place[other] != j and place[other] not in present:
                    swaps[j, place[other]] = swaps.get((j, place[other]), 0) + 1
    for group in IDENTITY_GROUPS:  # a swap that the sample lacks still counts once, so that unseen terms stay neutral
        for a in group:
            for b in group:
                if a != b and a in place and b in place:
                    swaps.setdefault((place[a], place[b]), 1)
    pairs = np.array([*swaps], int).reshape(-1, 2)
    times = swap_penalty * np.array([*swaps.values()], float)

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, v[word], n)

    def back(u: np.ndarray) -> np.ndarray:
        return np.bincount(word, u[at], d + 1)

    def penalised(v: np.ndarray) -> np.ndarray:
        change = times * (v[pairs[:, 0]] - v[pairs[:, 1]])
        return own * v + np.bincount(pairs[:, 0], change, d + 1) - np.bincount(pairs[:, 1], change, d + 1)

    positive = max(y.sum(), 1)
    weight = np.where(y == 1, n / (2 * positive), n / (2 * max(n - positive, 1)))
    start = np.append(np.zeros(d), odds)
    theta = start.copy()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(forward(theta), -30, 30)))
        left = -(back(weight * (p - y)) + penalised(theta - start))  # what Newton's move must undo
        curve, move = weight * p * (1 - p) + 1e-9, np.zeros(d + 1)
        scale = back(curve) + own + np.bincount(pairs.ravel(), np.repeat(times, 2), d + 1)
        preferred = left / scale
        direction, gain = preferred, left @ preferred
        first = gain
        for _ in range(INNER):
            if gain <= 1e-10 * first or not gain:
                break
            bent = back(curve * forward(direction)) + penalised(direction)
            size = gain / (direction @ bent)
            move, left = move + size * direction, left - size * bent
            preferred = left / scale
            direction, gain = preferred + (left @ preferred) / gain * direction, left @ preferred
        theta += move * min(1, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-7:
            break
    return Model(words, theta[:d], theta[d])


def train(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH, sample_chars: int = SAMPLE_CHARS, **columns) -> Model:
    """Learns how much words tell from all labelled rows, and weights from a sample of at most about sample_each rows and
    sample_chars characters a label, drawn by the digest of the id. Without rows of both labels, every text gets the share
    of toxic rows."""
    spark = docs.sparkSession
    rows = common.stored(labelled(docs, labels, **columns), "toxic-labelled")
    counts, part = {}, F.lit(0.0)
    for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect():
        counts[r["toxic"]] = r["n"]
        part = F.when(F.col("toxic") == r["toxic"], min(1.0, sample_each / r["n"], sample_chars / max(r["chars"] or 0, 1))).otherwise(part)
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    words = telling_words(rows, drawn)
    place = spark.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def present(batches):
        for batch in batches:
            # packed, as the driver holds the whole sample
            found = [np.sort(np.array([place.value[w] for w in word_set(t) & place.value.keys()], "<i4")).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "present": found, "toxic": batch["toxic"]})

    # a repeated row is one of the sample, so that repetition can't make it large
    sample = drawn.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(present, "doc_id string, present binary, toxic int").distinct().orderBy("doc_id", "present").toArrow()
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    place.destroy()
    model = fit([(np.frombuffer(p.as_py(), "<i4"), y.as_py()) for p, y in zip(sample["present"], sample["toxic"])], words, rate=rate)
    common.drop_stored(rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for each row of docs, from its whole text alone; a null text counts as
    empty. Repeated rows give repeated rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        return pd.DataFrame({"score": [shared.value.score(t) for t in texts]}, dtype=float)

    scored = common.map_texts(docs, work, "score double", id_col, text_col)
    return scored.select("doc_id", (common.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
