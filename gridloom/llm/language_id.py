"""Language identification by nearest centroids of TF-IDF byte n-gram vectors, several centroids a language.

A text that is farther from its nearest centroid than nearly all training rows were from theirs is rejected: one
centroid's nearness says little then, and the language whose centroids are nearest on average is given instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Places of the hashed n-gram vectors, lengths of the n-grams in bytes, rows of each language that the centroids are
#: clustered from at most (about), centroids a language, rounds of clustering, bytes of a text hashed at once, the share of
#: a centroid's training rows that lie beyond its distance of rejection, and the rows that tell it at least.
PLACES, SIZES, SAMPLE_EACH, CENTROIDS, ROUNDS, BLOCK, BEYOND, TELL_LEAST = 4096, (1, 2, 3), 600, 3, 12, 1 << 20, 0.01, 20
UNKNOWN = "und"

#: ASCII characters other than letters separate words; bytes of other characters stay.
NORMAL = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts_of(text: str | None) -> np.ndarray:
    """How often each place is hit by the n-grams of the text's words, a space before and after each word."""
    words = (text or "").lower().encode().translate(NORMAL).split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    total = np.zeros(PLACES, np.int64)
    for start in range(0, len(raw), BLOCK):
        block = raw[start : start + BLOCK + max(SIZES) - 1].astype(np.uint32)
        for size in SIZES:
            n = min(BLOCK, len(block) - size + 1)
            if n <= 0:
                continue
            code = np.full(n, size, np.uint32)
            for k in range(size):
                code = (code << np.uint32(8)) | block[k : k + n]
            place = (code * np.uint32(2654435761)) >> np.uint32(32 - PLACES.bit_length() + 1)
            total += np.bincount(place, minlength=PLACES)
    return total


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (or zero): log-scaled counts times idf."""
    found = np.zeros((len(texts), PLACES), np.float32)
    for k, text in enumerate(texts):
        found[k] = np.log1p(counts_of(text)) * idf
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, length, out=found, where=length > 0)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.remainder(F.col("doc_id"), 4) != 2))


class Model:
    """langs, centroids and least (cosines below which a centroid rejects) go together."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least
        self.names = sorted(set(langs))
        self.of = np.array([[lang == name for lang in langs] for name in self.names], np.float32)

    def predict(self, texts) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether the nearest centroid rejected, of each text."""
        result = []
        for start in range(0, len(texts), 256):
            part = texts[start : start + 256]
            if not self.langs:
                result += [(UNKNOWN, 0.0, True)] * len(part)
                continue
            cosine = vectors(part, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            average = (cosine @ self.of.T / self.of.sum(axis=1)).argmax(axis=1)
            for text, row, k, a in zip(part, cosine, best, average):
                if not has_letter(text):
                    result.append((UNKNOWN, 0.0, True))
                    continue
                rejected = bool(row[k] < self.least[k])
                result.append((self.names[a] if rejected else self.langs[k], float(min(max(row[k], 0.0), 1.0)), rejected))
        return result


def rejections(rows: np.ndarray, centres: np.ndarray, beyond: float = BEYOND) -> np.ndarray:
    """For each centre the cosine that all but a share of the rows nearest to it reach; of all rows where it has few."""
    cosine = rows @ centres.T
    nearest, own = cosine.argmax(axis=1), cosine.max(axis=1)
    every = np.quantile(own, beyond)
    return np.array([np.quantile(own[nearest == k], beyond) if (nearest == k).sum() >= TELL_LEAST else every for k in range(len(centres))])


def clustered(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first centroids are the mean and then, each time, the row farthest from those chosen."""

    def unit(x):
        return x / max(np.linalg.norm(x), 1e-12)

    chosen = [unit(rows.mean(axis=0))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[(rows @ np.array(chosen).T).max(axis=1).argmin()])
    centres = np.array(chosen, np.float32)
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        centres = np.array([unit(rows[nearest == j].mean(axis=0)) if (nearest == j).any() else centres[j] for j in range(len(centres))], np.float32)
    return centres


def train(docs: DataFrame, sample_each: int = SAMPLE_EACH, beyond: float = BEYOND, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Document frequencies come from all training rows (text and lang not null, crc32(doc_id as text) mod 4 not 2),
    centroids from a sample of about sample_each rows a language, drawn by the digest of the id; of a repeated row one
    is in the sample. A centroid rejects texts farther from it than all but a share of beyond of its training rows."""
    rows = training_rows(docs, id_col, text_col, lang_col)

    def frequencies(batches):
        found, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found += counts_of(text) > 0
            n += len(batch)
        if n:
            yield pd.DataFrame({"place": np.arange(PLACES + 1), "n": np.append(found, n)})

    def per_row(batches):
        for batch in batches:
            packed = [counts_of(t).astype("<u4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "counts": packed})

    totals = rows.select("text").mapInPandas(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(PLACES + 1)
    for r in totals:
        seen[r["place"]] = r["n"]
    idf = (np.log((1 + seen[PLACES]) / (1 + seen[:PLACES])) + 1).astype(np.float32)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    part = F.lit(0.0)
    for lang, count in counts.items():
        part = F.when(F.col("lang") == lang, min(1.0, sample_each / count)).otherwise(part)
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < part * 1_000_000).withColumn("doc_id", F.col("doc_id").cast("string"))
    sample = drawn.mapInPandas(per_row, "doc_id string, lang string, counts binary").distinct().collect()
    sample.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["counts"]))
    langs, centres, least = [], [], []
    for lang in sorted(counts):
        own = np.array([np.log1p(np.frombuffer(r["counts"], "<u4").astype(np.float32)) * idf for r in sample if r["lang"] == lang], np.float32)
        own = own[np.linalg.norm(own, axis=1) > 0] if len(own) else own
        if len(own):
            own /= np.linalg.norm(own, axis=1, keepdims=True)
            found = clustered(own, CENTROIDS)
            langs += [lang] * len(found)
            centres.append(found)
            least.append(rejections(own, found, beyond))
    return Model(idf, langs, np.concatenate(centres) if centres else np.zeros((0, PLACES), np.float32), np.concatenate([*least, np.zeros(0)]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs, from its whole text alone. score is the cosine with
    the nearest centroid; where that rejects the text, lang_pred is the language nearest on average. A text that is null
    or has no letter is 'und' with score 0 and rejected; so is every text if there was nothing to learn from. Repeated
    rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        found = shared.value.predict(texts)
        return pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    scored = common.map_texts(docs, work, "lang_pred string, score double, rejected boolean", id_col, text_col, nulls=True)
    return scored.select("doc_id", (common.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
