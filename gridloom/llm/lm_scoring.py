"""Language-model scoring: bigrams and unigrams mixed by deleted interpolation.

P(w | v) = a[b] c(v w) / c(v) + u[b] c(w) / N + z[b] / (V + 1), where b is the bucket of the context's frequency c(v). The
weights of each bucket are learned by expectation maximisation on a tenth of the training documents, from counts
with that tenth deleted.

Documents are packed into chunks of some MB, one row each, with their words as numbers of a chunk's own word list. A
chunk sends its distinct n-grams, sorted by digest, with their counts to the shards that hold the digests' ranges, one
packed message for each shard that it has any n-gram of; a shard adds up what all chunks say and answers each message
with the totals, in the same order. A shard gets a bounded number of tokens' n-grams, so shards grow with the text, and
there are never more messages than n-grams. A very frequent n-gram costs one entry a chunk, and an answer no n-grams.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Bytes of text in a chunk, tokens whose n-grams a shard gets (about), buckets of context frequency (powers of two), steps of a factor
#: of ten by which probabilities are binned for learning the weights (they bound what the driver gets), rounds of EM,
#: least weight of the rest.
CHUNK_BYTES, SHARD_TOKENS, BUCKETS, BINS_A_DECADE, EM_ROUNDS, LEAST_WEIGHT = 6 << 20, 3 << 19, 32, 48, 60, 1e-6
TEST, LEARN, DELETED = 0, 1, 2
END = np.uint64(0x9E3779B97F4A7C15)


def pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def least_kind(array: np.ndarray) -> tuple[str, np.ndarray]:
    top = int(array.max()) if len(array) else 0
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return kind, array.astype(kind)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_digest(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0xD6E8FEB86659FD93) + mixed(second))


CHUNK_SCHEMA = "chunk long, deleted boolean, n_tokens long, n_train long, doc_ids binary, folds binary, lengths binary, words binary, token_kind string, tokens binary"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents, packed; those of the deleted tenth are in chunks of their own."""
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.when(common.remainder(F.col(id_col), 10) == 0, TEST).when(common.remainder(F.col(id_col), 10) == 9, DELETED).otherwise(LEARN).alias("fold"),
    )

    def run(batches):
        import pickle

        from pyspark import TaskContext

        numbers_of = itertools.count(TaskContext.get().partitionId() << 32)  # the same when a task runs again
        open_chunks: dict[bool, list] = {}

        def closed(deleted):
            ids, folds, lengths, words, tokens = open_chunks.pop(deleted)[:5]
            kind, numbers = least_kind(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
            listed = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            return {
                "chunk": next(numbers_of), "deleted": deleted, "n_tokens": sum(lengths), "n_train": sum(n for n, fold in zip(lengths, folds) if fold != TEST), "doc_ids": pickle.dumps(ids), "folds": bytes(folds), "lengths": pack(np.array(lengths, "<u4")),
                "words": listed.tobytes(), "token_kind": kind, "tokens": pack(numbers),
            }

        for batch in batches:
            done = []
            for doc_id, text, fold in zip(batch["doc_id"], batch["text"], batch["fold"]):
                deleted = fold == DELETED
                if deleted not in open_chunks:
                    open_chunks[deleted] = [[], [], [], {None: 0}, [], 0]
                c = open_chunks[deleted]
                raw = text.encode().lower()
                found, known = raw.split(), c[3]
                numbers = [known.setdefault(w, len(known)) for w in found]
                numbers.append(0)
                c[0].append(doc_id)
                c[1].append(int(fold))
                c[2].append(len(numbers))
                c[4].append(np.array(numbers, np.int64))
                c[5] += len(raw)
                if c[5] >= chunk_bytes:
                    done.append(closed(deleted))
            if done:
                yield pd.DataFrame(done)
        if open_chunks:
            yield pd.DataFrame([closed(k) for k in list(open_chunks)])
        common.release()

    return rows.mapInPandas(run, CHUNK_SCHEMA)


class Chunk:
    """A chunk's tokens, with the distinct unigrams and bigrams that they make, in a fixed order."""

    def __init__(self, row):
        self.folds = np.frombuffer(row["folds"], np.uint8)
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = unpack(row["tokens"], row["token_kind"]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0  # a text begins after an end
        self.before = before
        self.pairs, self.pair_of = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        self.fold_of = np.repeat(self.folds, self.lengths)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the n-grams (words, then pairs) in the order of their digests, and those."""
        keys = np.concatenate([self.words, bigram_digest(self.words[self.pairs // len(self.words)], self.words[self.pairs % len(self.words)])])
        order = np.argsort(keys, kind="stable")
        return order, keys[order]

    def counts(self) -> np.ndarray:
        """Of each key in the training documents."""
        train = self.fold_of != TEST
        return np.concatenate([np.bincount(self.tokens[train], minlength=len(self.words)), np.bincount(self.pair_of[train], minlength=len(self.pairs))])


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each digest: equal ranges, in order."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Their differences, byte by byte: the leading bytes are mostly 0."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


MESSAGE_SCHEMA = "shard int, chunk long, deleted boolean, keys binary, is_word binary, counts_kind string, counts binary"


def messages(packed: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                chunk = Chunk(row)
                order, keys = chunk.order()
                counts, is_word, shard = chunk.counts()[order], order < len(chunk.words), shards_of(keys, shards)
                own, starts = np.unique(shard, return_index=True)
                out = []
                for s, a, b in zip(own.tolist(), starts, [*starts[1:], len(keys)]):
                    kind, n = least_kind(counts[a:b])
                    out.append((s, row["chunk"], row["deleted"], pack_sorted(keys[a:b]), np.packbits(is_word[a:b]).tobytes(), kind, pack(n)))
                yield pd.DataFrame(out, columns=["shard", "chunk", "deleted", "keys", "is_word", "counts_kind", "counts"])
        common.release()

    return packed.mapInPandas(run, MESSAGE_SCHEMA)


ANSWER_SCHEMA = "shard int, chunk long, total_kind string, total binary, rest_kind string, rest binary, types long"


def answers(sent: DataFrame, shards: int) -> DataFrame:
    """For each message the totals of its keys and, to chunks of the deleted tenth, those without that tenth; the first
    answer of a shard has its number of distinct training words."""

    def answered(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in frame["keys"]]
        counts = [unpack(c, k).astype(np.int64) for c, k in zip(frame["counts"], frame["counts_kind"])]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(unique)).astype(np.int64)
        gone = np.concatenate([c if d else np.zeros_like(c) for c, d in zip(counts, frame["deleted"])])
        rest = total - np.bincount(place, gone, len(unique)).astype(np.int64)
        word = np.zeros(len(unique), bool)
        out, at = [], 0
        for chunk, deleted, bits, k in zip(frame["chunk"], frame["deleted"], frame["is_word"], keys):
            own = place[at : at + len(k)]
            at += len(k)
            word[own[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(k)).astype(bool)]] = True
            a, x = least_kind(total[own])
            b, y = least_kind(rest[own]) if deleted else ("", None)
            out.append([int(frame["shard"].iloc[0]), chunk, a, pack(x), b, pack(y) if deleted else b"", 0])
        out[0][-1] = int((word & (total > 0)).sum())
        return pd.DataFrame(out, columns=["shard", "chunk", "total_kind", "total", "rest_kind", "rest", "types"])

    def run(batches):
        for group in common.contiguous_groups(batches, ["shard"]):
            yield answered(group)
        common.release()

    return sent.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInPandas(run, ANSWER_SCHEMA)


def put_together(chunk: Chunk, replies: list[dict], which: str) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the chunk's words, counts of its pairs) from the answers of all shards."""
    order = chunk.order()[0]
    found = np.zeros(len(order), np.int64)
    found[order] = np.concatenate([unpack(r[which], r[f"{which}_kind"]) for r in sorted(replies, key=lambda r: r["shard"])])
    return found[: len(chunk.words)], found[len(chunk.words) :]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 and on by powers of two."""
    return np.where(context > 0, np.minimum(np.frexp(np.maximum(context, 1))[1], BUCKETS - 1), 0)


def parts(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, tokens: float):
    """(bucket, bigram estimate, unigram estimate) of each token."""
    context = words[chunk.before]
    bigram = np.divide(pairs[chunk.pair_of], context, out=np.zeros(len(context)), where=context > 0)
    return bucket(context), bigram, words[chunk.tokens] / max(tokens, 1)


def binned(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else the place of its logarithm, from 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(1, 1 + np.rint(-np.log10(p) * BINS_A_DECADE)), 0).astype(np.int64)


def learned_weights(events: list[tuple[int, float, float, int]], types: int) -> np.ndarray:
    """Rows of the weights of bigram, unigram and rest for each bucket, by EM over rows of the bucket, the two estimates
    (the geometric means of a bin) and their count."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    table = np.array(sorted(events), float).reshape(-1, 4)
    for b in range(BUCKETS):
        own = table[table[:, 0] == b]
        if not len(own):
            if b:
                weights[b] = weights[b - 1]
            continue
        p = np.stack([own[:, 1], own[:, 2], np.full(len(own), 1 / (types + 1))], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
        w = np.maximum(w, [0, LEAST_WEIGHT, LEAST_WEIGHT])
        weights[b] = w / w.sum()
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Documents whose crc32(doc_id as text) mod 10 isn't 0 are learned from. A null text counts as empty: its one token is
    the end. Repeated rows give repeated rows, and each is learned from. Words are told apart by 64-bit digests.
    Without training documents every count is 0 and the scores rest on the uniform part alone.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    packed = common.stored(chunks(docs, id_col, text_col, chunk_bytes), "lm-chunks")
    tokens, without, every = packed.agg(F.sum("n_train"), F.sum(F.when(~F.col("deleted"), F.col("n_train"))), F.sum("n_tokens")).first()
    if tokens is None:
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    tokens, without = int(tokens), int(without or 0)
    shards = max(1, round(every / SHARD_TOKENS))
    replies = common.stored(answers(messages(packed, shards), shards), "lm-answers")
    common.free_shuffles(spark)
    types = int(replies.agg(F.sum("types")).first()[0] or 0)

    def answered(own: DataFrame, to: DataFrame) -> DataFrame:
        return own.join(to.groupBy("chunk").agg(F.collect_list(F.struct("shard", "total_kind", "total", "rest_kind", "rest")).alias("replies")), "chunk")

    def events(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                chunk = Chunk(row)
                # the tenth's own tokens are left out of N as out of the counts
                words, pairs = put_together(chunk, row["replies"], "rest")
                b, p2, p1 = parts(chunk, words, pairs, without)
                keys, place, n = np.unique(np.stack([b, binned(p2), binned(p1)]), axis=1, return_inverse=True, return_counts=True)
                logs = [np.bincount(place.ravel(), np.log(np.where(p > 0, p, 1.0)), len(n)) for p in (p2, p1)]
                yield pd.DataFrame({"bucket": keys[0], "p2": keys[1], "p1": keys[2], "n": n, "log2": logs[0], "log1": logs[1]})
        common.release()

    deleted = packed.filter("deleted")
    found = answered(deleted, replies.join(deleted.select("chunk"), "chunk", "left_semi")).mapInPandas(events, "bucket long, p2 long, p1 long, n long, log2 double, log1 double").groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"), F.sum("log2").alias("log2"), F.sum("log1").alias("log1"))
    mean = lambda bin_, logs: F.when(F.col(bin_) > 0, F.exp(F.col(logs) / F.col("n"))).otherwise(0.0)
    weights = learned_weights([tuple(r) for r in found.select("bucket", mean("p2", "log2"), mean("p1", "log1"), "n").collect()], types)
    weights = spark.sparkContext.broadcast(weights)
    common.free_shuffles(spark)

    def scored(batches):
        import pickle

        for batch in batches:
            for row in batch.to_dict("records"):
                chunk = Chunk(row)
                words, pairs = put_together(chunk, row["replies"], "total")
                b, p2, p1 = parts(chunk, words, pairs, tokens)
                w = weights.value[b]
                model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1))
                c = words[chunk.tokens]
                base = np.log10((c + 0.1) / (tokens + 0.1 * (types + 1)))
                yield pd.DataFrame({
                    "doc_id": pickle.loads(row["doc_ids"]), "held_out": chunk.folds == TEST, "n_tokens": chunk.lengths,
                    "n_known": np.add.reduceat((c > 0).astype(np.int64), chunk.starts), "train_tokens": tokens,
                    "base_score": np.add.reduceat(base, chunk.starts), "score": np.add.reduceat(model, chunk.starts),
                })
        common.release()

    out = answered(packed, replies).mapInPandas(scored, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
