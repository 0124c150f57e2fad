"""Spelling variants: words one edit apart, grouped under the commonest of them.

Pairs come from the composition of the minimal acceptor of the vocabulary, a transducer of one edit, and the acceptor again.
The composition is cut by initial states, so that no task holds the vocabulary. A pair of lengths m and m or m + 1 first
differs at some place; a window [low, high) of places stands for the pairs that first differ there. They share the first low
letters and the last m - high ones: these are a partition's key, and its task composes acceptors of what lies between, from
the state that the shared letters lead to. Windows of a partition with too many words are halved; a window of one place has
no more words than the alphabet allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.automata import Register

RUNS = r"[A-Za-zÀ-ÿ]+"
#: Words of a partition; more are cut into halves of its window. A window of one place has at most A + A^2, A = 90 letters.
PARTITION_WORDS = 1 << 14
NEAR = "word string, n_near bigint, best_n bigint, best string"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the runs of letters of whole texts, a letter taken out where the checksum of id and run says so."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = texts.filter(F.length("run") >= least_length).select("id", common.lower_ascii(F.col("run")).alias("run"))
    checked = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = checked.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _window(m: Column, low: Column, high: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of the partition: a digest of the window and of what its words share. Should two agree, words of one window
    meet that don't share those letters; pairs are checked for that."""
    tail = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    word = F.col("word")
    shared = (F.substring(word, F.lit(1), F.col("low")), F.substring(word, F.length(word) - tail + 1, tail))
    return rows.withColumn("key", F.xxhash64("m", "low", "high", *shared))


def partitions(vocab: DataFrame, stores: common.Stores, most: int = PARTITION_WORDS, least_length: int = 5) -> DataFrame:
    """word, n, m, low, high, key: each word in the windows of its pairs with words of its length, and with shorter ones."""
    length = F.length("word")
    windows = []
    for m in (length, length - 1):
        half = F.floor((m + 1) / 2)
        windows += [_window(m, F.lit(0), half), _window(m, half, m + 1)]
    rows = vocab.select("word", "n", F.explode(F.array(*windows)).alias("w")).select("word", "n", "w.m", "w.low", "w.high").filter(F.col("m") >= least_length)
    rows, ready = _keyed(rows), []
    while True:
        large = stores(rows.filter("high - low > 1").groupBy("key").count().filter(F.col("count") > most).select("key"), "spelling-large")
        if large.isEmpty():
            break
        large = common.broadcast_if_small(large)
        ready.append(rows.join(large, "key", "left_anti").select("word", "n", "m", "low", "high", "key"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        halves = F.array(_window(F.col("m"), F.col("low"), middle), _window(F.col("m"), middle, F.col("high")))
        split = rows.join(large, "key", "left_semi").select("word", "n", F.explode(halves).alias("w")).select("word", "n", "w.m", "w.low", "w.high")
        rows = stores(_keyed(split), "spelling-halves")
    for part in ready:
        rows = rows.unionByName(part)
    return rows


def _near_in(words: list[str], counts: list[int], m: int, low: int, high: int, found: dict) -> None:
    """Adds to found {word: [near words, the largest count among them less than nothing, that word]} the pairs of a partition."""
    tail = max(m - high, 0)
    groups: dict[tuple, tuple[list, list]] = {}
    for word, n in sorted(zip(words, counts)):
        end = len(word) - tail
        sides = groups.setdefault((word[:low], word[end:]), ([], []))
        sides[len(word) > m].append((word[low:end], word, n))
    for equal, longer in groups.values():
        if not equal or len(equal) + len(longer) < 2:
            continue
        register = Register()
        short = register.acceptor([w[0] for w in equal])
        pairs = [(equal[i], equal[j]) for i, j in register.replaced(short, high - low)] if len(equal) > 1 else []
        if longer:
            long = register.acceptor([w[0] for w in longer])
            pairs += [(longer[i], equal[j]) for i, j in register.deleted(long, short, high - low)]
        for (_, a, n), (_, b, k) in pairs:
            for word, other, count in ((a, b, -k), (b, a, -n)):
                held = found.get(word)
                if held is None:
                    found[word] = [1, count, other]
                else:
                    held[0] += 1
                    if (count, other) < (held[1], held[2]):
                        held[1], held[2] = count, other


def _near(batches):
    """Rows come sorted by partition, and a partition may span batches."""
    names = ["m", "low", "high"]
    held: pd.DataFrame | None = None

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        key, *windows = (rows[c].to_numpy() for c in ["key", *names])
        words, counts = rows["word"].tolist(), rows["n"].tolist()
        changed = np.ones(len(rows), bool)
        changed[1:] = key[1:] != key[:-1]
        for w in windows:
            changed[1:] |= w[1:] != w[:-1]
        starts = np.flatnonzero(changed)
        ends = np.append(starts[1:], len(rows))
        several = ends - starts > 1
        found: dict = {}
        for s, e in zip(starts[several].tolist(), ends[several].tolist()):
            _near_in(words[s:e], counts[s:e], *(int(w[s]) for w in windows), found)
        return pd.DataFrame([(w, k, -n, b) for w, (k, n, b) in found.items()], columns=["word", "n_near", "best_n", "best"])

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch])
        last = rows["key"].to_numpy() == rows["key"].iloc[-1] if len(rows) else np.zeros(0, bool)
        held = rows[last]
        if not last.all():
            yield work(rows[~last])
    if held is not None and len(held):
        yield work(held)


def near_words(vocab: DataFrame, stores: common.Stores, most: int = PARTITION_WORDS, least_length: int = 5) -> DataFrame:
    """word, n_near, best_n, best: of each word that has near ones, their number and the commonest (of equals the first)."""
    dealt = partitions(vocab, stores, most, least_length).repartition("key").sortWithinPartitions("key", "m", "low", "high")
    some = dealt.select("key", "m", "low", "high", "word", "n").mapInPandas(_near, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("word"))).alias("b")
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.word").alias("best"))


def roots_of(edges: DataFrame, stores: common.Stores) -> DataFrame:
    """word, root of edges (word, form): forms followed to the last, twice as far in each round."""
    roots = edges.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stores(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if roots.filter("moved").isEmpty():
            return roots.drop("moved")
        roots = roots.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 2, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the vocabulary of docs.

    A null text has no words, a null id counts as the text ''; empty texts and texts without letters add nothing, repeated rows
    count each. An empty table gives no rows. Two words are near if one inserted, deleted or replaced code point tells them
    apart; form is the near word of largest n, of equal ones the first in code-point order, if its n is factor times the word's
    or more. Other columns of docs are not read. No cap is set on near words or on partitions; words may be of any length.
    """
    stores = common.Stores()
    try:
        vocab = stores(vocabulary(docs, id_col, text_col), "spelling-words")
        known = vocab.join(near_words(vocab, stores, partition_words), "word", "left")
        chosen = F.col("best_n") >= factor * F.col("n")
        known = stores(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "spelling-near")
        roots = roots_of(known.filter(F.col("form").isNotNull()).select("word", "form"), stores)
        out = known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return common.stored(out, "spelling")
    finally:
        stores.drop()
