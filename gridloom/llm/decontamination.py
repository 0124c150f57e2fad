"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised words.

A text becomes its words, each after one space, and a final space; a window of words is a pattern in the same form. A
table gives for the block of bytes that ends at a place how far every pattern lets the search move on; where it
gives 0, the block's bucket holds the patterns to compare. Patterns of like length share tables, as the shortest of
a set bounds the moves.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Bytes of a block at most, and bytes of patterns in one set of tables: a larger benchmark is searched for in several
#: sets, one pass of the same tasks after another, each with a broadcast of bounded size.
BLOCK, SET_BYTES = 10, 32 << 20

#: What isn't part of a word becomes a space, A-Z become a-z, and bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class WuManber:
    """patterns: {b' word word ... ': item numbers}."""

    def __init__(self, patterns: dict[bytes, list[int]]):
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for pattern in patterns:
            by_length[len(pattern).bit_length()].append(pattern)
        self.patterns, self.tables = patterns, [self.built(group) for group in by_length.values()]

    @staticmethod
    def built(group: list[bytes]):
        least = min(map(len, group))
        block = min(BLOCK, least)
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for pattern in group:
            for end in range(block, least + 1):
                key = pattern[end - block : end]
                if least - end < shift.get(key, least):
                    shift[key] = least - end
            buckets[pattern[least - block : least]].append(pattern)
        return least, block, least - block + 1, shift, dict(buckets)

    def occurrences(self, text: bytes):
        """(start, pattern) of every occurrence."""
        for least, block, far, shift, buckets in self.tables:
            at, size, move = least, len(text), shift.get
            while at <= size:
                step = move(text[at - block : at], far)
                if step:
                    at += step
                    continue
                start = at - least
                for pattern in buckets[text[at - block : at]]:
                    if text.startswith(pattern, start):
                        yield start, pattern
                at += 1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word, end) of the hit stretches, and the items found."""
        text = b" " + b" ".join(words) + b" "
        found = sorted(self.occurrences(text))
        stretches, items, at, word = [], set(), 0, 0
        for start, pattern in found:
            word += text.count(b" ", at, start)
            at = start
            items.update(self.patterns[pattern])
            stretches.append((word, word + pattern.count(b" ") - 1))
        return stretches, items


def windows(words: list[bytes], size: int) -> set[bytes]:
    """The patterns of an item: each stretch of size words, or all of its words where it has fewer, but not none."""
    return {b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1))} if words else set()


def pattern_sets(benchmark: DataFrame, size: int, item_col: str, text_col: str):
    """(patterns, item ids) of as many items as SET_BYTES allow, again and again until all items are through."""
    patterns, items, held = defaultdict(list), [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        if row["item"] is None:
            continue
        found = windows(normal_words(row["text"]), size)
        for pattern in found:
            patterns[pattern].append(len(items))
        items.append(row["item"])
        held += sum(map(len, found)) + len(row["item"])
        if held > SET_BYTES:
            yield dict(patterns), items
            patterns, items, held = defaultdict(list), [], 0
    yield dict(patterns), items


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings of the items with an occurring window), hits (array of
    [first word, end) structs that don't touch), contaminated.

    Null texts have no words; items without words or without an id never occur. Items that share an id are one item
    with the windows of each. Repeated rows give repeated rows. An occurrence is one of whole words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<int>")
    rows = rows.select("*", none.alias("starts"), none.alias("ends"), none.cast("array<string>").alias("items"))

    def searched(shared, result):
        """Tasks that add what one set finds to starts, ends and items, and give the frame that result makes of a batch,
        the words of its texts and those three."""

        def run(batches):
            patterns, names = shared.value
            search = WuManber(patterns)
            for batch in batches:
                texts, found = [], []
                for starts, ends, items, text in zip(batch["starts"], batch["ends"], batch["items"], batch["text"]):
                    words = normal_words(text)
                    stretches, own = search.hits(words)
                    texts.append(len(words))
                    found.append(([*starts, *(a for a, _ in stretches)], [*ends, *(b for _, b in stretches)], [*items, *(names[k] for k in own)]))
                done = result(batch, texts, found)
                done.insert(0, "doc_id", batch["doc_id"].to_numpy())
                yield done
            del search, patterns, names
            common.release()

        return run

    def carried(batch, n_words, found):
        done = pd.DataFrame(found, columns=["starts", "ends", "items"])
        done.insert(0, "text", batch["text"].to_numpy())
        return done

    def finished(batch, n_words, found):
        out = []
        for n, (starts, ends, items) in zip(n_words, found):
            merged: list[list[int]] = []
            for a, b in sorted(zip(map(int, starts), map(int, ends))):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append((n, sum(b - a for a, b in merged), sorted(set(items)), [{"first": a, "end": b} for a, b in merged], bool(merged)))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "hits", "contaminated"])

    *before, last = (spark.sparkContext.broadcast(x) for x in pattern_sets(benchmark, window, item_col, item_text_col))
    for shared in before:
        rows = rows.mapInPandas(searched(shared, carried), "doc_id string, text string, starts array<int>, ends array<int>, items array<string>")
    kinds = "doc_id string, n_words long, n_hit long, items array<string>, hits array<struct<first: int, end: int>>, contaminated boolean"
    return rows.mapInPandas(searched(last, finished), kinds).withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[id_col]))
