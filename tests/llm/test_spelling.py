"""Spelling variants against brute force over pairs, and on odd rows."""

import random
import zlib
from collections import Counter

from gridloom.llm import spelling
from gridloom.llm.automata import Register

SCHEMA = "doc_id bigint, text string, word string, n string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                count[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
            run = ""
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    form, close = {}, {}
    for a in n:
        others = [b for b in n if near(a, b)]
        best = min(others, key=lambda b: (-n[b], b), default=None)
        close[a], form[a] = len(others), best if best is not None and n[best] >= 2 * n[a] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], close[w], n[form[w]] if form[w] else None) for w in n}


def drawn(seed, docs, letters):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(120)]
    return [(k, " ".join(r.choice(words[: r.choice((8, 30, 120))]) + r.choice(["", "", ",", "1"]) for _ in range(r.randint(0, 120)))) for k in range(docs)]


def run(spark, rows, **options):
    found = [tuple(r) for r in spelling.variants(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA), **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_variants_equal_brute_force(spark):
    odd = [(None, "WOODEN wooden Wooden× wooden"), (900, None), (901, ""), (902, " 12 ..."), (903, "\U0001f600 Àtout àtout atout Àtout Àtout atout atout"), (904, "wooden woodens woodens woodens")]
    for seed, letters in ((1, "abc"), (2, "abéÿ"), (3, "aB")):
        rows = drawn(seed, 60, letters) + odd
        rows += rows[:4]
        want = brute(rows)
        assert len(want) > 30 and any(w[1] for w in want)
        assert run(spark, rows) == want


def test_partitions_are_halved_without_losing_pairs(spark):
    """A partition of more words than allowed is cut, down to windows of one place."""
    rows = [(k, " ".join([f"commonprefix{a}{b}ending"] * 3)) for k, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")]
    rows += [(100 + k, " ".join([f"commonprefix{a}ending"] * 7)) for k, a in enumerate("abcd")]
    assert run(spark, rows, partition_words=4) == run(spark, rows) == brute(rows)


def test_empty_table_and_long_words(spark):
    assert run(spark, []) == set()
    long = "ab" * 100_000
    rows = [(k, f"{long} {long[:-1]} {long}x") for k in range(3)]
    found = {len(r[0]): (r[3], r[4]) for r in run(spark, rows)}
    assert found == {200_000: (3, 2), 199_999: (3, 1), 200_001: (3, 1)}


def test_acceptors_are_minimal_and_number_words():
    words = sorted(a + b + c for a in "xyz" for b in "pq" for c in "mn")
    register = Register()
    start = register.acceptor(words)
    assert len(register.arcs) == 4 and register.counts[start] == len(words)  # one state a layer
    assert sorted(register.replaced(start, 3)) == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and near(a, b))
