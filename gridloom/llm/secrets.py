"""Secret scans: fixed formats found by patterns, and further ones by probabilistic automata inferred from them.

Labelled credentials are those that the patterns find, with the assignment around them, and examples of public formats.
The prefix tree of each kind, with counts, is folded: two states whose outcomes don't differ statistically (Hoeffding's
bound) become one, and so do their successors. What remains is a probabilistic automaton of the format, which goes with
the lengths of its examples. Every candidate, an unbroken run of credential characters, is scored: the best automaton's
log-likelihood against that of ordinary text, by itself and with the assignment to its left. Ordinary text is a chain of
characters, learned from how often one follows another in all texts outside of what the patterns find.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

KINDS = ("assign", "access", "hex", "format")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: A candidate is a run of 16 or more, without the full stops around it, and the signs = that may end it; its left context is
#: the assignment before it.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{14,}[A-Za-z0-9+/_-]={0,2}")
NAME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")

#: Labelled credentials of each kind at most, the characters of a piece (longer ones are learned from piece by piece),
#: Hoeffding's confidence, the log-odds over ordinary text that make a candidate a secret, and how much less likely than
#: a format's usual values one of that format may be.
EXAMPLES, PIECE, ALPHA, ODDS, SLACK = 300, 256, 0.05, 25.0, 8.0
#: Pairs of characters that the prior of ordinary text counts as, after each character.
PRIOR = 50.0

# Public formats of credentials, as parts that are texts or (characters, least, most).
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM, HEX_DIGITS, URL_SAFE = LOWER + UPPER + DIGITS, DIGITS + "abcdef", LOWER + UPPER + DIGITS + "_-"
PUBLIC_FORMATS = {
    "digitalocean": ["dop_v1_", (HEX_DIGITS, 64, 64)],
    "github": ["ghp_", (ALNUM, 36, 36)],
    "github_app": ["ghs_", (ALNUM, 36, 36)],
    "github_fine": ["github_pat_", (ALNUM, 22, 22), "_", (ALNUM, 59, 59)],
    "github_oauth": ["gho_", (ALNUM, 36, 36)],
    "gitlab": ["glpat-", (URL_SAFE, 20, 20)],
    "google": ["AIza", (URL_SAFE, 35, 35)],
    "huggingface": ["hf_", (LOWER + UPPER, 34, 34)],
    "npm": ["npm_", (ALNUM, 36, 36)],
    "openai": ["sk-", (ALNUM, 32, 64)],
    "sendgrid": ["SG.", (URL_SAFE, 22, 22), ".", (URL_SAFE, 43, 43)],
    "shopify": ["shpat_", (HEX_DIGITS, 32, 32)],
    "slack_app": ["xapp-", (DIGITS, 1, 1), "-", (UPPER + DIGITS, 9, 12), "-", (DIGITS, 12, 14), "-", (HEX_DIGITS, 64, 64)],
    "slack_bot": ["xoxb-", (DIGITS, 10, 13), "-", (DIGITS, 10, 13), "-", (ALNUM, 24, 32)],
    "slack_user": ["xoxp-", (DIGITS, 12, 12), "-", (DIGITS, 12, 12), "-", (DIGITS, 12, 12), "-", (HEX_DIGITS, 32, 32)],
    "stripe": ["sk_live_", (ALNUM, 24, 99)],
    "stripe_restricted": ["rk_live_", (ALNUM, 24, 99)],
    "stripe_test": ["sk_test_", (ALNUM, 24, 99)],
    "twilio": ["SK", (HEX_DIGITS, 32, 32)],
}
#: Examples that stand for each public format.
EACH_FORMAT = 200


def drawn(parts: list, rng: random.Random) -> str:
    """A credential of a public format."""
    return "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(*p[1:]))) for p in parts)


def public_examples(seed: int = 11) -> dict[str, list[bytes]]:
    """Labelled credentials of the public formats, drawn at random."""
    rng = random.Random(seed)
    return {name: [drawn(parts, rng).encode() for _ in range(EACH_FORMAT)] for name, parts in PUBLIC_FORMATS.items()}


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, each kind leftmost and without overlaps."""
    found = []
    lower = raw.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    return found


def symbol(c: int) -> str:
    """The class of a byte: digits, a-f, other small letters, A-F, other capitals, and the rest each by itself."""
    if 48 <= c <= 57:
        return "0"
    if 97 <= c <= 102:
        return "a"
    if 103 <= c <= 122:
        return "g"
    if 65 <= c <= 70:
        return "A"
    if 71 <= c <= 90:
        return "G"
    return chr(c)


SYMBOLS = [symbol(c) for c in range(256)]
#: Bytes that a class stands for; classes that a state may meet.
WIDTH = Counter(SYMBOLS)
CLASSES = len(WIDTH)


class Automaton:
    """states: for each its successors {class: state} and how often each byte came from it; lengths: of the examples.

    Outcomes are smoothed: a class that a state never met leads back to it, at a cost. Besides its log-likelihood a value has
    a deficit: how much less likely it is than what the states on its way and the lengths give on average."""

    def __init__(self, states: list[tuple[dict[str, int], Counter]], lengths: Counter):
        self.moves: list[list[tuple[int, float]]] = []
        self.usual: list[float] = []
        for k, (successors, seen) in enumerate(states):
            by_class: Counter = Counter()
            for c, n in seen.items():
                by_class[SYMBOLS[c]] += n
            total = sum(seen.values()) + 0.1 * CLASSES
            self.moves.append([
                (successors.get(s, k), math.log((by_class[s] + 0.1) / total * (seen[c] + 0.5) / (by_class[s] + 0.5 * WIDTH[s])))
                for c, s in enumerate(SYMBOLS)
            ])
            gains = np.array([gain for _, gain in self.moves[-1]])
            self.usual.append(float((np.exp(gains) * gains).sum()))
        n, rest = sum(lengths.values()), len(lengths)
        top = 2 * max(lengths, default=1)
        self.lengths = {size: math.log((count + rest / top) / (n + rest)) for size, count in lengths.items()}
        self.other_length = math.log(rest / top / (n + rest)) if n else -math.inf
        self.usual_length = sum(lengths[size] / n * gain for size, gain in self.lengths.items()) if n else 0.0

    def score(self, value: bytes) -> tuple[float, float]:
        """The log-likelihood of a value and its deficit, 0 or more on average."""
        state, total = 0, self.lengths.get(len(value), self.other_length)
        usual = self.usual_length
        for c in value:
            usual += self.usual[state]
            state, gain = self.moves[state][c]
            total += gain
        return total, usual - total

    def log_likelihood(self, value: bytes) -> float:
        return self.score(value)[0]


def infer(values: list[bytes], alpha: float = ALPHA) -> Automaton:
    """Folds the prefix tree of values: states are taken breadth first, and each is merged into a settled state with compatible
    outcomes, the one before it or else the one most often met, or else settled itself. The order matters where a state was
    met a few times only and much is compatible with it: it goes on with what it is part of."""
    children: list[dict[str, int]] = [{}]
    count, ends, seen = [0], [0], [Counter()]
    for value in values:
        at = 0
        count[0] += 1
        for c in value:
            s = SYMBOLS[c]
            seen[at][c] += 1
            if s not in children[at]:
                children[at][s] = len(children)
                children.append({})
                count.append(0)
                ends.append(0)
                seen.append(Counter())
            at = children[at][s]
            count[at] += 1
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if a == b:
                continue
            if differ(ends[a], count[a], ends[b], count[b]):
                return False
            for s in children[a].keys() | children[b].keys():
                x, y = children[a].get(s), children[b].get(s)
                if differ(moves(a, s), count[a], moves(b, s), count[b]):
                    return False
                if x is not None and y is not None:
                    pairs.append((x, y))
        return True

    taken: list[Counter] = [Counter({s: count[c] for s, c in kids.items()}) for kids in children]

    def moves(state: int, s: str) -> int:
        return taken[state][s]

    def fold(a: int, b: int) -> None:
        """b's tree into a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            count[a] += count[b]
            ends[a] += ends[b]
            taken[a].update(taken[b])
            seen[a].update(seen[b])
            for s, y in children[b].items():
                if s in children[a]:
                    pairs.append((children[a][s], y))
                else:
                    children[a][s] = y

    settled, waiting = [0], deque((0, s) for s in sorted(children[0]))
    while waiting:
        parent, s = waiting.popleft()
        state = children[parent][s]
        if state in settled:
            continue
        for old in sorted(settled, key=lambda x: (x != parent, -count[x])):
            if compatible(old, state):
                children[parent][s] = old
                before = set(children[old])
                fold(old, state)
                waiting.extend((old, t) for t in sorted(set(children[old]) - before))
                break
        else:
            settled.append(state)
            waiting.extend((state, t) for t in sorted(children[state]))
    number = {state: k for k, state in enumerate(settled)}
    return Automaton([({s: number.get(c, 0) for s, c in children[state].items()}, seen[state]) for state in settled], Counter(map(len, values)))


class Ordinary:
    """Ordinary text, a chain of bytes. Before anything is counted: characters of one kind after another (small letters,
    capitals, digits, the rest), changing kind once in ten characters. Counts of pairs, of all texts, outweigh that prior.

    pairs[a, b] is how often byte b follows byte a; bytes that no candidate holds count as the byte 0."""

    KIND = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in range(256)])
    WITHIN = np.array([1 / 26, 1 / 26, 1 / 10, 1 / 8])
    HELD = np.array([c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" for c in range(256)])
    #: A byte as it is counted.
    COUNTED = np.where(HELD, np.arange(256), 0).astype("u1")

    def __init__(self, pairs: np.ndarray | None = None):
        prior = np.where(self.KIND[:, None] == self.KIND[None, :], 0.9, 0.1 / 3) * self.WITHIN[self.KIND][None, :]
        prior[~self.HELD] = self.WITHIN[self.KIND] * 0.1 / 3
        counted = np.zeros((256, 256)) if pairs is None else pairs.astype(float)
        # a candidate's byte is followed by another one of it: what ends a run takes no part
        counted[:, ~self.HELD] = 0
        chances = (counted + PRIOR * prior) / (counted.sum(axis=1, keepdims=True) + PRIOR)
        self.moves = np.log(chances)

    def log_likelihood(self, value: bytes) -> float:
        at = self.COUNTED[np.frombuffer(b"\0" + value, "u1")]
        return float(self.moves[at[:-1], at[1:]].sum())


def ordinary_of(docs: DataFrame, text_col: str = "text") -> Ordinary:
    """Ordinary text as all docs have it: pairs of bytes are counted in tasks, outside of what the patterns find, and at most
    69 x 69 sums come to the driver. Repeated rows count as often as they are there; null and empty texts have no pairs."""

    def count(batches):
        sums = np.zeros(256 * 256, "i8")
        for batch in batches:
            texts = []
            for raw in map(str.encode, batch["text"]):
                at = Ordinary.COUNTED[np.frombuffer(b"\0" + raw, "u1")]
                for start, end, _ in base_spans(raw):
                    at[start + 1 : end + 1] = 0
                texts.append(at)
            row = np.concatenate([*texts, np.zeros(0, "u1")])
            for before in range(0, len(row) - 1, 1 << 20):
                part = row[before : before + (1 << 20) + 1].astype("u2")
                sums += np.bincount(part[:-1] * np.uint16(256) + part[1:], minlength=256 * 256)
        common.release()
        some = np.flatnonzero(sums)
        yield pd.DataFrame({"a": some // 256, "b": some % 256, "n": sums[some]})

    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    pairs = np.zeros((256, 256))
    for a, b, n in texts.mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n")).collect():
        pairs[a, b] = n
    return Ordinary(pairs)


class Scorer:
    """Likelihood of a candidate under the automata of the labelled formats, against ordinary text."""

    def __init__(self, examples: dict[str, list[bytes]], alpha: float = ALPHA, ordinary: Ordinary | None = None):
        self.formats = {kind: infer(values, alpha) for kind, values in sorted(examples.items()) if values}
        self.ordinary = ordinary or Ordinary()

    def odds(self, value: bytes, context: bytes = b"") -> float:
        """The best log-odds of value, by itself or after its context; context alone is no evidence. What a deficit has
        beyond SLACK counts tenfold against a format: text may be rare and yet not of that format."""
        plain, best = self.ordinary.log_likelihood(value), -math.inf
        for kind, automaton in self.formats.items():
            if kind != "assign":
                likely, deficit = automaton.score(value)
                best = max(best, likely - plain - 10 * max(0.0, deficit - SLACK))
            elif context:
                likely, deficit = automaton.score(context + value)
                best = max(best, likely - self.ordinary.log_likelihood(context) - plain - 10 * max(0.0, deficit - SLACK))
        return best


def examples_of(docs: DataFrame, text_col: str = "text", most: int = EXAMPLES) -> dict[str, list[bytes]]:
    """Labelled credentials by kind: of the distinct ones that the patterns find in all docs (assignments whole), those with
    the least digests, most of each kind; and those of the public formats. One of more than PIECE characters counts as its
    pieces, and first pieces come before second ones."""
    from pyspark.sql import Window

    def values(batches):
        for batch in batches:
            rows = {
                (kind, at // PIECE, raw[start + at : min(end, start + at + PIECE)])
                for raw in map(str.encode, batch["text"]) for start, end, kind in base_spans(raw) for at in range(0, end - start, PIECE)
            }
            yield pd.DataFrame(list(rows), columns=["kind", "piece", "value"])
        common.release()

    found = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull()).mapInPandas(values, "kind string, piece long, value binary")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("piece", F.xxhash64("value"), "value"))
    rows = found.distinct().withColumn("place", place).filter(F.col("place") <= most).collect()
    labelled = {kind: sorted(bytes(r["value"]) for r in rows if r["kind"] == kind) for kind in KINDS[:3]}
    return labelled | public_examples()


SPANS = "array<struct<kind: string, start: int, end: int, odds: double>>"


def scan(docs: DataFrame, examples: dict[str, list[bytes]], odds: float = ODDS, id_col: str = "doc_id", text_col: str = "text", ordinary: Ordinary | None = None) -> DataFrame:
    """doc_id, spans and best_odds for each row of docs. spans is an array of structs (kind, start, end, odds) by start, then
    kind as listed in KINDS; places are code points, the end is exclusive. The kinds assign, access and hex are those of
    the patterns, and their odds are those of the best candidate within; format are candidates whose log-odds under the
    automata of examples reach odds and that lie in none of the others. best_odds is the greatest of all candidates, null
    where a text has none.

    A null text counts as empty and has no spans; repeated rows give repeated rows; without examples there are no spans
    of the kind format. Texts are scanned whole. ordinary is what ordinary_of learned, or else the prior alone.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(examples, ordinary=ordinary))

    def work(texts):
        return pd.DataFrame([spans_of(t, scorer.value, odds) for t in texts], columns=["spans", "best_odds"])

    return common.map_texts(docs, work, f"spans {SPANS}, best_odds double", id_col, text_col)


def context_before(raw: bytes, at: int) -> bytes:
    """The assignment that ends at a place: a name of two characters or more, a sign and what may stand between; else nothing."""

    def back(k: int, of) -> int:
        while k and raw[k - 1] in of:
            k -= 1
        return k

    def quote(k: int) -> int:
        return k - 1 if k and raw[k - 1] in b"\"'" else k

    sign = back(quote(at), b" ")
    if not sign or raw[sign - 1] not in b":=":
        return b""
    name = quote(back(sign - 1, b" "))
    start = back(name, NAME)
    return raw[start:at] if name - start >= 2 else b""


def spans_of(text: str, scorer: Scorer, least: float = ODDS) -> tuple[list[dict], float | None]:
    """The spans of one text and its best odds, in time in proportion to its length: candidates and the spans of each kind
    are met in order, and code points are counted on from one place to the next."""
    raw = text.encode()
    found = [[start, end, kind, None] for start, end, kind in base_spans(raw)]
    waiting, best = [deque(span for span in found if span[2] == kind) for kind in KINDS[:3]], None
    for m in CANDIDATE.finditer(raw) if scorer.formats else ():
        odds = scorer.odds(m[0], context_before(raw, m.start()))
        best, inside = odds if best is None else max(best, odds), False
        for spans in waiting:
            while spans and spans[0][1] < m.end():
                spans.popleft()
            if spans and spans[0][0] <= m.start():
                inside, spans[0][3] = True, odds if spans[0][3] is None else max(spans[0][3], odds)
        if not inside and odds >= least:
            found.append([m.start(), m.end(), "format", odds])
    if found and not raw.isascii():
        points, before, total = {}, 0, 0
        for place in sorted({place for span in found for place in span[:2]}):
            total += len(raw[before:place].decode())
            points[place], before = total, place
        for span in found:
            span[:2] = points[span[0]], points[span[1]]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return [{"kind": kind, "start": a, "end": b, "odds": odds} for a, b, kind, odds in found], best


def redacted(text: str, spans: list) -> str:
    """The text with each stretch of spans, overlapping ones together, replaced by [SECRET]."""
    parts, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            parts += [text[at : s["start"]], "[SECRET]"]
        at = s["end"]
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, examples: dict[str, list[bytes]], odds: float = ODDS, text_col: str = "text", length_col: str = "n_chars", ordinary: Ordinary | None = None) -> DataFrame:
    """docs with the secrets of each text replaced by [SECRET] and, where docs have the column length_col, that set to the
    new length; a null text stays null with its length. Repeated rows stay repeated."""
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(examples, ordinary=ordinary))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, spans_of(t, scorer.value, odds)[0]) for t in texts], dtype=object)

    changed = docs.withColumn(text_col, cleaned(F.col(text_col)))
    if length_col not in docs.columns:
        return changed
    return changed.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col).cast(dict(docs.dtypes)[length_col])))
