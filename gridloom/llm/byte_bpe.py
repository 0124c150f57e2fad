"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database for each partition.

Rows (word, position, token) of the distinct words of a batch join the table of merges. Each step of the recursion
contracts each word's leftmost pair of least rank, until no pair of the word can merge. A second query decodes: the
bytes of all ids of a text are put together by an aggregation in the order of positions.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.pretokens import can_be_cut

#: Bytes of distinct words in one recursive query, rows that its steps hold together, ids in one decoding query, and bytes of
#: the words that a worker remembers with their ids; they bound memory.
QUERY_BYTES, STATE_ROWS, DECODE_IDS, KNOWN_BYTES = 1 << 17, 1 << 21, 1 << 18, 1 << 23
SYMBOLS = [chr(256 + b) for b in range(256)]

#: pos counts the bytes of all words of the batch, so it names a row. A row carries its right neighbour's position and
#: token and, as one number, the rank and place of the pair it makes with it (null if the two can't merge). A step
#: takes each word's least such number: that row gets the merged token and its neighbour's neighbour, the neighbour
#: goes, and the row before sees the merged token. Words without any pair take no further step; the rows of each
#: word's last step are the result. A recursion keeps the rows of all its steps, so it ends after a number of them;
#: words with a pair left then go on from their last rows in another one.
ENCODE_SQL = """
WITH RECURSIVE state AS (
    SELECT s.word, s.pos, s.tok, s.rpos, s.rtok, m.tok::BIGINT * 1099511627776 + s.pos AS pair, 0 AS step
    FROM seed s LEFT JOIN merges m ON m.lhs = s.tok AND m.rhs = s.rtok
    UNION ALL
    (WITH best AS (
        SELECT word, min(pair) AS pair, arg_min(rpos, pair) AS gone FROM state WHERE pair IS NOT NULL AND step < {steps} GROUP BY word
    ), chosen AS (
        SELECT b.word, (b.pair % 1099511627776)::INTEGER AS hit, (b.pair // 1099511627776)::INTEGER AS merged, b.gone, g.rpos, g.rtok
        FROM best b JOIN state g ON g.pos = b.gone
    ), contracted AS (
        SELECT s.word, s.pos, CASE WHEN s.pos = c.hit THEN c.merged ELSE s.tok END AS tok,
               CASE WHEN s.pos = c.hit THEN c.rpos ELSE s.rpos END AS rpos,
               CASE WHEN s.pos = c.hit THEN c.rtok WHEN s.rpos = c.hit THEN c.merged ELSE s.rtok END AS rtok,
               s.step + 1 AS step
        FROM state s JOIN chosen c ON c.word = s.word WHERE s.pos <> c.gone
    )
    SELECT n.word, n.pos, n.tok, n.rpos, n.rtok, m.tok::BIGINT * 1099511627776 + n.pos AS pair, n.step
    FROM contracted n LEFT JOIN merges m ON m.lhs = n.tok AND m.rhs = n.rtok)
)
SELECT s.word, s.pos, s.tok, s.rpos, s.rtok, s.pair IS NOT NULL AS more
FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l ON l.word = s.word AND l.step = s.step ORDER BY s.pos
"""
DECODE_SQL = """
SELECT text_no, array_to_string(list(v.symbols ORDER BY pos), '') AS symbols
FROM ids JOIN vocabulary v ON v.tok = ids.tok GROUP BY text_no ORDER BY text_no
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tables(ranks: dict[bytes, int]) -> tuple[pa.Table, pa.Table]:
    """merges (lhs, rhs, tok) and vocabulary (tok, token)."""
    splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    columns = zip(*splits) if splits else ([], [], [])
    merges = pa.table({name: pa.array(column, pa.int32()) for name, column in zip(("lhs", "rhs", "tok"), columns)})
    return merges, pa.table({"tok": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks, pa.binary())})


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat with these starts and lengths, one after another."""
    ends = np.cumsum(lengths)
    size = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(size, len(flat)) < 1 << 31 else np.int64  # half of what there is to move
    place = np.repeat((starts - ends + lengths).astype(kind), lengths)
    place += np.arange(size, dtype=kind)
    return flat[place]


class Known:
    """Distinct words and the ids of each, packed in columns, as a dict of strings takes several times their memory. met: words that
    were asked for again."""

    def __init__(self):
        self.words, self.flat, self.sizes, self.met = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, bool)

    def nbytes(self) -> int:
        return self.words.nbytes + self.flat.nbytes + self.sizes.nbytes + self.met.nbytes

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of some distinct words is, -1 if it isn't here. Those that are have now been met again."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(int)
        self.met[at[at >= 0]] = True
        return at

    def keep(self, mask: np.ndarray) -> None:
        starts = np.cumsum(self.sizes) - self.sizes
        self.flat, self.sizes = gathered(self.flat, starts[mask], self.sizes[mask]), self.sizes[mask]
        self.words, self.met = self.words.filter(pa.array(mask)), self.met[mask]

    def add(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words that aren't here. Where that takes too much memory, those never met again go, then all."""
        more = words.nbytes + flat.nbytes + sizes.nbytes
        if self.nbytes() + more > KNOWN_BYTES:
            self.keep(self.met)
        if self.nbytes() + more > KNOWN_BYTES:
            self.keep(np.zeros(len(self.met), bool))
        if more <= KNOWN_BYTES:
            self.words, self.met = pa.concat_arrays([self.words, words]), np.append(self.met, np.zeros(len(words), bool))
            self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes.astype(np.int32))


class Codec:
    """Encodes and decodes with the tables of one vocabulary. Bytes stand in the database as the characters U+0100 to U+01FF."""

    def __init__(self, merges: pa.Table, vocabulary: pa.Table, pattern: str, known: Known | None = None):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        tokens = vocabulary["token"].to_pylist()
        self.ranks = dict(zip(tokens, vocabulary["tok"].to_pylist()))
        self.known = Known() if known is None else known
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.load("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.load("vocabulary_in", pa.table({"tok": vocabulary["tok"], "symbols": ["".join(map(SYMBOLS.__getitem__, t)) for t in tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")

    def close(self) -> None:
        self.known.keep(self.known.met)  # most words never come again
        self.db.close()

    def load(self, name: str, rows: pa.Table) -> None:
        self.db.register(name, rows)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers. A word that is a token itself is that token."""
        found = [self.ranks.get(w) for w in words]
        result = [b"" if r is None else int(r).to_bytes(4, "little") for r in found]
        todo = [k for k, r in enumerate(found) if r is None and words[k]]
        common.trim()
        while todo:
            batch, size = [], 0
            while todo and size < QUERY_BYTES:
                batch.append(todo.pop())
                size += len(words[batch[-1]])
            lengths = np.array([len(words[k]) for k in batch])
            start = np.cumsum(lengths) - lengths
            raw = np.frombuffer(b"".join(words[k] for k in batch), np.uint8)
            last = np.zeros(len(raw), bool)
            last[start + lengths - 1] = True
            tok, pos = self.byte_ids[raw], np.arange(len(raw), dtype=np.int32)
            seed = pa.table({
                "word": np.repeat(np.arange(len(batch), dtype=np.int32), lengths), "pos": pos, "tok": tok,
                "rpos": pa.array(pos + 1, mask=last), "rtok": pa.array(np.append(tok[1:], tok[:1]), mask=last),
            })
            while len(seed):
                self.load("seed", seed)
                rows = self.db.sql(ENCODE_SQL.format(steps=max(1, STATE_ROWS // len(seed)))).to_arrow_table()
                word, ids = rows["word"].to_numpy(), rows["tok"].to_numpy().astype("<u4")
                more = np.zeros(len(batch), bool)
                more[word[rows["more"].to_numpy()]] = True
                done = np.setdiff1d(word, np.flatnonzero(more))
                for k, a, b in zip(done, np.searchsorted(word, done), np.searchsorted(word, done, "right")):
                    result[batch[k]] = ids[a:b].tobytes()
                seed = rows.filter(pa.array(more[word]))
        return result

    def decode(self, flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """What the stretches of ids, of these lengths one after another in flat, stand for."""
        found: list[list[bytes]] = [[] for _ in lengths]
        text_no = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        for start in range(0, len(flat), DECODE_IDS):
            part = slice(start, start + DECODE_IDS)
            tok = flat[part].astype(np.int32)
            self.load("ids", pa.table({"text_no": text_no[part], "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
            rows = self.db.sql(DECODE_SQL).to_arrow_table()
            for k, symbols in zip(rows["text_no"].to_pylist(), rows["symbols"].to_pylist()):
                found[k].append(symbols.encode("utf-16-le")[::2])
        return [b"".join(parts) for parts in found]

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some distinct words, one after another, and how many each word has."""
        at = self.known.places(words)
        new = at < 0
        unknown = words.filter(pa.array(new))
        ids = self.encode_words([w.encode() for w in unknown.to_pylist()])
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), int, len(ids)) // 4
        at[new] = len(self.known.sizes) + np.arange(len(ids))
        every = np.append(self.known.sizes, sizes)
        found = gathered(np.append(self.known.flat, flat), (np.cumsum(every) - every)[at], every[at])
        self.known.add(unknown, flat, sizes)
        return found, every[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has.

        A text is a sequence of pieces, and a piece one of matches of the pattern: the pieces that follow a space are
        matched once for each distinct one, the first piece of a text and a text that can't be cut by themselves. The ids
        of the distinct matches are then put together by pieces, and those by texts.
        """
        cut = np.array([can_be_cut(t) for t in texts], bool)
        lists = pc.split_pattern(pa.array([t for t, c in zip(texts, cut) if c], pa.large_string()), " ")
        flat, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        first = np.zeros(len(flat), bool)
        first[np.cumsum(size) - size] = True
        after = flat.filter(pa.array(~first)).dictionary_encode()
        spaced = after.dictionary.to_pylist()
        alone = [t for t, c in zip(texts, cut) if not c] + flat.filter(pa.array(first)).to_pylist()
        matches = self.find(" " + " ".join(spaced)) if spaced else []
        found = [self.find(piece) for piece in alone]
        n_spaced = len(matches)
        for f in found:
            matches += f
        n_pieces, piece_of, sizes_alone = len(spaced), after.indices.to_numpy(), np.array([len(f) for f in found], int)
        words = pa.array(matches, pa.large_string()).dictionary_encode()
        # no piece has a space within, so each match that begins with one begins a piece
        begins = pc.starts_with(words.dictionary, " ").to_numpy(zero_copy_only=False)[words.indices.to_numpy()[:n_spaced]]
        per_piece = np.bincount(np.cumsum(begins), minlength=n_pieces + 1)[1:]
        per_piece, n_flat = np.concatenate([per_piece, sizes_alone]), len(flat)
        del lists, flat, after, spaced, alone, matches, found, begins  # the next step takes much memory
        word_ids, word_sizes = self.ids_of(words.dictionary)
        which = words.indices.to_numpy()
        match_sizes = word_sizes[which]
        piece_ids = gathered(word_ids, (np.cumsum(word_sizes) - word_sizes)[which], match_sizes)
        match_ends = np.append(0, np.cumsum(match_sizes))[np.append(0, np.cumsum(per_piece))]
        piece_starts, piece_sizes = match_ends[:-1], np.diff(match_ends)
        n_whole = int((~cut).sum())
        sequence = np.empty(n_flat, int)
        sequence[~first] = piece_of
        sequence[first] = n_pieces + n_whole + np.arange(len(size))
        # the texts that are cut come first, then the others, each of one piece
        sequence = np.concatenate([sequence, n_pieces + np.arange(n_whole)])
        every = gathered(piece_ids, piece_starts[sequence], piece_sizes[sequence])
        text_ends = np.append(0, np.cumsum(piece_sizes[sequence]))[np.append(0, np.cumsum(np.append(size, np.ones(n_whole, int))))]
        order = np.argsort(np.append(np.flatnonzero(cut), np.flatnonzero(~cut)))
        lengths = np.diff(text_ends)[order]
        return (gathered(every, text_ends[:-1][order], lengths) if n_whole else every), lengths


class Shared:
    """A vocabulary that tasks get by broadcast. A worker has one codec open, from a task's first text to its end, and keeps
    the words met again for its next task with the same vocabulary."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.broadcast, self.pattern = spark.sparkContext.broadcast(tables(ranks)), pattern
        self.name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def codec(self) -> Codec:
        if not _OPEN:
            if self.name not in _KEPT:
                _KEPT.clear()
            _OPEN.append(Codec(*self.broadcast.value, self.pattern, _KEPT.setdefault(self.name, Known())))
        return _OPEN[0]

    @staticmethod
    def close() -> None:
        while _OPEN:
            _OPEN.pop().close()


_OPEN: list[Codec] = []
_KEPT: dict[str, Known] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of each row's whole text; a null text counts as empty and has no ids."""
    shared = Shared(docs.sparkSession, ranks_path, pattern)

    def work(texts):
        flat, lengths = shared.codec().encode(texts)
        return pd.DataFrame({"ids": np.split(flat.astype(np.int32), np.cumsum(lengths)[:-1])})

    return common.map_texts(docs, work, "ids array<int>", id_col, text_col, forget=shared.close)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes (binary): what the ids of each row stand for; null ids count as none. An id that the vocabulary
    lacks stands for no bytes."""
    shared = Shared(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        try:
            for batch in batches:
                ids = [np.asarray(x) for x in batch["ids"]]
                found = shared.codec().decode(np.concatenate(ids) if ids else np.zeros(0, int), np.array([len(x) for x in ids], int))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "bytes": found})
        finally:
            shared.close()
            common.release()

    ids = encoded.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return ids.mapInPandas(run, "doc_id string, bytes binary").withColumn("doc_id", F.col("doc_id").cast(dict(encoded.dtypes)[id_col]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs: its text is encoded, and all its ids are decoded.

    A null text counts as empty: no ids, no bytes. Repeated rows give repeated rows; other columns aren't read. A text
    of any length is one row of the work; the cost of one match of the pattern grows with the square of its length.
    """
    shared = Shared(docs.sparkSession, ranks_path, pattern)

    def work(texts):
        codec = shared.codec()
        flat, lengths = codec.encode(texts)
        raw, ends = memoryview(flat.astype("<u4").tobytes()), 4 * np.cumsum(lengths)
        return pd.DataFrame({
            "n_tokens": lengths,
            "ids_sha256": [hashlib.sha256(raw[end - 4 * n : end]).hexdigest() for end, n in zip(ends.tolist(), lengths.tolist())],
            "decoded_sha256": [hashlib.sha256(found).hexdigest() for found in codec.decode(flat, lengths)],
        })

    return common.map_texts(docs, work, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, forget=shared.close)
