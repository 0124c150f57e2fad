"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class, and classes are what is compared. Bands of the MinHash signature give
buckets; each member of a bucket is first paired with one of them, the class with most copies. A pair's signatures are
compared batch by batch, and a pair goes as soon as the posterior probability that its similarity reaches the threshold
is less than the chosen miss probability. Survivors are verified on the full sets. Components of the links found so
far then show which buckets still hold classes of several components: there each class outside the main component is
compared with all members of other components that share a bucket with it, pruned and verified alike. Both sides come in
blocks of bounded size. So a group of any size costs one comparison a member, and more only for the members that its most
copied class doesn't link.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Words of a shingle unless the caller says otherwise, and the least similarity of a link as a fraction.
SHINGLE, LINK = 4, (80, 100)
#: Hashes of a signature, of a band, of a batch of the comparison; the probability at which a pair is given up; members
#: of one block and bytes of their sets (about). A pair at the threshold shares no band with probability
#: (1 - 0.8^4)^40 = 6e-10.
HASHES, BAND, BATCH, MISS, MEMBERS, BLOCK_BYTES = 160, 4, 32, 1e-6, 500, 8 << 20
BANDS = HASHES // BAND

_RNG = np.random.Generator(np.random.PCG64(20240229))
MULTIPLY = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _RNG.integers(0, 1 << 63, HASHES, np.uint64)
PLACE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


class _Words(dict):
    """Digests of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def forget_words() -> None:
    _WORDS.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit digests of the distinct shingles; fewer words than a shingle has make one of them all."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digests = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return mixed(np.array([xxhash.xxh64_intdigest(digests.tobytes(), len(words))], np.uint64))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += mixed(digests[k : k + n] ^ PLACE[k % 4]) * (PLACE[(k + 1) % 4] + np.uint64(2 * (k // 4)))
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 512):
        part = (found[None, start : start + 512] ^ FLIP[:, None]) * MULTIPLY[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sign: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(sign[k * BAND : (k + 1) * BAND].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def needed(link=LINK, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, agreements that a pair needs to go on) after each batch. With a uniform prior the similarity has
    a beta posterior, and the chance that it reaches t after m agreements of n is that of at most m successes among
    n + 1 trials of probability t."""
    t, steps = link[0] / link[1], []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while True:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        steps.append((n, m))
    return steps


NEEDED = needed()


def survivors(sign: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places among others (rows of signatures) that no batch prunes."""
    left, agreed, done = np.arange(len(others)), np.zeros(len(others), int), 0
    for n, least in NEEDED:
        agreed = agreed + (others[left, done:n] == sign[done:n]).sum(axis=1)
        keep = agreed >= least
        left, agreed, done = left[keep], agreed[keep], n
        if not len(left):
            break
    return left


def linked(found: np.ndarray, others: list[np.ndarray], link=LINK) -> np.ndarray:
    """Which of others, sorted sets, have the similarity of a link with found."""
    if not others:
        return np.zeros(0, bool)
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(found, flat), len(found) - 1)
    both = np.add.reduceat((found[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return link[1] * both >= link[0] * (sizes + len(found) - both)


def class_features(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set) and bands of each row; the last two are null for an empty set."""

    def work(texts):
        rows = []
        for text in texts:
            found = shingles(text, size)
            rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(signature(found))) if len(found) else (0, None, None))
        return pd.DataFrame(rows, columns=["n_shingles", "class", "bands"])

    return common.map_texts(docs, work, "n_shingles long, class binary, bands array<long>", id_col, text_col, forget=forget_words)


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, store=common.stored) -> DataFrame:
    """class, sign, found of the wanted classes (first_id, class), from the text of a row with that id: one row for each
    class, however often that row is repeated. A task gives a class once; only if several tasks do, they are counted out."""
    texts = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text")).join(common.broadcast_if_small(wanted), "first_id")

    def run(batches):
        given: set[bytes] = set()
        for batch in batches:
            rows = []
            for text, own in zip(batch["text"], map(bytes, batch["class"])):
                if own in given:
                    continue
                found = shingles(text, size)
                if len(found) and xxhash.xxh3_128_digest(found.tobytes()) == own:
                    given.add(own)
                    rows.append((own, signature(found).tobytes(), found.tobytes()))
            yield pd.DataFrame(rows, columns=["class", "sign", "found"])
        forget_words()
        common.release()

    found = store(texts.select("text", "class").mapInPandas(run, "class binary, sign binary, found binary"), "dedup-sets")
    if found.count() == found.select("class").distinct().count():
        return found
    once = store(found.dropDuplicates(["class"]), "dedup-sets")
    common.drop_stored(found)
    return once


def in_parts(members: int):
    """An aggregate: how many blocks the rows of a group make, of about so many members and BLOCK_BYTES of their sets
    (n, the shingles of a set)."""
    return F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum(8 * F.col("n").cast("long")) / BLOCK_BYTES)).cast("int")


def verified(pairs: DataFrame, sets: DataFrame, store=common.stored) -> DataFrame:
    """The pairs (class, other, n) whose sets are linked; the members of one other are dealt out in blocks."""
    counts = store(pairs.groupBy("other").agg(in_parts(MEMBERS).alias("blocks")), "dedup-blocks")
    members = pairs.join(counts, "other").select("other", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "class")
    others = counts.select("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("other").alias("class"))
    rows = members.unionByName(others).join(sets, "class")

    def run(batches):
        for group in common.contiguous_groups(batches, ["other", "block"]):
            own = group["role"].to_numpy() == 0
            if not own.any() or own.all():
                continue
            sign, found = np.frombuffer(group["sign"][own].iloc[0], np.uint32), np.frombuffer(group["found"][own].iloc[0], np.uint64)
            rest = group[~own]
            left = survivors(sign, np.stack([np.frombuffer(s, np.uint32) for s in rest["sign"]]))
            rest = rest.iloc[left]
            yield rest[linked(found, [np.frombuffer(f, np.uint64) for f in rest["found"]])][["class", "other"]]

    dealt = rows.repartition("other", "block").sortWithinPartitions("other", "block", "role")
    return dealt.mapInPandas(run, "class binary, other binary")


def components(edges: DataFrame, store=common.stored) -> DataFrame:
    """class, root (the least class of its component) for the classes of edges (class, other), by alternating stars."""
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        moved = pairs.join(least, "a")
        if large:
            return moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        kept = least.select("a", F.col("least").alias("b"))
        return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").unionByName(kept).distinct()

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = store(edges.select(F.greatest("class", "other").alias("a"), F.least("class", "other").alias("b")).filter("a <> b").distinct(), "dedup-edges")
    before = state(pairs)
    while before[0]:
        after = store(stars(stars(pairs, True), False), "dedup-stars")
        common.drop_stored(pairs)
        pairs, now = after, state(after)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("class"), F.col("b").alias("root")).distinct()
    return store(pairs.select(F.col("a").alias("class"), F.col("b").alias("root")).unionByName(roots), "dedup-roots")


def in_blocks(grouped: DataFrame, store=common.stored) -> DataFrame:
    """main, ask_block, block, role, class, root: the classes of grouped (main, class, root, n) outside the main component
    (role 0) and all of them (role 1), both dealt out by digest in blocks of about 4 * MEMBERS or BLOCK_BYTES, each block
    of the one with each of the other."""
    asks = F.col("root") != F.col("main")
    members = grouped.groupBy("main").agg(in_parts(4 * MEMBERS).alias("blocks"))
    asking = grouped.filter(asks).groupBy("main").agg(in_parts(4 * MEMBERS).alias("ask_blocks"))
    own = grouped.join(store(members.join(asking, "main"), "dedup-group-blocks"), "main")

    def dealt(name):
        return F.pmod(F.xxhash64("class"), F.col(name)).cast("int")

    def each(name):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    members = own.select("main", each("ask_blocks").alias("ask_block"), dealt("blocks").alias("block"), F.lit(1).alias("role"), "class", "root")
    asking = own.filter(asks).select("main", dealt("ask_blocks").alias("ask_block"), each("blocks").alias("block"), F.lit(0).alias("role"), "class", "root")
    return members.unionByName(asking)


def sharing(sign: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of others (rows of signatures) share a bucket with sign."""
    return (others == sign).reshape(len(others), BANDS, BAND).all(axis=2).any(axis=1)


def remaining(buckets: DataFrame, reps: DataFrame, roots: DataFrame, sets: DataFrame, store=common.stored) -> DataFrame:
    """Links (class, other) between classes of different components that share a bucket with at least one more class.

    Buckets that still hold several components are put together by their main component. In each such group, each class
    outside the main component is compared with all members of other components, in blocks: signatures first, then, for
    pairs that share a bucket, sets. One link to each other component is enough.
    """
    many = reps.filter("n > 2")
    rows = buckets.select("key", "class", "n").join(many.select("key", "rep"), "key").join(roots, "class", "left")
    rows = store(rows.select("key", "class", "n", F.coalesce("root", "class").alias("root"), (F.col("class") == F.col("rep")).alias("is_rep")), "dedup-members")
    mixed_keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("is_rep"), F.col("root"))).alias("main"))
    mixed_keys = store(mixed_keys.filter("low <> high").select("key", "main"), "dedup-mixed")
    grouped = store(rows.select("key", "class", "root", "n").join(mixed_keys, "key").select("main", "class", "root", "n").distinct(), "dedup-groups")
    common.drop_stored(rows, mixed_keys)
    keys = ["main", "ask_block", "block"]
    dealt = in_blocks(grouped, store).join(sets, "class").repartition(*keys).sortWithinPartitions(*keys, "role")

    def run(batches):
        for group in common.contiguous_groups(batches, keys):
            ask = group["role"].to_numpy() == 0
            if not ask.any() or ask.all():
                continue
            asked, rest = group[ask], group[~ask]
            signs = np.stack([np.frombuffer(s, np.uint32) for s in rest["sign"]])
            sets_ = [np.frombuffer(f, np.uint64) for f in rest["found"]]
            names, of = rest["class"].to_numpy(), rest["root"].to_numpy()
            out = []
            for name, root, sign, found in zip(asked["class"], asked["root"], asked["sign"], asked["found"]):
                elsewhere, sign = np.flatnonzero(of != root), np.frombuffer(sign, np.uint32)
                left = elsewhere[survivors(sign, signs[elsewhere])]
                left = left[sharing(sign, signs[left])]
                left = left[linked(np.frombuffer(found, np.uint64), [sets_[k] for k in left])]
                out += [(name, names[k]) for k in {of[k]: k for k in left}.values()]
            yield pd.DataFrame(out, columns=["class", "other"])

    return dealt.mapInPandas(run, "class binary, other binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; shingle is the number of words of a shingle.

    component_id is the least id of those that links lead to, the row's own included; kept says whether it is the row's
    own. A null, empty or wordless text has no shingles and no links. A row without an id takes part in no component: its
    component_id is null and it is kept. Repeated rows give repeated rows, kept or not alike. Words are told apart by
    64-bit digests.
    """
    spark, store = docs.sparkSession, common.Stores()
    features = common.stored(class_features(docs, id_col, text_col, shingle), "dedup-features")
    whole = features.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    of_class = [F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands")]
    classes = store(whole.groupBy("class").agg(*of_class), "dedup-classes")
    buckets = classes.select("class", F.least("copies", F.lit((1 << 31) - 1)).cast("int").alias("copies"), "n", F.explode("bands").alias("key"))
    reps = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("copies")).alias("copies"), "class"))["class"].alias("rep")).filter("n > 1")
    reps = store(reps, "dedup-reps")
    pairs = buckets.select("key", "class", "n").join(reps.select("key", "rep"), "key").filter("class <> rep").select("class", F.col("rep").alias("other"), "n").distinct()
    pairs = store(pairs, "dedup-pairs")
    common.free_shuffles(spark)
    wanted = classes.select("first_id", "class").join(pairs.select("class").unionByName(pairs.select(F.col("other").alias("class"))).distinct(), "class")
    wanted = store(wanted, "dedup-wanted")
    sets = sets_of(docs, wanted, id_col, text_col, shingle, store)
    edges = store(verified(pairs, sets, store), "dedup-links")
    common.free_shuffles(spark)
    roots = components(edges, store)
    more = store(remaining(buckets, reps, roots, sets, store), "dedup-more")
    common.drop_stored(sets)
    if not more.isEmpty():
        roots = components(roots.withColumnRenamed("root", "other").unionByName(more), store)
    common.free_shuffles(spark)
    least = classes.select("class", "first_id").join(roots, "class").groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = roots.join(store(least, "dedup-least"), "root").select("class", "component_id")
    # a class of one row without links needs no entry
    named = classes.select("class", "first_id", "copies").join(found, "class", "left").filter("copies > 1 OR component_id IS NOT NULL")
    named = common.stored(named.select("class", F.coalesce("component_id", "first_id").alias("component_id")), "dedup-components")
    store.drop()
    out = features.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
