"""Similarity of requests and top-k retrieval, by classes of equal features rather than all pairs of rows."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.keys import jaccard
from millrace.session import cut

SAME_INTENT, STATE_KEYS = 0.5, 0.3
TOP = 5
INTENT_SIMILAR = 0.7
#: Sets of a word that are one block; pairs of blocks are the unit of work.
BLOCK = 1 << 14
#: Pairs that are verified at once.
PAIRS = 1 << 17
#: Slots of words' hashes that are counted, and how many of them are a row on the way.
SLOTS, SLICE = 1 << 22, 1 << 16
#: Groups of cells, at least, and words of sets for each of them; zones share the groups.
GROUPS, GROUP_WORDS = 24, 1 << 24
CHUNK = 100_000  # rows of whole cells that are compared at once
HELD = 1 << 18  # pairs that are sent on together
FIRST = 4  # words of a set by which a pair that has met before is known
MARKS = 1 << 25  # bits by hashes of ids, 1 << 15 of them a row
COPIES = 1 << 20  # ids of equal sets that are sent to all tasks, at most


def similar_by_state(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """For each query (id, intent, keys) the k most similar rows of its intent, itself excluded.

    Score: 0.5 for the intent and 0.3 times the Jaccard similarity of the key sets. Rows with equal intent
    and keys score alike, so k + 1 of each class, by id, are all that can be in an answer.
    """
    features = ["intent", "keys"]
    sets = rows.select("id", "intent", F.array_sort("keys").alias("keys"))
    place = F.row_number().over(Window.partitionBy(*features).orderBy("id"))
    best = sets.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy(*features).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = queries.select("id", "intent", F.array_sort("keys").alias("keys"))
    classes = asked.select(*features).distinct()
    score = F.lit(SAME_INTENT) + STATE_KEYS * jaccard(F.col("keys"), F.col("other"))
    pairs = classes.join(best.withColumnRenamed("keys", "other"), "intent").select(*features, score.alias("score"), "ids")
    ranked = pairs.select(*features, "score", F.explode("ids").alias("similar_id"))
    per_class = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*features).orderBy(F.col("score").desc(), "similar_id"))).filter(F.col("r") <= k + 1)
    found = asked.join(per_class, features).filter(F.col("id") != F.col("similar_id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "similar_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "similar_id", "score")


def similar_weighted(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k best rows for each query (id, intent, hash, path): 0.4 for the intent, 0.4 for the input hash, 0.1 / length
    for each capability of the query's path that theirs shares; at most 1.

    Equal (intent, hash, path) classes are folded first.
    """
    features = ["intent", "hash", "path"]
    place = F.row_number().over(Window.partitionBy(*features).orderBy("id"))
    best = rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy(*features).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    best = best.select(F.col("intent").alias("i2"), F.col("hash").alias("h2"), F.col("path").alias("p2"), "ids")
    classes = queries.select(*features).distinct()
    # three index joins give the candidates; each class pair is scored once
    on = [classes.intent == best.i2, classes.hash == best.h2]
    pairs = classes.join(best, on[0]).unionByName(classes.join(best, on[1] & (classes.intent != best.i2)))
    a = classes.withColumn("cap", F.explode(F.array_distinct("path")))
    b = best.withColumn("cap", F.explode(F.array_distinct("p2")))
    shared = a.join(b, "cap").filter((F.col("intent") != F.col("i2")) & (F.col("hash") != F.col("h2"))).drop("cap").dropDuplicates([*features, "i2", "h2", "p2"])
    pairs = pairs.unionByName(shared)
    common = F.size(F.filter("path", lambda c: F.array_contains("p2", c)))
    score = F.least(F.lit(1.0), 0.4 * (F.col("intent") == F.col("i2")).cast("int") + 0.4 * (F.col("hash") == F.col("h2")).cast("int") + F.when(F.size("path") > 0, 0.1 * common / F.size("path")).otherwise(0.0))
    ranked = pairs.withColumn("score", F.round(score, 9)).select(*features, "score", F.explode("ids").alias("similar_id"))
    order = [F.col("score").desc(), F.col("similar_id")]
    per_class = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*features).orderBy(*order))).filter(F.col("r") <= k + 1)
    found = queries.join(per_class, features).filter(F.col("id") != F.col("similar_id"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("rank") <= k).select("id", "rank", "similar_id", "score")


def similar_word_sets(texts: DataFrame, column: str = "text", threshold: float = INTENT_SIMILAR) -> DataFrame:
    """Pairs (key_a, key_b, similarity) of different word sets of texts whose Jaccard similarity is above the threshold.

    A set's key is the SHA-256 of its lower-cased words, sorted and joined by spaces; equal sets are one. Words are ordered by how rare they are,
    by counts in SLOTS slots of their hashes; similar sets must share one of their first size - ceil(threshold * size) + 1
    words, so only these are met on. Sizes must be near: they fall into classes, of which only neighbours can hold similar sets, and a pair meets in the zone
    of its larger set's class. By the places of the word that is shared first, what is left of both must suffice.
    The pairs that are left are compared by the parities of their words' hashes, which bound the difference from below,
    and only then by the words. Hashes that collide add candidates and lose none. Candidates are sent as packed lists, most of them once for each group of their zone.
    """
    spark = texts.sparkSession
    made = texts.select(F.lower(column).alias("text")).filter("text is not null").mapInArrow(_packed_sets, "key string, size int, words binary")
    sets = _once(cut(made.select(F.monotonically_increasing_id().alias("id"), "key", "size", "words")))
    slices = sets.select("words").mapInArrow(_slot_counts, "slice int, counts binary").groupBy("slice").applyInArrow(_sum_slice, "slice int, counts binary")
    counts = np.zeros(SLOTS, np.uint32)
    for row in slices.collect():  # of fixed size together
        counts[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    shared = spark.sparkContext.broadcast(counts)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _classes(threshold)
    of_class = F.size(F.filter(F.array(*map(F.lit, bounds.tolist())), lambda b: b <= F.col("size"))) - 1
    words = np.zeros(len(bounds), np.int64)
    for row in sets.groupBy(of_class.alias("class")).agg(F.sum("size").alias("words")).collect():  # a row a class
        words[row["class"]] = row["words"]
    groups = _zones(words, max(GROUPS, width // 4, -(-int(words.sum()) // GROUP_WORDS)))
    block, pairs, buckets = BLOCK, PAIRS, max(GROUPS, width)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):  # bounds the memory
                yield _heads(batch.slice(lo, 2048), shared.value, threshold, block, bounds, groups)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _meet(batches, threshold, bounds, groups, buckets)

    # a set goes to a group of cells once, with its parities
    sent = sets.select("id", "size", "words").mapInArrow(heads, "part int, sets int, heads int, numbers binary, bits binary").repartition(max(width, 2 * int(groups.sum())), "part")
    met = sent.groupBy("part").applyInArrow(meet, "bucket int, pairs int, numbers binary").repartition(buckets, "bucket")
    near = cut(met.groupBy("bucket").applyInArrow(_partners, "a long, place long, n int, others binary"))
    # a set's partners of larger ids are verified at the largest of them, which most near copies share, so that words are sent to few places
    parts = near.groupBy("place").agg(F.ceil(F.sqrt(F.sum(F.col("n").cast("long")) / pairs)).cast("int").alias("parts"))
    placed = cut(near.join(parts, "place").mapInArrow(_dealt, "place long, p int, q int, a long, n int, others binary"))
    names = ["place", "p", "q"]
    members = cut(placed.groupBy(*names).applyInArrow(_members, "place long, p int, q int, id long"))
    members = members.join(_likely(sets.select("id", "key", "words"), members), "id")
    return placed.groupBy(*names).cogroup(members.groupBy(*names)).applyInArrow(_compared, "key_a string, key_b string, similarity double").filter(F.col("similarity") > threshold)


def _once(sets: DataFrame) -> DataFrame:
    """The sets (id, key, ...) without those that have the key of one of a smaller id; only keys are shuffled, unless very many sets are equal."""
    keys = sets.select("id", F.unhex("key").alias("key"))
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = cut(keys.join(least, "key").filter("id <> least").select("id"))
    return sets.join(F.broadcast(copies), "id", "left_anti") if copies.count() <= COPIES else cut(sets.join(copies, "id", "left_anti"))


def _likely(sets: DataFrame, members: DataFrame) -> DataFrame:
    """The sets whose ids can be members', by marks of fixed size, so that a join doesn't shuffle the words of the others."""
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    place, at = F.shiftright(mark, 15), mark.bitwiseAND(F.lit(0x7FFF))
    marks = members.select(place.alias("slice"), at.alias("at")).groupBy("slice").agg(F.bitmap_construct_agg("at").alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", (F.shiftright("at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = sets.withColumns({"slice": place, "at": at}).join(F.broadcast(marks), "slice").filter(F.getbit(byte, F.col("at").bitwiseAND(F.lit(7)).cast("int")) == 1)
    return marked.select(*sets.columns)


def _classes(threshold: float) -> np.ndarray:
    """The least size of each class of sizes; a set and one that is at most 1 / threshold as large are of one class or of neighbours."""
    bounds, ratio = [1], min(threshold, 0.9)  # coarser classes than needed for larger thresholds
    while ratio > 0 and bounds[-1] < 1 << 31:
        last = bounds[-1]
        bounds.append(max(last + 1, int(np.floor((last - 1) / ratio + 1e-6)) + 1))
    return np.array(bounds, np.int64)


def _zones(words: np.ndarray, groups: int) -> np.ndarray:
    """How many groups of cells each zone has by the words of its class and of the one below, and none without sets of its class."""
    weight = np.where(words > 0, words + np.r_[0, words[:-1]] / 2, 0)
    return np.ceil(groups * weight / max(weight.sum(), 1)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _pressed(*numbers: np.ndarray) -> bytes:
    """Arrays of whole numbers, the first bytes of each array's numbers before their second ones and so on, compressed."""
    return zlib.compress(b"".join(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in numbers), 1)


def _restored(raw: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of `_pressed` of these types and lengths."""
    flat, out, lo = np.frombuffer(zlib.decompress(raw), np.uint8), [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[lo : lo + size * n].reshape(size, n).T).reshape(-1).view(kind))
        lo += size * n
    return out


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key, size and compressed words of each text with a word; words are what ASCII white space parts."""
    for batch in batches:
        rows = []
        for text in batch["text"].cast(pa.binary()).to_pylist():
            own = sorted(set(text.split()))
            if own:
                joined = b" ".join(own)
                rows.append((hashlib.sha256(joined).hexdigest(), len(own), zlib.compress(joined, 1)))
        key, size, words = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(size, pa.int32()), pa.array(words, pa.binary())], names=["key", "size", "words"])


def _hashes(words: bytes) -> np.ndarray:
    return np.array([crc32(w) for w in zlib.decompress(words).split(b" ")], np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of these have a word of each slot, a slice of slots a row."""
    counts = np.zeros(SLOTS, np.uint32)
    for batch in batches:
        for words in batch["words"].to_pylist():
            np.add.at(counts, _hashes(words) % SLOTS, 1)
    for k in range(SLOTS // SLICE):
        part = counts[k * SLICE : (k + 1) * SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.astype("<u4").tobytes(), 1)], pa.binary())], names=["slice", "counts"])


def _sum_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, k = np.zeros(SLICE, np.uint32), None
    for batch in batches:
        for k, counts in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):  # noqa: B007
            total += np.frombuffer(zlib.decompress(counts), "<u4")
    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(total.astype("<u4").tobytes(), 1)], pa.binary())], names=["slice", "counts"])


def _heads(batch: pa.RecordBatch, counts: np.ndarray, threshold: float, block: int, bounds: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """Sets' rarest words with their first places and the sets' parities, a row for each group of cells (word, p, q) of a zone.

    A set is host in the zone of its class, and guest in the one above with the words that a larger set must share one of.
    One word's sets are dealt into blocks of about `block` by its slot's count, and go to every pair of blocks that theirs is in.
    """
    ids, sizes = batch["id"].to_numpy(), batch["size"].to_numpy().astype(np.int64)
    parts, bits = [(np.zeros(0, np.int64),) * 4], []
    for i, (size, words) in enumerate(zip(sizes.tolist(), batch["words"].to_pylist(), strict=True)):
        h = _hashes(words)
        bits.append(_parity(h))
        f = counts[h % SLOTS].astype(np.int64)
        order = np.lexsort((h, f))[: size - int(np.ceil(threshold * size - 1e-9)) + 1]
        h, f = h[order], f[order]
        at = np.flatnonzero((np.diff(h, prepend=-1) != 0) & (f > 1))  # a word of one set meets none
        parts.append((h[at], f[at], np.full(len(at), i), at))
    word, f, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    zone = np.searchsorted(bounds, sizes[row], "right") - 1
    larger = np.r_[bounds, np.iinfo(np.int64).max >> 8][zone + 1]
    guest = np.flatnonzero((np.r_[groups, 0][zone + 1] > 0) & _enough(sizes[row], at, larger, threshold))
    zone = np.r_[zone, zone[guest] + 1]
    word, f, row, at = (np.r_[x, x[guest]] for x in (word, f, row, at))
    blocks = -(-f // block)
    own = _mixed(ids[row]) % blocks
    copies = np.repeat(np.arange(len(word)), blocks)
    other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    word, own, row, at, zone = (x[copies] for x in (word, own, row, at, zone))
    p, q = np.minimum(own, other), np.maximum(own, other)
    part = (np.cumsum(groups) - groups)[zone] + _mixed(word + 31 * p + 1009 * q) % groups[zone]
    order = np.lexsort((at, row, part))
    part, row = part[order], row[order]
    numbers = [x[order].astype("<u4") for x in (word, p, q, own, at)]
    out: dict[str, list] = {"part": [], "sets": [], "heads": [], "numbers": [], "bits": []}
    edges = np.flatnonzero(np.r_[True, np.diff(part) != 0, True]) if len(part) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        here, heads = np.unique(row[i:j], return_counts=True)
        out["part"].append(int(part[i]))
        out["sets"].append(len(here))
        out["heads"].append(j - i)
        out["numbers"].append(_pressed(ids[here], sizes[here].astype("<u4"), heads.astype("<u4"), *(x[i:j] for x in numbers)))
        out["bits"].append(b"".join(bits[k] for k in here.tolist()))
    kinds = {"part": pa.int32(), "sets": pa.int32(), "heads": pa.int32(), "numbers": pa.binary(), "bits": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], names=list(kinds))


def _enough(size: np.ndarray, at: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Whether what is left of sets from the place of the first shared word on suffices with others of these sizes."""
    return (size - at) * (1 + threshold) >= threshold * (size + other) - 1e-6


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, bounds: np.ndarray, groups: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs of ids of sets in one cell (word, p, q), as far as sizes, places and parities allow; of different blocks if p and q differ.

    batches: rows of `_heads` of one group. A pair that shares one of both sets' first words here is left to that word's cell.
    """
    columns, bits, zone = [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            zone = int(np.searchsorted(np.cumsum(groups), row["part"], "right"))
            columns.append(_restored(row["numbers"], ("<i8", row["sets"]), ("<u4", row["sets"]), ("<u4", row["sets"]), *[("<u4", row["heads"])] * 5))
            bits.append(row["bits"])
    ids, sizes, heads, word, p, q, own, at = (np.concatenate(x) for x in zip(*columns, strict=True))
    del columns
    sizes = sizes.astype(np.int64)
    close = _closeness(b"".join(bits), sizes)
    del bits
    host = sizes >= bounds[zone]
    source = np.repeat(np.arange(len(ids), dtype=np.int32), heads)
    order = np.lexsort((sizes[source], q, p, word))
    word, p, q, own, at, source = (x[order] for x in (word, p, q, own, at, source))
    edge = np.r_[True, (word[1:] != word[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), True]
    met = ~(edge[1:] & edge[:-1])  # a cell of one set is none
    word, p, q, own, at, source = (x[met] for x in (word, p, q, own, at, source))
    cross = p != q
    edges = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), True]) if len(word) else np.zeros(1, np.int64)
    del p, q, order
    first, rank = _first_words(word, at, source, len(ids))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held, lo = 0, 0
    while lo < len(edges) - 1:
        hi = min(len(edges) - 1, max(lo + 1, int(np.searchsorted(edges, edges[lo] + CHUNK))))
        rows = slice(edges[lo], edges[hi])
        counts = np.diff(edges[lo : hi + 1])
        stop = np.repeat(edges[lo + 1 : hi + 1] - edges[lo], counts)
        lo = hi
        src = source[rows]
        size, place, block, apart, turn = sizes[src], at[rows].astype(np.int64), own[rows], cross[rows], rank[rows]
        # a cell's guests are its smaller sets; each row is compared with the hosts behind it, in the order of sizes
        guests = np.add.reduceat((~host[src]).astype(np.int64), np.cumsum(counts) - counts)
        start = np.maximum(np.arange(len(src)) + 1, np.repeat(np.cumsum(counts) - counts + guests, counts))
        waiting, n_waiting, step, i = [], 0, 0, np.arange(len(src))
        while len(i) or n_waiting:
            i = i[start[i] + step < stop[i]]
            i = i[_enough(size[i], place[i], size[start[i] + step], threshold)]  # no larger set suffices either, then
            j = start[i] + step
            step += 1
            ok = ~apart[i] | (block[i] != block[j])
            ok &= _enough(size[j], place[j], size[i], threshold)
            ok &= (turn[i] == 0) | (first[src[i], 0] != first[src[j], 0])
            waiting.append((i[ok], j[ok]))
            n_waiting += int(ok.sum())
            if n_waiting > 1 << 15 or not len(i):
                x, y = (np.concatenate(k) for k in zip(*waiting, strict=True))
                waiting, n_waiting = [], 0
                near = close(src[x], src[y]) <= (size[x] + size[y]) * (1 - threshold) / (1 + threshold) + 1e-6
                x, y = x[near], y[near]
                before = np.zeros(len(x), bool)
                for k in range(FIRST):
                    before |= (turn[x] > k) & (first[src[x], k, None] == first[src[y]]).any(1)
                x, y = ids[src[x[~before]]], ids[src[y[~before]]]
                held.append((np.minimum(x, y), np.maximum(x, y)))
                n_held += len(x)
                if n_held > HELD:
                    yield _bucketed(held, buckets)
                    held, n_held = [], 0
    yield _bucketed(held, buckets)


def _first_words(word: np.ndarray, at: np.ndarray, source: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's FIRST words by their places, -1 where it has fewer, and how many of its words precede that of each row, at most FIRST."""
    order = np.lexsort((at, source))
    new = np.r_[True, np.diff(source[order]) != 0][: len(order)]
    number = np.cumsum(new | np.r_[True, np.diff(at[order].astype(np.int64)) != 0][: len(order)])
    begin = np.flatnonzero(new)
    rank = np.zeros(len(order), np.int64)
    rank[order] = number - np.repeat(number[begin], np.diff(np.r_[begin, len(order)]))
    first = np.full((n, FIRST), -1, np.int64)
    early = np.flatnonzero(rank < FIRST)
    first[source[early], rank[early]] = word[early]
    return first, np.minimum(rank, FIRST).astype(np.int8)


def _unique(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by a and b, each once."""
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return a[new], b[new]


def _bucketed(pairs: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Pairs, each once, a row for each bucket of a."""
    a, b = _unique(pairs)
    bucket = _mixed(a) % buckets
    order = np.argsort(bucket, kind="stable")
    a, b, bucket = a[order], b[order], bucket[order]
    edges = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]) if len(a) else np.zeros(1, np.int64)
    packed = [_pressed(a[i:j], b[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(np.diff(edges), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "pairs", "numbers"])


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's partners of larger ids, a bucket's pairs at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    known = fresh = 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(tuple(_restored(row["numbers"], ("<i8", row["pairs"]), ("<i8", row["pairs"]))))
            fresh += row["pairs"]
            if fresh > max(1 << 21, known):
                held = [_unique(held)]
                known, fresh = len(held[0][0]), 0
    a, b = _unique(held)
    edges = np.flatnonzero(np.r_[True, np.diff(a) != 0, True]) if len(a) else np.zeros(1, np.int64)
    for lo in range(0, len(edges) - 1, 4096):
        own = edges[lo : lo + 4097]
        others = [_list(b[i:j]) for i, j in zip(own[:-1], own[1:], strict=True)]
        columns = [pa.array(a[own[:-1]]), pa.array(b[own[1:] - 1]), pa.array(np.diff(own), pa.int32()), pa.array(others, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "place", "n", "others"])


def _list(ids: np.ndarray) -> bytes:
    return _pressed(ids) if len(ids) > FIRST else ids.tobytes()


def _unlist(raw: bytes, n: int) -> np.ndarray:
    return _restored(raw, ("<i8", n))[0] if n > FIRST else np.frombuffer(raw, "<i8")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partners of each set, those of a place of many pairs by pairs of parts."""
    kinds = {"place": pa.int64(), "p": pa.int32(), "q": pa.int32(), "a": pa.int64(), "n": pa.int32(), "others": pa.binary()}
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["parts"] == 1:
                rows.append((row["place"], 0, 0, row["a"], row["n"], row["others"]))
                continue
            others = _unlist(row["others"], row["n"])
            part = _mixed(others) % row["parts"]
            p = int(_mixed(np.array([row["a"]]))[0]) % row["parts"]
            for q in np.unique(part).tolist():
                own = others[part == q]
                rows.append((row["place"], p, q, row["a"], len(own), _list(own)))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids that the pairs of a part of a place have."""
    ids, key = np.zeros(0, np.int64), None
    for batch in batches:
        for row in batch.to_pylist():
            key = key or (row["place"], row["p"], row["q"])
            ids = np.union1d(ids, np.r_[row["a"], _unlist(row["others"], row["n"])])
    columns = [pa.array([x] * len(ids), kind) for x, kind in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(ids)], names=["place", "p", "q", "id"])


def _parity(hashes: np.ndarray) -> bytes:
    """A bit for each of some classes of hashes: whether there is an odd number of words of the class.

    There are at least as many classes as words, a power of two, so that halves of bits can be folded onto each other.
    """
    n = max(64, 1 << (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount(hashes % n, minlength=n) & 1).astype(bool)).tobytes()


def _closeness(bits: bytes, sizes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of places of sets: in how many classes their parities differ, after halving the longer one; 0 if that is over twice as long.

    bits: the parities of sets of these sizes, one after another.
    """
    length = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)) // 8
    flat, begin = np.frombuffer(bits, np.uint64), (np.cumsum(length) - length) // 8
    place, whole = np.zeros(len(sizes), np.int64), {}
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        place[own] = np.arange(len(own))
        whole[n] = flat[begin[own][:, None] + np.arange(n // 8)]
    half = {n: x[:, : n // 16] ^ x[:, n // 16 :] for n, x in whole.items() if n > 8}

    def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        short = np.minimum(length[x], length[y])
        for n in np.unique(short).tolist():
            for longer_x, longer_y in ((False, False), (True, False), (False, True)):
                k = np.flatnonzero((short == n) & (length[x] == n * (1 + longer_x)) & (length[y] == n * (1 + longer_y)))
                if len(k):
                    a, b = (half[2 * n] if longer else whole[n] for longer in (longer_x, longer_y))
                    out[k] = np.bitwise_count(a[place[x[k]]] ^ b[place[y[k]]]).sum(1)
        return out

    return differ


def _compared(pairs: pa.Table, members: pa.Table) -> pa.Table:
    """The keys in order and the similarity of each pair."""
    ids = members["id"].to_numpy()
    order = np.argsort(ids)
    ids, keys = ids[order], members["key"].combine_chunks().take(pa.array(order))
    code: dict[bytes, int] = {}
    words = [np.array([code.setdefault(w, len(code)) for w in zlib.decompress(x).split(b" ")], np.int64) for x in members["words"].take(pa.array(order)).to_pylist()]
    size = np.array([len(x) for x in words], np.int64)
    held, x, y, common = np.zeros(len(code), bool), [], [], []
    for row in pairs.to_pylist():
        i, j = np.searchsorted(ids, row["a"]), np.searchsorted(ids, _unlist(row["others"], row["n"]))
        held[words[i]] = True
        for lo in range(0, len(j), 1024):
            own = j[lo : lo + 1024]
            common.append(np.add.reduceat(held[np.concatenate([words[k] for k in own.tolist()])], np.cumsum(size[own]) - size[own], dtype=np.int64))
        held[words[i]] = False
        x.append(np.full(len(j), i))
        y.append(j)
    x, y, common = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (x, y, common))
    rank = np.argsort(np.argsort(np.array(keys.to_pylist(), object)))
    a, b = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
    return pa.table([keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(common / (size[x] + size[y] - common))], names=["key_a", "key_b", "similarity"])
