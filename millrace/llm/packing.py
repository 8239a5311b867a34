"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

A document's tokens are cut into pieces of at most `capacity`; only the first piece may be shorter.
Full pieces are sequences of their own. The others are dealt into shards; several islands each evolve
packings of a shard's pieces. Parents are best fit, best fit in a perturbed order, and bins filled exactly
one by one. Crossover injects whole well-filled bins of one parent into another, bins with displaced
duplicates are dissolved, and what they held is placed again by best fit; swaps of single pieces then move
the room that is left into as few bins as they can. After each epoch every island sends its elite to the
next island of its shard. A shard stops at the lower bound of its total length. Bins that stay poorly filled are dissolved and dealt again with those of other
shards, so the loss of shards doesn't add up.

Null and empty texts have one piece: the end token. Null ids are kept; repeated ids are documents
of their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._common import checkpoint

SHARD_PIECES = 2000
ISLANDS = 2
POPULATION = 4
EPOCHS = 2
GENERATIONS = 6
SWAP_ROUNDS = 8
POOL = 4000  # pieces of bins with room that swaps look at
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _encoder(path: str):
    """Ids of texts, equal to those of the tokenizer file: its vocabulary as ranks.

    Texts with the string of a special token go to the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    of_char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


# Fixed value: the pattern by which the tokenizer's pre-tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and pid (a number of its own) of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                owner, numbers = [], []
                for row, text in enumerate(part["text"].to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    at = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        owner.append(row)
                        numbers.append((k, i, j - i, zlib.crc32(ids[i:j].tobytes())))
                columns = np.array(numbers, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c) for c in columns[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return checkpoint(rows.mapInArrow(cut, PIECE).withColumn("pid", F.monotonically_increasing_id()))


def best_fit(lengths: np.ndarray, items: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Place the items, longest first, each in the fullest bin that takes it; new bins where none does."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in sorted(items, key=lambda k: -lengths[k]):
        n = int(lengths[i])
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(r)
        bins[b].append(i)
        room[b] = r - n
        if room[b]:
            bisect.insort(free, (room[b], b))


def _fitness(bins: list[list[int]], room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then bins that are filled unevenly, which leave room to gain."""
    return len(bins), -sum((1 - r / capacity) ** 2 for r in room)


def crossover(a, b, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
    """A child of two packings: a's, with a tenth to all of b's better-filled half of bins injected."""
    bins_a, room_a = a
    bins_b, room_b = b
    by_fill = np.argsort(room_b, kind="stable")
    share = rng.uniform(0.1, 1.0)
    chosen = [bins_b[k] for k in by_fill[: max(1, len(bins_b) // 2)] if rng.random() < share] or [bins_b[by_fill[0]]]
    injected = {i for x in chosen for i in x}
    bins = [list(x) for x in chosen]
    loose: list[int] = []
    for x in bins_a:
        if injected.isdisjoint(x):
            bins.append(list(x))
        else:
            loose += [i for i in x if i not in injected]
    room = [capacity - int(lengths[x].sum()) for x in bins]
    best_fit(lengths, loose, bins, room, capacity)
    return bins, room


def swap_rooms(packing, lengths: np.ndarray, capacity: int, rounds: int = SWAP_ROUNDS):
    """The packing after swaps of a piece of one bin for a longer one (or a piece for nothing) that fit and make the bins' rooms less even.

    Fuller bins get fuller, and the room goes to the emptiest; a bin that loses its last piece is gone.
    """
    bins, room = [list(x) for x in packing[0]], np.array(packing[1], np.int64)
    for _ in range(rounds):
        loose = np.flatnonzero(room)
        held = np.cumsum([len(bins[k]) for k in loose])
        loose = loose[held <= POOL]
        if len(loose) < 2:
            break
        items = [i for k in loose for i in bins[k]]
        m = len(items)
        owner = np.r_[np.repeat(loose, [len(bins[k]) for k in loose]), loose]
        given = np.r_[lengths[items], np.zeros(len(loose), np.int64)]  # the last ones stand for giving nothing
        # only pieces longer than the own one, by no more than the own bin's room, can come: a stretch of all pieces by length
        by_length = np.argsort(given[:m], kind="stable")
        lo = np.searchsorted(given[by_length], given, side="right")
        hi = np.searchsorted(given[by_length], given + room[owner], side="right")
        taker = np.repeat(np.arange(len(given)), hi - lo)
        coming = by_length[np.arange(len(taker)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        more = given[coming] - given[taker]
        gain = more * (more + room[owner[coming]] - room[owner[taker]])
        gain[owner[coming] == owner[taker]] = 0
        touched: set[int] = set()
        some = np.flatnonzero(gain > 0)
        for k in some[np.argsort(-gain[some], kind="stable")].tolist():
            a, b = int(taker[k]), int(coming[k])
            fuller, emptier = int(owner[a]), int(owner[b])
            if fuller in touched or emptier in touched:
                continue
            touched |= {fuller, emptier}
            bins[emptier].remove(items[b])
            bins[fuller].append(items[b])
            if a < m:
                bins[fuller].remove(items[a])
                bins[emptier].append(items[a])
            room[fuller] -= more[k]
            room[emptier] += more[k]
        if not touched:
            break
    kept = [k for k in range(len(bins)) if bins[k]]
    return [bins[k] for k in kept], [int(room[k]) for k in kept]


def exact_fill(lengths: np.ndarray, capacity: int, rng: np.random.Generator):
    """Bins filled one by one: the longest piece left, and the one or two pieces that leave the least room."""
    stacks: dict[int, list[int]] = {}
    for i in rng.permutation(len(lengths)).tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    count = np.bincount(lengths, minlength=capacity + 1)
    bins: list[list[int]] = []
    room: list[int] = []

    def take(n: int) -> int:
        count[n] -= 1
        return stacks[n].pop()

    for top in range(int(lengths.max()), 0, -1):
        while count[top]:
            own, left = [take(top)], capacity - top
            shortest = int(np.flatnonzero(count)[0]) if count.any() else capacity + 1
            for want in range(left, shortest - 1, -1):
                half = want // 2
                small, large = count[1 : half + 1], count[want - 1 : want - half - 1 : -1]
                pairs = (small > 0) & (large > 0)
                if want % 2 == 0 and half and count[half] < 2:
                    pairs[half - 1] = False
                some = np.flatnonzero(pairs)
                if count[want] and (not len(some) or rng.random() < 0.7):
                    own.append(take(want))
                elif len(some):
                    n = int(rng.choice(some)) + 1
                    own += [take(n), take(want - n)]
                else:
                    continue
                left -= want
                break
            bins.append(own)
            room.append(left)
    return bins, room


def mutate(packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
    """Dissolve the least filled bins and a few others, and place their pieces again."""
    bins, room = packing
    gone = set(np.argsort(room)[-max(1, len(bins) // 50) :].tolist()) | set(rng.integers(0, len(bins), 3).tolist())
    kept = [list(x) for k, x in enumerate(bins) if k not in gone]
    left = [room[k] for k in range(len(bins)) if k not in gone]
    best_fit(lengths, [i for k in gone for i in bins[k]], kept, left, capacity)
    return kept, left


def _first(lengths: np.ndarray, capacity: int, rng: np.random.Generator | None):
    bins, room = [], []
    order = list(range(len(lengths)))
    if rng is None:
        best_fit(lengths, order, bins, room, capacity)
        return bins, room
    loud = lengths * (1 + 0.2 * rng.random(len(lengths)))  # nearly the longest first
    free: list = []
    for i in np.argsort(-loud, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(r)
        bins[b].append(i)
        room[b] = r - n
        if room[b]:
            bisect.insort(free, (room[b], b))
    return bins, room


def evolve(lengths: np.ndarray, capacity: int, seed: int, elites: list, generations: int = GENERATIONS):
    """One island's epoch: its best packing, from best fit, perturbed starts and the elites it was sent."""
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // capacity)
    best = _first(lengths, capacity, None)
    if len(best[0]) == bound:
        return best
    elites = elites[: POPULATION - 2]
    people = [best, *elites, exact_fill(lengths, capacity, rng)]
    people += [_first(lengths, capacity, rng) for _ in range(POPULATION - len(people))]
    for _ in range(generations):
        people.sort(key=lambda p: _fitness(*p, capacity))
        if len(people[0][0]) == bound:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child = crossover(people[min(a, b)], people[max(a, b)], lengths, capacity, rng)
        child = swap_rooms(mutate(child, lengths, capacity, rng), lengths, capacity)
        if _fitness(*child, capacity) < _fitness(*people[-1], capacity):
            people[-1] = child
    return min(people, key=lambda p: _fitness(*p, capacity))


def _epoch(epoch: int, capacity: int):
    """For one shard on one island: evolve, and report each piece's bin."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = key
        # pieces in an order of their own, so that places mean the same on every island
        mine = rows[rows["sender"] == -1].sort_values("pid", kind="stable")
        lengths = mine["length"].to_numpy()
        elites = []
        for _, sent in rows[rows["sender"] >= 0].groupby("sender"):
            of = sent.sort_values("pid", kind="stable")["bin"].to_numpy()
            bins = [np.flatnonzero(of == k).tolist() for k in range(int(of.max()) + 1)]
            elites.append((bins, [capacity - int(lengths[x].sum()) for x in bins]))
        bins, _ = evolve(lengths, capacity, seed=1000 * epoch + 10 * int(shard) + int(island), elites=elites)
        of = np.zeros(len(mine), np.int64)
        fill = np.zeros(len(mine), np.int64)
        for k, x in enumerate(bins):
            of[x] = k
            fill[x] = lengths[x].sum()
        return pd.DataFrame({"pid": mine["pid"].to_numpy(), "length": lengths, "shard": shard, "island": island, "bin": of, "fill": fill, "bins": len(bins)})

    return run


_BIN = "pid long, length long, shard int, island int, bin long, fill long, bins int"


def evolve_shards(items: DataFrame, capacity: int) -> DataFrame:
    """Pieces (pid, length, shard) with the bin of their shard's best packing over all islands."""
    base = items.select("pid", "length", "shard").withColumn("bin", F.lit(-1).cast("long")).withColumn("sender", F.lit(-1))
    everywhere = base.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    found = checkpoint(everywhere.groupBy("shard", "island").applyInPandas(_epoch(0, capacity), _BIN))
    for epoch in range(1, EPOCHS):
        # shards that are at the lower bound are done
        bound = found.groupBy("shard", "island").agg(F.ceil(F.sum("length") / capacity).alias("bound"), F.first("bins").alias("bins"))
        open_shards = bound.groupBy("shard").agg(F.min(F.col("bins") - F.col("bound")).alias("over")).filter("over > 0").select("shard")
        if open_shards.isEmpty():
            break
        sent = found.withColumn("sender", F.col("island")).withColumn("island", (F.col("island") + 1) % ISLANDS)
        going = everywhere.unionByName(sent.select(*everywhere.columns)).join(open_shards, "shard", "left_semi")
        more = going.groupBy("shard", "island").applyInPandas(_epoch(epoch, capacity), _BIN)
        found = checkpoint(found.unionByName(more.withColumn("island", F.col("island") + ISLANDS * epoch)))
    best = found.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best")).select("shard", F.col("best.island").alias("island"))
    return found.join(best, ["shard", "island"]).drop("island", "bins")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, shard_pieces: int = SHARD_PIECES, well_filled: float = 0.995, rounds: int = 3) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset."""
    cut = pieces(docs, tokenizer, capacity, end_id)
    full = cut.filter(F.col("length") == capacity).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cut.filter(F.col("length") < capacity).select("pid", "length")
    done = [full]
    for r in range(1, rounds + 1):
        n = items.count()
        if not n:
            break
        shards = -(-n // shard_pieces)
        items = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(r), "pid"), F.lit(shards)).cast("int"))
        packed = checkpoint(evolve_shards(items, capacity))
        last = r == rounds or shards == 1
        good = packed if last else packed.filter(F.col("fill") >= well_filled * capacity)
        before = Window.partitionBy("shard", "bin").orderBy("pid")
        offset = F.coalesce(F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        done.append(good.select("pid", F.first("pid").over(before).alias("sequence_id"), offset.alias("offset")))
        if last:
            break
        items = packed.filter(F.col("fill") < well_filled * capacity).select("pid", "length")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return cut.join(placed, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
