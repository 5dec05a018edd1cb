"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and components.

A fingerprint's 64 bits are cut into five blocks. Two fingerprints that differ in at most two
bits agree on three whole blocks at least, so each fingerprint joins one shard for each choice of
three blocks and no link can be lost. A shard with many fingerprints is cut once more: the 25 or 26 bits
that it leaves open are six finer blocks, of which two within two bits share four, so its members join
fifteen shards of 1,024 fingerprints at most. A tree is built where the shuffle brought its shard,
because trees of the whole corpus have no size bound under which they could be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import join_hot, settle, slices
from sluice.llm.components import components
from sluice.session import table

SEED = 42
#: Bits of each block, lowest first.
BLOCKS = (13, 13, 13, 13, 12)
RADIUS = 2
#: Fingerprints of a shard beyond which it is cut by finer blocks, and those blocks: six of the bits that the shard leaves open.
SHARD, FINER = 4096, 6
#: Bits within which similar sets' fingerprints are looked for (two sets of similarity 0.8 differ in about 10 bits, unlike ones in
#: 32), hashes of a sketch, and classes that one part of a shard compares, about.
WIDE, SKETCH, MOST = 22, 4, 1000
#: Of the hashes that a slice's sets hold OFTEN times or more, as many of the most frequent as LAST come last in every set's order.
OFTEN, LAST = 2, 50_000
#: Words of 64 bits of a parity map at most; pairs compared at once, and parts over which the pairs of one class are dealt.
PARITY, PAIRS, SALT = 128, 1 << 12, 64
#: Nodes of one tree; a larger shard becomes several trees, all of which are searched.
TREE_NODES = 1 << 16
_CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    """The XXH64 hashes of a text's word shingles, repeats included; of the whole sequence if it is shorter, none without words."""
    words = (text or b"").lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    return [digest(line[i:j], SEED) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], dtype="<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (set_bits * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles, repeats included; no words give 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, bits): the fingerprint of each document as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x, shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, bits long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.children: dict[int, dict[int, int]] = {}
        self.root: int | None = None

    def __len__(self) -> int:
        return len(self.children)

    def add(self, item: int) -> None:
        if self.root is None:
            self.root = item
            self.children[item] = {}
            return
        at = self.root
        while at != item:
            edges = self.children[at]
            distance = (at ^ item).bit_count()
            if distance not in edges:
                edges[distance] = item
                self.children[item] = {}
                return
            at = edges[distance]

    def within(self, item: int, radius: int) -> Iterator[int]:
        """All members within the radius; only edges that may lead to one are followed."""
        todo = [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            distance = (at ^ item).bit_count()
            if distance <= radius:
                yield at
            edges = self.children[at]
            for edge in range(distance - radius, distance + radius + 1):
                if edge in edges:
                    todo.append(edges[edge])


def _shard_links(bits: list[int], ids: list[int], radius: int, nodes: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links inside one shard, as pairs of ids."""
    owner = dict(zip(bits, ids, strict=True))
    parent = {x: x for x in owner}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    trees = [BKTree()]
    for item in owner:
        for tree in trees:
            for other in tree.within(item, radius):
                if (a := find(item)) != (b := find(other)):
                    parent[a] = b
                    yield owner[item], owner[other]
        if len(trees[-1]) >= nodes:
            trees.append(BKTree())
        trees[-1].add(item)


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _shards(bits: Column, places: list[int], cuts: list[int], left_out: int) -> Column:
    """An array of (choice, shared): the bits at `places`, cut into blocks, in every choice of all blocks but `left_out`."""
    blocks = [places[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = combinations(range(len(blocks)), len(blocks) - left_out)
    masks = [sum(1 << p for b in own for p in blocks[b]) for own in chosen]
    return F.array(*[F.struct(F.lit(k).cast("int").alias("choice"), bits.bitwiseAND(_signed(m)).alias("shared")) for k, m in enumerate(masks)])


def links(keyed: DataFrame, radius: int = RADIUS, nodes: int = TREE_NODES, shard: int | None = None) -> DataFrame:
    """(a, b): links between the ids of distinct fingerprints (bits, id), spanning each shard's components.

    A shard of more than `shard` fingerprints (SHARD if not given) is cut by finer blocks.
    """
    if radius > 2:
        raise ValueError("five blocks, three of them equal, find distances of 2 at most")
    cuts = [0, *np.cumsum(BLOCKS).tolist()]
    spread = settle(keyed.select("bits", "id", F.explode(_shards(F.col("bits"), list(range(64)), cuts, 2)).alias("s")).select("s.choice", "s.shared", "bits", "id"), "shards")
    hot = settle(spread.groupBy("choice", "shared").count().filter(F.col("count") > (SHARD if shard is None else shard)).select("choice", "shared", F.lit(True).alias("hot")), "hot")
    whole = [F.lit(-1).cast("int").alias("finer"), F.lit(0).cast("long").alias("part")]
    if hot.isEmpty():
        cold = spread.select("choice", "shared", *whole, "bits", "id")
    else:
        marked = spread.join(hot, ["choice", "shared"], "left")
        finer = F.lit(None).cast("array<struct<choice:int,shared:bigint>>")
        for k, own in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - 2)):
            open_bits = [p for b in range(len(BLOCKS)) if b not in own for p in range(cuts[b], cuts[b + 1])]
            at = [len(open_bits) * x // FINER for x in range(FINER + 1)]
            finer = F.when(F.col("choice") == k, _shards(F.col("bits"), open_bits, at, 2)).otherwise(finer)
        again = marked.filter("hot").select("choice", "shared", F.explode(finer).alias("f"), "bits", "id").select("choice", "shared", F.col("f.choice").alias("finer"), F.col("f.shared").alias("part"), "bits", "id")
        cold = marked.filter("hot is null").select("choice", "shared", *whole, "bits", "id").unionByName(again)
    dealt = cold.repartition("choice", "shared", "finer", "part").sortWithinPartitions("choice", "shared", "finer", "part", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(table: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
            *keys, bits, ids = table
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            edges = np.concatenate(([0], cuts, [len(bits)])).astype(np.int64)
            if not last:  # the final shard may go on in the next batch
                keep, edges = edges[-2], edges[:-1]
            made = []
            for k in np.flatnonzero(np.diff(edges) > 1):
                i, j = edges[k], edges[k + 1]
                made += _shard_links(bits[i:j].view(np.uint64).tolist(), ids[i:j].tolist(), radius, nodes)
            return [] if last else [x[keep:] for x in table], made

        def out(made: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held, made = flush([np.concatenate(x) for x in zip(held, new, strict=True)] if held else new, False)
            yield out(made)
        if held:
            yield out(flush(held, True)[1])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits.
    A null or wordless text has fingerprint zero and links like any other; repeated rows share
    their component; a row without doc_id gets the component of its fingerprint, or null if no
    document with an id has it. Other columns are ignored; an empty table gives no rows.
    """
    marks = settle(fingerprints(docs, shingle), "fingerprints")
    distinct = settle(marks.filter("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("bits", "id"), radius)).withColumnRenamed("node", "id")
    shared = distinct.join(roots, "id", "left").filter("n > 1 or component is not null").select("bits", F.coalesce("component", "id").alias("component"))
    found = marks.join(shared, "bits", "left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ mixed >> np.uint64(32)


def _sketch(distinct: np.ndarray) -> np.ndarray:
    """The SKETCH smallest of the distinct hashes, once mixed."""
    mixed = _mixed(distinct)
    return np.sort(np.partition(mixed, SKETCH)[:SKETCH] if len(mixed) > SKETCH else mixed)


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (small + large - both)


def _similar_links(bits: list[int], ids: list[int], sets: list[np.ndarray], radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs of one shard: a BK-tree finds candidates, the shingle sets decide."""
    tree, members, parent = BKTree(), {}, list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, item in enumerate(bits):
        for near in tree.within(item, radius):
            for other in members[near]:
                if (a := find(k)) != (b := find(other)) and _alike(sets[k], sets[other], similarity):
                    parent[a] = b
                    yield ids[k], ids[other]
        tree.add(item)
        members.setdefault(item, []).append(k)


def _shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def _whole(distinct: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(distinct.tobytes())


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices with a few MB of texts each: sets of all of a batch's texts at once would take much memory."""
    for batch in batches:
        at = 0
        for texts in slices(batch.column(column)):
            yield batch.slice(at, len(texts))
            at += len(texts)


def _parity(distinct: np.ndarray) -> np.ndarray:
    """Bit h mod 64 * words is odd where an odd number of the hashes h fall there; about as many bits as hashes.

    Of two sets' maps of one length, each differing bit needs a hash that only one of the sets has.
    """
    words = min(PARITY, 1 << max(0, (len(distinct) - 1).bit_length() - 6))
    odd = np.bincount((_mixed(distinct) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _prefix(distinct: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """A set's first hashes, once mixed, in the order common to all sets: those of `last`, which ascends, after the others.

    Similar sets share at least `similarity` of either one's hashes, so their first common hash is among these of both.
    """
    mixed = _mixed(distinct)
    need = int(np.ceil(similarity * len(mixed) - 1e-9 * len(mixed)))
    late = last[np.searchsorted(last, mixed).clip(max=len(last) - 1)] == mixed if len(last) else np.zeros(len(mixed), bool)
    return mixed[np.lexsort((mixed, late))][: len(mixed) - max(need, 1) + 1]


def _possible(ids: np.ndarray, component: np.ndarray, n: np.ndarray, at: np.ndarray, part: np.ndarray, maps: list[np.ndarray], apart: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of rows with a common hash, `at` in their order, that may be similar and lie in different components.

    With `apart` only pairs of different parts count. No similar pair is left out whose first common hash this is: the sizes, what
    is left of both sets from that hash on and the parity maps each bound the hashes in common from above.
    """
    words = np.array([len(x) for x in maps])
    left, share = n - at, similarity / (1 + similarity)
    folded: dict[int, np.ndarray] = {}

    def to(w: int) -> np.ndarray:
        """All maps of w words or more, folded to w."""
        if w not in folded:
            folded[w] = np.zeros((len(maps), w), np.uint64)
            for k in np.flatnonzero(words >= w):
                folded[w][k] = np.bitwise_xor.reduce(maps[k].reshape(-1, w), axis=0)
        return folded[w]

    step = max(1, (1 << 18) // max(1, len(ids)))
    for start in range(0, len(ids), step):
        i = np.arange(start, min(start + step, len(ids)))[:, None]
        total = n[i] + n
        fit = (ids[i] < ids) & (component[i] != component) & (np.minimum(n[i], n) >= similarity * np.maximum(n[i], n) - 1e-6) & (np.minimum(left[i], left) >= share * total - 1e-6)
        if apart:
            fit &= part[i] != part
        x, y = np.nonzero(fit)
        x = x + start
        least = np.minimum(words[x], words[y])
        for w in np.unique(least):
            rows, own = to(int(w)), np.flatnonzero(least == w)
            for k in range(0, len(own), PAIRS):
                a, b = x[own[k : k + PAIRS]], y[own[k : k + PAIRS]]
                differ = np.bitwise_count(rows[a] ^ rows[b]).sum(axis=1, dtype=np.int64)
                keep = differ <= (n[a] + n[b]) * (1 - 2 * share) + 1e-6
                yield ids[a[keep]], ids[b[keep]]


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])


def _remaining_links(texts: DataFrame, classes: DataFrame, copies: DataFrame, roots: DataFrame, last: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of classes with a similarity of `similarity` or more whose components, by roots (id, component), still differ.

    Each class meets the others by the hashes of its prefix. A hash that more than MOST classes hold deals them to cells of two
    parts each, so that every pair of parts meets; members of its largest component need no cell of their own.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 1):
            ids, hashes, sizes = batch.column(0).to_numpy(), [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                distinct = _shingle_set(text, shingle)
                hashes.append(_prefix(distinct, last, similarity) if len(distinct) else distinct)
                sizes.append(len(distinct))
            each = np.array([len(x) for x in hashes], np.int64)
            places = np.concatenate([np.arange(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.repeat(ids, each)), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(places.astype(np.int32))], ["hash", "id", "n", "at"])

    holders = texts.join(copies, "doc_id", "left_anti").mapInArrow(first, "hash long, id long, n int, at int")
    one = Window.partitionBy("hash")
    shared = settle(holders.withColumn("held", F.count("*").over(one)).filter("held > 1").drop("held"), "shared")
    parted = shared.join(roots, "id", "left").repartition("hash").withColumn("component", F.coalesce("component", "id")).withColumn("own", F.count("*").over(Window.partitionBy("hash", "component")))
    parted = parted.withColumn("most", F.max(F.struct("own", "component")).over(one)).withColumn("held", F.count("*").over(one)).filter("held > most.own")
    strays, members = (F.ceil(x / MOST).cast("int") for x in (F.col("held") - F.col("most.own"), F.col("most.own")))
    parted = parted.select("hash", "id", "n", "at", "component", (F.col("held") > MOST).alias("large"), (F.col("component") != F.col("most.component")).alias("stray"), strays.alias("strays"), members.alias("members"))
    parted = settle(parted.withColumn("part", F.when(~F.col("large"), 0).otherwise(F.pmod(F.xxhash64("id", "hash"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("members"))) + F.when(F.col("stray"), 0).otherwise(F.col("strays"))).cast("int")), "parted")
    others = F.when(~F.col("large"), F.array(F.lit(0))).when(F.col("stray"), F.sequence(F.lit(0), F.col("strays") + F.col("members") - 1)).otherwise(F.sequence(F.lit(0), F.col("strays") - 1))
    cells = parted.withColumn("other", F.explode(others)).select("hash", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "id", "component", "n", "at")
    dealt = cells.join(classes.select("id", "parity"), "id").select("hash", "x", "y", "part", "id", "component", "n", "at", "parity").repartition("hash", "x", "y").sortWithinPartitions("hash", "x", "y")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(cell: pa.Table) -> pa.RecordBatch:
            _, x, y, part, ids, component, n, at = (c.to_numpy() for c in cell.columns[:8])
            maps = [np.frombuffer(m, "<u8") for m in cell.column(8).to_pylist()]
            found = list(_possible(ids, component, n.astype(np.int64), at.astype(np.int64), part, maps, bool(x[0] != y[0]), similarity))
            return _pairs([f[0] for f in found], [f[1] for f in found])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [c.to_numpy() for c in batch.columns[:3]]
            edges = np.concatenate(([0], np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1, [batch.num_rows])).tolist()
            for i, j in zip(edges, edges[1:], strict=False):
                if held and any(held[0].column(k)[0].as_py() != keys[k][i] for k in range(3)):
                    yield made(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield made(pa.Table.from_batches(held))

    doubtful = settle(dealt.mapInArrow(meet, "a long, b long").distinct().withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")), "doubtful")
    sides = settle(doubtful.select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("doc_id")).distinct().unionByName(doubtful.select("a", "salt", F.lit(1).alias("side"), F.col("b").alias("doc_id"))), "sides")
    both = sides.join(texts, "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "side").select("a", "salt", "side", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in _sliced(batches, 4):
            found = []
            for a, salt, side, b, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if (a, salt) != key:
                    key, own = (a, salt), []
                distinct = _shingle_set(text, shingle)
                if not side:
                    own.append(distinct)
                elif any(_alike(x, distinct, similarity) for x in own):
                    found.append((a, b))
            yield _pairs([np.array([x[0] for x in found], np.int64)], [np.array([x[1] for x in found], np.int64)])

    return both.mapInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WIDE) -> DataFrame:
    """doc_id and component_id of each document with an id: the smallest doc_id reachable over pairs whose sets of word
    shingles have a Jaccard similarity of `similarity` or more. No such pair is lost.

    Documents of equal sets are one class, and wordless ones are another. Classes meet first in shards, one for each of the SKETCH
    smallest of a set's mixed hashes, in which similar sets nearly always share one; a shard of more than MOST classes deals its
    members to further shards by a second hash of their sketches, and to parts at random where it or these are still larger. In a shard
    BK-trees of fingerprints find what lies within `radius` bits, and the whole sets are then compared. What these miss, pairs
    without a common sketch hash, beyond the radius or in different parts of a large shard, _remaining_links finds.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "bits", "whole", "sketch", "parity", "hash", "times"]
        for batch in _sliced(batches, 1):
            made, sets = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, shingle)
                distinct = np.unique(np.array(hashes, np.uint64))
                sets.append(distinct)
                made.append((majority(hashes), _whole(distinct), _sketch(distinct).view(np.int64).tolist(), _parity(distinct).tobytes()))
            bits, whole, sketch, parity = zip(*made, strict=True)
            none = pa.nulls(len(made), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(bits, np.uint64).view(np.int64)), pa.array(whole, pa.string()), pa.array(sketch, pa.list_(pa.int64())), pa.array(parity, pa.binary()), none, none], names)
            values, times = np.unique(np.concatenate(sets), return_counts=True)
            often = times >= OFTEN
            columns = [pa.nulls(int(often.sum()), t) for t in (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_mixed(values[often]).view(np.int64)), pa.array(times[often])], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    marked = settle(texts.mapInArrow(mark, "doc_id long, bits long, whole string, sketch array<long>, parity binary, hash long, times long"), "marks")
    marks = marked.filter("doc_id is not null").drop("hash", "times")
    often = marked.filter("doc_id is null").groupBy("hash").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "hash").limit(LAST)
    last = np.sort(np.array([r["hash"] for r in often.select("hash").collect()], np.int64).view(np.uint64))
    classes = settle(marks.groupBy("whole").agg(F.min("doc_id").alias("id"), F.any_value("bits").alias("bits"), F.any_value("sketch").alias("sketch"), F.any_value("parity").alias("parity"), F.count("*").alias("rows")), "classes")

    def counted(rows: DataFrame) -> DataFrame:
        return join_hot(rows, settle(rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "sizes"), ["shard"], "n").filter("n > 1")

    first = settle(classes.select(F.explode("sketch").alias("shard"), "id", "whole", "bits", "sketch"), "shards")
    shared = settle(counted(first), "shards")
    finer = shared.filter(F.col("n") > MOST).withColumn("t", F.explode("sketch")).filter("t <> shard").select(F.xxhash64(F.least("shard", "t"), F.greatest("shard", "t")).alias("shard"), "id", "whole", "bits").distinct()
    again = settle(finer, "finer")
    both = shared.select("shard", "n", "id", "whole", "bits").unionByName(counted(again).select("shard", "n", "id", "whole", "bits"))
    parts = settle(both.withColumn("part", F.pmod(F.xxhash64("id", "shard"), F.ceil(F.col("n") / MOST)).cast("int")), "parts")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 2):
            whole = [_whole(_shingle_set(text, shingle)) for text in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.string())], ["id", "whole", "text", "found"])

    wanted = settle(parts.select("id", "whole").distinct(), "wanted")
    held = texts.join(wanted, F.col("doc_id") == F.col("id")).select("id", "whole", "text").mapInArrow(gather, "id long, whole string, text string, found string")
    whole_texts = held.filter("found = whole").dropDuplicates(["id", "whole"]).select("id", "whole", "text")
    dealt = parts.select("shard", "part", "bits", "id", "whole").join(whole_texts, ["id", "whole"]).repartition("shard", "part").sortWithinPartitions("shard", "part", "bits", "id").select("shard", "part", "bits", "id", "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def made() -> pa.RecordBatch:
            bits, ids, sets = zip(*rows, strict=True) if rows else ((), (), ())
            found = list(_similar_links([b & ((1 << 64) - 1) for b in bits], list(ids), list(sets), radius, similarity))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in _sliced(batches, 4):
            for shard, part, bits, doc, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if (shard, part) != key:
                    yield made()
                    key, rows = (shard, part), []
                rows.append((bits, doc, _shingle_set(text, shingle)))
        yield made()

    links_found = settle(dealt.mapInArrow(link, "a long, b long"), "links")
    roots = settle(components(links_found).withColumnRenamed("node", "id"), "roots")
    doubles = classes.filter("rows > 1").select("whole", "rows", "id")
    copies = join_hot(marks.select("doc_id", "whole"), doubles, ["whole"], "rows").filter("doc_id <> id").select("doc_id").distinct()
    copies = settle(copies.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "copies")
    more = settle(_remaining_links(texts, classes, copies, roots, last, shingle, similarity), "more")
    if not more.isEmpty():
        edges = roots.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        roots = components(edges).withColumnRenamed("node", "id")
    leaders = settle(classes.join(roots, "id", "left").select("whole", "rows", F.coalesce("component", "id").alias("component_id")), "leaders")
    return join_hot(marks.select("doc_id", "whole"), leaders, ["whole"], "rows").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """The documents, with their own columns, that lead their component; rows without doc_id stay.

    Components are those of simhash_groups, or with a similarity those of similar_groups, whose radius is its own.
    Of repeated rows of one doc_id a single one stays.
    """
    groups = simhash_groups(docs, shingle, radius) if similarity is None else similar_groups(docs, shingle, similarity)
    others = settle(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "copies")
    repeated = settle(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    left = docs.join(others, "doc_id", "left_anti")
    once = left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
