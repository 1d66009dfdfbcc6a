"""Near-duplicates by SimHash fingerprints and BK-trees.

Equal fingerprints collapse first. A link differs in at most ``radius`` bits, so of radius + 1
bit blocks at least one is equal on both sides: each fingerprint goes to one shard per block,
keyed by the block's value, and no link is lost. In a shard the fingerprints form a BK-tree: a
node's children are keyed by their integer Hamming distance to it, and a query at distance d
follows only the edges within d - radius to d + radius. All trees of a task grow and are searched
level by level in vectorised steps. A shard over
``shard_limit`` is dealt again by a further block of the bits not yet fixed (the same argument
holds there), so a tree has a proven bound and travels with its shard; it is never one tree of
all fingerprints. Trees return a spanning forest of their links, not all pairs, and Spark rounds
join the forests into components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, in_chunks, packed, shared_checkpoint, shuffle_partitions, split_words, text_bytes
from .components import connected_components

BITS = 64
#: Members of trees that grow together, and pairs of query and node in one vectorised step.
STEP = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each ``data[start:end]``; ranges of one length go through its steps together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight, four = (np.ndarray((len(data) + 1,), kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 1 << 16 else size, kind="stable")
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            at, n = starts[own], int(size[own[0]])
            left = n
            if n >= 32:
                lanes = [np.full(len(own), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
                while left >= 32:
                    for k in range(4):
                        lanes[k] = rotated(lanes[k] + eight[at + 8 * k] * P2, 31) * P1
                    at, left = at + 32, left - 32
                h = sum(rotated(v, r) for v, r in zip(lanes, (1, 7, 12, 18), strict=True))
                for v in lanes:
                    h = (h ^ rotated(v * P2, 31) * P1) * P1 + P4
            else:
                h = np.full(len(own), seed + P5, np.uint64)
            h += np.uint64(n)
            while left >= 8:
                h = rotated(h ^ rotated(eight[at] * P2, 31) * P1, 27) * P1 + P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = rotated(h ^ four[at].astype(np.uint64) * P1, 23) * P2 + P3
                at, left = at + 4, left - 4
            while left:
                h = rotated(h ^ padded[at].astype(np.uint64) * P5, 11) * P1
                at, left = at + 1, left - 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[own] = h ^ (h >> np.uint64(32))
    return out


#: Shingles whose bits are counted at a time.
VOTES = 1 << 14


def simhashes(data: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """64-bit SimHash of the word shingles of each joined text ``data[bound:next bound]``; 0 for one without words."""
    starts, ends, doc = split_words(data, bounds)
    # the words with one space after each: what lies between two of a text is then what joins them
    keep = np.zeros(len(data) + 1, bool)
    keep[:-1] = ~IS_SPACE[data]
    place = np.cumsum(keep) - keep
    place = place[starts] + np.arange(len(starts))
    size = ends - starts
    text = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    solid = np.ones(len(text), bool)
    solid[place + size] = False
    text[solid] = _LOWER[data[keep[:-1]]]
    n = np.bincount(doc, minlength=len(bounds) - 1)
    shingles = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    owner, first = spread(np.cumsum(n) - n, shingles)
    last = np.minimum(first + width, np.cumsum(n)[owner]) - 1
    votes = np.zeros((len(n), BITS), np.int64)
    hashes = xxh64(text, place[first], place[last] + size[last], 42)
    for i in range(0, len(first), VOTES):
        own = owner[i : i + VOTES]
        bits = np.unpackbits(hashes[i : i + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.diff(own, prepend=-1))
        votes[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, hashed: bool = False) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long, and the text's hash if ``hashed``) of every row."""
    carried = [pa.field("hash", pa.int64())] if hashed else []
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.empty(0, np.uint64), *(simhashes(*part, width) for part in in_chunks(batch.column("data")))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *(batch.column(f.name) for f in carried)], schema=schema)

    hashes = [text_hash(text_col)] if hashed else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("data"), *hashes)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", hash long" * hashed)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string")).alias("hash")


# ---------------------------------------------------------------- BK-trees


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number of each range, and its members: first, first + 1 ... of every (first, count)."""
    row = np.repeat(np.arange(len(first)), count)
    skip = np.repeat(np.cumsum(count) - count, count)
    return row, np.repeat(first, count) + np.arange(len(row)) - skip


@dataclass
class Level:
    """The nodes of all trees at one depth."""

    #: Each node's fingerprint, as a place in fp.
    root: np.ndarray
    #: Node number x (BITS + 1) + distance of every edge, sorted; an edge's number is its node's on the next level.
    edges: np.ndarray


def grow(fp: np.ndarray, tree: np.ndarray) -> list[Level]:
    """BK-trees of the fingerprints, one for each number in ``tree``, which counts from 0 in sorted order.

    A node's root is its first member; the others become children by their distance to it.
    """
    member, node = np.arange(len(fp)), tree.astype(np.int64)
    levels = []
    while len(member):
        first = np.flatnonzero(np.diff(node, prepend=-1))
        root = member[first]
        rest = np.ones(len(member), bool)
        rest[first] = False
        member, node = member[rest], node[rest]
        code = node * (BITS + 1) + distance(fp[member], fp[root[node]])
        order = np.argsort(code, kind="stable")
        member, code = member[order], code[order]
        new = np.diff(code, prepend=-1) > 0
        levels.append(Level(root, code[new]))
        node = np.cumsum(new) - 1
    return levels


def tree_links(fp: np.ndarray, tree: np.ndarray, radius: int, visits: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each tree, every one at least once, as places in fp.

    Every member is a query too. It meets a node only by the edges within its distance to the
    parent plus or minus the radius. Queries that meet over STEP nodes of a level go on in parts,
    so memory is bounded. ``visits`` gets the number of nodes met by every step.
    """
    levels = grow(fp, tree)
    waiting = [(0, np.arange(len(fp)), tree.astype(np.int64))]
    while waiting:
        depth, query, node = waiting.pop()
        if len(query) > STEP:
            waiting += [(depth, query[i : i + STEP], node[i : i + STEP]) for i in range(0, len(query), STEP)]
            continue
        if not len(query):
            continue
        root, edges = levels[depth].root[node], levels[depth].edges
        if visits is not None:
            visits.append(len(query))
        d = distance(fp[query], fp[root]).astype(np.int64)
        hit = (d <= radius) & (query != root)
        yield query[hit], root[hit]
        code = node * (BITS + 1)
        low = np.searchsorted(edges, code + np.maximum(d - radius, 0))
        high = np.searchsorted(edges, code + np.minimum(d + radius, BITS), "right")
        row, child = spread(low, high - low)
        waiting.append((depth + 1, query[row], child))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest connected place for each of n places, from links in parts."""
    label = np.arange(n)

    def settle() -> None:
        while True:
            up = label[label]
            if np.array_equal(up, label):
                return
            label[:] = up

    for a, b in links:
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            settle()
    return label


def blocks(free: list[int], n: int) -> list[list[int]]:
    """The free bits in n runs of near-equal length."""
    cut = [len(free) * i // n for i in range(n + 1)]
    return [free[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def bits_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def shards(fp: np.ndarray, radius: int, limit: int, free: list[int] | None = None) -> Iterator[np.ndarray]:
    """Places of the members of bounded shards that together hold every link of one large shard."""
    free = list(range(BITS)) if free is None else free
    for block in blocks(free, radius + 1):
        rest = [b for b in free if b not in block]
        value = bits_value(fp, block)
        order = np.argsort(value, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(part) > limit and len(rest) > radius:
                for sub in shards(fp[part], radius, limit, rest):
                    yield part[sub]
            elif len(part) > 1:
                yield part


def near_links(distinct: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """Spanning links (a, b: signed fingerprints) of the distinct fingerprints ``fp`` (no nulls, no repeats) within the radius; none for an empty table."""
    parts = blocks(list(range(BITS)), radius + 1)
    spark = distinct.sparkSession
    n = 4 * shuffle_partitions(spark)
    keys = []
    for k, block in enumerate(parts):
        mask = (1 << len(block)) - 1
        value = F.shiftrightunsigned("fp", block[0]).bitwiseAND(F.lit(mask))
        keys.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", (F.col("key.value") * F.lit(len(parts)) + F.col("key.block")).alias("shard"))
    # shards over the limit are dealt once more by a second block, so that no task holds one whole
    hot = dealt.groupBy("shard").count().filter(F.col("count") > shard_limit).select("shard", F.lit(True).alias("hot"))
    first = F.pmod("shard", F.lit(len(parts)))
    second = []
    for k, block in enumerate(parts):
        rest = [b for other in parts if other is not block for b in other]
        again = []
        for j, sub in enumerate(blocks(rest, radius + 1)):
            value = F.lit(0).cast("long")
            for i, bit in enumerate(sub):
                value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1)), i))
            again.append(value * F.lit(radius + 1) + F.lit(j))
        second.append(F.when(first == k, F.array(*again)))
    deal = F.when(F.col("hot"), F.coalesce(*second)).otherwise(F.array(F.lit(-1).cast("long")))
    settled = dealt.join(hot, "shard", "left").select("fp", "shard", F.explode(deal).alias("sub"))
    placed = settled.select("fp", F.pmod(F.xxhash64("shard", "sub"), F.lit(n)).cast("int").alias("task"), F.xxhash64("shard", "sub").alias("tree"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        tree = table.column("tree").to_numpy()
        order = np.lexsort((fp, tree))
        fp, tree = fp[order], tree[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(tree)) + 1, [len(tree)]))
        size = np.diff(cut)
        number = np.repeat(np.arange(len(size)), size)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            small = np.flatnonzero((size > 1) & (size <= shard_limit))
            load = np.cumsum(size[small])
            for group in np.split(small, np.searchsorted(load, np.arange(STEP, load[-1] if len(load) else 0, STEP))):
                keep = np.concatenate([np.arange(cut[g], cut[g + 1]) for g in group]) if len(group) else np.empty(0, int)
                tree = np.cumsum(np.diff(number[keep], prepend=-1) > 0) - 1
                for a, b in tree_links(fp[keep], tree, radius):
                    yield keep[a], keep[b]
            for g in np.flatnonzero(size > shard_limit):
                own = np.arange(cut[g], cut[g + 1])
                for part in shards(fp[own], radius, shard_limit):
                    for a, b in tree_links(fp[own[part]], np.zeros(len(part), int), radius):
                        yield own[part][a], own[part][b]

        label = forest(len(fp), found())
        tied = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table([pa.array(fp[tied].view(np.int64)), pa.array(fp[label[tied]].view(np.int64))], schema=schema)

    return placed.groupBy("task").applyInArrow(run, "a long, b long")


def components_of(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, shard_limit: int, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, hash if ``hashed``) of every row, and (fp, root, component_id) of every fingerprint."""
    prints = shared_checkpoint(fingerprints(docs, id_col, text_col, width, hashed))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(groups.select("fp"), radius, shard_limit)
    roots = connected_components(links).withColumnsRenamed({"node": "fp"})
    tied = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a table, so that the join's sides are plain exchanges and a large component is split
    smallest = shared_checkpoint(tied.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints, tied.join(smallest, "root").select("fp", "root", "component_id")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, shard_limit: int = 20_000) -> DataFrame:
    """Every row's fingerprint and near-duplicate component.

    One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id: the
    smallest doc_id reachable by links of at most ``radius`` differing bits. Fingerprints come
    from lower-cased (A-Z) words in ``width``-word shingles, repeats included; a shorter text is
    one shingle; null and blank texts have fingerprint zero and link like others. Rows with a
    null id link others but are no component's smallest id unless all are null (then null);
    repeated rows share a component; an empty table gives no rows; other columns are not read.
    """
    prints, named = components_of(docs, id_col, text_col, width, radius, shard_limit)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, shard_limit: int = 20_000) -> DataFrame:
    """The rows of ``docs``, whole, one of each near-duplicate component: that of the smallest id.

    Rows that repeat an id are separate documents: the row that stays is found by id and text
    hash, the least hash first where rows of a component share its smallest id; of rows that share
    both the one with the least hash of all columns stays. A component without ids keeps the row of the least hash. Texts are shuffled
    once, by id and hash.
    """
    prints, named = components_of(docs, id_col, text_col, width, radius, shard_limit, hashed=True)
    keys = ["none", "id", "hash"]

    def place(doc_id: Column, digest: Column) -> dict[str, Column]:
        return dict(zip(keys, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), digest), strict=True))

    # by fingerprint before the join, so that no large group of copies meets in it
    least = prints.groupBy("fp").agg(F.min(F.struct(*(c.alias(k) for k, c in place(F.col("doc_id"), F.col("hash")).items()))).alias("row"))
    first = least.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    hashable = [f"row.`{f.name}`" for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    placed = packed(docs, **place(F.col(id_col).cast("long"), text_hash(text_col)))
    kept = placed.join(first, keys, "left_semi").groupBy(*keys).agg(F.min_by("row", F.xxhash64(*hashable)).alias("row"))
    return kept.select("row.*")
