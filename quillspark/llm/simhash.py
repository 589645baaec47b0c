"""Near-duplicates by SimHash: pigeonhole blocks, join on blocks, verify Hamming distance.

1. Fingerprint: 64 majority bits over the XXH64 of all word shingles, repeats
   included (Arrow batches; one document at a time in memory).
2. Equal fingerprints fold to one row, so a group of exact copies costs one row.
3. Blocks: 64 bits in six blocks.  Fingerprints that differ in three bits or
   fewer agree in three whole blocks at least, so they share one of the 20 keys of
   about 32 bits (short keys of one block would hold ever more rows each).
4. Buckets above ``BUCKET`` fingerprints are divided again by the same rule on
   their other bits: such a bucket fixes about 48 bits and is bounded by 2^17.
5. In a bucket a search from each fingerprint to those not yet reached, verified
   by Hamming distance, gives a spanning forest: the same components as all pairs,
   but a link less than fingerprints, whatever the group's size.
6. Connected components over the links.

:func:`similar_groups` does the same for copies by similarity, with fingerprints of 1024
bits; :func:`drop_near_copies` stands on it.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of all.
A null doc_id is never a component's id unless no member has one (then null).
Repeated rows each give a row.  An empty table gives an empty table.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, doc_columns, text_of, without_keys, written
from .components import connected_components

#: Words in a shingle, the hash's seed and the most differing bits, where no contract says otherwise.
SHINGLE, SEED, DISTANCE = 5, 42, 3
#: Fingerprints in a bucket above which it is divided again.
BUCKET = 4096
_PART = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle.  ``bytes.lower`` and ``bytes.split`` know ASCII only, as the contract asks."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip((ends - size)[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash."""
    hashes = shingle_hashes(text, shingle)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        part = hashes[at : at + _PART]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): a row per document; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return doc_columns(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(bits: list[int], distance: int = DISTANCE, blocks: int = 6) -> list[int]:
    """Masks of all ways to choose ``blocks - distance`` of the blocks that ``bits`` are cut into.

    With at most ``distance`` differing bits, one of the masks covers none of them.
    """
    cuts = [sum(1 << b for b in bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(cuts, blocks - distance)]


def _links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of values within ``distance`` bits."""
    found, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            near = np.bitwise_count(rest ^ q) <= distance
            if near.any():
                reached, rest = rest[near], rest[~near]
                found += [(q, x) for x in reached]
                queue += list(reached)
    return found


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between different fingerprints of ``distinct(fp)`` that connect
    just those that are connected by steps of at most ``distance`` bits."""
    first = block_masks(list(range(64)), distance)
    second = [[m | s for s in block_masks([b for b in range(64) if not m >> b & 1], distance)] for m in first]
    fp = F.col("fp")

    def key(t: int, m: int):
        return F.struct(F.lit(t).cast("int").alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key"))

    keyed = distinct.select("fp", F.explode(F.array(*(key(t, m) for t, m in enumerate(first)))).alias("k")).select("fp", "k.t", "k.key")
    hot = keyed.groupBy("t", "key").count().filter(F.col("count") > bucket).select("t", "key", F.lit(True).alias("hot"))
    routed = keyed.join(hot, ["t", "key"], "left")
    cold = routed.filter("hot IS NULL").select("t", "key", "fp")
    choice = F.lit(None).cast("array<struct<t:int,key:bigint>>")
    for t, masks in enumerate(second):
        choice = F.when(F.col("t") == t, F.array(*(key(100 + 20 * t + s, m) for s, m in enumerate(masks)))).otherwise(choice)
    again = routed.filter("hot").select("fp", F.explode(choice).alias("k")).select("k.t", "k.key", "fp")
    buckets = cold.unionAll(again).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            pairs: list[tuple[int, int]] = []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if j - i == 2:
                    if (int(flat[i]) ^ int(flat[i + 1])).bit_count() <= distance:
                        pairs.append((flat[i], flat[i + 1]))
                else:
                    pairs += _links(flat[i:j], distance)
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per document."""
    each = written(fingerprints(docs, shingle), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(fingerprint_links(distinct.select("fp"), distance, bucket)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = linked.join(smallest, "root").select("fp", "least")
    reps = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return each.join(reps, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- By similarity ------------------------------------------------------------------------------
#
# Three bits of 64 catch near-identical texts.  Copies with a Jaccard similarity of 0.8
# differ in ten bits of 64, too many for blocks that still tell texts apart.  A fingerprint
# of 1024 bits has 64 blocks of 16: two texts with similarity s agree in a bit with chance
# 1 - acos(2s / (1 + s)) / pi, so at 0.8 they share a block with chance 0.994 (0.9998 at 0.9).

WIDE, BLOCK = 16, 16
SIMILARITY = 0.8
#: Rows of a large bucket taken together, rows of a small one, and the most differing bits of two
#: sketches, a fingerprint's first 128 bits: at a similarity of 0.8 they differ in 19, 28 lie 2.2 deviations above.
_CHUNK, _SMALL, _NEAR = 4096, 8, 28
#: Rows of one bucket held in memory; further ones wait in a temporary file.
_HELD = 1 << 18
#: By table: all bits set in the sketch's blocks from that table on.
_LATER = np.array([[sum(0xFFFF << (16 * (b % 4)) for b in range(4 * w, 4 * w + 4) if b >= t) for w in (0, 1)] for t in range(9)], np.uint64)
_MIXES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def wide_fingerprint(text: str | None, shingle: int = SHINGLE, wide: int = WIDE) -> tuple[int, bytes]:
    """(shingles, fingerprint of 64 * wide bits): majority bits over mixes of each shingle's hash."""
    h = shingle_hashes(text, shingle)
    votes = np.zeros(64 * wide, np.int64)
    steps = np.arange(1, wide + 1, dtype=np.uint64) * _MIXES[0]
    for at in range(0, len(h), 255 * 16):
        part = h[at : at + 255 * 16]
        mixed = np.empty((len(part), wide), np.uint64)
        for i in range(wide):
            x = part + steps[i]
            x = (x ^ (x >> np.uint64(30))) * _MIXES[1]
            x = (x ^ (x >> np.uint64(27))) * _MIXES[2]
            mixed[:, i] = x ^ (x >> np.uint64(31))
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(part), 8 * wide), axis=1, bitorder="little")
        for j in range(0, len(part), 255):
            votes += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return len(h), np.packbits(2 * votes > len(h), bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, shingle: int = SHINGLE, wide: int = WIDE) -> DataFrame:
    """(doc_id, mark, n, fp), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [wide_fingerprint(t.as_py(), shingle, wide) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([n for n, _ in rows], pa.int32()), pa.array([f for _, f in rows], pa.binary())], ["doc_id", "mark", "n", "fp"])

    read = doc_columns(docs, ("doc_id", "bigint"), ("text", "string")).select("doc_id", text_mark().alias("mark"), "text")
    return read.mapInArrow(run, "doc_id bigint, mark bigint, n int, fp binary")


def text_mark() -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(text_of())


def differing_bits(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits in which texts of a similarity differ, and one standard deviation more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + (bits * p * (1 - p)) ** 0.5)


def _keyed(distinct: DataFrame, similarity: float) -> DataFrame:
    """(key, id, s0, s1): a row per block, for each class of lengths that a text may meet.

    Texts of a similarity s have numbers of shingles within a factor s; classes are three
    such factors wide, and a text near its class's upper end is also in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -3 * np.log(similarity)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            place = np.log(np.maximum(batch.column(1).to_numpy(zero_copy_only=False), 1)) / width
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(len(ids), -1)
            sketch = fps[:, :8].copy().view("<u8")
            level = np.floor(place).astype(np.uint64)
            for up in (0, 1):
                at = np.arange(len(ids)) if not up else np.flatnonzero(place - np.floor(place) >= 2 / 3 - 1e-9)
                blocks = fps[at].astype(np.uint64)
                key = (np.arange(fps.shape[1], dtype=np.uint64) << np.uint64(48)) | ((level[at] + np.uint64(up))[:, None] << np.uint64(16)) | blocks
                many = fps.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[at], many)), *(pa.array(np.repeat(sketch[at, i], many).view(np.int64)) for i in (0, 1))], ["key", "id", "s0", "s1"])

    return distinct.select("id", "n", "fp").mapInArrow(run, "key bigint, id bigint, s0 bigint, s1 bigint")


class _Forest:
    """Spanning forest of the rows of one bucket under a test, taken in parts.

    A part is searched breadth first from its first rows, then meets every earlier
    row that isn't in its tree yet: the components are those of all pairs, and links
    are fewer than rows.  Beyond ``_HELD`` rows earlier parts wait in a temporary file.
    """

    def __init__(self, near: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.near, self.held, self.spilled, self.file = near, [], [], None
        #: By tree: the number of the tree that it has become part of.
        self.root = np.zeros(0, np.int64)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, rows, trees) of what was added."""
        yield from self.held
        for at, n, width in self.spilled:
            self.file.seek(at)
            every = np.frombuffer(self.file.read(8 * n * (2 + width)), np.int64)
            yield every[:n], every[2 * n :].view(np.uint64).reshape(n, width), every[n : 2 * n]

    def _keep(self, ids: np.ndarray, rows: np.ndarray, tree: np.ndarray) -> None:
        if sum(len(x[0]) for x in self.held) + len(ids) <= _HELD:
            self.held.append((ids, rows, tree))
            return
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for x in (ids, tree, rows):
            self.file.write(np.ascontiguousarray(x).tobytes())
        self.spilled.append((at, len(ids), rows.shape[1]))

    def add(self, ids: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """The links of further rows, among them and to the earlier ones."""
        pairs, rest, tree, trees = [], np.arange(len(ids)), np.zeros(len(ids), np.int64), len(self.root)
        while len(rest):
            queue, tree[rest[0]], rest = deque([rest[0]]), trees, rest[1:]
            while queue and len(rest):
                q = queue.popleft()
                hit = self.near(rows[rest], rows[q])
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    tree[found] = trees
                    pairs += [(ids[q], ids[x]) for x in found]
                    queue.extend(found.tolist())
            trees += 1
        self.root = np.concatenate([self.root, np.arange(len(self.root), trees)])
        for old_ids, old_rows, old_tree in self.parts():
            roots, old = self.root[tree], self.root[old_tree]
            if (roots == roots[0]).all() and (old == roots[0]).all():
                continue
            for p in range(len(ids)):
                root = self.root[tree[p]]
                other = np.flatnonzero(old != root)
                hit = other[self.near(old_rows[other], rows[p])] if len(other) else other
                if len(hit):
                    joined, first = np.unique(old[hit], return_index=True)
                    pairs += [(old_ids[x], ids[p]) for x in hit[first]]
                    self.root[np.isin(self.root, joined)] = root
                    old = self.root[old_tree]
        self._keep(ids, rows, tree)
        return pairs

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, each one's tree) of the trees of two rows or more."""
        ids, roots = np.concatenate([x[0] for x in self.parts()]), self.root[np.concatenate([x[2] for x in self.parts()])]
        many = np.bincount(roots)[roots] > 1
        return ids[many], roots[many]


def _bucket_groups(keyed: DataFrame, near: int = _NEAR) -> DataFrame:
    """(g, h, id): groups of a bucket's rows that hold every two rows of near sketches.

    Small buckets give each such pair as a group, under its two ids.  Larger ones give the
    components by near sketches, under the bucket's key and the component's first id: what
    is near by sketch only isn't a link, just a reason to compare the whole fingerprints.
    Two rows that share one of the first eight blocks meet in that block's table, not again
    in each later one: that table has tested the pair, or has both in one group.
    """

    low, high = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)

    def meet(x: np.ndarray, y: np.ndarray, table) -> np.ndarray:
        """Near, and not in a bucket of an earlier table together, as far as the sketch's eight blocks tell."""
        differ = x ^ y
        close = np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) <= near
        # A zero among the 16-bit lanes is a common block; the lanes of this table and later ones are set.
        lanes = differ | _LATER[np.minimum(table, 8)]
        common = ((lanes - low) & ~lanes & high).any(axis=-1)
        return close & ~common

    def feed(forest: _Forest | None, key: int, ids: np.ndarray, sketches: np.ndarray) -> _Forest:
        table = int(np.int64(key).view(np.uint64) >> np.uint64(48))
        forest = forest or _Forest(lambda x, y: meet(x, y, table))
        for j in range(0, len(ids), _CHUNK):
            forest.add(ids[j : j + _CHUNK], sketches[j : j + _CHUNK])
        return forest

    def grouped(key: int, forest: _Forest) -> list[np.ndarray]:
        """Rows (g, h, id) of a large bucket; a group of two goes under its ids, as in small buckets."""
        ids, roots = forest.groups()
        order = np.argsort(roots, kind="stable")
        ids, roots = ids[order], roots[order]
        starts = np.flatnonzero(np.diff(roots, prepend=-1))
        sizes = np.diff(starts, append=len(ids))
        first, last = np.repeat(ids[starts], sizes), np.repeat(ids[starts + sizes - 1], sizes)
        pair = np.repeat(sizes == 2, sizes)
        return [np.stack([np.where(pair, np.minimum(first, last), key), np.where(pair, np.maximum(first, last), first), ids], axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sk = none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
        of = forest = None  # a large bucket that goes on
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                more, more_ids, *halves = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                key, ids, sk = np.concatenate([key, more]), np.concatenate([ids, more_ids]), np.concatenate([sk, np.stack(halves, axis=1).view(np.uint64)])
            rows = []
            if forest:
                n = int((key == of).sum())
                feed(forest, of, ids[:n], sk[:n])
                key, ids, sk = key[n:], ids[n:], sk[n:]
                if batch is not None and not len(key):
                    continue
                rows += grouped(of, forest)
                of = forest = None
            if len(key):
                starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
                # The last bucket may go on in the next batch.
                end = len(key) if batch is None else int(starts[-1])
                starts = starts[starts < end]
                sizes = np.diff(starts, append=end)
                table = (key.view(np.uint64) >> np.uint64(48)).astype(np.int64)
                small = np.repeat(sizes <= _SMALL, sizes)
                for d in range(1, _SMALL):
                    same = np.flatnonzero((key[d:end] == key[: end - d]) & small[d:]) if d < end else []
                    if not len(same):
                        break
                    hit = same[meet(sk[same], sk[same + d], table[same])]
                    a, b = np.minimum(ids[hit], ids[hit + d]), np.maximum(ids[hit], ids[hit + d])
                    rows += [np.stack([a, b, x], axis=1) for x in (a, b)]
                for i, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
                    rows += grouped(int(key[i]), feed(None, key[i], ids[i : i + n], sk[i : i + n]))
                key, ids, sk = key[end:], ids[end:], sk[end:]
                if len(key) > _CHUNK:
                    of, forest = int(key[0]), feed(None, key[0], ids, sk)
                    key, ids, sk = none
            every = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, i]) for i in range(3)], ["g", "h", "id"])

    return keyed.repartition(F.col("key")).sortWithinPartitions("key", "id").mapInArrow(run, "g bigint, h bigint, id bigint")


def similar_links(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between rows of ``distinct(id, n, fp)``, each within the Hamming distance of whole
    fingerprints, that connect all such rows of a group of :func:`_bucket_groups`."""
    bits = differing_bits(similarity)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = forest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, h, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(len(ids), -1)
            starts = np.flatnonzero((np.diff(g, prepend=g[0] - 1) != 0) | (np.diff(h, prepend=h[0] - 1) != 0))
            pairs = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                if of != (g[i], h[i]):
                    of, forest = (g[i], h[i]), _Forest(near)
                for k in range(i, j, _CHUNK):
                    pairs += forest.add(ids[k : min(k + _CHUNK, j)], fps[k : min(k + _CHUNK, j)])
            ends = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    groups = _bucket_groups(_keyed(distinct, similarity)).distinct().join(distinct.select("id", "fp"), "id").select("g", "h", "id", "fp")
    return groups.repartition(F.col("g"), F.col("h")).sortWithinPartitions("g", "h", "id").mapInArrow(run, "a bigint, b bigint")


def _similar(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, fp) a row per document, and (fp, rep, copies) a row per fingerprint:
    its component's first document (no_id, doc_id, mark), and how many rows have this fingerprint."""
    each = written(wide_fingerprints(docs, shingle), "wide-fingerprints")
    document = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    # Fingerprints have a number of their own, whether their documents have an id or not.
    folded = each.groupBy("fp").agg(F.min(document).alias("own"), F.max("n").alias("n"), F.count("*").alias("copies"))
    distinct = written(folded.withColumn("id", F.monotonically_increasing_id()), "distinct-fingerprints")
    roots = connected_components(similar_links(distinct, similarity)).withColumnRenamed("node", "id")
    linked = distinct.join(roots, "id").select("fp", "own", "root")
    first = linked.groupBy("root").agg(F.min("own").alias("rep"))
    named = linked.join(first, "root").select("fp", "rep")
    return each, distinct.join(named, "fp", "left").select("fp", F.coalesce("rep", "own").alias("rep"), "copies", F.col("rep").isNotNull().alias("linked"))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per document; null where no member has an id."""
    each, named = _similar(docs, similarity, shingle)
    return each.join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, few: int = FEW) -> DataFrame:
    """One document of each group of :func:`similar_groups`, with all columns: the one with
    the smallest id; of a group without any id, and of unlike texts under one id, the one whose
    text has the least hash.  Rows that repeat both id and text count as one document.

    As in exact dedup, only the keys of rows that go are written and dealt.
    """
    each, named = _similar(docs, similarity, shingle)
    groups = named.filter("linked OR copies > 1")
    rows = each.select("doc_id", "mark", "fp").join(groups, "fp").groupBy("doc_id", "mark", "rep").agg(F.count("*").alias("same"))
    stays = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("mark") == F.col("rep.mark"))
    gone = rows.filter(~stays | (F.col("same") > 1)).select("doc_id", "mark", stays.alias("one"))
    return without_keys(docs, written(gone, "near-copies"), text_mark(), few)
