"""SentencePiece encoding and decoding: segmentations sampled without replacement.

A text's lattice holds every way to write it as pieces of a vocabulary.  A piece's
log weight follows Zipf's law in its place in the vocabulary, flattened by ``ALPHA``,
so a segmentation has a probability.  The ``k`` segmentations with the largest Gumbel-perturbed log
probabilities are drawn without replacement, by an A-star search from the top:

* A node of the search is a set of segmentations: a prefix, and the edges that may
  not follow it.  Its exact mass comes from the lattice's backward sums, and so the
  maximum of its perturbed scores is one Gumbel variate at the log of that mass,
  truncated at its parent's.  That is the node's priority; no bound is loose.
* Taking the best node draws one member in proportion (its perturbed score is the
  node's), and divides the rest by the first edge that differs.
* The (k+1)-th score is the threshold: a sample's inclusion score is the chance
  that its perturbed score passes it, 1 - exp(-exp(log p - threshold)).

Nodes whose mass is below e^-45 of the best are left out, which is less than the
rounding of the sums.

No piece crosses a place where a space mark follows another character, so a text is a
row of blocks; each distinct block of a batch is analysed once and all walks of a
batch go forward together.  Random numbers are a hash of the row's key, the sample,
the block and the step: a row's samples depend on neither batch nor partition.

Memory is bounded by ``BATCH`` characters a lattice, whatever a text's length.  A block
of more than ``BLOCK`` characters is divided where no piece holds the two characters
that meet; only where ``BLOCK`` more characters have no such place, a piece's edge is forced.
A long text's search sees its head alone, as many blocks as leave every further
node a mass below e^-90; all behind it is drawn block by block, in parts.

As in the model, spaces are written as U+2581 with one in front, and characters
without a piece fall back to bytes.  Decoding gives the text back (U+2581 itself as a
space).

Defined cases: a null text is empty and has one segmentation, of no pieces, with
inclusion 1; a text with fewer than k segmentations gives all it has, each with
inclusion 1.  Rows without id share a key; repeated rows get the same samples.  An
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import doc_columns

#: Samples a text, and the seed beside the row's key.
SAMPLES, SEED = 2, 17
#: The exponent of the pieces' weights: 1 keeps them, 0 makes all segmentations alike.
ALPHA = 0.3
#: Characters analysed together, and characters of a block.
BATCH, BLOCK = 200_000, 2048
_MARK = "▁"
_BYTE0 = 3
_FAR = 45.0
#: What keeps backward sums in a float's range, and the levels after which they start anew.
_SCALE, _LEVELS = 20.0, 48


def default_model() -> str:
    """The public 32k model of this installation."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id as bytes, and their tree of characters: an open hash table from
    (node, character), both in full, to the child."""

    raw: tuple[bytes, ...]
    slots: np.ndarray  # node << 21 | code point; 0 for a free slot
    child: np.ndarray  # by slot: the child
    piece: np.ndarray  # by node: its piece's id, or -1
    single: np.ndarray  # by code point: the node of that character alone, or 0
    weight: np.ndarray  # [characters, id]: a piece's weight, times _SCALE for every character
    longest: int
    lone_newline: bool
    pairs: frozenset[str]  # neighbouring characters of all pieces


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).view(np.int64)


def build_vocabulary(pieces: list[str], special: set[int]) -> Vocabulary:
    """``special``: ids that stand for no text (control, unknown and byte pieces)."""
    known = {p: i for i, p in enumerate(pieces) if i not in special}
    nodes = {p[:n]: 0 for p in known for n in range(1, len(p) + 1)}
    nodes = {p: i for i, p in enumerate(nodes, 1)}
    longest = -(-max(map(len, known)) // 8) * 8
    if longest > 56 or any("\0" in p for p in known):
        raise ValueError("a piece has 56 characters at most (a node's edges are bits of a long) and no null")
    size = 1 << (4 * len(nodes)).bit_length()
    slots, child = np.zeros(size, np.uint64), np.zeros(size, np.int32)
    single = np.zeros(0x110000, np.int32)
    for p, i in nodes.items():
        if len(p) == 1:
            single[ord(p)] = i
            continue
        key = np.array([nodes[p[:-1]] << 21 | ord(p[-1])], np.uint64)
        at = int(_slot(key, size)[0])
        while slots[at]:
            at = (at + 1) & (size - 1)
        slots[at], child[at] = key[0], i
    raw = [b"" if i in special else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
    raw[_BYTE0 : _BYTE0 + 256] = [bytes([b]) for b in range(256)]
    pairs = frozenset(p[i : i + 2] for p in known for i in range(len(p) - 1))
    weight = np.maximum(np.arange(len(pieces)) - 257, 2.0) ** -ALPHA * _SCALE ** np.arange(longest + 1.0)[:, None]
    return Vocabulary(tuple(raw), slots, child, np.array([-1, *(known.get(p, -1) for p in nodes)], np.int32), single, weight, longest, not any("\n" in p for p in known), pairs)


def load_vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    return build_vocabulary([model.id_to_piece(i) for i in range(n)], special)


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of a row of ids, without the space that encoding puts in front."""
    raw = vocabulary.raw
    out = b"".join(itemgetter(*ids)(raw) if len(ids) > 1 else [raw[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


# --- The lattice of a batch's distinct blocks -------------------------------------------------


@dataclass
class Lattice:
    """Nodes are places in blocks, numbered by their distance to the block's end (the
    ends come first); a node's edges are neighbours, the shorter ones first."""

    blocks: int
    first: np.ndarray  # by block: its first node
    edges: np.ndarray  # by node: its first edge; one more at the end
    target: np.ndarray  # by edge: the node it leads to
    piece: np.ndarray  # by edge: its id; -1 - code point for a fallback to several bytes
    chance: np.ndarray  # by edge: probability, given its start
    reach: np.ndarray  # [node, number of its edge]: running sums of probabilities; 2 from the last on

    def source(self, edge: np.ndarray) -> np.ndarray:
        """The nodes that edges start from."""
        return np.searchsorted(self.edges, edge, "right") - 1


def build_lattice(blocks: list[str], v: Vocabulary) -> Lattice:
    size = np.fromiter(map(len, blocks), np.int64, len(blocks))
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    n = int(size.sum()) + len(blocks)
    code = np.frombuffer(("\0".join(blocks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    left = (np.repeat(first + size, size + 1) - np.arange(n)).astype(np.uint16)  # 2 * BLOCK at most
    order = np.argsort(left, kind="stable").astype(np.int32)
    node = np.empty(n + v.longest, np.int32)
    node[order] = np.arange(n, dtype=np.int32)
    place = order[len(blocks) :]  # in the nodes' order, which every step keeps
    tree = v.single[code[place]]
    ids = v.piece[tree]
    bare = ids < 0
    chars = code[place[bare]].astype(np.int32)
    piece, weight = ids.copy(), v.weight[1][np.maximum(ids, 0)]
    piece[bare] = np.where(chars < 0x80, _BYTE0 + chars, -1 - chars)
    weight[bare] = v.weight[1][-1] * (v.weight[0][-1] ** ((chars > 0x7F) + 0.0 + (chars > 0x7FF) + (chars > 0xFFFF)))
    found_at = [(place, piece, weight)]
    place, tree = place.compress(tree > 0), tree.compress(tree > 0)
    for k in range(1, v.longest):
        # No piece holds the mark of a block's end, so none goes beyond it.
        h = tree.astype(np.uint64) << np.uint64(21) | code[place + k]
        at = _slot(h, len(v.slots))
        key = v.slots.take(at)
        found = key == h
        open_ = np.flatnonzero(~found & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(v.slots) - 1)
            key = v.slots.take(at[open_])
            hit = key == h[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (key != 0)]
        place, tree = place.compress(found), v.child.take(at.compress(found))
        if not len(place):
            break
        ids = v.piece[tree]
        real = ids >= 0
        found_at.append((place.compress(real), ids.compress(real), v.weight[k + 1][ids.compress(real)]))
    degree = np.zeros(n, np.int32)
    nth = []
    for place, _, _ in found_at:
        at = node[place]
        nth.append((at, degree[at]))
        degree[at] += 1
    edges = np.concatenate([[0], np.cumsum(degree)]).astype(np.int64)
    total = int(edges[-1])
    target, pieces, chance = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
    for length, ((place, piece, weight), (at, i)) in enumerate(zip(found_at, nth), 1):
        e = edges[at] + i
        target[e], pieces[e], chance[e] = node[place + length], piece, weight
    # Backward sums: the mass of all ways from a node to its block's end, every character times _SCALE.
    beta, mass = np.ones(n), np.ones(n)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(left))]).tolist()
    for level in range(1, len(bounds) - 1):
        i, j = bounds[level : level + 2]
        a, b = int(edges[i]), int(edges[j])
        s = chance[a:b]
        s *= beta[target[a:b]]
        beta[i:j] = mass[i:j] = np.add.reduceat(s, edges[i:j] - a)
        if level % _LEVELS == 0:
            # Sums of blocks that go on start at one again, with those that their pieces may still reach.
            start = bounds[max(level - v.longest, 0)]
            block = np.searchsorted(first, order[start:j], "right") - 1
            scale = np.ones(len(blocks))
            scale[block[i - start :]] = beta[i:j]
            beta[start:j] /= scale[block]
    source = np.repeat(np.arange(n), degree)
    chance /= mass.take(source)
    run = np.cumsum(chance)
    run -= np.concatenate([[0.0], run])[edges[:-1]].take(source)
    run[edges[1:].compress(degree > 0) - 1] = 2
    reach = np.full(n * v.longest, 2, np.float32)
    # An edge's number is its distance to the node's first.
    reach[(np.arange(n) * v.longest - edges[:-1]).take(source) + np.arange(total)] = run
    return Lattice(len(blocks), node[first], edges, target, pieces, chance, reach.reshape(n, v.longest))


# --- Walks and search -------------------------------------------------------------------------


def _uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) from a hash of equally long columns."""
    x = np.uint64(0x243F6A8885A308D3)
    for p in parts:
        x = (x ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(32))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


@dataclass
class Walks:
    """One segmentation of every text of a batch: edges in order."""

    block: np.ndarray  # of each edge: the block's place in the batch
    edge: np.ndarray
    start: np.ndarray  # by block: its first edge; one more at the end


def _walk(lat: Lattice, block: np.ndarray, node: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Go from ``node`` to the end of each block of ``block``: (block, step from there, edge).

    ``state``: random words, one for each walk; each step makes the next of them.
    """
    out = []
    step = 0
    while True:
        alive = np.flatnonzero(node >= lat.blocks)
        if not len(alive):
            break
        if len(alive) < len(node):
            block, node, state = block.take(alive), node.take(alive), state.take(alive)
        state = state * np.uint64(0x5851F42D4C957F2D) + np.uint64(0x14057B7EF767814F)
        u = ((state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        below = np.bitwise_count((lat.reach.take(node, axis=0) <= u[:, None]).view(np.uint64))
        edge = lat.edges[node]
        for eight in below.T:
            edge += eight
        out.append((block, np.full(len(block), step, np.int32), edge))
        node = lat.target[edge]
        step += 1
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))


def _placed(blocks: int, block, step, edge) -> Walks:
    start = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
    at = start[block] + step
    out = Walks(np.empty(len(block), np.int64), np.empty(len(block), np.int64), start)
    out.block[at] = block
    out.edge[at] = edge
    return out


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _truncated(g: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Gumbel variates g, given that they don't pass ``most``."""
    return most - np.log1p(np.exp(np.minimum(most - g, 700.0)))


def _states(keys: np.ndarray, place: np.ndarray, sample: int) -> np.ndarray:
    """The first random word of blocks' walks, by row key and the block's place in the text."""
    return _mix((keys + np.uint64(0x1000193 * (sample + 1))) ^ _mix(place.astype(np.uint64) + np.uint64(1)))


def sample_batch(keys: np.ndarray, texts: list[list[str]], v: Vocabulary, k: int):
    """Yield per sample (texts that have it, ids of all edges, text bounds in edges, log p, perturbed), and at last the thresholds."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    docs, total = len(texts), int(counts.sum())
    numbers = dict.fromkeys(chain.from_iterable(texts))
    numbers = dict(zip(numbers, range(len(numbers))))
    kind = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, total)
    lat = build_lattice(list(numbers), v)
    wide = np.arange(v.longest)
    begin = lat.first[kind]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(docs), counts)
    place = np.arange(total) - bounds[doc]

    def free_chances(node: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """[node, number]: the probabilities of a node's edges that aren't taken."""
        edge = lat.edges[node][:, None] + wide
        real = (edge < lat.edges[node + 1][:, None]) & ((taken[:, None] >> wide) & 1 == 0)
        return np.where(real, lat.chance[np.minimum(edge, len(lat.chance) - 1)], 0.0)

    def states(block: np.ndarray, sample: int) -> np.ndarray:
        return _states(keys[doc[block]], place[block], sample)

    pool: list[dict] = []
    walks: list[Walks] = []
    score = _gumbel(_uniform(keys, np.zeros(docs)))
    now = _placed(total, *_walk(lat, np.arange(total), begin, states(np.arange(total), 0)))
    live = np.ones(docs, bool)
    # The edge from which a text's new sample differs from its parent, what is forbidden there, and if so.
    fork, banned, forked = np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs, bool)
    for sample in range(k):
        walks.append(now)
        text_at = now.start[bounds]
        logp = np.log(lat.chance[now.edge])
        run = np.concatenate([[0.0], np.cumsum(logp)])
        yield live.copy(), lat.piece[now.edge], text_at, run[text_at[1:]] - run[text_at[:-1]], score.copy()
        # Divide what is left of each text's set by the first edge that differs: early edges hold the mass.
        base = np.repeat(run[text_at[:-1]], np.diff(text_at))
        for deep in (2 * _FAR, np.inf):
            e = np.flatnonzero((run[:-1] > base - deep) & (logp < -1e-15) | (run[:-1] == base))
            d = doc[now.block[e]]
            position = e - text_at[:-1][d]
            mass = run[e] - base[e] + np.log(np.maximum(-np.expm1(logp[e]), 1e-300))
            taken = np.zeros(len(e), np.int64)  # filled in for those that stay
            mass[(logp[e] > -1e-15) | (position <= fork[d]) & forked[d] | ~live[d]] = -np.inf
            at_fork = np.flatnonzero(forked & live)
            if len(at_fork):
                f = text_at[:-1][at_fork] + fork[at_fork]
                node = lat.source(now.edge[f])
                f_taken = banned[at_fork] | np.left_shift(1, now.edge[f] - lat.edges[node])
                rest = free_chances(node, f_taken).sum(axis=1)
                f_mass = np.where(rest > 0, run[f] - base[f] + np.log(np.maximum(rest, 1e-300)), -np.inf)
                e, d, position = np.concatenate([e, f]), np.concatenate([d, at_fork]), np.concatenate([position, fork[at_fork]])
                mass, taken = np.concatenate([mass, f_mass]), np.concatenate([taken, f_taken])
            best = np.full(docs, -np.inf)
            np.maximum.at(best, d, mass)
            if (best > _FAR - deep)[live].all():
                break
        near = np.flatnonzero((mass > best[d] - _FAR) & np.isfinite(mass))
        plain = near[taken[near] == 0]
        taken[plain] = np.left_shift(1, now.edge[e[plain]] - lat.edges[lat.source(now.edge[e[plain]])])
        d, position = d[near], position[near]
        g = mass[near] + _gumbel(_uniform(keys[d], np.full(len(d), 1000 * sample + 2), position))
        pool.append({"doc": d, "edge": e[near], "position": position, "taken": taken[near], "g": _truncated(g, score[d])})
        # The best node of each text, over all samples so far.
        score = np.full(docs, -np.inf)
        for p in pool:
            np.maximum.at(score, p["doc"], p["g"])
        live = np.isfinite(score)
        if sample == k - 1 or not live.any():
            break
        parts, chosen = [], np.zeros(docs, bool)
        fork, banned, forked = np.zeros(docs, np.int64), np.zeros(docs, np.int64), live.copy()
        skip = np.zeros(docs, np.int64)  # blocks up to here come from the parent
        for p, parent in zip(pool, walks):
            hit = np.flatnonzero((p["g"] == score[p["doc"]]) & ~chosen[p["doc"]])
            hit = hit[np.unique(p["doc"][hit], return_index=True)[1]]
            ds, e = p["doc"][hit], p["edge"][hit]
            chosen[ds] = True
            fork[ds], banned[ds] = p["position"][hit], p["taken"][hit]
            p["g"][hit] = -np.inf
            b, node = parent.block[e], lat.source(parent.edge[e])
            step = e - parent.start[b]
            skip[ds] = b + 1
            p_at = parent.start[bounds]
            length_of = e - p_at[:-1][ds]
            head = np.repeat(p_at[:-1][ds] - np.concatenate([[0], np.cumsum(length_of)])[:-1], length_of) + np.arange(int(length_of.sum()))
            parts.append((parent.block[head], head - parent.start[parent.block[head]], parent.edge[head]))
            reach = np.cumsum(free_chances(node, p["taken"][hit]), axis=1)
            u = _uniform(keys[ds], np.full(len(ds), 1000 * (sample + 1) + 3))
            edge = lat.edges[node] + np.minimum((reach <= (u * reach[:, -1])[:, None]).sum(axis=1), v.longest - 1)
            parts.append((b, step, edge))
            tail = _walk(lat, b, lat.target[edge], states(b, sample + 1))
            later = np.zeros(total, np.int64)
            later[b] = step + 1
            parts.append((tail[0], tail[1] + later[tail[0]], tail[2]))
        fresh = np.flatnonzero(live[doc] & (np.arange(total) >= skip[doc]))
        parts.append(_walk(lat, fresh, begin[fresh], states(fresh, sample + 1)))
        now = _placed(total, *(np.concatenate(c) for c in zip(*parts)))
    yield score


def blocks_of(text: str | None, v: Vocabulary) -> list[str]:
    if not text:
        return []
    marked = _MARK + text.replace(" ", _MARK)
    found = (_LINES if v.lone_newline else _PLAIN).findall(marked)
    if max(map(len, found)) <= BLOCK:
        return found
    return [part for block in found for part in ((block,) if len(block) <= BLOCK else _parts(block, v.pairs))]


def _parts(block: str, pairs: frozenset[str]) -> Iterator[str]:
    """A long block in parts, cut where two characters meet that no piece holds together."""
    at = 0
    while len(block) - at > BLOCK:
        end = at + BLOCK
        cut = next((i for i in range(end, min(end + BLOCK, len(block))) if block[i - 1 : i + 1] not in pairs), min(end + BLOCK, len(block)))
        yield block[at:cut]
        at = cut
    if at < len(block):
        yield block[at:]


_PLAIN = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+")
_LINES = re.compile(f"\n|{_MARK}*[^{_MARK}\n]+|{_MARK}+")


def _row_key(doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(f"{doc_id}".encode(), SEED)


def _split(blocks: list[str], most: int) -> tuple[list[str], list[str]]:
    """The first blocks, of ``most`` characters together (one at least), and the others."""
    size = 0
    for i, b in enumerate(blocks):
        size += len(b)
        if size > most and i:
            return blocks[:i], blocks[i:]
    return blocks, []


def _bytes_for(ids: np.ndarray) -> np.ndarray:
    """Piece ids, with the byte pieces in place of characters that have none."""
    if not len(ids) or ids.min() >= 0:
        return ids
    return np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else [_BYTE0 + b for b in chr(-1 - i).encode()])], np.int32)


def _drawn(key: int, blocks: list[str], place: int, samples: list[int], v: Vocabulary) -> list[tuple[np.ndarray, float]]:
    """Of every sample (ids, log p) of blocks behind a text's head, ``place`` blocks into the text."""
    out: list[list] = [[[], 0.0] for _ in samples]
    while blocks:
        part, blocks = _split(blocks, BATCH)
        numbers = {b: i for i, b in enumerate(dict.fromkeys(part))}
        lat = build_lattice(list(numbers), v)
        begin = lat.first[np.fromiter(map(numbers.__getitem__, part), np.int64, len(part))]
        every = np.arange(len(part))
        for sample, found in zip(samples, out):
            walk = _placed(len(part), *_walk(lat, every, begin, _states(np.full(len(part), key, np.uint64), every + place, sample)))
            found[0].append(_bytes_for(lat.piece[walk.edge]))
            found[1] += float(np.log(lat.chance[walk.edge]).sum())
        place += len(part)
    return [(np.concatenate(ids) if ids else np.zeros(0, np.int32), logp) for ids, logp in out]


def sample_texts(ids: list[int | None], texts: list[str | None], v: Vocabulary, k: int = SAMPLES) -> list[tuple]:
    """(row, rank, ids, log p, perturbed, inclusion) of every sample."""
    keys = np.fromiter(map(_row_key, ids), np.uint64, len(ids))
    parts = [_split(blocks_of(t, v), BATCH) for t in texts]
    out = _sampled(keys, [head for head, _ in parts], v, k)
    for d, (head, tail) in enumerate(parts):
        if not tail:
            continue
        own = [x for x in out if x[0] == d]
        # A head whose samples are likely, so that nodes behind it count too, grows until they aren't.
        while tail and max(x[3] for x in own) > -2 * _FAR:
            more, tail = _split(tail, sum(map(len, head)))
            head = head + more
            own = [(d, *x[1:]) for x in _sampled(keys[d : d + 1], [head], v, k)]
        drawn = _drawn(int(keys[d]), tail, len(head), [x[1] - 1 for x in own], v)
        out = [x for x in out if x[0] != d] + [(d, rank, np.concatenate([pieces, more]), lp + lp_more, g, chance) for (_, rank, pieces, lp, g, chance), (more, lp_more) in zip(own, drawn)]
    return out


def _sampled(keys: np.ndarray, blocks: list[list[str]], v: Vocabulary, k: int) -> list[tuple]:
    found, threshold = [], None
    for step in sample_batch(keys, blocks, v, k):
        if isinstance(step, np.ndarray):
            threshold = step
            break
        live, pieces, at, logp, score = step
        found += [(d, _bytes_for(pieces[at[d] : at[d + 1]]), float(logp[d]), float(score[d])) for d in np.flatnonzero(live).tolist()]
    rank: dict[int, int] = {}
    out = []
    for d, own, lp, g in found:
        rank[d] = rank.get(d, 0) + 1
        t = threshold[d]
        chance = 1.0 if not np.isfinite(t) else -np.expm1(-np.exp(min(lp - t, 700.0)))
        out.append((d, rank[d], own, lp, g, float(chance)))
    return out


def encode_samples(docs: DataFrame, model_file: str | None = None, k: int = SAMPLES) -> DataFrame:
    """(doc_id, sample, n_pieces, log_prob, perturbed, inclusion, decoded, ids_sha256, ids).

    ``decoded`` tells that decoding gave the text back; ids_sha256 is of the ids as
    little-endian 32-bit numbers.
    """
    vocabulary = load_vocabulary(model_file or default_model())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "decoded", "ids_sha256"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        keys: list = []
        texts: list = []
        size = 0

        def done() -> pa.RecordBatch:
            rows, pieces = [], []
            for d, rank, own, lp, g, chance in sample_texts(keys, texts, v, k):
                same = decode(own.tolist(), v) == (texts[d] or "").replace(_MARK, " ")
                own = own.astype("<i4")
                rows.append((keys[d], rank, len(own), lp, g, chance, same, hashlib.sha256(own.tobytes()).hexdigest()))
                pieces.append(own)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces)))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), ids], [*names, "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                keys.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BATCH:
                    yield done()
                    keys, texts, size = [], [], 0
        if keys:
            yield done()

    ddl = "doc_id bigint, sample int, n_pieces int, log_prob double, perturbed double, inclusion double, decoded boolean, ids_sha256 string, ids array<int>"
    return doc_columns(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(run, ddl)


def decode_ids(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``encoded`` with a column ``text`` from its ``ids``."""
    from pyspark.sql import functions as F

    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_file or default_model()))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = shared.value
        return ids.map(lambda x: None if x is None else decode(x.tolist(), v))

    return encoded.withColumn("text", text("ids"))
