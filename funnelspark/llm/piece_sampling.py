"""Sampled segmentations with a sentencepiece vocabulary, and decoding.

A text's segmentations form a lattice; a segmentation's probability is the
product of its pieces' probabilities over the lattice's total. Pieces follow
Zipf's law over the ranks of the vocabulary. Characters outside it are spelled
as bytes. Pieces hold the boundary character at their start only, so the
lattice of a text is a chain of small lattices, one for each word with the
spaces before it; equal words share theirs.

Gumbel top-k without replacement by A-star search: the root's value is a Gumbel
draw; the best path is followed down, each step drawn by the mass behind it and
keeping the value, and all its siblings stay behind as one node whose value is
a Gumbel draw cut off at that of the step. The best node left behind gives the
next segmentation. Segmentations so come out distinct, in order of perturbed
log-probability, as if all of them had been perturbed. Draws are hashes of the
row key, the sample's number and the place, so that any task gives the same.

The value of sample k + 1, that of the best node left, is the threshold of the inclusion scores: sample y is
among the first k with probability 1 - exp(-exp(log p(y) - threshold)).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from funnelspark.llm.common import row_key, small_batches
from funnelspark.llm.textarrays import mix, utf8

SAMPLES = 2
BOUNDARY = "▁"
#: Edges remembered by a worker; the memory is emptied when full.
REMEMBERED = 6_000_000
#: A second segmentation that leaves the first where that is less likely by this much (natural log) needs no look: see ``_best_forks``.
REACH = 40.0
#: No draw of ``_uniform`` gives a Gumbel value beyond, save for one hash in 2^53 that rounds to 1.
_HIGHEST_GUMBEL = 37.0


class Lattices:
    """Lattices of words over one vocabulary: states are places in a word, edges are pieces.

    ``upto`` holds, for the edges of a state in turn, the probability of all up to
    this one, infinity at the last; ``first`` the first edge of each state; ``next``
    the state that an edge leads to, -1 at the end of the word.
    """

    _held: dict[str, Lattices] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ordinary = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        weight = {i: 1 / (rank + 10) for rank, i in enumerate(ordinary)}
        total = sum(weight.values())
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in ordinary:
            piece = model.id_to_piece(i)
            for end in range(1, len(piece)):
                self.pieces.setdefault(piece[:end], (-1, 0.0))
            self.pieces[piece] = i, weight[i] / total
        self.fallback = min(weight.values()) / total
        self.longest = max(map(len, self.pieces))
        self._build_trie()
        self.spelled = [model.id_to_piece(i).encode() for i in range(size)]
        for value, i in self.byte.items():
            self.spelled[i] = bytes([value])
        for i in range(size):
            if model.is_control(i):
                self.spelled[i] = b""
        self.spelled_column = pa.array([x.replace(BOUNDARY.encode(), b" ") for x in self.spelled], pa.large_binary())
        self.first = np.zeros(1 << 16, np.int64)  # first edge of each state, and the end of the last
        self.upto, self.log = np.zeros(1 << 18), np.zeros(1 << 18)
        self.next, self.token = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self._reset()

    def _build_trie(self) -> None:
        """The prefixes of pieces as numbered nodes; a step is looked up by node and class of character."""
        node = {prefix: i + 1 for i, prefix in enumerate(self.pieces)}
        chars = sorted({c for prefix in self.pieces for c in prefix})
        self.class_of = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.classes = len(chars) + 1
        step = np.array([node.get(x[:-1], 0) * self.classes + int(self.class_of[ord(x[-1])]) for x in node], np.int64)
        to, inner = np.arange(1, len(node) + 1, dtype=np.int32), step >= self.classes
        self.of_root = np.zeros(self.classes, np.int32)
        self.of_root[step[~inner]] = to[~inner]
        self.goes_on = np.zeros(len(node) + 1, bool)
        self.goes_on[step[inner] // self.classes] = True
        self._index_steps(step[inner], to[inner])
        self.node_token = np.array([-1, *(t for t, _ in self.pieces.values())], np.int32)
        self.node_chance = np.array([0.0, *(p for _, p in self.pieces.values())])
        #: Masses of words of no more bytes can't become too small for a float.
        self.short = int(150 / -np.log10(self.fallback))

    def _index_steps(self, step: np.ndarray, to: np.ndarray) -> None:
        """Put each step in the first free slot from its hash on."""
        bits = max(4, (4 * len(step)).bit_length())
        self.step_shift = np.uint64(64 - bits)
        self.step_key, self.step_node = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = self._slot(step)
        while len(step):
            free = self.step_key[slot] < 0
            self.step_key[slot[free]] = step[free]  # one of those that share a slot stays
            done = self.step_key[slot] == step
            self.step_node[slot[done]] = to[done]
            step, to, slot = step[~done], to[~done], (slot[~done] + 1) % len(self.step_key)

    def _slot(self, step: np.ndarray) -> np.ndarray:
        return ((step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.step_shift).astype(np.int64)

    def _onward(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes that steps lead to, 0 where there is none."""
        step = node * np.int64(self.classes) + kind
        slot = self._slot(step)
        held = self.step_key[slot]
        other = np.flatnonzero((held != step) & (held >= 0))
        while len(other):
            at = (slot[other] + 1) % len(self.step_key)
            slot[other], held[other] = at, self.step_key[at]
            other = other[(held[other] != step[other]) & (held[other] >= 0)]
        return np.where(held == step, self.step_node[slot], 0)

    @classmethod
    def of(cls, path: str) -> Lattices:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.states = self.edges = 0
        self.bytes: list[list[int]] = []
        self.spelt: dict[str, tuple[int, int]] = {}

    def _room(self, states: int, edges: int) -> None:
        grown = lambda x, n: np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)]) if n > len(x) else x
        self.first = grown(self.first, states + 1)
        for name in ("upto", "log", "next", "token"):
            setattr(self, name, grown(getattr(self, name), edges))

    def learn(self, new: list[str]) -> None:
        """Add the lattices of words."""
        code = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, new), np.int64, len(new))
        size = 1 + (code >= 0x80).view(np.int8) + (code >= 0x800) + (code >= 0x10000)  # of UTF-8
        is_short = np.add.reduceat(size, np.cumsum(n) - n, dtype=np.int64) <= self.short
        if not is_short.all():
            self._learn_long([new[i] for i in np.flatnonzero(~is_short).tolist()])
            new, code, n = [new[i] for i in np.flatnonzero(is_short).tolist()], code[np.repeat(is_short, n)], n[is_short]
        if new:
            self._learn_short(new, code, n)

    def _spelt(self, char: str) -> tuple[int, int]:
        """Token and number of bytes of a character that is no piece."""
        if char not in self.spelt:
            spelt = [self.byte.get(b, self.unknown) for b in char.encode("utf-8", "replace")] if self.byte else [self.unknown]
            if len(spelt) > 1:
                self.bytes.append(spelt)
            self.spelt[char] = spelt[0] if len(spelt) == 1 else -len(self.bytes), len(spelt)
        return self.spelt[char]

    def _add(self, weight: np.ndarray, size: np.ndarray, nexts: np.ndarray, tokens: np.ndarray) -> None:
        """Append states with ``size`` edges each."""
        states, edges = self.states + len(size), self.edges + len(weight)
        self._room(states, edges)
        start = np.cumsum(size) - size
        part = weight / np.repeat(np.add.reduceat(weight, start), size)
        self.log[self.edges : edges] = np.log(part)
        # summed within each state alone, so that a word's lattice is the same in any batch
        ends, held, rank = start + size - 1, size, 1
        while True:
            start, held = start[held > rank], held[held > rank]
            if not len(start):
                break
            at = start + rank
            part[at] += part[at - 1]
            rank += 1
        part[ends] = np.inf
        self.first[self.states + 1 : states + 1] = self.edges + np.cumsum(size)
        self.upto[self.edges : edges] = part
        self.next[self.edges : edges] = nexts
        self.token[self.edges : edges] = tokens
        self.states, self.edges = states, edges

    def _learn_short(self, new: list[str], code: np.ndarray, n: np.ndarray) -> None:
        """All words at once; the states of a word run from its first place to its last."""
        begin = np.cumsum(n) - n
        places = len(code)
        left = np.repeat(begin + n, n) - np.arange(places)  # characters from a place to the end of its word
        kind = self.class_of[code]
        at, node = np.arange(places), self.of_root[kind]
        bare = np.flatnonzero(self.node_token[node] < 0)  # characters that are no piece are spelled in bytes
        found = []  # (places, length, nodes, number of the edge at its place)
        count = np.zeros(places, np.int64)
        for size in range(1, self.longest + 1):
            is_piece = np.flatnonzero(self.node_token[node] >= 0)
            here = at[is_piece]
            rank = count[here]
            found.append((here, size, node[is_piece], rank))
            count[here] = rank + 1
            on = np.flatnonzero(self.goes_on[node] & (left[at] > size))
            at = at[on]
            if not len(at):
                break
            node = self._onward(node[on], kind[at + size])
            on = np.flatnonzero(node)
            at, node = at[on], node[on]
        rank = count[bare]
        count[bare] = rank + 1
        start = np.cumsum(count) - count
        nodes, length = np.zeros(int(count.sum()), np.int32), np.ones(int(count.sum()), np.int32)
        for here, size, piece, number in found:
            slot = start[here] + number
            nodes[slot], length[slot] = piece, size
        token, weight = self.node_token[nodes], self.node_chance[nodes]
        if len(bare):
            spelt = [self._spelt(chr(c)) for c in code[bare].tolist()]
            slot = start[bare] + rank
            token[slot], weight[slot] = [t for t, _ in spelt], [self.fallback**m for _, m in spelt]
        from_, distance = np.repeat(np.arange(places, dtype=np.int32), count), np.repeat(left.astype(np.uint8), count)
        ends = distance == length
        # masses from the end: places at the same distance from the end of their words together
        mass = np.ones(places + 1)
        to = np.where(ends, np.int32(places), from_ + length)
        by_left = np.argsort(distance, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(distance)[1:])])
        weight_by, to_by, from_by = weight[by_left], to[by_left], from_[by_left]
        first = np.ones(len(from_by), bool)
        np.not_equal(from_by[1:], from_by[:-1], out=first[1:])
        group, firsts = np.cumsum(first) - 1, from_by[first]
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if a < b:
                weight_by[a:b] *= mass[to_by[a:b]]
                mass[firsts[group[a] : group[b - 1] + 1]] = np.bincount(group[a:b] - group[a], weights=weight_by[a:b])
        weight[by_left] = weight_by
        self.known.update(zip(new, (self.states + begin).tolist()))
        self._add(weight, count, np.where(ends, -1, self.states + to), token)

    def _learn_long(self, new: list[str]) -> None:
        """Word by word; the states of a word run from its last place to its first."""
        get, weights, nexts, tokens, sizes = self.pieces.get, [], [], [], []
        state = self.states
        for unit in new:
            n = len(unit)
            last = state + n - 1
            mass = [0.0] * n + [1.0]
            for i in range(n - 1, -1, -1):
                total, before, alone = 0.0, len(weights), False
                for j in range(i + 1, n + 1):
                    piece = get(unit[i:j])
                    if piece is None:
                        break
                    token, p = piece
                    if token >= 0:
                        p *= mass[j]
                        total += p
                        weights.append(p)
                        tokens.append(token)
                        nexts.append(last - j if j < n else -1)
                        if j == i + 1:
                            alone = True
                if not alone:  # a character that is no piece is spelled in bytes
                    token, size = self._spelt(unit[i])
                    p = self.fallback**size * mass[i + 1]
                    total += p
                    weights.append(p)
                    tokens.append(token)
                    nexts.append(last - i - 1 if i + 1 < n else -1)
                mass[i] = total
                sizes.append(len(weights) - before)
                if total < 1e-150:  # only ratios matter
                    ahead = range(i, min(n, i + self.longest) + 1)
                    for j in ahead:
                        mass[j] *= 1e120
            state += n
            self.known[unit] = last
        self._add(np.array(weights), np.array(sizes, np.int64), np.array(nexts), np.array(tokens))

    def starts(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The start state of every word of the texts, and the text each belongs to."""
        if self.edges > REMEMBERED:
            self._reset()
        words, counts = _words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        words = words.dictionary_encode()
        distinct = pc.replace_substring(words.dictionary, " ", BOUNDARY).to_numpy(zero_copy_only=False).tolist()
        states = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(states < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            self.learn(new)
            states[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return states[words.indices.to_numpy()], np.repeat(np.arange(len(counts)), counts)

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.first[state]
        # a state has a few edges, so they are tried one after the other
        open_ = np.flatnonzero(self.upto[edge] <= u)
        at, drawn = edge[open_], u[open_]
        while len(open_):
            at += 1
            on = np.flatnonzero(self.upto[at] <= drawn)
            edge[open_] = at
            open_, at, drawn = open_[on], at[on], drawn[on]
        return edge

    def ids(self, edges: np.ndarray) -> np.ndarray:
        token = self.token[edges]
        if (token >= 0).all():
            return token.astype(np.int32)
        parts = [[t] if t >= 0 else self.bytes[-t - 1] for t in token.tolist()]
        return np.fromiter((i for p in parts for i in p), np.int32)

    def ids_of_paths(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        token = self.token[np.concatenate([np.zeros(0, np.int64), *paths])]
        bounds = np.cumsum([0, *map(len, paths)]).tolist()
        spelt = np.minimum.reduceat(np.append(token, 0), bounds[:-1]) < 0 if paths else []
        return [self.ids(path) if s else token[a:b] for path, s, a, b in zip(paths, spelt, bounds, bounds[1:])]

    def states_of(self, edges: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first[: self.states + 1], edges, side="right") - 1


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, spaces for boundaries, and the number of each text's; a text that isn't empty begins with a boundary."""
    texts = pc.replace_substring(texts.cast(pa.large_string()), BOUNDARY, " ")
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    data, offsets = utf8(texts)
    space = data == 32
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(starts)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(start, offsets))


def _hashed(x: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """The hashes ``x`` carried on by more parts."""
    for p in parts:
        x = mix(x + (np.atleast_1d(p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))
    return x


def _as_uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers strictly between 0 and 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _uniform(*parts: np.ndarray) -> np.ndarray:
    """Hashes of the parts as numbers strictly between 0 and 1."""
    return _as_uniform(_hashed(np.zeros(1, np.uint64), *parts))


def _below(location: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at ``location`` cut off at ``limit``."""
    return _cut_off(location, limit, np.log(-np.log(u)))


def _cut_off(location: np.ndarray, limit: np.ndarray, draw: np.ndarray) -> np.ndarray:
    return location - np.logaddexp(location - limit, draw)


def _best_forks(bounds: np.ndarray, logs: np.ndarray, before: np.ndarray, log: np.ndarray, base: np.ndarray, had: np.ndarray, need: int) -> tuple[np.ndarray, ...]:
    """The ``need`` best nodes beside each text's new edges (at most): text, edge, location and draw, best first.

    ``before`` holds the log-probability of the new path up to each edge, ``log`` that of each text's path up to there.
    The value of a node with location ``l`` and a Gumbel draw ``g``, cut off at its text's value,
    rises with ``l + g``. Locations fall along a path and ``g`` is below ``_HIGHEST_GUMBEL``, so edges that begin where the path
    is already so unlikely that no draw lifts them above the nodes found are not drawn.
    """
    texts = len(bounds) - 1
    size = np.diff(bounds)
    parts, todo = [], np.ones(texts, bool)
    for reach in (REACH, np.inf):
        near = np.flatnonzero((before >= -reach) & np.repeat(todo, size))
        whole = np.diff(np.searchsorted(near, bounds)) == size
        rest = -np.expm1(logs[near])
        near, rest = near[rest > 1e-15], rest[rest > 1e-15]
        text = np.searchsorted(bounds, near, side="right") - 1
        location = log[text] + before[near] + np.log(rest)
        draw = np.log(-np.log(_as_uniform(_hashed(base[text], had[text] + near - bounds[text], 11))))
        score = location - draw
        cut = np.searchsorted(text, np.arange(texts + 1)).tolist()
        top = [a + np.argpartition(-score[a:b], need - 1)[:need] if b - a > need else np.arange(a, b) for a, b in zip(cut, cut[1:])]
        number = np.array([len(x) for x in top])
        best = np.concatenate(top)
        best = best[np.lexsort((-score[best], text[best]))]
        worst = np.full(texts, -np.inf)
        worst[number == need] = score[best[np.cumsum(number)[number == need] - 1]]
        done = todo & (whole | (worst >= log - reach + _HIGHEST_GUMBEL))
        best = best[done[text[best]]]
        parts.append((text[best], near[best], location[best], draw[best]))
        todo &= ~done
        if not todo.any():
            break
    return tuple(np.concatenate(c) for c in zip(*parts))


def sample(lattices: Lattices, texts: list[str] | pa.Array, keys: np.ndarray, k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each text its first ``k`` segmentations, fewer if it has fewer: (edges, log-probability, perturbed value); then the value of the next, if any."""
    n = len(texts)
    start, text_of = lattices.starts(texts)
    count = np.bincount(text_of, minlength=n)
    offset = np.cumsum(count) - count
    keyed = _hashed(np.zeros(1, np.uint64), keys.astype(np.uint64))
    value = -np.log(-np.log(_as_uniform(_hashed(keyed, 0, 0))))
    out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(n)]
    # a node left behind: (value, path before it, log-probability of that path, word it stands in, state, edges used up)
    behind: list[list[tuple]] = [[] for _ in range(n)]
    none = np.zeros(0, np.int64)
    # where each text goes on: path so far, its log-probability, next word, state inside the word before (or -1), edges used up there
    going = [(none, 0.0, 0, -1, ()) if count[i] else None for i in range(n)]

    for number in range(k):
        live = np.array([i for i in range(n) if going[i] is not None], np.int64)
        if not len(live):
            break
        base = _hashed(keyed[live], number)
        # the words still to segment, the rest of the word in hand first
        paths, logs_before, first_word, states = [], [], [], []
        depth = np.array([len(going[i][0]) for i in live], np.int64)
        of_pick, of_left = (_as_uniform(_hashed(base, 2 * depth + j)) for j in (1, 0))
        siblings = []
        for x, i in enumerate(live.tolist()):
            path, log, word, inside, used = going[i]
            state = -1
            if inside >= 0:
                # a sibling of the edges used up, by the mass it has
                edges = [e for e in range(lattices.first[inside], lattices.first[inside + 1]) if e not in used]
                chance = np.exp(lattices.log[edges])
                total = chance.sum()
                pick = min(int(np.searchsorted(np.cumsum(chance), of_pick[x] * total, side="right")), len(edges) - 1)
                left = float(total - chance[pick]) if len(edges) > 1 else 0.0
                edge = edges[pick]
                if left > 0:
                    siblings.append((x, left, (path, log, word, inside, (*used, edge))))
                path, log, state = np.append(path, edge), log + float(lattices.log[edge]), int(lattices.next[edge])
                word += state < 0
            paths.append(path)
            logs_before.append(log)
            first_word.append(word)
            states.append(state)
        if siblings:
            at = [x for x, _, _ in siblings]
            location = np.array([node[1] for _, _, node in siblings]) + np.log([left for _, left, _ in siblings])
            for x, v, (_, _, node) in zip(at, _below(location, value[live[at]], of_left[at]).tolist(), siblings):
                behind[live[x]].append((v, *node))
        log, first_word, states = np.array(logs_before), np.array(first_word, np.int64), np.array(states, np.int64)
        size = count[live] - first_word
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(live)), size)
        place = np.arange(len(owner)) - np.repeat(begin - first_word, size)
        state = start[np.repeat(offset[live], size) + place]
        inside = np.flatnonzero(states >= 0)
        state[begin[inside]] = states[inside]
        hashes = _hashed(base[owner], place)
        steps = np.zeros(len(state), np.int64)
        got, at, step = [], np.arange(len(state)), 0
        while len(at):
            edge = lattices.draw(state, _as_uniform(_hashed(hashes, step, 7)))
            got.append((at, edge))
            step += 1
            steps[at] = step
            state = lattices.next[edge]
            on = np.flatnonzero(state >= 0)
            at, state, hashes = at[on], state[on], hashes[on]
        first = np.concatenate([[0], np.cumsum(steps)])  # each word's edges in turn
        edge = np.zeros(first[-1], np.int64)
        for step, (at, drawn) in enumerate(got):
            edge[first[at] + step] = drawn
        bounds = first[np.append(begin, len(steps))]
        logs = lattices.log[edge]
        wholes, before = [], np.zeros(len(edge))
        for x, (i, path, a, b) in enumerate(zip(live.tolist(), paths, bounds.tolist(), bounds[1:].tolist())):
            whole = np.concatenate([path, edge[a:b]])
            wholes.append(whole)
            total = log[x]
            if b > a:
                np.cumsum(logs[a : b - 1], out=before[a + 1 : b])
                total = total + (before[b - 1] + logs[b - 1])
            out[i].append((whole, float(total), float(value[i])))
            going[i] = None
        # siblings of the path's new edges; only the best can be needed
        had = np.array([len(p) for p in paths], np.int64)
        text, fork, location, draw = _best_forks(bounds, logs, before, log, base, had, k - number)
        v = _cut_off(location, value[live[text]], draw)
        words = place[np.searchsorted(first, fork, side="right") - 1]
        lengths = had[text] + fork - bounds[text]
        taken = edge[fork]
        columns = (text, v, lengths, log[text] + before[fork], words, lattices.states_of(taken), taken)
        for x, top, length, chance, word, inside, e in zip(*(c.tolist() for c in columns)):
            behind[live[x]].append((top, wholes[x][:length], chance, word, inside, (e,)))
        if number + 1 < k:
            for i in live.tolist():
                if behind[i]:
                    top = max(range(len(behind[i])), key=lambda x: behind[i][x][0])
                    value[i], *node = behind[i].pop(top)
                    going[i] = tuple(node)
    # the best node left behind has the value that the next segmentation would have
    return [(paths, max((node[0] for node in left), default=-np.inf)) for paths, left in zip(out, behind)]


def _log_inclusion(over: float) -> float:
    """log(1 - exp(-exp(over))): a long text's segmentations are too unlikely for the plain number."""
    return over if over < -30 else float(np.log(-np.expm1(-np.exp(min(over, 700.0)))))


def encode(docs: DataFrame, samples: int = SAMPLES, model: str | None = None) -> DataFrame:
    """doc_id, sample (from 1), ids, log_prob, perturbed and log_inclusion: up to ``samples`` distinct segmentations of each text.

    A text with fewer segmentations has a row for each, with log_inclusion 0. A null
    or empty text has one row with no ids and log_prob 0. Repeated rows have
    equal keys and so equal samples. Extra columns are ignored.
    """
    return _encode(docs, samples, model, lambda lattices, ids: pa.array(ids, pa.list_(pa.int32())), "ids array<int>")


def encode_digest(docs: DataFrame, samples: int = SAMPLES, model: str | None = None) -> DataFrame:
    """As ``encode``, with n_ids, the ids (little-endian, 32 bits each) and the text decoded from them as bytes."""

    def digest(lattices: Lattices, ids: list[np.ndarray]) -> pa.Array:
        return pa.StructArray.from_arrays(
            [pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(decode_bytes(lattices, ids), pa.binary())],
            names=["n", "ids", "text"])

    return _encode(docs, samples, model, digest, "ids struct<n:int,ids:binary,text:binary>")


def _encode(docs: DataFrame, samples: int, model: str | None, form, kind: str) -> DataFrame:
    import public_tokenizers

    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices.of(path)
        for batch in small_batches(batches, "text"):
            found = sample(lattices, pc.fill_null(batch.column("text"), ""), batch.column("key").to_numpy().view(np.uint64), samples)
            rows, paths = [], []
            for doc, (segmentations, limit) in zip(batch.column("doc_id").to_pylist(), found):
                if not segmentations:
                    rows.append((doc, 1, 0.0, 0.0, 0.0))
                    paths.append(np.zeros(0, np.int64))
                for number, (edges, log, value) in enumerate(segmentations):
                    rows.append((doc, number + 1, log, value, _log_inclusion(log - limit)))
                    paths.append(edges)
            ids = lattices.ids_of_paths(paths)
            doc, number, log, value, inclusion = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), form(lattices, ids), pa.array(log, pa.float64()), pa.array(value, pa.float64()), pa.array(inclusion, pa.float64())],
                names=["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key("doc_id", "text").alias("key"))
    return rows.mapInArrow(run, f"doc_id long, sample int, {kind}, log_prob double, perturbed double, log_inclusion double")


def decode_bytes(lattices: Lattices, ids: list[np.ndarray]) -> list[bytes]:
    """The UTF-8 texts of lists of ids: boundaries become spaces, the first one is dropped."""
    if not any(map(len, ids)):
        return [b""] * len(ids)
    known = np.arange(len(lattices.spelled), dtype=np.int32)  # a negative id counts from the end, one beyond it fails
    spelled = lattices.spelled_column.take(pa.array(known[np.concatenate(ids)]))
    _, offsets, data = spelled.buffers()
    bounds = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
    data = data.to_pybytes()
    # bytes spelled one by one may make a boundary as well
    return [data[a:b].replace(BOUNDARY.encode(), b" ")[1:] for a, b in zip(bounds, bounds[1:])]


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` (ids, any others) with ``text``; null ids give null, bytes that are no UTF-8 the replacement character."""
    import public_tokenizers

    path = model or public_tokenizers.path("piece_bpe_32k.model")
    schema = StructType([*encoded.schema.fields, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices.of(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            spelled = decode_bytes(lattices, [np.array(x or [], dtype=np.int32) for x in ids])
            texts = [None if x is None else text.decode("utf-8", "replace") for x, text in zip(ids, spelled)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
