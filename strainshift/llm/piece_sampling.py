"""Distinct sampled segmentations of texts into SentencePiece pieces, by Gumbel top-k.

A piece's weight is Zipf's law over the vocabulary's own order; a text's segmentations are
the paths of its lattice, with probabilities in proportion to the product of their pieces'
weights. Adding Gumbel noise to every path's log probability and taking the k largest
draws k paths without replacement. Paths are not listed: the tree of decisions is searched
best first (A*). A node's bound is the largest perturbed value below it, which is drawn
before its children: the chosen child keeps its parent's value, and the best of the other
children is a Gumbel of their joint mass, cut at that value.

No piece crosses the space before a word or a newline, so a text's lattice is a chain of
small ones, one per unit (a space or newline and the word after it). A decision is one
unit's segmentation; it is drawn piece by piece by the lattice's backward sums, for all
units of many texts in step. Lattices are kept per distinct unit, and a unit of any length has
its whole lattice: the sums of those over LONGEST bytes carry a power of two per state.

All noise is hashed from (seed, row key, sample, unit, step): a row gets the same samples
whatever task or batch it is in.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strainshift.llm.wordhash import WordHasher, batches_of, mix

U = np.uint64
LONGEST = 64
#: Weights grow by this per byte; all paths of a unit have its bytes, so none is favoured.
PER_BYTE = 20.0
#: Lattice edges a task keeps, and bytes of text it works on at a time.
KEEP_EDGES, BATCH_BYTES = 1_000_000, 1 << 19
SHIFTS = (U(44), U(20))
UNIT = re.compile(rb"\n[^ \n]*| *[^ \n]+| +")
SPLIT = np.zeros(256, np.uint8)
SPLIT[[32, 10]], SPLIT[[9, 11, 12, 13]] = 1, 2


def tag(n: int, odd: int = 0x8EBC6AF09C88C6E3) -> np.ndarray:
    """A 64-bit number for n, to be added to keys."""
    return np.array([(n * odd) & 0xFFFFFFFFFFFFFFFF], np.uint64)


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(keys) >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Vocabulary:
    """Pieces as bytes (a space for the mark of one), their weights, and a table to find them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        score = np.array([model.get_score(i) for i in range(n)])
        plain = []
        for i in range(n):
            if model.is_byte(i):
                self.bytes[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = model.id_to_piece(i).replace("▁", " ").encode()
                plain.append(i)
        if any(b" " in p.lstrip(b" ") or b"\n" in p for p in (self.bytes[i] for i in plain)):
            raise ValueError("pieces cross words")
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[self.bytes[i][0]] = i
        rank = np.full(n, len(plain), np.float64)
        rank[np.array(plain)[np.argsort(-score[plain], kind="stable")]] = np.arange(len(plain))
        self.size = np.array([len(b) for b in self.bytes])
        self.weight = PER_BYTE ** self.size / (rank + 10)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.hasher = WordHasher(fold=False)
        self.longest = int(self.size[plain].max())
        keys = self._keys(np.frombuffer(b"".join(self.bytes[i] for i in plain), np.uint8), np.cumsum(self.size[plain]) - self.size[plain], self.size[plain])
        self.reach = np.zeros(65536, np.int64)  # the longest piece by its first two bytes
        for i in plain:
            b = self.bytes[i]
            if len(b) == 1:
                self.reach[b[0] * 256:b[0] * 256 + 256] = np.maximum(self.reach[b[0] * 256:b[0] * 256 + 256], 1)
            else:
                self.reach[b[0] * 256 + b[1]] = max(self.reach[b[0] * 256 + b[1]], len(b))
        # Two tables by different bits of the key; the second has what shares a slot of the first.
        self.key = np.zeros(n + 1, np.uint64)
        self.key[plain] = keys
        self.slot = np.full((2, 1 << 20), n, np.int32)
        left = np.array(plain)
        for k, shift in enumerate(SHIFTS):
            at = self.key[left] >> shift & U((1 << 20) - 1)
            self.slot[k, at] = left
            left = left[self.slot[k, at] != left]
        if len(left):
            raise ValueError("pieces share both slots")

    def sums(self, buffer: np.ndarray) -> np.ndarray:
        h = self.hasher
        if len(buffer) >= len(h.up):  # a unit of over two MB: grow the powers for it
            h.up, h.down = (np.cumprod(np.concatenate(([U(1)], np.full(len(buffer), p[1])))) for p in (h.up, h.down))
        return np.concatenate(([U(0)], np.cumsum(self.hasher.values[buffer] * self.hasher.up[:len(buffer)])))

    def _keys(self, buffer, start, size, sums=None):
        sums = self.sums(buffer) if sums is None else sums
        h = (sums[start + size] - sums[start]) * self.hasher.down[start]
        return (h + size.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)) * U(0x9E3779B97F4A7C15)

    def find(self, buffer, start, size, sums):
        """Ids of the pieces that stand at start with that size; -1 for none."""
        keys = self._keys(buffer, start, size, sums)
        out = self.slot[0].take(keys >> SHIFTS[0])
        miss = np.flatnonzero(self.key.take(out) != keys)
        other = self.slot[1].take(keys[miss] >> SHIFTS[1] & U((1 << 20) - 1))
        out[miss] = np.where(self.key.take(other) == keys[miss], other, -1)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, spaces as spaces."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()


class Lattices:
    """Lattices of distinct units: states are byte positions, edges are pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self):
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of units found by hash
        self.named: dict[bytes, int] = {}                                       # of other units
        self.states = self.size = 0          # in use; the arrays below have room for more
        self.edge = np.zeros(1 << 16, np.int32)   # where each state's edges begin
        # Of each edge: the running share of its state's mass, log of its share, its piece, the state behind it.
        self.upto, self.logp = np.zeros(1 << 16), np.zeros(1 << 16)
        self.id, self.next = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int32)

    def _room(self, states: int, edges: int) -> None:
        for names, need in ((("edge",), self.states + states + 1), (("upto", "logp", "id", "next"), self.size + edges)):
            for name in names:
                old = getattr(self, name)
                if need > len(old):
                    setattr(self, name, np.resize(old, max(need, len(old) * 3 // 2)))

    def add(self, units: list[bytes]) -> np.ndarray:
        """Put the units' lattices down; gives their first states."""
        firsts = [self._add(units[a:b]) for a, b in batches_of([len(u) for u in units], 1 << 20)]
        return np.concatenate(firsts) if firsts else np.zeros(0, np.int64)

    def _add(self, units):
        v, buffer = self.v, np.frombuffer(b"".join(units), np.uint8)
        sizes = np.array([len(u) for u in units])
        ends = np.cumsum(sizes)
        n, rest = len(buffer), np.repeat(ends, sizes) - np.arange(len(buffer))
        sums = v.sums(buffer)
        width = np.where(buffer < 0x80, 1, np.where(buffer < 0xE0, 2, np.where(buffer < 0xF0, 3, 4)))
        start = (buffer & 0xC0) != 0x80
        reach = np.minimum(v.reach[buffer.astype(np.int64) * 256 + np.r_[buffer[1:], 0]], rest)
        reach[rest == 1] = 1
        at, source, ids = np.flatnonzero(start), [], []
        plain = np.zeros(n, bool)
        for size in range(1, v.longest + 1):
            at = at[reach[at] >= size]
            found = v.find(buffer, at, np.full(len(at), size), sums)
            hit = found >= 0
            source.append(at[hit])
            ids.append(found[hit])
            plain[at[hit][width[at[hit]] == size]] = True
        # Characters that are no piece go by their bytes.
        alone = np.flatnonzero(start & ~plain)
        alone = np.repeat(alone, width[alone]) + np.concatenate([np.arange(w) for w in width[alone]]) if len(alone) else alone
        source, ids = np.concatenate([*source, alone]), np.concatenate([*ids, v.byte_id[buffer[alone]]])
        order = np.argsort(source, kind="stable")
        source, ids = source[order], ids[order]
        target, weight = source + v.size[ids], v.weight[ids]
        left = rest[source].astype(np.min_scalar_type(int(sizes.max())))  # small types sort faster
        goal = v.size[ids] == left
        # Backward sums, by the bytes that are left; behind its last byte a unit has a place of its own, of mass 1.
        unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        at, to = source + unit[source], target + unit[source]
        total = np.zeros(n + len(units))
        total[ends + np.arange(len(units))] = 1.0
        # Sums of long units leave the range of doubles, so there a state's mass is total * 2 ** power.
        scaled = int(sizes.max()) > LONGEST
        power = np.zeros(len(total) if scaled else 0, np.int32)
        by_rest = np.argsort(left, kind="stable")
        at_r, to_r, weight_r = at[by_rest], to[by_rest], weight[by_rest]
        head_r = np.r_[True, at_r[1:] != at_r[:-1]]
        cuts = np.searchsorted(left[by_rest], np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if a < b:
                head = np.flatnonzero(head_r[a:b])
                mass, state = weight_r[a:b] * total.take(to_r[a:b]), at_r[a:b][head]
                if scaled:
                    own = power.take(to_r[a:b])
                    most = np.maximum.reduceat(own, head)
                    mass = np.ldexp(mass, own - np.repeat(most, np.diff(head, append=b - a)))
                    total[state], up = np.frexp(np.add.reduceat(mass, head))
                    power[state] = most + up
                else:
                    total[state] = np.add.reduceat(mass, head)
        share = weight * total.take(to) / total.take(at)
        if scaled:
            share = np.ldexp(share, power.take(to) - power.take(at))
        begin = np.r_[0, np.cumsum(np.bincount(source, minlength=n))]
        upto, nth = share.copy(), np.arange(len(source)) - begin[source]
        e, last = np.flatnonzero(nth == 1), np.r_[nth[1:] <= 1, True]
        while len(e):
            upto[e] += upto[e - 1]
            e = e[~last[e]] + 1
        upto[begin[1:][begin[1:] > begin[:-1]] - 1] = 2.0  # the last edge takes what rounding leaves
        base, e = self.states, slice(self.size, self.size + len(ids))
        self._room(n, len(ids))
        self.edge[base + 1:base + n + 1] = begin[1:] + self.size
        self.upto[e], self.logp[e], self.id[e], self.next[e] = upto, np.log(share), ids, np.where(goal, -1, target + base)
        self.states, self.size = base + n, self.size + len(ids)
        return ends - sizes + base

    def by_text(self, units: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(u for u in units if u not in self.named))
        self.named.update(zip(new, self.add(new).tolist()))
        return np.array([self.named[u] for u in units], np.int64)

    def by_key(self, keys: np.ndarray, unit) -> np.ndarray:
        """First states of units by distinct sorted keys; unit(i) gives the i-th one's bytes."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            first = self.add([unit(i) for i in np.flatnonzero(~known).tolist()])
            merged = np.r_[self.keys, keys[~known]]
            order = np.argsort(merged, kind="stable")
            self.keys, self.first = merged[order], np.r_[self.first, first][order]
            at = np.searchsorted(self.keys, keys)
        return self.first[at]

    def draw(self, state: np.ndarray, noise: np.ndarray, order: np.ndarray | None = None):
        """A segmentation of each unit: pieces per unit, log probabilities, and ids in order.

        An order that has the same units together reads memory faster; it changes nothing else.
        """
        n = len(state)
        count, logp, steps = np.zeros(n, np.int64), np.zeros(n), []
        live = np.arange(n) if order is None else order
        state, noise = state[live], noise[live]
        while len(live):
            u = uniform(noise + tag(len(steps), 0xA0761D6478BD642F))
            e = self.edge.take(state)
            more = np.flatnonzero(self.upto.take(e) < u)
            while len(more):
                further = e[more] + 1
                e[more] = further
                more = more[self.upto.take(further) < u[more]]
            logp[live] += self.logp.take(e)
            count[live] += 1
            steps.append((live, self.id.take(e)))
            state = self.next.take(e)
            on = np.flatnonzero(state >= 0)
            live, state, noise = live[on], state[on], noise[on]
        at = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.uint16)
        for k, (who, piece) in enumerate(steps):
            ids[at[who] + k] = piece
        return count, logp, ids


def whole_units(text: bytes) -> list[bytes]:
    """Units of a text with its space in front."""
    return UNIT.findall(b" " + text) if text else []


def cut_units(text: bytes) -> list[bytes]:
    """The same with long units cut at characters; samples are drawn from whole units."""
    out = []
    for unit in whole_units(text):
        while len(unit) > LONGEST:
            at = LONGEST
            while unit[at] & 0xC0 == 0x80:
                at -= 1
            out.append(unit[:at])
            unit = unit[at:]
        out.append(unit)
    return out


class Sampler:
    """Samples k segmentations of each text; one per task."""

    def __init__(self, path: str, k: int, seed: int):
        self.v, self.k, self.seed = Vocabulary(path), k, seed
        self.lattices = Lattices(self.v)

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First states of all units in order, and units per text."""
        if self.lattices.size > KEEP_EDGES:
            self.lattices.forget()
        hashes, lengths, counts, places, buffer = self.v.hasher.placed_words(texts)
        kind = SPLIT[buffer]
        gap, ends = kind == 1, np.cumsum([len(t) + 1 for t in texts])
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.flatnonzero((kind == 2) | (gap & np.r_[True, gap[:-1]])), "right")] = True
        owner = np.repeat(np.arange(len(texts)), counts)
        odd[owner[lengths >= LONGEST]] = True
        line = buffer[places - 1] == 10
        line[(np.cumsum(counts) - counts)[counts > 0]] = False
        use = ~odd[owner]
        keys, first, back = np.unique(mix(hashes[use] + line[use].astype(np.uint64)), return_index=True, return_inverse=True)
        raw, at, size, new_line = buffer.tobytes(), places[use][first], lengths[use][first], line[use][first]
        states = self.lattices.by_key(keys, lambda i: (b"\n" if new_line[i] else b" ") + raw[at[i]:at[i] + size[i]])[back]
        if not odd.any():
            return states, counts
        cuts = np.cumsum(np.where(odd, 0, counts))[:-1]
        parts, sizes = np.split(states, cuts), counts.copy()
        for i in np.flatnonzero(odd):
            parts[i] = self.lattices.by_text(whole_units(texts[i]))
            sizes[i] = len(parts[i])
        return np.concatenate(parts), sizes

    def _others(self, before, logp, top, noise):
        """The best perturbed value among a unit's other segmentations, cut at its parent's."""
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.log(-np.expm1(logp))
            where = before + rest
            cut = where - np.logaddexp(where - top, np.log(-np.log(uniform(noise))))
        return np.where(rest > -np.inf, cut, -np.inf)

    def sample(self, keys: np.ndarray, texts: list[bytes]):
        """Per text a list of (ids, log probability, perturbed value, inclusion), best first."""
        states, counts = self.units(texts)
        ends = np.cumsum(counts)
        starts, owner = ends - counts, np.repeat(np.arange(len(texts)), counts)
        text_noise = mix(keys.astype(np.uint64) + mix(np.array([self.seed], np.uint64)))
        unit_noise = mix(text_noise[owner] + (np.arange(len(states)) - starts[owner]).astype(np.uint64) * U(0xE7037ED1A0B428DB))
        stream = lambda s, kind: tag(s * 4 + kind)
        top = -np.log(-np.log(uniform(text_noise + stream(0, 3))))
        together = np.argsort(states.astype(np.int32), kind="stable")
        pieces, logp, ids = self.lattices.draw(states, unit_noise + stream(0, 0), together)
        cuts = np.r_[0, np.cumsum(pieces)]
        out = [[] for _ in texts]
        # The open list: for each path and unit, the best value off the path there.
        paths, opened = [], []
        before = np.concatenate([np.cumsum(logp[a:b]) - logp[a:b] for a, b in zip(starts, ends)]) if len(states) else np.zeros(0)
        paths.append((pieces, logp, ids, cuts))
        opened.append(self._others(before, logp, top[owner], unit_noise + stream(0, 1)))
        totals = np.array([logp[a:b].sum() for a, b in zip(starts, ends)])
        found = [[(ids[cuts[a]:cuts[b]], t, g)] for a, b, t, g in zip(starts, ends, totals, top)]
        taken: dict[tuple[int, int], list] = {}
        for s in range(1, self.k + 1):
            # The best open node of every text that is still searched.
            has = np.flatnonzero(counts > 0)
            has = has[[len(found[d]) == s for d in has]] if len(has) else has
            best, path, unit = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for p, values in enumerate(opened):
                for d in has.tolist():
                    k = starts[d] + int(np.argmax(values[starts[d]:ends[d]]))
                    if values[k] > best[d]:
                        best[d], path[d], unit[d] = values[k], p, k
            for d in range(len(texts)):
                if len(found[d]) == s:
                    out[d] = [(i, t, g, 1.0 if best[d] == -np.inf else float(-np.expm1(-np.exp(min(t - best[d], 700.0)))))
                              for i, t, g in found[d][:self.k]]
            go = has[best[has] > -np.inf]
            if s == self.k or not len(go):
                break
            # New paths: the old one up to the unit, another segmentation there, fresh draws behind.
            behind = np.concatenate([np.arange(unit[d] + 1, ends[d]) for d in go]) if len(go) else np.zeros(0, np.int64)
            place = np.full(len(states), -1)
            place[behind] = np.arange(len(behind))
            order = place[together]
            more_pieces, more_logp, more_ids = self.lattices.draw(states[behind], unit_noise[behind] + stream(s, 0), order[order >= 0])
            more_cuts, at = np.r_[0, np.cumsum(more_pieces)], 0
            values = np.full(len(states), -np.inf)
            new_pieces, new_logp, parts = np.zeros(len(states), np.int64), np.zeros(len(states)), []
            befores, seen_at = [], []
            for d in go.tolist():
                p, k = int(path[d]), int(unit[d])
                _, old_logp, old_ids, old_cuts = paths[p]
                seen_at.append(taken.setdefault((p, k), [(tuple(old_ids[old_cuts[k]:old_cuts[k + 1]].tolist()), float(old_logp[k]))]))
            others = self._others_of(states[unit[go]], seen_at, unit_noise[unit[go]] + stream(s, 2))
            for d, seen, (other, chance) in zip(go.tolist(), seen_at, others):
                p, k = int(path[d]), int(unit[d])
                old_pieces, old_logp, old_ids, old_cuts = paths[p]
                lead = old_logp[starts[d]:k].sum()
                seen.append((tuple(other.tolist()), chance))
                left = -np.expm1(np.log(sum(np.exp(x) for _, x in seen))) if sum(np.exp(x) for _, x in seen) < 1 - 1e-12 else 0.0
                opened[p][k] = -np.inf if left <= 0 else float(
                    (w := lead + np.log(left)) - np.logaddexp(w - best[d], np.log(-np.log(uniform(unit_noise[k:k + 1] + stream(s, 3))[0]))))
                n = int(ends[d]) - k - 1
                tail = slice(at, at + n)
                new_pieces[starts[d]:k], new_logp[starts[d]:k] = old_pieces[starts[d]:k], old_logp[starts[d]:k]
                new_pieces[k], new_logp[k] = len(other), chance
                new_pieces[k + 1:ends[d]], new_logp[k + 1:ends[d]] = more_pieces[tail], more_logp[tail]
                got = np.concatenate([old_ids[old_cuts[starts[d]]:old_cuts[k]], other, more_ids[more_cuts[at]:more_cuts[at + n]]])
                befores.append(lead + chance + np.cumsum(more_logp[tail]) - more_logp[tail])
                at += n
                parts.append(got)
                found[d].append((got, float(new_logp[starts[d]:ends[d]].sum()), float(best[d])))
            values[behind] = self._others(np.concatenate(befores), more_logp, best[owner[behind]], unit_noise[behind] + stream(s, 1))
            paths.append((new_pieces, new_logp, np.concatenate(parts), np.r_[0, np.cumsum(new_pieces)]))
            opened.append(values)
        return out

    def _others_of(self, states, seen_at, noise):
        """For each unit a segmentation in proportion to its probability among those not seen.

        Draws until one is new; a unit with little mass left is listed instead.
        """
        out, open_units = [None] * len(states), list(range(len(states)))
        had = [{s for s, _ in seen} for seen in seen_at]
        for k in range(64):
            if not open_units:
                break
            count, logp, ids = self.lattices.draw(states[open_units], noise[open_units] + tag(k, 0x589965CC75374CC3))
            ends = np.cumsum(count).tolist()
            for i, a, b, chance in zip(open_units, [0, *ends], ends, logp.tolist()):
                if tuple(ids[a:b].tolist()) not in had[i]:
                    out[i] = ids[a:b], chance
            open_units = [i for i in open_units if out[i] is None]
        for i in open_units:
            out[i] = self._by_listing(states[i], had[i], noise[i:i + 1])
        return out

    def _by_listing(self, state, had, noise):
        """Best-first through the unit's own lattice with one Gumbel per node: exact for any mass."""
        import heapq

        lat, count = self.lattices, 0
        heap = [(0.0, 0, int(state), (), 0.0)]
        while heap:
            g, _, at, ids, logp = heapq.heappop(heap)
            if at < 0:
                if ids not in had:
                    return np.array(ids, np.uint16), logp
                continue
            a, b = int(lat.edge[at]), int(lat.edge[at + 1])
            count += 1
            u = uniform(np.arange(b - a, dtype=np.uint64) + noise + tag(1000 + count, 0xD6E8FEB86659FD93))
            place = logp + lat.logp[a:b]
            raw = place - np.log(-np.log(u))
            value = -g  # cut so that the largest child has its parent's value
            z = raw.max()
            with np.errstate(divide="ignore"):
                v = value - raw + np.log1p(-np.exp(np.minimum(raw - z, 0)))
            cut = value - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))
            for j in range(b - a):
                heapq.heappush(heap, (-float(cut[j]), count * 100000 + j, int(lat.next[a + j]), (*ids, int(lat.id[a + j])), float(place[j])))
        raise ValueError("no other segmentation")


SAMPLES = ("key {kind}, sample int, n_pieces bigint, log_prob double, perturbed double, inclusion double, exact boolean, "
           "ids_crc32 bigint")


def sample_segmentations(docs: DataFrame, model: str, doc: str = "doc_id", text: str = "text", k: int = 2, seed: int = 1,
                         with_ids: bool = True) -> DataFrame:
    """Per row up to k segmentations, sample 1 the first drawn: key column, n_pieces, log_prob,
    perturbed (log_prob with its Gumbel), inclusion, exact, ids_crc32 (of 32-bit ids), and
    ids (16-bit little-endian) if asked for.

    inclusion is the probability that the path would be among the k drawn, given the value of
    the first one left out; 1 where no path is left. exact says that the pieces decode to the
    text. Null and empty text has one segmentation, without pieces. Noise comes from the
    key's hash: rows that share a key and text get the same samples. Other columns are not read.
    """
    kind = docs.schema[doc].dataType.simpleString()
    schema = SAMPLES.format(kind=kind) + (", ids binary" if with_ids else "")
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        sampler = Sampler(model, k, seed)
        for batch in batches:
            names, noise = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            column = batch.column(2).cast(pa.binary())
            for a, b in batches_of(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BATCH_BYTES):
                rows, texts = [], [x or b"" for x in column.slice(a, b - a).to_pylist()]
                for name, t, got in zip(names[a:b], texts, sampler.sample(noise[a:b], texts)):
                    for s, (ids, logp, value, inclusion) in enumerate(got):
                        same = sampler.v.decode(ids) == (b" " + t if t else b"")
                        row = (name, s + 1, len(ids), float(logp), float(value), inclusion, same, zlib.crc32(ids.astype("<u4").tobytes()))
                        rows.append((*row, ids.astype("<u2").tobytes()) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    rows = docs.select(F.col(doc).alias("key"), F.xxhash64(F.col(doc)).alias("noise"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", doc)


def decode_ids(data: bytes, vocabulary: Vocabulary) -> str:
    """The text of 16-bit ids."""
    return vocabulary.decode(np.frombuffer(data, "<u2").astype(np.int64))[1:].decode()
