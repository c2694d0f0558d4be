"""SentencePiece encoding and decoding with Gumbel top-k sampling of segmentations without replacement.

The lattice of a text is the chain of its words' lattices (a piece holds a
space, written as U+2581, at its start only), so beta sums and arc
probabilities are computed once per distinct word of a slice.  A segmentation
is a sequence of arc choices; its log-probability is the sum of theirs.

Sampling without replacement is a perturbed best-first (A*) search.  The root
holds a Gumbel value: the best perturbed score of any segmentation.  Along the
best path the choices not taken at each arc form a subtree, whose best
perturbed score is a Gumbel with the subtree's mass, truncated at the path's
score.  The open subtree with the best score holds the next sample: one of its
arcs is chosen in proportion, the rest of the text is drawn freely, and the
subtrees along the new part are opened.  After k samples the best open score
is the threshold kappa; a sample of log-probability phi is included with
probability 1 - exp(-exp(phi - kappa)).

All draws are hashes of (seed, row key, sample, word, step): the result of a
row depends on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import column_bytes, mix, powers, row_slices, trim

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FALLBACK = -1
_B = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces as bytes (the space mark as a space), log weights, byte pieces.

    A BPE model ranks its pieces but gives no probabilities: a piece of rank r weighs (r + 2) ** -zipf, normalised.
    """

    def __init__(self, path: str, zipf: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        rank = np.full(n, float(n))
        self.byte_id = np.zeros(256, np.int32)
        usable = np.zeros(n, bool)
        for i in range(n):
            p, s = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.bytes[i] = bytes([b])
                self.byte_id[b] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.bytes[i] = p.replace("▁", " ").encode()
                if s > -1e8 and " " not in p[1:] and "▁" not in p[1:]:
                    usable[i] = True
                    rank[i] = -s
        weight = (np.maximum(rank, 0) + 2) ** -zipf
        self.log = np.log(weight / weight.sum())
        ids = np.flatnonzero(usable)
        hashes = np.array([hash_of(self.bytes[i]) for i in ids], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order].astype(np.int32)
        self.lengths = sorted({len(self.bytes[i]) for i in ids})
        # pieces of one and of two bytes, by these as a number
        self.short = [np.full(256**m, -1, np.int32) for m in (1, 2)]
        for i in ids:
            if len(self.bytes[i]) <= 2:
                self.short[len(self.bytes[i]) - 1][int.from_bytes(self.bytes[i])] = i
        self.arc_log = np.append(self.log, self.log[self.byte_id[0]])  # at -1: a byte of a bare character
        # by the first 20 bits: the first piece with them, and how many have them
        top = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.slot_size = np.bincount(top, minlength=1 << 20).astype(np.uint8)
        self.slot = np.searchsorted(top, np.arange(1 << 20)).astype(np.int32)
        # the bits of hashes of beginnings that longer pieces have: others needn't be looked for
        self.goes_on = np.zeros(1 << 20, bool)
        heads = {self.bytes[i][:m] for i in ids for m in self.lengths if m < len(self.bytes[i])}
        self.goes_on[np.array([hash_of(b) for b in heads], np.uint64) >> np.uint64(44)] = True
        self.spell = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spell_at = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        hit, got, _ = self.matched(h)
        out[hit] = got
        return out

    def matched(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in ``h``, piece ids there) of the substring hashes that are pieces, and places that a longer piece may begin with."""
        top = (h >> np.uint64(44)).view(np.int64)
        may = np.flatnonzero(self.slot_size[top])
        at, left, want = self.slot[top[may]], self.slot_size[top[may]], h[may]
        got = np.full(len(may), -1, np.int32)
        own = np.arange(len(may))
        while len(own):
            hit = self.hashes[at] == want
            got[own[hit]] = self.ids[at[hit]]
            more = np.flatnonzero(~hit & (left > 1))
            own, at, left, want = own[more], at[more] + 1, left[more] - 1, want[more]
        hit = got >= 0
        return may[hit], got[hit], np.flatnonzero(self.goes_on[top])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that ``ids`` spell, with the leading space of the encoder."""
        n = np.diff(self.spell_at)[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(n) else 0) + np.repeat(self.spell_at[ids] - (ends - n), n)
        return self.spell[at].tobytes()


def hash_of(b: bytes) -> np.uint64:
    a = np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        return mix(np.array([(a * powers(len(a))[::-1]).sum(dtype=np.uint64)], np.uint64))[0]


#: Word bytes that a worker's lattice keeps between slices; a fuller one starts anew.  A byte takes about 80 bytes.
LATTICE_BYTES = 1 << 19

#: Word bytes that are added to a lattice at once; a longer word is added alone.
ADDED_BYTES = 1 << 15


def appended(a: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``a`` with ``more`` from place ``used`` on, in a copy with a quarter's more room where it doesn't fit."""
    if used + len(more) > len(a):
        a, old = np.empty((used + len(more)) * 5 // 4, a.dtype), a
        a[:used] = old[:used]
    a[used : used + len(more)] = more
    return a


class Lattice:
    """Arcs of the distinct words seen so far: by start byte, with probabilities of being taken there.

    A word's arcs depend on the word alone, so what a worker keeps doesn't change a result.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.raw, self.first = np.zeros(0, np.uint8), np.zeros(1, np.int32)
        self.pos, self.size, self.piece, self.next = (np.zeros(0, np.int32) for _ in range(4))
        self.last, self.logp, self.upto = np.zeros(0, bool), np.zeros(0), np.zeros(0)
        self.clear()

    def clear(self) -> None:
        """Forget all words; the room that they took is used again."""
        self.n_bytes, self.n_arcs = 0, 0
        self.known, self.known_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def begins(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Start bytes, in this lattice, of the words that begin at ``at`` in ``raw``; new ones are added."""
        if not len(at):
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            inside = np.arange(len(raw)) - np.repeat(at, length)
            h = mix(np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[inside], at) + length.astype(np.uint64))
        words, some, which = np.unique(h, return_index=True, return_inverse=True)
        here = np.searchsorted(self.known, words)
        new = np.ones(len(words), bool)
        if len(self.known):
            new = self.known[np.minimum(here, len(self.known) - 1)] != words
        if new.any():
            a, n = at[some[new]], length[some[new]]
            own, base, i = np.cumsum(n) - n, self.n_bytes, 0
            while i < len(n):  # in parts: building arcs takes several times what they keep
                j = max(int(np.searchsorted(own + n, own[i] + ADDED_BYTES, side="right")), i + 1)
                part = own[i:j] - own[i]
                self.add(raw[np.repeat(a[i:j] - part, n[i:j]) + np.arange(int(n[i:j].sum()))], part, n[i:j])
                i = j
            known, known_at = np.concatenate([self.known, words[new]]), np.concatenate([self.known_at, own + base])
            order = np.argsort(known)
            self.known, self.known_at = known[order], known_at[order]
        return self.known_at[np.searchsorted(self.known, words)][which]

    def add(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Append the lattices of words that lie one after the other in ``raw``."""
        v, n = self.v, len(raw)
        end = np.repeat(starts + lengths, lengths)
        left = (end - np.arange(n)).astype(np.int32)
        with np.errstate(over="ignore"):
            # prefix hashes: H[i + l] - H[i] * B**l is the hash of the substring
            head = np.zeros(n + 1, np.uint64)
            inv = _inverse_powers(n + 1)
            head[1:] = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * inv[1 : n + 1], dtype=np.uint64)
            big = powers(n + 2)
            pos, size, piece = [], [], []
            lead = (raw & 0xC0) != 0x80
            spots = np.flatnonzero(lead).astype(np.int32)
            for m in v.lengths:
                spots = spots[left[spots] >= m]
                if not len(spots):
                    break
                if m <= 2:
                    code = raw[spots] if m == 1 else raw[spots].astype(np.uint16) << 8 | raw[spots + 1]
                    got = v.short[m - 1][code]
                    hit = np.flatnonzero(got >= 0)
                    got, on = got[hit], slice(None)
                else:
                    stop = spots + m
                    hit, got, on = v.matched(mix((head[stop] - head[spots]) * big[stop]))
                pos.append(spots[hit])
                size.append(np.full(len(hit), m, np.int32))
                piece.append(got)
                spots = spots[on]
        width = np.ones(n, np.int32)
        width[raw >= 0xC0], width[raw >= 0xE0], width[raw >= 0xF0] = 2, 3, 4
        single = np.zeros(n, bool)
        for p, s in zip(pos, size, strict=True):
            single[p[s == width[p]]] = True
        bare = np.flatnonzero(lead & ~single).astype(np.int32)  # characters that are no piece are spelt in bytes
        pos.append(bare)
        size.append(np.minimum(width[bare], left[bare]))
        piece.append(np.full(len(bare), FALLBACK, np.int32))
        # arcs by start byte, long ones first: the groups hold one arc a start byte each, shortest first, the bare ones last
        arcs_at = np.zeros(n + 1, np.int64)
        for p in pos:
            arcs_at[p] += 1
        first = np.concatenate([[0], np.cumsum(arcs_at[:n])])
        filled, total = first[:n].copy(), int(first[n])
        order = np.empty(total, np.int64)
        offset = np.cumsum([0, *(len(p) for p in pos)])
        for g in (len(pos) - 1, *range(len(pos) - 2, -1, -1)):
            order[filled[pos[g]]] = np.arange(offset[g], offset[g + 1])
            filled[pos[g]] += 1
        size, piece = np.concatenate(size)[order], np.concatenate(piece)[order]
        pos = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
        score, bare = v.arc_log[piece], np.flatnonzero(piece < 0)
        score[bare] *= size[bare]
        stop = pos + size
        ends_word = size == left[pos]
        # from the words' ends on; a word's end counts as 0, so beta is looked up inside words only
        beta, logp = np.zeros(n + 1), np.empty(total)
        starts = np.flatnonzero(arcs_at[:n] > 0)
        narrow = np.uint16 if n and left.max() < 1 << 16 else np.int32  # sorted by digits, in one pass
        starts = starts[np.argsort(left[starts].astype(narrow), kind="stable")]
        cut = np.searchsorted(left[starts], np.arange(1, (int(left.max()) if n else 0) + 2))
        many = first[starts + 1] - first[starts]
        begin = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(first[starts] - begin[:-1], many) + np.arange(total)
        x, onward = score[at], np.where(ends_word, n, stop)[at]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i < j:
                here = x[begin[i] : begin[j]]
                here += beta[onward[begin[i] : begin[j]]]
                beta[starts[i:j]] = np.logaddexp.reduceat(here, begin[i:j] - begin[i])
        logp[at] = np.minimum(x - np.repeat(beta[starts], many), 0.0)
        # sums of probabilities from a position's first arc on, arc by arc so that they don't depend on other words
        upto = np.exp(logp)
        at, stops = first[starts], first[starts + 1]
        while len(at):
            on = at + 1 < stops
            at, stops = at[on] + 1, stops[on]
            upto[at] += upto[at - 1]
        upto[first[1:][arcs_at[:n] > 0] - 1] = 2.0
        k, base = self.n_arcs, self.n_bytes
        for name, more in (("pos", pos + base), ("size", size), ("piece", piece), ("last", ends_word), ("next", np.where(ends_word, -1, stop + base)), ("logp", logp), ("upto", upto)):
            setattr(self, name, appended(getattr(self, name), k, more))
        self.raw, self.first = appended(self.raw, base, raw), appended(self.first, base, first + k)
        self.n_arcs, self.n_bytes = k + total, base + n

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc from each start byte ``at``, by uniform ``u`` in (0, 1)."""
        arc = self.first[at]
        miss = np.flatnonzero(u >= self.upto[arc])
        while len(miss):
            arc[miss] += 1
            miss = miss[u[miss] >= self.upto[arc[miss]]]
        return arc


_INV = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    """Powers of the inverse of the polynomial base modulo 2**64."""
    global _INV
    if len(_INV) < n:
        inverse = np.uint64(pow(int(_B), -1, 2**64))
        with np.errstate(over="ignore"):
            _INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), inverse)]).astype(np.uint64), dtype=np.uint64)
    return _INV[:n]


def salted(seed: np.ndarray, *parts) -> np.ndarray:
    """Hashes of a seed and integers."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.uint64)
        for p in parts:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + np.asarray(p).astype(np.uint64) + np.uint64(1))
    return h


def uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Uniforms in (0, 1) that are hashes of a seed and integers."""
    return ((salted(seed, *parts) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel of location ``phi`` below ``top``: phi - log(exp(phi - top) - log u), where phi is -inf: -inf."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, np.minimum(out, top))


def walk(lat: Lattice, start: np.ndarray, seed: np.ndarray, sample: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(arcs of all walks one after the other, arcs of each walk): free walks from ``start`` (-1: nothing) to the word's end."""
    count = np.zeros(len(start), np.int64)
    live, at, steps = np.flatnonzero(start >= 0), start[start >= 0], []
    own = salted(seed[live], sample, word[live])
    t = 0
    while len(live):
        arc = lat.draw(at, uniform(own, t))
        steps.append((live, arc))
        count[live] += 1
        at = lat.next[arc]
        go = np.flatnonzero(at >= 0)
        live, own, at = live[go], own[go], at[go]
        t += 1
    base = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for t, (who, arc) in enumerate(steps):
        out[base[who] + t] = arc
    return out, count


class Sampler:
    """Gumbel top-k over the rows of a slice; ``samples[i]`` has (score, log-probability, arcs) of each row, best first."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray, v: Vocabulary, k: int, lattice: Lattice | None = None):
        spaced = [b" " + t if t else b"" for t in texts]
        raw = np.frombuffer(b"".join(spaced), np.uint8)
        at = np.flatnonzero(raw == 32)
        length = np.diff(np.append(at, len(raw)))
        row_at = np.concatenate([[0], np.cumsum([len(s) for s in spaced])])
        self.word_first = np.searchsorted(at, row_at)
        n_words = np.diff(self.word_first)
        lat = lattice or Lattice(v)
        begin = lat.begins(raw, at, length)
        self.lat, self.v, self.k, n = lat, v, k, len(texts)
        ordinal = np.arange(len(at)) - np.repeat(self.word_first[:-1], n_words)
        self.samples: list[list[tuple[float, float, np.ndarray]]] = [[] for _ in range(n)]
        open_: list[list[tuple]] = [[] for _ in range(n)]
        arcs, count = walk(lat, begin, np.repeat(seeds, n_words), 0, ordinal)
        score = -np.log(-np.log(uniform(seeds, 0, 1 << 40)))
        cuts = np.concatenate([[0], np.cumsum(count)])[self.word_first]
        word_of = np.repeat(ordinal, count)
        paths = [(r, float(score[r]), arcs[cuts[r] : cuts[r + 1]], word_of[cuts[r] : cuts[r + 1]], 0) for r in range(n)]
        self._emit(paths, open_, seeds, 0)
        for i in range(1, k):
            forks = []
            for r in range(n):
                if open_[r]:
                    j = max(range(len(open_[r])), key=lambda x: open_[r][x][0])
                    forks.append((r, open_[r].pop(j)))
            if not forks:
                break
            who = np.array([r for r, _ in forks])
            u_choice, u_rest = uniform(seeds[who], i, 1 << 41), uniform(seeds[who], i, 1 << 42)
            rest, choices, start, word = [], [], [], []
            for f, (r, (top, path, t, shut, words)) in enumerate(forks):
                choice = self._other(path[t], shut, u_choice[f])
                w = int(words[t])
                after = -1 if lat.last[choice] else lat.pos[choice] + lat.size[choice]
                start.append(np.concatenate([[after], begin[self.word_first[r] + w + 1 : self.word_first[r + 1]]]))
                word.append(np.arange(w, w + len(start[-1])))
                choices.append(choice)
                rest.append(self._mass(path, t, {*shut, choice}))
            # what is left of the subtree: neither the closed arcs nor the chosen one
            left = truncated(np.array(rest), np.array([f[1][0] for f in forks]), u_rest)
            size = np.array([len(x) for x in start])
            arcs, count = walk(lat, np.concatenate(start).astype(np.int64), np.repeat(seeds[who], size), i, np.concatenate(word))
            ends = np.concatenate([[0], np.cumsum(count)])
            at_word = np.concatenate([[0], np.cumsum(size)])
            paths = []
            for f, (r, (top, path, t, shut, words)) in enumerate(forks):
                if left[f] > -np.inf:
                    open_[r].append((float(left[f]), path, t, {*shut, choices[f]}, words))
                new = np.concatenate([path[:t], [choices[f]], arcs[ends[at_word[f]] : ends[at_word[f + 1]]]])
                new_words = np.concatenate([words[: t + 1], np.repeat(word[f], count[at_word[f] : at_word[f + 1]])])
                paths.append((r, top, new, new_words, t + 1))
            self._emit(paths, open_, seeds, i)
        self.kappa = np.array([max((o[0] for o in op), default=-np.inf) for op in open_])

    def _mass(self, path: np.ndarray, t: int, shut: set[int]) -> float:
        """Log mass of the choices at step ``t`` outside ``shut``."""
        lat = self.lat
        p = lat.pos[path[t]]
        left = [a for a in range(lat.first[p], lat.first[p + 1]) if a not in shut]
        if not left:
            return -np.inf
        return float(lat.logp[path[:t]].sum() + np.logaddexp.reduce(lat.logp[left]))

    def _other(self, arc: int, shut: set[int], u: float) -> int:
        lat = self.lat
        p = lat.pos[arc]
        left = np.array([a for a in range(lat.first[p], lat.first[p + 1]) if a not in shut])
        c = np.cumsum(np.exp(lat.logp[left] - lat.logp[left].max()))
        return int(left[min(int(np.searchsorted(c, u * c[-1])), len(left) - 1)])

    def _emit(self, paths: list[tuple], open_: list[list[tuple]], seeds: np.ndarray, i: int) -> None:
        """Add a sample a row and open the subtrees along its part from a step on; paths: (row, score, arcs, words, step).

        A hashed uniform has 53 bits, so a Gumbel is at most 37 above its location.  Locations fall along the path: once
        37 above the path's log-probability is under the k-th best open score, no later subtree can be reached.
        """
        lat, k = self.lat, self.k
        flat = np.concatenate([p[2] for p in paths])
        size = np.array([len(p[2]) for p in paths])
        base = np.cumsum(size) - size
        logs = lat.logp[flat]
        heads = []
        for (r, score, path, _, begin), b, n in zip(paths, base, size, strict=True):
            own = logs[b : b + n]
            self.samples[r].append((score, float(own.sum()), path))
            heads.append(float(own[:begin].sum()))
        heads, at = np.array(heads), np.array([p[4] for p in paths])
        top, seed = np.array([p[1] for p in paths]), seeds[np.array([p[0] for p in paths])]
        step, live = 256, np.arange(len(paths))
        while True:
            live = live[[bool(at[f] < size[f] and (len(o := open_[paths[f][0]]) < k or heads[f] + 38 >= sorted(x[0] for x in o)[-k])) for f in live]]
            if not len(live):
                return
            n = np.minimum(size[live] - at[live], step)
            f, inside = np.repeat(live, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = base[f] + at[f] + inside
            part = flat[place]
            # running sums a row: the heads join in at the first step
            x = logs[place]
            first = np.cumsum(n) - n
            run = np.cumsum(x)
            run += np.repeat(heads[live] - (run[first] - x[first]), n)
            t = np.flatnonzero(x < 0)  # an arc that is taken for certain leaves no subtree
            if len(t):
                with np.errstate(divide="ignore"):
                    phi = run[t] - x[t] + np.log(-np.expm1(x[t]))
                g = truncated(phi, top[f[t]], uniform(seed[f[t]], i, at[f[t]] + inside[t], 1 << 43))
                own = f[t]
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                size_of = np.diff(np.append(begin, len(own)))
                for _ in range(k):  # no more than these can ever be popped
                    best = np.maximum.reduceat(g, begin)
                    for b in np.flatnonzero((g == np.repeat(best, size_of)) & (g > -np.inf)):
                        j = own[b]
                        r, _, path, words, _ = paths[j]
                        open_[r].append((float(g[b]), path, int(at[j] + inside[t[b]]), {int(part[t[b]])}, words))
                        g[b] = -np.inf
            heads[live] = run[np.cumsum(n) - 1]
            at[live] += n
            step *= 4

    def ids(self, path: np.ndarray) -> np.ndarray:
        """Piece ids of arcs, one path or several one after the other."""
        return self.pieces(path)[0]

    def pieces(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each arc)"""
        lat = self.lat
        piece = lat.piece[path]
        if (piece >= 0).all():
            return piece, np.ones(len(piece), np.int64)
        n = np.where(piece >= 0, 1, lat.size[path])
        out = np.repeat(piece, n)
        bare = np.flatnonzero(out < 0)
        if len(bare):
            inside = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
            out[bare] = self.v.byte_id[lat.raw[(np.repeat(lat.pos[path], n) + inside)[bare]]]
        return out, n


def spelt(v: Vocabulary, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether ``ids[ends[j]:ends[j+1]]``, decoded, are the bytes of text ``row[j]``."""
    got, texts = v.decode(ids), raw.tobytes()
    at = np.concatenate([[0], np.cumsum(np.diff(v.spell_at)[ids])])[ends]
    lead = (np.diff(at) > 0).tolist()  # the encoder's space, before each text that isn't empty
    at, offsets = at.tolist(), offsets.tolist()
    return np.array([got[at[j] + lead[j] : at[j + 1]] == texts[offsets[r] : offsets[r + 1]] for j, r in enumerate(row.tolist())], bool)


def sample_segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, model: str = DEFAULT_MODEL, zipf: float = 1.0, seed: int = 1) -> DataFrame:
    """(key, sample, n_pieces, ids, log_prob, score, log_inclusion, exact), up to ``k`` rows per input row.

    Sample 0 is the best perturbed segmentation.  ``log_prob`` is normalised over the text's lattice, ``score`` the
    perturbed log-probability, ``log_inclusion`` the log-probability of being among ``k`` (0 where the lattice has no
    further segmentation), ``exact`` whether the decoded ids give the text back.  Texts with fewer segmentations give
    fewer rows; an empty or null text has the empty segmentation.  A null key seeds as an empty one; rows that repeat
    are sampled alike; an empty table gives no rows; other columns are ignored.  Characters that are no piece, U+2581
    included, are spelt in byte pieces, so that decoding is exact.
    """
    v = Vocabulary(model, zipf)
    if k < 1:
        raise ValueError("k is at least 1")
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in (("sample", T.IntegerType()), ("n_pieces", T.LongType()), ("ids", T.ArrayType(T.IntegerType(), False)), ("log_prob", T.DoubleType()), ("score", T.DoubleType()), ("log_inclusion", T.DoubleType()), ("exact", T.BooleanType())))])
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(v)
        for b in batches:
            for part in row_slices(b, "text", 4096, 1 << 18):
                if lattice.n_bytes > LATTICE_BYTES:
                    lattice.clear()
                raw, offsets = column_bytes(part.column(1))
                whole = raw.tobytes()
                texts = [whole[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]
                s = Sampler(texts, part.column(2).to_numpy().view(np.uint64), v, k, lattice)
                drawn = [(r, i, score, logp, path) for r, got in enumerate(s.samples) for i, (score, logp, path) in enumerate(got)]
                row, nth = np.array([d[0] for d in drawn]), pa.array([d[1] for d in drawn], pa.int32())
                score, logp = np.array([d[2] for d in drawn]), np.array([d[3] for d in drawn])
                ids, n = s.pieces(np.concatenate([d[4] for d in drawn]).astype(np.int64))
                paths = np.cumsum([0, *(len(d[4]) for d in drawn)])
                ends = np.concatenate([[0], np.cumsum(n)])[paths]
                same = spelt(v, ids, ends, raw, offsets, row)
                x = logp - s.kappa[row]
                with np.errstate(over="ignore", divide="ignore"):
                    inc = np.where(np.isneginf(s.kappa[row]), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700))))))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), nth, pa.array(np.diff(ends)), lists, pa.array(logp), pa.array(score), pa.array(inc), pa.array(same)], names=schema.names)
                del s, drawn, ids, lists
            trim()

    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``rows`` with a column ``decoded``: the text that ``ids`` spell.  Null ids give null; invalid UTF-8 is replaced."""
    v = Vocabulary(model)
    at = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else v.decode(np.array(x, np.int64))[1:].decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)
