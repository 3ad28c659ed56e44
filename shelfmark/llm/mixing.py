"""The numerical part of the language model: bits of words, hashed contexts, gated mixing, and refinement along a text.

A text is taken as the bytes of its lower-cased words, one blank between words and an end mark after the last. Each byte is coded as
the yes-or-no decisions on its path in a fixed binary tree (a Huffman tree for a rule of thumb, so frequent letters take few
decisions). For each decision several predictors, one per kind of context, look up a hashed slot and say how likely a 1 is, as a
logit. Mixers, whose weights are chosen by a gate, add the logits. Since every mixer gives probabilities of whole bytes
that add up to one, so does a weighted mean of them; its weights are refined along each text.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from shelfmark.llm.words import BLANKS, LOWER

BLANK, END = 0x20, 0x0A  # neither occurs in a word
_ENDS = 0x0A0A0A0A0A0A0A0A
CONTEXTS = 5  # 2 to 5 bytes before, and the word so far
SMALL = 64  # slots seen less often than this are told apart by their exact counts
STATES = 1 << 16
_PAIRS = SMALL * (SMALL + 1) // 2  # pairs of counts with a sum below SMALL
_LIMIT = 12.0  # logits lie between -_LIMIT and _LIMIT
_STEP = 2 * _LIMIT / (STATES - _PAIRS - 1)
BITS = (20, 21, 22, 23, 23)  # logarithms of the numbers of slots
LOW = 2  # contexts that the mixer for unfamiliar texts uses
SEGMENT = 128  # bytes of a text after which its weights are refined first; then whenever it has doubled, or ``LONGEST`` bytes are read
LONGEST = 4096
_TOGETHER = 1 << 14  # histories mixed at once
_SUMMED = 1 << 16  # histories whose gates' sums are made at once
HELD = 1 << 21  # histories whose probabilities a task keeps
MEMORY = 512.0  # bytes of evidence that the weights of a text begin with


def _tree() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each byte's path (one more entry for the end), and the inner node and bit of every step."""
    first = b" etaoinsrhldcumfpgwybvkxjqz\n\xc3.,"
    rank = [*first, *(b for b in range(256) if b not in first)]
    heap: list[tuple] = [(1 / (r + 2), b, b) for r, b in enumerate(rank)]
    heapq.heapify(heap)
    nodes, made = 0, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (made, a[2], b[2])))
        made += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(heap[0][2], [])]
    while stack:
        at, path = stack.pop()
        if isinstance(at, int):
            paths[at] = path
            continue
        node, nodes = nodes, nodes + 1
        stack += [(at[1], [*path, (node, 0)]), (at[2], [*path, (node, 1)])]
    begin = np.append(0, np.cumsum([len(paths[b]) for b in range(256)]))
    steps = [s for b in range(256) for s in paths[b]]
    return begin.astype(np.int32), np.array([n for n, _ in steps], np.uint8), np.array([y for _, y in steps], np.uint8)


_BEGIN, _NODE, _BIT = _tree()
_DECISIONS = np.diff(_BEGIN)
_RNG = np.random.Generator(np.random.PCG64(11))
_NODE_HASH = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
_MULTIPLY = _RNG.integers(1, 1 << 63, CONTEXTS, dtype=np.uint64) | np.uint64(1)
_LOWERED_BLANKS = np.where(BLANKS, BLANK, LOWER).astype(np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)


_BLOCK = 1 << 16  # bytes whose histories are made at once
_POWERS = np.cumprod(np.full(_BLOCK, _BASE))


def normal_form(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that stand for the texts, and where each text starts (one more entry for the end)."""
    if len(off) < 2:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    b = np.insert(_LOWERED_BLANKS[buf], off[1:], END)
    blank = b == BLANK
    follows = np.append(b[1:], np.uint8(END))
    b = b[~(blank & ((follows == BLANK) | (follows == END)))]
    before = np.append(np.uint8(END), b[:-1])
    b = b[~((b == BLANK) & (before == END))]
    return b, np.append(0, np.flatnonzero(b == END) + 1)


def histories(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte 64 bits: two bytes for the hash of the word so far, the five bytes before, and the byte itself on top; then
    the hash of each word, and where the word ends."""
    window = np.empty(len(b), np.uint64)
    hashes, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(b):
        hi = lo
        while hi < len(b):  # a word is not cut
            hi = min(len(b), hi + _BLOCK)
            out = np.flatnonzero((b[lo:hi] == BLANK) | (b[lo:hi] == END))
            if len(out):
                hi = lo + int(out[-1]) + 1
                break
        window[lo:hi], h, e = _block(b, lo, hi)
        hashes.append(h)
        ends.append(e)
        lo = hi
    return window, np.concatenate(hashes), np.concatenate(ends)


def _block(b: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``histories`` of the bytes from ``lo`` to ``hi``, where a word ends, if not at the end of all."""
    own = b[lo:hi]
    padded = np.concatenate([np.full(max(7 - lo, 0), END, np.uint8), b[max(lo - 7, 0):hi]])
    window = np.ndarray(len(own), dtype="<u8", buffer=padded, strides=(1,)).copy()
    end = own == END
    for j in range(5):  # before a text there are end marks, not the text before it
        if j == 0:
            begins = np.flatnonzero(padded[2:] == END) + 3 - 7  # of texts, also of those that begin up to four bytes earlier
            begins = begins[begins < len(own)]
        at = begins + j
        at = at[(at >= 0) & (at < len(own))]
        if j:
            begun = padded[7 + at[:, None] - np.arange(1, j + 1)] != END
            at = at[begun.all(axis=1)]
        keep = np.uint64(64 - 8 * (j + 1))
        window[at] = (window[at] >> keep << keep) | (np.uint64(_ENDS) >> (np.uint64(64) - keep))
    out = (own == BLANK) | end
    power = _POWERS[:len(own)] if len(own) <= _BLOCK else np.cumprod(np.full(len(own), _BASE))
    total = own.astype(np.uint64)
    total += np.uint64(1)
    total *= power
    before = np.empty(len(own), np.uint64)
    before[0] = 0
    np.cumsum(total[:-1], out=before[1:])
    starts = np.append(0, np.flatnonzero(out) + 1)
    starts = starts[starts < len(own)]
    sizes = np.diff(np.append(starts, len(own)))
    # The same word has the same hash wherever it stands: divided by the power at its start.
    before -= np.repeat(before[starts], sizes)
    before *= np.repeat(_inverse(power[starts]), sizes)
    before ^= before >> np.uint64(32)
    before *= np.uint64(0xD6E8FEB86659FD93)
    ends = np.flatnonzero(out)
    ends = ends[padded[ends + 6] != END]
    ends = ends[ends + lo > 0]
    window &= ~np.uint64(0xFFFF)
    return window | (before >> np.uint64(48)), before[ends].view(np.int64), ends + lo


def _inverse(odd: np.ndarray) -> np.ndarray:
    """Inverse of odd numbers among the 64-bit ones."""
    x = odd.copy()
    for _ in range(5):
        x *= np.uint64(2) - odd * x
    return x


def context_hash(history: np.ndarray, i: int) -> np.ndarray:
    """A 32-bit hash of the ``i``-th kind of context per history; the byte itself is left out."""
    if i < CONTEXTS - 1:
        seen = (history << np.uint64(8)) >> np.uint64(48 - 8 * i)
    else:
        seen = ((history >> np.uint64(40)) & np.uint64(0xFFFF)) | ((history & np.uint64(0xFFFF)) << np.uint64(16))
    seen = (seen + np.uint64(1)) * _MULTIPLY[i]
    seen ^= seen >> np.uint64(29)
    return ((seen * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of decisions per byte, and node and bit of all of them."""
    many = _DECISIONS[byte]
    ends = np.cumsum(many)
    at = np.repeat(_BEGIN[byte] - (ends - many).astype(np.int32), many) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    return many, _NODE[at], _BIT[at]


def count_bits(history: np.ndarray, counts: np.ndarray, bits: tuple[int, ...] = BITS) -> Iterator[np.ndarray]:
    """For one kind of context after the other, the decisions of distinct histories, each met ``counts`` times: slot by slot the
    number of 0 and of 1."""
    for i, size in enumerate(bits):
        table = np.zeros(2 << size, np.int32)
        for lo in range(0, len(history), _TOGETHER):
            part = history[lo:lo + _TOGETHER]
            many, node, bit = decisions((part >> np.uint64(56)).astype(np.uint8))
            slot = np.repeat(context_hash(part, i), many)
            slot ^= _NODE_HASH[node]
            slot &= np.uint32((1 << size) - 1)
            np.add.at(table, (slot << np.uint32(1)) | bit, np.repeat(counts[lo:lo + _TOGETHER], many))
        yield table


def state_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """States of counts: the exact pair where the sum is below ``SMALL``, else the logit in small steps."""
    n = zeros + ones
    small = n < SMALL
    pair = np.where(small, n * (n + 1) // 2 + ones, 0)
    logit = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -_LIMIT, _LIMIT)
    return np.where(small, pair, _PAIRS + np.round((logit + _LIMIT) / _STEP)).astype(np.uint16)


def without_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """For each state of few counts how often it is met, and followed by a 0 or a 1, when each occurrence is judged by all others."""
    out = np.zeros((2, _PAIRS))
    for bit, (n0, n1, own) in enumerate(((zeros - 1, ones, zeros), (zeros, ones - 1, ones))):
        n = n0 + n1
        use = (own > 0) & (n < SMALL)
        out[bit] = np.bincount(n[use] * (n[use] + 1) // 2 + n1[use], weights=own[use], minlength=_PAIRS)
    return out


def logits_of(met: np.ndarray) -> np.ndarray:
    """Logit of every state: for few counts what followed them in the corpus, smoothed by the counts themselves."""
    n = np.repeat(np.arange(SMALL), np.arange(1, SMALL + 1))
    ones = np.arange(_PAIRS) - n * (n + 1) // 2
    guess = (ones + 0.4) / (n + 0.8)
    p = (met[1] + 2 * guess) / (met[0] + met[1] + 2)
    few = np.clip(np.log(p / (1 - p)), -_LIMIT, _LIMIT)
    many = np.arange(STATES - _PAIRS) * _STEP - _LIMIT
    return np.concatenate([few, many]).astype(np.float32)


#: State after an occurrence of 0 or 1 is taken away; large states stay.
_N = np.repeat(np.arange(SMALL), np.arange(1, SMALL + 1))
_ONES = np.arange(_PAIRS) - _N * (_N + 1) // 2
_LESS = np.stack([np.arange(STATES), np.arange(STATES)]).astype(np.uint16)
for _bit, _take in ((0, _N - _ONES > 0), (1, _ONES > 0)):
    _LESS[_bit, :_PAIRS][_take] = ((_N - 1) * _N // 2 + _ONES - _bit)[_take]


@dataclass
class Mixer:
    """What the corpus has taught: a state per slot and kind of context, logits of states, and the gates' weights.

    ``by_node`` is chosen by the place in the tree, ``by_seen`` by which of the longer contexts have been met, ``low`` by the place
    again, for the shorter contexts only.
    """

    tables: list[np.ndarray]
    logits: list[np.ndarray]
    by_node: np.ndarray = field(default_factory=lambda: np.tile(np.float32([0.05, 0.1, 0.25, 0.4, 0.3]), (256, 1)))
    by_seen: np.ndarray = field(default_factory=lambda: np.tile(np.float32([0.05, 0.1, 0.25, 0.4, 0.3]), (16, 1)))
    low: np.ndarray = field(default_factory=lambda: np.tile(np.float32([0.4, 0.7]), (256, 1)))

    def inputs(self, history: np.ndarray, less: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per decision of the histories: bit, node, seen (which of the longer contexts have been met), and the predictors' logits
        (for one context after the other); and the number of decisions per history. With ``less`` each occurrence itself is
        taken out of the counts."""
        many, node, bit = decisions((history >> np.uint64(56)).astype(np.uint8))
        by_node = _NODE_HASH[node]
        x = np.empty((CONTEXTS, len(node)), np.float32)
        seen = np.zeros(len(node), np.uint8)
        first = bit.astype(np.int32) * STATES if less else None
        for i in range(CONTEXTS):
            slot = np.repeat(context_hash(history, i), many)
            slot ^= by_node
            slot &= np.uint32(len(self.tables[i]) - 1)
            state = self.tables[i][slot]
            if less:
                state = np.take(_LESS, state + first)
            np.take(self.logits[i], state, out=x[i])
            if i >= 1:
                seen |= (state > 0).view(np.uint8) << np.uint8(i - 1)
        return bit, node, seen, x, many

    def byte_probabilities(self, history: np.ndarray) -> np.ndarray:
        """Natural logs of what three mixers give to the byte of each history: both full mixers' mean logit, the mixer by contexts
        seen, and the one of short contexts."""
        out = np.empty((3, len(history)), np.float32)
        for lo in range(0, len(history), _TOGETHER):
            part = history[lo:lo + _TOGETHER]
            bit, node, seen, x, many = self.inputs(part)
            z = np.zeros((3, len(node)), np.float32)
            for i in range(CONTEXTS):
                z[0] += np.take(self.by_node[:, i], node) * x[i]
                z[1] += np.take(self.by_seen[:, i], seen) * x[i]
                if i < LOW:
                    z[2] += np.take(self.low[:, i], node) * x[i]
            z[0] += z[1]
            z[0] *= 0.5
            z *= 1 - 2 * bit.astype(np.float32)
            # ln(1 + e^z) without overflow; logits are bounded far below the range of floats, but weights may grow.
            np.minimum(z, 60, out=z)
            np.exp(z, out=z)
            np.log1p(z, out=z)
            first = np.append(0, np.cumsum(many)[:-1])
            np.negative(np.add.reduceat(z, first, axis=1), out=out[:, lo:lo + len(part)])
        return out


GATES = {"by_node": CONTEXTS, "by_seen": CONTEXTS, "low": LOW}  # contexts that each set of weights is for


def _gates(node: np.ndarray, seen: np.ndarray) -> tuple[tuple[np.ndarray, tuple[str, ...]], ...]:
    return (node, ("by_node", "low")), (seen, ("by_seen",))


def gate_sums(mixer: Mixer, history: np.ndarray, times: np.ndarray, sums: dict[str, np.ndarray]) -> None:
    """Add the slope and curvature of the gates' log likelihood over distinct histories, each met ``times`` times, to ``sums``.

    Per gate one row for the slope, then one for each context; each occurrence is judged by the counts of all others.
    """
    for lo in range(0, len(history), _SUMMED):
        bit, node, seen, x, many = mixer.inputs(history[lo:lo + _SUMMED], less=True)
        weight = np.repeat(times[lo:lo + _SUMMED], many).astype(np.float32)
        for gate, names in _gates(node, seen):
            order = np.argsort(gate, kind="stable")
            own, y, t = np.take(x, order, axis=1), bit[order], weight[order]
            edge = np.append(0, np.cumsum(np.bincount(gate)))
            for g in np.flatnonzero(np.diff(edge)):
                part = slice(edge[g], edge[g + 1])
                for name in names:
                    inputs = own[:GATES[name], part]
                    p = 1 / (1 + np.exp(-np.clip(getattr(mixer, name)[g] @ inputs, -60, 60)))
                    sums[name][g, 0] += inputs @ (t[part] * (y[part] - p))
                    sums[name][g, 1:] += (inputs * (t[part] * p * (1 - p))) @ inputs.T


def moved(weights: np.ndarray, sums: np.ndarray, prior: float) -> np.ndarray:
    """One Newton step of the gates' weights, held back as by ``prior`` decisions in favour of what they were.

    Rounded, since sums of floats differ in their last digits by the order of the tasks.
    """
    step = np.linalg.solve(sums[:, 1:] + prior * np.eye(weights.shape[1]), sums[:, 0, :, None])[..., 0]
    return np.round(weights + step, 4).astype(np.float32)


def numbered(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit numbers, ascending, and for each number its place among them.

    Places are looked up in hashed tables: of the numbers that share a slot one is found, the others go on to the next table.
    """
    ascending = np.sort(numbers)
    distinct = ascending[np.append(True, ascending[1:] != ascending[:-1])[:len(numbers)]]
    place = np.zeros(len(numbers), np.int32)
    left, at = np.arange(len(distinct), dtype=np.int32), slice(None)
    odd = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for factor in itertools.cycle(odd):
        shift = np.uint64(64 - max(int(len(left) * 2).bit_length(), 4))

        def hashed(x: np.ndarray, factor: np.uint64 = factor, shift: np.uint64 = shift) -> np.ndarray:
            x = x.view(np.uint64)
            return (((x ^ (x >> np.uint64(29))) * factor) >> shift).astype(np.int32)

        own = hashed(distinct[left])
        table = np.zeros(1 << (64 - int(shift)), np.int32)
        table[own] = left
        lost = table[own] != left
        mine = numbers[at]
        found = table[hashed(mine)]
        if not lost.any():
            place[at] = found
            break
        wrong = np.flatnonzero(distinct[found] != mine)
        place[at] = found
        at = wrong if isinstance(at, slice) else at[wrong]
        left = left[lost]
    return distinct, place


def segments(size: int) -> Iterator[tuple[int, int]]:
    """Start and size of the segments of a text of ``size`` bytes."""
    start = 0
    while start < size:
        own = min(max(start, SEGMENT), LONGEST)
        yield start, own
        start += own


class Probabilities:
    """What the mixers give to the bytes of histories, kept for the texts to come; at most ``HELD`` histories and those asked for last."""

    def __init__(self, mixer: Mixer):
        self.mixer, self.known, self.p = mixer, np.zeros(0, np.uint64), np.zeros((3, 0), np.float32)

    def of(self, distinct: np.ndarray) -> np.ndarray:
        """Probabilities of distinct histories in ascending order; those not yet known are mixed."""
        at = np.searchsorted(self.known, distinct)
        held = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        held[inside] = self.known[at[inside]] == distinct[inside]
        new = np.flatnonzero(~held)
        out = np.empty((3, len(distinct)), np.float32)
        held = np.flatnonzero(held)
        out[:, held] = self.p[:, at[held]]
        out[:, new] = np.exp(self.mixer.byte_probabilities(distinct[new]))
        if len(self.known) + len(new) <= HELD:
            self.known = np.insert(self.known, at[new], distinct[new])
            self.p = np.insert(self.p, at[new], out[:, new], axis=1)
        else:
            self.known, self.p = distinct, out
        return out


def text_scores(mixer: Mixer | Probabilities, history: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Natural log probability of each text, whose histories stand between the bounds ``off``.

    Distinct histories are mixed once, with ``Probabilities`` for all texts that it is used for. The texts are then read side by side in segments; a byte's probability is the mean of the
    mixers' by the text's weights, and after each segment a text's weights are the shares that each mixer has had so far.
    """
    texts = len(off) - 1
    distinct, place = numbered(history)
    p = (mixer if isinstance(mixer, Probabilities) else Probabilities(mixer)).of(distinct)
    total, sizes = np.zeros(texts), np.diff(off)
    share = np.tile(np.array([[0.6], [0.2], [0.2]], np.float32) * MEMORY, texts)
    for start, size in segments(int(sizes.max(initial=0))):
        now = np.flatnonzero(sizes > start)
        width = np.minimum(sizes[now] - start, size)
        edge = np.cumsum(width)
        first = edge - width
        at = place[np.repeat(off[now] + start - first, width) + np.arange(edge[-1])]
        weights = share[:, now] / (MEMORY + start)
        parts = [np.repeat(w, width) * q[at] for w, q in zip(weights, p)]
        both = parts[0] + parts[1] + parts[2]
        total[now] += np.add.reduceat(np.log(both), first, dtype=np.float64)
        for e, part in enumerate(parts):
            share[e, now] += np.add.reduceat(part / both, first)
    return total
