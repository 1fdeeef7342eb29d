"""Context-mixing range coder over token ids, many blocks in step.

A block is coded on its own: its alphabet (the sorted distinct ids) stands in its header and the
model starts anew. The model predicts the next id three times and mixes the predictions:

* order 2: the id that last proved right after the two ids before, with a confidence;
* order 1: the same after the one id before;
* order 0: adaptive counts of all ids of the alphabet.

How often a prediction of a given confidence is right is learned in the block; that is its weight,
the order-0 counts share what is left. An id's interval is the sum of the three, so
``F(s) = unit * C0(s) + w1 * [p1 < s] + w2 * [p2 < s]`` with whole numbers throughout.

The blocks of a call are lanes of NumPy arrays: one step codes one id of every lane. Contexts learn
at every id; counts and weights take in what was coded every ``RENEW`` ids, so a step needs two
look-ups in the running sums of a lane. The coder is carry-less: 64-bit low and range, 16-bit words.
"""

from __future__ import annotations

import numpy as np

VERSION = 1
#: An interval is a share of 2**MASS. Ids of a block; lanes that go in step.
MASS, BLOCK, LANES = 28, 4096, 512
#: Count of one occurrence (an id of the alphabet starts at 1), slots of the order-2 table, ids between renewals.
#: All counts of a block add up to less than 2**16, and an id of its alphabet with a confidence fits 16 bits.
GAIN, SLOTS, RENEW = 14, 4096, 64
#: Largest weight of one prediction, of 65536: order 0 keeps at least 2**-10 of the mass.
SURE = 65536 - 2048
#: Weights by confidence before anything is learned, and for how many ids they count.
FIRST_WEIGHTS, FIRST_IDS = (0, 16000, 30000, 42000, 50000, 55000, 58000, 60000), 8

_LOWEST, _WORD = np.uint64(1 << 32), np.uint64(16)
_TOP, _MOST = np.uint64(48), np.uint64((1 << 48) - 1)


class _Model:
    """Predictions and counts of every lane."""

    def __init__(self, alphabets: np.ndarray):
        n, size = len(alphabets), int(alphabets.max(initial=1))
        self.lane, self.size = np.arange(n), size
        self.row = 1 << size.bit_length()  # more than the alphabet: the search ends at a huge sum
        self.counts = (np.arange(size) < alphabets[:, None]).astype(np.uint16)
        self.sums = np.full((n, self.row), 65535, np.uint16)
        self.after1 = np.zeros(n * size, np.uint16)  # predicted id * 8 + confidence
        self.after2 = np.zeros(n * SLOTS, np.uint16)
        first = np.array(FIRST_WEIGHTS, np.int64)
        self.tried = np.full((2, n, 8), FIRST_IDS, np.int64)
        self.hits = np.tile(first * FIRST_IDS, (2, n, 1)) >> 16
        self.rates = np.tile(first.astype(np.int32), (2, n, 1))
        self.last1, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.seen = np.zeros((2, RENEW, n), np.int64)  # confidence * 2 + whether it was right
        self.at = 0
        self.steps = 0
        self._renew(n)

    def _renew(self, a: int) -> None:
        """Take the ids coded since the last time into the counts and weights of the first ``a`` lanes."""
        lane, at = self.lane[:a], self.at
        if at:
            for order in (0, 1):
                found = (lane * 16 + self.seen[order, :at, :a]).ravel()
                wrong, right = np.bincount(found, minlength=a * 16).reshape(a, 8, 2).transpose(2, 0, 1)
                self.tried[order, :a] += wrong + right
                self.hits[order, :a] += right
            rates = (self.hits[:, :a] << 16) // self.tried[:, :a]
            rates[:, :, 0] = 0  # nothing was predicted
            self.rates[:, :a] = np.minimum(rates, SURE)
        sums = self.sums[:a, 1 : self.size + 1]
        np.cumsum(self.counts[:a], axis=1, out=sums)
        self.sums[:a, 0] = 0
        self.total = self.sums[:, self.size].astype(np.int32)
        self.at = 0

    def predict(self, a: int) -> None:
        """For the first ``a`` lanes: both predicted ids, their weights and the unit of an order-0 count."""
        lane, last1, last2 = self.lane[:a], self.last1[:a], self.last2[:a]
        self.at1 = lane * self.size + last1
        self.at2 = lane * SLOTS + ((last1 * 40503 + last2 * 25717 + (last2 >> 3)) & (SLOTS - 1))
        self.entry1, self.entry2 = self.after1[self.at1].astype(np.int32), self.after2[self.at2].astype(np.int32)
        self.sure1, self.sure2 = self.entry1 & 7, self.entry2 & 7
        self.id1, self.id2 = self.entry1 >> 3, self.entry2 >> 3
        flat = self.rates.reshape(2, -1)
        self.w2 = flat[1][lane * 8 + self.sure2] << (MASS - 16)
        left = (1 << MASS) - self.w2
        self.w1 = (left >> 16) * flat[0][lane * 8 + self.sure1]
        self.unit = (left - self.w1) // self.total[:a]

    def interval(self, a: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of each lane's id."""
        at, sums = self.lane[:a] * self.row + s, self.sums.reshape(-1)
        low = sums[at].astype(np.int32)
        begin = self.unit * low + self.w1 * (self.id1 < s) + self.w2 * (self.id2 < s)
        width = self.unit * (sums[at + 1] - low) + self.w1 * (self.id1 == s) + self.w2 * (self.id2 == s)
        return begin, width

    def find(self, a: int, v: np.ndarray) -> np.ndarray:
        """The id whose interval holds ``v``."""
        sums, rows = self.sums.reshape(-1), self.lane[:a] * self.row
        v = np.minimum(v, self.unit * self.total[:a] + self.w1 + self.w2 - 1)  # only a damaged block goes beyond
        low_first = self.id1 <= self.id2
        near, far = np.where(low_first, self.id1, self.id2), np.where(low_first, self.id2, self.id1)
        w_near, w_far = np.where(low_first, self.w1, self.w2), np.where(low_first, self.w2, self.w1)
        begin = self.unit * sums[rows + near]
        passed = v >= begin  # at or behind the nearer prediction
        in_near = passed & (v < self.unit * sums[rows + near + 1] + w_near + w_far * (near == far))
        begin_far = self.unit * sums[rows + far] + w_near
        passed_far = passed & (v >= begin_far)
        in_far = passed_far & (v < self.unit * sums[rows + far + 1] + w_near + w_far) & ~in_near
        s = np.where(in_far, far, near)
        rest = np.flatnonzero(~(in_near | in_far))  # these follow from the counts alone
        if len(rest):
            x = (v - w_near * passed - w_far * passed_far)[rest] // self.unit[rest]
            place = rows[rest]
            step = self.row >> 1
            while step:
                ahead = place + step
                place = np.where(sums[ahead] <= x, ahead, place)
                step >>= 1
            s[rest] = place - rows[rest]
        return s

    def update(self, a: int, s: np.ndarray) -> None:
        at = self.at
        self.counts.reshape(-1)[self.lane[:a] * self.size + s] += GAIN
        for order, (after, place, entry, sure, known) in enumerate((
            (self.after1, self.at1, self.entry1, self.sure1, self.id1),
            (self.after2, self.at2, self.entry2, self.sure2, self.id2),
        )):
            hit = (known == s) & (sure > 0)
            self.seen[order, at, :a] = 2 * sure + hit
            weaker = np.where(sure <= 1, (s << 3) | 1, (entry - sure) | (sure >> 1))
            after[place] = np.where(hit, entry + (sure < 7), weaker)
        self.last2[:a], self.last1[:a] = self.last1[:a], s
        self.at, self.steps = at + 1, self.steps + 1
        if self.at == RENEW or self.steps in (8, 16, 32):
            self._renew(a)


def _settle(low, span, emit) -> None:
    """Move out the words that are decided: both ends share them, or the range became too small."""
    lanes, l, r = None, low, span
    while True:
        same = ((l ^ (l + r - np.uint64(1))) >> _TOP) == 0
        out = np.flatnonzero(same | (r < _LOWEST))
        if not len(out):
            return
        lanes = out if lanes is None else lanes[out]
        l, r, cut = l[out], r[out], ~same[out]
        if cut.any():  # ends differ: keep the part below the next multiple of 2**32
            r[cut] = (np.uint64(0) - l[cut]) & (_LOWEST - np.uint64(1))
        emit(lanes, l)
        l, r = l << _WORD, np.minimum(r, _MOST) << _WORD
        low[lanes], span[lanes] = l, r


def _steps(lengths: np.ndarray):
    """(step, lanes that still have an id); lanes are in descending order of length."""
    for t in range(int(lengths.max(initial=0))):
        yield t, int(np.searchsorted(-lengths, -t, side="left"))


def _varints(values: np.ndarray) -> bytes:
    values = values.astype(np.uint32)
    more = [values >= 1 << 7 * (i + 1) for i in range(4)]
    sizes = 1 + sum(m.astype(np.int64) for m in more)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(5):
        has = sizes > i
        part = (values[has] >> np.uint32(7 * i)) & np.uint32(127)
        out[(ends - sizes)[has] + i] = part | np.where(sizes[has] > i + 1, 128, 0)
    return out.tobytes()


def _read_varints(raw: bytes, count: int, at: int) -> tuple[np.ndarray, int]:
    if not count:
        return np.zeros(0, np.int64), at
    some = np.frombuffer(raw, np.uint8, min(5 * count, len(raw) - at), at)
    ends = np.flatnonzero(some < 128)[:count]
    if len(ends) < count:
        raise ValueError("damaged block: header ends early")
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((some[: ends[-1] + 1].astype(np.int64) & 127) << (7 * np.minimum(place, 8)), starts)
    return values, at + int(ends[-1]) + 1


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """One payload per block of ids (at most ``BLOCK`` ids of 0 to 2**32 - 1 each)."""
    payloads: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for start in range(0, len(order), LANES):
        lanes = order[start : start + LANES]
        lengths = np.array([len(blocks[i]) for i in lanes])
        alphabets, symbols = [], np.zeros((int(lengths.max(initial=0)), len(lanes)), np.int32)
        for lane, i in enumerate(lanes):
            alphabet, symbols[: lengths[lane], lane] = np.unique(blocks[i], return_inverse=True)
            alphabets.append(alphabet.astype(np.int64))
        model = _Model(np.array([len(x) for x in alphabets]))
        low, span = np.zeros(len(lanes), np.uint64), np.full(len(lanes), (1 << 64) - 1, np.uint64)
        words, count = np.zeros((len(lanes), 4 * len(symbols) + 8), "<u2"), np.zeros(len(lanes), np.int64)

        def emit(out, l):
            words[out, count[out]] = l >> _TOP
            count[out] += 1

        for t, a in _steps(lengths):
            model.predict(a)
            begin, width = model.interval(a, symbols[t, :a])
            r = span[:a] >> np.uint64(MASS)
            low[:a] += r * begin.astype(np.uint64)
            span[:a] = r * width.astype(np.uint64)
            _settle(low[:a], span[:a], emit)
            model.update(a, symbols[t, :a])
        for _ in range(4):
            emit(np.arange(len(lanes)), low)
            low <<= _WORD
        for lane, i in enumerate(lanes):
            head = _varints(np.r_[lengths[lane], len(alphabets[lane]), np.diff(alphabets[lane], prepend=0)])
            payloads[i] = bytes([VERSION]) + head + words[lane, : count[lane]].tobytes()
    return payloads


def decode(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of every payload, as uint32. Damage shows as a ValueError or as other ids: compare checksums."""
    blocks: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    heads = []
    for raw in payloads:
        if raw[:1] != bytes([VERSION]):
            raise ValueError("damaged block: unknown version")
        (length, size), at = _read_varints(raw, 2, 1)
        if length > BLOCK or size > length:
            raise ValueError("damaged block: impossible header")
        deltas, at = _read_varints(raw, int(size), at)
        heads.append((int(length), np.cumsum(deltas), at))
    order = sorted(range(len(payloads)), key=lambda i: -heads[i][0])
    for start in range(0, len(order), LANES):
        lanes = order[start : start + LANES]
        lengths = np.array([heads[i][0] for i in lanes])
        bodies = [np.frombuffer(payloads[i][heads[i][2] :][: (len(payloads[i]) - heads[i][2]) // 2 * 2], "<u2") for i in lanes]
        words = np.zeros((len(lanes), max(map(len, bodies)) + 4), np.uint64)  # a damaged block reads zeros beyond its end
        for lane, body in enumerate(bodies):
            words[lane, : len(body)] = body
        model = _Model(np.array([max(1, len(heads[i][1])) for i in lanes]))
        low, span = np.zeros(len(lanes), np.uint64), np.full(len(lanes), (1 << 64) - 1, np.uint64)
        code, count = np.zeros(len(lanes), np.uint64), np.zeros(len(lanes), np.int64)
        last = words.shape[1] - 1

        def take(out, _):
            code[out] = (code[out] << _WORD) | words[out, np.minimum(count[out], last)]
            count[out] += 1

        for _ in range(4):
            take(np.arange(len(lanes)), None)
        symbols = np.zeros((int(lengths.max(initial=0)), len(lanes)), np.int32)
        for t, a in _steps(lengths):
            model.predict(a)
            r = span[:a] >> np.uint64(MASS)
            v = np.minimum((code[:a] - low[:a]) // r, np.uint64((1 << MASS) - 1)).astype(np.int32)
            s = model.find(a, v)
            begin, width = model.interval(a, s)
            low[:a] += r * begin.astype(np.uint64)
            span[:a] = r * np.maximum(width, 1).astype(np.uint64)
            _settle(low[:a], span[:a], take)
            symbols[t, :a] = s
            model.update(a, symbols[t, :a])
        for lane, i in enumerate(lanes):
            alphabet = heads[i][1]
            if lengths[lane]:
                blocks[i] = alphabet[np.minimum(symbols[: lengths[lane], lane], len(alphabet) - 1)].astype(np.uint32)
    return blocks
