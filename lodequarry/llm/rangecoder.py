"""An adaptive range coder for token ids that mixes predictions of order 0, 1 and 2; one block is coded on its own.

The ids of a block are dealt into lanes, each a run of neighbouring ids; at every step all lanes code one id with the same model,
so that each operation works on a whole vector. All that the model knows it learnt from the ids coded before:
  - order 2: by the two ids before (hashed), all ids that followed at least twice, with their counts,
  - order 1: the same by the one id before,
  - order 0: the counts of all ids.
The mixture gives each order a share of the interval. The shares depend on a state, which is how much of what followed both contexts so far their
kept ids cover, and are the rates at which the orders were used in that state. An id that several orders offer is coded by the one that gives it most.
Shares and order 0 are renewed when the ids coded have doubled, from 1,024 on, then some 32,768 ids apart, and from 262,144 on when they have grown by an eighth;
orders 1 and 2 when they have grown eightfold. So the work stays in proportion to the ids.

The followers of a context divide a power of two of slots, so that a decoder finds an id by its slot and an encoder finds a pair by its hash: neither searches.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LQR3"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, alphabet, lanes, steps, crc32 of the ids, crc32 of what follows
_TOTAL = 26  # bits of the interval that is divided for one id
_LEAST = 1 << 20  # of it order 0 gets at least this
_FEWEST = 1 << 17  # and each other order this
_ID = 18  # bits of an id
_SLOTS = 12  # bits of the slots of a context, at most
_PART = 1 << 15  # ids whose intervals an encoder works out at a time
_U = np.uint64
_T = _U(_TOTAL)
_LOW32 = _U(1 << 32)
_32 = _U(32)
_GROWTH = 8  # orders 1 and 2 are learnt anew when the ids coded have grown by this
_SEEN = 2  # times a pair must have been coded to be offered
_HASHES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # odd


class CorruptBlock(ValueError):
    """A block whose checksum or shape is wrong."""


class _Finder:
    """Where each of many different keys stands, by three tables of hashes, each for the keys that met another one in the table before, and a search for the few left."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        for factor in _HASHES:
            if not len(left):
                break
            shift = _U(64 - max(4, (4 * len(left)).bit_length()))
            at = ((keys[left].view(_U) * _U(factor)) >> shift).view(np.int64)
            table = np.zeros(1 << 64 - int(shift), np.int32)  # a place << 1, and whether other keys had to go on from here
            table[at] = left << 1
            lost = table[at] >> 1 != left
            table[at[lost]] |= 1
            self.tables.append((_U(factor), shift, table))
            left = left[lost]
        self.left = left

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted keys are here, and where."""
        ask, hit, place = None, [], []
        for factor, shift, table in self.tables:
            got = table.take(((wanted.view(_U) * factor) >> shift).view(np.int64))
            at = got >> 1
            same = self.keys.take(at) == wanted
            yes, more = np.flatnonzero(same), np.flatnonzero((got & 1).astype(bool) & ~same)
            hit.append(yes if ask is None else ask[yes])
            place.append(at[yes])
            ask = more if ask is None else ask[more]
            wanted = wanted[more]
        if len(self.left) and len(wanted):
            at = self.left[np.minimum(np.searchsorted(self.keys[self.left], wanted), len(self.left) - 1)]
            yes = np.flatnonzero(self.keys[at] == wanted)
            hit.append(ask[yes])
            place.append(at[yes])
        return np.concatenate(hit), np.concatenate(place)


class _Followers:
    """The ids that followed each context, as sorted pairs context << _ID | id that divide the context's slots, and each context's level of 0 (unseen) to 7.

    Pairs coded less than _SEEN times are not kept, nor those too rare in a context of more than 2**_SLOTS ids to get a slot."""

    def __init__(self, contexts: int) -> None:
        self.contexts = contexts
        self.pair = np.empty(0, np.int64)
        self.level = np.zeros(contexts, np.uint8)
        self.first = np.zeros(contexts, np.int64)  # a context's first slot << 4 | bits of its slots
        self.part = np.empty(0, np.int64)  # of a pair: slots << 32 | first of them in its context << _ID | id

    def learn(self, keys: np.ndarray) -> None:
        """From the pairs coded so far, sorted."""
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        pair, count = keys[at], np.diff(np.append(at, len(keys)))
        context = pair >> _ID
        seen = np.bincount(context, count + 1, self.contexts).astype(np.int64)  # ids that followed, and different ones
        kept = count >= _SEEN
        pair, count, context = pair[kept], count[kept], context[kept]
        total = np.bincount(context, count, self.contexts).astype(np.int64)
        self.level = np.where(total > 0, 1 + np.minimum(6, total * 7 // np.maximum(seen, 1)), 0).astype(np.uint8)
        bits = np.minimum(np.frexp(np.maximum(total, 1) - 1)[1], _SLOTS).astype(np.int64)
        slots = np.where(total > 0, 1 << bits, 0)
        self.first = (np.cumsum(slots) - slots) << 4 | bits
        before = np.cumsum(count) - count - (np.cumsum(total) - total)[context]
        start, end = (before << bits[context]) // total[context], ((before + count) << bits[context]) // total[context]
        some = end > start
        self.pair = pair[some]
        self.part = (end - start)[some] << 32 | start[some] << _ID | self.pair & ((1 << _ID) - 1)


class _Model:
    """State common to both directions; everything in it follows from the rows of the grid (a step each) coded before."""

    def __init__(self, n: int, alphabet: int, grid: np.ndarray) -> None:
        self.alphabet, self.grid = alphabet, grid
        self.lanes = grid.shape[1]
        self.bits = max(18, alphabet.bit_length() + 2)
        if self.bits > 20:
            raise ValueError("ids must be below 2**18")
        self.pairs = min(17, max(8, n.bit_length() - 2))
        self.one, self.two = _Followers(alphabet), _Followers(1 << self.pairs)
        self.count = np.zeros(alphabet, np.int64)
        self.used = np.zeros((64, 3), np.float64)  # by state: coded by order 0, 1, 2
        self.learnt, self.next, self.version = 0, max(1 << 10, n >> 8), 0
        self._weigh()

    def until(self) -> int:
        """The row before which the model stays as it is."""
        coded = self.learnt * self.lanes
        return min(len(self.grid), self.learnt + max(1, max(min(32768, max(1024, coded)), coded >> 3) // self.lanes))

    def contexts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hashed pair of the id before and the one before that."""
        return ((b * 0x2C1B3C6D + a * 0x297A2D39) >> 11) & ((1 << self.pairs) - 1)

    def states(self, pair: np.ndarray, a: np.ndarray) -> np.ndarray:
        return (self.two.level.take(pair) << 3) + self.one.level.take(a)

    def before(self, start: int, end: int, back: int) -> np.ndarray:
        """Of rows start to end, the ids that many steps before; 0 before the first."""
        out = np.zeros((end - start, self.lanes), np.int64)
        skip = max(0, back - start)
        if skip < end - start:
            out[skip:] = self.grid[start + skip - back : end - back]
        return out.reshape(-1)

    def learn(self, end: int, used: np.ndarray) -> None:
        """Rows up to `end` are coded, the new ones so often in each state by each order."""
        self.count += 16 * np.bincount(self.grid[self.learnt : end].reshape(-1), minlength=self.alphabet)
        if self.count.sum() > 1 << 24:
            self.count >>= 1
        self.used += used.reshape(64, 3)
        self.learnt = end
        if end * self.lanes >= self.next and end < len(self.grid):
            self.next = _GROWTH * end * self.lanes
            ids, a = self.grid[:end].reshape(-1), self.before(0, end, 1)
            for followers, context in ((self.one, a), (self.two, self.contexts(a, self.before(0, end, 2)))):
                keys = context << _ID | ids
                keys.sort()
                followers.learn(keys)
            self.version += 1
            self.used *= 0.25  # the states mean something else now
        self._weigh()

    def _weigh(self) -> None:
        share = np.zeros(self.alphabet + 1, np.int64)
        np.cumsum(self.count, out=share[1:])
        if share[-1]:
            share = share * ((1 << self.bits) - self.alphabet) // share[-1]
        else:
            share = np.arange(self.alphabet + 1) * ((1 << self.bits) - self.alphabet) // self.alphabet
        self.below = share + np.arange(self.alphabet + 1)  # ids below each, of 1 << bits
        rate = (self.used + 0.4) / (self.used.sum(1, keepdims=True) + 1.2)
        room = (1 << _TOTAL) - _LEAST - 2 * _FEWEST
        shares = (rate[:, 1:] * room).astype(np.int64) + _FEWEST
        self.share1, self.share2 = shares[:, 0].copy(), shares[:, 1].copy()
        self.both = self.share1 + self.share2


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps: lanes grow with the block up to 4096, as long as each has some hundred ids."""
    lanes = min(4096, max(1, n // 256))
    steps = -(-n // lanes) if n else 0
    return (-(-n // steps), steps) if n else (1, 0)


def _intervals(model: _Model, start: int, end: int, finders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows start to end: where each id's interval begins, its size, and the state it is coded in, three times, plus the order."""
    ids, a = model.grid[start:end].reshape(-1).astype(np.int64), model.before(start, end, 1)
    pair = model.contexts(a, model.before(start, end, 2))
    state = model.states(pair, a).astype(np.int64)
    both = model.both.take(state)
    rest = (1 << _TOTAL) - both
    lo = (rest * model.below.take(ids)) >> model.bits
    size = ((rest * model.below.take(ids + 1)) >> model.bits) - lo
    lo += both
    order = state * 3
    for k, followers, finder, context in ((1, model.one, finders[0], a), (2, model.two, finders[1], pair)) if finders else ():
        hit, place = finder.find(context << _ID | ids)
        share2 = model.share2.take(state.take(hit))
        share = (model.share1.take(state.take(hit)) if k == 1 else share2) >> (followers.first.take(context.take(hit)) & 15)
        part = followers.part.take(place)
        much = share * (part >> 32)
        better = np.flatnonzero(much > size.take(hit))
        at = hit.take(better)
        begin = share.take(better) * (part.take(better) >> _ID & ((1 << _SLOTS) - 1))
        lo[at] = begin + share2.take(better) if k == 1 else begin
        size[at], order[at] = much.take(better), state.take(at) * 3 + k
    return lo.view(_U), size.view(_U), order


def encode(ids: np.ndarray) -> bytes:
    """A block of at most 2**31 ids below 2**18."""
    n = len(ids)
    lanes, steps = _shape(n)
    alphabet = int(ids.max()) + 1 if n else 1
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    model = _Model(n, alphabet, np.ascontiguousarray(grid.reshape(lanes, steps).T))
    finders, version = None, 0
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    words, used = np.zeros((steps + 2, lanes), _U), np.zeros(lanes, np.int64)
    rows = max(1, _PART // lanes)
    while model.learnt < steps:
        end, times = model.until(), np.zeros(192, np.int64)
        for start in range(model.learnt, end, rows):
            los, sizes, orders = _intervals(model, start, min(end, start + rows), finders)
            times += np.bincount(orders, minlength=192)
            for lo, size in zip(los.reshape(-1, lanes), sizes.reshape(-1, lanes)):
                unit = span >> _T
                new = low + unit * lo
                over = np.flatnonzero(new < low)
                if len(over):  # the carry; a word may hold more than 32 bits until the end
                    words[used[over] - 1, over] += _U(1)
                low, span = new, unit * size
                out = np.flatnonzero(span < _LOW32)
                if len(out):
                    first, at = low.take(out), used.take(out)
                    words[at, out] = first >> _32
                    used[out] = at + 1
                    low[out] = first << _32
                    span[out] = span.take(out) << _32
        model.learn(end, times)
        if model.version != version:
            version = model.version
            finders = [_Finder(followers.pair) if len(followers.pair) else None for followers in (model.one, model.two)]
            finders = finders if all(finders) else None
    lane = np.arange(lanes)
    words[used, lane], words[used + 1, lane] = low >> _32, low & _U(0xFFFFFFFF)
    used += 2
    words = words[: used.max()]
    while (big := words >= _LOW32).any():
        k, lane_of = np.nonzero(big)
        words[k, lane_of] -= _LOW32
        words[k - 1, lane_of] += _U(1)
    keep = np.arange(len(words)) < used[:, None]
    body = used.astype("<u4").tobytes() + words.astype("<u4").T[keep].tobytes()
    return _HEAD.pack(MAGIC, n, alphabet, lanes, steps, zlib.crc32(ids.astype("<u4")), zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers; CorruptBlock if anything is off."""
    if len(block) < _HEAD.size:
        raise CorruptBlock("a block ends within its head")
    magic, n, alphabet, lanes, steps, ids_crc, body_crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise CorruptBlock("a block's bytes were changed")
    if not n:
        return np.empty(0, "<u4")
    used = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(body, "<u4", offset=4 * lanes), 0).astype(_U)
    at_word = np.cumsum(used) - used
    grid = np.empty((steps, lanes), np.int32)
    model = _Model(n, alphabet, grid)
    span = np.full(lanes, (1 << 64) - 1, _U)
    code = (words[at_word] << _32) | words[at_word + 1]
    at_word = at_word + 2
    full, bits, top = 1 << _TOTAL, model.bits, (1 << _TOTAL) - 1
    mask, least = (1 << _ID) - 1, (1 << _SLOTS) - 1
    a = b = np.zeros(lanes, np.int64)
    row, lo, size = np.empty(lanes, np.int64), np.empty(lanes, np.int64), np.empty(lanes, np.int64)
    version, slots, first, part, twos = 0, np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), len(model.two.level)
    while model.learnt < steps:
        start, end, times = model.learnt, model.until(), np.zeros(192, np.int64)
        table = np.repeat(np.arange(alphabet, dtype=np.int32), np.diff(model.below))
        if model.version != version:  # contexts of order 2, then of order 1, and their slots
            version = model.version
            part = np.concatenate((model.two.part, model.one.part))
            slots = np.repeat(np.arange(len(part), dtype=np.int32), part >> 32)
            first = np.concatenate((model.two.first, model.one.first + (int((model.two.part >> 32).sum()) << 4)))
        for step in range(start, end):
            pair = model.contexts(a, b)
            state = model.states(pair, a)
            share2, both = model.share2.take(state), model.both.take(state)
            unit = span >> _T
            value = np.minimum((code // unit).view(np.int64), top)
            order = state * np.int16(3)
            plain = value >= both
            if len(k := np.flatnonzero(plain)):
                under = both.take(k)
                rest = full - under
                # quotients of integers below 2**53 this far from the next integer are exact as floats
                row[k] = found = table.take((((value.take(k) - under + 1 << bits) - 1) / rest).astype(np.int64), mode="clip")
                begin = (rest * model.below.take(found)) >> bits
                size[k] = ((rest * model.below.take(found + 1)) >> bits) - begin
                lo[k] = begin + under
            if len(k := np.flatnonzero(~plain)):
                if not len(slots):
                    raise CorruptBlock("a block uses a prediction that nothing made")
                goal, share = value.take(k), share2.take(k)
                two = goal < share
                under = np.where(two, 0, share)
                share = np.where(two, share, both.take(k) - share)
                begin = first.take(np.where(two, pair.take(k), a.take(k) + twos))
                share >>= begin & 15
                got = part.take(slots.take((begin >> 4) + ((goal - under) / share).astype(np.int64), mode="clip"))
                row[k] = got & mask
                lo[k] = under + share * (got >> _ID & least)
                size[k] = share * (got >> 32)
                order[k] += np.int16(1) + two
            code -= unit * lo.view(_U)
            span = unit * size.view(_U)
            more = np.flatnonzero(span < _LOW32)
            if len(more):
                at = at_word.take(more)
                code[more] = (code.take(more) << _32) | words.take(at)
                at_word[more] = at + 1
                span[more] = span.take(more) << _32
            grid[step] = row
            a, b = row.copy(), a
            times += np.bincount(order, minlength=192)
        model.learn(end, times)
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids) != ids_crc:
        raise CorruptBlock("a block does not give the ids it was made of")
    return ids
