"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

A document is contaminated if a stretch of it lies within an edit distance of ``1 - similarity`` of a
benchmark item's length from the item. Both are compared in lower case (A-Z), with one space between words;
distances count code points.

1. Windows open at every place where an occurrence can be. An item with at most k edits, cut into k // 2 + 1
   pieces, has a piece with one edit at most, and around it two or three successive pieces (a of them)
   with 2a - 1 edits at most. Deleting a character from a piece and one from the text gives equal strings,
   so pieces are looked up at every place of a document; their groups are checked by Myers' search over
   many places at once. A window is as long as its item and lies as the piece lies in the item.
2. CGK: a random walk reads the window from the piece on, another one from the piece back; step j writes the
   character at the pointer and moves the pointer on by a random bit of (j, character). Few edits leave
   most of the written string as it is: edit distance becomes Hamming distance.
3. Bit sampling: each of ``REPEATS`` keys takes ``BITS`` places of the written string. A window goes on if
   it shares a key with its item's string. Strings that agree in a share p of the places do so with
   probability 1 - (1 - p^BITS)^REPEATS, 0.99 at p = 0.45; an occurrence has a window for each of its pieces
   that is good enough, so it is missed only if all of them are. What shares no key is not lost either: it
   goes on if the next larger group of pieces (three to five) is close enough, which an occurrence within
   the distance grants.
4. Windows of a document and an item that overlap are joined, and each stretch is verified by the bit-parallel
   (Myers) search of the whole item; ``distance`` is the least of them.

So every stretch within the distance is found, wherever it begins, in any script. The benchmark is a stated
query set; it is read in blocks of at most ``block_bytes``, each sent to every task, and the documents are
never shuffled. Every document is read whole, long ones in overlapping slices.

Edge cases: null and empty texts are clean; items shorter than ``least`` code points are evidence only where
they stand whole and letter for letter, not inside a longer word (scripts without spaces have no such
bounds); null items and those of one code point are none. Repeated items and rows give equal answers;
null ids are allowed, extra columns pass through ``clean``; an empty table or benchmark finds nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys of a window, and the places that a key takes.
REPEATS, BITS = 64, 3
#: The longest part of a piece that is looked up, and text that is searched at once, in bytes.
LONGEST, SLICE = 9, 4 << 20
#: Lower case, and one kind of space.
PLAIN = np.where(common.SPACE, 0x20, common.LOWER).astype(np.uint8)
#: Scripts without spaces between words: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in lower case with a space behind each: their bytes, and the n + 1 starts of the rows."""
    if not len(data):
        return data, offsets
    solid = ~common.SPACE.take(data)
    keep = np.empty(len(data), bool)
    keep[0] = False
    keep[1:] = solid[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = False  # nothing stands before a row's first byte
    keep |= solid
    at = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
    out = PLAIN.take(data)[keep]
    open_ = (np.diff(offsets) > 0) & solid[np.maximum(offsets[1:] - 1, 0)]
    return np.insert(out, at[1:][open_], 0x20), at + np.concatenate([[0], np.cumsum(open_)])


def points(data: np.ndarray, rows: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The rows of normal() as one string, its code points, and the n + 1 starts of the rows in it."""
    try:
        text = data.tobytes().decode()
        starts = rows if len(text) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[rows]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(rows[:-1], rows[1:], strict=True)]
        text, starts = "".join(parts), np.cumsum([0, *map(len, parts)])
    return text, data if len(text) == len(data) else np.frombuffer(text.encode("utf-32-le"), np.uint32), starts


def slices(data: np.ndarray, rows: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """Parts of normal()'s rows: bytes, starts, the first row's number, and whether it begins inside that row. A row longer than ``SLICE`` comes in parts that overlap."""
    at = 0
    while at < len(rows) - 1:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + SLICE, "right")) - 1)
        begin, end = int(rows[at]), int(rows[to])
        if end - begin <= SLICE + 2 * overlap:
            yield data[begin:end], rows[at : to + 1] - begin, at, False
        else:
            inside = False
            while begin < end:
                stop = min(end, begin + SLICE)
                while stop < end and data[stop] & 0xC0 == 0x80:
                    stop += 1
                yield data[begin:stop], np.array([0, stop - begin]), at, inside
                if stop == end:
                    break
                begin, inside = stop - overlap, True
                while data[begin] & 0xC0 == 0x80:
                    begin -= 1
        at = to


# ---------------------------------------------------------------- CGK embedding and bit sampling


def walk(classes: np.ndarray, at: np.ndarray, sizes: np.ndarray, stop: np.ndarray, way: int, steps: int) -> np.ndarray:
    """CGK strings (steps x windows) of classes from ``at`` on, forward (way 1) or back (-1), over ``sizes`` characters, to ``stop`` at most."""
    turn = np.random.default_rng(2 + way).integers(0, 2, (steps, 256), np.uint8)
    turn[:, 0] = 0
    turn = turn.astype(np.int64) * way
    out = np.empty((steps, len(at)), np.uint8)
    end = np.minimum(at + sizes, stop) if way > 0 else np.maximum(at - sizes, stop)
    now = at.copy()
    for j in range(steps):
        c = classes.take(now, mode="clip", out=out[j])
        c *= now < end if way > 0 else now > end
        now += turn[j].take(c)
    return out


def agreed(mine: list[np.ndarray], theirs: list[np.ndarray], sizes: list[np.ndarray], repeats: int = REPEATS, bits: int = BITS) -> np.ndarray:
    """Whether each window shares a key with its item: strings forward and back, over 2 * sizes steps each."""
    n = len(sizes[0])
    share = np.random.default_rng(77).random((repeats, bits))
    found, column = np.zeros(n, bool), np.arange(n)
    total = 2 * (sizes[0] + sizes[1])
    for r in range(repeats):
        keys = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
        for u in share[r]:
            place = (u * total).astype(np.int64)
            back = place >= 2 * sizes[0]
            place[back] -= 2 * sizes[0][back]
            for key, strings in zip(keys, (mine, theirs), strict=True):
                c = np.where(back, strings[1][np.minimum(place, len(strings[1]) - 1), column], strings[0][np.minimum(place, len(strings[0]) - 1), column])
                key *= np.uint64(257)
                key += c
        found |= keys[0] == keys[1]
    return found


# ---------------------------------------------------------------- exact edit search


def distance_within(item: str, text: str, most: int) -> int | None:
    """The least edit distance of item from a stretch of text, if at most ``most``: Myers' bit-parallel search."""
    m = len(item)
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        ph = (minus | ~(d0 | plus)) & full
        mh = plus & d0
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best = score
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = (mh | ~(d0 | ph)) & full, ph & d0
    return best if best <= most else None


def apart(left: str, right: str) -> bool:
    """Whether a word may end between two neighbours."""
    return not (left.isalnum() and right.isalnum()) or bool(UNSPACED.match(left) or UNSPACED.match(right))


def spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers low[i] .. low[i] + n[i] - 1 of successive i."""
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


class Keys:
    """Values by 32-bit keys: a table of bits spares most look-ups, a table of the upper bits begins the others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
        self.keys, self.values = keys[new], values[new]
        bits = min(27, max(18, int(32 * len(self.keys)).bit_length()))
        self.shift = np.uint32(32 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[self.keys >> self.shift] = True
        self.seen = np.packbits(seen, bitorder="little")
        bits = min(24, max(10, int(2 * len(self.keys)).bit_length()))
        self.coarse = np.uint32(32 - bits)
        self.head = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.int64)
        self.head = np.append(self.head, len(self.keys))

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """A bit each: 0 where a key is certainly none of these."""
        at = keys >> self.shift
        got = self.seen.take((at >> np.uint32(3)).astype(np.int64), mode="wrap")
        got >>= at.astype(np.uint8) & np.uint8(7)
        got &= np.uint8(1)
        return got

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of keys, and the values that they have."""
        top = (keys >> self.coarse).astype(np.int64)
        low = self.head[top]
        n = self.head[top + 1] - low
        which, at = np.repeat(np.arange(len(keys)), n), spread(low, n)
        good = self.keys[at] == keys[which]
        return which[good], self.values[at[good]]


class Groups:
    """Successive pieces of items, as bit masks of at most 64 characters for Myers' search. Longer groups hold everywhere (their pieces are long, so few places come)."""

    def __init__(self, classes: np.ndarray, begin: np.ndarray, size: np.ndarray, budget: np.ndarray):
        self.free = size > 64
        size = np.where(self.free, 1, size)
        kind = np.uint32 if size.max(initial=1) <= 32 else np.uint64
        self.size, self.budget = size, budget
        at = spread(begin, size)
        group = np.repeat(np.arange(len(size)), size)
        # a mask's top bit is its group's last character; the bits below the first match anything, so a match may begin anywhere
        self.width = kind(0).nbytes * 8
        self.below = ((np.uint64(1) << (self.width - size).astype(np.uint64)) - np.uint64(1)).astype(kind)
        self.masks = np.repeat(self.below, 64)
        np.bitwise_or.at(self.masks, group * 64 + classes[at], (np.uint64(1) << (at - begin[group] + self.width - size[group]).astype(np.uint64)).astype(kind))

    def close(self, classes: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether a stretch of the text around ``at`` (where the group begins) lies within the group's distance of it: Myers' search, many pairs at once."""
        out = np.empty(len(at), bool)
        kind = self.masks.dtype.type
        signed, one, last = np.dtype(f"i{kind(0).nbytes}"), kind(1), self.width - 1
        for j in range(0, len(at), 8192):
            g = group[j : j + 8192]
            size, most = self.size[g], self.budget[g]
            steps = int((size + 2 * most).max())
            begin = np.clip(at[j : j + 8192] - most, 0, len(classes) - steps)
            text = np.ascontiguousarray(sliding_window_view(classes, steps)[begin].T)
            base = g * 64
            minus = np.zeros(len(g), kind)
            plus = ~self.below[g]
            score, best = size.astype(signed), size.astype(signed)
            eq, d0, ph, mh, t = (np.empty(len(g), kind) for _ in range(5))
            place, sign, early = np.empty(len(g), np.int64), t.view(signed), int((size - most).min()) - 1
            for k in range(steps):
                np.add(base, text[k], out=place)
                self.masks.take(place, mode="wrap", out=eq)
                np.bitwise_and(eq, plus, out=d0)
                np.add(d0, plus, out=d0)
                np.bitwise_xor(d0, plus, out=d0)
                np.bitwise_or(d0, eq, out=d0)
                np.bitwise_or(d0, minus, out=d0)
                np.bitwise_or(d0, plus, out=t)
                np.invert(t, out=t)
                np.bitwise_or(minus, t, out=ph)
                np.bitwise_and(plus, d0, out=mh)
                # the top bits: one more, or one less
                np.right_shift(ph.view(signed), last, out=sign)
                np.subtract(score, sign, out=score)
                np.right_shift(mh.view(signed), last, out=sign)
                np.add(score, sign, out=score)
                if k >= early:
                    np.minimum(best, score, out=best)
                np.left_shift(ph, one, out=ph)
                np.left_shift(mh, one, out=mh)
                np.bitwise_or(d0, ph, out=t)
                np.invert(t, out=t)
                np.bitwise_or(mh, t, out=plus)
                np.bitwise_and(ph, d0, out=minus)
            out[j : j + 8192] = (best <= most) | self.free[g]
        return out


class Index:
    """A block of items; those below ``least`` code points are only searched as they are."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, least: int = 0):
        self.ids, self.similarity = [i for i, _ in items], similarity
        data, rows = normal(*common.flat_text(pa.array([t for _, t in items], pa.string())))
        self.texts = [data[a : max(a, b - 1)].tobytes().decode("utf-8", "replace") for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.most = [int((1 - similarity) * len(t) + 1e-9) for t in self.texts]
        self.grams: dict[int, list] = {}
        whole = "".join(self.texts)
        known = np.array(sorted(set(whole)), dtype="U1").view(np.uint32) if whole else np.zeros(0, np.uint32)
        self.number = np.zeros(0x110000, np.uint16 if len(known) < 1 << 16 else np.uint32)
        self.number[known] = np.arange(1, len(known) + 1)
        #: 64 classes of characters: of the items' own, and 0 for all others and between rows
        self.kind = np.concatenate([[0], 1 + np.arange(len(known)) % 63]).astype(np.uint8)
        own = self.number[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        self.own, first = self.kind[own], np.cumsum([0, *map(len, self.texts)])
        self.first = first
        rng = np.random.default_rng(99)
        self.power = rng.integers(0, 1 << 32, max([LONGEST, *(len(t) for t in self.texts if len(t) < least)]) + 1, np.uint64).astype(np.uint32) | np.uint32(1)
        pieces, inner, outer = [], [], []
        for k, t in enumerate(self.texts):
            if not t or len(t) < least:
                continue
            p = self.most[k] // 2 + 1
            cuts = [j * len(t) // p for j in range(p + 1)]
            size = min(LONGEST, len(t) // p)
            # groups of three to five pieces, in them groups of two or three
            for big in np.array_split(np.arange(p), -(-p // 5)):
                outer.append((first[k] + cuts[big[0]], cuts[big[-1] + 1] - cuts[big[0]], 2 * len(big) - 1))
                for small in np.array_split(big, max(1, len(big) // 2)):
                    inner.append((first[k] + cuts[small[0]], cuts[small[-1] + 1] - cuts[small[0]], 2 * len(small) - 1))
                    pieces += [(k, cuts[j], size, len(inner) - 1, cuts[j] - cuts[small[0]], len(outer) - 1, cuts[j] - cuts[big[0]]) for j in small.tolist()]
        self.piece = np.array(pieces, np.int64).reshape(-1, 7)
        self.groups = [Groups(self.own, *np.array(x, np.int64).reshape(-1, 3).T) for x in (inner, outer)]
        self.tables = {}
        for size in np.unique(self.piece[:, 2]).tolist():
            mine = np.flatnonzero(self.piece[:, 2] == size)
            part = own[(first[self.piece[mine, 0]] + self.piece[mine, 1])[:, None] + np.arange(size)].astype(np.uint32)
            keys = np.stack([(np.delete(part, d, 1) * self.power[: size - 1]).sum(1, dtype=np.uint32) for d in range(size)])
            self.tables[size] = Keys(keys.ravel(), np.tile(mine, size))
        equal: dict[int, list[int]] = {}
        for k, t in enumerate(self.texts):
            if 1 < len(t) < least:
                equal.setdefault(len(t), []).append(k)
        self.equal = {}
        for size, some in equal.items():
            part = own[first[some][:, None] + np.arange(size)].astype(np.uint32)
            self.equal[size] = Keys((part * self.power[:size]).sum(1, dtype=np.uint32), np.array(some, np.int64))
        self.reach = max([0, *(len(t) + 2 * m for t, m in zip(self.texts, self.most, strict=True))])

    def opened(self, code: np.ndarray, classes: np.ndarray, front: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, pieces) of windows: a piece with one edit at most, in a group of pieces that is close enough. ``classes`` are those of ``code`` behind ``front`` empty places."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def near() -> tuple[np.ndarray, np.ndarray]:
            place, piece = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            good = self.groups[0].close(classes, front + place - self.piece[piece, 4], self.piece[piece, 3])
            return place[good], piece[good]

        step = 1 << 14
        for size, table in self.tables.items():
            power = self.power[: size - 1]
            for a in range(0, len(code), step):
                n = min(step, len(code) - a)
                part = np.zeros(n + size + 1, np.uint32)
                own = code[a : a + n + size + 1]
                part[: len(own)] = own
                change = part[:-1] - part[1:]
                key, t, any_ = np.zeros(n, np.uint32), np.empty(n, np.uint32), np.zeros(n, np.uint8)
                for j in range(size - 1):
                    np.multiply(part[j + 1 : j + 1 + n], power[j], out=t)
                    key += t
                first = key.copy()
                for j in range(size):
                    any_ |= table.maybe(key)
                    if j < size - 1:
                        np.multiply(change[j : j + n], power[j], out=t)
                        key += t
                some = np.flatnonzero(any_)
                if not len(some):
                    continue
                # the keys of the few places that may have one: a row for each deleted character
                keys = np.empty((size, len(some)), np.uint32)
                keys[0] = first[some]
                for j in range(size - 1):
                    np.multiply(change[some + j], power[j], out=keys[j + 1])
                np.cumsum(keys, axis=0, dtype=np.uint32, out=keys)
                hit = np.flatnonzero(table.maybe(keys.ravel()))
                which, piece = table.pairs(keys.ravel()[hit])
                both = np.sort(some[hit[which] % len(some)] * len(self.piece) + piece)
                if len(both):
                    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
                    held.append((a + both // len(self.piece), both % len(self.piece)))
                    if sum(len(x) for x, _ in held) >= 8192:
                        yield near()
        if held:
            yield near()

    def equals(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, items) of equal short items."""
        most = max(self.equal, default=0)
        for a in range(0, len(code) if most else 0, 1 << 16):
            n = min(1 << 16, len(code) - a)
            part = np.zeros(n + most, np.uint32)
            own = code[a : a + n + most]
            part[: len(own)] = own
            key = np.zeros(n, np.uint32)
            for j in range(most):
                key += part[j : j + n] * self.power[j]
                if j + 1 in self.equal:
                    at = np.flatnonzero(self.equal[j + 1].maybe(key))
                    which, item = self.equal[j + 1].pairs(key[at])
                    yield a + at[which], item

    def shares_key(self, classes: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether windows share a key with their items: ``at`` are the pieces' places in classes, ``low`` and ``high`` their rows' bounds."""
        item, cut = self.piece[piece, 0], self.piece[piece, 1]
        sizes = [self.first[item + 1] - self.first[item] - cut, cut]
        begin = self.first[item] + cut
        steps = [max(1, 2 * int(s.max())) for s in sizes]
        mine = [walk(classes, at, sizes[0], high, 1, steps[0]), walk(classes, at - 1, sizes[1], low - 1, -1, steps[1])]
        theirs = [walk(self.own, begin, sizes[0], self.first[item + 1], 1, steps[0]), walk(self.own, begin - 1, sizes[1], self.first[item] - 1, -1, steps[1])]
        return agreed(mine, theirs, sizes)

    def search(self, text: pa.Array) -> list[list[tuple[int, int]]]:
        """(number of the item, least distance) of each row's contaminations."""
        out: list[dict[int, int]] = [{} for _ in range(len(text))]
        for data, rows, base, inside in slices(*normal(*common.flat_text(text)), 8 * self.reach):
            for r, k, d in self._search(*points(data, rows), inside):
                out[base + r][k] = min(d, out[base + r].get(k, d))
        return [sorted(row.items()) for row in out]

    def _search(self, text: str, code: np.ndarray, starts: np.ndarray, inside: bool) -> Iterator[tuple[int, int, int]]:
        code = self.number.take(code)
        code[starts[1:][starts[1:] > starts[:-1]] - 1] = 0
        for place, item in self.equals(code):
            row = np.searchsorted(starts, place, "right") - 1
            for r, k, at in zip(row.tolist(), item.tolist(), place.tolist(), strict=True):
                t = self.texts[k]
                end = at + len(t)
                if text.startswith(t, at) and end < starts[r + 1] and (not inside if at == starts[r] else apart(text[at - 1], t[0])) and apart(t[-1], text[end]):
                    yield r, k, 0
        if not self.tables:
            return
        front = 512
        classes = np.zeros(len(code) + 2 * front, np.uint8)
        self.kind.take(code, out=classes[front : front + len(code)], mode="wrap")
        opened = [x for x in self.opened(code, classes, front) if len(x[0])]
        if not opened:
            return
        place, piece = (np.concatenate(x) for x in zip(*opened, strict=True))
        # windows of like sizes meet in a batch
        order = np.argsort(self.piece[piece, 1], kind="stable")
        found = []
        for j in range(0, len(order), 4096):
            p, q = place[order[j : j + 4096]], piece[order[j : j + 4096]]
            r = np.searchsorted(starts, p, "right") - 1
            good = self.shares_key(classes, front + starts[r], front + starts[r + 1], front + p, q)
            rest = np.flatnonzero(~good)
            good[rest] = self.groups[1].close(classes, front + p[rest] - self.piece[q[rest], 6], self.piece[q[rest], 5])
            found.append((r[good], self.piece[q[good], 0], p[good] - self.piece[q[good], 1]))
        row, item, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, item, row))
        held: list[int] = []  # row, item, first and last place of the stretch
        for r, k, a in [*zip(row[order].tolist(), item[order].tolist(), begin[order].tolist(), strict=True), (-1, -1, 0)]:
            if held and (held[0], held[1]) == (r, k) and a - self.most[k] <= held[3]:
                held[3] = a + len(self.texts[k]) + self.most[k]
                continue
            if held:
                r0, k0, x, y = held
                d = self.check(k0, text[max(int(starts[r0]), x) : max(0, min(int(starts[r0 + 1]) - 1, y))])
                if d is not None:
                    yield r0, k0, d
            held = [r, k, a - self.most[k], a + len(self.texts[k]) + self.most[k]]

    def check(self, k: int, near: str) -> int | None:
        """The least distance of the item from a part of the stretch, if it is low enough."""
        if k not in self.grams:
            t = self.texts[k]
            self.grams[k] = [[t[j : j + q] for j in range(len(t) - q + 1)] for q in (4, 3)]
        # an edit spoils q of the item's q-character strings at most: too few left, and the search can't succeed
        if any(sum(map({near[j : j + q] for j in range(len(near) - q + 1)}.__contains__, g)) < len(g) - q * self.most[k] for q, g in zip((4, 3), self.grams[k], strict=True)):
            return None
        return distance_within(self.texts[k], near, self.most[k])


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, each brought to the driver on its own."""
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where(F.length("t") > 1)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = [(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()]
        if got:
            yield got


def _mapped(docs: DataFrame, items: list[tuple[int, str]], similarity: float, least: int, run, schema) -> DataFrame:
    spark = docs.sparkSession
    common.ship(spark)
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def mapped(batches):
        index = common.latest("cgk", name, lambda: Index(sent.value, similarity, least))
        yield from run(index, batches)

    return docs.mapInArrow(common.tidy(mapped), schema)


def contaminated(docs: DataFrame, items: DataFrame, *, similarity: float = 0.8, least: int = 24, block_bytes: int = 4 << 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance) of every item found in a document."""
    source = docs.select("doc_id", "text")
    schema = source.drop("text").schema.add("item_id", "long").add("distance", "integer")

    def run(index, batches):
        for block in common.blocks(batches):
            hits = [(r, index.ids[k], d) for r, row in enumerate(index.search(block.column(1))) for k, d in row]
            if hits:
                r, i, d = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(r)), pa.array(i, pa.int64()), pa.array(d, pa.int32())], names=["doc_id", "item_id", "distance"])

    out = None
    for part in _blocks(items, item_id, item_text, block_bytes):
        got = _mapped(source, part, similarity, least, run, schema)
        out = got if out is None else out.union(got)
    return out if out is not None else source.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("int").alias("distance")).where("false")


def clean(docs: DataFrame, items: DataFrame, *, similarity: float = 0.8, least: int = 24, block_bytes: int = 4 << 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns; further blocks of items filter what earlier ones left."""
    at = docs.columns.index("text")

    def run(index, batches):
        for block in common.blocks(batches):
            good = [not row for row in index.search(block.column(at))]
            yield block.filter(pa.array(good, pa.bool_()))

    for part in _blocks(items, item_id, item_text, block_bytes):
        docs = _mapped(docs, part, similarity, least, run, docs.schema)
    return docs


def op5_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row per contaminated document: its items and the least distance."""
    hits = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.groupBy("doc_id").agg(F.lit(True).alias("contaminated"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.countDistinct("item_id").alias("n_items"), F.min("distance").alias("distance"))
