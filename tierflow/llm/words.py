"""Splitting batches of texts into words and hashing them, with whole numpy arrays.

Texts of a batch are laid out as one array of code points with a lone surrogate between them,
which no text from Spark can hold. A word's hash is the sum of (random number of its code
point) x (random number of its place) modulo 2**64, mixed afterwards; all processes draw
the same random numbers. Different words share a hash with a probability of about 2**-60 a pair.
"""

from __future__ import annotations

import sys
import types

import numpy as np

SEPARATOR = 0xD800
SPACE, WORD, DIGIT, OTHER, BETWEEN, UNKNOWN = 0, 1, 2, 3, 4, 255
#: Code points that are looked at together; a longer text makes a batch of its own.
BATCH_CHARS = 1 << 19
#: Code points whose words are folded into one set of entries before a shuffle.
FOLDED_CHARS = 1 << 22


def kept(name, make):
    """``make()``, kept in this process under ``name``; a worker's later tasks find it again."""
    store = sys.modules.setdefault("_tierflow_kept", types.ModuleType("_tierflow_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def mixed(x):
    """64 bits stirred, so that each bit of the result depends on all of ``x``."""
    x = np.asarray(x, dtype=np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _numbers(n, salt):
    return mixed((np.arange(n, dtype=np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15))


def _characters():
    return _numbers(0x110000, 1 << 40)


def _lowered():
    numbers = _characters()
    numbers[65:91] = numbers[97:123]
    return numbers


def _places(n):
    places = kept("places", lambda: _numbers(1 << 12, 1 << 50) | np.uint64(1))
    if len(places) < n:
        places = _numbers(n, 1 << 50) | np.uint64(1)
        if n <= 1 << 20:
            kept("places", list)
            sys.modules["_tierflow_kept"].places = places
    return places


class HashIndex:
    """Numbers by 64-bit keys, looked up and added by whole arrays; slots are probed one after the other."""

    def __init__(self, capacity):
        bits = max(4, int(2 * capacity - 1).bit_length())
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        self.shift, self.mask, self.held, self.capacity = np.uint64(64 - bits), (1 << bits) - 1, 0, capacity

    def _slots(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys):
        """The number of each key, -1 where it has none."""
        keys = np.maximum(keys, np.uint64(1))
        slots = self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.values[slots], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            there, wanted = self.keys[slots[open_]], keys[open_]
            hit = there == wanted
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return found

    def add(self, keys, values):
        """New keys, each once; at most ``capacity`` in all."""
        keys = np.maximum(keys, np.uint64(1))
        self.held += len(keys)
        slots = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            self.keys[slots[free]] = keys[free]
            won = self.keys[slots[left]] == keys[left]
            self.values[slots[left[won]]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask


def release():
    """Memory that this process has freed given back to the machine; a worker that waits for its next task holds no more than it uses."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(kept("libc", lambda: ctypes.CDLL(None)), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget_others(*names):
    """What this process keeps for other operators dropped: all whose name begins with none of ``names``. A worker goes from one
    stage of a pipeline to the next, and would hold the tables of both."""
    store = sys.modules.setdefault("_tierflow_kept", types.ModuleType("_tierflow_kept")).__dict__
    others = [k for k in store if not k.startswith(("__", "places", "libc", *names))]
    for name in others:
        del store[name]
    if others:
        release()


def released(run, *names):
    """A function for ``mapInArrow`` that gives its memory back when its part has ended; with ``names`` of what it keeps,
    what others have kept goes before."""

    def releasing(parts):
        if names:
            forget_others(*names)
        yield from run(parts)
        release()

    return releasing


def released_group(run):
    """A function for ``applyInArrow`` that gives its memory back after a group of more than a megabyte."""

    def releasing(table):
        made = run(table)
        if table.nbytes > 1 << 20:
            release()
        return made

    return releasing


def batches(texts, chars=BATCH_CHARS, most=1 << 30):
    """Slices (first, last) of ``texts`` with about ``chars`` code points, or one longer text, and at
    most ``most`` texts."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and (held + len(text) > chars or i - first >= most):
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def column_batches(column, size=BATCH_CHARS, most=1 << 30):
    """Slices (first, last) of an Arrow column of texts with about ``size`` bytes, or one longer text, and
    at most ``most`` texts; so no more than a slice need be Python strings."""
    import pyarrow.compute as pc

    first, held = 0, 0
    for i, length in enumerate(pc.binary_length(column).to_pylist()):
        if i > first and (held + length > size or i - first >= most):
            yield first, i
            first, held = i, 0
        held += length + 1
    if first < len(column):
        yield first, len(column)


def texts_of(column, size=BATCH_CHARS):
    """Lists of a column's texts, slice by slice."""
    for first, last in column_batches(column, size):
        yield column.slice(first, last - first).to_pylist()


def distinct(values):
    """Sorted values, each once. Sorting whole numbers is faster than the hash table of ``np.unique``."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    return values[np.append(True, values[1:] != values[:-1])]


def runs(values):
    """(value, first, last) of each run of equal ``values``, which are sorted."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(values)) if len(values) else starts
    return list(zip(values[starts].tolist(), starts.tolist(), ends.tolist()))


def listed_owners(owners, everyone, many):
    """Bytes of a blob's owners, numbered anew, and of the list of those that it has; ``many`` stays as it is."""
    real = owners != many
    who = np.unique(owners[real])
    local = np.where(real, np.searchsorted(who, owners), many).astype(np.uint16)
    return local.tobytes(), everyone[who].tobytes()


def code_points(texts):
    """One array of code points, with ``SEPARATOR`` after every text."""
    joined = chr(SEPARATOR).join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def run_starts(classes):
    """Mask of the places where a run of one class begins; separators stand alone."""
    begins = np.empty(len(classes), dtype=bool)
    begins[:1] = True
    np.not_equal(classes[1:], classes[:-1], out=begins[1:])
    begins |= classes == BETWEEN
    return begins


def segment_hashes(points, starts, numbers):
    """Hash of each segment between neighbouring ``starts``; the last ends with the array."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = np.diff(starts, append=len(points))
    place = np.arange(len(points), dtype=np.int32) - np.repeat(starts, lengths).astype(np.int32)
    terms = _places(int(lengths.max()))[place]
    terms *= numbers[points]
    return mixed(np.add.reduceat(terms, starts))


def _blank_classes():
    classes = np.full(0x110000, WORD, dtype=np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[SEPARATOR] = BETWEEN
    return classes


def blank_separated(texts):
    """Words between blanks (space and code points 9 to 13), A-Z lower-cased.

    Returns (hashes, bounds): the words of text ``i`` are ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    points = code_points(texts)
    classes = kept("blank classes", _blank_classes)[points]
    starts = np.flatnonzero(run_starts(classes))
    hashes = segment_hashes(points, starts, kept("lowered numbers", _lowered))
    kinds = classes[starts]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    bounds[1:] = np.cumsum(kinds == WORD)[kinds == BETWEEN]
    return hashes[kinds == WORD], bounds


def _unknown_classes():
    classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
    classes[SEPARATOR] = BETWEEN
    return classes


def classified(points, table, classify):
    """Class of every code point; ``classify`` is asked once for each that ``table`` lacks."""
    classes = table[points]
    if (classes == UNKNOWN).any():
        for point in np.unique(points[classes == UNKNOWN]).tolist():
            table[point] = classify(chr(point))
        classes = table[points]
    return classes


def letter_classes(name, classify):
    """A table for ``classified``, kept in this process."""
    return kept(f"letter classes {name}", _unknown_classes)


def contractions(points, classes, begins, after_space):
    """Split off 's 't 're 've 'm 'll 'd where an apostrophe begins a piece."""
    at = np.flatnonzero((points == ord("'")) & (classes == OTHER))
    at = at[(at == 0) | (classes[at - 1] != OTHER)]
    at = at[classes[at + 1] == WORD]  # the array ends with a separator
    if not after_space:
        at = at[(at == 0) | (points[at - 1] != 0x20)]
    if not len(at):
        return
    first = points[at + 1]
    second = points[np.minimum(at + 2, len(points) - 1)]
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = np.zeros(len(at), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        two |= (first == ord(a)) & (second == ord(b))
    for which, length in ((one, 1), (two & ~one, 2)):
        begins[at[which] + 1] = False
        begins[at[which] + 1 + length] = True
