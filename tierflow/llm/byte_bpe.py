"""Byte-level BPE ids of whole texts, by the ``tokenizers`` library.

The library spends most of its time on words that it has seen before. So texts are cut into the
vocabulary's pieces with numpy, each different piece is encoded by the library once and its
ids are kept in the worker, and a text's ids are gathered from there. Classes of code points
are asked of the library's own splitter. A text that holds a special token's string is encoded by
the library as a whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd

from tierflow.llm import words
from tierflow.llm.words import SEPARATOR
from tierflow.workspace import runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors(__name__)

#: Pieces whose ids a worker keeps; beyond them it starts anew. About 40 bytes each.
KEPT_PIECES = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself if printable,
    else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b if b in printable else 0x100 + hidden.index(b)) for b in range(256)}


class PieceStore:
    """Numbers of each piece, by the piece's hash."""

    def __init__(self, least=0):
        self.index = words.HashIndex(max(KEPT_PIECES, least))
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def add(self, keys, lists):
        """A list of numbers for each of the new ``keys``; the places where they are kept."""
        ends = self.used + np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
        n, used = self.index.held, int(ends[-1])
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), used), dtype=np.uint32)])
        if n + len(keys) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(keys) + 1), dtype=np.int64)])
        self.flat[self.used : used] = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=used - self.used)
        self.ends[n + 1 : n + 1 + len(keys)] = ends
        numbers = np.arange(n, n + len(keys), dtype=np.int32)
        self.index.add(keys, numbers)
        self.used = used
        return numbers

    def gather(self, numbers):
        """(ids of all the numbered pieces one after the other, count of each)."""
        first = self.ends[numbers]
        counts = self.ends[numbers + 1] - first
        shift = first - (np.cumsum(counts) - counts)
        return self.flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))], counts


class ByteBpe:
    """Encoder of one vocabulary file; made once in a worker."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.letter_separator = chr(SEPARATOR).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        self.table = words.letter_classes(path, None)
        self.store = PieceStore()
        self.numbers = words.kept("plain numbers", words._characters)

    def classify(self, character):
        """Class of a code point as the splitter sees it: what it stays together with."""
        pieces = lambda text: [a for _, (a, _) in self.splitter.pre_tokenize_str(text)]
        if 1 not in pieces("a" + character):
            return words.WORD
        if 1 not in pieces("1" + character):
            return words.DIGIT
        if 1 not in pieces("!" + character):
            return words.OTHER
        return words.SPACE

    def pieces(self, texts):
        points = words.code_points(texts)
        classes = words.classified(points, self.table, self.classify)
        begins = words.run_starts(classes)
        # Of blanks before something else, the last goes with it if it is a space, and alone otherwise.
        last = np.flatnonzero((classes[:-1] == words.SPACE) & (classes[1:] != words.SPACE) & (classes[1:] != words.BETWEEN))
        begins[last] = True
        begins[last[points[last] == 0x20] + 1] = False
        words.contractions(points, classes, begins, after_space=False)
        starts = np.flatnonzero(begins)
        return points, starts, classes[starts]

    def written(self, points, starts, ends):
        """The pieces between ``starts`` and ``ends`` in byte letters."""
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        pieces = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        # No piece holds the separator, whose bytes no other character has.
        joined = chr(SEPARATOR).join(pieces).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return joined.split(self.letter_separator)

    def encode(self, texts):
        """(ids, bounds): the ids of text ``i`` are ``ids[bounds[i]:bounds[i + 1]]``."""
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        points, starts, kinds = self.pieces(["" if i in whole else t for i, t in enumerate(texts)])
        hashes = words.segment_hashes(points, starts, self.numbers)
        ends = np.append(starts[1:], len(points))
        inside = kinds != words.BETWEEN
        starts, ends, hashes = starts[inside], ends[inside], hashes[inside]
        codes, unique = pd.factorize(hashes)
        if self.store.index.held + len(unique) > KEPT_PIECES:
            self.store = PieceStore(len(unique))
        numbers = self.store.index.get(unique)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            where = np.empty(len(unique), dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            new = self.written(points, starts[where[missing]], ends[where[missing]])
            tokenize = self.model.tokenize
            numbers[missing] = self.store.add(unique[missing], [[t.id for t in tokenize(piece)] for piece in new])
        ids, counts = self.store.gather(numbers[codes])
        totals = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        bounds[1:] = totals[np.cumsum(inside)[kinds == words.BETWEEN]]
        if whole:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
            bounds[1:] = np.cumsum([len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, bounds


def encoder(path) -> ByteBpe:
    return words.kept(f"byte bpe {path}", lambda: ByteBpe(path))
