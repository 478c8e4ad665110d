"""BPE of whole texts by dynamic programming over the prefixes of each word.

For every prefix of a word, the encoding that the merges give has one last token. It is found among the
tokens that end there, longest first: the one before which the rest of the prefix ends with a
token that it may stand beside. An automaton over the vocabulary (a trie with links to the longest proper
suffix) yields the tokens that end at a place. Two tokens may stand side by side if, while each is built
merge by merge, no merge across the border would have come first: going back in time through
the right edge of the first and the left edge of the second, each pair of symbols that
lived at one time must have no merge, or one later than the end of either. Back-pointers
from the last prefix give the ids. All words of a batch go through this together, in arrays.

Normalising and the classes of code points come from the vocabulary file's own settings by the ``tokenizers``
library; no text is encoded by it. Special tokens' strings become their ids, as there.

Null texts count as empty and give no ids; repeated rows are each encoded; an empty table
gives no rows. Only the id and the text are read, so other columns may have any name.
Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import byte_bpe, words
from tierflow.workspace import runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors("tierflow.llm.byte_bpe")
runs_on_executors(__name__)

NEVER = np.int32(2**31 - 1)
COMPLEX = np.uint32(2**32 - 1)
#: Cells (word x place) of one table of prefixes.
CELLS = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """A vocabulary with merges: parts and age of each token, and the automaton over all tokens."""

    def __init__(self, model):
        ids = model["vocab"]
        size = max(ids.values()) + 1
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.age = np.full(size, -1, np.int32)
        self.length = np.ones(size, np.int32)
        suffix = model["end_of_word_suffix"] or ""
        pairs, spelled = [], {}
        letter_of = {c: b for b, c in byte_bpe.byte_letters().items()}
        for word, i in ids.items():
            if word in letter_of:
                spelled[i] = (letter_of[word],)
            elif suffix and word[:1] in letter_of and word[1:] == suffix:
                spelled[i] = (256 + letter_of[word[0]],)
        self.symbol_ids = np.zeros(512, np.int32)
        for i, (symbol,) in spelled.items():
            self.symbol_ids[symbol] = i
        for age, (a, b) in enumerate(model["merges"]):
            i, a, b = ids[a + b], ids[a], ids[b]
            self.left[i], self.right[i], self.age[i] = a, b, age
            spelled[i] = spelled[a] + spelled[b]
            self.length[i] = len(spelled[i])
            pairs.append((a << 20) | b)
        self.pairs = words.HashIndex(len(pairs))
        self.pairs.add(np.array(pairs, dtype=np.uint64) + np.uint64(1), np.arange(len(pairs), dtype=np.int32))
        self._automaton(spelled)

    def _automaton(self, spelled):
        children, token_at = [{}], [-1]
        for i, symbols in spelled.items():
            node = 0
            for symbol in symbols:
                node = children[node].setdefault(symbol, len(children))
                if node == len(children):
                    children.append({})
                    token_at.append(-1)
            token_at[node] = i
        fail, ends = [0] * len(children), [-1] * len(children)
        self.shorter = np.full(len(self.age), -1, np.int32)
        level = list(children[0].values())
        for node in level:
            ends[node] = token_at[node]
        while level:
            below = []
            for node in level:
                for symbol, child in children[node].items():
                    link = fail[node]
                    while link and symbol not in children[link]:
                        link = fail[link]
                    fail[child] = children[link].get(symbol, 0)
                    ends[child] = token_at[child] if token_at[child] >= 0 else ends[fail[child]]
                    if token_at[child] >= 0:
                        self.shorter[token_at[child]] = ends[fail[child]]
                    below.append(child)
            level = below
        self.fail, self.ends = np.array(fail, np.int32), np.array(ends, np.int32)
        steps = [(node * 512 + symbol, child) for node, edges in enumerate(children) for symbol, child in edges.items()]
        self.steps = words.HashIndex(len(steps))
        self.steps.add(np.array([s for s, _ in steps], dtype=np.uint64) + np.uint64(1), np.array([c for _, c in steps], dtype=np.int32))

    def step(self, states, symbols):
        """The automaton's states after one symbol each."""
        keys = lambda s, c: s.astype(np.uint64) * np.uint64(512) + c.astype(np.uint64) + np.uint64(1)
        after = self.steps.get(keys(states, symbols))
        stuck = np.flatnonzero(after < 0)
        back = states[stuck]
        while len(stuck):
            at_root = back == 0
            after[stuck[at_root]] = 0
            stuck, back = stuck[~at_root], self.fail[back[~at_root]]
            found = self.steps.get(keys(back, symbols[stuck]))
            after[stuck[found >= 0]] = found[found >= 0]
            stuck, back = stuck[found < 0], back[found < 0]
        return after

    def stand_together(self, first, second):
        """Whether the merges leave each pair of neighbours as they are."""
        together = np.ones(len(first), dtype=bool)
        rows = np.arange(len(first))
        end_first = np.full(len(first), NEVER)
        end_second = end_first.copy()
        while len(rows):
            merge = self.pairs.get((first.astype(np.uint64) << np.uint64(20)) + second.astype(np.uint64) + np.uint64(1))
            # Of merges of one age the leftmost comes first: one across the border before the second's own.
            crossed = (merge >= 0) & (merge < end_first) & (merge <= end_second)
            together[rows[crossed]] = False
            age_first, age_second = self.age[first], self.age[second]
            go = ~crossed & ((age_first >= 0) | (age_second >= 0))
            undo_first = age_first > age_second
            end_first = np.where(undo_first, age_first, end_first)[go]
            end_second = np.where(undo_first, end_second, age_second)[go]
            first, second = np.where(undo_first, self.right[first], first)[go], np.where(undo_first, second, self.left[second])[go]
            rows = rows[go]
        return together

    def encode(self, symbols, starts, lengths):
        """(ids of all words one after the other, count of each word)."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left") if longest else np.zeros(0, np.int64)
        rows = np.concatenate([[0], np.cumsum(active)])
        last = np.empty(int(rows[-1]), np.int32)
        states = np.zeros(len(lengths), np.int32)
        for place in range(longest):
            n = int(active[place])
            states = self.step(states[:n], symbols[starts[:n] + place])
            tokens = self.ends[states]
            open_ = np.flatnonzero(self.length[tokens] <= place)  # those that fill the prefix stand
            while len(open_):
                here = tokens[open_]
                before = last[rows[place - self.length[here]] + open_]
                fits = self.stand_together(before, here)
                open_ = open_[~fits]
                tokens[open_] = self.shorter[here[~fits]]
            last[rows[place] : rows[place + 1]] = tokens
        found, left, which = [], lengths.copy(), np.flatnonzero(lengths > 0)
        counts = np.zeros(len(lengths), np.int64)
        while len(which):
            tokens = last[rows[left[which] - 1] + which]
            found.append((which, counts[which], tokens))
            counts[which] += 1
            left[which] -= self.length[tokens]
            which = which[left[which] > 0]
        by_word = np.empty(len(lengths), np.int64)
        by_word[order] = counts
        firsts = np.cumsum(by_word) - by_word
        ids = np.empty(int(by_word.sum()), np.uint32)
        for which, nth, tokens in found:
            ids[firsts[order[which]] + counts[which] - 1 - nth] = tokens
        return ids, by_word


class PrefixBpe:
    """Encoder of one vocabulary file; made once in a worker."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path) as file:
            settings = json.load(file)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(settings["model"])
        self.special = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.spelling = {i: w for w, i in (settings["model"]["vocab"] | self.special).items()}
        self.table = words.letter_classes(path, None)
        self.lower = words.kept(f"lower {path}", lambda: np.full(0x110000, COMPLEX - np.uint32(1), dtype=np.uint32))
        self.lower[words.SEPARATOR] = words.SEPARATOR
        self.numbers = words.kept("plain numbers", words._characters)
        self.store, self.ids_text, self.spelled = byte_bpe.PieceStore(), [], []

    def classify(self, character):
        """Class of a code point as the splitter sees it: what it stays together with."""
        whole = lambda text: any(span == (0, 2) for _, span in self.split(text))
        if whole("a" + character):
            return words.WORD
        if whole("!" + character):
            return words.OTHER
        return words.DIGIT if len(self.split("1" + character)) == 2 else words.SPACE

    def lowered(self, points):
        lower = self.lower[points]
        if (lower == COMPLEX - np.uint32(1)).any():
            for point in np.unique(points[lower == COMPLEX - np.uint32(1)]).tolist():
                now = self.normalize(chr(point))
                self.lower[point] = ord(now) if len(now) == 1 else COMPLEX
            lower = self.lower[points]
        return lower

    def segments(self, texts):
        """(stretches between special tokens' strings, normalised; owner of each; special ids with owner and place)."""
        stretches, owners, specials = [], [], []
        for i, text in enumerate(texts):
            for part in self.special_pattern.split(text) if "<" in text else (text,):
                if part in self.special:
                    specials.append((len(stretches), self.special[part]))
                    part = ""
                elif not part.isascii() and not unicodedata.is_normalized("NFC", part):
                    part = self.normalize(part)
                stretches.append(part)
                owners.append(i)
        return stretches, owners, specials

    def pieces(self, texts):
        """(numbers of the kept pieces in order, bounds of each text's pieces)."""
        stretches, owners, specials = self.segments(texts)
        points = self.lowered(words.code_points(stretches))
        if (points == COMPLEX).any():  # a letter whose lower case is not one code point
            held = np.cumsum(words.code_points(stretches) == words.SEPARATOR)[points == COMPLEX]
            for i in np.unique(held).tolist():
                stretches[i] = self.normalize(stretches[i])
            points = self.lowered(words.code_points(stretches))
        classes = words.classified(points, self.table, self.classify)
        begins = words.run_starts(classes)
        begins |= classes == words.DIGIT
        words.contractions(points, classes, begins, after_space=True)
        starts = np.flatnonzero(begins)
        kinds = classes[starts]
        hashes = words.segment_hashes(points, starts, self.numbers)
        lengths = np.diff(starts, append=len(points))
        inside = (kinds != words.BETWEEN) & (kinds != words.SPACE)
        ends = np.cumsum(inside)[kinds == words.BETWEEN]  # of each stretch
        hashes, starts, lengths = hashes[inside], starts[inside], lengths[inside]
        for at, token in reversed(specials):
            hashes = np.insert(hashes, ends[at], np.uint64(token + 1))
            starts, lengths = np.insert(starts, ends[at], -token - 1), np.insert(lengths, ends[at], 0)
            ends[at:] += 1
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, end in zip(owners, ends.tolist()):
            bounds[i + 1] = end
        return self.known(points, hashes, starts, lengths), np.maximum.accumulate(bounds)

    def known(self, points, hashes, starts, lengths):
        codes, unique = pd.factorize(hashes)
        if self.store.index.held + len(unique) > byte_bpe.KEPT_PIECES:
            self.store, self.ids_text, self.spelled = byte_bpe.PieceStore(len(unique)), [], []
        numbers = self.store.index.get(unique)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            where = np.empty(len(unique), dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            where = where[missing]
            lists = self.encode_pieces(points, starts[where], lengths[where])
            numbers[missing] = self.store.add(unique[missing], lists)
            spelling = self.spelling
            self.ids_text += [" ".join(map(str, ids)) for ids in lists]
            self.spelled += [" ".join([spelling[i] for i in ids]) for ids in lists]
        return numbers[codes]

    def encode_pieces(self, points, starts, lengths):
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        written = [text[a : a + n].encode() for a, n in zip(np.maximum(starts, 0).tolist(), lengths.tolist())]
        sizes = np.fromiter(map(len, written), dtype=np.int64, count=len(written))
        symbols = np.frombuffer(b"".join(written), dtype=np.uint8).astype(np.int32)
        ends = np.cumsum(sizes)
        symbols[ends[sizes > 0] - 1] += 256
        ids, counts = self.merges.encode(symbols, (ends - sizes), sizes)
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        flat = ids.tolist()
        lists = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.flatnonzero(starts < 0).tolist():
            lists[i] = [-int(starts[i]) - 1]
        return lists

    def encode(self, texts):
        """(ids, bounds): the ids of text ``i`` are ``ids[bounds[i]:bounds[i + 1]]``."""
        numbers, bounds = self.pieces(texts)
        ids, counts = self.store.gather(numbers)
        return ids, np.concatenate([[0], np.cumsum(counts)])[bounds]

    def written(self, texts):
        """For each text: number of ids, the ids in decimal and the decoded text, both joined by spaces."""
        numbers, bounds = self.pieces(texts)
        sizes = np.concatenate([[0], np.cumsum(self.store.ends[numbers + 1] - self.store.ends[numbers])])[bounds]
        numbers = numbers.tolist()
        for i in range(len(texts)):
            own = numbers[bounds[i] : bounds[i + 1]]
            yield int(sizes[i + 1] - sizes[i]), " ".join([self.ids_text[n] for n in own]), " ".join([self.spelled[n] for n in own])

    def decode(self, ids):
        """The text of ``ids``: this kind of vocabulary joins its tokens by spaces."""
        return " ".join([self.spelling[i] for i in ids])


def encoder(path) -> PrefixBpe:
    return words.kept(f"prefix bpe {path}", lambda: PrefixBpe(path))


def _texts(docs, id_column, text_column):
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def encode(docs: DataFrame, id_column="doc_id", text_column="text", vocabulary=None) -> DataFrame:
    """Rows (doc_id, ids)."""
    path = vocabulary or default_path()

    def run(parts):
        bpe = encoder(path)
        for batch in parts:
            for first, last in words.column_batches(batch.column(1)):
                ids, bounds = bpe.encode(batch.column(1).slice(first, last - first).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["doc_id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _texts(docs, id_column, text_column).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, id_column="doc_id", ids_column="ids", vocabulary=None) -> DataFrame:
    """Rows (doc_id, text) of what ``encode`` returns; null ids count as none."""
    path = vocabulary or default_path()

    def run(parts):
        bpe = encoder(path)
        for batch in parts:
            texts = [bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    kind = tokens.schema[id_column].dataType.simpleString()
    rows = tokens.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, id_column="doc_id", text_column="text", vocabulary=None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), of the ids and of the text that they decode to."""
    path = vocabulary or default_path()

    def run(parts):
        bpe = encoder(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in parts:
            for first, last in words.column_batches(batch.column(1)):
                texts = batch.column(1).slice(first, last - first).to_pylist()
                rows = [(n, sha(ids), sha(decoded)) for n, ids, decoded in bpe.written(texts)]
                counts, ids, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts, type=pa.int64()), pa.array(ids), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _texts(docs, id_column, text_column).mapInArrow(run, schema)
