"""Token ids of whitespace-separated words; a worker remembers the words it has met, up to a bound."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain

import numpy as np

from ledgerweave.llm.once import once
from ledgerweave.llm.synchronise import U, Prefix, byte_values
from ledgerweave.llm.words import NOT_SPACE, Words, words_of

#: Distinct words a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 19
NONE = 1 << 30


def path_of(vocabulary: str) -> str:
    """A path stays; a bare name is looked up among the public vocabularies of this machine."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0] + 1, ... of all ranges, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(begin - before, counts)


class Memory:
    """Ids of words met before, by name. `encode(words, which)` gives the ids of new ones, and how many each has."""

    def __init__(self, encode: Callable[[Words, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.names, self.seconds = np.zeros(0, dtype=U), np.zeros(0, dtype=U)
        self.begin, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 20, dtype=np.uint32), 0

    def add(self, words: Words, names: np.ndarray, which: np.ndarray) -> None:
        ids, counts = self.encode(words, which)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        place = np.searchsorted(self.names, names)
        self.begin = np.insert(self.begin, place, self.used + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, place, counts)
        self.seconds = np.insert(self.seconds, place, words.second[which])
        self.names = np.insert(self.names, place, names)
        self.used += len(ids)

    def _known(self, names: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.names):
            return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return place, (self.names[place] == names) & (self.seconds[place] == seconds)

    def flat(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        if not len(words.first):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        names, which, back = np.unique(words.first, return_index=True, return_inverse=True)
        place, known = self._known(names, words.second[which])
        if not known.all():
            if len(self.names) + int((~known).sum()) > REMEMBERED:
                self.forget()
                known[:] = False
            self.add(words, names[~known], which[~known])
            place = np.searchsorted(self.names, names)
        begin, count = self.begin[place][back], self.count[place][back]
        return self.ids[spread(begin, count)], count

    def by_text(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's ids begin and end."""
        words = words_of(texts, NOT_SPACE)
        ids, counts = self.flat(words)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[words.offsets]


# Classes of bytes in words of plain text: letters, digits, other signs; the rest is left to the tokenizer.
LETTER, DIGIT, SIGN, LEAD, FOREIGN = 1, 2, 3, 4, 5
_CLASS = np.full(256, FOREIGN, dtype=np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = LETTER
_CLASS[0xC3] = LEAD  # and the byte behind it: À to ÿ without × and ÷, both letters or upper case of letters
_CLASS[[0x27, 0x3C]] = FOREIGN  # contractions and special tokens have rules of their own


class WordBpe:
    """The word-end BPE vocabulary over words.

    Parts of plain words are merged for many words at once: in each round every part merges its first pair of
    lowest rank, which is what the tokenizer does one word at a time. All other words go through the tokenizer.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        path = path_of(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        shown = _bytes_shown()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[shown[b] + "</w>"] for b in range(256)], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self._index(np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], dtype=np.int64))

    def _index(self, pair: np.ndarray) -> None:
        """An open hash table from pair to rank."""
        size = 1 << 18
        self.mask, self.keys, self.ranks = size - 1, np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        for rank, (key, slot) in enumerate(zip(pair.tolist(), self._slot(pair).tolist())):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & self.mask
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(U) * U(0x9E3779B97F4A7C15)) >> U(46)).view(np.int64)

    def rank(self, pair: np.ndarray) -> np.ndarray:
        slot = self._slot(pair)
        at = self.keys[slot]
        rank = np.where(at == pair, self.ranks[slot], NONE)
        open_ = np.flatnonzero((at != pair) & (at != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            hit = at == pair[open_]
            rank[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return rank

    def merge(self, buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of one width class; begin and size are their places in the buffer."""
        widest, size = int(size.max()), size.copy()
        column = np.arange(widest)[None, :]
        raw = buffer[np.minimum(begin[:, None] + column, len(buffer) - 1)]
        row = np.arange(len(begin))
        ids = self.inner[raw]
        ids[row, size - 1] = self.last[raw[row, size - 1]]
        ids[column >= size[:, None]] = 0
        ranks = np.full(ids.shape, NONE, dtype=np.int64)
        if widest > 1:
            pair = (ids[:, :-1] << 20) | ids[:, 1:]
            ranks[:, :-1] = np.where(column[:, 1:] < size[:, None], self.rank(pair.ravel()).reshape(pair.shape), NONE)
        done_ids, done_size = ids, size
        live = np.arange(len(begin))
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            keep = best < NONE
            if not keep.all():
                done_ids[live[~keep], : ids.shape[1]] = ids[~keep]
                done_size[live[~keep]] = size[~keep]
                live, at, best, ids, ranks, size = live[keep], at[keep], best[keep], ids[keep], ranks[keep], size[keep]
            if not len(live):
                return done_ids[column < done_size[:, None]].astype(np.uint32), done_size
            # the place behind the merged pair is left out; then the merged token's two new pairs are ranked
            width = ids.shape[1]
            stay = np.arange(width)[None, :] != (at + 1)[:, None]
            ids, ranks = ids[stay].reshape(-1, width - 1), ranks[stay].reshape(-1, width - 1)
            k = np.arange(len(live))
            ids[k, at] = self.made[best]
            size = size - 1
            for place in (at - 1, at):
                p, q = np.maximum(place, 0), np.minimum(np.maximum(place, 0) + 1, width - 2)
                fresh = np.where(place + 1 < size, self.rank((ids[k, p] << 20) | ids[k, q]), NONE)
                inside = place >= 0
                ranks[k[inside], p[inside]] = fresh[inside]

    def __call__(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, size = words.starts[which], words.ends[which] - words.starts[which]
        joined = np.frombuffer(words.joined, dtype=np.uint8)
        buffer = joined[spread(begin, size)].copy()
        ends = np.cumsum(size)
        kind = _CLASS[buffer]
        lead = np.flatnonzero(kind == LEAD)
        tail = buffer[np.minimum(lead + 1, len(buffer) - 1)]
        letter = (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)
        kind[lead] = np.where(letter, LETTER, FOREIGN)
        kind[lead[letter] + 1] = LETTER
        upper = lead[letter & (tail <= 0x9E)] + 1
        buffer[upper] += 0x20
        buffer[(buffer >= 0x41) & (buffer <= 0x5A)] += 0x20
        owner = np.repeat(np.arange(len(which)), size)
        foreign = np.zeros(len(which), dtype=bool)
        foreign[owner[kind == FOREIGN]] = True
        foreign[size > 48] = True

        # parts of plain words: runs of letters, runs of signs, single digits
        cut = np.ones(len(buffer), dtype=bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(buffer)))
        plain = ~foreign[owner[first]]
        first, length = first[plain], length[plain]
        prefix_names = self._names(buffer, first, length)
        _, pick, back = np.unique(prefix_names, return_index=True, return_inverse=True)
        part_ids, part_count = self._merged(buffer, first[pick], length[pick])
        part_begin = np.cumsum(part_count) - part_count
        count, start = part_count[back], part_begin[back]
        belongs = owner[first]
        flat = part_ids[spread(start, count)]
        totals = np.bincount(belongs, weights=count, minlength=len(which)).astype(np.int64)
        if foreign.any():
            other = np.flatnonzero(foreign)
            texts = [words.joined[words.starts[which[k]] : words.ends[which[k]]].decode("utf-8", "replace") for k in other]
            made = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            at = np.cumsum(totals)[other]
            more = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            flat = np.insert(flat, np.repeat(at, more), np.fromiter(chain.from_iterable(made), dtype=np.uint32))
            totals[other] = more
        return flat, totals

    @staticmethod
    def _names(buffer: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), dtype=U)
        at, step = 0, 1 << 17
        while at < len(first):
            upto = max(at + 1, int(np.searchsorted(first, first[at] + step)))
            low, high = first[at], first[upto - 1] + length[upto - 1]
            prefix = Prefix(byte_values(0)[buffer[low:high]], byte_values(1)[buffer[low:high]])
            out[at:upto] = prefix.name(first[at:upto] - low, first[at:upto] - low + length[at:upto])[0]
            at = upto
        return out

    def _merged(self, buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, merged in groups of like length, given back in their own order."""
        order = np.argsort(size, kind="stable")
        made = [self.merge(buffer, begin[some], size[some]) for some in (order[low : low + 4096] for low in range(0, len(order), 4096))]
        if not made:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        flat, counts = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        starts = np.cumsum(counts) - counts
        own_start, own_count = np.empty_like(starts), np.empty_like(counts)
        own_start[order], own_count[order] = starts, counts
        return flat[spread(own_start, own_count)], own_count


def _bytes_shown() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, other = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in shown:
            shown[b], other = chr(other), other + 1
    return [shown[b] for b in range(256)]


def word_bpe(vocabulary: str) -> Memory:
    return once(("word_bpe", vocabulary), lambda: Memory(WordBpe(vocabulary)))


def sentence_pieces(vocabulary: str) -> tuple[Memory, np.ndarray]:
    """Pieces of words, each word encoded by itself; and which pieces are single fallback bytes."""
    return once(("sentence_pieces", vocabulary), lambda: _sentence_pieces(vocabulary))


def _sentence_pieces(vocabulary: str) -> tuple[Memory, np.ndarray]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path_of(vocabulary))
    is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])

    def encode(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [words.joined[s:e].decode("utf-8", "replace") for s, e in zip(words.starts[which].tolist(), words.ends[which].tolist())]
        made = model.encode(texts, num_threads=1)
        return np.fromiter(chain.from_iterable(made), dtype=np.uint32), np.fromiter(map(len, made), dtype=np.int64, count=len(made))

    return Memory(encode), is_byte
