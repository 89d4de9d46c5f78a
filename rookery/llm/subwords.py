"""Subword ids of many texts, with a memory of chunks that a worker keeps between tasks."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

#: White space, and characters that end a chunk's letters in a splitter piece of their own.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MARKS = ".,;:!?*#$%&()[]{}|=+<>/\\\"@~^-_"


class Encoder:
    """Subword ids of texts by a vocabulary whose splitter drops white space and never joins across it.

    A text's ids are its white-space separated chunks' ids in order, and a chunk of letters and trailing marks is two
    pieces. ASCII letters are lower-cased before the lookup, as the vocabulary does, except in texts that may
    hold a special token. Unknown letter pieces are encoded together, apart by spaces, and told apart by
    the word ends of the vocabulary; where their number does not come out, one by one.
    """

    #: Chunks remembered at most; beyond, all but the first KEPT, most of which are frequent ones, are forgotten.
    LIMIT, KEPT = 800_000, 400_000

    def __init__(self, path: str, plain: bool = False):
        """``plain``: the strings of special tokens are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = self.plain = plain
        self.generation = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.place: dict[str, int] = {}
        self.names: list[str] = []
        self.flat, self.start, self.size = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _forget(self) -> None:
        k = min(self.KEPT, len(self.names))
        del self.names[k:]
        self.place = dict(zip(self.names, range(k)))
        self.used = int(self.start[k - 1] + self.size[k - 1]) if k else 0
        self.generation += 1

    def _put(self, chunks: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(flat), len(self.place)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(chunks) > len(self.start):
            self.start, self.size = (np.concatenate([v, np.zeros_like(v)]) for v in (self.start, self.size))
        self.flat[self.used : self.used + n] = flat
        self.start[k : k + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(chunks)] = sizes
        self.used += n
        self.place.update(zip(chunks, range(k, k + len(chunks))))
        self.names += chunks

    def raw(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lines in a row and how many each has, past the memory."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Pieces that are letters only."""
        if not pieces:
            return
        lines = [" ".join(pieces[i : i + 50]) for i in range(0, len(pieces), 50)]  # short lines encode fastest
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) == len(pieces) and stops[-1] == len(flat):
            self._put(pieces, flat, np.diff(stops, prepend=0))
        else:
            self._learn_chunks(pieces)

    def _learn_chunks(self, chunks: list[str]) -> None:
        if chunks:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            self._put(chunks, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]))

    def _learn(self, chunks: list[str]) -> None:
        pieces, pairs, odd = {}, [], {}
        for c in chunks:
            core = c.rstrip(_MARKS)
            if not core.isalpha() or "\u0130" in core:  # its lower case ends in a mark
                odd[c] = None
                continue
            if core not in self.place:
                pieces[core] = None
            if len(core) < len(c):
                marks = c[len(core) :]
                pairs.append((c, core, marks))
                if marks not in self.place:
                    odd[marks] = None
        self._learn_pieces(list(pieces))
        self._learn_chunks(list(odd))
        if pairs:
            names, cores, marks = zip(*pairs)
            two = np.empty(2 * len(pairs), np.int64)
            two[::2], two[1::2] = [self.place[c] for c in cores], [self.place[m] for m in marks]
            sizes = self.size[two]
            self._put(list(names), self.gather(two), sizes[::2] + sizes[1::2])

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of remembered chunks in a row."""
        size = self.size[places].astype(np.int64)
        total = np.cumsum(size)
        return self.flat[np.repeat(self.start[places] - total + size, size) + np.arange(total[-1] if len(total) else 0)]

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where the memory has each chunk; unknown ones are learnt."""
        if len(self.place) > self.LIMIT:
            self._forget()
        at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._learn(list(dict.fromkeys([chunks[i] for i in unknown])))
            at[unknown] = [self.place[chunks[i]] for i in unknown]
        return at

    def sizes(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of ids of texts whose chunks end at ``ends``."""
        total = np.concatenate([[0], np.cumsum(self.size[at], dtype=np.int64)])
        return np.diff(total[np.concatenate([[0], ends])])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        chunks: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            t = t if "<|" in t and not self.plain else lower(t)
            # the four separators that Python alone takes for white space
            chunks += [c for c in _SPACE.split(t) if c] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split()
            ends[i] = len(chunks)
        at = self.places(chunks)
        return self.gather(at), self.sizes(at, ends)


def lower(text: str) -> str:
    """ASCII letters in lower case."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def encoder_of(path: str, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary."""
    return Encoder(path, plain)
