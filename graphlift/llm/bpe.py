"""Byte-pair encoding: counts by heap and linked list, and the token ids of the tokenizers library.

Both work on words, the stretches between single spaces, and remember each word's answer per Python
worker. A word with its leading space is a unit of the byte-level split: no piece of that split crosses
a single space that stands between two other characters that are not both white space. A text with two
white-space characters in a row, or with one of the rare characters that Python's ``\\s`` and the
library's disagree on, is not cut at spaces but split as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

#: The split of byte-level BPE before any merge. Fixed value: it must equal the library's.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and pieces of words, remembered per worker: how many, the longest, and the bytes they may take.
REMEMBERED, LONGEST, MEMORY = 300_000, 64, 96 * 2**20

_TOGETHER = re.compile(r"[\s\x1c-\x1f\x85][\s\x1c-\x1f\x85]")


class Remembered(dict):
    """A bounded memo: looking up a missing key computes it. The first keys stay, which are the frequent ones.

    At most ``limit`` of them, none longer than ``LONGEST``, and with their answers ``MEMORY`` bytes together.
    """

    def __init__(self, compute: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.room = compute, limit, MEMORY

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.limit and len(key) <= LONGEST and self.room > 0:
            self.room -= 200 + 2 * len(key) + (len(value) if isinstance(value, bytes) else 0)
            self[key] = value
        return value


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """The merge table of a tokenizers .json file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_ids = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if (key := (vocab[a], vocab[b])) not in self.rank:
                self.rank[key] = len(self.made)
                self.made.append(vocab[a + b])

    def count(self, piece: bytes) -> int:
        """Tokens of one piece of the split: its bytes less the merges that apply.

        A heap holds (rank, left place) of every adjacent pair as one number; the lowest rank goes first
        and, within it, the leftmost. The linked list ``after``/``before`` skips merged places. Entries
        whose pair has changed meanwhile are passed over. O(n log n) in the length of the piece.
        """
        n = len(piece)
        if n < 2:
            return n
        rank, made = self.rank, self.made
        symbol = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j >= n or symbol[i] < 0 or rank.get((symbol[i], symbol[j])) != r:
                continue
            symbol[i], symbol[j] = made[r], -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((symbol[i], symbol[k]))) is not None:
                    heappush(heap, q * n + i)
            if (h := before[i]) >= 0 and (q := rank.get((symbol[h], symbol[i]))) is not None:
                heappush(heap, q * n + h)
        return n - merges


class _ByWord:
    """Sums or joins an answer over the words of a text."""

    special: list[str]

    def _word(self, word: str):
        raise NotImplementedError

    def _parts(self, text: str) -> Iterable[str]:
        if not self.special:
            return (text,)
        return re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if any(s in text for s in self.special) else (text,)


class TokenCounter(_ByWord):
    """Counts tokens without ever making ids."""

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        self.special = self.merges.special
        self.split = regex.compile(SPLIT).findall
        self.piece = Remembered(lambda p: self.merges.count(p.encode()))
        self.word = Remembered(lambda w: self.whole(" " + w))

    def whole(self, text: str) -> int:
        return sum(map(self.piece.__getitem__, self.split(text)))

    def __call__(self, text: str) -> int:
        total = 0
        for part in self._parts(text):
            if part in self.special:
                total += 1
            elif part:
                if _TOGETHER.search(part):
                    total += self.whole(part)
                else:
                    first, *rest = part.split(" ")
                    total += (self.whole(first) if first else 0) + sum(map(self.word.__getitem__, rest))
        return total


@lru_cache(maxsize=4)
def merged_by_concatenation(path: str) -> bool:
    """Whether merging the adjacent pair with the least id of its concatenation gives the file's ids for any text.

    That is how a rank-based encoder works; the file's model merges listed pairs only. Every merge of a
    rank-based run lies inside one of the tokens it ends with, and runs on that token's own bytes alike.
    So it is enough that the run on each token's bytes merges listed pairs only, and that ids of merges
    grow in the order of the list.
    """
    merges = Merges(path)
    if any(b <= a for a, b in pairwise(merges.made)):
        return False
    spelled: dict[int, bytes] = {i: bytes([b]) for b, i in enumerate(merges.byte_ids)}
    for (a, b), rank in merges.rank.items():
        if a not in spelled or b not in spelled:
            return False
        spelled[merges.made[rank]] = spelled[a] + spelled[b]
    ids = {v: k for k, v in spelled.items()}
    for word in spelled.values():
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            found = [(k, i) for i, (a, b) in enumerate(pairwise(parts)) if (k := ids.get(a + b)) is not None]
            if not found:
                return False
            k, i = min(found)
            rank = merges.rank.get((ids[parts[i]], ids[parts[i + 1]]))
            if rank is None or merges.made[rank] != k:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


class TokenIds(_ByWord):
    """Ids of the tokenizers library, as unsigned integers of ``width`` bytes (2 or 4) in the machine's order.

    Where ``merged_by_concatenation`` holds for the file, words are encoded by tiktoken with the file's
    vocabulary as ranks, which is faster and gives the same ids. Otherwise, and for texts that aren't cut
    at spaces, the library encodes.
    """

    def __init__(self, path: str, width: int = 2, by_ranks: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 256**width:
            raise ValueError(f"{width} bytes are too few for this vocabulary")
        self.kind = {2: "H", 4: "I"}[width]
        if by_ranks:
            byte = {c: b for b, c in byte_symbols().items()}
            ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
            ordinary = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.word = Remembered(lambda w: array(self.kind, ordinary(" " + w)).tobytes())
        else:
            self.word = Remembered(lambda w: self.whole(" " + w))

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or _TOGETHER.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.word.__getitem__, rest))
