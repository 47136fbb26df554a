"""Encoding and decoding with a word-level BPE file; long unsplit pieces by joining the encodings of their halves.

A text is cut at white space and at the file's special strings, and the library's own normaliser and
split make pieces of each word, so that what counts as a letter or as lower case is always the
library's answer. A short piece is the library's as well. A long one is a tree: its halves are encoded
on their own, by rank, and joined, and only a window around the join is encoded again.

Why the join is exact: a run of merges by lowest rank, leftmost first, acts inside a token as it would
on that token alone, as long as nothing merges across the token's ends. So a sequence of tokens is the
encoding of its bytes if and only if every two neighbours are the encoding of theirs. The pairs of the
left half, of the right half and of the window hold by construction, and so do the two pairs at the
window's ends where it begins with the left half's token and ends with the right half's.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from typing import NamedTuple

#: Pieces of more symbols than this are encoded by halves.
LEAF = 1024
#: A whole piece of up to this many symbols is merged by the library's model; up to as many, the lowest rank is
#: looked for in a list, beyond in a heap.
_SHORT = 48
#: Longest word or piece whose answer is remembered, and the bytes that all answers of a worker may take.
LONGEST_WORD, MEMORY = 64, 96 * 2**20

#: White space that the file's split always removes, whatever stands beside it.
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: A word with anything beside printable ASCII. For the rest normalising only lower-cases, and bytes are their own symbols.
_ODD_WORD = re.compile(r"(?<![^ \t\n\r\x0b\x0c])([!-~]*+[^ -~\t\n\r\x0b\x0c][^ \t\n\r\x0b\x0c]*+)")
#: The split of the file for which the split of plain texts is known. Fixed value: it must equal the file's.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
_NO_MERGE = 1 << 60


class Encoded(NamedTuple):
    """Token ids as unsigned 32-bit integers, and their decoded text."""

    ids: bytes
    text: str


class Remembered(dict):
    """A memo of texts' answers: looking up a missing key computes it. It is kept while there is room, in bytes, which several memos may share."""

    def __init__(self, compute: Callable, room: list[int], size: Callable[..., int]):
        super().__init__()
        self.compute, self.room, self.size = compute, room, size

    def __missing__(self, key):
        value = self.compute(key)
        n = len(key) if isinstance(key, str) else 1
        if n <= LONGEST_WORD and (cost := 200 + 4 * n + self.size(value)) <= self.room[0]:
            self.room[0] -= cost
            self[key] = value
        return value


def _known_split(spec: dict) -> bool:
    """Whether a file normalises and splits plain texts as ``_PLAIN_SPLIT`` does."""
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT}


class WordBpe:
    """The model of a tokenizers .json file: BPE with a mark at the end of each word, without a decoder."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"not a plain BPE file: {', '.join(odd) or 'model, decoder or post-processor'}")
        self.leaf, end = max(leaf, 2), model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inside = {t: i for t, i in vocab.items() if len(t) == 1}
        self.last = {t: vocab[t + end] for t in self.inside if t + end in vocab}
        #: left << 32 | right -> rank, and the merged id of each rank
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in [*self.inside.values(), *self.last.values()]}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(left << 32 | right, rank)
            self.made.append(made)
            self.symbols.setdefault(made, self.symbols[left] + self.symbols[right])
        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._library.no_truncation()
        self._library.no_padding()
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        blank = " \t\n\r\x0b\x0c"
        if any(_SPACE.search(t) for t in self.special) or self._split(f"a{blank}b") != ["a", "b"]:
            raise ValueError("white space does not separate the pieces of this file")
        self._plain = _known_split(spec)
        room = [MEMORY]
        self._known = Remembered(self._ids, room, len)
        self._split_words = Remembered(lambda word: list(self.pieces(word)), room, lambda pieces: 60 + 8 * len(pieces))

    # -- pieces -------------------------------------------------------------------------------

    def merged(self, symbols: Iterable[int]) -> list[int]:
        """The ids of a run of symbols: always the pair of lowest rank, the leftmost of equal ones."""
        ids = list(symbols)
        return self._merged_short(ids) if len(ids) <= _SHORT else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, _NO_MERGE) for a, b in pairwise(ids)]
        while ranks and (low := min(ranks)) < _NO_MERGE:
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, _NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], _NO_MERGE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """With a heap of rank and place as one number, and links between the symbols that are left: O(n log n)."""
        rank, made, n = self.rank.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, (a, b) in enumerate(pairwise(ids)) if (r := rank(a << 32 | b)) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has changed meanwhile
            ids[i], ids[j] = (new := made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 32 | ids[k])) is not None:
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 32 | new)) is not None:
                heappush(heap, r * n + h)
        return [x for x in ids if x >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring stretches from the ids of each: a window around the join grows until both agree."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merged(s for t in (*left[len(left) - a :], *right[:b]) for s in self.symbols[t])
            starts = a == len(left) or window[0] == left[len(left) - a]
            ends = b == len(right) or window[-1] == right[b - 1]
            if starts and ends:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if starts else 4 * a, b if ends else 4 * b

    def piece(self, text: str, whole: bool = True) -> list[int]:
        """The ids of one piece of the split. ``whole=False``: a stretch that does not reach the end of its word."""
        if whole and len(text) <= min(_SHORT, self.leaf):
            return [t.id for t in self._model.tokenize(text)]
        symbols = [self.inside[c] for c in text]
        if whole and symbols:
            symbols[-1] = self.last[text[-1]]
        return self._tree(symbols)

    def _tree(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= self.leaf:
            return self.merged(symbols)
        half = len(symbols) // 2
        return self.joined(self._tree(symbols[:half]), self._tree(symbols[half:]))

    # -- parts of a long text, which tasks encode on their own ---------------------------------

    def parts(self, text: str, size: int) -> Iterator[tuple[list[str | int], bool, bool]]:
        """The pieces of a text in parts of about ``size`` symbols: (pieces, continues, unfinished).

        A piece that does not fit is cut: ``unfinished`` says that the last piece goes on in the next
        part, ``continues`` that the first one began in an earlier part.
        """
        held, n, continues = [], 0, False
        for p in self.pieces(text):
            while isinstance(p, str) and n + len(p) > size:
                room = max(size - n, 1)
                if len(p) <= room:
                    break
                yield [*held, p[:room]], continues, True
                held, n, continues, p = [], 0, True, p[room:]
            held.append(p)
            n += len(p) if isinstance(p, str) else 1
            if n >= size:
                yield held, continues, False
                held, n, continues = [], 0, False
        if held:
            yield held, continues, False

    def part(self, pieces: list[str | int], continues: bool, unfinished: bool) -> tuple[list[int], list[int], list[int]]:
        """Ids of the end of an earlier piece, of the whole pieces, and of the start of a piece that goes on.

        A part that is the middle of one piece has all its ids in the first.
        """
        groups = [[p] if isinstance(p, int) else self.piece(p, whole=not (unfinished and i == len(pieces) - 1)) for i, p in enumerate(pieces)]
        head = groups.pop(0) if continues else []
        tail = groups.pop() if unfinished and groups else []
        return head, [x for g in groups for x in g], tail

    # -- texts --------------------------------------------------------------------------------

    def pieces(self, text: str) -> Iterator[str | int]:
        """The pieces of a text in order; a special string is its id."""
        for part in self._cut.split(text) if self._cut else (text,):
            if part in self.special:
                yield self.special[part]
            else:
                for word in _SPACE.split(part):
                    if word:
                        yield from self._split(word)

    def _split(self, word: str) -> list[str]:
        library = self._library
        return [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(word) if library.normalizer else word)]

    def decoded(self, ids: Iterable[int]) -> str:
        """As the library decodes without a decoder: the tokens with a space between them."""
        return " ".join(map(self.token.__getitem__, ids))

    def _ids(self, piece: str | int) -> bytes:
        return array("I", self.piece(piece) if isinstance(piece, str) else (piece,)).tobytes()

    def encode(self, text: str) -> Encoded:
        """Ids and decoded text. Words and pieces of up to ``LONGEST_WORD`` characters are remembered, within ``MEMORY`` bytes."""
        pieces: list[str | int] = []
        if self._plain and not (self._cut and self._cut.search(text)):
            plain = True
            for part in _ODD_WORD.split(text):  # plain stretches and odd words take turns
                pieces += _PLAIN_SPLIT.findall(part.lower()) if plain else self._split_words[part]
                plain = not plain
        else:
            for word in _SPACE.split(text):
                pieces += self._split_words[word]
        ids = b"".join(map(self._known.__getitem__, pieces))
        return Encoded(ids, self.decoded(array("I", ids)))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
