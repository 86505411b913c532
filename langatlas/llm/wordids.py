"""Token ids of whole texts by the tokenizers library, each distinct word once.

A byte-level BPE splits a text by a fixed pattern before it merges, and a blank
followed by anything but white space always starts a new piece.  So a text can
be cut before such blanks and its ids are the ids of the cuts in order.  Where the
pattern makes a piece of a lone line feed, a cut of several lines is put together
from theirs.  The
cuts are looked up in a bounded store of words that a Python worker has already
seen; only a new word goes through the library's model.  The ids are those of
encoding the whole text at once (tests compare them).
"""

from __future__ import annotations

import base64
import re
import string
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

#: Words (and ids) a worker keeps; beyond it the store starts anew.
MAX_WORDS = 500_000
MAX_STORED_IDS = 4_000_000
FILE_WORDS = 800_000

CUT = re.compile(r" (?=\S)")
#: A line feed with no other white space beside it.
LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: ASCII signs but the apostrophe, which may start a piece that goes on with letters.
SIGNS = string.punctuation.replace("'", "")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


BYTE_CHARS = byte_chars()
TO_CHARS = dict(enumerate(BYTE_CHARS))
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


class _Uncut(Exception):
    """A blank of the text is no place to cut it."""


class _Words(dict):
    """word -> row of the encoder's store; a new word is encoded on first sight."""

    def __init__(self, encoder: "WordEncoder", prefix: str) -> None:
        super().__init__()
        self.encoder, self.prefix, self.lead = encoder, prefix, to_chars(prefix.encode())
        self.plain = encoder.fallback is None

    def __missing__(self, word: str) -> int:
        enc = self.encoder
        if word.isalpha():
            # Letters alone are one piece; ASCII letters stand for themselves.
            if self.plain and word.isascii():
                ids = [t.id for t in enc.model.tokenize(self.lead + word)]
            else:
                ids = enc.encode_cut(self.prefix, word)
        elif self.prefix and (not word or word[0].isspace()):
            raise _Uncut
        elif ((letters := word.rstrip(SIGNS)).isalpha()
              and (tail := enc.tail(word[len(letters):])) is not None):
            ids = enc.held(self[letters]) + tail
        elif enc.feed is not None and len(lines := LINE.split(word)) > 1:
            ids = enc.held(self[lines[0]])
            for line in lines[1:]:
                ids += enc.feed
                ids += enc.held(enc.first[line])
        else:
            ids = enc.encode_cut(self.prefix, word)
        enc.ids.extend(ids)
        enc.bounds.append(len(enc.ids))
        row = self[word] = len(enc.bounds) - 2
        return row


class WordEncoder:
    """Ids of texts under one tokenizer (a byte-level BPE)."""

    def __init__(self, tokenizer: Tokenizer, fallback: Callable[[str], list[int] | None] | None = None,
                 max_words: int = MAX_WORDS) -> None:
        self.model, self.pre = tokenizer.model, tokenizer.pre_tokenizer
        self.fallback, self.max_words = fallback, max_words
        # Ids of a lone line feed, if the pattern makes a piece of it.
        pieces = [chars for chars, _ in self.pre.pre_tokenize_str("a.\nb\n.")]
        feed = to_chars(b"\n")
        self.feed = array("I", self.piece("\n")) if pieces == ["a", ".", feed, "b", feed, "."] else None
        self._clear()

    def _clear(self) -> None:
        self.ids, self.bounds = array("I"), array("q", [0])
        self.first, self.rest = _Words(self, ""), _Words(self, " ")
        self.tails: dict[str, array | None] = {}

    def held(self, row: int) -> array:
        return self.ids[self.bounds[row]:self.bounds[row + 1]]

    def tail(self, signs: str) -> array | None:
        """Ids of signs that end a word of letters; None: they share a piece with these."""
        if signs not in self.tails:
            pieces = [chars for chars, _ in self.pre.pre_tokenize_str("a" + signs)]
            self.tails[signs] = (array("I", [i for p in pieces[1:] for i in self._mapped(p)])
                                 if pieces[0] == "a" else None)
        return self.tails[signs]

    def add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.bounds.append(len(self.ids))
        return len(self.bounds) - 2

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the splitting pattern."""
        return self._mapped(to_chars(text.encode()))

    def _mapped(self, chars: str) -> list[int]:
        if self.fallback is not None and (ids := self.fallback(chars)) is not None:
            return ids
        return [t.id for t in self.model.tokenize(chars)]

    def encode_cut(self, prefix: str, word: str) -> list[int]:
        # Letters alone are one piece; of letters beyond Latin the library decides.
        if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            return self.piece(prefix + word)
        return [i for chars, _ in self.pre.pre_tokenize_str(prefix + word)
                for i in self._mapped(chars)]

    def _look_up(self, cuts: list[str], rows: array) -> None:
        if cuts[0]:
            rows.append(self.first[cuts[0]])
        rows.extend(map(self.rest.__getitem__, cuts[1:]))

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` (uint32, all texts one after the other) and ``bounds`` (where
        each text starts, and the end); ``end`` follows each text's ids."""
        if len(self.first) + len(self.rest) > self.max_words or len(self.ids) > MAX_STORED_IDS:
            self._clear()
        ending = [] if end is None else [self.add([end])]
        rows, counts = array("q"), []
        for text in texts:
            before = len(rows)
            if text:
                try:                         # most texts have cuts at all their blanks
                    self._look_up(CUT.split(text) if "  " in text else text.split(" "), rows)
                except _Uncut:
                    del rows[before:]
                    self._look_up(CUT.split(text), rows)
            rows.extend(ending)
            counts.append(len(rows) - before)
        at = np.frombuffer(rows, np.int64) if rows else np.zeros(0, np.int64)
        bounds = np.frombuffer(self.bounds, np.int64)
        starts, sizes = bounds[at], bounds[at + 1] - bounds[at]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])
        ids = np.frombuffer(self.ids, np.uint32)[take] if len(take) else np.zeros(0, np.uint32)
        return ids, upto[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]


@cache
def file_encoder(path: str) -> WordEncoder:
    """Of a tokenizers JSON file with a byte-level BPE; the strings of special
    tokens in a text are ordinary text.  One per Python worker."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return WordEncoder(tokenizer, max_words=FILE_WORDS)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _ordered_splits(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where ``token`` can be merged from two tokens, in the order that makes the
    leftmost of two overlapping merges come first.

    Merges (x, y) and (y, z) into one token overlap in x y z only if y is both
    its end and its start; the first is the split before y, the second the one
    after it.  They are the complementary splits len - b and b for a border of
    length b; (x, y) has to come first.
    """
    n = len(token)
    splits = [p for p in range(1, n) if token[:p] in ranks and token[p:] in ranks]

    def order(p: int) -> tuple[int, int, int]:
        left = token.startswith(token[p:])      # p = n - b for the border token[p:]
        right = token.endswith(token[:p])       # p = b for the border token[:p]
        return (min(p, n - p), 0 if left and not right else 1, p)

    return sorted(splits, key=order)


def rank_merges(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Merge rules equal to merging by rank: every way to make a token, by the
    token's rank."""
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        merges += [(to_chars(token[:p]), to_chars(token[p:]))
                   for p in _ordered_splits(token, ranks)]
    return merges


#: A byte string four times in a row: both merges of an overlap can then be of
#: one token that repeats itself, where no order of merge rules says "leftmost".
REPEATS = re.compile(r"(.+?)\1{3}", re.S)
REPEATS_SHORT = re.compile(r"(.)\1{3}|(..)\2{3}|(...)\3{3}", re.S)      # of up to 15 bytes


class LeftmostMerges:
    """Merging by rank, the leftmost of equals first, for pieces that repeat."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __call__(self, chars: str) -> list[int] | None:
        if len(chars) < 4 or not (REPEATS_SHORT if len(chars) < 16 else REPEATS).search(chars):
            return None
        data = bytes(map(CHAR_BYTES.__getitem__, chars))
        if data in self.ranks:
            return [self.ranks[data]]
        return merge_by_rank(data, self.ranks)


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Heap of adjacent pairs by (rank, place) over a linked list of parts."""
    from heapq import heapify, heappop, heappush
    n = len(data)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        rank = ranks.get(data[i:ends[j]]) if j < n else None
        return None if rank is None else (rank, i, ends[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue                               # one of the two has been merged since
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:ends[i]]])
        i = after[i]
    return out


@cache
def rank_encoder(path: str, pattern: str) -> WordEncoder:
    """Of a file of ranks: the library's BPE with merge rules made from the ranks."""
    ranks = read_ranks(path)
    model = models.BPE(vocab={to_chars(t): r for t, r in ranks.items()},
                       merges=rank_merges(ranks), ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return WordEncoder(tokenizer, fallback=LeftmostMerges(ranks))
