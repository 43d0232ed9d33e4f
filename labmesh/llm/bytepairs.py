"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one encoding, so one last token. A token that ends at a
byte is the last one of that prefix exactly if merging would leave it beside the
last token of the prefix before it. Whether it would is answered by undoing the
merges of both tokens from the latest on: no pair across the boundary may merge
earlier than the halves beside it were made. So a word is encoded from left to right
without ever merging, bytes can be appended at the cost of the new prefixes, and an
edit costs the prefixes from there to where the last tokens are as before.

Texts are split in numpy at the places where the pattern splits them. New words of a
batch are encoded together in numpy, long ones one by one; each Python worker keeps
short words that it has met, up to a bound in bytes. One narrow pass, no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labmesh.llm.common import by_bytes
from labmesh.llm.pieces import DoubleArray
from labmesh.llm.remembered import Remembered

# Fixed value: the pattern whose splits `split_words` takes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Words of similar length in bytes are encoded together; longer ones one by one.
WIDTHS = (6, 8, 10, 12, 16, 24, 32, 64)
# Bytes of words and ids that a worker keeps, with what Python adds to each.
REMEMBERED = 48 << 20
# Pairs of tokens whose answer a worker keeps, as a power of two.
ANSWERS = 20
# Characters that are split at once.
SEGMENT = 1 << 20

OTHER, LETTER, NUMBER, BLANK = range(4)
_NEVER = np.iinfo(np.int64).max


# --- the vocabulary ---


class PairTable:
    """Numbers of pairs of tokens: a hash table in two arrays, with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int], size: int):
        self.size = size
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int64)
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values()):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.values[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 for pairs that are not in the table."""
        keys = first * self.size + second
        slot = self._slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] += 1
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found


def _merged(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of a word after all merges of a rank below the given one, the lowest first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least >= below:
            break
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class BytePairs:
    """Tokens by rank. `left` and `right` are the halves that a token was merged of, itself for bytes."""

    ranks: dict[bytes, int]
    left: np.ndarray
    right: np.ndarray
    pairs: dict[tuple[int, int], int]
    trie: DoubleArray
    back: DoubleArray  # of the tokens read from their ends
    classes: np.ndarray
    pattern: str = PATTERN
    size: int = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        self.size = max(self.ranks.values()) + 1
        self.longest = max(map(len, self.ranks))

    @cached_property
    def table(self) -> PairTable:
        return PairTable(self.pairs, self.size)

    @cached_property
    def whole_only(self) -> dict[bytes, int]:
        """Tokens that no merges lead to: they occur as a whole word only."""
        return {t: r for t, r in self.ranks.items() if len(t) > 1 and self.left[r] == r}

    @cached_property
    def _answers(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(1 << ANSWERS, -1, np.int64), np.zeros(1 << ANSWERS, bool)

    def adjacent(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves `second` beside `first`; answers are kept in a table of one place per hash."""
        keys, answers = self._answers
        pairs = first * self.size + second
        place = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ANSWERS)).astype(np.int64)
        valid = answers[place]
        new = np.flatnonzero(keys[place] != pairs)
        if len(new):
            valid[new] = found = self._adjacent(first[new], second[new])
            # Of new pairs that share a place one is kept, with its own answer.
            _, chosen = np.unique(place[new], return_index=True)
            new = new[chosen]
            keys[place[new]], answers[place[new]] = pairs[new], found[chosen]
        return valid

    def _adjacent(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves `second` beside `first`, for many pairs at once."""
        valid = np.ones(len(first), bool)
        rows, limit = np.arange(len(first)), np.full(len(first), _NEVER)
        left, right, table = self.left, self.right, self.table
        while len(rows):
            merged = table.find(first, second)
            broken = (merged >= 0) & (merged < limit)
            valid[rows[broken]] = False
            # The later merge is undone; of equal ones the second half was made later.
            inner_first, inner_second = right[first], left[second]
            undo_first = (first > second) & (inner_first != first)
            undo_first |= (first <= second) & (inner_second == second) & (inner_first != first)
            undo_second = ~undo_first & (inner_second != second)
            go = ~broken & (undo_first | undo_second)
            limit = np.where(undo_first, first, second + 1)[go]
            first = np.where(undo_first, inner_first, first)[go]
            second = np.where(undo_first, second, inner_second)[go]
            rows = rows[go]
        return valid

    def beside(self, first: int, second: int) -> bool:
        """The same for one pair."""
        left, right, limit = self._left, self._right, _NEVER
        while True:
            if self.pairs.get((first, second), limit) < limit:
                return False
            inner_first, inner_second = right[first], left[second]
            if inner_first != first and (first > second or inner_second == second):
                limit, first = first, inner_first
            elif inner_second != second:
                limit, second = second + 1, inner_second
            else:
                return True

    @cached_property
    def _left(self) -> list[int]:
        return self.left.tolist()

    @cached_property
    def _right(self) -> list[int]:
        return self.right.tolist()

    @cached_property
    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """The trie of reversed tokens as lists, which answer single reads faster than arrays."""
        return self.back.base.tolist(), self.back.check.tolist(), self.back.value.tolist()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}


def character_classes() -> np.ndarray:
    """Letter, number, blank or other, by code point."""
    every = "".join(map(chr, range(0x110000)))
    classes = np.zeros(len(every), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, every):
            classes[run.start() : run.end()] = kind
    return classes


def load_byte_pairs(path: str, pattern: str = PATTERN) -> BytePairs:
    """A vocabulary from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        rows = [line.split() for line in lines if line.strip()]
    return byte_pairs({base64.b64decode(token): int(rank) for token, rank in rows}, pattern)


def byte_pairs(ranks: dict[bytes, int], pattern: str = PATTERN) -> BytePairs:
    """A vocabulary from ranks, which must hold all single bytes, below all other tokens."""
    single = [ranks.get(bytes([b])) for b in range(256)]
    if None in single or max(single) > min((r for t, r in ranks.items() if len(t) > 1), default=256):
        raise ValueError("the vocabulary must begin with all single bytes")
    left = np.arange(max(ranks.values()) + 1)
    right, pairs, words = left.copy(), {}, {}
    for token, rank in ranks.items():
        parts = _merged(token, ranks, rank) if len(token) > 1 else [token]
        if len(parts) == 2:
            left[rank], right[rank] = halves = ranks[parts[0]], ranks[parts[1]]
            pairs[halves] = rank
        if len(parts) <= 2:
            words[token] = rank
        # A token that no merges lead to occurs as a whole word only.
    forth, back = DoubleArray.build(words), DoubleArray.build({w[::-1]: r for w, r in words.items()})
    return BytePairs(ranks, left, right, pairs, forth, back, character_classes(), pattern)


# --- splitting ---


def word_starts(codes: np.ndarray, texts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where PATTERN splits texts that stand one after another.

    `texts` are the positions where non-empty texts begin.
    """
    size = len(codes)
    kinds = classes[codes]
    run = np.empty(size, bool)
    run[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=run[1:])
    first = np.zeros(size + 3, bool)
    first[texts] = True
    first[size:] = True
    run |= first[:size]
    starts = run.copy()
    # The last of several blanks stands alone, and a space there joins what follows.
    after = np.flatnonzero(run[1:] & (kinds[:-1] == BLANK) & ~first[1:size]) + 1
    starts[after - 1] = True
    starts[after[codes[after - 1] == 0x20]] = False
    # Contractions: an apostrophe that a word begins with and one or two letters.
    quote = np.flatnonzero(codes == 0x27)
    quote = quote[starts[quote] & ~first[quote + 1]]
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        long &= ~first[quote + 2]
        for found, length in ((short, 2), (long, 3)):
            at = quote[found]
            starts[at + 1] = False
            ends = at + length
            starts[ends[ends < size]] = True
    return np.flatnonzero(starts)


def split_words(texts: Sequence[str], vocabulary: BytePairs) -> tuple[list[str], np.ndarray]:
    """The words of texts one after another, and where those of each text end."""
    if vocabulary.pattern != PATTERN:
        split = [regex.findall(vocabulary.pattern, text) for text in texts]
        return [w for words in split for w in words], np.cumsum([len(words) for words in split])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined, ends = "".join(texts), np.cumsum(lengths)
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = word_starts(codes, (ends - lengths)[lengths > 0], vocabulary.classes)
    places = starts.tolist()
    words = [joined[a:b] for a, b in zip(places, [*places[1:], len(joined)])]
    return words, np.searchsorted(starts, ends)


# --- words ---


class Prefixes:
    """The last token of every prefix of a word that may grow and change."""

    def __init__(self, vocabulary: BytePairs, word: bytes = b""):
        self.vocabulary = vocabulary
        self.word = bytearray()
        # Entry i: rank and length of the last token of the first i bytes.
        self.last: list[tuple[int, int]] = [(-1, 0)]
        self._checked: dict[tuple[int, int], bool] = {}
        self.append(word)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; prefixes that are there stay."""
        self.word += more
        self._extend(len(self.word), None)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts bytes in place of [start, end); returns how many prefixes were found anew."""
        after, tail = self.last[end + 1 :], len(self.word) - end
        self.word[start:end] = new
        del self.last[start + 1 :]
        return self._extend(len(self.word), after, len(self.word) - tail)

    def _extend(self, size: int, after: list | None, fixed: int = 0) -> int:
        """Finds entries up to `size`. Behind `fixed` the bytes are those that `after` was found for:
        once as many entries as the longest token has bytes are as before, all others are too."""
        first = len(self.last)
        same = 0
        while len(self.last) <= size:
            at = len(self.last)
            self.last.append(self._last_token(at))
            if after and at > fixed:
                same = same + 1 if self.last[at] == after[at - fixed - 1] else 0
                if same >= self.vocabulary.longest:
                    self.last += after[at - fixed :]
                    return at - first + 1
        return size - first + 1

    def _last_token(self, end: int) -> tuple[int, int]:
        base, check, value = self.vocabulary.walk
        word, last, checked = self.word, self.last, self._checked
        node, at, reach = 0, end, len(check)
        while at:
            at -= 1
            after = base[node] + word[at] + 1
            if after >= reach or check[after] != node:
                break
            node = after
            token = value[node]
            if token >= 0:
                pair = (last[at][0], token)
                valid = checked.get(pair)
                if valid is None:
                    valid = checked[pair] = pair[0] < 0 or self.vocabulary.beside(*pair)
                if valid:
                    return token, end - at
        raise ValueError("no token ends here")

    def ids(self) -> list[int]:
        """The tokens of the whole word."""
        whole = self.vocabulary.ranks.get(bytes(self.word))
        if whole is not None:
            return [whole]
        found, end = [], len(self.word)
        while end:
            token, length = self.last[end]
            found.append(token)
            end -= length
        return found[::-1]


def _encode_rows(vocabulary: BytePairs, rows: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Ids, as 32-bit numbers in bytes, of words that are rows of bytes; all advance together."""
    base, check, value = vocabulary.trie.base, vocabulary.trie.check, vocabulary.trie.value
    n, width = rows.shape
    last = np.full((n, width + 1), -1, np.int32)
    begin = np.zeros((n, width + 1), np.int8)
    for start in range(width):
        active = np.flatnonzero(lengths > start)
        if not len(active):
            break
        node = np.zeros(len(active), np.int64)
        ends, words, tokens = [], [], []
        for end in range(start + 1, width + 1):
            after = base[node] + rows[active, end - 1] + 1
            fits = (check[after] == node) & (lengths[active] >= end)
            active, node = active[fits], after[fits].astype(np.int64)
            if not len(active):
                break
            token = value[node]
            found = np.flatnonzero(token >= 0)
            words.append(active[found])
            tokens.append(token[found])
            ends.append(np.full(len(found), end))
        word, token, end = np.concatenate(words), np.concatenate(tokens).astype(np.int64), np.concatenate(ends)
        if start:
            valid = vocabulary.adjacent(last[word, start].astype(np.int64), token)
            word, token, end = word[valid], token[valid], end[valid]
        last[word, end], begin[word, end] = token, start
    every, end, steps = np.arange(n), lengths.copy(), []
    while end.any():
        steps.append(np.where(end > 0, last[every, end], -1))
        end = begin[every, end]
    ids = np.stack(steps[::-1], axis=1).astype(np.int32)
    packed, row = ids.tobytes(), 4 * ids.shape[1]
    skipped = 4 * (ids < 0).sum(axis=1)
    return [packed[k * row + skip : (k + 1) * row] for k, skip in enumerate(skipped.tolist())]


class Encoder:
    """Ids of texts; short words that were met are kept, up to a bound in bytes."""

    def __init__(self, vocabulary: BytePairs, remembered: int = REMEMBERED):
        self.vocabulary = vocabulary
        self.known = Remembered(
            remembered, lambda words: self.encode_words([w.encode("utf-8", "replace") for w in words])
        )

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of different words, as 32-bit numbers in bytes."""
        vocabulary = self.vocabulary
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words) + bytes(WIDTHS[-1]), np.uint8)
        below = 0
        for width in WIDTHS:
            group = np.flatnonzero((lengths > below) & (lengths <= width))
            below = width
            if len(group):
                rows = flat[starts[group][:, None] + np.arange(width)]
                for k, ids in zip(group.tolist(), _encode_rows(vocabulary, rows, lengths[group])):
                    out[k] = ids
        for k in np.flatnonzero(lengths > below).tolist():
            out[k] = np.array(Prefixes(vocabulary, words[k]).ids(), np.int32).tobytes()
        if vocabulary.whole_only:
            for k, word in enumerate(words):
                if word in vocabulary.whole_only:
                    out[k] = vocabulary.whole_only[word].to_bytes(4, "little")
        return out

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of texts as 32-bit numbers in bytes; none for NULL and empty texts."""
        if any(text is not None and len(text) > SEGMENT for text in texts):
            return [self._encode_long(text) for text in texts]
        words, ends = split_words([text or "" for text in texts], self.vocabulary)
        found = self.known.look_up(words)
        places = [0, *ends.tolist()]
        return [b"".join(found[a:b]) for a, b in zip(places, places[1:])]

    def _encode_long(self, text: str | None) -> bytes:
        """A text by segments. What a match takes depends on what follows it: the last two
        matches of a segment are taken again with the next one."""
        text, out, at, width = text or "", [], 0, SEGMENT
        while at < len(text):
            part = text[at : at + width]
            words, _ = split_words([part], self.vocabulary)
            if at + width < len(text):
                words = words[:-2]
            if not words:
                width *= 2
                continue
            out += self.known.look_up(words)
            at, width = at + sum(map(len, words)), SEGMENT
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()


class EncodedText:
    """A text and its ids that follow edits: only words that an edit can reach are split anew.

    A word that the edit touches keeps the prefixes before it.
    """

    def __init__(self, vocabulary: BytePairs, text: str = ""):
        self.vocabulary, self.text = vocabulary, text
        words, _ = split_words([text], vocabulary)
        self.words = [Prefixes(vocabulary, w.encode()) for w in words]
        self.ends = np.cumsum([len(w) for w in words]).tolist()

    def ids(self) -> list[int]:
        return [token for word in self.words for token in word.ids()]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts `new` in place of characters [start, end); returns how many words were encoded anew.

        A match looks at most two characters beyond its end, and nothing before its
        beginning. So words that end two characters before the edit stay, and from the
        first split behind it that was one before, all do.
        """
        grown = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = 0
        while first < len(self.ends) and self.ends[first] + 2 <= start:
            first += 1
        begin = self.ends[first - 1] if first else 0
        before = {e: k for k, e in enumerate(self.ends)}
        words, ends, at, rest = [], [], begin, len(self.words)
        for found in regex.finditer(self.vocabulary.pattern, self.text[begin:]):
            word = found.group()
            at += len(word)
            words.append(word)
            ends.append(at)
            if at >= start + len(new) and at - grown in before:
                rest = before[at - grown] + 1
                break
        changed = []
        for k, word in enumerate(words):
            data = word.encode()
            prefixes = self.words[first + k] if first + k < rest and k == 0 else Prefixes(self.vocabulary)
            _turn_into(prefixes, data)
            changed.append(prefixes)
        self.words[first:rest] = changed
        self.ends[first:] = ends + [e + grown for e in self.ends[rest:]]
        return len(changed)


def _turn_into(prefixes: Prefixes, data: bytes) -> None:
    """Changes the least stretch that makes the word equal to the data."""
    old = bytes(prefixes.word)
    most = min(len(old), len(data))
    head = 0
    while head < most and old[head] == data[head]:
        head += 1
    tail = 0
    while tail < most - head and old[-1 - tail] == data[-1 - tail]:
        tail += 1
    prefixes.replace(head, len(old) - tail, data[head : len(data) - tail])


class Decoder:
    """Bytes of ids; ids outside the vocabulary become U+FFFD."""

    def __init__(self, vocabulary: BytePairs):
        surface = ["\ufffd".encode()] * (vocabulary.size + 1)
        for token, rank in vocabulary.ranks.items():
            surface[rank] = token
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.lengths = np.fromiter(map(len, surface), np.int64, len(surface))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.size = vocabulary.size

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for part in np.split(ids, range(SEGMENT, len(ids), SEGMENT)):
            known = np.where((part >= 0) & (part < self.size), part, self.size)
            lengths = self.lengths[known]
            ends = np.cumsum(lengths)
            # Every byte of the text: where its token starts, and how far it is within it.
            at = np.repeat(self.starts[known] - ends + lengths, lengths)
            out.append(self.flat[at + np.arange(len(at))].tobytes())
        return b"".join(out)


# --- rows ---


def _replaced(docs: DataFrame, new: dict[str, str]) -> tuple[list[str], T.StructType]:
    """Columns that pass by, and the schema with the new ones; names differ in more than case."""
    lowered = {name.lower() for name in new}
    fields = [f for f in docs.schema.fields if f.name.lower() not in lowered]
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in new.items()]
    return [f.name for f in fields], T.StructType(fields + more)


def encode_byte_pairs(
    docs: DataFrame,
    vocabulary: BytePairs,
    text: str = "text",
    ids: str = "token_ids",
    decoded: str | None = None,
) -> DataFrame:
    """The rows with the ids of the whole text as an array and, if named, the bytes they decode to.

    NULL and empty texts have no ids and no bytes. Repeated rows get equal ids; an
    empty table gives an empty result. Very long texts are split a segment at a time.
    A column that is called like a new one, in any case, is replaced; the text column
    itself may not be.
    """
    new = {ids: "array<int>"} | ({decoded: "binary"} if decoded else {})
    if text.lower() in {name.lower() for name in new}:
        raise ValueError("the new columns need names of their own")
    kept, schema = _replaced(docs, new)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for part in by_bytes(batches, text):
            found = encoder.encode_many(part.column(text).to_pylist())
            ends = np.cumsum([0, *(len(i) // 4 for i in found)]).astype(np.int32)
            columns = [part.column(c) for c in kept]
            columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(found), np.int32)))
            if decoded:
                columns.append(pa.array([decoder.decode(np.frombuffer(i, np.int32)) for i in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return docs.mapInArrow(work, schema)


def decode_byte_pairs(
    docs: DataFrame, vocabulary: BytePairs, ids: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """The rows with the bytes of their ids; none for NULL and empty arrays."""
    kept, schema = _replaced(docs, {decoded: "binary"})
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.column(ids).to_pylist()
                found = [decoder.decode(np.array(row or [], np.int64)) for row in rows]
                columns = [*(part.column(c) for c in kept), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, decoded])

    return docs.mapInArrow(work, schema)
