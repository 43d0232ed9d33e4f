"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Blanks become the marker U+2581 and one marker is put in front. No piece of the
vocabulary has a marker after another character, so the best segmentation of a
text is made of the best ones of its words, each with the markers in front of it.
Words are cut by Viterbi on the log scores of the pieces, the new words of a batch
together in numpy; a character that no piece covers is written as its UTF-8 bytes.
Each Python worker keeps short words that it has cut, up to a bound in bytes. One
narrow pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from labmesh.llm.common import add_column, by_bytes
from labmesh.llm.remembered import Remembered

MARKER = "▁"
# Bytes of words and ids that a worker keeps, with what Python adds to each.
REMEMBERED = 64 << 20
UNKNOWN_PENALTY = 10.0
# Words of similar length in bytes are cut together; longer ones one by one.
WIDTHS = (8, 12, 16, 24, 32, 64)

# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class DoubleArray:
    """A trie over bytes in two arrays: child = base[node] + byte + 1, check[child] = node."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, words: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, value in words.items():
            node = 0
            for byte in word:
                after = children[node].get(byte)
                if after is None:
                    after = children[node][byte] = len(children)
                    children.append({})
                node = after
            ends[node] = value
        size = 2 * len(children) + 1024
        base = np.zeros(size, np.int32)
        check = np.full(size, -1, np.int32)
        value = np.full(size, -1, np.int32)
        check[0] = 0
        used = bytearray(size)
        used[0] = 1
        from_here = 1
        queue, at = [(0, 0)], 0
        while at < len(queue):
            node, place = queue[at]
            at += 1
            value[place] = ends.get(node, -1)
            own = sorted(children[node])
            if not own:
                continue
            # The first spot where all children fit; crowded regions are not tried again.
            spot, taken, begun = max(own[0] + 1, from_here), 0, None
            while True:
                if spot + 512 > len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    base = np.concatenate([base, np.zeros(more, np.int32)])
                    check = np.concatenate([check, np.full(more, -1, np.int32)])
                    value = np.concatenate([value, np.full(more, -1, np.int32)])
                if used[spot]:
                    taken += 1
                else:
                    begun = begun or spot
                    start = spot - own[0] - 1
                    if not any(used[start + byte + 1] for byte in own):
                        break
                spot += 1
            if taken >= 0.9 * (spot - begun + 1):
                from_here = spot
            elif own[0] + 1 <= from_here:
                from_here = begun
            base[place] = start
            for byte in own:
                spot = start + byte + 1
                used[spot] = 1
                check[spot] = place
                queue.append((children[node][byte], spot))
        end = max(np.flatnonzero(np.frombuffer(used, np.uint8))) + 258
        return cls(base[:end], check[:end], value[:end])


@dataclass(frozen=True)
class Pieces:
    """A vocabulary ready for tasks: the trie, the scores and the bytes of every id."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    surface: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    add_prefix: bool


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = found = 0
        while True:
            byte = data[at]
            at += 1
            found |= (byte & 127) << shift
            if byte < 128:
                return found
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = number()
            yield key >> 3, data[at : at + size]
            at += size


def load_pieces(path: str) -> Pieces:
    """Read a model file of the driver. Its size is that of a vocabulary, not of the data.

    The scores of the file serve as log scores, whatever model it was made for.
    Vocabularies that rewrite characters first, or that have a marker inside a
    piece, are refused, since cutting by words would not be exact for them.
    """
    with open(path, "rb") as file:
        data = file.read()
    words, scores, surface, byte_ids, unknown, prefix = {}, [], [], {}, 0, True
    for field, value in _fields(data):
        if field == 1:
            parts = dict(_fields(value))
            text = parts.get(1, b"").decode()
            kind = parts.get(3, NORMAL)
            score = float(np.frombuffer(parts[2], "<f4")[0]) if 2 in parts else 0.0
            if MARKER in text.lstrip(MARKER):
                raise ValueError(f"piece with a marker inside: {text!r}")
            id = len(scores)
            scores.append(score)
            surface.append(text.replace(MARKER, " ").encode() if kind == NORMAL else b"")
            if kind == NORMAL or kind == USER_DEFINED:
                words[text.encode()] = id
                surface[id] = text.replace(MARKER, " ").encode()
            elif kind == UNKNOWN:
                unknown = id
            elif kind == BYTE:
                byte_ids[int(text[1:-1], 16)] = id
                surface[id] = bytes([int(text[1:-1], 16)])
        elif field == 3:
            rules = dict(_fields(value))
            prefix = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("only vocabularies that keep all characters and blanks are read")
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no piece for every byte")
    trie = DoubleArray.build(words)
    ids = tuple(byte_ids[b] for b in range(256))
    return Pieces(
        trie.base, trie.check, trie.value, np.array(scores), tuple(surface), ids, unknown, prefix
    )


# Bytes of the character that a byte begins; 0 within a character.
_SPAN = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16)


class Encoder:
    """Ids of texts; remembers the words that it has cut, up to a bound in bytes."""

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED):
        self.pieces = pieces
        self.known = Remembered(remembered, self._cut_all)
        # Python lists answer single reads faster than arrays.
        self.base, self.check = pieces.base.tolist(), pieces.check.tolist()
        self.value, self.scores = pieces.value.tolist(), pieces.scores.tolist()
        lowest = min((self.scores[i] for i in self.value if i >= 0), default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        # A lone marker in the text is an empty word and is written as bytes.
        self.marker = np.array([pieces.byte_ids[b] for b in MARKER.encode()], np.int32).tobytes()
        # Control characters that no piece has are cut off: they stand alone in any cut.
        used = set(b"".join(pieces.surface[i] for i in pieces.value[pieces.value >= 0].tolist()))
        alone = "".join(c for c in "\t\n\r" if ord(c) not in used)
        self.chunk = re.compile(
            (f"[{alone}]|" if alone else "") + f"{MARKER}*[^{MARKER}{alone}]+|{MARKER}+"
        )

    def cut(self, word: str) -> list[int]:
        """Viterbi over the bytes of one word; of equal sums the first found counts."""
        data = word.encode()
        size = len(data)
        base, check, value, scores = self.base, self.check, self.value, self.scores
        reach = len(check)
        best = [-float("inf")] * (size + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (size + 1)
        start = 0
        while start < size:
            first = data[start]
            width = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            here, node, whole = best[start], 0, False
            for at in range(start, size):
                after = base[node] + data[at] + 1
                if after >= reach or check[after] != node:
                    break
                node = after
                id = value[node]
                if id >= 0:
                    score = here + scores[id]
                    if score > best[at + 1]:
                        best[at + 1] = score
                        back[at + 1] = (start, id)
                    whole = whole or at + 1 - start == width
            if not whole and here + self.unknown_score > best[start + width]:
                best[start + width] = here + self.unknown_score
                back[start + width] = (start, -1)
            start += width
        ids: list[int] = []
        end = size
        while end:
            start, id = back[end]
            if id >= 0:
                ids.append(id)
            else:
                ids.extend(self.pieces.byte_ids[b] for b in reversed(data[start:end]))
            end = start
        ids.reverse()
        return ids

    def cut_many(self, words: Sequence[str]) -> list[bytes]:
        """The same for many words, ids as 32-bit numbers in bytes.

        All words of similar length advance together in numpy.
        """
        out = [b""] * len(words)
        data = [word.encode() for word in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        below, alone = 0, []
        for width in WIDTHS:
            group = np.flatnonzero((lengths > below) & (lengths <= width))
            below = width
            if len(group):
                rows = np.frombuffer(b"".join([data[k].ljust(width, b"\0") for k in group]), np.uint8)
                found = self._cut_rows(rows.reshape(len(group), width), lengths[group])
                for k, ids in zip(group.tolist(), found):
                    if ids is None:
                        alone.append(k)
                    else:
                        out[k] = ids
        for k in [*alone, *np.flatnonzero(lengths > below).tolist()]:
            out[k] = np.array(self.cut(words[k]), np.int32).tobytes()
        return out

    def _cut_rows(self, rows: np.ndarray, lengths: np.ndarray) -> list[bytes | None]:
        """Viterbi over rows of bytes, one start at a time; None for words with unknown characters."""
        base, check, value, scores = self.pieces.base, self.pieces.check, self.pieces.value, self.pieces.scores
        n, width = rows.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.full((n, width + 1), -1, np.int32)
        begin = np.zeros((n, width + 1), np.int64)
        spans = _SPAN[rows]
        for start in range(width):
            # Characters begin where a byte is not a continuation.
            words = np.flatnonzero((spans[:, start] > 0) & (lengths > start))
            if not len(words):
                continue
            whole = np.zeros(n, bool)
            active, node, here = words, np.zeros(len(words), np.int64), best[words, start]
            for end in range(start + 1, width + 1):
                after = base[node] + rows[active, end - 1] + 1
                fits = (check[after] == node) & (lengths[active] >= end)
                active, node, here = active[fits], after[fits].astype(np.int64), here[fits]
                if not len(active):
                    break
                id = value[node]
                piece = id >= 0
                at, id, score = active[piece], id[piece], here[piece] + scores[id[piece]]
                whole[at[spans[at, start] == end - start]] = True
                better = score > best[at, end]
                at = at[better]
                best[at, end], back[at, end], begin[at, end] = score[better], id[better], start
            lost = words[~whole[words]]
            end = start + spans[lost, start]
            score = best[lost, start] + self.unknown_score
            better = score > best[lost, end]
            lost, end = lost[better], end[better]
            best[lost, end], back[lost, end], begin[lost, end] = score[better], -1, start
        every, end = np.arange(n), lengths.copy()
        steps, unknown = [], np.zeros(n, bool)
        while end.any():
            id = np.where(end > 0, back[every, end], -2)
            unknown |= id == -1
            steps.append(id)
            end = begin[every, end]
        ids = np.stack(steps[::-1], axis=1).astype(np.int32)
        packed, row = ids.tobytes(), 4 * ids.shape[1]
        skipped = 4 * (ids == -2).sum(axis=1)
        return [
            None if lost else packed[k * row + skip : k * row + row]
            for k, (skip, lost) in enumerate(zip(skipped.tolist(), unknown.tolist()))
        ]

    def _words(self, text: str | None) -> list[str]:
        """The words of a text, with a marker of its own as a lone empty word."""
        if not text:
            return []
        text = text.encode("utf-8", "replace").decode()
        out: list[str] = []
        for k, part in enumerate(text.split(MARKER)):
            if k:
                out.append("")
            elif self.pieces.add_prefix:
                part = " " + part
            out.extend(self.chunk.findall(part.replace(" ", MARKER)))
        return out

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of texts as 32-bit numbers in bytes; none for NULL and empty texts.

        A marker that stands in the text itself is written as bytes, so that
        decoding does not turn it into a blank. Half surrogates become "?".
        """
        split = [self._words(text) for text in texts]
        ends = np.cumsum([0, *map(len, split)]).tolist()
        found = self.known.look_up([word for words in split for word in words])
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]

    def _cut_all(self, words: list[str]) -> list[bytes]:
        return [ids if word else self.marker for word, ids in zip(words, self.cut_many(words))]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()


class Decoder:
    """Texts of ids: markers as blanks, without the one in front; control pieces are silent.

    Bytes that are no UTF-8 become U+FFFD, as do ids outside the vocabulary.
    """

    def __init__(self, pieces: Pieces):
        surface = [*pieces.surface, "\ufffd".encode()]
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.lengths = np.fromiter(map(len, surface), np.int64, len(surface))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.size, self.add_prefix = len(pieces.surface), pieces.add_prefix

    def decode(self, ids: np.ndarray) -> str:
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        lengths = self.lengths[known]
        ends = np.cumsum(lengths)
        # Every byte of the text: where its piece starts, and how far it is within it.
        at = np.repeat(self.starts[known] - ends + lengths, lengths)
        data = self.flat[at + np.arange(len(at))].tobytes()
        if self.add_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def decode_ids(pieces: Pieces, ids) -> str:
    return Decoder(pieces).decode(np.array(ids, np.int64))


def _shared(spark: SparkSession, pieces: Pieces):
    return spark.sparkContext.broadcast(pieces)


def encode_pieces(
    docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "token_ids"
) -> DataFrame:
    """The rows with the ids of the whole text as an array; empty for NULL and empty texts.

    A column that is called like the new one is replaced. Repeated rows get equal
    ids; an empty table gives an empty result.
    """
    shared = _shared(docs.sparkSession, pieces)

    def start():
        encoder = Encoder(shared.value)

        def convert(texts: pa.Array) -> pa.Array:
            found = encoder.encode_many(texts.to_pylist())
            ends = np.cumsum([0, *(len(ids) // 4 for ids in found)]).astype(np.int32)
            return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(found), np.int32))

        return convert

    return add_column(docs, text, ids, "array<int>", pa.list_(pa.int32()), start)


def decode_pieces(
    docs: DataFrame, pieces: Pieces, ids: str = "token_ids", text: str = "decoded"
) -> DataFrame:
    """The rows with the text of their ids; empty for NULL and empty arrays."""
    shared = _shared(docs.sparkSession, pieces)

    def start():
        decoder = Decoder(shared.value)

        def convert(rows: pa.Array) -> list[str]:
            values = rows.values.to_numpy(zero_copy_only=False)
            ends = rows.offsets.to_numpy()
            present = rows.is_valid().to_pylist()
            return [
                decoder.decode(values[a:b]) if there else ""
                for a, b, there in zip(ends[:-1].tolist(), ends[1:].tolist(), present)
            ]

        return convert

    return add_column(docs, ids, text, "string", pa.string(), start)


def encode_round_trip(
    docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "token_ids", same: str = "round_trip"
) -> DataFrame:
    """The rows with the ids of the whole text in place of the text, and whether they decode to it.

    One pass in one worker: the decoded text is compared where it is made and not
    carried on. NULL and empty texts have no ids and come back. Columns that are called
    like the new ones are replaced; an empty table gives an empty result.
    """
    shared = _shared(docs.sparkSession, pieces)
    dropped = {text.lower(), ids.lower(), same.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in dropped]
    new = T.StructType.fromDDL(f"`{ids}` array<int>, `{same}` boolean")
    names = [f.name for f in kept] + [ids, same]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value, REMEMBERED // 2), Decoder(shared.value)
        for part in by_bytes(batches, text, 1 << 20):
            texts = part.column(text).to_pylist()
            found = encoder.encode_many(texts)
            ends = np.cumsum([0, *(len(i) // 4 for i in found)]).astype(np.int32)
            back = [decoder.decode(np.frombuffer(i, np.int32)) == (t or "") for i, t in zip(found, texts)]
            columns = [part.column(f.name) for f in kept]
            lists = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(back)], names=names)

    return docs.mapInArrow(work, T.StructType(kept + new.fields))
