"""SentencePiece encoding and decoding with seeded merge-dropout.

Merges never cross the units between spaces, so texts are encoded unit by unit. An agenda
holds the merges that are possible, best first; one that a keyed hash picks is skipped.
The key is the seed, the document, the place of the unit in it, and the candidate: where in
the unit it starts, where its two parts meet, and the piece that it would make. So every candidate of every
occurrence has a draw of its own. Short units are taken many at a time: the agenda of each is a column of arrays, and every step
draws and merges the best candidate of all of them. Long units have a heap each. Nothing is kept between units, so memory is bounded.
Without dropout the result is the library's, which reads a literal U+2581 as a space; with it,
that mark is spelled in bytes, so every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.base import text_batches
from kvspark.llm.words import mix, per_worker

#: Units whose agendas are worked off together, and characters of text that are taken together.
TOGETHER, CHARS = 1 << 14, 1 << 20
#: Longest unit, in characters, of each group of short ones; longer ones have a heap.
SIZES = (4, 7, 10, 14, 20, 30, 48)
_MASK = (1 << 64) - 1
_START, _SPLIT, _PIECE, _UNIT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93
_SLOTS, _SLOT = 20, 0x9E3779B97F4A7C15
_PLACE, _NEVER = 6, np.int32((1 << 31) - 1)
UNIT = re.compile(r" *[^ \n]+|\n| +")
MARK = "\u2581"


class Pieces:
    """A merge-type model with byte fallback: its pieces, scores and byte ids."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.strings = [library.id_to_piece(i) for i in range(n)]
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        scores = {self.strings[i]: (library.get_score(i), i) for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
        places = {score: k for k, score in enumerate(sorted({-s for s, _ in scores.values()}))}
        self.ids = {piece: i for piece, (_, i) in scores.items()}
        self.ranks = {piece: places[-score] for piece, (score, _) in scores.items()}  # 0 is merged first
        self.plain = [b"" if library.is_control(i) else self.bytes_of.get(i, self.strings[i].replace("\u2581", " ").encode()) for i in range(n)]

    def merge(self, unit: str, dropout: float = 0.0, key: int = 0, at: int = 0) -> list[int]:
        """Ids of one unit, spaces already written as U+2581. Of merges of one rank the leftmost comes first.

        ``key`` is that of the unit's occurrence, ``at`` the place of ``unit`` in it.
        """
        return self.ids_of(self._by_heap(unit, int(dropout * 2**64), (key + at * _START) & _MASK))

    def ids_of(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            found = self.ids.get(part)
            if found is None:
                out += [self.byte_ids[b] for b in part.encode()]
            else:
                out.append(found)
        return out

    def _skipped(self, keyed: int, start: int, split: int, joined: str, limit: int) -> bool:
        """The draw of a candidate; ``split`` is the length of its left part."""
        x = (keyed + start * _START + split * _SPLIT + self.ids[joined] * _PIECE) & _MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK  # the same as words.mix
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
        return x ^ x >> 31 < limit

    def _by_heap(self, unit: str, limit: int, keyed: int) -> list[str]:
        parts: list[str | None] = list(unit)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                joined = parts[a] + parts[b]
                rank = self.ranks.get(joined)
                if rank is not None:
                    heapq.heappush(agenda, (rank, a, b, joined))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, joined = heapq.heappop(agenda)
            if parts[a] is None or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != len(joined):
                continue
            if limit and self._skipped(keyed, a, len(parts[a]), joined, limit):
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def decode(self, ids) -> str:
        """The text of the ids; the space that encoding put in front is taken away."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode()
        return text[1:] if text.startswith(" ") else text


class Agendas:
    """The merges of many short units at a time, on arrays. Symbols are piece ids, further numbers for characters that only occur inside pieces, or -1."""

    def __init__(self, pieces: Pieces, dropout: float):
        self.limit = np.uint64(min(int(dropout * 2**64), _MASK))
        n = len(pieces.strings)
        letters = sorted({c for p in pieces.ids for c in p} - set(pieces.ids))
        numbers = pieces.ids | {c: n + k for k, c in enumerate(letters)}
        self.symbols = np.full(0x110000, -1, np.int32)
        for c, number in numbers.items():
            if len(c) == 1:
                self.symbols[ord(c)] = number
        self.symbols[ord(" ")] = self.symbols[ord(MARK)]
        if dropout:  # the mark itself would decode as a space; its bytes do not
            self.symbols[ord(MARK)] = -1
        self.n = n
        self.ranks = np.full(n + 1, 1 << (30 - _PLACE), np.int32)  # the last, which -1 finds, is of no piece
        for p, i in pieces.ids.items():
            self.ranks[i] = pieces.ranks[p]
        # every way to make a piece of two parts, in open addressing
        self.keys, self.made = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        for p, i in pieces.ids.items():
            for k in range(1, len(p)):
                left, right = numbers.get(p[:k]), numbers.get(p[k:])
                if left is not None and right is not None:
                    key = (left + 1) << 32 | (right + 1)
                    slot = (key * _SLOT & _MASK) >> (64 - _SLOTS)
                    while self.keys[slot]:
                        slot = (slot + 1) & ((1 << _SLOTS) - 1)
                    self.keys[slot], self.made[slot] = key, i

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = (left + 1).astype(np.uint64) << np.uint64(32) | (right + 1).astype(np.uint64)
        slot = (key * np.uint64(_SLOT) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == key, self.made[slot], -1)
        rest = np.flatnonzero((held != key) & (held != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << _SLOTS) - 1)
            held = self.keys[slot[rest]]
            hit = held == key[rest]
            out[rest[hit]] = self.made[slot[rest[hit]]]
            rest = rest[~hit & (held != 0)]
        return out

    def merge(self, letters: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For units of up to as many letters as ``letters`` has rows, one a column: the symbols that remain, at the places where they start, and which places are dead (True)."""
        height, width = letters.shape
        place = np.arange(height, dtype=np.int32)[:, None]
        inside = place < sizes
        symbol = np.where(inside, self.symbols[letters], -1)
        made = np.full((height + 1, width), -1, np.int32)
        if height > 1:
            both = inside[1:]
            made[: height - 1][both] = self.joined(symbol[:-1][both], symbol[1:][both])
        done, dead = symbol.copy(), ~inside
        column = np.arange(width)
        # a sentinel row below takes what falls off either end
        symbol = np.concatenate([symbol, np.full((1, width), -1, np.int32)])
        after = np.broadcast_to(np.minimum(place + 1, height), (height, width))
        after = np.concatenate([np.where(place + 1 < sizes, after, height), np.full((1, width), height)]).astype(np.int32)
        before = np.concatenate([np.broadcast_to(np.where(place > 0, place - 1, height), (height, width)), np.full((1, width), height)]).astype(np.int32)
        order = np.where(made >= 0, self.ranks[made] << _PLACE | np.arange(height + 1, dtype=np.int32)[:, None], _NEVER)
        gone = np.zeros((height + 1, width), bool)
        symbol, made, after, before, order = map(np.ascontiguousarray, (symbol, made, after, before, order))  # flat views of them are written to
        while True:
            best = np.minimum.reduce(order, axis=0)
            live = best != _NEVER
            alive = int(np.count_nonzero(live))
            if alive < 0.7 * len(column) or not alive:
                over = np.flatnonzero(~live)
                done[:, column[over]], dead[:, column[over]] = symbol[:-1, over], gone[:-1, over] | (dead[:, column[over]])
                keep = np.flatnonzero(live)
                if not len(keep):
                    return done, dead
                symbol, made, after, before, order, gone = (np.ascontiguousarray(x[:, keep]) for x in (symbol, made, after, before, order, gone))
                column, best, live = column[keep], best[keep], live[keep]
            width = len(column)
            r = np.flatnonzero(live)
            symbols, mades, afters, befores, orders = (x.reshape(-1) for x in (symbol, made, after, before, order))
            start = (best[r] & ((1 << _PLACE) - 1)).astype(np.int64)
            at = start * width + r
            piece, second = mades[at], afters[at].astype(np.int64)
            if self.limit:
                code = start.astype(np.uint64) * np.uint64(_START) + (second - start).astype(np.uint64) * np.uint64(_SPLIT) + piece.astype(np.uint64) * np.uint64(_PIECE)
                skip = mix(code + keys[column[r]]) < self.limit
                orders[at[skip]] = _NEVER
                stays = ~skip
                r, start, at, piece, second = r[stays], start[stays], at[stays], piece[stays], second[stays]
            old = second * width + r
            symbols[at] = piece
            gone.reshape(-1)[old] = True
            orders[old] = _NEVER
            third = afters[old].astype(np.int64)
            afters[at] = third
            third_at = third * width + r
            befores[third_at] = start
            first = befores[at].astype(np.int64)
            first_at = first * width + r
            right = self.joined(piece, symbols[third_at])
            mades[at] = right
            orders[at] = np.where(right >= 0, self.ranks[right] << _PLACE | start.astype(np.int32), _NEVER)
            left = self.joined(symbols[first_at], piece)
            mades[first_at] = left
            orders[first_at] = np.where((left >= 0) & (first < height), self.ranks[left] << _PLACE | first.astype(np.int32), _NEVER)


class Encoder:
    def __init__(self, path: str, dropout: float, seed: int):
        self.pieces, self.dropout, self.seed = Pieces(path), dropout, seed
        self.agendas = Agendas(self.pieces, dropout)
        self.bytes_of: dict[int, list[int]] = {}

    def encode(self, text: str, key: int) -> bytes:
        """Ids of a whole text, four bytes each. ``key`` is the document's."""
        return self.encode_all([text], [key])[0].tobytes()

    def _alone(self, unit: str, key: int) -> list[int]:
        """The ids of a long unit."""
        if not self.dropout or MARK not in unit:
            return self.pieces.merge(unit.replace(" ", MARK), self.dropout, key)
        ids, at = [], 0
        for part in re.split(f"({MARK})", unit):
            ids += [self.pieces.byte_ids[b] for b in part.encode()] if part == MARK else self.pieces.merge(part.replace(" ", MARK), self.dropout, key, at)
            at += len(part)
        return ids

    def _spelled(self, code: int) -> list[int]:
        return [self.pieces.byte_ids[b] for b in (MARK if code == 32 else chr(code)).encode()]

    def encode_all(self, texts: list[str], keys: list) -> list[np.ndarray]:
        """The ids of each text."""
        joined = "".join(" " + t for t in texts if t)
        letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes, counts, occurrences = [], [], [np.zeros(0, np.uint64)]
        for text, key in zip(texts, keys, strict=True):
            own = list(map(len, UNIT.findall(" " + text))) if text else []
            sizes += own
            counts.append(len(own))
            document = np.uint64(xxhash.xxh64_intdigest(str(key), self.seed))
            occurrences.append(mix(np.arange(len(own), dtype=np.uint64) * np.uint64(_UNIT) + document))
        size, drawn = np.array(sizes, np.int64), np.concatenate(occurrences)
        begin = np.cumsum(size) - size
        # what remains at each letter's place: a symbol, or nothing
        symbols, dead = np.full(len(letters), -1, np.int32), np.zeros(len(letters), bool)
        smaller = 0
        for height in SIZES:
            group = np.flatnonzero((size > smaller) & (size <= height))
            smaller = height
            for k in range(0, len(group), TOGETHER):
                some = group[k : k + TOGETHER]
                place = begin[some] + np.arange(height)[:, None]
                inside = np.arange(height)[:, None] < size[some]
                done, gone = self.agendas.merge(letters[np.minimum(place, len(letters) - 1)], size[some], drawn[some])
                symbols[place[inside]], dead[place[inside]] = done[inside], gone[inside]
        long: dict[int, list[int]] = {}
        for k in np.flatnonzero(size > SIZES[-1]).tolist():
            a, b = int(begin[k]), int(begin[k] + size[k])
            long[a] = self._alone(joined[a:b], int(drawn[k]))
            dead[a + 1 : b] = True
        # each place that is left gives one id, or the bytes of its letter, or a long unit
        alive = np.flatnonzero(~dead)
        ids, wide = symbols[alive], np.ones(len(alive), np.int64)
        odd = np.flatnonzero((ids < 0) | (ids >= self.agendas.n))
        spelled = []
        for k, a in zip(odd.tolist(), alive[odd].tolist(), strict=True):
            found = long.get(a)
            if found is None:
                code = int(letters[a])
                found = self.bytes_of.get(code)
                if found is None:
                    found = self.bytes_of[code] = self._spelled(code)
            spelled.append(found)
            wide[k] = len(found)
        out = np.repeat(ids, wide)
        starts = np.cumsum(wide) - wide
        for k, found in zip(odd.tolist(), spelled, strict=True):
            out[starts[k] : starts[k] + len(found)] = found
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        upto = np.concatenate([[0], np.cumsum(wide)])[np.searchsorted(alive, ends)]
        return [out[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHARS`` characters together."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHARS or k == len(texts) - 1:
            yield start, k + 1
            start, size = k + 1, 0


def encode(df: DataFrame, path: str, dropout: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256 (over the ids, four bytes each, little-endian), lossless, and ``ids`` if asked for.

    ``lossless`` says that the decoded ids are the text. Null and empty texts have no tokens. Rows with the same
    id and text are cut alike; a null id has the key of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("pieces", path, dropout, seed), lambda: Encoder(path, dropout, seed))
        for batch in batches:
            numbers, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in parts(texts):  # a part's rows go on before the next is encoded
                encoded = encoder.encode_all(texts[a:b], ["" if i is None else i for i in numbers[a : b].to_pylist()])
                columns = [
                    numbers[a:b],
                    pa.array([len(ids) for ids in encoded], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string()),
                    pa.array([encoder.pieces.decode(ids.tolist()) == text for ids, text in zip(encoded, texts[a:b], strict=True)], pa.bool_()),
                ]
                if with_ids:
                    columns.append(pa.array(encoded, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "lossless", "ids"][: 4 + with_ids]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, lossless boolean" + ", ids array<int>" * with_ids)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of an id array; null for null."""

    @F.pandas_udf("string")
    def texts(column):
        pieces = per_worker(("decode", path), lambda: Pieces(path))
        return column.map(lambda ids: None if ids is None else pieces.decode([int(i) for i in ids]))

    return df.withColumn(out, texts(F.col(ids_col)))
