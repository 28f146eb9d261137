"""Token counts with a two-tier lookup on the map side.

The first tier is a table of the token counts of common pre-tokens, those that the
vocabulary itself spells out; it is bounded by the vocabulary, compact, and sent to every executor.
What it lacks is encoded once and kept in a bounded cache of the Python worker. No
pre-token is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm.words import per_worker

# The pre-token pattern of the vocabulary, with white space by its Unicode property.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Texts with characters outside these scripts are encoded whole: libraries may differ on newer letters.
ODD = re.compile("[^\u0000-ԯḀ-῿ -⁯₠-₿℀-⅏←-⏿　-ヿ㐀-䶵一-龥가-힣＀-￯]")
CACHE = 300_000


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def common_lengths(path: str) -> bytes:
    """The first tier: pre-tokens among the strings of the vocabulary and the number of tokens of each, compressed."""
    tokenizer = load(path)
    strings = sorted({tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size(with_added_tokens=False))})
    pieces = [s for s in strings if s and "\ufffd" not in s and "\x00" not in s and PRE_TOKEN.fullmatch(s) and PRE_TOKEN.findall(s) == [s]]
    sizes = [len(e.ids) for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    kept = [(s, n) for s, n in zip(pieces, sizes, strict=True) if n < 256]
    return zlib.compress("\x00".join(s for s, _ in kept).encode() + b"\x00\x00" + bytes(n for _, n in kept))


class Lengths(dict):
    """Both tiers of one worker."""

    def __init__(self, packed: bytes, path: str):
        text, _, sizes = zlib.decompress(packed).rpartition(b"\x00\x00")
        self.table = dict(zip(text.decode().split("\x00"), sizes, strict=True)) if sizes else {}
        super().__init__(self.table)
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE + len(self.table):
            self.clear()
            self.update(self.table)
        self[piece] = n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n

    def count(self, text: str) -> int:
        if not text.isascii() and ODD.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.split is None:
            return sum(map(self.__getitem__, PRE_TOKEN.findall(text)))
        parts = self.split.split(text)  # the library takes its special strings out first; each is one token
        return len(parts) - 1 + sum(sum(map(self.__getitem__, PRE_TOKEN.findall(p))) for p in parts)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). Null texts count as empty: 0 of each."""
    sent = df.sparkSession.sparkContext.broadcast(common_lengths(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = per_worker(("lengths", path), lambda: Lengths(sent.value, path))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            arrays = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([lengths.count(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
