"""Lengths of texts in tokens of a public tokenizer.

The tokenizer is a byte-level BPE given by a rank file (one base64 token and its
rank a line) and its split pattern; both are parameters. The split pattern cuts
before a blank, so the pieces between blanks are encoded once and remembered:
the sum of their lengths is the length of the text.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.llm.common import spread

VOCABULARY = os.environ.get("TEXTRILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECE = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")


@lru_cache(4)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts of texts, with a memory for pieces."""

    def __init__(self, path: str = VOCABULARY, memory: int = 400_000):
        self.encode = encoding(path).encode_ordinary
        self.memory = memory
        self.seen: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        for piece in _PIECE.findall(text):
            n = seen.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(seen) < self.memory:
                    seen[piece] = n
            total += n
        return total


def token_counts(docs: DataFrame, key: str, column: str, also: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """(key, *also, tokens): the token count of every row's text; null and empty texts have 0."""
    also = also or []

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            n = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([counter.count(t) for t in batch.column(n).to_pylist()], pa.int32())], [*batch.schema.names[:n], "tokens"])

    rows = spread(docs.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("string").alias(c) for c in also], F.col(column).alias("_text")))
    return rows.mapInArrow(run, ", ".join([f"`{key}` long", *[f"`{c}` string" for c in also], "tokens int"]))
