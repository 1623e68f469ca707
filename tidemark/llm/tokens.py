"""Token counts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public tokenizer parts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 100_000
CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut before single spaces between words, where the tokenizer parts words anyway; so counts add up exactly."""
    out, at = [], 0
    while len(text) - at > size:
        m = CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def with_token_counts(rows: DataFrame, keep: list[str | Column], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row; whole texts, 0 for null.  Texts reach the tokenizer in pieces of bounded size.

    ``tokenizer`` is a file of byte-pair ranks, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            counts = [sum(len(encode(p)) for p in pieces(t.as_py() or "")) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    rows = rows.select(*keep, text)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", n_tokens bigint")
