"""Token counts by a public byte-level tokenizer whose files are given by path."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
_RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(folder: str):
    """The tokenizer, and the length in bytes of each of its tokens."""
    import tiktoken

    with open(f"{folder}/{_RANKS}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(text: str, folder: str = TOKENIZERS) -> np.ndarray:
    return encoder(folder)[0].encode_to_numpy(text, disallowed_special=())


def token_counts(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), folder: str = TOKENIZERS) -> DataFrame:
    """The ``keep`` columns and n_tokens LONG of every row; null and empty texts have 0. Whole texts, in Arrow batches;
    only the counts leave the worker. The same text in one batch is counted once."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)[0]
        for b in batches:
            seen: dict[str | None, int] = {None: 0, "": 0}
            out = []
            for t in b.column(b.num_columns - 1).to_pylist():
                n = seen.get(t)
                if n is None:
                    n = seen[t] = len(enc.encode_to_numpy(t, disallowed_special=()))
                out.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return kept.mapInArrow(run, schema)
