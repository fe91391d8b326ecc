"""Texts above a token limit into pieces cut at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.llm.tokens import TOKENIZERS, encoder

# Kinds of boundary, the stronger the later; -1 is inside a character.
KINDS = ("none", "word", "sentence", "line", "paragraph", "section")
_BLANK_LINE = re.compile(rb"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+")
_HEADING = re.compile(rb"(?m)^(?:#{1,6} |={3,}|-{3,}|\*{3,}|[0-9]+(?:\.[0-9]+)*\.? +[A-Z][^\n.]{0,70}$|[A-Z][A-Z0-9 /&-]{3,60}\r?$)")
_WIDE_STOP = re.compile("。|！|？".encode())
#: Tokens by which a piece counted alone can exceed its count within the text; nearer pieces are counted again.
_EDGE = 4


def strengths(data: bytes) -> np.ndarray:
    """Kind of the boundary before each byte (and after the last), as an index of KINDS; -1 within a character."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    k = np.zeros(n + 1, np.int8)
    space = (a == 32) | (a == 9) | (a == 10) | (a == 13)
    k[:n][space] = 1
    k[1:][space] = 1
    stop = (a == 46) | (a == 33) | (a == 63)
    k[1:n][stop[:-1] & space[1:]] = 2
    for m in _WIDE_STOP.finditer(data):
        k[m.end()] = 2
    newline = (a == 10) | (a == 13)
    if newline.any():
        at = np.flatnonzero(newline)
        k[at] = np.maximum(k[at], np.where((at > 0) & newline[at - 1], 0, 3))
        k[at + 1] = 3
        k[:n][(a == 10) & np.r_[False, a[:-1] == 13]] = 0  # within a two-byte line end
        for m in _BLANK_LINE.finditer(data):
            k[m.start()] = k[m.end()] = 4
        for m in _HEADING.finditer(data):
            k[m.start()] = 5
    k[:n][(a & 0xC0) == 0x80] = -1
    return k


def cuts(n: int, kind: np.ndarray, limit: int, overlap: int, n_pieces: int) -> list[tuple[int, int, int]] | None:
    """(start, end, kind of the end) in tokens of ``n_pieces`` pieces, or None if one exceeds the limit.

    ``kind``: kind of the boundary before each token. The targets give pieces of equal length; each is moved to the
    strongest boundary within a quarter of a step, of equal ones the nearest.
    """
    step = (n - overlap) / n_pieces
    reach = max(1, int(step / 4))
    out, start = [], 0
    for i in range(1, n_pieces):
        target = overlap + i * step
        floor = (out[-1][1] if out else 0) + 1
        lo, hi = max(floor, int(target) - reach), min(start + limit, int(target) + reach, n - 1)
        if hi < lo:
            lo, hi = max(floor, start + limit - 4), min(start + limit, n - 1)
            if hi < lo:
                return None
        here = kind[lo : hi + 1].astype(np.int64)
        best = here.max()
        if best < 0:
            return None
        at = np.flatnonzero(here == best) + lo
        end = int(at[np.argmin(np.abs(at - target))])
        out.append((start, end, int(best)))
        start = max(0, end - overlap)
        while start > 0 and kind[start] < 0:
            start -= 1
    out.append((start, n, len(KINDS)))
    return out if all(e - s <= limit for s, e, _ in out) else None


def split_text(text: str, limit: int, overlap: int, folder: str = TOKENIZERS) -> list[tuple[int, int, int, int, str, str]]:
    """(token_start, token_end, char_start, char_end, boundary, text) of each piece; [] if the text is within the limit."""
    enc, sizes = encoder(folder)
    ids = enc.encode_to_numpy(text, disallowed_special=())
    n = len(ids)
    if n <= limit:
        return []
    data = text.encode()
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    k = strengths(data)
    kind = k[ends]
    pieces = 1 + -(-(n - limit) // (limit - overlap))
    while True:
        found = cuts(n, kind, limit, overlap, pieces)
        if found is not None:
            texts = [data[ends[s] : ends[e]].decode() for s, e, _ in found]
            if all(
                e - s <= limit - _EDGE or len(enc.encode_to_numpy(t, disallowed_special=())) <= limit for (s, e, _), t in zip(found, texts)
            ):
                break
        pieces += 1
    if len(data) == len(text):
        at = ends
    else:
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        at = chars[ends]
    return [(s, e, int(at[s]), int(at[e]), KINDS[b] if b < len(KINDS) else "end", t) for (s, e, b), t in zip(found, texts)]


_OUT = pa.schema(
    [
        ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("token_start", pa.int64()), ("token_end", pa.int64()),
        ("n_tokens", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("boundary", pa.string()), ("text", pa.string())
    ]
)
#: Bytes of piece text that one output batch holds.
_FLUSH = 16_000_000


def split_documents(
    docs: DataFrame, limit: int, overlap: int, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS
) -> DataFrame:
    """Every text above ``limit`` tokens as pieces of at most ``limit`` tokens; lazy, no shuffle.

    The piece count is the least possible with the overlap; equal targets are moved to the strongest nearby boundary
    (section, paragraph, line, sentence, word, else any character), and a piece is added when a limit fails. A piece starts
    ``overlap`` tokens before the end of the one before (up to three more where that would cut a character). Pieces close to
    the limit are counted again on their own text.

    Result: doc_id, piece_no INT (from 0), n_pieces INT, token_start, token_end, n_tokens, char_start, char_end LONG,
    boundary STRING (at the piece's end; ``end`` for the last), text STRING. The texts without their overlaps join to the
    original. Texts within the limit, empty and null ones have no rows; repeated rows are split each. Texts of up to
    ``limit`` bytes can't exceed it and aren't sent to a worker.
    """
    if not 0 <= overlap <= limit - 8:
        raise ValueError("overlap must be at least 0 and 8 below the limit")
    big = docs.where(F.octet_length(F.col(f"`{text}`")) > limit).select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    kind = big.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            take: list[int] = []
            held = 0

            def flush() -> pa.RecordBatch:
                arrays = [b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types))]
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_OUT.names])

            for i, t in enumerate(b.column(1).to_pylist()):
                found = split_text(t, limit, overlap, folder)
                for p, (s, e, cs, ce, kind_, piece) in enumerate(found):
                    rows.append((p, len(found), s, e, e - s, cs, ce, kind_, piece))
                    take.append(i)
                    held += len(piece)
                if held > _FLUSH:
                    yield flush()
                    rows, take, held = [], [], 0
            if rows:
                yield flush()

    return big.mapInArrow(
        run,
        f"doc_id {kind}, piece_no int, n_pieces int, token_start long, token_end long, n_tokens long, char_start long, char_end long, boundary string, text string"
    )


def texts_again(pieces: DataFrame, limit: int) -> DataFrame:
    """doc_id, whole STRING (the pieces of each text without their overlaps, in order) and fits (no piece above ``limit``
    tokens), for documents with unique ids."""
    before = F.coalesce(F.lag("char_end").over(W.partitionBy("doc_id").orderBy("piece_no")), F.lit(0))
    own = pieces.select("doc_id", "piece_no", "n_tokens", F.substr("text", (before - F.col("char_start") + 1).cast("int")).alias("part"))
    rows = own.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("piece_no", "part"))).alias("parts"), F.every(F.col("n_tokens") <= limit).alias("fits")
    )
    return rows.select("doc_id", F.array_join("parts.part", "").alias("whole"), "fits")
