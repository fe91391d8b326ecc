"""Sources mixed to target shares of the tokens, with capped repetition."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.llm.tokens import TOKENIZERS, encoder, token_counts
from gridloom.session import materialize

#: Tokens of a block at most, blocks of an output shard, and documents numbered together.
BLOCK_TOKENS = 512
SHARD_BLOCKS = 4096
BUCKET_DOCS = 65_536
#: Table of bucket totals (source, bucket, start) that may be broadcast, in rows of about a hundred bytes.
BROADCAST_BUCKETS = 200_000
#: As ``total``: as many tokens as all sources with a target have together.
ALL_TOKENS = -1
_MASK = (1 << 33) - 1


@dataclass(frozen=True)
class SourcePlan:
    """What one source has and gives: blocks of ``length`` tokens (the last may be shorter), of which ``take`` are drawn."""

    source: str
    share: float
    max_repeat: int
    tokens: int
    length: int
    blocks: int
    take: int


def plan_sources(
    targets: list[tuple[str, float, int]], tokens: dict[str, int], block_tokens: int = BLOCK_TOKENS, total: int | None = None
) -> list[SourcePlan]:
    """Blocks to draw from each source.

    ``total`` tokens are mixed; by default as many as can be while every source that has tokens reaches its share within
    its repetitions. Sources without tokens give nothing; with a larger ``total`` (ALL_TOKENS: that of all sources together) a
    source ends at its cap and falls short.
    """
    live = [(s, w, r) for s, w, r in targets if tokens.get(s, 0) > 0 and w > 0 and r > 0]
    weight = sum(w for _, w, _ in live)
    if total is None:
        total = min((math.floor(r * tokens[s] * weight / w) for s, w, r in live), default=0)
    if total == ALL_TOKENS:
        total = sum(tokens[s] for s, _, _ in live)
    out = []
    for s, w, r in targets:
        n = tokens.get(s, 0)
        if (s, w, r) not in live:
            out.append(SourcePlan(s, w, r, n, 0, 0, 0))
            continue
        length = -(-n // -(-n // block_tokens))
        blocks = -(-n // length)
        mean = n / blocks
        out.append(SourcePlan(s, w, r, n, length, blocks, min(r * blocks, round(total * w / weight / mean))))
    return out


def _stirling_rest(n: int) -> float:
    """log n! beyond Stirling's sqrt(2 pi n) (n / e)^n."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    i = 1 / (n * n)
    return (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / n


def _deviance(x: int, d: float) -> float:
    """x log(x / m) + m - x for a mean m = x - d, without the cancellation of its terms."""
    m = x - d
    if abs(d) >= 0.1 * (x + m):
        return x * math.log(x / m) - d
    v = d / (x + m)
    total, term, j = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        if (more := total + term / (2 * j + 1)) == total:
            return total
        total, j = more, j + 1


def _log_binomial(x: int, n: int, share: tuple[int, int]) -> float:
    """log of the binomial probability of x out of n at p = share[0] / share[1], to full precision at any size."""
    a, b = share
    if x == 0:
        return n * math.log1p(-a / b)
    if x == n:
        return n * math.log(a / b)
    d = (x * b - n * a) / b  # distance from the mean, from whole numbers
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x)
    return rest - _deviance(x, d) - _deviance(n - x, -d) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(good: int, total: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``good`` among ``total`` items are in a draw of ``n``: one draw of the hypergeometric distribution.

    Rejection under a hat that lies above every log-concave distribution: flat around the mode, exponential beyond. The same
    for all sizes, from the exact probabilities (three binomial ones, whose terms don't cancel).
    """
    low, high = max(0, n - (total - good)), min(good, n)
    if low == high:
        return low
    share = (n, total)

    def log_p(k: int) -> float:
        return _log_binomial(k, good, share) + _log_binomial(n - k, total - good, share)

    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    top = log_p(mode)
    p = math.exp(top - _log_binomial(n, total, share))
    w = 1 + p / 2
    while True:
        u, v, accept = rng.random(3).tolist()
        away = v * w / p if u <= w / (1 + w) else (w - math.log1p(-v)) / p
        k = mode + round(away) * (1 if rng.random() < 0.5 else -1)
        if low <= k <= high and accept * min(1.0, math.exp(w - p * away)) <= math.exp(log_p(k) - top):
            return k


@lru_cache(maxsize=256)
def _split(counts: tuple[int, ...], left: int, seed: tuple[int, ...]) -> tuple[int, ...]:
    """Of ``counts`` blocks by source, how many fall on the left ``left`` slots: a multinomial draw given the totals."""
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed)))
    rest, got = sum(counts), []
    for c in counts:
        got.append(hypergeometric(c, rest, left, rng))
        left, rest = left - got[-1], rest - c
    return tuple(got)


def shard_counts(shard: int, n_shards: int, take: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source in one shard, and how many of each lie in the shards before it.

    Halving the shards from the root, each half's counts are drawn from its parent's with a seed of its own, so that any
    worker finds a shard's counts in log2(n_shards) draws, without the others', and all shards together give exactly ``take``.
    """
    lo, hi, counts, before = 0, n_shards, take.astype(np.int64), np.zeros(len(take), np.int64)
    total = int(take.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = min(mid * slots, total) - min(lo * slots, total)
        first = np.array(_split(tuple(counts.tolist()), left, (seed, lo, hi)), np.int64)
        if shard < mid:
            counts, hi = first, mid
        else:
            counts, before, lo = counts - first, before + first, mid
    return counts, before


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 ... n - 1 at ``index``: four Feistel rounds on the next even number of bits,
    repeated while the value is n or more. Nothing of size n is held."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, b = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                f = b + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
                f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                f ^= f >> np.uint64(31)
            a, b = b, a ^ (f & mask)
        x[todo] = (a << np.uint64(half)) | b
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def mix(
    docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, total: int | None = None, seed: int = 7, doc_id: str = "doc_id",
    text: str = "text", source: str = "source", folder: str = TOKENIZERS, shard_blocks: int = SHARD_BLOCKS
) -> tuple[DataFrame, list[SourcePlan]]:
    """Draw a mixture in which each source has its target share of the tokens. Returns it and the plan of the sources.

    The tokens of a source, document after document, are cut into blocks of equal length (at most ``block_tokens``). The
    mixture's slots are spread over shards; the number of each source's blocks in a shard is a multinomial draw, given the
    totals that meet the shares. A source's k-th slot takes block perm(k mod n) of its n blocks, with a new pseudorandom
    permutation after each n, so that every block is used once before any is used again and none more than max_repeat times.
    Slots and documents are joined by (source, block): a source of any size is spread over all tasks.

    ``targets``: source, target_share, max_repeat (a small table, collected: one row a source; null or repeated sources are
    an error). Rows of ``docs`` with a null source or one without target are not used; null and empty texts have no tokens.
    Mixture, a row for each piece of a document in a block: shard_id, slot INT, source STRING, repeat_no INT, block LONG,
    doc_id, token_start LONG (in the document), block_offset LONG, n_tokens LONG. Repeated rows count as documents each.
    Empty tables give an empty mixture. Runs jobs.
    """
    rows = [
        (
            r["source"], float(r["target_share"] or 0), int(r["max_repeat"] or 0)
        ) for r in targets.select("source", "target_share", "max_repeat").collect()
    ]
    if len({s for s, _, _ in rows} - {None}) != len(rows):
        raise ValueError("each source needs one target")
    rows.sort()
    names = [s for s, _, _ in rows]
    spark = docs.sparkSession
    used = docs.where(F.col(f"`{source}`").isin(names)).select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")
    )
    sizes = materialize(
        token_counts(used, "text", ["doc_id", "source"], folder).withColumn("row_no", F.monotonically_increasing_id())
    ).where("n_tokens > 0")
    bucket = F.struct(
        F.shiftright("row_no", 33).alias("split"), F.floor(F.col("row_no").bitwiseAND(F.lit(_MASK)) / BUCKET_DOCS).alias("part")
    ).alias("bucket")
    numbered = sizes.select("doc_id", "source", "n_tokens", "row_no", bucket)
    held = numbered.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = materialize(
        held.select(
            "source", "bucket", "tokens",
            F.coalesce(
                F.sum("tokens").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("bucket_start")
        )
    )
    tokens = {r["source"]: r["t"] for r in before.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    plan = plan_sources(rows, tokens, block_tokens, total)
    n_before = before.count()
    start = before.select("source", "bucket", "bucket_start")
    offset = F.coalesce(
        F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    placed = numbered.withColumn("inner", offset).join(F.broadcast(start) if n_before <= BROADCAST_BUCKETS else start, ["source", "bucket"])
    length = F.lit(1).cast("long")
    for p in plan:
        length = F.when(F.col("source") == p.source, F.lit(p.length).cast("long")).otherwise(length)
    placed = placed.select("doc_id", "source", "n_tokens", (F.col("bucket_start") + F.col("inner")).alias("start"), length.alias("len"))
    whole_div = lambda a: F.expr(f"({a}) div len")
    parts = placed.withColumn("block", F.explode(F.sequence(whole_div("start"), whole_div("start + n_tokens - 1"))))
    block_from, block_to = F.col("block") * F.col("len"), (F.col("block") + 1) * F.col("len")
    parts = parts.select(
        "source", "block", "doc_id", F.greatest(F.lit(0), block_from - F.col("start")).alias("token_start"),
        F.greatest(F.lit(0), F.col("start") - block_from).alias("block_offset"),
        (F.least(block_to, F.col("start") + F.col("n_tokens")) - F.greatest(block_from, F.col("start"))).alias("n_tokens")
    )

    take = np.array([p.take for p in plan], np.int64)
    blocks = np.array([max(1, p.blocks) for p in plan], np.int64)
    n_slots = int(take.sum())
    n_shards = max(1, -(-n_slots // shard_blocks))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                got, past = shard_counts(int(shard), n_shards, take, shard_blocks, seed)
                which = np.repeat(np.arange(len(take)), got)
                k = np.concatenate([np.arange(p, p + g) for p, g in zip(past, got)]) if len(take) else np.zeros(0, np.int64)
                turn, at = k // blocks[which], k % blocks[which]
                block = np.empty(len(k), np.int64)
                for s in np.unique(which):
                    for t in np.unique(turn[which == s]):
                        here = (which == s) & (turn == t)
                        block[here] = permute(at[here], int(blocks[s]), (seed << 40) ^ (int(s) << 24) ^ int(t))
                order = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(shard), 1 << 30]))).permutation(len(k))
                out = pd.DataFrame(
                    {
                        "shard_id": int(shard), "slot": np.arange(len(k), dtype=np.int32), "source": np.array(names, object)[which[order]],
                        "repeat_no": turn[order].astype(np.int32), "block": block[order]
                    }
                )
                yield out.astype({"shard_id": np.int32})

    ids = spark.range(0, n_shards if n_slots else 0, 1, min(n_shards, max(512, n_shards // 256)))
    drawn = ids.mapInPandas(slots, "shard_id int, slot int, source string, repeat_no int, block long")
    return drawn.join(parts, ["source", "block"]).select(
        "shard_id", "slot", "source", "repeat_no", "block", "doc_id", "token_start", "block_offset", "n_tokens"
    ), plan


def mixed_tokens(mixture: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """The mixture's tokens: shard_id, slot INT, source STRING, block_offset LONG, doc_id, token_ids ARRAY<INT>.

    Each used document is joined to the list of its ranges (as many as its blocks and repetitions) and counted once; the
    pieces of a slot, in order of block_offset, are its block. ``doc_id`` must be unique in ``docs``.
    """
    spot = F.struct("shard_id", "slot", "source", "block_offset", "token_start", "n_tokens")
    ranges = mixture.groupBy("doc_id").agg(F.collect_list(spot).alias("spots"))
    used = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(ranges, "doc_id")
    kind = used.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)[0]
        for b in batches:
            ids, texts, spots = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text", "spots"))
            for i, t in enumerate(texts.to_pylist()):
                tokens = enc.encode_to_numpy(t, disallowed_special=()).astype(np.int32)
                at = spots[i].as_py()
                yield pa.RecordBatch.from_pydict({
                    "shard_id": pa.array([s["shard_id"] for s in at], pa.int32()), "slot": pa.array([s["slot"] for s in at], pa.int32()),
                    "source": pa.array([s["source"] for s in at], pa.string()),
                    "block_offset": pa.array([s["block_offset"] for s in at], pa.int64()),
                    "doc_id": ids.take(pa.array([i] * len(at), pa.int64())),
                    "token_ids": pa.array([tokens[s["token_start"] : s["token_start"] + s["n_tokens"]] for s in at], pa.list_(pa.int32())),
                })

    return used.mapInArrow(run, f"shard_id int, slot int, source string, block_offset long, doc_id {kind}, token_ids array<int>")


def share_report(mixture: DataFrame, plan: list[SourcePlan]) -> DataFrame:
    """For each target: source, target_share, actual_share, shortfall DOUBLE, tokens, available_tokens LONG, max_repeat,
    most_uses INT (of a document's tokens) and n_docs LONG used."""
    spark = mixture.sparkSession
    by_block = mixture.groupBy("source", "block", "doc_id", "token_start").agg(
        F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens")
    )
    got = by_block.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"), F.countDistinct("doc_id").alias("n_docs")
    )
    want = spark.createDataFrame(
        [(p.source, p.share, p.tokens, p.max_repeat) for p in plan],
        "source string, target_share double, available_tokens long, max_repeat int"
    )
    j = want.join(got, "source", "left").na.fill(0, ["tokens", "most_uses", "n_docs"])
    whole = F.sum("tokens").over(W.partitionBy())  # one row a source
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole.cast("double")), F.lit(0.0))
    return j.select(
        "source", "target_share", share.alias("actual_share"), F.greatest(F.lit(0.0), F.col("target_share") - share).alias("shortfall"),
        "tokens", "available_tokens", "max_repeat", F.col("most_uses").cast("int").alias("most_uses"), "n_docs"
    )
