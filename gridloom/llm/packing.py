"""Texts into containers of fixed capacity by sum-of-squares online packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import TOKENIZERS, encoder, token_counts
from gridloom.session import materialize

#: Items that one packer places in order; the number of packers follows from the data.
SHARD_ITEMS = 20_000
#: Tasks that pack at the same time, at most.
MOST_TASKS = 4096


def pack(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item of 1 to ``capacity`` tokens, placed one after the other.

    An array holds how many open containers there are at each fill level. Adding an item of size s to a container at level
    h moves one container from h to h + s; the item goes where the sum of the squared counts becomes least (a new container
    being level 0, a full one leaving the array), of equal choices to the fullest.
    """
    count = np.zeros(capacity + 1, np.int64)  # count[0] and count[capacity] stay 0
    closed = np.full(capacity + 1, np.int64(1) << 40)  # 2 x count where a container is open
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes):
        best = None
        if s < capacity:
            # half the growth of the sum: count[h + s] - count[h] + 1, or -count[h] + 1/2 when it fills up
            cost = 2 * count[s + 1 : capacity + 1] + closed[1 : capacity - s + 1]
            cost[-1] -= 1
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] < (1 << 39) and cost[k] + 2 <= 2 * count[s] + 1:
                best = k + 1
        if best is None:
            box, level = n, s
            n += 1
        else:
            box, level = at[best].pop(), best + s
            count[best] -= 1
            closed[best] = -2 * count[best] if count[best] else np.int64(1) << 40
        if level < capacity:
            at[level].append(box)
            count[level] += 1
            closed[level] = -2 * count[level]
        out[i] = box
    return out


def pack_documents(
    docs: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """Assign every text to containers of ``capacity`` tokens.

    Texts are counted once (the counts are written, not the texts). A text above the capacity is cut into pieces of exactly
    ``capacity`` tokens, each a container of its own, and a rest; no other text is cut. Items are hashed to shards of about
    ``shard_items``, whatever their source or key, and each shard packs its items in row order with its own level array, so
    the work is linear and a shard's state is ``capacity`` counters. What shards leave open is packed again by further
    rounds over far fewer items (open containers at most half full), until one shard is left.

    Result: doc_id, piece_no INT (from 0), n_pieces INT, token_start LONG, n_tokens LONG, container_id STRING. Null and
    empty texts have one row with 0 tokens and a null container. Repeated rows are packed each. Empty tables work; other
    columns are ignored. Runs jobs.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = materialize(token_counts(docs, text, [doc_id], folder).withColumn("row_no", F.monotonically_increasing_id()))
    pieces = sizes.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int"))
    pieces = pieces.select(
        doc_id, "row_no", "n_pieces", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no")
    )
    start = F.col("piece_no").cast("long") * capacity
    pieces = pieces.select(
        F.col(doc_id), "row_no", "piece_no", "n_pieces", start.alias("token_start"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start).alias("n_tokens")
    )
    whole = pieces.where(F.col("n_tokens") == capacity).withColumn("container_id", F.concat_ws("-", F.lit("whole"), "row_no", "piece_no"))
    none = pieces.where("n_tokens = 0").withColumn("container_id", F.lit(None).cast("string"))
    loose = pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    n_loose = sizes.where(F.col("n_tokens") % capacity > 0).count()

    def placed(items: DataFrame, n_items: int, tag: str) -> DataFrame:
        """items: item, n_tokens -> item, container, container_tokens."""
        shards = max(1, -(-n_items // shard_items))

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("item", kind="stable")
            box = pack(group["n_tokens"].tolist(), capacity)
            held = np.bincount(box, weights=group["n_tokens"]).astype(np.int64)
            return pd.DataFrame({"item": group["item"], "container": [f"{tag}-{key[0]}-{b}" for b in box], "held": held[box]})

        kind = items.schema["item"].dataType.simpleString()
        # an explicit number of partitions isn't coalesced: the few bytes of a shard hide seconds of packing
        spread = items.withColumn(
            "shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")
        ).repartition(min(shards, MOST_TASKS), "shard")
        return spread.groupBy("shard").applyInPandas(run, f"item {kind}, container string, held long")

    boxes = materialize(placed(loose.select(F.col("row_no").alias("item"), "n_tokens"), n_loose, "r0"))
    moves, level, current, shards = [], 0, boxes, -(-n_loose // shard_items)
    while shards > 1:
        level += 1
        half = current.where(F.col("held") * 2 <= capacity).select(
            F.col("container").alias("item"), F.col("held").alias("n_tokens")
        ).distinct()
        n_half = half.count()
        if not n_half:
            break
        moved = materialize(placed(half, n_half, f"r{level}"))
        moves.append((moved, n_half))
        current, fewer = moved, -(-n_half // shard_items)
        if fewer >= shards:
            break
        shards = fewer
    out = boxes.select("item", "container")
    for moved, n in moves:
        m = moved.select(F.col("item").alias("container"), F.col("container").alias("into"))
        out = out.join(m, "container", "left").select("item", F.coalesce("into", "container").alias("container"))
    packed = loose.join(out.select(F.col("item").alias("row_no"), F.col("container").alias("container_id")), "row_no")
    cols = [doc_id, "piece_no", "n_pieces", "token_start", "n_tokens", "container_id"]
    return whole.select(*cols).unionAll(packed.select(*cols)).unionAll(none.select(*cols))


def texts_again(packed: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text STRING: the tokens of each document's pieces, decoded in order; for documents with unique ids."""
    spots = packed.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("piece_no", "token_start", "n_tokens"))).alias("spots"))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")
    ).join(spots.withColumnRenamed(doc_id, "doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)[0]
        for b in batches:
            out = []
            for t, spots in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tokens = enc.encode_to_numpy(t or "", disallowed_special=()).tolist()
                got = [x for s in spots for x in tokens[s["token_start"] : s["token_start"] + s["n_tokens"]]]
                out.append(enc.decode_bytes(got).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_containers, n_tokens, least_containers (that the tokens alone would need), n_unused LONG, fill DOUBLE."""
    held = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    return held.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("held"), F.lit(0)).alias("n_tokens")).select(
        "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).cast("long").alias("least_containers"),
        (F.col("n_containers") * capacity - F.col("n_tokens")).alias("n_unused"),
        F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * F.lit(float(capacity))).alias("fill")
    )
