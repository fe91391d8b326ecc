import random
from collections import defaultdict

import numpy as np

from gridloom.llm.packing import fill_report, pack, pack_documents
from gridloom.llm.tokens import encode


def slow_pack(sizes, capacity):
    """The rule by its definition: try every open level and a new container, keep the least sum of squares."""
    boxes, out = [], []
    for s in sizes:
        best = None
        for h in sorted({b for b in boxes if b + s <= capacity and b < capacity} | {0}, reverse=True):
            after = list(boxes)
            if h:
                after.remove(h)
            after.append(h + s)
            count = defaultdict(int)
            for x in after:
                if x < capacity:
                    count[x] += 1
            cost = sum(c * c for c in count.values())
            if best is None or cost < best[0]:
                best = (cost, h, after)
        boxes = best[2]
        out.append(best[1])
    return out


def levels(sizes, boxes):
    held, out = defaultdict(int), []
    for s, b in zip(sizes, boxes):
        out.append(held[b])
        held[b] += s
    return out


def test_matches_the_definition():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 20):
        for _ in range(30):
            sizes = [rng.randint(1, capacity) for _ in range(60)]
            assert levels(sizes, pack(sizes, capacity)) == slow_pack(sizes, capacity)


def test_never_over_capacity_and_close_to_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.minimum(2048, (rng.lognormal(5, 1.2, 20_000)).astype(int) + 1)
    boxes = pack(sizes.tolist(), 2048)
    held = np.bincount(boxes, weights=sizes)
    assert held.max() <= 2048 and len(held) <= 1.03 * sizes.sum() / 2048


def test_frames(spark):
    texts = [None, "", "word " * 300, "word " * 1200, "a", "a", "line\n" * 90]
    df = spark.createDataFrame([(i % 6, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, container_id string")
    for shard_items in (2, 20_000):
        out = pack_documents(df, 256, shard_items=shard_items).collect()
        assert sum(r.n_tokens for r in out) == sum(len(encode(t)) for t in texts if t)
        held = defaultdict(int)
        for r in out:
            assert (r.container_id is None) == (r.n_tokens == 0)
            held[r.container_id] += r.n_tokens
        assert max(held.values()) <= 256
        assert len([r for r in out if r.n_pieces == 1]) == 5
    assert pack_documents(df.limit(0), 256).count() == 0
    r = fill_report(pack_documents(df, 256), 256).first()
    assert r.n_containers >= r.least_containers and r.n_unused == r.n_containers * 256 - r.n_tokens
