import math
from collections import Counter

import numpy as np
import pytest

from gridloom.llm.mixing import ALL_TOKENS, hypergeometric, mix, mixed_tokens, permute, plan_sources, shard_counts, share_report
from gridloom.llm.tokens import encode


def test_permutations_are_bijections():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (0, 1, 99):
            assert sorted(permute(np.arange(n), n, key)) == list(range(n))
    assert list(permute(np.arange(1000), 1000, 1)) != list(permute(np.arange(1000), 1000, 2))


def test_shards_share_out_the_totals():
    take = np.array([5000, 1, 0, 777])
    n = -(-int(take.sum()) // 64)
    got = [shard_counts(i, n, take, 64, 3) for i in range(n)]
    assert (sum(c for c, _ in got) == take).all()
    past = np.zeros(4, int)
    for i, (c, before) in enumerate(got):
        assert (before == past).all() and c.sum() == min(64, take.sum() - 64 * i)
        past = past + c
    spread = np.array([c[0] for c, _ in got[:-1]])
    assert 0 < spread.std() < 10


@pytest.mark.parametrize(("good", "total", "n"), [(5, 20, 7), (3, 10, 9), (50, 1000, 300), (1, 4, 2), (400, 800, 400)])
def test_draws_have_the_hypergeometric_probabilities(good, total, n):
    rng, draws = np.random.default_rng(4), 20_000
    got = Counter(hypergeometric(good, total, n, rng) for _ in range(draws))
    p = {
        k: math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n) for k in range(
            max(0, n + good - total), min(good, n) + 1
        )
    }
    assert set(got) <= set(p)
    tested = [k for k in p if draws * p[k] > 5]
    assert sum((got[k] - draws * p[k]) ** 2 / (draws * p[k]) for k in tested) < len(tested) + 4 * math.sqrt(2 * len(tested)) + 4


@pytest.mark.parametrize("size", [10**6, 10**10, 10**14])
def test_counts_of_huge_nodes_are_drawn_too(size):
    good, n, rng = 3 * size // 10, size // 2, np.random.default_rng(8)
    sd = math.sqrt(n * 0.3 * 0.7 * (size - n) / (size - 1))
    x = (np.array([hypergeometric(good, size, n, rng) for _ in range(4000)]) - good * n // size) / sd
    assert abs(x.mean()) < 0.07 and abs(x.std() - 1) < 0.05
    take = np.array([size, size // 7, 0, 5])
    halves = [shard_counts(i, 2, take, -(-int(take.sum()) // 2), 3)[0] for i in range(2)]
    assert (halves[0] + halves[1] == take).all() and halves[0][0] != size // 2


def test_plan_respects_caps():
    plan = {p.source: p for p in plan_sources([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.2, 2)], {"a": 100_000, "b": 1000}, 100)}
    assert plan["b"].take == 3 * plan["b"].blocks and abs(plan["a"].take * plan["a"].length - 3000) < 100 and plan["none"].take == 0
    more = {p.source: p for p in plan_sources([("a", 0.5, 1), ("b", 0.5, 3)], {"a": 100_000, "b": 1000}, 100, total=50_000)}
    assert more["b"].take == 3 * more["b"].blocks and abs(more["a"].take * more["a"].length - 25_000) < 100
    assert plan_sources([("a", 1.0, 9)], {"a": 1000, "other": 5}, 100, total=ALL_TOKENS)[0].take == 10


def test_frames(spark):
    rows = [
        (i, f"text number {i} " * (20 + i % 50), "big") for i in range(300)
    ] + [(1000 + i, "small words here " * 40, "small") for i in range(12)]
    rows += [(5000, None, "big"), (5001, "", "small"), (5002, "stray", None), (5003, "stray", "other")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, block int")
    targets = spark.createDataFrame(
        [("big", 0.75, 1), ("small", 0.25, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeat int"
    )
    m, plan = mix(docs, targets, block_tokens=64, shard_blocks=16)
    got = m.collect()
    size = {r[0]: len(encode(r[1] or "")) for r in rows}
    uses = Counter()
    filled = Counter()
    for r in got:
        for t in range(r.token_start, r.token_start + r.n_tokens):
            uses[r.source, r.doc_id, t] += 1
        assert r.token_start + r.n_tokens <= size[r.doc_id]
        filled[r.shard_id, r.slot] += r.n_tokens
    assert max(v for (s, _, _), v in uses.items() if s == "big") == 1 and max(v for (s, _, _), v in uses.items() if s == "small") <= 4
    assert max(filled.values()) <= 64 and {r.doc_id for r in got}.isdisjoint({5000, 5001, 5002, 5003})
    report = {r.source: r for r in share_report(m, plan).collect()}
    assert abs(report["big"].actual_share - 0.75) < 0.02 and abs(
        report["small"].actual_share - 0.25
    ) < 0.02 and report["absent"].tokens == 0
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, got))
    tokens = {(r.shard_id, r.slot, r.block_offset): list(r.token_ids) for r in mixed_tokens(m, docs).collect()}
    text = {r[0]: encode(r[1] or "").tolist() for r in rows}
    assert tokens == {(r.shard_id, r.slot, r.block_offset): text[r.doc_id][r.token_start : r.token_start + r.n_tokens] for r in got}
    assert mix(docs.limit(0), targets)[0].count() == 0 and mix(docs, targets.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        mix(docs, targets.union(targets))
