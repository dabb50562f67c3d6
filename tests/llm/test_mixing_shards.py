from __future__ import annotations

from collections import Counter, defaultdict

from fleetlens.llm import mixing
from fleetlens.llm.queries import QUERIES


def test_shards_are_put_out_in_order(spark, docs, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 40 * 160 + i % 3)), "en", "abc"[i % 3]) for i in range(120)]
    rows += [(None, "one two", None, None), (500, None, "en", "a"), (501, "", "en", "z"), *[(7, "x y z", "en", "a")] * 20]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_mixing_shards"](spark, str(tmp_path)).collect()
    again = QUERIES["op3_mixing_shards"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))

    slots, draws = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        draws[r.doc_id, r.source, r["size"], r.copy, r["pass"], r.block] += 1
        assert 0 < r.words <= 1024
    assert max(draws.values()) == 1, "ranges are disjoint"
    assert set(slots) == set(range(mixing.SHARDS)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

    # the order in a shard is not that of the texts, and blocks of one text are in several shards
    shards, order = defaultdict(set), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        shards[r.doc_id].add(r.shard)
        order[r.shard].append((r.doc_id or 0, r["pass"], r.block))
    assert max(map(len, shards.values())) > 3 and all(o != sorted(o) for o in order.values())

    # the same draws as in the sums by document
    taken = Counter()
    for r in got:
        taken[r.doc_id, r["size"], r.source] += r.words
    by_size, want = Counter(), Counter()
    for (doc_id, size, _), n in taken.items():
        by_size[doc_id, size] += n
    for r in mixing.mixed_sizes(docs(*rows)).collect():
        want[r.doc_id, r.size] += r.taken
    assert by_size == Counter({k: n for k, n in want.items() if n})


def test_empty(docs):
    assert mixing.mixed_blocks(docs()).count() == 0
    assert mixing.mixed_blocks(docs(None, "")).count() == 0
