import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from libroflow.llm.packing import encoding, fill, pack, pack_all, token_counts


def brute(counts, room):
    best = 0
    items = [s for s, n in counts.items() for _ in range(n)]
    for k in range(len(items) + 1):
        for c in itertools.combinations(items, k):
            if sum(c) <= room:
                best = max(best, sum(c))
    return best


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 30))
def test_fill_is_closest(counts, room):
    used = fill(counts, room)
    assert all(0 < n <= counts[s] for s, n in used.items())
    assert sum(s * n for s, n in used.items()) == brute(counts, room)


def test_pack_whole():
    rng = random.Random(1)
    items = [(i, rng.randint(0, 300)) for i in range(400)]
    bins = pack(items, 128)
    seen = {}
    for b in bins:
        assert sum(x[3] for x in b) <= 128
        for key, piece, start, n in b:
            seen.setdefault(key, []).append((piece, start, n))
    for key, size in items:
        parts = sorted(seen[key])
        assert sum(n for _, _, n in parts) == size and [p for p, _, _ in parts] == list(range(1, len(parts) + 1))
        assert len(parts) == max(1, -(-size // 128))  # cut only where longer than a container
    assert sum(s for _, s in items) / (128 * len(bins)) > 0.99
    assert pack([], 10) == [] and pack([(1, 0)], 10) == [[(1, 1, 0, 0)]]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "hello world", "c"), (2, None, "c"), (3, "", "c"), (4, "a " * 5000, "c"), (1, "hello world", "c")], "doc_id bigint, text string, n_tokens string")
    sizes = token_counts(docs, "doc_id", "text")
    got = {r.doc_id: r.n_tokens for r in sizes.collect()}
    enc = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert got == {1: 2, 2: 0, 3: 0, 4: len(enc.encode_ordinary("a " * 5000))}
    packs = spark.createDataFrame([(1, 512), (2, None), (3, 0), (4, 64)], "pack_id bigint, capacity_tokens bigint")
    rows = pack_all(sizes, "doc_id", "n_tokens", packs).collect()
    assert {r.pack_id for r in rows} == {1, 4}
    for p in (1, 4):
        total = {}
        for r in rows:
            if r.pack_id == p:
                total[r.item] = total.get(r.item, 0) + r.n_tokens
        assert total == got
    assert pack_all(sizes, "doc_id", "n_tokens", packs.limit(0)).count() == 0
    assert pack_all(sizes.limit(0), "doc_id", "n_tokens", packs).count() == 0
