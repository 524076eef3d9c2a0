"""Filling containers of fixed capacity with texts, by minimum bin slack.

Texts are measured in tokens of a public tokenizer. A text longer than a capacity is cut into full pieces of exactly
that capacity and a rest; nothing else is cut. The items of a capacity are spread over windows by a hash of the
document id, so no window depends on a hot key and each holds about WINDOW items. In a window, each container is
seeded with the largest item left; a bitset subset-sum over the remaining lengths, held as counts, finds the filling
closest to the room left, and the counts used are read back from the bitsets.

Defined edge cases: a row without an id is left out; a null or empty text has 0 tokens and lies, as an item of size 0, in the window's first container;
capacities that are null or below 1 are left out; repeated documents are packed once; no documents or no capacities
give an empty result; columns other than the ones named are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libroflow.session import cut, small

WINDOW = 8192
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer at `path` (ranks file), read once per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row, over whole texts."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for b in it:
            sizes = [len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], schema=schema)

    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(text).alias(text)).mapInArrow(run, f"{key} bigint, n_tokens bigint")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths from `counts` whose sum is closest to `room` from below: length -> number used."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    top = 1 << room
    for size in sorted(counts, reverse=True):
        if size > room:
            continue
        left, part = min(counts[size], room // size), 1
        while left > 0:  # a count is covered by parts 1, 2, 4, ... and a rest
            n = min(part, left)
            steps.append((reach, size, n))
            reach |= reach << size * n & mask
            left -= n
            part *= 2
            if reach & top:
                break
        if reach & top:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, size, n in reversed(steps):
        if not before >> at & 1:  # this sum was out of reach without the part
            used[size] = used.get(size, 0) + n
            at -= size * n
    return used


def pack(items: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """items: (id, size). Containers of (id, piece, start, length)."""
    out, stock, nothing = [], {}, []
    for key, size in sorted(items, reverse=True):
        if size <= 0:
            nothing.append((key, 1, 0, 0))
            continue
        full, rest = divmod(size, capacity)
        out += [[(key, p + 1, p * capacity, capacity)] for p in range(full)]
        if rest:
            stock.setdefault(rest, []).append((key, full + 1, full * capacity, rest))
    counts = {s: len(v) for s, v in stock.items()}

    def take(size: int) -> tuple[int, int, int, int]:
        counts[size] -= 1
        if not counts[size]:
            del counts[size]
        return stock[size].pop()

    while counts:
        seed = max(counts)
        bin_ = [take(seed)]
        for size, n in fill(counts, capacity - seed).items() if capacity > seed else ():
            bin_ += [take(size) for _ in range(n)]
        out.append(bin_)
    if nothing:
        out = [nothing + out[0], *out[1:]] if out else [nothing]
    return out


def _pack_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pack_id", pa.int64()), ("container", pa.int64()), ("item", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])
    for b in it:
        for pack_id, capacity, window, items in zip(*[b.column(i).to_pylist() for i in range(4)]):
            rows = []
            for seq, held in enumerate(pack([(x["item"], x["size"]) for x in items], capacity)):
                rows += [(pack_id, window << 32 | seq, *x) for x in held]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def pack_all(sizes: DataFrame, key: str, size: str, packs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(pack_id, container, item, piece, start_token, n_tokens): every item in a container of every capacity."""
    packs = packs.filter(F.col("capacity_tokens") >= 1).select("pack_id", "capacity_tokens").distinct()
    few = small(packs, 1000)
    if few is None:
        raise ValueError("more than 1000 capacities to try")
    if not few:
        return sizes.sparkSession.createDataFrame([], "pack_id bigint, container bigint, item bigint, piece int, start_token bigint, n_tokens bigint")
    sizes = cut(sizes.select(F.col(key).alias("item"), F.col(size).alias("size")).distinct())
    windows = max(1, -(-sizes.count() // window))
    # each item goes once to every capacity (a checked handful), and each (capacity, window) is a task's work
    tries = F.array(*[F.struct(F.lit(p).cast("bigint").alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in few])
    placed = sizes.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(windows)).alias("window"), F.explode(tries).alias("try"))
    each = placed.groupBy("try.pack_id", "try.capacity", "window").agg(F.collect_list(F.struct("item", "size")).alias("items")).select("pack_id", "capacity", "window", "items")
    return each.mapInArrow(_pack_rows, "pack_id bigint, container bigint, item bigint, piece int, start_token bigint, n_tokens bigint")
