"""Packing: minimum bin slack over a multiset of remaining lengths.

Documents become token ids and an end id.  Full windows are cut off the front,
each a sequence of its own; what remains of a document (shorter than a window)
is packed whole.  Packing runs in shards of a few thousand pieces, by a hash of
the piece, so its memory and time per task do not grow with the corpus; a
shard loses at most its last sequence's padding.

Within a shard, pieces of equal length are interchangeable, so the state is a
count per length.  For each window the largest remaining length is fixed and a
subset-sum dynamic programme over one bit set (bit s: sum s can be reached)
finds the multiset closest to the capacity; backtracking through the bit sets
kept after each length gives how often each length is used, and the same
filling is repeated as often as the counts allow.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import rows_of, stage
from solvefront.llm.tokenization import SLICE_BYTES, default_tokenizer, encoder

WINDOW = 4096
END_ID = 2
SHARD_PIECES = 4096


def fill_window(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset with the largest length in ``lengths`` (descending) whose sum is nearest ``capacity`` from below.

    Each length is entered in binary portions of its count, so a length of
    count c costs about log2(c) shifts of the bit set.
    """
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach = 1
    trail: list[tuple[int, int, int]] = []  # (length, portion, bits before it)
    for length in lengths:
        if length > room:
            continue
        left = counts[length] - (length == first)
        left = min(left, room // length)
        portion = 1
        while left > 0:
            take = min(portion, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            portion <<= 1
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = Counter({first: 1})
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  Pieces of one length are dealt in the order given."""
    order = np.argsort(-lengths, kind="stable")
    counts = Counter(lengths.tolist())
    places: dict[int, list[int]] = {}
    for i in order.tolist():
        places.setdefault(int(lengths[i]), []).append(i)
    nxt = dict.fromkeys(places, 0)
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    remaining = sorted(counts, reverse=True)
    b = 0
    while remaining:
        used = fill_window(counts, remaining, capacity)
        for _ in range(min(counts[n] // k for n, k in used.items())):
            at = 0
            for n, k in sorted(used.items(), reverse=True):
                for _ in range(k):
                    i = places[n][nxt[n]]
                    nxt[n] += 1
                    bins[i], offsets[i] = b, at
                    at += n
                counts[n] -= k
            b += 1
        remaining = [n for n in remaining if counts[n]]
    return bins, offsets


def token_pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None,
    window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True,
) -> DataFrame:
    """Cut each document's ids (with ``end_id`` last) into full windows and a remainder.

    Returns key, start, length, ids_crc32 (little-endian unsigned 32-bit ids),
    doc_tokens, and ids unless ``keep_ids`` is False.  A null or empty text is
    the end id alone.  Repeated rows are pieces of their own.
    """
    name = tokenizer or default_tokenizer()
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids array<int>" if keep_ids else ""
    kind = pa.int64() if df.schema[key].dataType.simpleString() == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for b in rows_of(batches, text, SLICE_BYTES):
            flat, bounds = enc.ids(b.column(1))
            flat = np.insert(flat, bounds[1:], np.uint32(end_id)).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            size = np.diff(bounds)
            pieces = -(-size // window)
            row = np.repeat(np.arange(len(size)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, size[row] - start)
            total = size[row]
            at = bounds[row] + start
            parts = [flat[lo:hi] for lo, hi in zip(at.tolist(), (at + length).tolist(), strict=True)]
            crc = [zlib.crc32(x) for x in parts]
            cut = [x.astype(np.int32) for x in parts] if keep_ids else []
            keys = b.column(0).take(pa.array(row, pa.int32()))
            out = [keys.cast(kind) if kind else keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = [key, "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                out.append(pa.array(cut, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select(key, text).mapInArrow(run, schema)


def pack_pieces(spark: SparkSession, pieces: DataFrame, key: str = "doc_id", *, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to staged pieces.

    ``pieces`` is read twice (its count, its rows), so stage it first.  Shards
    are dealt by a hash of the whole piece but its ids: a hot key, a hot length
    or a group of copies spreads, and a rerun deals alike.  Pieces equal in all
    columns may swap places, which changes no row.  No piece: no row.  A number
    of the piece in ``_piece`` passes through and decides nothing.
    """
    n = pieces.count()
    shards = max(1, math.ceil(n / shard_pieces))
    digest = [c for c in pieces.columns if c not in ("ids", "_piece")]
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(*digest), F.lit(shards)))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    by = [(c, "ascending") for c in ("length", "start", "ids_crc32", key)]

    def run(shard: tuple, t: pa.Table) -> pa.Table:
        t = t.drop_columns(["shard"]).sort_by(by)
        bins, offsets = minimum_bin_slack(t.column("length").to_numpy(), window)
        # A sequence's number: its shard and its place there; a shard has no more sequences than pieces, far below 2^32.
        ids = bins + (shard[0].as_py() << 32)
        return t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("shard").applyInArrow(run, schema)


def pack_documents(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Tokens to packed sequences: cut, stage, pack.  See the parts for nulls and repeats.

    Packing needs lengths only, so no Python worker gets the ids again: they
    meet their pieces' places in a join, by a number staged with both.
    """
    pieces = token_pieces(df, key, text, tokenizer=tokenizer, window=window, end_id=end_id, keep_ids=keep_ids)
    if not keep_ids:
        return pack_pieces(spark, stage(spark, pieces, "pieces"), key, window=window)
    staged = stage(spark, pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    placed = pack_pieces(spark, staged.drop("ids"), key, window=window)
    # Places are some 100 bytes a piece and pieces spread evenly by number: hashed, so that the ids pass by unsorted.
    return staged.select("_piece", "ids").join(placed.hint("shuffle_hash"), "_piece").select(*pieces.columns, "sequence_id", "offset")
