"""64-bit FNV-1a as Spark columns.

Three routes give the same value, a BIGINT holding the unsigned bit pattern:

* `fnv1a64` is a plain column expression for short keys (ids, `seed:name:id` strings).
* `fnv1a64_text` hashes keys that hold whole texts through Arrow, a batch at a time.
* `fnv1a64_tokens` hashes a whole token array per row through Arrow. Distinct tokens of a batch
  are dictionary-encoded first, so a token is hashed once per batch and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a 64-bit parameters.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
LIMB = 0xFFFFFFFF
PRIME_LOW = 435  # FNV_PRIME = 2**40 + 435


def fnv1a64(key: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of `key`; two 32-bit limbs because BIGINT products overflow under ANSI."""
    digits = F.hex(F.encode(key, "UTF-8"))
    octets = F.when(
        F.length(digits) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)),
            lambda i: F.conv(digits.substr(i, F.lit(2)), 16, 10).cast("bigint"),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(FNV_OFFSET >> 32).alias("hi"), F.lit(FNV_OFFSET & LIMB).alias("lo"))

    def step(acc: Column, octet: Column) -> Column:
        mixed = acc["lo"].bitwiseXOR(octet)
        low = mixed * PRIME_LOW
        carry = F.shiftrightunsigned(low, 32)
        high = acc["hi"] * PRIME_LOW + F.shiftleft(mixed, 8).bitwiseAND(F.lit(LIMB)) + carry
        return F.struct(high.bitwiseAND(F.lit(LIMB)).alias("hi"), low.bitwiseAND(F.lit(LIMB)).alias("lo"))

    return F.aggregate(octets, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def umod(hashed: Column, n: int | Column) -> Column:
    """Unsigned `hashed % n` for 0 < n < 2**31."""
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n.cast("bigint")
    high = F.shiftrightunsigned(hashed, 32)
    low = hashed.bitwiseAND(F.lit(LIMB))
    return ((high % n) * (F.lit(1 << 32) % n) + low % n) % n


def hash_bit(hashed: Column, position: int) -> Column:
    return F.shiftrightunsigned(hashed, position).bitwiseAND(F.lit(1).cast("bigint"))


def unit53(hashed: Column) -> Column:
    """(h >> 11) / 2**53."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def unit_mod(hashed: Column, n: int) -> Column:
    """(h % n) / n, used with one million and ten million."""
    return umod(hashed, n).cast("double") / F.lit(float(n))


def hash_octets(values: pa.Array) -> np.ndarray:
    """FNV-1a of every string in an Arrow array, column of bytes by column of bytes."""
    values = values.cast(pa.large_binary())
    if len(values) == 0:
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    starts, lengths = offsets[:-1], np.diff(offsets)
    out = np.full(len(values), FNV_OFFSET, dtype=np.uint64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    hashed = out[order]
    live = len(values)
    for position in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths[:live], -position, side="left"))
        octet = data[starts[:live] + position].astype(np.uint64)
        hashed[:live] = (hashed[:live] ^ octet) * np.uint64(FNV_PRIME)
    out[order] = hashed
    return out


PIECE_TOKENS = 1 << 18  # tokens of a batch that are worked on at a time


def list_pieces(batch: pa.Array, most: int = PIECE_TOKENS) -> Iterator[pa.Array]:
    """An Arrow list array in consecutive slices of at most `most` values each; a longer row is a slice of its own.

    What a task holds beside its batch is then bounded by the slice, not by the rows of a batch times their length.
    """
    ends = np.cumsum(list_lengths(batch))
    start = 0
    while start < len(batch):
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def hash_batch(flat: pa.Array) -> np.ndarray:
    encoded = flat.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    distinct = hash_octets(encoded.dictionary)
    return distinct[encoded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.uint64)


def list_lengths(batch: pa.Array) -> np.ndarray:
    return np.asarray(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)


def list_parts(batch: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flattened values and per-row lengths of an Arrow list array (null rows count as empty)."""
    return batch.flatten(), list_lengths(batch)


@F.arrow_udf(T.LongType())
def fnv1a64_text(batch: pa.Array) -> pa.Array:
    return pa.array(hash_octets(batch.fill_null("")).view(np.int64))


@F.arrow_udf(T.ArrayType(T.LongType()))
def fnv1a64_tokens(batch: pa.Array) -> pa.Array:
    hashed = [hash_batch(piece.flatten()).view(np.int64) for piece in list_pieces(batch)]
    offsets = np.concatenate([[0], np.cumsum(list_lengths(batch))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashed or [np.zeros(0, np.int64)])))


def hash_embedding(tokens: Column, dims: int = 64) -> Column:
    """Signed hashing embedding of a token array, L2-normalised; all zeros for no tokens."""

    def dense_rows(piece: pa.Array) -> np.ndarray:
        flat, lengths = list_parts(piece)
        hashed = hash_batch(flat)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        slot = (hashed % np.uint64(dims)).astype(np.int64)
        sign = np.where((hashed >> np.uint64(8)) & np.uint64(1), -1.0, 1.0)
        dense = np.bincount(rows * dims + slot, weights=sign, minlength=len(lengths) * dims).astype(np.float64).reshape(-1, dims)
        norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        norm[norm == 0.0] = 1.0
        dense /= norm
        return dense

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(batch: pa.Array) -> pa.Array:
        dense = np.concatenate([np.zeros((0, dims)), *map(dense_rows, list_pieces(batch))])
        offsets = np.arange(0, dense.size + 1, dims, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(dense.ravel()))

    return embed(tokens)


@F.arrow_udf(T.LongType())
def activation_mask(batch: pa.Array) -> pa.Array:
    """OR of bit `fnv % 64` over every token longer than one character."""
    return pa.array(np.concatenate([np.zeros(0, np.int64), *map(_masks, list_pieces(batch))]))


def _masks(piece: pa.Array) -> np.ndarray:
    flat, lengths = list_parts(piece)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    encoded = flat.dictionary_encode()
    if len(encoded.dictionary):
        long_enough = np.array([len(t) > 1 for t in encoded.dictionary.to_pylist()])
        bits = np.left_shift(np.uint64(1), hash_octets(encoded.dictionary) & np.uint64(63))
        bits = np.where(long_enough, bits, np.uint64(0))[encoded.indices.to_numpy(zero_copy_only=False)]
    else:
        bits = np.zeros(0, np.uint64)
    masks = np.zeros(len(lengths), dtype=np.uint64)
    np.bitwise_or.at(masks, rows, bits)
    return masks.view(np.int64)
