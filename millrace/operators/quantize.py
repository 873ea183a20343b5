"""Block quantization of float arrays: FP4 (E2M1) groups of 32 and FP8 (E4M3) blocks, with power-of-two scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the number formats.
FP8_MAX = 448.0
FP8_BLOCK = 128
FP4_MAX = 6.0
FP4_GROUP = 32
FP4_GRID = np.array([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0], np.float32)
LEAST_EXPONENT = -127


def exponents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor, ceiling) of log2, exact at powers of two; zero gives the least exponent, denormals the least floor."""
    fraction, power = np.frexp(np.asarray(x, np.float32))
    tiny = x < np.float32(2.0**-126)
    floor = np.where(tiny, LEAST_EXPONENT, power - 1)
    ceiling = np.where(x == 0, LEAST_EXPONENT, np.where(tiny, LEAST_EXPONENT + 1, power - (fraction == 0.5)))
    return floor.astype(np.int32), ceiling.astype(np.int32)


def _on_grid(magnitude: np.ndarray) -> np.ndarray:
    """Codes 0 to 7 of the nearest grid value, ties to the even code."""
    middle = (FP4_GRID[1:] + FP4_GRID[:-1]) / 2
    low = np.searchsorted(middle, magnitude, side="left")
    tie = (low < 7) & (magnitude == middle[np.minimum(low, 6)])
    return np.where(tie & (low % 2 == 1), low + 1, low).astype(np.uint8)


def fp4_groups(values: np.ndarray, rule: str = "floor") -> tuple[np.ndarray, np.ndarray]:
    """(codes, exponents) of groups along the last axis. min_error takes twice the scale where that errs less."""
    if not np.isfinite(values).all():
        raise ValueError("values must be finite")
    groups = np.asarray(values, np.float32).reshape(*values.shape[:-1], -1, FP4_GROUP)
    exponent = np.maximum(exponents(np.abs(groups).max(-1))[0] - 2, LEAST_EXPONENT)

    def coded(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = np.ldexp(np.float32(1), e)[..., None]
        codes = _on_grid(np.minimum(np.abs(groups) / scale, FP4_MAX))
        return codes, np.square(FP4_GRID[codes] * scale - np.abs(groups)).sum(-1)

    codes, error = coded(exponent)
    if rule == "min_error":
        wider, wider_error = coded(exponent + 1)
        better = wider_error < error
        codes = np.where(better[..., None], wider, codes)
        exponent = exponent + better
    elif rule != "floor":
        raise ValueError(f"unknown rule {rule!r}")
    return codes | np.signbit(groups).astype(np.uint8) << 3, exponent


def fp4_values(codes: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    sign = np.where(codes & 8, np.float32(-1), np.float32(1))
    return sign * FP4_GRID[codes & 7] * np.ldexp(np.float32(1), exponent)[..., None]


def fp8_block(values: np.ndarray) -> tuple[np.ndarray, int]:
    """(rounded values over the scale, exponent) of one block; the greatest value never saturates."""
    if not np.isfinite(values).all():
        raise ValueError("values must be finite")
    amax = np.float32(np.abs(values).max(initial=0))
    exponent = int(exponents(np.array([amax / np.float32(FP8_MAX)], np.float32))[1][0])
    q = np.clip(np.asarray(values, np.float32) / np.ldexp(np.float32(1), exponent), -FP8_MAX, FP8_MAX)
    step = np.ldexp(np.float32(1), np.maximum(exponents(np.abs(q))[0], -6) - 3)
    return np.rint(q / step) * step, exponent


def fp8_tiles(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rounded values over their scales, exponents by tile) of a matrix in tiles of 128 by 128; ValueError for other shapes."""
    if weight.ndim != 2 or any(n % FP8_BLOCK for n in weight.shape):
        raise ValueError(f"a matrix of whole tiles of {FP8_BLOCK} is needed, not {weight.shape}")
    down, across = (n // FP8_BLOCK for n in weight.shape)
    codes, found = np.empty(weight.shape, np.float32), np.empty((down, across), np.int32)
    for i, j in np.ndindex(down, across):
        tile = np.s_[i * FP8_BLOCK : (i + 1) * FP8_BLOCK, j * FP8_BLOCK : (j + 1) * FP8_BLOCK]
        codes[tile], found[i, j] = fp8_block(weight[tile])
    return codes, found


def fp8_tile_values(codes: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """The matrix that fp8_tiles() stands for."""
    return codes * np.kron(np.ldexp(np.float32(1), exponent), np.ones((FP8_BLOCK, FP8_BLOCK), np.float32))


def fp8_matrix_round_trip(df: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(key, exponents, max_error, n_exact, n_zero_tiles) of matrices given row by row, ``width`` values a row; padded with zeros to whole tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in batch.column(column).to_pylist():
                own = np.array(values or [], np.float32).reshape(-1, width)
                padded = np.pad(own, [(0, -n % FP8_BLOCK) for n in own.shape])
                codes, exponent = fp8_tiles(padded)
                gap = np.abs(fp8_tile_values(codes, exponent) - padded)[: own.shape[0], : own.shape[1]]
                rows.append((exponent.reshape(-1).tolist(), float(gap.max(initial=0)), int((gap == 0).sum()), int((exponent == LEAST_EXPONENT).sum())))
            kinds = [pa.list_(pa.int32()), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], [key, "exponents", "max_error", "n_exact", "n_zero_tiles"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, exponents array<int>, max_error double, n_exact long, n_zero_tiles long")


def round_trip_counters(df: DataFrame, by: str) -> DataFrame:
    """Counters by class of tensors coded again, from columns value_exact, codes_exact (boolean), scales, again (exponents by
    block), negative_zeros, zero_blocks: (by, tensors, value_exact, codes_exact, scales_exact, negative_zeros, zero_blocks, scale_ratios)."""
    gaps = F.filter(F.zip_with("scales", "again", lambda a, b: a - b), lambda d: d != 0)
    rows = df.withColumn("__gaps", gaps)
    total = rows.groupBy(by).agg(
        F.count("*").alias("tensors"),
        *[F.count_if(F.col(c)).alias(c) for c in ("value_exact", "codes_exact")],
        F.count_if(F.size("__gaps") == 0).alias("scales_exact"),
        *[F.sum(c).cast("long").alias(c) for c in ("negative_zeros", "zero_blocks")],
    )
    ratios = rows.select(F.col(by).alias("__by"), F.explode("__gaps").alias("gap")).groupBy("__by", "gap").agg(F.count("*").alias("n"))
    ratios = ratios.groupBy("__by").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("gap", "n")))).alias("scale_ratios"))  # few powers of two
    return total.join(ratios, total[by].eqNullSafe(ratios["__by"]), "left").drop("__by")


def pack_nibbles(codes: np.ndarray) -> bytes:
    flat = codes.reshape(-1)
    return (flat[0::2] | flat[1::2] << 4).astype(np.uint8).tobytes()


def unpack_nibbles(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    return np.stack([raw & 15, raw >> 4], axis=-1).reshape(-1)


def fp4_round_trip(df: DataFrame, key: str, column: str, rule: str = "floor") -> DataFrame:
    """(key, packed, scales, max_error, n_exact, n_negative_zero, n_zero_groups); arrays are padded with zeros to whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in batch.column(column).to_pylist():
                own = np.array(values or [], np.float32)
                padded = np.concatenate([own, np.zeros(-len(own) % FP4_GROUP, np.float32)])
                codes, scale = fp4_groups(padded, rule)
                back = fp4_values(codes, scale).reshape(-1)[: len(own)]
                gap = np.abs(back - own)
                rows.append((pack_nibbles(codes), scale.reshape(-1).astype(int).tolist(), float(gap.max(initial=0)), int((gap == 0).sum()), int((codes.reshape(-1)[: len(own)] == 8).sum()), int((np.abs(padded.reshape(-1, FP4_GROUP)).max(-1, initial=0) == 0).sum()) if len(padded) else 0))
            kinds = [pa.binary(), pa.list_(pa.int32()), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], [key, "packed", "scales", "max_error", "n_exact", "n_negative_zero", "n_zero_groups"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, packed binary, scales array<int>, max_error double, n_exact long, n_negative_zero long, n_zero_groups long")


def fp8_round_trip(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, exponents, max_relative_error): each run of 128 values as a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in batch.column(column).to_pylist():
                own = np.array(values or [], np.float32)
                found, worst = [], 0.0
                for at in range(0, len(own), FP8_BLOCK):
                    block = own[at : at + FP8_BLOCK]
                    q, e = fp8_block(block)
                    found.append(e)
                    worst = max(worst, float((np.abs(q * np.ldexp(np.float32(1), e) - block) / np.maximum(np.abs(block).max(), np.float32(1e-30))).max()))
                rows.append((found, worst))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.float64())], [key, "exponents", "max_relative_error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, exponents array<int>, max_relative_error double")
