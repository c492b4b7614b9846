"""Deterministic sampling of positions by hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def probe_indices(name: Column, draws: int, size: int) -> Column:
    """Sorted distinct positions below `size`: 60 bits of SHA-256 of "name:draw", for each draw."""
    one = lambda i: F.pmod(F.conv(F.substring(F.sha2(F.concat(name, F.lit(":"), i.cast("string")), 256), 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), one)))


# Constants of the public SeedSequence and PCG64 (XSL-RR) generators.
INIT_A, MULT_A, INIT_B, MULT_B = 0x43B0D7E5, 0x931E8875, 0x8B51F9DD, 0x58F38DED
MIX_L, MIX_R = 0xCA01F9DD, 0x4973F715
PCG_MULT = 0x2360ED051FC65DA44385DF649FCCF645

_U32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _mul(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low words of 64-bit products."""
    a0, a1, b0, b1 = a & _LOW, a >> _U32, b & _LOW, b >> _U32
    mid = a1 * b0 + (a0 * b0 >> _U32)
    cross = a0 * b1 + (mid & _LOW)
    return a1 * b1 + (mid >> _U32) + (cross >> _U32), a * b


def _seeded(seed: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit words of state for each 64-bit seed."""
    const = INIT_A

    def stirred(x: np.ndarray, mult: int) -> np.ndarray:
        nonlocal const
        x = x ^ np.uint32(const)
        const = const * mult & 0xFFFFFFFF
        x = x * np.uint32(const)
        return x ^ (x >> np.uint32(16))

    zero = np.zeros(len(seed), np.uint32)
    pool = [stirred(x, MULT_A) for x in ((seed & _LOW).astype(np.uint32), (seed >> _U32).astype(np.uint32), zero, zero)]
    for i in range(4):
        for j in range(4):
            if i != j:
                x = np.uint32(MIX_L) * pool[j] - np.uint32(MIX_R) * stirred(pool[i], MULT_A)
                pool[j] = x ^ (x >> np.uint32(16))
    const = INIT_B
    half = [stirred(pool[i % 4], MULT_B).astype(np.uint64) for i in range(8)]
    return [half[i] | half[i + 1] << _U32 for i in range(0, 8, 2)]


class Generators:
    """One PCG64 for each seed, all stepped together as 128-bit arithmetic on arrays. Each keeps the unused half of
    its last word, as its 32-bit draws do."""

    def __init__(self, seed: np.ndarray):
        s = _seeded(seed.astype(np.uint64))
        self.inc = s[2] << np.uint64(1) | s[3] >> np.uint64(63), s[3] << np.uint64(1) | np.uint64(1)
        zero = np.zeros(len(seed), np.uint64)
        self.state = self._added(self._stepped((zero, zero), self.inc), (s[0], s[1]))
        self.state = self._stepped(self.state, self.inc)
        self.half, self.kept = zero.copy(), np.zeros(len(seed), bool)

    @staticmethod
    def _added(a: tuple, b: tuple) -> tuple:
        low = a[1] + b[1]
        return a[0] + b[0] + (low < a[1]).astype(np.uint64), low

    def _stepped(self, s: tuple, inc: tuple) -> tuple:
        high, low = np.uint64(PCG_MULT >> 64), np.uint64(PCG_MULT & (1 << 64) - 1)
        top, out = _mul(s[1], np.full(len(s[1]), low))
        return self._added((top + s[0] * low + s[1] * high, out), inc)

    def next64(self, who: np.ndarray) -> np.ndarray:
        high, low = self._stepped((self.state[0][who], self.state[1][who]), (self.inc[0][who], self.inc[1][who]))
        self.state[0][who], self.state[1][who] = high, low
        x, turn = high ^ low, high >> np.uint64(58)
        return x >> turn | x << (np.uint64(64) - turn & np.uint64(63))

    def next32(self, who: np.ndarray) -> np.ndarray:
        out = self.half[who]
        fresh = ~self.kept[who]
        if fresh.any():
            x = self.next64(who[fresh])
            out[fresh], self.half[who[fresh]] = x & _LOW, x >> _U32
        self.kept[who] = fresh
        return out

    def below(self, size: np.ndarray) -> np.ndarray:
        """A number below each size (1 to 2^63), by multiplication with rejection."""
        out = np.zeros(len(size), np.uint64)
        for wide in (False, True):
            left = np.flatnonzero((size > 1) & ((size > 2**32) == wide))
            floor = ((np.uint64(0) if wide else np.uint64(2**32)) - size[left]) % size[left] if len(left) else left
            while len(left):
                n = size[left]
                if wide:
                    got, rest = _mul(self.next64(left), n)
                else:
                    x = self.next32(left) * n
                    got, rest = x >> _U32, x & _LOW
                out[left] = got
                again = rest < floor
                left, floor = left[again], floor[again]
        return out


def numpy_probes(rows: DataFrame, key: str, name: str, size: str, count: int = 16) -> DataFrame:
    """(key, probes): for each row the sorted distinct values of `count` draws below `size` that NumPy's default
    generator makes from the first 64 bits of the name's SHA-256. A batch of names is one set of arrays."""
    ship(rows.sparkSession)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype(np.uint64)
            size = b.column(2).to_numpy().astype(np.uint64)
            g = Generators(seed)
            draws = np.sort(np.stack([g.below(size) for _ in range(count)], axis=1).astype(np.int64), axis=1)
            new = np.ones(draws.shape, bool)
            new[:, 1:] = draws[:, 1:] != draws[:, :-1]
            at = np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(draws[new]))], ["key", "probes"])

    seed = F.unhex(F.substring(F.sha2(F.col(name).cast("string"), 256), 1, 16))
    kind = rows.schema[key].dataType.simpleString()
    return rows.filter(F.col(name).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("key"), seed.alias("seed"), F.col(size).cast("long").alias("size")).mapInArrow(turn, f"key {kind}, probes array<long>")
