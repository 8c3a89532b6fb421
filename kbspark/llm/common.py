"""Scratch tables, hashing and joins that the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..sources.scratch import Stored, fresh_path  # noqa: F401
from ..sources.scratch import stored as store  # noqa: F401

#: The white space of every word contract: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Words whose hash a Python worker remembers. When full the memory is cleared, so it is bounded.
WORDS_REMEMBERED = 250_000


def normalised(c: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def own_id(rows: DataFrame, column: str) -> tuple[Column, str, pa.DataType]:
    """An id as the operators hold it, with its types: integers as long, anything else as a string, ordered as such."""
    whole = isinstance(rows.schema[column].dataType, (ByteType, ShortType, IntegerType, LongType))
    return F.col(column).cast("long" if whole else "string"), "long" if whole else "string", pa.int64() if whole else pa.string()


#: A key is hot with at least this share of the rows, and with as many rows at least. At most 1,000 keys are hot.
HOT_SHARE, HOT_ROWS = 1_000, 200


def attach(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on key (inner, left or left_anti), where right has one row per key and in count how many rows of left carry it.

    total: the rows of left. Keys with at least a thousandth of them (and 200 rows) number at most 1,000, so they can
    always be broadcast; the others go through a shuffle, in which no key then has more than a thousandth of the rows.
    Both inputs are read twice, so pass stored tables.
    """
    floor = max(total // HOT_SHARE, HOT_ROWS)
    hot = F.broadcast(right.where(F.col(count) >= floor))
    cold = right.where(F.col(count) < floor)
    rest = left.join(hot.select(key), key, "left_anti")
    return rest.join(cold, key, how) if how == "left_anti" else left.join(hot, key).unionByName(rest.join(cold, key, how))


#: Bits of a filter for each member, and bits of one at most (as a power of 2: 32 MB).
FILTER_BITS, MOST_BITS = 16, 28


def marked(rows: DataFrame, key: Column, members: DataFrame, member: str, flag: str = "_maybe") -> DataFrame:
    """rows with a boolean flag, which is false only where key is not among the values of member in members.

    A bitmap has a bit for each residue of the members' hashes. It is sized by their count up to 32 MB, so it can always
    be broadcast; with far more members than bits it lets all rows through, which then take the way of the members.
    Built-in functions only. members is read twice, so pass a stored table.
    """
    bits = min(MOST_BITS, max(15, (FILTER_BITS * members.count()).bit_length()))
    residue = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)) + 1
    of = members.select(residue(F.col(member)).alias("_r"))
    parts = of.groupBy(F.bitmap_bucket_number("_r").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_r")).alias("_bits"))
    at = F.bitmap_bit_position(residue(key))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(parts), F.bitmap_bucket_number(residue(key)) == F.col("_bucket"), "left")
    return found.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def without(rows: DataFrame, id_col: str, gone: DataFrame, total: int) -> DataFrame:
    """rows, with its own columns, without those whose id is in gone (_gone: an id, _rows: how many rows have it).

    Rows that the filter of marked() clears are kept where they are read; only the others are shuffled. Null ids stay.
    """
    held = [rows[c] for c in rows.columns]
    keyed = rows.select(F.struct(*held).alias("_row"), own_id(rows, id_col)[0].alias("_gone"))
    keyed = marked(keyed, F.col("_gone"), gone, "_gone")
    kept = keyed.where(~F.col("_maybe") | F.col("_gone").isNull())
    rest = attach(keyed.where(F.col("_maybe") & F.col("_gone").isNotNull()), gone, "_gone", "_rows", total, "left_anti")
    return kept.select("_row.*").unionByName(rest.select("_row.*"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def blobs(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, 4096), base % (1 << 64), np.uint64)
        factors[0] = 1
        held = _powers[base] = np.cumprod(factors)
    return held[:n]


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive ids, the same wherever it stands; empty if there are fewer."""
    n = len(ids) - width + 1
    if n <= 0 or width <= 0:
        return np.empty(0, np.uint64)
    if width <= 5:
        out = ids[:n].copy()
        for i in range(1, width):
            out *= np.uint64(_BASE)
            out += ids[i : i + n]
        return mix(out)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * _power(pow(_BASE, -1, 1 << 64), len(ids)))])
    return mix((sums[width:] - sums[:n]) * _power(_BASE, n))


def stretches(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ids, of any length, the same wherever it stands."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * _power(pow(_BASE, -1, 1 << 64), len(ids)))])
    return mix((sums[ends] - sums[starts]) * _power(_BASE, len(ids))[starts] + (ends - starts).astype(np.uint64))

