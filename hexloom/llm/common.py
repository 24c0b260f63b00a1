"""What the operators on documents share: text normalisation, splits, batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does just that on plain ASCII and is faster there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches at ``rows`` rows or fewer, so that long texts fit beside each other."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def discard(settled: DataFrame) -> None:
    """Delete the files of a settled frame once whatever was made from it is settled, too."""
    files, jvm = settled.inputFiles(), settled.sparkSession.sparkContext._jvm
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(settled.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; bytes know no other spaces or cases."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """Word to 64-bit hash; forgets everything when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


#: Bytes of texts hashed at a time, and the first words of the secret that xxhash has without a seed.
HASHED = 1 << 22
_S = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e"), "<u8")
_FLIPS = [_S[0] & np.uint64(0xFFFFFFFF) ^ _S[0] >> np.uint64(32), _S[1] ^ _S[2], _S[3] ^ _S[4], _S[5] ^ _S[6]]


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both halves of the product of 64-bit values, one over the other."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a, b, c, d = x & low, x >> half, y & low, y >> half
    middle = (a * c >> half) + (b * c & low) + a * d
    return (b * d + (b * c >> half) + (middle >> half)) ^ x * y


def _xxh3(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxh3 of the stretches of some bytes, none of them empty, as ``WordHashes`` has it; 8 bytes follow the last one."""
    u = np.uint64
    out = np.empty(len(start), np.uint64)
    eight, four = (np.ndarray(len(data) - 7, kind, data, strides=(1,)) for kind in ("<u8", "<u4"))
    few, some, more, many = (np.flatnonzero(f) for f in (size < 4, (size > 3) & (size < 9), (size > 8) & (size < 17), size > 16))

    at, n = start[few], size[few]
    x = (data[at].astype(u) << u(16) | data[at + (n >> 1)].astype(u) << u(24) | data[at + n - 1] | n.astype(u) << u(8)) ^ _FLIPS[0]
    x = (x ^ x >> u(33)) * u(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> u(29)) * u(0x165667B19E3779F9)
    out[few] = x ^ x >> u(32)

    at, n = start[some], size[some]
    x = (four[at + n - 4] + (four[at].astype(u) << u(32))) ^ _FLIPS[1]
    x = (x ^ (x << u(49) | x >> u(15)) ^ (x << u(24) | x >> u(40))) * u(0x9FB21C651E98DF25)
    x = (x ^ (x >> u(35)) + n.astype(u)) * u(0x9FB21C651E98DF25)
    out[some] = x ^ x >> u(28)

    at, n = start[more], size[more]
    x, y = eight[at] ^ _FLIPS[2], eight[at + n - 8] ^ _FLIPS[3]
    x = n.astype(u) + x.byteswap() + y + _folded(x, y)
    x = (x ^ x >> u(37)) * u(0x165667919E3779F9)
    out[more] = x ^ x >> u(32)

    for k in many.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return out


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the ``words`` of each text, without a Python object for each word."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(texts):
        # Whole texts of ``HASHED`` bytes, and one at least.
        end = max(at + int(np.searchsorted(np.cumsum(sizes[at:]), HASHED, side="right")), at + 1)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts[at:end], "")))
        edges, parts = lists.offsets.to_numpy(), lists.values
        _, offsets, data = parts.buffers()
        offsets = np.frombuffer(offsets, "<i4", len(parts) + 1, 4 * parts.offset) if len(parts) else np.zeros(1, np.int32)
        data = np.frombuffer(data or b"", np.uint8, offsets[-1])
        start, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        # White space before the first or after the last word leaves an empty part.
        kept = size > 0
        hashes = _xxh3(np.r_[data, np.zeros(8, np.uint8)], start[kept], size[kept])
        edges = np.r_[0, np.cumsum(kept)][edges]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield hashes[lo:hi]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a multiply and shift finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """64-bit hash of each run of ``width`` words; of the whole sequence if it is shorter; none if empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    factor, span = np.uint64(0x9E3779B97F4A7C15), min(width, n)
    out = np.full(n - span + 1, np.uint64(span), np.uint64)
    for i in range(span):
        out = out * factor + mix(hashes[i : n - span + 1 + i])
    return mix(out)
