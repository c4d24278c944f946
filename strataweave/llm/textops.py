"""Array kernels that tasks run on Arrow batches of texts.

Texts are handled as UTF-8 bytes. A word is a run of bytes other than space, tab, LF, VT, FF and CR,
which is what ``bytes.split`` does. Hashes are polynomial over bytes (words) or over mixed word
hashes (windows), taken from prefix sums, so a batch costs a few passes whatever the window length.
Batches are cut into pieces of a bounded number of bytes; only a single text can exceed the bound.
"""

from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PIECE_BYTES = 2 << 20
_MASK = (1 << 64) - 1
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASE = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_WINDOW_BASE = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values)), dtype=np.uint64, out=out[1:])
    return out


def _between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 1 << 64)
    return (sums[ends] - sums[starts]) * _power(inverse, len(sums))[starts]


def pieces(column: pa.Array | list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row + 1, texts) of consecutive rows, about ``limit`` bytes each; null is empty."""
    texts, size, first = [], 0, 0
    for row, value in enumerate(column):
        text = value if isinstance(value, bytes) else value.as_py() or b""
        if texts and size + len(text) > limit:
            yield first, row, texts
            texts, size, first = [], 0, row
        texts.append(text)
        size += len(text)
    if texts:
        yield first, first + len(texts), texts


class Words:
    """The words of some texts: byte positions, and which words belong to which text."""

    def __init__(self, texts: list[bytes], lower: bool = False, letters: bool = False):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        solid = LETTER[data] if letters else ~SPACE[data]
        edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
        self.solid = solid
        self.data = LOWER[data] if lower else data
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(lengths + 1) - lengths - 1
        self.bounds = np.append(np.searchsorted(self.starts, begins), len(self.starts))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lane: int = 0, ends: np.ndarray | None = None) -> np.ndarray:
        """One 64-bit hash per word (or per word cut at ``ends``)."""
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_LANES[lane]))
        sums = _sums(table[self.data], _WORD_BASE[lane])
        return mix(_between(sums, self.starts, self.ends if ends is None else ends, _WORD_BASE[lane]))


def sequence_sums(hashes: np.ndarray, lane: int = 0) -> np.ndarray:
    return _sums(hashes, _WINDOW_BASE[lane])


def sequence_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the word sequences [starts, ends); equal sequences get equal hashes."""
    return mix(_between(sums, starts, ends, _WINDOW_BASE[lane]) + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words, those across two texts included."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(len(hashes) - n + 1)
    return sequence_hashes(sequence_sums(hashes, lane), starts, starts + n, lane)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(
            held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns)
        ):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for cut in cuts:
            yield pa.Table.from_batches([*held, batch.slice(start, cut - start)])
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def ship(spark: SparkSession) -> None:
    """Give the package to all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_strataweave_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    target = pathlib.Path(tempfile.mkdtemp(prefix="strataweave-")) / "strataweave-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._strataweave_shipped = True


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` for functions that use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
