"""Content-defined chunking: a byte kernel for files and a word form in plain SQL for texts.

The byte kernel is a gear-hash chunker with normalised cut probability: below the target size a cut needs more zero
bits of the rolling hash than above it. The hash at a byte depends on the last 64 bytes only, so it is computed for
all places at once; only the places whose hash may cut are then walked in order. Files are read and cut block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schemas import CHUNKS, MAX_CHUNK

#: One 64-bit number for each byte, by rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear" + bytes([i])).digest()[:8], "little") for i in range(256)], np.uint64)
_SEGMENT = 1 << 20


@dataclass(frozen=True)
class Config:
    """Chunks are at least min and at most max bytes, about target on the whole."""

    target: int
    min: int
    max: int

    @classmethod
    def of(cls, target: int) -> Config:
        return cls(target, target // 4, min(target * 4, MAX_CHUNK)).check()

    def check(self) -> Config:
        if not 256 <= self.target <= 4 << 20:
            raise ValueError(f"target size {self.target} is out of range")
        if not 64 <= self.min <= self.target <= self.max <= MAX_CHUNK:
            raise ValueError("sizes must not fall from min to target to max")
        return self


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 64 bytes' numbers, each shifted by its distance."""
    out = GEAR[data]
    for k in range(6):  # doubles the window each time
        step = 1 << k
        out[step:] = out[step:] + (out[:-step] << np.uint64(step))
    return out


class Stream:
    """Cuts bytes as they come, for several configs from one pass of hashing.

    feed() and close() give, for each config, the (start, end) of the chunks that are decided. A chunk is decided once
    as many bytes are there as it can have at most, so no more than one largest chunk and a block are ever held.
    """

    def __init__(self, configs: list[Config], keep: bool = True):
        self.configs, self.keep = configs, keep
        self.bits = [max(1, c.target.bit_length() - 1) for c in configs]
        self.loosest = min(self.bits) - 1
        self.size = self.base = 0
        self.tail, self.held = np.zeros(0, np.uint8), bytearray()
        self.starts = [0] * len(configs)
        none = np.zeros(0, np.int64)
        self.hard, self.easy = [none] * len(configs), [none] * len(configs)

    def feed(self, data: bytes) -> list[list[tuple[int, int]]]:
        raw = np.concatenate((self.tail, np.frombuffer(data, np.uint8)))
        lead = len(self.tail)
        h = rolling(raw)[lead:]
        hit = np.flatnonzero(h >> np.uint64(64 - self.loosest) == 0)
        value, end = h[hit], hit + self.size + 1
        for k, b in enumerate(self.bits):
            self.hard[k] = np.concatenate((self.hard[k], end[value >> np.uint64(64 - b - 1) == 0]))
            self.easy[k] = np.concatenate((self.easy[k], end[value >> np.uint64(64 - b + 1) == 0] if b > 1 else end))
        self.size += len(data)
        self.tail = raw[-63:].copy()
        if self.keep:
            self.held += data
        return self._decide(False)

    def close(self) -> list[list[tuple[int, int]]]:
        return self._decide(True)

    def bytes(self, start: int, end: int) -> bytes:
        """The bytes of a chunk that the last call gave."""
        return bytes(self.held[start - self.base : end - self.base])

    def trim(self) -> None:
        """Lets go of what lies before all configs' next chunks."""
        least = min(self.starts)
        del self.held[: least - self.base]
        self.base = least

    def _decide(self, last: bool) -> list[list[tuple[int, int]]]:
        out = []
        for k, c in enumerate(self.configs):
            spans, start, hard, easy = [], self.starts[k], self.hard[k], self.easy[k]
            while start + c.max <= self.size or (last and start < self.size):
                end = self._end(c, start, hard, easy)
                spans.append((start, end))
                start = end
            self.starts[k] = start
            self.hard[k], self.easy[k] = hard[np.searchsorted(hard, start) :], easy[np.searchsorted(easy, start) :]
            out.append(spans)
        return out

    def _end(self, c: Config, start: int, hard: np.ndarray, easy: np.ndarray) -> int:
        middle, most = start + c.target, min(start + c.max, self.size)
        i = np.searchsorted(hard, start + max(c.min, 1))
        if i < len(hard) and hard[i] <= min(middle, most):
            return int(hard[i])
        if middle < most:
            j = np.searchsorted(easy, middle + 1)
            if j < len(easy) and easy[j] < most:
                return int(easy[j])
        return most


def cuts(data: bytes, configs: list[Config]) -> list[list[int]]:
    """The end of every chunk, for each config, from one pass of hashing."""
    stream = Stream(configs, keep=False)
    out: list[list[int]] = [[] for _ in configs]
    for start in range(0, len(data), _SEGMENT):
        for ends, spans in zip(out, stream.feed(data[start : start + _SEGMENT]), strict=True):
            ends += [b for _, b in spans]
    for ends, spans in zip(out, stream.close(), strict=True):
        ends += [b for _, b in spans]
    return out


def chunk_bytes(data: bytes, config: Config, key: bytes | None = None) -> list[tuple[int, int, str]]:
    """Offset, length and id of each chunk; no chunks of nothing."""
    return [(a, b - a, _id(data[a:b], key)) for a, b in _spans(cuts(data, [config])[0])]


def _spans(ends: list[int]) -> list[tuple[int, int]]:
    return list(zip([0, *ends], ends, strict=False))


def _id(data: bytes, key: bytes | None) -> str:
    import hmac

    return hmac.new(key, data, "sha256").hexdigest() if key is not None else hashlib.sha256(data).hexdigest()


def chunked(files: DataFrame, targets: list[int], key: bytes | None = None, with_data: bool = False) -> DataFrame:
    """The chunks of every file for every target size, from one read of its bytes. files: path, content."""
    configs = [Config.of(t) for t in targets]
    names = [f.name for f in CHUNKS.fields] + ["data"] * with_data
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, data = path.as_py(), content.as_py() or b""
                rows = [
                    (path, c.target, i, a, b - a, _id(data[a:b], key), *([data[a:b]] if with_data else ()))
                    for c, ends in zip(configs, cuts(data, configs), strict=True)
                    for i, (a, b) in enumerate(_spans(ends))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS.fields) + ", data binary" * with_data
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def streamed(files: DataFrame, open_: Callable[[str], BinaryIO], targets: list[int], key: bytes | None = None, with_data: bool = False) -> DataFrame:
    """The chunks of files that tasks open and read block by block, so a file of any size fits. files: path.

    open_ gives a file to read for a path; the rows are those of chunked().
    """
    configs = [Config.of(t) for t in targets]
    names = [f.name for f in CHUNKS.fields] + ["data"] * with_data
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                stream, counts, more = Stream(configs), [0] * len(configs), True
                with open_(path) as f:
                    while more:
                        block = f.read(_SEGMENT)
                        more, rows = bool(block), []
                        for k, spans in enumerate(stream.feed(block) if block else stream.close()):
                            for a, b in spans:
                                data = stream.bytes(a, b)
                                rows.append((path, configs[k].target, counts[k], a, b - a, _id(data, key), *([data] if with_data else ())))
                                counts[k] += 1
                        stream.trim()
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS.fields) + ", data binary" * with_data
    return files.select("path").mapInArrow(run, schema)


def threshold(rate: int) -> str:
    """The hex digits that one hash in `rate` is below."""
    return f"{(1 << 32) // rate:08x}"


def word_chunks(texts: DataFrame, *rates: int) -> DataFrame:
    """Chunks of texts cut after a word when the hash of it and the word before is below a rate's threshold.

    texts: path, text. Returns target_size (the rate), path, seq, chunk_id, len (bytes, with the single spaces between
    words). Plain SQL: words are hashed once for all rates, and cut inside their own row, so only chunks leave it.
    """
    words = texts.select("path", F.split("text", " ").alias("w"))
    hashed = F.transform("w", lambda x, i: F.struct((i + 1).alias("i"), F.md5(F.concat_ws(" ", F.get("w", i - 1), x)).alias("h")))
    places = F.filter(hashed, lambda x: (x["h"] < threshold(min(rates))) | (x["i"] == F.size("w")))
    by_rate = words.select("path", "w", places.alias("places")).select("path", "w", "places", F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("rate"), F.lit(threshold(r)).alias("below")) for r in rates])).alias("r"))
    ends = F.transform(F.filter("places", lambda x: (x["h"] < F.col("r.below")) | (x["i"] == F.size("w"))), lambda x: x["i"])
    # each explode holds its array computed once below it
    rows = by_rate.select("path", "w", "r.rate", ends.alias("ends")).select("path", "w", "rate", "ends", F.posexplode("ends").alias("seq", "stop"))
    start = F.coalesce(F.get("ends", F.col("seq") - 1), F.lit(0))
    body = F.array_join(F.slice("w", start + 1, F.col("stop") - start), " ")
    rows = rows.select(F.col("rate").alias("target_size"), "path", "seq", body.alias("body"))
    return rows.select("target_size", "path", F.col("seq").cast("long").alias("seq"), F.md5("body").alias("chunk_id"), F.octet_length("body").cast("long").alias("len"))
