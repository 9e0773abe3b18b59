"""Which codec each chunk is stored with, simulated over policies, with throughput projections."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.schemas import FRAME, SEAL

LEVEL, ESCALATED = 3, 9
KEEP, PROBE, ESCALATE = 0.95, 1.02, 2.0
RAW, ZSTD = 0, 1
BANDWIDTHS = (50, 200, 1000)


@dataclass(frozen=True)
class Policy:
    """keep: the largest compressed share that is kept; inf keeps always, 0 never."""

    name: str
    use_probe: bool = False
    escalate: bool = False
    keep: float = KEEP


POLICIES = (Policy("raw-only", keep=0.0), Policy("zstd3-always", keep=float("inf")), Policy("zstd3"), Policy("probe", use_probe=True), Policy("escalate", use_probe=True, escalate=True))


def dimension(spark: SparkSession, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The policies as rows: ord, policy, use_probe, escalate, keep_threshold."""
    return spark.createDataFrame([(i, p.name, p.use_probe, p.escalate, p.keep) for i, p in enumerate(policies)], "ord int, policy string, use_probe boolean, escalate boolean, keep_threshold double")


def choose(data: bytes, policy: Policy, incremental: bool) -> tuple[int, int, bool, bool, bytes]:
    """Codec, stored length, whether the higher level was tried, whether its result was taken, and the payload.

    A cheap probe may rule zstd out; a result above the kept share is stored raw; a chunk that compresses well is
    compressed again at the higher level in the incremental phase, whose result is taken only if it is smaller.
    """
    if not data or policy.keep == 0:
        return RAW, len(data), False, False, data
    if policy.use_probe:
        probe = pa.compress(data, codec="lz4_raw", asbytes=True)
        if len(data) / max(len(probe), 1) < PROBE:
            return RAW, len(data), False, False, data
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(data)
    if len(packed) > len(data) * policy.keep:
        return RAW, len(data), False, False, data
    if policy.escalate and incremental and len(data) / max(len(packed), 1) >= ESCALATE:
        more = zstandard.ZstdCompressor(level=ESCALATED).compress(data)
        return (ZSTD, len(more), True, True, more) if len(more) < len(packed) else (ZSTD, len(packed), True, False, packed)
    return ZSTD, len(packed), False, False, packed


def decode(framed: bytes, most: int = 16 << 20) -> bytes:
    """The chunk of a frame; other codec bytes are an error."""
    if not framed or framed[0] not in (RAW, ZSTD):
        raise ValueError("unknown codec")
    body = framed[1:]
    return body if framed[0] == RAW else zstandard.ZstdDecompressor().decompress(body, max_output_size=most)


def encode(data: bytes, policy: Policy, incremental: bool = False) -> bytes:
    codec, _, _, _, payload = choose(data, policy, incremental)
    return bytes([codec]) + payload


def chosen(chunks: DataFrame, policies: tuple[Policy, ...] = POLICIES, incremental: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk and policy: chunk_id, ord, policy, raw_len, codec, stored_len, attempted, escalated, wall (seconds).

    One pass over the bytes serves all policies. chunks: chunk_id, data, and columns to keep.
    """
    cols = ["chunk_id", *keep]
    kinds = {"ord": pa.int32(), "policy": pa.string(), "raw_len": pa.int64(), "codec": pa.int32(), "stored_len": pa.int64(), "attempted": pa.bool_(), "escalated": pa.bool_(), "wall": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows, out = [], {k: [] for k in kinds}
                for i, data in enumerate(batch.column("data")):
                    raw = data.as_py() or b""
                    for k, policy in enumerate(policies):
                        began = time.perf_counter()
                        codec, size, attempted, escalated, _ = choose(raw, policy, incremental)
                        wall = time.perf_counter() - began
                        rows.append(i)
                        for name, value in zip(kinds, (k, policy.name, len(raw), codec, size, attempted, escalated, wall), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in cols), *(pa.array(out[k], t) for k, t in kinds.items())], [*cols, *kinds])

    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in cols)
    return chunks.select(*cols, "data").mapInArrow(run, schema + ", ord int, policy string, raw_len long, codec int, stored_len long, attempted boolean, escalated boolean, wall double")


def counters(choices: DataFrame, *by: str) -> DataFrame:
    """The counters of each policy: raw, zstd and escalated chunks, attempts at the higher level, bytes in, out and saved.

    choices: codec, raw_len, stored_len, attempted, escalated and perhaps wall, whose sum comes along. Bytes saved are never below 0; empty chunks add none.
    """
    zstd = F.col("codec") == ZSTD
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return choices.groupBy(*by).agg(
        F.count_if(~zstd).alias("raw_chunks"),
        F.count_if(zstd & ~F.col("escalated")).alias("zstd_chunks"),
        F.count_if("escalated").alias("escalated_chunks"),
        F.count_if("attempted").alias("attempts"),
        total("raw_len").alias("bytes_in"),
        total("stored_len").alias("bytes_out"),
        F.greatest(total("raw_len") - total("stored_len"), F.lit(0)).alias("bytes_saved"),
        *([F.coalesce(F.sum("wall"), F.lit(0.0)).alias("wall")] if "wall" in choices.columns else []),
    )


def stored(counted: DataFrame) -> DataFrame:
    """Adds framed and stored bytes and the ratio. counted: the counters."""
    n = F.col("raw_chunks") + F.col("zstd_chunks") + F.col("escalated_chunks")
    framed = F.col("bytes_out") + n * FRAME
    out = counted.withColumn("framed_bytes", framed).withColumn("stored_bytes", framed + n * SEAL)
    return out.withColumn("ratio", F.when(F.col("stored_bytes") > 0, F.round(F.col("bytes_in") / F.col("stored_bytes"), 6)).otherwise(1.0))


def class_rollup(choices: DataFrame) -> DataFrame:
    """Bytes in and out of each file class and its share of all savings, in the classes' order.

    choices: chunk_id, path, raw_len, stored_len; a chunk in several files belongs to the first by path.
    """
    owner = choices.groupBy("chunk_id").agg(F.min("path").alias("path"), F.min("raw_len").alias("raw_len"), F.min("stored_len").alias("stored_len"))
    by = owner.groupBy(formats.file_class(F.col("path")).alias("class")).agg(F.sum("raw_len").cast("long").alias("bytes_in"), F.sum("stored_len").cast("long").alias("bytes_out"))
    saved = by.agg((F.sum("bytes_in") - F.sum("bytes_out")).alias("all"))
    order = F.array_position(F.array(*map(F.lit, formats.CLASS_ORDER)), F.col("class"))
    share = F.when(F.col("all") > 0, F.round((F.col("bytes_in") - F.col("bytes_out")) / F.col("all"), 6)).otherwise(0.0)
    return by.join(saved, F.lit(True)).select(order.cast("int").alias("ord"), "class", "bytes_in", "bytes_out", share.alias("share_of_savings")).orderBy("ord")


def scaled(counted: DataFrame, fraction: Column) -> DataFrame:
    """Every counter (and measured seconds) times a fraction held to 0..1; counters rounded half away from nothing."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    return counted.select(*[F.round(F.col(c) * f).cast("long").alias(c) if t == "bigint" else (F.col(c) * f).alias(c) if c == "wall" else F.col(c) for c, t in counted.dtypes])


def policy_rows(rows: DataFrame, threads: int, bookkeeping: int) -> DataFrame:
    """Adds rate, initial CPU seconds and steady-state bytes.

    rows: bytes_in, stored_bytes, read_rate, cdc_rate, hash_rate, codec_rate, seal_rate (MiB a second).
    """
    rate = F.least(F.col("read_rate"), max(1, threads) * formats.harmonic_rate(*(F.col(c) for c in ("cdc_rate", "hash_rate", "codec_rate", "seal_rate"))))
    out = rows.withColumn("rate", rate)
    return out.withColumn("cpu_seconds", formats.seconds_for(F.col("bytes_in"), F.col("rate"))).withColumn("steady_bytes", (F.col("stored_bytes") + bookkeeping).cast("long"))


def incremental(rows: DataFrame, threads: int = 1) -> DataFrame:
    """Adds what a run after the first costs: a scan of everything and the work on the measured delta, else on the assumed churn, else nothing known.

    rows: total_bytes; delta_in, delta_stored, delta_wall (what the policy made of the delta, null without a baseline);
    whole_in, whole_stored, whole_wall (what it made of everything, scaled by the assumed churn); churn_pct (null unless
    assumed); read_rate, cdc_rate, hash_rate, seal_rate. Adds churn_source, delta_in, delta_stored, scan_seconds and
    cpu_seconds.
    """
    share = F.when(F.col("churn_pct").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("churn_pct") / 100)))
    measured = F.col("delta_in").isNotNull()
    of = lambda name: F.when(measured, F.col(f"delta_{name}").cast("double")).otherwise(F.round(F.col(f"whole_{name}") * share))
    wall = F.when(measured, F.col("delta_wall")).otherwise(F.col("whole_wall") * share)
    packing = formats.mib_per_second(of("in"), wall)
    rate = F.least(F.col("read_rate"), max(1, threads) * formats.harmonic_rate(F.col("cdc_rate"), F.col("hash_rate"), packing, F.col("seal_rate")))
    known = measured | F.col("churn_pct").isNotNull()
    scan = formats.seconds_for(F.col("total_bytes"), F.col("read_rate"))
    return rows.withColumns({
        "churn_source": F.when(measured, "measured").when(known, "assumed"),
        "incremental_bytes": of("in").cast("long"),
        "incremental_stored": of("stored").cast("long"),
        "scan_seconds": F.when(known, scan),
        "incremental_seconds": F.when(known, scan + formats.seconds_for(of("in"), rate)),
    })


def bandwidth(rows: DataFrame, points: tuple[int, ...] = BANDWIDTHS) -> DataFrame:
    """A row for each link: the larger of the CPU's floor and the transfer. rows: cpu_seconds, stored_bytes, ..."""
    each = rows.withColumn("mbit", F.explode(F.array(*map(F.lit, points))))
    return each.withColumn("seconds", F.greatest(F.col("cpu_seconds"), F.col("stored_bytes") / formats.MIB / (F.col("mbit") / 8)))


def recommend_policy(rows: DataFrame) -> DataFrame:
    """Of policies within 1.5 times the CPU of plain zstd, the one of fewest bytes, then the first. rows: ord, policy, cpu_seconds, steady_bytes."""
    bound = rows.filter("policy = 'zstd3'").agg(F.max("cpu_seconds").alias("most"))
    return rows.join(bound, F.col("cpu_seconds") <= 1.5 * F.col("most")).agg(F.min_by("policy", F.struct("steady_bytes", "ord")).alias("policy"), F.min("steady_bytes").alias("steady_bytes")).filter("policy IS NOT NULL")
