"""Scalar functions as columns: ids, sizes, durations, times, rates and labels."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB, TIB = 1 << 10, 1 << 20, 1 << 30, 1 << 40
#: File classes by extension. Fixed values.
CLASSES = {
    "db/sqlite": ("db", "sqlite", "sqlite3"),
    "office-zip": ("docx", "xlsx", "pptx", "odt", "ods", "zip", "jar"),
    "pdf": ("pdf",),
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff"),
    "text/code": ("txt", "md", "rs", "py", "js", "ts", "c", "h", "cpp", "hpp", "json", "toml", "yaml", "yml", "csv", "log", "xml", "html", "css", "go", "java", "sql"),
}
CLASS_ORDER = [*CLASSES, "other"]


def content_id(data: Column) -> Column:
    """The id of a chunk's content as lower-case hex."""
    return F.sha2(data, 256)


def keyed_id(data: Column, key: bytes) -> Column:
    """The id of content under a key: HMAC-SHA256 as lower-case hex."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    within = F.unhex(F.sha2(F.concat(F.lit(inner), data.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), within), 256)


def id_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def parse_id(text: Column) -> Column:
    """The 32 raw bytes of an id in hex of either case; null if it isn't one."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def parse_base64(text: Column) -> Column:
    """The bytes of standard base64, spaces and line ends left out and the padding optional; null if it isn't that."""
    clean = F.regexp_replace(text, r"\s", "")
    body = F.regexp_extract(clean, "^([A-Za-z0-9+/]*)={0,2}$", 1)
    padded = F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, F.lit("="))
    return F.when(clean.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 != 1), F.unbase64(padded))


def pem_text(raw: Column, label: str) -> Column:
    """Bytes between a label's lines, as base64 in lines of 64."""
    body = F.regexp_replace(F.regexp_replace(F.base64(raw), r"\s", ""), "(.{64})(?=.)", "$1\n")
    return F.concat(F.lit(f"-----BEGIN {label}-----\n"), body, F.lit(f"\n-----END {label}-----\n"))


def parse_pem(text: Column) -> Column:
    """The bytes between the lines that begin with dashes; null if they aren't base64."""
    return parse_base64(F.regexp_replace(text, "(?m)^-----.*$", ""))


def id_ok(raw: Column, size: int = 32) -> Column:
    return F.coalesce(F.octet_length(raw) == size, F.lit(False))


def parse_size(text: Column) -> Column:
    """Bytes of `256K`, `1m` or a plain number; null if it isn't a size or is beyond 64 bits. No space before the unit."""
    number, unit = (F.regexp_extract(text, r"^\s*\+?([0-9]+)([kKmM]?)\s*$", k) for k in (1, 2))
    times = F.when(F.upper(unit) == "K", KIB).when(F.upper(unit) == "M", MIB).otherwise(1)
    return F.when(number != "", F.try_multiply(number.try_cast("long"), times.cast("long")))


def size_label(size: Column) -> Column:
    """The largest exact unit of M and K, else bytes."""
    return (
        F.when((size > 0) & (size % MIB == 0), F.concat((size / MIB).cast("long").cast("string"), F.lit("M")))
        .when((size > 0) & (size % KIB == 0), F.concat((size / KIB).cast("long").cast("string"), F.lit("K")))
        .otherwise(F.concat(size.cast("string"), F.lit("B")))
    )


def human_bytes(size: Column) -> Column:
    """Binary units to TiB with two decimals; whole bytes below one KiB."""
    out = F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
    for unit, over, name in ((KIB, MIB, "KiB"), (MIB, GIB, "MiB"), (GIB, TIB, "GiB")):
        out = out.when(size < over, F.format_string(f"%.2f {name}", size / unit))
    return out.otherwise(F.format_string("%.2f TiB", size / TIB))


def parse_duration(text: Column) -> Column:
    """Seconds of `3h`, `10M`, `45s` or a plain number; null if it isn't a duration. No space before the unit."""
    number, unit = (F.regexp_extract(text, r"^\s*\+?([0-9]+)([hHmMsS]?)\s*$", k) for k in (1, 2))
    times = F.when(F.lower(unit) == "h", 3600).when(F.lower(unit) == "m", 60).otherwise(1)
    return F.when(number != "", F.try_multiply(number.try_cast("long"), times.cast("long")))


def utc_text(ms: Column) -> Column:
    """Milliseconds since the epoch as text, seconds truncated; the session's zone is taken to be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss 'UTC'")


def civil_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def id_time_ms(snapshot_id: Column) -> Column:
    """Milliseconds in a snapshot id's first 48 bits."""
    return F.conv(F.hex(F.substring(snapshot_id, 1, 6)), 16, 10).cast("long")


def file_class(path: Column) -> Column:
    """The class of a file by the extension of the last path component, in any case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), "")
    for name, exts in CLASSES.items():
        out = out.when(ext.isin(*exts), name)
    return out.otherwise("other")


def frame(codec: Column, payload: Column) -> Column:
    """One codec byte before the payload."""
    return F.concat(F.unhex(F.lpad(F.hex(codec), 2, "0")), payload)


def frame_codec(framed: Column) -> Column:
    """0 for raw, 1 for compressed; null for other bytes or an empty frame."""
    code = F.conv(F.hex(F.substring(framed, 1, 1)), 16, 10).cast("int")
    return F.when(code.isin(0, 1), code)


def frame_payload(framed: Column) -> Column:
    return F.substring(framed, F.lit(2), F.octet_length(framed))


def seal(plain: Column, key: Column, nonce: Column, bound: Column) -> Column:
    """Authenticated encryption bound to an id: nonce, text and tag in one value."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, bound)


def unseal(sealed: Column, key: Column, bound: Column) -> Column:
    """The sealed value, or null if it was altered or is bound to another id."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), bound)


def mib_per_second(size: Column, seconds: Column) -> Column:
    """Infinite for no bytes or no time at all."""
    return F.when((seconds > 0) & (size > 0), size / MIB / seconds).otherwise(F.lit(float("inf")))


def seconds_for(size: Column, rate: Column) -> Column:
    """Seconds that so many bytes take at a rate in MiB a second; none for no bytes or at a rate that is no number above 0."""
    return F.when((size != 0) & (rate > 0) & (rate < float("inf")), size / MIB / rate).otherwise(0.0)


def harmonic_rate(*rates: Column) -> Column:
    """The rate of stages one after another; stages of infinite or no rate don't count."""
    total = sum((F.when((r > 0) & (r < float("inf")), 1.0 / r).otherwise(0.0) for r in rates), F.lit(0.0))
    return F.when(total > 0, 1.0 / total).otherwise(F.lit(float("inf")))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the rate so far; null before any progress or time and after the end."""
    return F.when((done > 0) & (done < total) & (elapsed > 0), (total - done) / (done / elapsed))


def progress_rate(done: Column, elapsed: Column) -> Column:
    """MiB a second so far; 0 before any time has passed."""
    return F.when(elapsed > 0, done / elapsed / MIB).otherwise(0.0)


def eta_suffix(eta: Column) -> Column:
    """What a progress line ends with; empty where nothing is known."""
    seconds = F.greatest(F.round(eta), F.lit(0.0)).cast("long").cast("string")
    return F.when(eta.isNull(), "").otherwise(F.concat(F.lit(", ETA ~"), seconds, F.lit("s")))


def codec_label(codec: Column) -> Column:
    return F.when(codec == 0, "raw").when(codec == 1, "zstd")


def prune_mode(code: Column) -> Column:
    return F.when(code == 0, "manual").when(code == 1, "auto")


def status_code(error: Column) -> Column:
    """The status that a store error is reported with."""
    return (
        F.when(error.isin("missing_chunk", "missing_snapshot"), "NOT_FOUND")
        .when(error == "duplicate_snapshot", "ALREADY_EXISTS")
        .when(error.isin("unknown_ref", "still_referenced"), "FAILED_PRECONDITION")
        .when(error.isin("hash_mismatch", "length_mismatch"), "DATA_LOSS")
        .when(error == "bad_id", "INVALID_ARGUMENT")
        .otherwise("INTERNAL")
    )


def usable_name(name: Column) -> Column:
    """A client name of 1 to 64 bytes without control characters."""
    return F.coalesce(F.octet_length(name).between(1, 64) & ~name.rlike(r"\p{Cc}"), F.lit(False))


def safe_path(path: Column) -> Column:
    """Whether a path is relative, plain and stays below its root."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))
    return F.coalesce((path != "") & ~path.rlike(r"[\x00\\]") & ~path.rlike("^[A-Za-z]:") & ~bad, F.lit(False))


def next_delay(interval: Column, jitter: float, draw: Column) -> Column:
    """Seconds to the next run: the interval, longer or shorter by up to the jitter's share. draw: 0 to 1."""
    return F.greatest(interval * (1 + F.lit(jitter) * (2 * draw - 1)), F.lit(0.0))


def caveat(has_baseline: Column) -> Column:
    return F.when(has_baseline, "overlap and increments are measured against the baseline").otherwise("no baseline: increments are assumed, not measured")
