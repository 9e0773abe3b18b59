import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tessera.functions import formats as f


def one(spark, kind, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_sizes_and_durations(spark):
    assert one(spark, "string", ["256K", "1m", "4096", "", "12Q", None], f.parse_size) == [262144, 1048576, 4096, None, None, None]
    assert one(spark, "string", ["1 K", "+5", "\t8k\n", "9223372036854775807K", "1K2"], f.parse_size) == [None, 5, 8192, None, None]
    assert one(spark, "string", ["3H", "7 m", "9M", "5S", "1d"], f.parse_duration) == [10800, None, 540, 5, None]
    assert one(spark, "string", ["3h", "10m", "45s", "90", "x"], f.parse_duration) == [10800, 600, 45, 90, None]
    assert one(spark, "long", [0, 512, 1024, 3 << 20, 1536 << 10], f.size_label) == ["0B", "512B", "1K", "3M", "1536K"]
    assert one(spark, "long", [5, 1536, 5 << 40], f.human_bytes) == ["5 B", "1.50 KiB", "5.00 TiB"]


def test_times(spark):
    ms = [0, 1_700_000_000_000, 1_709_208_000_000, 999]
    assert one(spark, "long", ms, f.utc_text) == ["1970-01-01 00:00:00 UTC", "2023-11-14 22:13:20 UTC", "2024-02-29 12:00:00 UTC", "1970-01-01 00:00:00 UTC"]
    assert [str(d) for d in one(spark, "long", [0, 19782], f.civil_date)] == ["1970-01-01", "2024-02-29"]


@pytest.mark.parametrize("key", [b"", b"k" * 32, b"long" * 40])
def test_keyed_ids(spark, key):
    texts = ["", "a", "é" * 500]
    assert one(spark, "string", texts, lambda c: f.keyed_id(c, key)) == [hmac.new(key, t.encode(), "sha256").hexdigest() for t in texts]
    assert one(spark, "string", texts, f.content_id) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_ids(spark):
    good = "ab" * 32
    assert one(spark, "string", [good.upper(), good[:-1], "g" + good[1:], None], lambda c: f.id_hex(f.parse_id(c))) == [good, None, None, None]
    raw = [(1_700_000_000_000).to_bytes(6, "big") + bytes(10)]
    assert one(spark, "binary", raw, f.id_time_ms) == [1_700_000_000_000]
    assert one(spark, "binary", [bytes(32), bytes(31), None], f.id_ok) == [True, False, False]


def test_text_forms_of_bytes(spark):
    raw = [b"", b"a", b"ab", b"abc", bytes(range(256))]
    back = one(spark, "binary", raw, lambda c: f.parse_pem(f.pem_text(c, "X")))
    assert [bytes(x) for x in back] == raw
    (text,) = one(spark, "binary", [bytes(100)], lambda c: f.pem_text(c, "X"))
    assert max(map(len, text.split("\n"))) == 64 and text.startswith("-----BEGIN X-----\n")
    assert [x if x is None else bytes(x) for x in one(spark, "string", ["YQ", " Y Q=\n=", "Y", "YQ===", "Y*Q=", "YWI=", None], f.parse_base64)] == [b"a", b"a", None, None, None, b"ab", None]


def test_frames_and_seals(spark):
    assert one(spark, "binary", [b"\x00a", b"\x01b", b"\x02c", b""], f.frame_codec) == [0, 1, None, None]
    assert [bytes(x) for x in one(spark, "binary", [b"\x00abc", b"\x01"], f.frame_payload)] == [b"abc", b""]
    key, nonce = F.lit(b"k" * 32), F.lit(b"n" * 12)
    sealed = lambda c: f.seal(c, key, nonce, F.lit(b"id"))
    assert [bytes(x) for x in one(spark, "binary", [b"abc", b""], lambda c: f.unseal(sealed(c), key, F.lit(b"id")))] == [b"abc", b""]
    assert one(spark, "binary", [b"abc"], lambda c: f.unseal(sealed(c), key, F.lit(b"no"))) == [None]


def test_rates(spark):
    inf = float("inf")
    assert one(spark, "double", [2.0, inf, 0.0], lambda c: f.harmonic_rate(c, F.lit(2.0))) == [1.0, 2.0, 2.0]
    assert one(spark, "double", [inf, 0.0], lambda c: f.harmonic_rate(c)) == [inf, inf]
    assert one(spark, "double", [inf, 2.0], lambda c: f.seconds_for(F.lit(4 << 20), c)) == [0.0, 2.0]
    assert one(spark, "double", [-1.0, 0.0], lambda c: f.seconds_for(F.lit(4 << 20), c)) == [0.0, 0.0]
    assert one(spark, "double", [0.0, 2.0], lambda c: f.seconds_for(F.lit(0), c)) == [0.0, 0.0]
    assert one(spark, "long", [0, 4 << 20], lambda c: f.mib_per_second(c, F.lit(2.0))) == [inf, 2.0]
    assert one(spark, "double", [0.0, 2.0], lambda c: f.progress_rate(F.lit(4 << 20), c)) == [0.0, 2.0]
    assert one(spark, "double", [None, 2.6], f.eta_suffix) == ["", ", ETA ~3s"]
    assert one(spark, "double", [0.0], lambda c: f.eta_seconds(F.lit(1), F.lit(10), c)) == [None]
    assert one(spark, "long", [0, 5, 10], lambda c: f.eta_seconds(c, F.lit(10), F.lit(3.0))) == [None, 3.0, None]
    assert one(spark, "double", [0.0, 0.5, 1.0], lambda c: f.next_delay(F.lit(10.0), 0.1, c)) == [9.0, 10.0, 11.0]


def test_paths_and_names(spark):
    paths = ["a/b", "", "/a", "../a", "a/../b", "a//b", "c:/x", "a\\b", "a\0b"]
    assert one(spark, "string", paths, f.safe_path) == [True] + [False] * 8
    assert one(spark, "string", ["a.DB", "r.docx", "x.d/none", "e.", "p.PDF", ".bashrc"], f.file_class) == ["db/sqlite", "office-zip", "other", "other", "pdf", "other"]
    assert one(spark, "string", ["ok", "", "a\tb", "x" * 65, None], f.usable_name) == [True, False, False, False, False]
