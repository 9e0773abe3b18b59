"""Envelopes and records that reports end in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_report(rows: DataFrame, **envelope) -> DataFrame:
    """One row with a JSON text: the envelope's fields and all rows, which are few (one for each candidate)."""
    fields = [F.lit(v).alias(k) for k, v in envelope.items()]
    packed = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rows"))
    return packed.select(F.to_json(F.struct(*fields, "rows")).alias("json"))


def overwrite_record(row: DataFrame, path: str) -> None:
    """Puts a record in the place of the last."""
    row.write.mode("overwrite").json(path)


def progress_lines(events: DataFrame, path: str, checkpoint: str):
    """A streaming query that writes events as lines of JSON."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_table(rows: DataFrame, most: int = 1000) -> str:
    """A report's rows, at most so many, as text columns."""
    names = rows.columns
    body = [["" if v is None else str(v) for v in r] for r in rows.limit(most).collect()]
    width = [max(len(x) for x in col) for col in zip(names, *body, strict=True)]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(line, width, strict=True)) for line in [names, *body])
