"""Personal data in texts, by kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pii_findings(df: DataFrame, ident: str, text: str, least: float = 0.6) -> DataFrame:
    """A row for each find in the whole texts: ident, kind, start, end, score and value.

    Finds below ``least`` are left out, after overlaps are settled. Null and empty texts give no rows.
    """
    from ..functions.recognisers import findings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, starts, ends, scores, values = [], [], [], [], [], []
            for k, t in enumerate(b["text"].to_pylist()):
                for kind, start, end, score in findings(t or "", least):
                    at.append(k)
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
                    scores.append(score)
                    values.append(t[start:end])
            yield pa.RecordBatch.from_arrays([b["ident"].take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(scores, pa.float64()), pa.array(values, pa.string())], ["ident", "kind", "start", "end", "score", "value"])

    kind = df.schema[ident].dataType.simpleString()
    found = df.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, f"ident {kind}, kind string, start int, `end` int, score double, value string")
    return found.withColumnRenamed("ident", ident)
