"""Contents behind URLs, fetched by the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_FETCHED = "url string, uid string, content binary, content_type string, error string"


def fetch(urls: DataFrame, timeout: float = 10.0, most_bytes: int = 64 << 20, partitions: int | None = None) -> DataFrame:
    """``(url, uid, content, content_type, error)`` for each row of ``urls (url)``; the uid is the content's SHA-1.

    What can't be fetched within ``timeout`` seconds, or has more than ``most_bytes`` bytes, has a null content and says why. Each task fetches its rows one after the
    other; ``partitions`` bounds how many do so at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        from urllib.request import urlopen

        for batch in batches:
            for url in batch.column(0).to_pylist():
                row = {"url": url, "uid": None, "content": None, "content_type": None, "error": None}
                try:
                    with urlopen(url, timeout=timeout) as answer:  # noqa: S310
                        content = answer.read(most_bytes + 1)
                        if len(content) > most_bytes:
                            raise ValueError(f"more than {most_bytes} bytes")
                        row |= {"uid": hashlib.sha1(content).hexdigest(), "content": content, "content_type": answer.headers.get_content_type()}
                except (OSError, ValueError, AttributeError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("url", pa.string()), ("uid", pa.string()), ("content", pa.binary()), ("content_type", pa.string()), ("error", pa.string())]))

    rows = urls.select(F.col("url").cast("string").alias("url"))
    return (rows.repartition(partitions) if partitions else rows).mapInArrow(run, _FETCHED)
