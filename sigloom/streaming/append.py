"""Signatures of documents as they arrive: an extension, for collections that grow.

With weights by counts, or frozen statistics, a signature depends on its own document only, so the stream has no state and no
watermark: each batch of new documents is signed and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sigloom.functions.tokenizer import Splitting
from sigloom.operators import signatures
from sigloom.operators.vectors import Projection


def append(
    docs: DataFrame, path: str, checkpoint: str, projection: Projection = Projection(), stats: DataFrame | None = None, splitting: Splitting = Splitting(),
    available_now: bool = False, **options: object,
) -> StreamingQuery:
    """A running query that appends the signatures of streamed documents (doc_id, text) to the Parquet table at ``path``.

    Rows have no doc_num: numbers are given to a whole table by signatures.numbered(). available_now ends the query with what is there.
    """

    def batch(rows: DataFrame, _: int) -> None:
        signatures.build(rows, projection, stats, splitting=splitting, **options).write.mode("append").parquet(path)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
