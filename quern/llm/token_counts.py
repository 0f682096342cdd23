"""Token counts of whole texts by a tokenizer compiled to a finite-state transducer (see automaton.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.automaton import transducer
from quern.llm.common import arrow_map, batch_of, texts_of


def token_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 512,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_bytes of its UTF-8 text, n_tokens and over_limit (n_tokens > limit).

    Null texts count as empty, with 0 bytes and tokens. Repeated rows each give a row, a null id stays null, an empty
    table gives none, and other columns are not read. No shuffle: every partition streams through the transducer.
    """
    out = pa.schema([(id_column, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            texts = texts_of(batch, "text")
            n = machine.counts(texts)
            sizes = [len(t.encode()) for t in texts]
            yield batch_of(out, [batch.column("id"), sizes, n, [x > limit for x in n]])

    picked = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    return arrow_map(picked, count, f"`{id_column}` long, n_bytes long, n_tokens long, over_limit boolean")
