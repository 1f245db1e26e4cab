"""Token counts of texts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    """The tokenizer of a file of ranks; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, row_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(row_id, n_tokens) of every row; a NULL text has 0 tokens, as an empty one.

    Strings that look like special tokens are ordinary text; lone surrogates can't occur in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(count(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[row_id, "n_tokens"])

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, text).mapInArrow(run, f"{row_id} {kind}, n_tokens bigint")
