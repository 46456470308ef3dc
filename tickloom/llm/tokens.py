"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Default vocabulary; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokens, prompt_tokens) of documents (doc_id, text, lang, source).

    `tokens` counts those of the whole text, `prompt_tokens` those of its first line where more
    lines follow: in instruction data the loss is on what comes after. NULL texts have 0.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in it:
            whole, prompt = [], []
            for text in b["text"].to_pylist():
                text = text or ""
                n = len(encode(text))
                first, _, rest = text.partition("\n")
                whole.append(n)
                prompt.append(min(n, len(encode(first))) if rest else 0)
            columns = [b["doc_id"], b["source"], b["lang"], pa.array(whole, pa.int64()), pa.array(prompt, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "lang", "tokens", "prompt_tokens"])

    schema = "doc_id long, source string, lang string, tokens long, prompt_tokens long"
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text", "lang", "source").mapInArrow(run, schema)
