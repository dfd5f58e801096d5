"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and the one used.
TOKENIZERS = os.environ.get("DOCWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(path: str | None = None):  # noqa: ANN201
    """The tokenizer of a vocabulary file of ranks; special tokens have none, so their strings are ordinary text."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_token_counts(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None, prompt: bool = False) -> DataFrame:
    """``keep`` columns and n_tokens of each whole text; null text has 0. With ``prompt`` also n_prompt, the tokens of the
    first line that is not blank, as that of an instruction or a heading that the rest answers."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def first_line(t: str) -> str:
        body = t.lstrip()
        return t[: len(t) - len(body)] + body.partition("\n")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            sizes = [pa.array(n, pa.int32())]
            if prompt:
                sizes.append(pa.array([min(k, len(enc.encode_ordinary(first_line(t)))) if t else 0 for t, k in zip(texts, n)], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *sizes], names=[*keep, "n_tokens", *(["n_prompt"] if prompt else [])])

    return documents.select(*keep, F.col("text")).mapInArrow(run, fields + ", n_tokens int" + (", n_prompt int" if prompt else ""))
