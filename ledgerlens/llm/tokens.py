"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import ast
import base64
import hashlib
import os

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FOLDER, FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Vocabularies are broadcast; a larger file is refused.
MAX_FILE_BYTES = 16 << 20

_encodings: dict[str, object] = {}


def read_vocabulary(folder: str = FOLDER, file: str = FILE) -> tuple[bytes, str]:
    """The file's bytes and the pattern by which its words are split."""
    path = os.path.join(folder, file)
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    # The pattern is read as a constant; nothing of the folder is run.
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        found = [n.value for n in ast.parse(f.read()).body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in n.targets)]
    if not found:
        raise ValueError(f"{folder} names no PATTERN")
    with open(path, "rb") as f:
        return f.read(), ast.literal_eval(found[0])


def encoding(raw: bytes, pattern: str):
    """The encoding, made once in each process."""
    key = hashlib.sha256(raw).hexdigest() + pattern
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_count(spark: SparkSession, text: str | Column, folder: str = FOLDER, file: str = FILE) -> Column:
    """Tokens of each whole text; 0 where it is null or empty. Strings of special tokens are ordinary text."""
    shared = spark.sparkContext.broadcast(read_vocabulary(folder, file))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(*shared.value)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count(F.col(text) if isinstance(text, str) else text)
