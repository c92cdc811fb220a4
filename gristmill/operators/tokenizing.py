"""Corpus tokenize job and its inverse."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T


class TextCodec(Protocol):
    """What a plug-in tokenizer offers; one is built per Python worker."""

    bos_id: int | None
    eos_id: int

    def encode(self, string: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


CodecFactory = Callable[[], TextCodec]

# Rows whose results a worker holds at a time; Spark hands over many more.
ROWS = 256


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def tokenize(
    docs: DataFrame,
    codec: CodecFactory | None = None,
    text: str = "text",
    bos: bool = False,
    eos: bool = True,
    max_length: int = -1,
) -> DataFrame:
    """Replace ``text`` by ``tokens ARRAY<INT>`` and ``n_tokens BIGINT``.

    Without a codec both columns are built-in expressions, and a query that only
    uses ``n_tokens`` never hashes a word.  With one, ``n_tokens`` is the size of
    the encoded array.
    """
    if codec is None:
        ids = T.token_ids(text, bos, eos, max_length)
        count = T.token_count(text, bos, eos, max_length)
        return docs.withColumn("n_tokens", count).withColumn("tokens", ids).drop(text)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = codec()
        if bos and tool.bos_id is None:
            raise ValueError("this tokenizer defines no BOS token")
        head = [tool.bos_id] if bos else []
        tail = [tool.eos_id] if eos else []

        def ids(string: str | None) -> np.ndarray:
            found = head + list(tool.encode(string or "")) + tail
            return np.array(found[:max_length] if max_length > 0 else found, np.int32)

        for part in _parts(batches):
            found = [ids(string.as_py()) for string in part]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))

    # Marked so that a filter on the result does not encode everything twice.
    coded = docs.withColumn("tokens", encode.asNondeterministic()(F.col(text))).drop(text)
    return coded.withColumn("n_tokens", F.size("tokens").cast("bigint"))


def detokenize(df: DataFrame, codec: CodecFactory, tokens: str = "tokens", out: str = "text") -> DataFrame:
    """Ids back to text with the same plug-in."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = codec()
        for part in _parts(batches):
            yield pa.array([tool.decode(ids.as_py()) for ids in part], pa.string())

    return df.withColumn(out, decode.asNondeterministic()(F.col(tokens)))


class _SentencePiece:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.bos_id = self._model.bos_id()
        self.eos_id = self._model.eos_id()

    def encode(self, string: str) -> list[int]:
        return self._model.encode(string)

    def decode(self, ids: list[int]) -> str:
        return self._model.decode(ids)


class _JsonTokenizer:
    def __init__(self, path: str, bos_token: str | None, eos_token: str) -> None:
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self.bos_id = None if bos_token is None else self._id(bos_token)
        self.eos_id = self._id(eos_token)

    def _id(self, token: str) -> int:
        found = self._model.token_to_id(token)
        if found is None:
            raise ValueError(f"{token!r} is not in the vocabulary")
        return found

    def encode(self, string: str) -> list[int]:
        return self._model.encode(string).ids

    def decode(self, ids: list[int]) -> str:
        return self._model.decode(ids)


def codec_from_dir(folder: str) -> CodecFactory:
    """Factory for the tokenizer files in ``folder``, a path every worker can read.

    A SentencePiece ``tokenizer.model`` wins over a ``tokenizer.json``.
    """

    def token_text(entry: object) -> str | None:
        return entry["content"] if isinstance(entry, dict) else entry

    def build() -> TextCodec:
        import json

        root = Path(folder)
        if (root / "tokenizer.model").is_file():
            return _SentencePiece(str(root / "tokenizer.model"))
        if (root / "tokenizer.json").is_file():
            conf = json.loads((root / "tokenizer_config.json").read_text())
            return _JsonTokenizer(
                str(root / "tokenizer.json"),
                token_text(conf.get("bos_token")),
                token_text(conf["eos_token"]),
            )
        raise FileNotFoundError(f"no tokenizer file in {folder}")

    return build
