"""Token counts and pieces of documents by a public tokenizer given as a rank file.

The file holds lines of base64 token bytes and a rank; its path and the pre-token
pattern are parameters, and the file is read on each Python worker.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENCODINGS: dict[str, object] = {}


@dataclass(frozen=True)
class Tokenizer:
    path: str
    pattern: str

    @staticmethod
    def public(name: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
        """A tokenizer of the public vocabulary package."""
        import public_tokenizers

        return Tokenizer(str(public_tokenizers.path(name)), public_tokenizers.PATTERN)

    def encoding(self):
        if self.path not in _ENCODINGS:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _ENCODINGS[self.path] = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _ENCODINGS[self.path]


#: Texts are tokenised in parts of about so many characters. A part ends before a single blank between two words, where every token ends too, so that
#: the tokens are those of the whole text; a stretch without such a blank is one part.
PART_CHARS = 100_000
_BETWEEN = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART_CHARS:
        blank = _BETWEEN.search(text, at + PART_CHARS)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


def encode(text: str, tokenizer: Tokenizer) -> list[int]:
    e = tokenizer.encoding()
    clean = text.encode("utf-8", "replace").decode("utf-8")
    return [t for part in _parts(clean) for t in e.encode_ordinary(part)]


def pieces_of(text: str, tokenizer: Tokenizer, capacity: int) -> list[tuple[int, int, int]]:
    """(begin, end, tokens) of consecutive pieces of at most capacity tokens; one piece if the text fits.

    A piece ends between two characters, so where a character spans tokens it ends before it."""
    tokens = encode(text, tokenizer)
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    e = tokenizer.encoding()
    ends, chars, whole = [], 0, []
    pending = b""
    for t in tokens:
        pending += e.decode_single_token_bytes(t)
        try:
            chars += len(pending.decode("utf-8"))
            pending = b""
            whole.append(True)
        except UnicodeDecodeError:
            whole.append(False)
        ends.append(chars)
    out, begin, at = [], 0, 0
    while at < len(tokens):
        stop = min(at + capacity, len(tokens))
        while stop > at + 1 and not whole[stop - 1]:
            stop -= 1
        end = len(text) if stop == len(tokens) else ends[stop - 1]
        out.append((begin, end, stop - at))
        begin, at = end, stop
    return out


def token_pieces(df: DataFrame, key: str, text: str, tokenizer: Tokenizer, capacity: int) -> DataFrame:
    """(id, piece_no, begin_char, end_char, n_tokens) of every record whose text isn't blank."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(r"[^\s\u00a0]"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, (a, b, n) in enumerate(pieces_of(t, tokenizer, capacity)):
                    of.append(i)
                    found.append((k, a, b, n))
            cols = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(list(c), pa.int32()) for c in cols]], names=["id", "piece_no", "begin_char", "end_char", "n_tokens"])

    return rows.mapInArrow(run, f"id {kind}, piece_no int, begin_char int, end_char int, n_tokens int")


def token_counts(df: DataFrame, text: str, tokenizer: Tokenizer) -> DataFrame:
    """df without its text and with n_tokens BIGINT."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("text_"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(t, tokenizer)) if t else 0 for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(rest))], pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    return rows.mapInArrow(run, schema)
