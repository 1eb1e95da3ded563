"""Token counts of whole documents; huge ones are encoded in overlapping chunks.

A boundary between two characters is *stable* when no match of the tokenizer's split
pattern can hold both, whatever stands around them: white space after anything else,
or the end of a run of letters or digits. Two neighbouring chunks are spliced at a
stable boundary of their overlap at which both encodings start a token. From there on
both see the same text with the same split, so everything before it is taken from the
left chunk and everything after it from the right one. The overlap doubles while no
such boundary is found, in the end up to the whole text.
"""

from __future__ import annotations

import base64
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelforge.llm.frames import Once, by_slices, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
CHUNK_CHARS = 16384
OVERLAP_CHARS = 256
TOKEN_LIMIT = 1024

#: The bar is excluded after letters because the special string has bars beside letters.
STABLE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}|])|(?<=\p{N})(?=\P{N})")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@Once
def encoder(path: str | None = None):
    """The tokenizer and the number of bytes of each of its tokens."""
    import public_tokenizers
    import tiktoken

    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    tool = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    widths = np.zeros(max([*ranks.values(), *SPECIAL.values()]) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    for token, rank in SPECIAL.items():
        widths[rank] = len(token)
    return tool, widths


def encode(tool, text: str) -> list[int]:
    return tool.encode(text, allowed_special="all")


def token_starts(tool, widths: np.ndarray, text: str) -> np.ndarray:
    """Byte offsets at which the tokens of `text` start, and its length as the last one."""
    ids = np.asarray(encode(tool, text), np.int64)
    return np.concatenate(([0], np.cumsum(widths[ids])))


def common_boundary(left: np.ndarray, right: np.ndarray, overlap: str, at: int) -> int | None:
    """The last byte of the left chunk at which both chunks may be spliced.

    `overlap` starts at byte `at` of the left chunk and at byte 0 of the right one.
    """
    for char in reversed([m.start() for m in STABLE.finditer(overlap) if 0 < m.start() < len(overlap)]):
        byte = len(overlap[:char].encode())
        i, j = np.searchsorted(left, at + byte), np.searchsorted(right, byte)
        if left[i] == at + byte and right[j] == byte:
            return at + byte
    return None


def count_tokens(tool, widths: np.ndarray, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Number of tokens of one text, holding the offsets of two chunks at a time.

    `begin` and `stop` bound the left chunk; its tokens before byte `taken` are counted.
    """
    if len(text) <= chunk:
        return len(encode(tool, text))
    counted, begin, stop, taken, wide = 0, 0, chunk, 0, overlap
    left = token_starts(tool, widths, text[:stop])
    while stop < len(text):
        if stop - wide <= begin:
            # no splice anywhere in the left chunk: it is encoded again, twice as long
            stop = min(len(text), 2 * stop - begin)
            left, wide = token_starts(tool, widths, text[begin:stop]), overlap
            continue
        start, end = stop - wide, min(len(text), stop + chunk)
        right = token_starts(tool, widths, text[start:end])
        at = len(text[begin:start].encode())
        splice = common_boundary(left, right, text[start:stop], at)
        if splice is None or splice < taken:
            wide *= 2
            continue
        counted += int(np.searchsorted(left, splice) - np.searchsorted(left, taken))
        left, taken, begin, stop, wide = right, splice - at, start, end, overlap
    return counted + len(left) - 1 - int(np.searchsorted(left, taken))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null texts count as empty: 0 bytes and 0 tokens. Rows are counted one by one, so
    repeated rows and null keys stay as they are; an empty table gives an empty table.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool, widths = encoder(vocabulary)
        values = [t or "" for t in batch.column("text").to_pylist()]
        counts = [count_tokens(tool, widths, t) for t in values]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t.encode()) for t in values], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return texts(df, key, text).mapInArrow(by_slices(work), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
