"""Token counts of whole texts under a byte-level BPE vocabulary.

Method: overlap resynchronisation.  A text longer than `chunk` characters is encoded
in overlapping chunks whose token ends are known as byte offsets.  Two neighbouring
chunks are spliced at a position that is a token end in both and that is proven
stable: a letter or digit followed by a space or newline.  The pre-tokenizer's pattern
never matches across such a position and never looks behind, so whatever follows it is
encoded as in the whole text.  Where the overlap holds no such position it is widened to
the next one in the text, or to its end.

Ids are those of the `tokenizers` file, which cuts a text at its special string and encodes
what stands between by itself; so is it done here.  `tiktoken` encodes from the same ranks
and gives the same ids for every code point (tests/llm/test_text_operators.py compares
them) in a fifth of the time.  Its pattern engine fails on runs of white space of about a
million characters, so chunks that had to be widened over `LONG` characters are encoded by
`tokenizers` itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
CHUNK = 1 << 16
OVERLAP = 1 << 10
LONG = 1 << 18
_STABLE = re.compile(r"(?<=[^\W_])(?=[ \n])")


class ByteBpe:
    """Encoder of one byte-level vocabulary, given as .json and .tiktoken files."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.chunk, self.overlap = chunk, overlap
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.json_path = json_path
        self._whole = None
        self.special, self.special_ids = "<|endoftext|>", np.array([max(ranks.values()) + 1], np.uint32)
        self.widened = 0

    @property
    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json_path)
        return self._whole

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """Ids of the whole text as unsigned 32-bit integers, a chunk at a time; none for null or empty."""
        for k, part in enumerate((text or "").split(self.special)):
            if k:
                yield self.special_ids
            if len(part) <= self.chunk:
                yield self.fast.encode_to_numpy(part)
            else:
                yield from self.spliced(part)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the whole text in one array."""
        return np.concatenate(list(self.parts(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text)))

    def encoded(self, text: str) -> np.ndarray:
        """Ids of a text without the special string, whatever its length."""
        if len(text) <= LONG:
            return self.fast.encode_to_numpy(text)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def spliced(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a long text, chunk by chunk; no more than two chunks are held."""
        begin, n = 0, len(text)
        while n - begin > self.chunk + self.overlap:
            cut = begin + self.chunk
            end = cut + self.overlap
            left = self.encoded(text[begin:end])
            at = self._common(text, begin, cut, end, left)
            if at is None:  # widened: what ends at a proven position needs no second chunk to agree
                self.widened += 1
                stable = _STABLE.search(text, end - 1)
                if not stable:
                    break
                at = stable.start(), None
                left = self.encoded(text[begin : at[0]])
            begin, kept = at
            yield left[:kept]
        yield self.encoded(text[begin:])

    def _common(self, text: str, begin: int, cut: int, end: int, left: np.ndarray) -> tuple[int, int] | None:
        """The first proven position in the overlap that ends a token in both chunks, with the left tokens before it."""
        right_text = text[cut : end + self.overlap]
        right_ends = np.cumsum(self.sizes[self.encoded(right_text)])
        left_ends = np.cumsum(self.sizes[left])
        base = len(text[begin:cut].encode())
        for m in _STABLE.finditer(text, cut + 1, end - 1):
            into = len(text[cut : m.start()].encode())
            k = int(np.searchsorted(left_ends, base + into))
            j = int(np.searchsorted(right_ends, into))
            if left_ends[k] == base + into and right_ends[j] == into:
                return m.start(), k + 1
        return None


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> ByteBpe:
    """One encoder for each Python worker."""
    import public_tokenizers

    path = public_tokenizers.path
    return ByteBpe(path(f"{vocabulary}.json"), path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN, chunk, overlap)


def token_counts(docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of `docs`.

    One row out for each row in, repeated rows and null ids included.  Null and empty
    texts have no bytes and no tokens.  Other columns of `docs` are ignored.  No shuffle.
    """

    def count(texts: pd.Series) -> pd.Series:
        bpe = encoder(vocabulary, chunk, overlap)
        return pd.Series([bpe.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.pandas_udf(count, "long")("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
