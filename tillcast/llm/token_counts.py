"""Token counts with overlap resynchronisation for huge documents.

A document up to ``chunk_chars`` is encoded whole.  A longer one is read in
overlapping chunks that are encoded with offsets.  A byte-level vocabulary cuts
a text into pre-tokens by one left-to-right pattern and merges inside them
only, so what follows a pre-token boundary does not depend on what precedes it.
A chunk's boundaries are proven from its splice point on, except for the last
``margin`` characters, which text beyond the chunk could change.  Where the next
chunk has a boundary at a proven place, both agree from there on, and the counts
are spliced at it.  If the overlap has no such place, the overlap is doubled,
and at last the chunk itself is lengthened from its splice point, up to the
rest of the text: the count is always that of the whole text.

Results for odd input: null text is empty and has no tokens; special strings in
texts are read as the library does by default; repeated rows and null ids each
give their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import row_slices, strings, table, whole_text
from tillcast.llm.registry import query

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
LIMIT = 1024
THREADS = 2  # of the library, per Python worker


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """A tokenizers or sentencepiece model, loaded once per Python worker."""
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library starts its pool
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def splice_margin(path: str) -> int | None:
    """Characters at a chunk's end that are not proven; None if the model must see whole texts."""
    import json
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    if not plain or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    return 2 * max([len(t["content"]) for t in added], default=0) + 4


class Chunk:
    """Offsets of one encoded stretch, in characters of the whole text."""

    def __init__(self, tok, text: str, start: int, end: int):
        enc = tok.encode(text[start:end], add_special_tokens=False)
        self.start, self.end = start, end
        words = np.array([-1 if w is None else w for w in enc.word_ids], np.int64)
        self.at = np.array([o[0] for o in enc.offsets], np.int64) + start
        self.first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
        self.edges = self.at[self.first]

    def between(self, low: int, high: int) -> np.ndarray:
        return self.edges[(self.edges >= low) & (self.edges <= high)]

    def index(self, edge: int) -> int:
        """Number of tokens before a pre-token edge."""
        return int(self.first[np.searchsorted(self.edges, edge)])


def count_spliced(tok, text: str, chunk: int, overlap: int, margin: int) -> int:
    """Tokens of ``text``, from chunks spliced at proven boundaries."""
    n, total, proven = len(text), 0, 0
    a = Chunk(tok, text, 0, min(n, chunk))
    while a.end < n:
        width, common = min(overlap, chunk // 2), np.empty(0, np.int64)
        while True:
            start = max(a.end - width, proven)
            b = Chunk(tok, text, start, min(n, start + max(chunk, 2 * width)))
            common = np.intersect1d(a.between(start, a.end - margin), b.edges)
            common = common[common > proven]
            if len(common) or start == proven:
                break
            width *= 2
        if not len(common):  # nothing to splice at: see more text from the proven place on
            a = Chunk(tok, text, proven, min(n, proven + 2 * (a.end - proven)))
            continue
        at = int(common[-1])
        total += a.index(at) - (a.index(proven) if proven > a.start else 0)
        proven, a = at, b
    return total + len(a.at) - (a.index(proven) if proven > a.start else 0)


def counter(path: str, chunk: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, margin = load_tokenizer(path), splice_margin(path)
        for b in row_slices(batches, "text"):
            texts = strings(b, "text")
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if margin is None or len(t) <= chunk]
            if path.endswith(".model"):
                for i, ids in zip(short, tok.encode([texts[i] for i in short], num_threads=1)):
                    counts[i] = len(ids)
            else:
                for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
                    counts[i] = len(e)
            seen = set(short)
            for i, t in enumerate(texts):
                if i not in seen:
                    counts[i] = count_spliced(tok, t, chunk, overlap, margin)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_()),
            ], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(counter(tokenizer, chunk_chars, overlap_chars, limit),
                           "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
