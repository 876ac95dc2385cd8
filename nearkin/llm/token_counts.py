"""Token counts with offset-mapped attribution.

A document is encoded once, whole. Each token covers a byte span of the text; spans are joined by
interval to the sections of the document (its lines, or any cut points), and a token that crosses
a boundary is allotted by a named rule: ``start`` (the section of its first byte) or ``most`` (the
section that holds most of its bytes, the first of equals). So section counts always add up to the
document's count.

Tokens come from a byte-level BPE vocabulary given by path; nothing is trained or copied here.

Defined results: a null or empty text has no token and one empty section; a text that ends in a
line feed has no further section after it; texts are encoded whole, however long; `most` gives a tie to
the first section; repeated rows each get their rows; a null identifier is kept; an empty table gives an
empty result. Only the identifier and text columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that the vocabulary was made with: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A section's row: its number, character span, token count.
SECTION = "n_tokens long, section long, start long, end long, section_tokens long"

_encoders: dict[str, tuple] = {}


def encoder(path: str):
    """The encoder and the byte length of each token; loaded once in each Python process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[path]


def line_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which lines begin; a line keeps its line feed."""
    starts = np.flatnonzero(data == 10) + 1
    return np.r_[0, starts[starts < len(data)]]


def allot(ends: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. ends: byte offsets at which tokens end; starts: where sections begin."""
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(starts, begins, side="right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    out = first.copy()
    for i in np.flatnonzero(last > first):
        edges = np.r_[begins[i], starts[first[i] + 1 : last[i] + 1], ends[i]]
        out[i] = first[i] + int(np.diff(edges).argmax())
    return out


def sections(text: str | None, path: str = VOCABULARY, rule: str = "start") -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a text, and of each of its lines: start and end (in code points) and tokens."""
    code, sizes = encoder(path)
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    ids = np.asarray(code.encode_ordinary(text or ""), np.int64)
    ends = np.cumsum(sizes[ids]) if len(ids) else ids
    if len(ids) and ends[-1] != len(raw):
        raise ValueError("the tokens do not cover the text")
    starts = line_starts(data)
    counts = np.bincount(allot(ends, starts, rule), minlength=len(starts)) if len(ids) else np.zeros(len(starts), np.int64)
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return len(ids), chars[starts], chars[np.r_[starts[1:], len(raw)]], counts


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """A row per section of each document: doc_id, n_tokens (of the document), section, start, end, section_tokens."""
    if rule not in ("start", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    schema = docs.select(F.col(id_col).alias("doc_id")).withColumns({x.split()[0]: F.lit(0).cast("long") for x in SECTION.split(", ")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, parts = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n, start, end, counts = sections(text, path, rule)
                owners.append(np.full(len(start), i))
                parts.append(np.stack([np.full(len(start), n), np.arange(len(start)), start, end, counts]))
            if parts:
                table = np.concatenate(parts, axis=1)
                ids = batch.column(0).take(pa.array(np.concatenate(owners)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(row) for row in table.astype(np.int64))], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
