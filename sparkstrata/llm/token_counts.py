"""Token counts of fields and sections by offset-mapped attribution.

A document is rendered once from its fields and encoded once, as a whole, so a count is what the document costs, not
what its parts would cost alone. The tokens' spans are then interval-joined to the sections' spans (both sorted, within
the row: a binary search for each end). A token inside one section belongs to it. A token that crosses a boundary goes
by an explicit rule: ``first`` to the section of its first byte, ``most`` to the one that holds most of its bytes (the
earlier of equals). ``share`` gives each section the part of the token's bytes that it holds, whatever the rule.

Fields are joined by line feeds, a separator belongs to the field before it; null fields are empty. The last field is
cut into lines, each with its line feed; the others are one section each. Empty sections have 0 tokens. Nothing is
shuffled. Repeated rows each get their rows; an empty table gives none. Further columns may have any names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary is fixed, it doesn't grow with the data; beyond this its ranks aren't broadcast.
MAX_RANK_BYTES = 64_000_000
RULES = ("first", "most")
#: White space beyond this is encoded by itself, which the pattern does too; the encoder's matcher can't hold it.
_LONG_SPACE = re.compile(r"\s{5000,}")


class Encoder:
    def __init__(self, ranks: bytes) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.sizes[i] = len(token)

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))  # the last one goes with the word behind it
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + self.encoding.encode_ordinary(text[at:] if at else text)


def sections(fields: list[str]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Rendered text and (field, index, start, end) in code points; sections touch and cover the text."""
    found, at = [], 0
    for i, f in enumerate(fields[:-1]):
        found.append((i, 0, at, at + len(f) + 1))
        at += len(f) + 1
    last = len(fields) - 1
    for j, line in enumerate(fields[-1].split("\n")):
        end = at + len(line) + 1
        found.append((last, j, at, end))
        at = end
    field, j, start, end = found[-1]
    found[-1] = (field, j, start, end - 1)  # nothing behind the last line
    return "\n".join(fields), found


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, shares) of each section. ``sizes``: bytes of each token; ``bounds``: sections' byte bounds, n + 1."""
    n = len(bounds) - 1
    counts, shares = np.zeros(n, np.int64), np.zeros(n)
    if not len(sizes):
        return counts, shares
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    whole = first == last
    counts += np.bincount(first[whole], minlength=n)
    shares += counts
    for t in np.flatnonzero(~whole):
        i, j = int(first[t]), int(last[t])
        held = np.minimum(bounds[i + 1 : j + 2], ends[t]) - np.maximum(bounds[i : j + 1], starts[t])
        counts[i + int(np.argmax(held)) if rule == "most" else i] += 1
        shares[i : j + 1] += held / sizes[t]
    return counts, shares


def counted(docs: DataFrame, *, fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "most", ranks_path: str = RANKS_PATH) -> DataFrame:
    """``doc_id, field, section, start, end, n_tokens, share``: one row for each section of each row of ``docs``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError("rank file is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = np.array(fields, object)
    columns = ["doc_id", "field", "section", "start", "end", "n_tokens", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(sent.value)
        for b in slices(batches):
            rows, where, counts, shares = [], [], [], []
            for i, parts in enumerate(zip(*(b.column(f"f{k}").to_pylist() for k in range(len(fields))), strict=True)):
                text, found = sections(list(parts))
                spans = np.array(found, np.int64)
                points = np.append(spans[:, 2], spans[-1, 3])
                raw = np.frombuffer(text.encode(), np.uint8)
                if len(raw) != len(text):  # bounds in bytes
                    points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[points]
                c, s = attribute(own.sizes[own.encode(text)] if text else np.empty(0, np.int64), points, rule)
                rows.append(np.full(len(spans), i))
                where.append(spans)
                counts.append(c)
                shares.append(s)
            spans = np.concatenate(where)
            ids = b.column("doc_id").take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names[spans[:, 0]], pa.string()), *(pa.array(spans[:, k]) for k in (1, 2, 3)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(shares))], columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", *(text_or_empty(F.col(f).cast("string")).alias(f"f{k}") for k, f in enumerate(fields)))
    return narrow.mapInArrow(run, f"doc_id {kind}, field string, section long, start long, end long, n_tokens long, share double")
