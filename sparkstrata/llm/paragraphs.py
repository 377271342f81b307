"""Substring dedup by paragraph MinHash banding.

Units. A paragraph is a line of at least ``MIN_WORDS`` words, or a run of neighbouring shorter lines without a blank
line between (wrapped text) of together that many words; shorter ones aren't compared as near-duplicates. Because a
repeated passage may also start and end inside lines, the whole document is cut a second time into pieces that begin
where a word's hash is the least of its ``REACH`` neighbours on either side; such cuts depend on nearby words only, so
equal passages have equal inner pieces.

Paragraphs: MinHash over runs of ``SHINGLE`` words, ``BANDS`` bands of ``ROWS`` rows; two paragraphs of similarity 0.8
share no band with probability (1 - 0.8^ROWS)^BANDS, 4 in 100,000. Equal paragraphs are one node. All members of a
bucket meet two of them (the one that meets most others, and one drawn anew for each bucket); then every two members
that no path joins yet are compared, in cells of two blocks of the bucket. The exact Jaccard similarity of the shingle
sets decides, and classes are the components. So every pair that shares a band is in one class if it is similar.
Pieces: a piece that two documents hold is repeated; runs of repeated pieces of at least ``RUN_WORDS`` words are
passages. A passage whose pieces have different owners, the least documents that hold them, is reported in parts, one
for each stretch of one owner; a part may be shorter than ``RUN_WORDS``, and its owner need not list it.

Every unit of a class or passage is reported with the class's least document; ``keep`` marks the owner's own, which
stays, the others are removals. Sums are made before shuffles and joins meet one row for each node, so a line that a
third of all documents hold is one row a task.

A document is an id with a text: ``text_hash`` tells texts of one id (or of null ids) apart, repeated rows count as one.
Null texts and texts without words have no units. Words are compared in ASCII lower case without punctuation. A
document that repeats a paragraph within itself reports the later ones as removals; passages are repeats across
documents only. Null ids come before others. An empty table gives an empty result. Further columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import buckets, by_cell, cell_verifier, joined_roots, mix, open_cells, shingles
from .common import passes, sieve_of, slices, text_or_empty, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 20
BANDS, ROWS = 14, 3
REACH = 5
RUN_WORDS = 15

_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _GOLD)


def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their start and end in code points, and the paragraph each is in."""
    raw = text.encode("utf-8", "replace")
    plain = raw.translate(_PLAIN)
    words = plain.split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    code = np.frombuffer(plain, np.uint8)
    inside = np.concatenate(([False], code != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    own = np.frombuffer(raw, np.uint8)
    line = paragraphs_of(np.searchsorted(np.flatnonzero(own == 10), start))
    if len(raw) != len(text):
        point = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        start, end = point[start], point[end]
    return h, start, end, line


def paragraphs_of(line: np.ndarray) -> np.ndarray:
    """The line of each word, or for wrapped text the first line of its run of neighbouring short lines.

    A line without a word between parts a run, whatever else it holds.
    """
    if not len(line):
        return line
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(first, len(line)))
    number, short = line[first], size < MIN_WORDS
    goes_on = np.concatenate(([False], short[1:] & short[:-1] & (number[1:] == number[:-1] + 1)))
    start = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(first))))
    return np.repeat(number[start], size)


def pieces(h: np.ndarray) -> np.ndarray:
    """First word of every piece but the open one at the front."""
    n = len(h)
    key = mix(h)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for d in range(1, min(REACH, n - 1) + 1):
        least[d:] = np.minimum(least[d:], key[:-d])
        least[:-d] = np.minimum(least[:-d], key[d:])
    return np.flatnonzero(key < least)


def sums(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of each run of words [first, last)."""
    size = last - first
    at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    place = at - np.repeat(first, size)
    parts = mix(h[at] + (place + 1).astype(np.uint64) * _GOLD)
    return mix(np.add.reduceat(parts, np.concatenate(([0], np.cumsum(size)[:-1])))) if len(size) else np.empty(0, np.uint64)


def lines_of(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last) word of every paragraph of enough words."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last = np.append(first[1:], len(h))
    held = last - first >= MIN_WORDS
    return first[held], last[held]


def signatures(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(paragraphs, bands) keys of the paragraphs [first, last) of a text, each of ``SHINGLE`` words or more."""
    every = shingles(h, SHINGLE)
    size = last - first - (SHINGLE - 1)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    bag = every[np.repeat(first - begin, size) + np.arange(size.sum())]
    if len(bag) > 4096:
        low = np.stack([np.minimum.reduceat(mix(bag ^ seed), begin) for seed in _SEEDS])
    else:
        low = np.minimum.reduceat(mix(bag[None, :] ^ _SEEDS[:, None]), begin, axis=1)
    low = low.reshape(BANDS, ROWS, len(first))
    key = np.repeat(_SEEDS[:BANDS, None], len(first), axis=1)
    for i in range(ROWS):
        key = mix(key ^ low[:, i])
    return key.T.copy().view(np.int64)


def _units(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, piece, start, end, words, node, bands``: paragraphs and pieces of every row, from one reading.

    Only the first meeting of a paragraph in a partition carries its band keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            rows, cols, kinds, keys, held, seen = [], [[], [], [], []], [], [], [], set()
            for i, t in enumerate(b.column("body").to_pylist()):
                h, start, end, line = cut(t)
                if not len(h):
                    continue
                first, last = lines_of(h, line)
                at = pieces(h)
                n = len(first)
                first, last = np.concatenate((first, at[:-1])), np.concatenate((last, at[1:]))  # the last piece is open
                if not len(first):
                    continue
                nodes = sums(h, first, last).view(np.int64)
                rows.append(np.full(len(first), i))
                kinds.append(np.arange(len(first)) >= n)
                for c, v in zip(cols, (start[first], end[last - 1], last - first, nodes), strict=True):
                    c.append(v)
                fresh = np.zeros(len(first), bool)
                for k, node in enumerate(nodes[:n].tolist()):
                    if node not in seen:
                        seen.add(node)
                        fresh[k] = True
                if fresh.any():
                    keys.append(signatures(h, first[fresh], last[fresh]).ravel())
                held.append(fresh * BANDS)
            if rows:
                values = [np.concatenate(c).astype(np.int64) for c in cols]
                ends = pa.array(np.concatenate(([0], np.concatenate(held).cumsum())), pa.int32())
                at = pa.array(np.concatenate(rows))
                bands = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("mark").take(at), pa.array(np.concatenate(kinds)), *map(pa.array, values), bands], ["doc_id", "mark", "piece", "start", "end", "words", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, mark long, piece boolean, start long, end long, words long, node long, bands array<long>")


def _bodies(docs: DataFrame, sieve: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            nodes, bodies = [], []
            for t in b.column("body").to_pylist():
                h, _, _, line = cut(t)
                first, last = lines_of(h, line)
                own = sums(h, first, last).view(np.int64)
                for k in np.flatnonzero(passes(sent.value, own)):
                    nodes.append(own[k])
                    bodies.append(h[first[k] : last[k]].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(bodies, pa.binary())], ["node", "body"])

    return docs.select("body").mapInArrow(run, "node long, body binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(shingles(a, SHINGLE)), np.unique(shingles(b, SHINGLE))
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(len(x) + len(y) - shared, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1024):
        got = [jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= SIMILARITY for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.filter(pa.array(got, pa.bool_())).select(["a", "b"])


def _set(body: bytes) -> np.ndarray:
    return np.unique(shingles(np.frombuffer(body, np.uint32), SHINGLE))


def _head_links(one: DataFrame, rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, int]:
    """(``a, b``: verified links between paragraphs and the heads of their buckets, the number of candidates)."""
    met = rows.join(heads, "key").select(F.col("node").alias("a"), F.explode("heads").alias("b")).filter(F.col("a") != F.col("b"))
    near = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near", 2 * rows.count())
    pairs = near.join(one.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(one.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), near.count()


def _other_links(one: DataFrame, nodes: DataFrame, rows: DataFrame, heads: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b``: roots to be joined, as members of theirs that aren't heads share a bucket and are similar."""
    met = open_cells(nodes, rows, heads, roots)
    return by_cell(met.join(one, "node").select("key", "i", "j", "root", "right", "body")).mapInArrow(cell_verifier(_set, SIMILARITY), "a long, b long").distinct()


def roots_of(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``node, root``: components of the links between different paragraphs, for every node but roots."""
    nodes = written(units.filter(F.size("bands") > 0).select("node", "bands").dropDuplicates(["node"]), "nodes")
    rows, heads = buckets(nodes.select("node", F.explode("bands").alias("key")), nodes.count() * BANDS)
    wanted = rows.select("node").distinct()
    one = written(_bodies(docs, sieve_of(wanted)).dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "bodies")
    links, most = _head_links(one, rows, heads)
    first = components(links, rows=most)
    sizes = one.select("node", (F.octet_length("body") / 4).cast("long").alias("n"))
    return joined_roots(first, _other_links(one, sizes, rows, heads, first))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kind, start, end, n_words, class_id, keep, text_hash``: every repeated paragraph and passage, in code points."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")).withColumn("mark", F.xxhash64("body"))
    units = written(_units(narrow), "units")
    n_units = units.count()
    lines, parts = units.filter("not piece"), units.filter("piece")
    roots = roots_of(narrow, units)
    rows = lines.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    place = F.struct("doc_id", "mark", "start")
    heads = rows.groupBy("root").agg(F.min(place).alias("head"), F.max(place).alias("tail"))
    heads = written(heads.filter(~F.col("head").eqNullSafe(F.col("tail"))).select("root", "head"), "heads", n_units)  # a table of its own: AQE can split the join with a hot root
    kept = place.eqNullSafe(F.col("head"))
    paragraphs = rows.join(heads, "root").select("doc_id", F.lit("paragraph").alias("kind"), "start", "end", F.col("words").alias("n_words"), F.col("head.doc_id").alias("class_id"), kept.alias("keep"), F.col("mark").alias("text_hash"))
    who = F.struct("doc_id", "mark")
    owners = parts.groupBy("node").agg(F.min(who).alias("owner"), F.max(who).alias("last")).filter(~F.col("owner").eqNullSafe(F.col("last"))).select("node", "owner")
    owners = written(owners, "owners", n_units)
    met = parts.join(owners, "node").select("doc_id", "mark", "start", "end", "words", "owner").distinct()
    order = Window.partitionBy("doc_id", "mark").orderBy("start", "end")
    gap, before = F.lag("end").over(order), F.lag("owner").over(order)
    # Words of neighbouring pieces are parted by other characters only, at most so many.
    met = met.withColumn("fresh", gap.isNull() | (F.col("start") - gap > 40)).withColumn("turn", F.col("fresh") | ~F.col("owner").eqNullSafe(before))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumns({"run": F.sum(F.col("fresh").cast("int")).over(so_far), "part": F.sum(F.col("turn").cast("int")).over(so_far)})
    met = met.withColumn("whole", F.sum("words").over(Window.partitionBy("doc_id", "mark", "run"))).filter(F.col("whole") >= RUN_WORDS)
    runs = met.groupBy("doc_id", "mark", "owner", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"))
    own = who.eqNullSafe(F.col("owner"))
    passages = runs.select("doc_id", F.lit("passage").alias("kind"), "start", "end", "n_words", F.col("owner.doc_id").alias("class_id"), own.alias("keep"), F.col("mark").alias("text_hash"))
    return paragraphs.unionByName(passages)
