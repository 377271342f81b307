"""Near-duplicate documents by BagMinHash.

A text is the multiset of its runs of ``SHINGLE`` words. For every shingle a Poisson process runs over time and weight:
the weight axis is cut into [0, 1), [1, 2), [2, 4), ..., each interval has points at the rate of its length, and a
point also draws a place in the interval and one of ``SIZE`` signature components. A shingle that occurs w times owns
the points placed below w. A component holds the earliest point time, so two signatures agree in a component with the
probability of the weighted Jaccard similarity. Processes are cut at the time by which every component is almost surely
met (later if not), so a signature costs about one draw a shingle.

Then ``BANDS`` bands of ``ROWS`` components: texts that agree in a band meet. At similarity 0.8 a pair meets in at least
one band but for 3 in a million. First all members of a bucket are compared with two of them, the one that meets most others
over all bands (of a text and its edited copies that is the text) and one drawn anew for each bucket; this joins most
of what belongs together with edges that grow with the rows. Then every two members of a bucket that no path joins yet
are compared: the bucket is cut into blocks and each two blocks are a cell of their own (see ``cells``), so a bucket of
one template's texts costs the square of its size, but no task gathers it. Candidates are
sieved by size ratio and by agreement of the whole signatures (4.5 standard errors of slack), and the rest is verified
on the exact multisets: sum of minima over sum of maxima, at least ``SIMILARITY``. Classes are the components.

Texts of equal words are one node, its copies only carry the class, so copies are never paired. Nodes are the first
half of a 128-bit hash; where two texts share it but not the second half, only the texts of the least second half are
the node, each other one is a class of its own: it may lose a link, but no document goes because of a shared hash.

Null text counts as empty. Texts without a word are alike only if they are equal. Texts under ``SHINGLE`` words are one
shingle. Repeated rows belong to one class. An empty table gives an empty result. Further columns may have any names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, passes, sieve_of, slices, text_or_empty, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
#: Standard errors that a candidate's signature agreement may lie below the threshold.
SLACK = 4.5
#: Members and words that a block of a bucket holds, about.
BLOCK, BLOCK_WORDS = 256, 1 << 16

_PUNCT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11 = (np.uint64(x) for x in (30, 27, 31, 11))


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = (z ^ (z >> _S30)) * _A
    z = (z ^ (z >> _S27)) * _B
    return z ^ (z >> _S31)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCT).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole if it is shorter; none of nothing."""
    w = words.astype(np.uint64)
    n = min(size, len(w))
    if not n:
        return w
    h = w[: len(w) - n + 1] + _GOLD
    for i in range(1, n):
        h = mix(h) + w[i : len(w) - n + 1 + i]
    return mix(h)


def node_of(text: str | None, words: list[bytes]) -> tuple[int, int]:
    """Two halves of a 128-bit hash of a text's words; of the text itself if it has none."""
    body = b" ".join(words) if words else b"\x00" + (text or "").encode("utf-8", "replace")
    digest = hashlib.blake2b(body, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bags(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, count) of the distinct elements of each row's multiset."""
    made = [np.unique(r, return_counts=True) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(m[0]) for m in made])
    element = np.concatenate([m[0] for m in made]) if made else np.empty(0, np.uint64)
    return row, element, np.concatenate([m[1] for m in made]) if made else np.empty(0, np.int64)


def signatures(rows: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures (rows, size) of multisets of 64-bit elements; empty multisets keep infinity."""
    out = np.full((len(rows), size), np.inf)
    row, element, count = bags(rows)
    total = np.bincount(row, count, len(rows))
    end = np.where(total > 0, size * (np.log(size) + 5) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        mine = todo[row]
        _points(out, row[mine], element[mine], count[mine], end)
        todo = np.isinf(out).any(1) & (total > 0)
        end = np.where(todo, end * 4, 0.0)
        out[todo] = np.inf
    return out


def _points(out: np.ndarray, row: np.ndarray, element: np.ndarray, count: np.ndarray, end: np.ndarray) -> None:
    size = np.uint64(out.shape[1])
    level = 0
    while len(row):
        low, length = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        held = count > low
        row, element, count = row[held], element[held], count[held]
        r, w = row, count
        state = mix(element + np.uint64(level * int(_B) % (1 << 64)))
        time = np.zeros(len(r))
        limit = end[r]
        while len(r):
            state = state + _GOLD
            draw = mix(state)
            time = time - np.log1p(-((draw >> _S11).astype(np.float64) * 2.0**-53)) / length
            live = time <= limit
            if not live.all():
                r, w, state, time, limit = r[live], w[live], state[live], time[live], limit[live]
            if not len(r):
                break
            more = mix(state ^ _A)
            place = low + ((more >> _S11).astype(np.float64) * 2.0**-53 * length).astype(np.int64)
            fits = place < w
            part = (mix(more) % size).astype(np.int64)
            np.minimum.at(out, (r[fits], part[fits]), time[fits])
        level += 1


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, bands) hashes of the bands."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD), bits.shape[:2]).copy()
    for i in range(ROWS):
        h = mix(h ^ bits[:, :, i])
    return h.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(m[i], n[j]).sum())
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, node, check, n, bands, sketch`` of every row; ``mark`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            texts = b.column("body").to_pylist()
            words = [words_of(t) for t in texts]
            rows = [shingles(word_hashes(w)) for w in words]
            sig = signatures(rows)
            n = np.array([len(r) for r in rows], np.int64)
            keys = band_keys(sig)
            sketch = (mix(sig.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).view(np.int8)
            ends = pa.array(np.where(n > 0, BANDS, 0).cumsum(), pa.int32())
            ends = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            some = n > 0
            marks = pa.concat_arrays([pa.array([0], pa.int32()), pa.array(np.where(some, SIZE, 0).cumsum(), pa.int32())])
            node, check = np.array([node_of(t, w) for t, w in zip(texts, words, strict=True)], np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(node), pa.array(check), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(keys[some].ravel())), pa.ListArray.from_arrays(marks, pa.array(sketch[some].ravel()))],
                ["doc_id", "mark", "node", "check", "n", "bands", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, mark long, node long, check long, n long, bands array<long>, sketch array<tinyint>")


def _bodies(docs: DataFrame, sieve: np.ndarray) -> DataFrame:
    """``node, body``: the word hashes of each row that passes the sieve."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            texts = b.column("body").to_pylist()
            words = [words_of(t) for t in texts]
            nodes = np.array([node_of(t, w)[0] for t, w in zip(texts, words, strict=True)], np.int64)
            held = np.flatnonzero(passes(sent.value, nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[held]), pa.array([word_hashes(words[i]).tobytes() for i in held], pa.binary())], ["node", "body"])

    return docs.select("body").mapInArrow(run, "node long, body binary")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256):
        a, c = (b.column(i).to_pylist() for i in (2, 3))
        keep, last, made = [], None, None
        for x, y in zip(a, c, strict=True):
            if y is not last and y != last:
                last, made = y, shingles(np.frombuffer(y, np.uint32))
            keep.append(similarity(shingles(np.frombuffer(x, np.uint32)), made) >= SIMILARITY)
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _least_agreement() -> float:
    return SIZE * (SIMILARITY - SLACK * (SIMILARITY * (1 - SIMILARITY) / SIZE) ** 0.5)


def cells(members: DataFrame) -> DataFrame:
    """``key, i, j, node, n, root, right``: each member of a bucket of several roots, once for each cell it is in.

    A cell (i, j) is two blocks of a bucket (``right``: in the second), or one block with itself. The members of a
    bucket's largest root have blocks of their own if they fill one, and these don't meet each other.
    """
    roots = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    keys = roots.groupBy("key").agg(F.max(F.struct("m", "w", "root")).alias("big"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots")).filter(F.col("roots") > 1)

    def parts(m: Column, w: Column) -> Column:
        return F.ceil(F.greatest(m / BLOCK, w / BLOCK_WORDS)).cast("int")

    alone = F.col("big.m") > BLOCK
    keys = keys.select(
        "key",
        F.when(alone, F.col("big.root")).alias("big"),
        F.when(alone, parts(F.col("big.m"), F.col("big.w"))).otherwise(0).alias("own"),
        F.when(alone, parts(F.col("m") - F.col("big.m"), F.col("w") - F.col("big.w"))).otherwise(parts(F.col("m"), F.col("w"))).alias("rest"),
    )
    rows = members.join(written(keys, "open-buckets", members.count()), "key")
    place = F.xxhash64("node", "key")
    x = F.when(F.col("root").eqNullSafe(F.col("big")), F.pmod(place, F.col("own"))).otherwise(F.col("own") + F.pmod(place, F.col("rest"))).cast("int")
    rows = rows.withColumn("x", x)
    other = F.sequence(F.when(F.col("x") < F.col("own"), F.col("own")).otherwise(0), F.col("own") + F.col("rest") - 1)
    rows = rows.withColumn("y", F.explode(other))
    return rows.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "node", "n", "root", (F.col("x") > F.col("y")).alias("right"))


def by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches sorted by the first three columns."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            own = tuple(at[:, lo])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def sides(right: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which pairs (row, row) of a cell are to be compared, each once."""
    across = ~right[:, None] & right[None, :] if right.any() else np.triu(np.ones((len(right),) * 2, bool), 1)
    return across & (root[:, None] != root[None, :])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that a signature doesn't keep from being similar to some other."""
    least = _least_agreement()
    for cell in groups(batches):
        root, right, n = (cell.column(c).to_numpy() for c in ("root", "right", "n"))
        open_ = sides(right, root)
        open_ &= np.minimum(n[:, None], n[None, :]) >= SIMILARITY * np.maximum(n[:, None], n[None, :])
        sketch = cell.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(n), SIZE)
        held = np.zeros(len(n), bool)
        for k in np.flatnonzero(open_.any(1)):
            with_ = np.flatnonzero(open_[k])
            near = with_[(sketch[with_] == sketch[k]).sum(1) >= least]
            held[near] = True
            held[k] |= len(near) > 0
        if held.any():
            kept = cell.select(["key", "i", "j", "node", "root", "right"]).filter(pa.array(held))
            yield from kept.combine_chunks().to_batches()


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """(rows, rows) sums of minima of multisets."""
    tokens = []
    for r in rows:
        r = np.sort(r)
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))[: len(r)]
        nth = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        tokens.append(mix(r + nth.astype(np.uint64) * _GOLD))  # the nth of equal elements: minima are intersections
    row = np.repeat(np.arange(len(rows)), [len(t) for t in tokens])
    _, col, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = count > 1
    row, col = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(rows), len(rows)), np.int64)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, (lo, lo + width))
        x = np.zeros((len(rows), width), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def cell_verifier(bag: Callable[[bytes], np.ndarray], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the roots of each cell's members whose bags, made of ``body``, are ``least`` or more alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches):
            root, right = (cell.column(c).to_numpy() for c in ("root", "right"))
            compared = sides(right, root)
            if not compared.any():
                continue
            rows = [bag(x) for x in cell.column("body").to_pylist()]
            n = np.array([len(r) for r in rows])
            shared = overlaps(rows)
            a, b = np.nonzero(compared & (shared >= least * (n[:, None] + n[None, :] - shared)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(root[a]), pa.array(root[b])], ["a", "b"])

    return run


def _bag(body: bytes) -> np.ndarray:
    return shingles(np.frombuffer(body, np.uint32))


def _wanted_bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    return written(_bodies(docs, sieve_of(wanted)).dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "bodies")


def _head_links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, int]:
    """(``a, b``: verified links between the members of buckets and their heads, the number of candidates)."""
    met = rows.join(heads, "key").select(F.col("node").alias("a"), F.explode("heads").alias("b")).filter(F.col("a") != F.col("b"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    near = met.join(left, "a").join(right, "b")
    near = near.filter(F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
    agree = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda x: x))
    near = written(near.filter(agree >= _least_agreement()).select("a", "b"), "near")
    one = _wanted_bodies(docs, near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct())
    pairs = near.join(one.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(one.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), near.count()


def _other_links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, heads: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b``: roots to be joined, as members of theirs that aren't heads share a bucket and are similar."""
    met = open_cells(nodes, rows, heads, roots).join(nodes.select("node", "sketch"), "node")
    left = by_cell(met.select("key", "i", "j", "node", "n", "root", "right", "sketch")).mapInArrow(_agreeing, "key long, i int, j int, node long, root long, right boolean")
    left = written(left, "left")
    one = _wanted_bodies(docs, left.select("node").distinct())
    return by_cell(left.join(one, "node").select("key", "i", "j", "root", "right", "body")).mapInArrow(cell_verifier(_bag, SIMILARITY), "a long, b long").distinct()


def buckets(rows: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``node, key`` rows of the buckets of several members, ``key, heads``: the member that meets most, and one drawn).

    ``most``: about so many ``rows`` at most, if known.
    """
    full = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1), "full", most)
    many = full.count()
    rows = written(rows.join(full, "key"), "buckets")
    degree = rows.groupBy("node").agg(F.sum("size").alias("degree"))
    rows = written(rows.select("node", "key").join(degree, "node"), "degrees")
    place = F.xxhash64("node", "key")
    heads = rows.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"), F.min(F.struct(place.alias("place"), "node")).alias("any"))
    return rows, written(heads.select("key", F.array_distinct(F.array("hub.node", "any.node")).alias("heads")), "bucket-heads", many)


def joined_roots(first: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after ``links`` (``a, b``) between the roots of ``first``, for every node but roots."""
    then = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = first.join(then, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(then.select(F.col("root").alias("node"), F.col("top").alias("root")))


def open_cells(nodes: DataFrame, rows: DataFrame, heads: DataFrame, roots: DataFrame) -> DataFrame:
    """The cells (see ``cells``) of those members that aren't heads and that no path joins yet."""
    known = nodes.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    members = rows.join(heads, "key").filter(~F.array_contains("heads", F.col("node"))).select("key", "node").join(known, "node")
    return cells(written(members, "members"))


def roots_of(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``node, root``: components of the links between all nodes that share a band, for every node but roots."""
    nodes = written(signed.filter(F.col("n") > 0).select("node", "n", "bands", "sketch").dropDuplicates(["node"]), "nodes")
    rows, heads = buckets(nodes.select("node", F.explode("bands").alias("key")), nodes.count() * BANDS)
    links, most = _head_links(docs, nodes, rows, heads)
    first = components(links, rows=most)
    return joined_roots(first, _other_links(docs, nodes, rows, heads, first))


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")).withColumn("mark", F.xxhash64("body"))
    signed = written(_signed(narrow), "signed")
    roots = roots_of(narrow, signed)
    halves = signed.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most"))
    shared = written(halves.filter(F.col("least") != F.col("most")).select("node", "least"), "shared-hashes")
    rows = signed.select("doc_id", "mark", "node", "check").join(roots, "node", "left").join(shared, "node", "left")
    other = F.coalesce(F.when(F.col("check") != F.col("least"), F.col("check")), F.lit(0)).alias("other")
    rows = rows.select("doc_id", "mark", F.coalesce("root", "node").alias("root"), other)
    heads = written(rows.groupBy("root", "other").agg(F.min(F.struct("doc_id", "mark")).alias("head")), "heads", signed.count())  # a table of its own: AQE can split the join with a hot root
    return rows.join(heads, ["root", "other"]).select("doc_id", "mark", "head")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id``: one row for each row of ``docs``; a class goes by its least id (a null id comes first)."""
    return _classes(docs, doc_id, text).select("doc_id", F.col("head.doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one of the least id, one of equal rows."""
    found = _classes(docs, doc_id, text)
    mark, id_, of = (fresh(docs, n) for n in ("kept_mark", "kept_id", "kept_of"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))).select(F.col("doc_id").alias(id_), F.col("mark").alias(of)).distinct()
    rows = docs.withColumn(mark, F.xxhash64(text_or_empty(text)))
    rows = rows.join(kept, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(of)), "left_semi")
    return rows.dropDuplicates([doc_id, mark]).drop(mark)
