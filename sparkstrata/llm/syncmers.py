"""Document fingerprints from closed syncmers, in built-in functions only.

A text is read as symbols, whose edges depend on two neighbouring characters only: a symbol ends after a letter or
digit of ``ENDS``, after every letter or digit beyond the Latin blocks, and before a character that is neither letter
nor digit, which begins a symbol with what follows it. So reading doesn't depend on where it began, in any script, in
code or in base64. Every run of ``K`` symbols is looked at through its inner runs of ``S`` symbols. It is chosen, a
closed syncmer, if the least hash of its inner runs stands at its first or last place. Whether a run is chosen depends
on nothing but the run, so anchors survive any edit elsewhere, and the anchors of a joined text are those of its parts
and of the few runs across the joint. This is used: a document's anchors are found once, and an edited text needs only
the anchors of what was put in.

The fingerprint is the ``SKETCH`` least hashes of the distinct anchors (a bottom sketch: that of a union follows from
the parts' sketches), a colon, and a hash over all anchors with their places, so any change among them shows. The
likeness of two texts is the Dice coefficient of their whole sets of anchors, not an estimate. ``anchors`` gives the
anchors with their places, ``shared_runs`` matches those of pairs of documents by position.

Texts under ``K`` symbols have one anchor, the whole text; the empty text has none. Two empty texts have likeness 1, an
empty and another one 0. Null text counts as empty. Rows are ordered by id downwards, null ids last, then by a hash of
the text. Repeated rows each get a result. An empty table gives an empty result. Further columns may have any names.

Order without one task: ids are cut into ranges at approximate quantiles; an id that fills several ranges (null ids
too) is cut further by the hash of the text. A range also gets a copy of the first row of the range that follows, so
the next document is always in the same group. Text is shuffled once, anchors are found after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_or_empty

#: Letters and digits that end a symbol; about a fifth of Latin letters, so a symbol has some three characters.
ENDS = "aeAE05"
_INNER = r"[b-df-zB-DF-Z1-46-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
_END = r"[aeAE05[\p{L}\p{N}&&[^\x{0}-\x{24F}]]]"
SYMBOL = rf"(?s)[^\p{{L}}\p{{N}}]?(?:{_INNER}*+{_END}|{_INNER}++)|."
K, S = 4, 2  # three inner runs a run
SKETCH = 128
#: Rows in a range of ids, about, until there are so many ranges.
RANGE_ROWS, MAX_RANGES = 500, 200_000

_HASHES = "array<bigint>"


def _head(a: Column, drop: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - drop, F.lit(0)))


def _tail(a: Column, drop: int) -> Column:
    return F.slice(a, drop + 1, F.greatest(F.size(a) - drop, F.lit(0)))


def symbols(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0))


def _least(a: Column, step: int) -> Column:
    return F.zip_with(_head(a, step), _tail(a, step), lambda x, y: F.least(x, y))


def anchors(text: Column) -> Column:
    """``array<struct<at, hash>>``: chosen runs by the place of their first symbol, hashes below 2^32."""

    def chosen(inner: Column) -> Column:
        def of(least: Column) -> Column:
            def one(m, i):
                edge = (F.get(inner, i) == m) | (F.get(inner, i + (K - S)) == m)
                return F.when(edge, F.struct(i.alias("at"), F.xxhash64(F.get(inner, i), F.get(inner, i + S)).bitwiseAND(0xFFFFFFFF).alias("hash")))

            return F.filter(F.transform(least, one), lambda x: x.isNotNull())

        return let(let(_least(inner, 1), lambda m: _least(m, 1)), of)

    def runs(s: Column) -> Column:
        inner = F.transform(_head(s, S - 1), lambda x, i: F.xxhash64(x, F.get(s, i + 1)))
        whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.array_join(s, "")).bitwiseAND(0xFFFFFFFF).alias("hash")))
        none = F.array().cast("array<struct<at:int,hash:bigint>>")
        return F.when(F.size(s) == 0, none).when(F.size(s) < K, whole).otherwise(let(inner, chosen))

    return let(symbols(text), runs)


def distinct(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda a: a["hash"]))


def bottom(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)


def placed(found: Column, shift: Column | int = 0) -> Column:
    """A hash over all anchors with their places; that of two parts is the exclusive or of theirs."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda h, a: h.bitwiseXOR(F.xxhash64(a["at"] + shift, a["hash"])))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct hashes."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def written_out(hashes: Column, places: Column) -> Column:
    sketch = F.array_join(F.transform(bottom(hashes), lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")
    return F.concat(sketch, F.lit(":"), F.lower(F.lpad(F.hex(places), 16, "0")))


def fingerprint(text: Column) -> Column:
    return let(anchors(text), lambda found: written_out(distinct(found), placed(found)))


class _Ranges:
    """Groups of rows in order: ids by cuts, and those of one id or of null ids by the hash of the text."""

    def __init__(self, ids: DataFrame) -> None:
        n, known, least = ids.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id")).first()
        parts = min(max(1, known // RANGE_ROWS), MAX_RANGES)
        found = ids.filter(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / parts for i in range(1, parts)], max(0.2 / parts, 1e-6)) if parts > 1 else []
        pieces = {int(least or 0): 1}
        for cut in map(int, found):
            pieces[cut] = pieces.get(cut, 0) + 1
        for cut in [c for c, m in pieces.items() if m > 1 and c < 2**63 - 1]:
            pieces.setdefault(cut + 1, 1)  # a range of this id alone, in several pieces
        self.cuts = sorted(pieces)
        self.pieces = [pieces[c] if c < 2**63 - 1 else 1 for c in self.cuts]
        self.nulls = max(1, min((n - known) // RANGE_ROWS, MAX_RANGES))
        self.first = [self.nulls]
        for m in self.pieces:
            self.first.append(self.first[-1] + m)

    def of(self, doc_id: Column, mark: Column) -> Column:
        """Number of the range of a row; ascending in id (null ids first), then in mark."""
        step = max(1, int(len(self.cuts) ** 0.5))
        opens = F.from_json(F.lit(str(self.cuts[::step])), _HASHES)
        inner = F.from_json(F.lit(str([self.cuts[i : i + step] for i in range(0, len(self.cuts), step)])), "array<array<bigint>>")
        info = F.from_json(F.lit(str([[a, m] for a, m in zip(self.first, self.pieces, strict=False)])), "array<array<int>>")
        block = F.greatest(F.size(F.filter(opens, lambda c: c <= doc_id)) - 1, F.lit(0))
        found = let(block, lambda k: k * step + F.greatest(F.size(F.filter(F.get(inner, k), lambda c: c <= doc_id)) - 1, F.lit(0)))

        def piece(n: Column | int) -> Column:
            n = F.lit(n) if isinstance(n, int) else n
            return F.least(F.floor((mark / F.lit(2.0**64) + 0.5) * n).cast("int"), n - 1)

        known = let(found, lambda k: let(F.get(info, k), lambda x: x[0] + piece(x[1])))
        return F.when(doc_id.isNull(), piece(self.nulls)).otherwise(known)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns: each document's and its edited text's fingerprint, and both likenesses."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("body"))
    ranges = _Ranges(rows.select("doc_id"))
    rows = rows.withColumn("mark", F.xxhash64("body"))
    rows = rows.withColumn("part", ranges.of(F.col("doc_id"), F.col("mark")))
    # Bounded: one row for each range. The first of a range in this order is what follows the last of the next higher.
    tops = rows.groupBy("part").agg(F.max(F.struct("doc_id", "mark")).alias("top")).select("part", "top.*").collect()
    parts = sorted(t["part"] for t in tops)
    above = {p: q for p, q in zip(parts, parts[1:] + parts[:1], strict=True)}
    spark = docs.sparkSession
    moved = spark.createDataFrame([(t["doc_id"], t["mark"], above[t["part"]]) for t in tops], "t_id long, t_mark long, t_part int")
    ghosts = rows.join(F.broadcast(moved), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("mark") == F.col("t_mark"))).dropDuplicates(["t_part"])
    both = rows.select("doc_id", "body", "mark", "part", F.lit(False).alias("ghost")).unionByName(ghosts.select("doc_id", "body", "mark", F.col("t_part").alias("part"), F.lit(True).alias("ghost")))
    both = both.repartition("part")  # that of the window below, so anchors aren't shuffled

    n = F.length("body")
    kept = n - F.floor(n / 2).cast("int")

    def own(front: Column) -> Column:
        """``front``: symbols of the kept front; all but the last are symbols of the edited text as well."""
        begin = F.greatest(F.size(front) - K, F.lit(0))
        last = F.array_join(F.slice(front, begin + 1, K), "")

        def of(found: Column) -> Column:
            inside = F.filter(found, lambda a: (a["at"] < begin) & (F.size(front) > K))
            return F.struct(
                distinct(found).alias("all"),
                placed(found).alias("places"),
                distinct(inside).alias("front"),
                placed(inside).alias("front_places"),
                begin.alias("begin"),
                last.alias("last"),
            )

        return let(anchors(F.col("body")), of)

    made = both.select("doc_id", "body", "mark", "part", "ghost", n.alias("n"), kept.alias("kept"), let(symbols(F.substring(F.col("body"), F.lit(1), kept)), own).alias("own"))
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("mark").desc())
    then = F.lead(F.struct("body", F.col("own.all").alias("all"))).over(order)
    pairs = made.withColumn("then", then).filter(~F.col("ghost"))
    put = F.substring(F.col("then.body"), F.lit(1), F.col("n") - F.col("kept"))

    def edited(found: Column) -> Column:
        hashes = F.array_union(F.col("own.front"), distinct(found))
        return let(hashes, lambda h: F.struct(written_out(h, F.col("own.front_places").bitwiseXOR(placed(found, F.col("own.begin")))).alias("fingerprint"), likeness(F.col("own.all"), h).alias("near")))

    done = pairs.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.concat(F.substring(F.col("body"), F.lit(1), F.col("kept")), put), 256).alias("edited_sha256"),
        written_out(F.col("own.all"), F.col("own.places")).alias("fingerprint"),
        let(anchors(F.concat(F.col("own.last"), put)), edited).alias("edited"),
        likeness(F.col("own.all"), F.col("then.all")).alias("near_next"),
    )
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("edited.fingerprint").alias("edited_fingerprint"), F.col("edited.near").alias("near_edited"), "near_next")


def shared_runs(docs: DataFrame, pairs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b, shift, n_anchors, first, last``: where the texts of each pair (``a, b``) hold the same anchors in place.

    Anchors that a text holds once are matched; those at one distance (``shift`` symbols from a to b) are one row, from
    symbol ``first`` to ``last`` of a. Null ids are in no pair; texts of one id count as one text each.
    """
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("body")).join(ids, "id", "left_semi")
    found = rows.select("id", F.xxhash64("body").alias("mark"), F.explode(anchors(F.col("body"))).alias("x"))
    once = found.groupBy("id", "mark", F.col("x.hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("x.at").alias("at")).filter("n = 1")
    left = once.select(F.col("id").alias("a"), F.col("mark").alias("a_mark"), "hash", F.col("at").alias("a_at"))
    right = once.select(F.col("id").alias("b"), F.col("mark").alias("b_mark"), "hash", F.col("at").alias("b_at"))
    met = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "hash"])
    runs = met.groupBy("a", "b", "a_mark", "b_mark", (F.col("b_at") - F.col("a_at")).alias("shift"))
    return runs.agg(F.count(F.lit(1)).alias("n_anchors"), F.min("a_at").alias("first"), F.max("a_at").alias("last")).select("a", "b", "shift", "n_anchors", "first", "last")
