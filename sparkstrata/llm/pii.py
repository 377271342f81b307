"""Information-theoretic sanitisation of personal data, in built-in functions only.

Two steps. Patterns find the protected entities (email, ip, card, phone). Then corpus co-occurrence says how much each
term gives an entity away: df counts the documents of the whole corpus that hold a term, an entity, or both, and a term
t reveals the share

    PMI(t; e) / IC(e) = 1 - log p(e | t) / log p(e),   p(e | t) = df(t, e) / df(t),   p(e) = df(e) / N

of what there is to know about entity e. Every pair of a term and an entity that ``SUPPORT`` documents hold together is
judged, if that isn't chance: df(t, e) documents drawn at random hold e with probability p(e)^df(t, e), which must be
at most exp(-``EVIDENCE``). Copies of a text are documents like others, so near-duplicates should go before. A pair above ``GENERALISE`` makes all occurrences of the term, in the documents that hold this entity, ``generalise``
spans, one above ``REMOVE`` makes them ``remove`` spans (a term that is both is removed). Occurrences inside base spans
don't count. An entity that more than one in 2^``MIN_BITS`` documents holds is common knowledge, no term discloses it.

Terms are runs of ``TERM`` letters, compared in lower case. They are counted on the whole text for df(t), outside base
spans for df(t, e). ``sanitised`` writes the texts: base spans become their kind, removed terms vanish, generalised ones
become their word class.

Cost: one scan finds spans, and the distinct terms of those documents that have any; one counts terms; one, joined
with the few documents that have risky terms (broadcast by Spark if that table is small), places them. Only short
strings are shuffled, sums are made before. An entity or term that a third of all rows hold is one row for each pair
after the map-side sums, so no key gathers rows.

Null text counts as empty. Repeated rows and ids each get a result and count each time. Terms, entities and spans are
sets, so ties need no choice. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read; further
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, text_or_empty, written
from .spans import Rule, count_of, found, joined, matches, replaced, tagged

SUPPORT = 3
EVIDENCE = 9.0
GENERALISE = 0.85
REMOVE = 0.97
MIN_BITS = 3
TERM = r"\p{L}{2,}+"
#: What a base span becomes, what a generalised term becomes.
PUT = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]"}
NAME, WORD = "[Name]", "[word]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column, g: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


# Base kinds in listing order. Possessive loops and the looks behind keep very long runs linear; the matches are those
# of the plain patterns, because what follows a run doesn't depend on where in the run a match began.
RULES = (
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m, g: F.lit(True)),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _octets),
    Rule("card", r"[0-9](?:[ -]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), lambda m, g: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))),
    Rule("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda m, g: F.length(_digits(m)).between(9, 15)),
)
KINDS = tuple(r.kind for r in RULES)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__body`` and ``__found``: all base spans, sorted."""
    rows = docs.withColumn("__body", text_or_empty(text))
    spans = F.concat(*(tagged(found(F.col("__body"), r), r.kind, i) for i, r in enumerate(RULES)))
    return rows.withColumn("__found", F.array_sort(spans))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(_digits(s["value"])))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosure(df_te: Column, df_t: Column, df_e: Column, n_docs: Column | int) -> Column:
    """The share of an entity's information that a term reveals, at most 1."""
    p_e = df_e / (F.lit(n_docs).cast("double") if isinstance(n_docs, int) else n_docs)
    return F.when(p_e >= 1, F.lit(0.0)).otherwise(1 - F.log(df_te / F.greatest(df_t, df_te)) / F.log(p_e))


def risky_pairs(docs: DataFrame, base: DataFrame, *, text: str, support: int, min_bits: float) -> DataFrame:
    """``term, entity, disclosed`` of the pairs at or above ``GENERALISE``. ``base``: ``entities, terms`` of each document."""
    n_docs = base.count()
    held = base.filter(F.size("entities") > 0).select(F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    entities = written(entities.filter((F.col("df_e") >= support) & (F.col("df_e") <= n_docs / 2.0**min_bits)), "pii-entities")
    each = base.filter(F.size("entities") > 0).select(F.explode("entities").alias("entity"), "terms").join(entities.select("entity"), "entity", "left_semi")
    pairs = each.select("entity", F.explode("terms").alias("term")).groupBy("term", "entity").agg(F.count(F.lit(1)).alias("df_te")).filter(F.col("df_te") >= support)
    pairs = pairs.join(entities, "entity").filter(F.col("df_te") * F.log(F.lit(max(n_docs, 1)) / F.col("df_e")) >= EVIDENCE)
    pairs = written(pairs, "pii-pairs")
    df_t = docs.select(F.explode(_terms(text_or_empty(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t")).filter(F.col("df_t") >= support)
    shown = disclosure(F.col("df_te"), F.col("df_t"), F.col("df_e"), max(n_docs, 1))
    # A term counts on the whole text, so one that is never whole there (a base span cuts it) has a df(t) of df(t, e).
    near = pairs.join(df_t, "term", "left").withColumn("df_t", F.coalesce("df_t", "df_te"))
    return near.withColumn("disclosed", shown).filter(F.col("disclosed") >= GENERALISE).select("term", "entity", "disclosed")


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, min_bits: float = MIN_BITS) -> DataFrame:
    """``doc_id, text_hash, found, added``: base spans and the spans of revealing terms, one row for each row of ``docs``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seen = detect(narrow, "text")
    outside = replaced(F.col("__body"), F.col("__found"), lambda s: F.lit("\n"))
    some = F.size("__found") > 0
    base = seen.select(
        "doc_id",
        F.xxhash64("__body").alias("text_hash"),
        F.col("__found").alias("found"),
        F.array_distinct(F.transform("__found", _entity)).alias("entities"),
        F.when(some, _terms(outside)).alias("terms"),
    )
    base = written(base, "pii-base")
    risky = written(risky_pairs(narrow, base, text="text", support=support, min_bits=min_bits), "pii-risky")
    held = base.filter(F.size("entities") > 0).select("doc_id", "text_hash", F.explode("entities").alias("entity"), "terms").join(risky.select("entity").distinct(), "entity", "left_semi")
    met = held.select("doc_id", "text_hash", "entity", F.explode("terms").alias("term")).join(risky, ["term", "entity"])
    worst = met.groupBy("doc_id", "text_hash", "term").agg(F.max("disclosed").alias("d"))
    split = worst.groupBy("doc_id", "text_hash").agg(F.collect_list(F.when(F.col("d") < REMOVE, F.col("term"))).alias("general"), F.collect_list(F.when(F.col("d") >= REMOVE, F.col("term"))).alias("gone"))
    marks = written(split, "pii-marks")
    rows = narrow.select(F.col("doc_id").alias("d"), F.xxhash64(text_or_empty("text")).alias("h"), text_or_empty("text").alias("body"))
    rows = rows.join(marks, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).dropDuplicates(["d", "h"])
    rows = rows.join(base.select(F.col("doc_id").alias("bd"), F.col("text_hash").alias("bh"), "found").dropDuplicates(["bd", "bh"]), F.col("d").eqNullSafe(F.col("bd")) & (F.col("h") == F.col("bh")))
    added = written(rows.select("d", "h", _placed(F.col("body"), F.col("found"), F.col("general"), F.col("gone")).alias("added")), "pii-added")
    b, m = base.alias("b"), added.alias("m")
    out = b.join(m, F.col("b.doc_id").eqNullSafe(F.col("m.d")) & (F.col("b.text_hash") == F.col("m.h")), "left")
    none = F.array().cast(added.schema["added"].dataType)
    return out.select("b.doc_id", "b.text_hash", "b.found", F.coalesce("m.added", none).alias("added"))


def _placed(body: Column, spans: Column, general: Column, gone: Column) -> Column:
    """All occurrences of the terms of two lists that no base span touches, as tagged spans."""
    order = len(KINDS)

    def of(words: Column) -> Column:
        clear = F.filter(words, lambda w: F.array_contains(F.concat(general, gone), F.lower(w["value"])))
        clear = F.filter(clear, lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))

        def one(w: Column) -> Column:
            out = F.array_contains(gone, F.lower(w["value"]))
            kind = F.when(out, F.lit("remove")).otherwise(F.lit("generalise"))
            return F.struct(w["start"].alias("start"), F.when(out, F.lit(order + 1)).otherwise(F.lit(order)).alias("ord"), kind.alias("kind"), w["end"].alias("end"), w["value"].alias("value"))

        return F.transform(clear, one)

    return let(matches(body, F.lit(TERM)), of)


def sanitised(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with personal data and revealing terms taken out of ``text``; all rows and columns stay.

    Base spans become ``PUT`` of their kind, ``remove`` terms are cut out, ``generalise`` terms become ``NAME`` if they
    begin with a capital letter, ``WORD`` otherwise. Of overlapping spans the first counts. A null text stays null.
    """
    spans = sanitise(docs, doc_id=doc_id, text=text, support=support, min_bits=min_bits)
    all_spans = F.array_sort(F.concat("found", F.col("added").cast(spans.schema["found"].dataType)))
    i, h, s = (fresh(docs, n) for n in ("span_id", "span_hash", "span_list"))
    marks = spans.filter((F.size("found") > 0) | (F.size("added") > 0)).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), all_spans.alias(s)).dropDuplicates([i, h])
    marks = written(marks, "pii-spans")
    rows = docs.join(marks, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(text_or_empty(text)) == F.col(h)), "left")

    def put(x: Column) -> Column:
        base = F.lit("")
        for kind, word in PUT.items():
            base = F.when(x["kind"] == kind, F.lit(word)).otherwise(base)
        first = F.substring(x["value"], F.lit(1), F.lit(1))
        return F.when(x["kind"] == "generalise", F.when(F.lower(first) != first, F.lit(NAME)).otherwise(F.lit(WORD))).otherwise(base)

    new = F.when(F.col(s).isNotNull() & F.col(text).isNotNull(), replaced(F.col(text), F.col(s), put)).otherwise(F.col(text))
    return rows.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from ``sanitise``."""
    both = F.concat("found", F.col("added").cast(spans.schema["found"].dataType))
    return spans.select("doc_id", *(count_of("found", k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("found")), 256).alias("base_sha256"), joined(both).alias("spans"))
