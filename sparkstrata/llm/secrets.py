"""Secret scans through an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its content. A ledger row says
which rules, in which versions, a blob was scanned for, and what was found. A run scans a blob only for the rules the ledger lacks, so a new rule
rescans for itself alone, and joins findings back to all paths that hold the blob.

Cost: ids and digests are shuffled for all rows; a text moves only if it may hold a secret (a necessary keyword or
long-run test passed) and is the first holder of its blob. The join is on the holder's row, so a blob that a third of
all rows share is one row there, and joining findings back meets one finding row per blob (AQE splits the hot side).

Null text counts as empty. Repeated rows and ids each get their own result. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read; further columns may have any names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty, written
from .spans import Rule, count_of, found, joined, replaced, tagged

# Fixed values of the contract: three base kinds, in listing order; then the kinds that this operator adds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = ("assign", "access", "hex")

def _keyword(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")


RULES = (
    Rule("assign", "(?i)" + ASSIGN, _keyword, lambda m, g: F.length(g) >= 6, 2),
    Rule("access", r"AKIA[A-Z0-9]++", lambda t: t.contains("AKIA"), lambda m, g: F.length(m) >= 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", lambda t: t.rlike("[0-9a-f]{24}"), lambda m, g: F.lit(True)),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", lambda t: t.contains("PRIVATE KEY-----"), lambda m, g: F.lit(True)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", lambda t: t.contains(".eyJ"), lambda m, g: F.lit(True)),
    Rule("ghp", r"gh[pousr]_[A-Za-z0-9]{36,}+", lambda t: t.rlike("gh[pousr]_"), lambda m, g: F.lit(True)),
)
#: ``rule_version`` lists the rules scanned in one run, each with its version.
LEDGER_SCHEMA = "blob string, rule_version string, spans array<struct<start:int,ord:int,kind:string,end:int,value:string>>"


def rule_version(rule: Rule) -> str:
    """Changes whenever a rule finds other spans: by its pattern, its group, or the written-out test of its matches."""
    test = str(rule.keep(F.col("match"), F.col("inner")))
    return f"{rule.kind}:{zlib.crc32(repr((rule.kind, rule.pattern, rule.group, test)).encode()):08x}"


def may_hold(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The kinds that a text may hold, as an array; empty for most texts."""
    return F.array_compact(F.array(*(F.when(r.sieve(text), F.lit(r.kind)) for r in rules)))


def _marked(rows: DataFrame, text: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, str, str]:
    """``rows`` with a blob and a kinds column, whose names no column of theirs has."""
    blob, may = fresh(rows, "blob"), fresh(rows, "may_hold")
    body = text_or_empty(text)
    return rows.withColumns({blob: F.sha2(body, 256), may: may_hold(body, rules)}), blob, may


def _facts(docs: DataFrame, path: str, text: str, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """(blob, spans) of every blob with findings; ledger rows of this run. ``docs`` is read twice: ids, then bodies."""
    versions = F.array(*(F.lit(rule_version(r)) for r in rules))
    key = F.coalesce(F.col(path).cast("string"), F.lit(""))
    body = text_or_empty(text)
    index = docs.select(F.sha2(body, 256).alias("blob"), may_hold(body, rules).alias("may"), key.alias("holder"))
    blobs = index.groupBy("blob").agg(F.min("holder").alias("holder"), F.first("may").alias("may"))
    known, none = None, F.array().cast("array<string>")
    if ledger is not None:
        known = ledger.select("blob", F.array_intersect(F.split("rule_version", ","), versions).alias("done"), "spans").filter(F.size("done") > 0)
        known = known.withColumn("spans", F.filter("spans", lambda s: F.exists("done", lambda v: F.startswith(v, F.concat(s["kind"], F.lit(":"))))))
        known = known.groupBy("blob").agg(F.flatten(F.collect_set("done")).alias("done"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        blobs = blobs.join(known.select("blob", "done"), "blob", "left").withColumn("todo", F.array_except(versions, F.coalesce("done", none))).drop("done")
    else:
        blobs = blobs.withColumn("todo", versions)
    blobs = written(blobs.filter(F.size("todo") > 0), "unseen")
    kinds = F.transform("todo", lambda v: F.substring_index(v, ":", 1))
    open_ = blobs.withColumn("scan", F.array_intersect(kinds, "may")).filter(F.size("scan") > 0)
    bodies = docs.filter(F.size(may_hold(body, rules)) > 0).select(F.sha2(body, 256).alias("blob"), key.alias("holder"), body.alias("body"))
    fresh_ = bodies.join(open_.select("blob", "holder", "scan"), ["blob", "holder"]).groupBy("blob").agg(F.first("body").alias("body"), F.first("scan").alias("scan"))
    each = (F.when(F.array_contains("scan", r.kind), tagged(found(F.col("body"), r), r.kind, i)).otherwise(F.array()) for i, r in enumerate(rules))
    scanned = fresh_.select("blob", F.array_sort(F.concat(*each)).alias("spans"))
    new = written(scanned.filter(F.size("spans") > 0), "findings")
    spans = F.coalesce("spans", F.array().cast(new.schema["spans"].dataType))
    rows = blobs.join(new, "blob", "left").select("blob", F.array_join("todo", ",").alias("rule_version"), spans.alias("spans"))
    facts = new
    if known is not None:
        old = known.filter(F.size("spans") > 0).select("blob", "spans")
        facts = new.unionByName(old).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return facts, rows


def scan(versions: DataFrame, *, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings by path, ledger rows of this run).

    ``ledger`` holds earlier runs' rows (``LEDGER_SCHEMA``); rows of other rule versions are ignored, rows held twice
    count once. Append the second result to it. Findings: ``path, blob, spans``, one row for each row of ``versions``;
    spans are sorted by start, ties by the rules' order.
    """
    narrow = versions.select(F.col(path).alias("path"), F.col(text).alias("text"))
    facts, rows = _facts(narrow, "path", "text", ledger, rules)
    none = F.array().cast(facts.schema["spans"].dataType)
    findings = narrow.select("path", F.sha2(text_or_empty("text"), 256).alias("blob")).join(facts, "blob", "left")
    return findings.select("path", "blob", F.coalesce("spans", none).alias("spans")), rows


def digest(findings: DataFrame) -> DataFrame:
    """The contract's columns from findings."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_KINDS))
    return findings.select(
        F.col("path").alias("doc_id"),
        *(count_of("spans", k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "blob",
    )


def redacted(docs: DataFrame, *, path: str = "doc_id", mark: str = "[secret]", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding replaced by ``mark`` and ``n_chars``, if there, counted anew; all rows and columns stay.

    Overlapping findings count as one. A null text stays null. Only rows that may hold a secret are joined to findings.
    """
    facts, _ = _facts(docs.select(F.col(path).alias("path"), F.col("text").alias("text")), "path", "text", ledger, rules)
    marked, blob, may = _marked(docs, "text", rules)
    spans, of = fresh(marked, "blob_spans"), fresh(marked, "blob_of")
    hot = marked.filter(F.size(may) > 0).join(facts.select(F.col("blob").alias(of), F.col("spans").alias(spans)), F.col(blob) == F.col(of), "left")
    body, hit = F.col("text"), F.col(spans).isNotNull()
    hot = hot.withColumn("text", F.when(hit, replaced(body, F.col(spans), lambda s: F.lit(mark))).otherwise(body))
    if "n_chars" in docs.columns:
        hot = hot.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return marked.filter(F.size(may) == 0).select(*docs.columns).unionByName(hot.select(*docs.columns))
