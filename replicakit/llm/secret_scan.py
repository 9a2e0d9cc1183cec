"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the digest of its content (a blob). The
ledger is a folder of Parquet batches with one row per blob and rule version that has
been scanned, and the spans found. A run scans only pairs of blob and rule version the
ledger does not hold, appends them, and joins the findings back to all paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm.common import stored, text_of
from replicakit.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` is shorter than ``least`` are dropped.
    ``cue``: a literal that every match holds, to pass over texts without it."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    cue: str | None = None


#: Fixed by the contract. Maximal runs of a class that must have n characters are written
#: as {n,}: shorter runs match nowhere inside, so the same spans result.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", cue="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)

LEDGER_SCHEMA = ("blob string, kind string, version int, "
                 "spans array<struct<start:bigint,end:bigint>>")


def _lengths(items: Column) -> Column:
    return F.transform(items, lambda x: F.length(x))


def _matches(rule: Rule, text: Column, wanted: Column) -> Column:
    """Per match, in order: characters since the match before it, its length and its
    group's length. The text between matches is what ``split`` leaves."""
    p = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        _lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        _lengths(F.regexp_extract_all(text, p, F.lit(0))).alias("len"),
        _lengths(F.regexp_extract_all(text, p, F.lit(rule.group))).alias("inner"))
    if rule.cue:
        wanted = wanted & F.contains(text, F.lit(rule.cue))
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
                    F.when(wanted, zipped).alias("found"))


def _ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_unseen(blobs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan the ``blobs`` (blob, body) for those rule versions the ledger lacks, append the
    results and return the whole ledger. Blobs without findings are recorded too."""
    spark = blobs.sparkSession
    seen = _ledger(spark, ledger)
    key = lambda r: F.lit(f"{r.kind}/{r.version}")
    if seen is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        done = seen.groupBy("blob").agg(
            F.collect_set(F.concat_ws("/", "kind", "version")).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn(
            "done", F.coalesce("done", F.array().cast("array<string>")))
        todo = todo.filter(~F.forall(F.array(*[key(r) for r in rules]),
                                     lambda k: F.array_contains(F.col("done"), k)))
    unseen = {r.kind: ~F.array_contains(F.col("done"), key(r)) for r in rules}
    found = todo.select("blob", F.explode(F.filter(F.array(*[
        F.struct(unseen[r.kind].alias("unseen"), _matches(r, F.col("body"), unseen[r.kind]).alias("m"))
        for r in rules]), lambda x: x["unseen"])).alias("x"))
    hits = found.select("blob", "x.m.kind", "x.m.version", F.posexplode_outer("x.m.found").alias("i", "hit"))
    before = W.partitionBy("blob", "kind", "version").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("hit.gap") + F.col("hit.len")).over(before).cast("bigint")
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    spans = hits.withColumn("end", end).withColumn("span", F.when(
        F.col("hit.len").isNotNull() & (F.col("hit.inner") >= least[F.col("kind")]),
        F.struct((F.col("end") - F.col("hit.len")).alias("start"), F.col("end").alias("end"))))
    batch = spans.groupBy("blob", "kind", "version").agg(
        F.sort_array(F.collect_list("span")).alias("spans"))
    batch.write.mode("append").parquet(ledger)
    return _ledger(spark, ledger)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``blob`` (lowercase hex SHA-256 of the text)
    and ``spans``, an array of (start, rule number, kind, end) in that order; positions are
    code points, ends exclusive.

    ``ledger`` is a folder to keep between runs; without it a fresh one below the cluster's
    scratch folder is used. Null texts count as empty; empty texts, empty tables and null or
    repeated identifiers give rows without further ado; extra columns are ignored.
    """
    ledger = ledger or scratch_path(docs.sparkSession, "secret-ledger")
    body = text_of(docs, text_col)
    paths = docs.select(docs[id_col].alias("doc_id"), body.alias("body")).withColumn(
        "blob", F.sha2("body", 256))
    ids = stored(paths.drop("body"), "secret-paths")
    # Equal contents meet before the shuffle (map side) and after it.
    blobs = paths.groupBy("blob").agg(F.first("body").alias("body"))
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    wanted = F.concat_ws("/", "kind", "version").isin([f"{r.kind}/{r.version}" for r in rules])
    # Of the history only blobs of this table, and one row per pair, however often it was appended.
    found = (scan_unseen(blobs, ledger, rules).filter(wanted & (F.size("spans") > 0))
             .join(ids.select("blob").distinct(), "blob", "left_semi")
             .groupBy("blob", "kind", "version").agg(F.max("spans").alias("spans")))
    findings = found.select("blob", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), number[F.col("kind")].alias("rule"),
        F.col("kind").alias("kind"), s["end"].alias("end"))).alias("spans")).groupBy("blob").agg(
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Both sides are written tables, so a blob of very many paths splits in the join.
    findings = stored(findings, "secret-findings")
    empty = F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")
    return ids.join(findings, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
