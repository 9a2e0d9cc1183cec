"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words: its weight's share of all words, at most
``most`` times its own size, the excess reshared by weight. A target is met by whole
epochs of the source first; what remains selects documents in the order of their
exponential keys ``-ln(u) / quality`` until the prefix sum of sizes reaches the budget,
the last one in part. ``u`` comes from a digest of seed and identifier, so reruns agree.

Nothing orders a whole source in one task. Given its quality a key is exponential, so the
qualities of a source (counted in narrow classes) give the distribution of its keys, and cuts
at equal shares of that give even buckets, whatever the mixture of qualities. Bucket sums give
each bucket's offset, over runs of buckets first and then within a run; only rows of one
bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm.common import SPACES, stored, text_of, word_count

#: ASCII digits and punctuation, in code point order.
JUNK = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


#: Classes of quality per e-fold, and buckets of a run.
QUALITY_CLASSES, RUN_CELLS = 16, 4096


def text_quality(text: Column) -> Column:
    """Quality weight of a document: the share of its non-space characters that are neither
    ASCII digits nor ASCII punctuation, 0.05 at least (also for empty texts)."""
    solid = F.length(F.translate(text, SPACES, ""))
    plain = F.length(F.translate(text, SPACES + JUNK, ""))
    return F.when(solid > 0, F.greatest(F.lit(0.05), plain / solid)).otherwise(F.lit(0.05))


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest; a null id counts as ''."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Consecutive numbers ``n`` from 1 in ``order``: range partitions are sorted and counted
    by themselves; only one count per partition is summed over all."""
    cols = df.columns
    parts = stored(df.repartitionByRange(*order).select(*cols, F.spark_partition_id().alias("part")), "numbered")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("part").orderBy(*order)
    return parts.withColumn("k", F.row_number().over(within)).join(offsets, "part").select(
        *cols, (F.col("k") + F.col("offset")).alias("n"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``: sources in code point order,
    null last, weigh ``weights`` in turn. Each round of the loop collects two sums."""
    ranked = _numbered(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight), "sources")
    cap = (F.col("source_size") * most).cast("double")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    words, parts, capped = total, None, -1
    while True:
        # As bigint: below 2^31 the literal would be an int, and its product with a weight overflow.
        share = None if parts is None else (
            F.lit(words).cast("bigint") * F.col("weight")).cast("double") / F.lit(parts).cast("double")
        over = F.lit(False) if share is None else share > cap
        row = ranked.agg(F.sum(F.when(over, F.col("source_size") * most).otherwise(0)).alias("held"),
                         F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("parts"),
                         F.sum(over.cast("int")).alias("capped")).first()
        if not row["parts"] or row["capped"] == capped:
            break
        words, parts, capped = total - row["held"], row["parts"], row["capped"]
    target = cap if share is None else F.least(share, cap)
    return ranked.withColumn("target", target).drop("n", "weight")


def _placed(base: DataFrame, known: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows with their source's plan and their bucket (``cell``): equal shares of its keys."""
    # The share of the source's keys below a row's: 1 - exp(-w key), over its classes of quality w.
    below = F.aggregate("kinds", F.lit(0.0), lambda a, k: a + k["n"] * (1 - F.exp(-k["w"] * F.col("key")))) / F.col("rows")
    cells = F.ceil(F.col("rows") / bucket_rows)
    cell = F.least(F.floor(below * cells), cells - 1)
    return base.join(known, base.source.eqNullSafe(known.s)).select(
        "sid", cell.alias("cell"), *[c for c in base.columns if c not in ("source", "weight")],
        "source_size", "target", "epochs", "rest")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix",
        quality: Callable[[Column], Column] = text_quality, bucket_rows: int = 2000,
        carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size`` (words), ``source_size``, ``target``
    (of its source), ``taken`` (words the mix takes, repeats counted) and, with ``carry``,
    ``row`` (a struct of these columns).

    Null texts and empty texts have size 0 and are taken 0 times. A null source is a source
    of its own, the last one. Ties of keys (repeated identifiers) go by identifier and size;
    identical rows are interchangeable. An empty table gives no rows; extra columns are
    ignored. ``bucket_rows`` is the mean number of rows sorted together.
    """
    text = text_of(docs, text_col)
    base = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
                       word_count(text).alias("size"), quality(text).alias("weight"),
                       (-F.log(uniform(docs[id_col], seed))).alias("key"),
                       *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []))
    base = stored(base.withColumn("key", F.col("key") / F.col("weight")), "mix")
    kinds = base.groupBy("source", F.round(F.log("weight") * QUALITY_CLASSES).alias("kind")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w"))
    sizes = kinds.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("rows"),
                                        F.collect_list(F.struct("w", "n")).alias("kinds"))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    plan = stored(source_targets(sizes, weights, most).withColumn("budget", budget).withColumn("epochs", epochs)
                  .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
                  .withColumn("sid", F.monotonically_increasing_id()), "mix-plan")
    placed = _placed(base, plan.withColumnRenamed("source", "s"), bucket_rows)
    run = F.floor(F.col("cell") / RUN_CELLS).alias("run")
    sums = stored(placed.groupBy("sid", run, "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    earlier = W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = sums.groupBy("sid", "run").agg(F.sum("cell_size").alias("run_size")).select(
        "sid", "run", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("run_offset"))
    before = W.partitionBy("sid", "run").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.join(runs, ["sid", "run"]).select(
        "sid", "cell", (F.col("run_offset") + F.coalesce(F.sum("cell_size").over(before), F.lit(0))).alias("offset"))
    within = W.partitionBy("sid", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(offsets, ["sid", "cell"]).withColumn(
        "start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return placed.select("doc_id", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + last).cast("bigint").alias("taken"),
                      *(["row"] if carry else []))


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, from ``mix(..., carry=columns)``: a row per whole copy, and one with
    the first words (joined by single spaces) where a document is taken in part."""
    whole = F.expr("taken div size")
    part = F.col("taken") - whole * F.col("size")
    sizes = F.concat(F.array_repeat(F.col("size"), whole.cast("int")),
                     F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.filter(F.col("taken") > 0).select("row", "size", F.explode(sizes).alias("words"))
    joined = F.trim(F.regexp_replace(F.col(f"row.{text_col}"), r"[\x20\x09-\x0D]+", " "))
    text = F.when(F.col("words") < F.col("size"), F.expr("substring_index(joined, ' ', cast(words as int))")) \
        .otherwise(F.col(f"row.{text_col}"))
    names = mixed.schema["row"].dataType.fieldNames()
    return rows.withColumn("joined", joined).select(
        *[text.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in names])
