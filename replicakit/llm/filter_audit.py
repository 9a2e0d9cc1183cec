"""How much each of several filters removes, alone and in every order, with Shapley values.

The removal game gives every coalition of filters the number of documents that fail any of
them. Its Hart-Mas-Colell potential follows recursively, P(S) = (v(S) + sum of P(S without i))
/ |S|, and a filter's Shapley value is the grand potential minus the potential without that
filter. What a filter removes at a step of an order is the difference of two coalitions.

Documents are only ever counted: each becomes a bit mask of the filters it fails, copies of a
text are aggregated map-side under its digest, and a part ends as one row per mask, 2 ** n at
most, before any coalition is looked at. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm.common import stored, text_of

#: The filter that removes copies of a text under a smaller identifier.
COPIES = "E"

AUDIT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
         "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def conditions(text: Column) -> dict[str, Column]:
    """When a text fails: A few words, B repeated words, C capitals, D symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
            "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def potentials(worth: Sequence[int]) -> list[int]:
    """Potential of every coalition (a bit mask), times the factorial of its size, which keeps
    it whole: Q(S) = (|S| - 1)! v(S) + the sum of Q(S without i)."""
    out = [0] * len(worth)
    for s in range(1, len(worth)):
        inside = [s ^ 1 << i for i in range(s.bit_length()) if s >> i & 1]
        out[s] = factorial(len(inside) - 1) * worth[s] + sum(out[r] for r in inside)
    return out


def shapley_totals(worth: Sequence[int], n: int) -> list[int]:
    """Per filter, its Shapley value times n!: what it removes, summed over all orders."""
    p, grand = potentials(worth), (1 << n) - 1
    return [p[grand] - n * p[grand ^ 1 << i] for i in range(n)]


def _audit(names: str):
    def run(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        n = len(names)
        rows = list(zip(masks["mask"].tolist(), masks["n"].tolist(), masks["good"].tolist(), masks["toxic"].tolist(),
                        strict=True))
        total = sum(r[1] for r in rows)
        worth, good, toxic = ([sum(r[c] for r in rows if r[0] & s) for s in range(1 << n)] for c in (1, 2, 3))
        shapley, grand = shapley_totals(worth, n), (1 << n) - 1
        out = []
        for order in permutations(range(n)):
            before = 0
            for step, i in enumerate(order, 1):
                s = before | 1 << i
                removed = worth[s] - worth[before]
                out.append((key[0], "".join(names[j] for j in order), step, total - worth[s], removed,
                            worth[1 << i] - removed, worth[grand] - worth[grand ^ 1 << i],
                            good[s] - good[before], toxic[s] - toxic[before], shapley[i]))
                before = s
        return pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])
    return run


def audit_filters(docs: DataFrame, labels: DataFrame, tests: Callable[[Column], Mapping[str, Column]] = conditions,
                  copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """One row per part (value of ``part_col``; null counts as ''), order of the filters and
    step: documents ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its
    filter, removed earlier), ``unique_fails`` (failing its filter only), ``good_lost`` and
    ``toxic_lost`` (removed, labelled quality 1 or toxic 1) and ``shapley`` (removed by its
    filter, summed over all orders).

    ``tests`` gives failure conditions by one-letter names; ``copies`` names the filter that
    fails rows whose text some smaller identifier has, anywhere in the table. Texts are equal
    when their SHA-256 is. A null text counts as empty. Rows with a null identifier are counted
    but neither fail as copies nor make others copies; they have no labels. Rows that repeat
    an identifier and its text count each, and none of them is a copy of the others. Where an
    identifier is labelled more than once, any 1 counts. An empty table gives no rows; extra
    columns are ignored.
    """
    text = text_of(docs, text_col)
    found = tests(text)
    names = "".join([*found, copies])
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found.values())), F.lit(0))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                       mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rated = stored(labels.groupBy(labels["doc_id"].alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "audit-labels")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = rows.join(rated, rows.doc_id == rated.l_id, "left").select(
        "doc_id", "digest", "part", "mask", flag("good"), flag("toxic"))
    # Rows of one identifier first, so that the rows of a text's smallest one can be told.
    kinds = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    texts = ids.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.isnull("doc_id"), F.col("n")).otherwise(0)).alias("n_null"))
    # A digest has few rows now: one per part, mask and label.
    first = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    later = F.col("n") - F.col("n_null") - F.when(first, F.col("n_least")).otherwise(0)
    bit = 1 << len(found)
    cases = F.array(F.struct((F.col("mask") + bit).alias("mask"), F.col("later").alias("n")),
                    F.struct(F.col("mask"), (F.col("n") - F.col("later")).alias("n")))
    masks = (texts.withColumn("later", later).select("part", "good", "toxic", F.explode(cases).alias("c"))
             .groupBy("part", F.col("c.mask").alias("mask"))
             .agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"),
                  F.sum(F.col("c.n") * F.col("toxic")).alias("toxic")))
    return masks.groupBy("part").applyInPandas(_audit(names), AUDIT)
