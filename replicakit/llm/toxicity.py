"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models of order ``ORDER`` (bytes of a lower-cased word, with marks for its start and
end) are learned from toxic and from ordinary labelled rows. Both back off to the same
lower orders, whose continuation counts (in how many different left contexts an n-gram
occurs) are gathered from every text of the corpus. Counts up to the discount are left
to the backoff, so rare expressions say the same in both models.

A text's figure is the length-normalised log-likelihood ratio of its words, taken over the
whole text and over its most suspect stretch of ``WINDOW`` words. A threshold learned on
labelled rows that the counts have not seen turns it into a score.

Every labelled row is used: by a digest of its identifier, four fifths of them are counted, and
the other fifth, which the counts have not seen, sets the threshold. The model is
the n-grams that a class has more often than the discount, with the sums of their contexts,
and the corpus's continuation counts for the contexts of these. It grows with the different
letter sequences in use, so its size is checked: up to ``MODEL_ROWS`` rows of either table it
is built on the driver and broadcast; beyond, it is built in parts and stays a table, from
which each shard of texts gets the entries of its own n-grams. Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from replicakit.llm.common import slices, stored, text_of
from replicakit.llm.tokens import LOWER, Tokens, tokens

ORDER = 6
DISCOUNT, SHARED_DISCOUNT = 4.0, 0.75
WINDOW = 2
#: Held-out figures to a part, on average, in the search for the threshold.
PART_FIGURES = 1_000_000
CHUNK = 1 << 20
#: Rows of a model's tables that the driver and each worker hold at most.
MODEL_ROWS = 2_000_000
#: N-grams to a part and bytes of text to a shard, on average, of a model that stays a table.
PART_GRAMS, SHARD_BYTES = 200_000, 8 << 20
START, END = np.uint64(2), np.uint64(1)

#: Columns of the maps of preceding symbols, 64 bits each.
LANES = ("seen0", "seen1", "seen2", "seen3")


@dataclass
class Words:
    """The different words of some texts and where they occur."""

    grams: np.ndarray    # uint64: the last ORDER symbols at each symbol, newest lowest
    bounds: np.ndarray   # first symbol of each word in grams, and the end
    which: np.ndarray    # per occurrence: the word
    doc: np.ndarray      # per occurrence: the text


def words_of(texts: list[bytes]) -> Words:
    raw, t = b" ".join(texts) + b" ", tokens(texts)
    buf = np.frombuffer(raw, np.uint8)
    start, size, hashes = t.start[t.word], t.size[t.word], t.hash[t.word]
    _, index, which = np.unique(hashes, return_index=True, return_inverse=True)
    start, size = start[index], size[index] + 1  # and the end mark
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    symbol = LOWER[buf[np.repeat(start, size) + place]].astype(np.uint64)
    symbol[bounds[1:] - 1] = END
    grams = symbol.copy()
    for i in range(1, ORDER):
        shifted = np.concatenate([np.full(min(i, len(symbol)), START), symbol[:-i]])
        grams |= np.where(place >= i, shifted, START) << np.uint64(8 * i)
    return Words(grams, bounds, which, t.doc[t.word])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, Words]]:
    for a, b in slices([len(t) for t in texts], CHUNK):
        yield a, b, words_of(texts[a:b])


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * n) - 1)


def class_counts(rows: DataFrame) -> DataFrame:
    """``rows`` (body, toxic) to (gram, toxic, ordinary): occurrences of each n-gram."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, toxic = [bytes(b) for b in batch["body"]], batch["toxic"].to_numpy(np.int64)
            for a, b, w in chunks(texts):
                n = len(w.bounds) - 1
                of = [np.bincount(w.which[toxic[a:b][w.doc] == k], minlength=n) for k in (1, 0)]
                size = np.diff(w.bounds)
                grams, inverse = np.unique(w.grams, return_inverse=True)
                yield pd.DataFrame({"gram": grams.view(np.int64)} | {
                    name: np.bincount(inverse, np.repeat(c, size), minlength=len(grams)).astype(np.int64)
                    for name, c in zip(("toxic", "ordinary"), of, strict=True)})

    return (rows.mapInPandas(count, "gram bigint, toxic bigint, ordinary bigint")
            .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))


def evidence(counts: DataFrame, above: float = DISCOUNT) -> DataFrame:
    """N-grams that a class has more than ``above`` times, with the sums of their context over
    all its n-grams: of the counts (``_all``) and of what the discount takes (``_held``). An
    n-gram at the discount or below in both classes has its context's weight as its ratio, and
    a context with only such ones weighs the same in both, so leaving them out loses nothing."""
    context = W.partitionBy(F.shiftright("gram", 8))
    sums = [F.sum(x).over(context).cast("double").alias(f"{c}_{name}") for c in ("toxic", "ordinary")
            for name, x in (("all", F.col(c)), ("held", F.least(F.col(c).cast("double"), F.lit(DISCOUNT))))]
    return counts.select("gram", "toxic", "ordinary", *sums).filter(F.greatest("toxic", "ordinary") > above)


def contexts(grams: np.ndarray) -> dict[int, np.ndarray]:
    """For each order below ORDER, the contexts (sorted) that backing off from ``grams`` meets."""
    return {n: np.unique(_low(grams >> np.uint64(8), n - 1)) for n in range(1, ORDER)}


def context_rows(seen: DataFrame, *keep: Column) -> DataFrame:
    """``contexts`` as rows (``keep``, n, context), each once."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))
                              .alias("context")) for n in range(1, ORDER)])
    return seen.select(*keep, F.explode(each).alias("x")).select(*seen.select(*keep).columns, "x.n", "x.context").distinct()


def continuation_counts(texts: DataFrame, wanted: dict[int, np.ndarray] | DataFrame) -> DataFrame:
    """(n, gram, count): how many different symbols precede each n-gram in the corpus; only
    n-grams with a context in ``wanted`` (``contexts``, or ``context_rows`` of any size). The symbols
    are bytes, so a map of 256 bits (four ``LANES``) tells them all apart and maps of tasks combine by
    a bitwise or."""
    listed = wanted if isinstance(wanted, dict) else dict.fromkeys(range(1, ORDER))
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def fold(n: int, keys: np.ndarray, maps: np.ndarray) -> None:
            order = np.argsort(keys, kind="stable")
            keys, maps = keys[order], maps[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys.astype(np.int64)
            held[n] = (keys[first], np.bitwise_or.reduceat(maps, first, axis=0) if len(keys) else maps)

        for batch in batches:
            for _, _, w in chunks([bytes(b) for b in batch["body"]]):
                for n, known in shared.value.items():
                    if known is not None and not len(known):
                        continue
                    grams = np.unique(_low(w.grams, n + 1))
                    if known is not None and n > 1:
                        context = _low(grams >> np.uint64(8), n - 1)
                        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
                        grams = grams[known[at] == context]
                    left = grams >> np.uint64(8 * n)
                    maps = np.zeros((len(grams), len(LANES)), np.uint64)
                    maps[np.arange(len(grams)), (left >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (left & np.uint64(63))
                    old = held.get(n, (grams[:0], maps[:0]))
                    fold(n, np.append(old[0], _low(grams, n)), np.concatenate([old[1], maps]))
        for n, (keys, maps) in held.items():
            for a in range(0, len(keys), 100_000):
                part = maps[a:a + 100_000].view(np.int64)
                yield pd.DataFrame({"n": n, "gram": keys[a:a + 100_000].view(np.int64)}
                                   | {lane: part[:, i] for i, lane in enumerate(LANES)})

    schema = ", ".join(["n int", "gram bigint", *[f"{lane} bigint" for lane in LANES]])
    count = sum((F.bit_count(F.bit_or(lane)) for lane in LANES), F.lit(0))
    counted = texts.mapInPandas(gather, schema).groupBy("n", "gram").agg(count.alias("count"))
    if isinstance(wanted, dict):
        return counted
    return (counted.withColumn("context", F.shiftright("gram", 8))
            .join(wanted.select("n", "context").distinct(), ["n", "context"], "left_semi").drop("context"))


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, the sum of their values and how many there are."""
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, values, minlength=len(found)), np.bincount(inverse, minlength=len(found))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


@dataclass
class Model:
    """Log ratios: of n-grams seen with a label, and of the backoff weights of contexts."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def build(seen: pd.DataFrame, shared: pd.DataFrame) -> Model:
    """The model of ``evidence`` and of the continuation counts for its contexts."""
    seen = seen.sort_values("gram")
    grams = seen["gram"].to_numpy(np.int64).view(np.uint64)
    p = np.full(len(grams), 1 / 256)
    for n in range(1, ORDER):
        part = shared[shared["n"] == n].sort_values("gram")
        keys = part["gram"].to_numpy(np.int64).view(np.uint64)
        keys, value = keys[np.argsort(keys)], part["count"].to_numpy(float)[np.argsort(keys)]
        ctx, total, kinds = _sums(keys >> np.uint64(8), value)
        own, context = _low(grams, n), _low(grams >> np.uint64(8), n - 1)
        c, t, k = _at(keys, value, own), _at(ctx, total, context), _at(ctx, kinds, context)
        known = t > 0
        safe = np.where(known, t, 1)
        p = np.where(known, np.maximum(c - SHARED_DISCOUNT, 0) / safe + SHARED_DISCOUNT * k / safe * p, p)
    logs, weights = [], []
    ctx, first, where = np.unique(grams >> np.uint64(8), return_index=True, return_inverse=True)
    for name in ("toxic", "ordinary"):
        c = seen[name].to_numpy(float)
        total, held = (seen[f"{name}_{x}"].to_numpy(float)[first] for x in ("all", "held"))
        back = np.where(total > 0, held / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[where] + back[where] * p))
        weights.append(np.log(back))
    return Model(grams, logs[0] - logs[1], ctx, weights[0] - weights[1])


@dataclass
class TableModel:
    """A ``Model`` of any size, as rows (context, key, value): ``context`` tells weights of
    contexts from ratios of n-grams."""

    rows: DataFrame


def build_table(seen: DataFrame, shared: DataFrame, parts: int) -> TableModel:
    """``build`` in ``parts``: n-grams of one context (256 at most) share a part, which gets the
    counts of the contexts it backs off to."""
    part = F.pmod(F.xxhash64(F.shiftright("gram", 8)), F.lit(parts)).alias("part")
    counts = (shared.withColumn("context", F.shiftright("gram", 8))
              .join(context_rows(seen, part), ["n", "context"]).select("part", "n", "gram", "count"))

    def make(own: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        m = build(own, counts)
        return pd.DataFrame({"context": np.repeat([False, True], [len(m.grams), len(m.contexts)]),
                             "key": np.append(m.grams, m.contexts).view(np.int64),
                             "value": np.append(m.ratios, m.weights)})

    rows = (seen.withColumn("part", part).groupBy("part").cogroup(counts.groupBy("part"))
            .applyInPandas(make, "context boolean, key bigint, value double"))
    return TableModel(stored(rows, "toxicity-model"))


def measured(texts: DataFrame, model: Model | TableModel, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``texts`` (body, others) with ``figure``, the sum of both figures, in place of ``body``.

    With a table the rows are numbered and written, so that their shards stay the same if a task
    runs again; repeated rows spread like others. A shard asks for each of its n-grams and contexts
    once and gets those that the model has; an n-gram that all shards ask for is one row a shard, in
    a join that adaptive execution splits."""
    keep = [c for c in texts.columns if c != "body"]
    types = [texts.schema[c].dataType for c in keep]
    # Pandas would make floats of whole numbers beside nulls, so the other columns travel as strings.
    texts = texts.select(*[F.col(c).cast("string").alias(c) for c in keep], "body")
    schema = StructType([texts.schema[c] for c in keep]).add("figure", "double")
    typed = [F.col(c).cast(t).alias(c) for c, t in zip(keep, types, strict=True)]

    def with_figures(rows: pd.DataFrame, held: Model) -> pd.DataFrame:
        f = figures([bytes(b) for b in rows["body"]], held)
        return rows[keep].assign(figure=f[:, 0] + f[:, 1])

    if isinstance(model, Model):
        sent = texts.sparkSession.sparkContext.broadcast(model)
        return texts.mapInPandas(lambda batches: (with_figures(b, sent.value) for b in batches),
                                  schema).select(*typed, "figure")

    rows = stored(texts.withColumn("_row", F.monotonically_increasing_id()), "toxicity-texts")
    total = rows.agg(F.sum(F.octet_length("body")).alias("b")).first()["b"] or 0
    shards = rows.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(total // shard_bytes + 1))).drop("_row")

    def ask(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        grams = [np.unique(w.grams) for _, _, w in chunks([bytes(b) for b in own["body"]])]
        grams = np.unique(np.concatenate(grams))
        context = np.unique(grams >> np.uint64(8))
        return pd.DataFrame({"_shard": key[0], "context": np.repeat([False, True], [len(grams), len(context)]),
                             "key": np.append(grams, context).view(np.int64)})

    asked = shards.select("_shard", "body").groupBy("_shard").applyInPandas(ask, "_shard bigint, context boolean, key bigint")
    found = stored(asked.join(model.rows, ["context", "key"]), "toxicity-found")

    def answer(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({c: [] for c in schema.names})
        found = found.sort_values("key")
        parts = [(x["key"].to_numpy(np.int64).view(np.uint64), x["value"].to_numpy(float))
                 for x in (found[~found["context"].astype(bool)], found[found["context"].astype(bool)])]
        return with_figures(own, Model(*parts[0], *parts[1]))

    return shards.groupBy("_shard").cogroup(found.groupBy("_shard")).applyInPandas(answer, schema).select(*typed, "figure")


def figures(texts: list[bytes], model: Model) -> np.ndarray:
    """Per text: the mean log ratio of its words, and that of its most suspect stretch; zeros
    for texts without words."""
    out = np.zeros((len(texts), 2))
    for a, b, w in chunks(texts):
        if not len(w.which):
            continue
        context = w.grams >> np.uint64(8)
        value = _at(model.grams, model.ratios, w.grams, np.nan)
        value = np.where(np.isnan(value), _at(model.contexts, model.weights, context), value)
        ratio = np.add.reduceat(value, w.bounds[:-1])[w.which]
        run = np.concatenate([np.zeros(1), np.cumsum(ratio)])
        first = np.searchsorted(w.doc, np.arange(b - a + 1))
        index = np.arange(len(ratio))
        begin = np.maximum(first[w.doc], index + 1 - WINDOW)
        stretch = (run[index + 1] - run[begin]) / WINDOW
        filled = np.flatnonzero(first[1:] > first[:-1])
        out[a + filled, 0] = (run[first[1:]] - run[first[:-1]])[filled] / (first[1:] - first[:-1])[filled]
        out[a + filled, 1] = np.maximum.reduceat(stretch, first[:-1][filled])
    return out


def threshold(figures: DataFrame, part_figures: int = PART_FIGURES) -> float:
    """The figure of ``figures`` (figure, n, toxic: each figure once, with its rows and toxic rows)
    that parts the labels with the best F1, halfway to the next lower one; of equal F1, the highest.

    Rows above a figure are counted within ranges of figures; only a range's sums reach the
    driver."""
    total = figures.agg(F.count(F.lit(1)).alias("figures"), F.sum("toxic").alias("toxic")).first()
    ranges = total["figures"] // part_figures + 1
    ranged = stored(figures.repartitionByRange(ranges, F.desc("figure")).withColumn("part", F.spark_partition_id()),
                    "toxicity-figures")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).orderBy("part").collect()
    above, before = {}, (0, 0)
    for r in sums:
        above[r["part"]] = before
        before = (before[0] + r["n"], before[1] + r["toxic"])
    starts = figures.sparkSession.createDataFrame([(p, *x) for p, x in above.items()],
                                                  "part int, n_above bigint, toxic_above bigint")
    down = W.partitionBy("part").orderBy(F.desc("figure")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows, hits = F.col("n_above") + F.sum("n").over(down), F.col("toxic_above") + F.sum("toxic").over(down)
    f1 = 2 * hits.cast("double") / (rows + F.lit(max(1, total["toxic"])))
    best = ranged.join(F.broadcast(starts), "part").select("figure", f1.alias("f1")).agg(
        F.max(F.struct("f1", "figure")).alias("m")).first()["m"]["figure"]
    below = ranged.filter(F.col("figure") < F.lit(best)).agg(F.max("figure").alias("m")).first()["m"]
    return (best + (best if below is None else below)) / 2


@dataclass
class Scorer:
    model: Model | TableModel
    middle: float
    scale: float
    least: float = 0.7

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        f = figures(texts, self.model)
        x = (f[:, 1] + f[:, 0] - self.middle) / self.scale + np.log(self.least / (1 - self.least))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", sample: int | None = None, least: float = 0.7,
          model_rows: int = MODEL_ROWS) -> Scorer:
    """``labels`` holds the rows to learn from; rows with a null label or identifier are passed
    over, of repeated labels of an identifier the largest counts, and of different texts the
    smallest. Every fifth row, by a digest of its identifier, is left out of the counts and sets
    the threshold; all others are counted. A caller may have only the ``sample`` smallest digests
    give rows for the threshold; by default all do. Without labelled texts all scores are low. A
    model with more than ``model_rows`` n-grams, or continuation counts, stays a table."""
    given = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic")))
    apart = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(5)) == 0
    if sample is not None:
        last = given.select(F.xxhash64("id").alias("d")).orderBy("d").limit(sample).agg(F.max("d").alias("d")).first()["d"]
        apart = apart & F.coalesce(F.xxhash64("id") <= F.lit(last).cast("bigint"), F.lit(False))
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).cast("binary").alias("body"))
    # One row per identifier, combined map-side before any join by it: repeats of one grow no task.
    labelled = lambda which: (texts.filter(which).groupBy("id").agg(F.min("body").alias("body"))
                              .join(given.filter(which), "id"))
    rows = labelled(~apart)
    seen = stored(evidence(class_counts(rows.select("body", "toxic"))), "toxicity-evidence")
    n_seen = seen.count()
    fits = n_seen <= model_rows
    held = seen.toPandas() if fits else None
    wanted = contexts(held["gram"].to_numpy(np.int64).view(np.uint64)) if fits else context_rows(seen)
    shared = stored(continuation_counts(texts.select("body"), wanted), "toxicity-continuations")
    fits = fits and shared.count() <= model_rows
    model = build(held, shared.toPandas()) if fits else build_table(seen, shared, n_seen // PART_GRAMS + 1)
    found = stored(measured(labelled(apart).select("body", "toxic"), model), "toxicity-held-out")
    whole = found.agg(F.sum("toxic").alias("toxic"), F.max("figure").alias("most"), F.stddev_pop("figure").alias("spread")).first()
    if not whole["toxic"]:
        return Scorer(model, np.inf if whole["most"] is None else whole["most"] + 1, 1.0, least)
    each = found.groupBy("figure").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    return Scorer(model, threshold(each), max(1e-3, whole["spread"] / 4), least)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``score`` (0 to 1).

    The score depends on the text only. Null, empty and blank texts have the figure zero; an
    empty table gives no rows; repeated rows score alike; extra columns are ignored. There is
    no shuffle while the model is broadcast; with a table the texts are written once and
    shuffled twice.
    """
    text = text_of(docs, text_col)
    if isinstance(scorer.model, Model):
        return docs.select(docs[id_col].alias("doc_id"), score_column(docs, scorer, text).alias("score"))
    rows = measured(docs.select(docs[id_col].alias("doc_id"), text.cast("binary").alias("body")), scorer.model)
    x = (F.col("figure") - F.lit(scorer.middle)) / F.lit(scorer.scale) + F.lit(float(np.log(scorer.least / (1 - scorer.least))))
    return rows.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))).alias("score"))


def score_column(docs: DataFrame, scorer, text: Column) -> Column:
    """The score as a column: only the text travels to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def run(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in bodies:
            yield pd.Series(shared.value([bytes(b) for b in batch]))

    return run(text.cast("binary"))
