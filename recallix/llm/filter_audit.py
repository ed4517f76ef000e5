"""Interaction of filters: what each removes in each order, for every part of a corpus.

A document is reduced to a mask, one bit for each filter that it fails. Documents of one part and mask are one cell, so
that a corpus of any size is a few cells a part. Cells are unpivoted against the steps of all orders; a running bit-or
over the steps tells what an earlier filter has removed, conditional sums give a step's counts, and a filter's total
over a part's orders is a sum over a window.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, quoted

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Failure conditions of a text, by the filter's letter.
RULES = {
    "A": lambda x: F.size(x["words"]) < 50,
    "B": lambda x: 100 * F.size(F.array_distinct(x["words"])) < 65 * F.size(x["words"]),
    "C": lambda x: 100 * (F.length(x["text"]) - F.length(F.translate(x["text"], UPPER, ""))) > 5 * F.length(x["text"]),
    "D": lambda x: x["text"].rlike(r"[#$%&*|]"),
}
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_mask(text: Column, rules: dict = RULES) -> Column:
    """Bits of the rules, in their order, that a text fails; a null text counts as empty."""
    words = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = F.transform(F.array(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("text"), words(t).alias("words")))
    bits = lambda x: reduce(lambda a, b: a + b, [F.when(rule(x), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())])
    return F.get(F.transform(whole, bits), F.lit(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame, rules: dict = RULES, copies: bool = True, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and those labelled quality = 1 and toxic = 1.

    With copies the highest bit marks a text that a row with a smaller key has too; rows of one key do not mark each
    other, and a row without a key is marked by none and marks none. A null text counts as empty, a null part as the
    empty string, a missing label as none; of repeated labels of a key any counts. Repeated rows are counted each. Empty
    tables give none; further columns are left out.
    """
    text, key, part = (F.col(quoted(c)) for c in (text, key, part))
    rows = docs.select(key.alias("key"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), text_mask(text, rules).alias("mask"), *([F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest")] if copies else []))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.select(F.col("doc_id").alias("key"), "quality", "toxic").groupBy("key").agg(is_one("quality"), is_one("toxic"))
    if copies:
        # the key is part of both joins, so that no group of copies meets in one task
        rows = cut_lineage(rows)
        first = rows.where("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key"), F.lit(True).alias("first"))
        rows = rows.join(first, ["digest", "key"], "left")
        again = F.when(F.col("first").isNull() & F.col("key").isNotNull(), 1 << len(rules)).otherwise(0)
        rows = rows.withColumn("mask", F.col("mask") + again)
    rows = rows.join(marks, "key", "left")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def audit(found: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, counts of COUNTS, shapley) for every part of cells(), order of the filters and step.

    filters: their letters, in the order of the mask's bits; up to 7, as all orders are evaluated. All are bigint;
    shapley is what the step's filter removes, summed over all orders at any step. A part has one row for each order and
    step, zeros included.
    """
    if not 1 <= len(filters) <= 7 or len(set(filters)) != len(filters):
        raise ValueError("between 1 and 7 filters of different letters")
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    steps = found.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)]), letter)
    steps = steps.withColumn("filter", letter).withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    run = Window.partitionBy("part", "mask", "filter_order").orderBy("step")
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fails, late = F.col("fails") != 0, F.col("earlier") != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")
    sums = [count(~fails & ~late), count(fails & ~late), count(fails & late), count(F.col("mask") == F.col("bit")), count(fails & ~late, "good"), count(fails & ~late, "toxic")]
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(*[s.alias(c) for s, c in zip(sums, COUNTS, strict=True)])
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("bigint"))
    return out.select("part", "filter_order", "step", *COUNTS, "shapley")
