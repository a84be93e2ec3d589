"""How several filters share what they remove, in every order of applying them; DataFrame functions only.

A document is the set of the filters it fails, a number of one bit per filter. What a set of filters removes from a
part is its removal polynomial at a corner: R(x) is the sum over the part's documents of 1 - prod(1 - x_f), f over the
filters that the document fails, multilinear in the x_f. Its coefficient of a set S of filters is, with alternating
signs, the number of documents that fail all of S. So a part needs its counts by failed set once, whatever the orders:

- the documents that S removes are R at the corner of S, a sum of coefficients over the subsets of S;
- a filter's Shapley value is the integral of dR/dx_f along the diagonal, the sum of its coefficients over |S|.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.tables import checkpointed

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_BETWEEN = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: str) -> Column:
    """The bits of the filters A to D that the text (not null) fails: too few words, repeated words, capitals, marks."""
    words = F.array_remove(F.split(text, _BETWEEN), "")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, _UPPER, ""))
    fails = (
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        F.col(text).rlike(r"[#$%&*|]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each source by the set of filters they fail.

    A text's digest stands for the text. Of the rows with one text those of the smallest doc_id pass E, all of them if
    the id repeats; a null id neither fails E nor makes others fail it. Texts are read once; what is joined are rows of
    fixed width, by digest and doc_id together, so a text with very many copies is dealt over all tasks.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = checkpointed(texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures("text").alias("mask")))
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = rows.join(first, ["digest", "doc_id"], "left").join(known.where("good OR toxic"), "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), COPY).otherwise(0)
    ones = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return joined.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), ones("good").alias("good"), ones("toxic").alias("toxic"))


def _total(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: total + term(v))


def _subsets(k: int) -> Column:
    return F.sequence(F.lit(0), F.lit((1 << k) - 1))


def polynomial(cells: str, weight: str, k: int) -> Column:
    """The coefficients of the removal polynomial by number of the subset, of ``cells`` array<struct<mask, ...>>."""
    failing_all = lambda s: _total(F.filter(cells, lambda c: c["mask"].bitwiseAND(s) == s), lambda c: c[weight])
    sign = lambda s: F.when(F.bit_count(s) % 2 == 1, 1).otherwise(-1)
    return F.transform(_subsets(k), lambda s: F.when(s == 0, F.lit(0).cast("long")).otherwise(sign(s) * failing_all(s)))


def corners(coefficients: str, k: int) -> Column:
    """The polynomial's value at every corner, by number of the subset whose variables are 1."""
    inside = lambda corner: _total(F.filter(_subsets(k), lambda s: s.bitwiseAND(corner) == s), lambda s: F.get(F.col(coefficients), s))
    return F.transform(_subsets(k), inside)


def shapley(coefficients: str, k: int) -> Column:
    """k! times each filter's Shapley value. The integral of t^(|S| - 1) is 1 / |S|; all are over one denominator, lcm(1..k)."""
    denominator = math.lcm(*range(1, k + 1))
    parts = F.array(*(F.lit(denominator // n if n else 0).cast("long") for n in range(k + 1)))  # 1 / n over the denominator
    scaled = lambda bit: _total(F.filter(_subsets(k), lambda s: s.bitwiseAND(bit) != 0), lambda s: F.get(F.col(coefficients), s) * F.get(parts, F.bit_count(s)))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: scaled(F.call_function("shiftleft", F.lit(1), f)) * (math.factorial(k) // denominator))


def audit(sets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, zeros included, of ``sets`` (part, mask, n, good, toxic).

    kept: documents after the step; removed: by it; redundant: those that fail its filter and went before;
    unique_fails: those that fail its filter only; good_lost and toxic_lost: of the removed; shapley: the filter's
    removed, summed over all orders. A part has at most 2^k sets, gathered in one row. No part, no rows.
    """
    k, every = len(filters), (1 << len(filters)) - 1
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    known = F.struct(_total(F.col("cells"), lambda c: c["n"]).alias("size"), *(polynomial("cells", w, k).alias(w) for w in ("n", "good", "toxic")))
    # generated, so that the coefficients are worked out once and not inside the lambdas that read them
    parts = parts.select("part", F.explode(F.array(known)).alias("p"))
    parts = parts.select("part", "p.size", shapley("p.n", k).alias("shares"), *(corners(f"p.{w}", k).alias(w) for w in ("n", "good", "toxic")))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    number = f"locate(substring(filter_order, {{}}, 1), '{filters}') - 1"
    steps = steps.withColumn("filter", F.expr(number.format("step"))).withColumn("bit", F.expr("shiftleft(1, filter)"))
    before = F.expr(f"aggregate(sequence(1, {k}), 0, (m, j) -> m + if(j < step, shiftleft(1, {number.format('j')}), 0))")
    steps = steps.withColumn("before", before).withColumn("after", F.col("before") + F.col("bit"))
    at = lambda values, corner: F.get(F.col(values), corner)
    gone = lambda w: at(w, F.col("after")) - at(w, F.col("before"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("size") - at("n", F.col("after"))).alias("kept"),
        gone("n").alias("removed"),
        (at("n", F.col("bit")) - gone("n")).alias("redundant"),
        (at("n", F.lit(every)) - at("n", F.lit(every) - F.col("bit"))).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.get(F.col("shares"), F.col("filter")).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole ``docs`` (doc_id, source, text), with ``labels`` (doc_id, quality, toxic).

    A null text is empty, a null source the part ''. A document is good, or toxic, if any of its label rows says 1.
    Repeated rows are documents each. Extra columns are ignored. An empty table gives no rows.
    """
    return audit(failed_sets(docs.select("doc_id", "source", "text"), labels.select("doc_id", "quality", "toxic")))
