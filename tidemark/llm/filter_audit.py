"""How text filters interact: what each removes in every order, what it alone removes, and its Shapley value."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, materialize

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[tuple[str, Column]]:
    """The failure conditions that a text alone decides: too short, repetitive, shouting, marked up."""
    words = F.filter(F.split(text, ASCII_SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [("A", n < 200), ("B", 100 * distinct < 50 * n), ("C", 100 * capitals > 3 * F.char_length(text)), ("D", text.rlike("[#$%&*|]"))]


def failing(docs: DataFrame, labels: DataFrame, duplicates: str = "E") -> tuple[DataFrame, str]:
    """(part, mask, good, toxic) of every document, and the filters' letters; bit k of the mask is set if the text fails filter k.

    ``duplicates`` names the last filter: the text equals that of a smaller doc_id anywhere in the
    table. Equal texts meet by their SHA-256, as narrow rows; only digests that occur twice are joined back.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = text_failures(F.col("_t"))
    mask = sum((F.when(rule, 1 << k).otherwise(0) for k, (_, rule) in enumerate(rules)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    rows = materialize(rows.select("id", "part", mask.cast("int").alias("texts"), F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("digest")), "audit-rows")
    first = rows.groupBy(F.col("digest").alias("same")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = labels.select(F.col("doc_id").cast("long").alias("of"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).where("g or t")
    marked = marked.groupBy("of").agg(F.max(F.coalesce("g", F.lit(False))).alias("g"), F.max(F.coalesce("t", F.lit(False))).alias("t"))
    again = F.when(F.col("id") > F.col("first"), 1 << len(rules)).otherwise(0)
    out = rows.join(first, F.col("digest") == F.col("same"), "left").select("id", "part", (F.col("texts") + again).alias("mask"))
    out = out.join(marked, F.col("id") == F.col("of"), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    return out.select("part", "mask", flag("g").alias("good"), flag("t").alias("toxic")), "".join(name for name, _ in rules) + duplicates


class RemovalPolynomial:
    """The multilinear extension of "rows that a set of filters removes", from counts by mask.

    A row with mask m is removed with probability 1 - prod(1 - x_k for k in m); expanded, the coefficient
    of the monomial S is (-1)**(|S| + 1) times the rows that fail all of S.
    """

    def __init__(self, counts: dict[int, int], filters: int):
        self.filters = filters
        self.coefficients = {
            s: (-1) ** (s.bit_count() + 1) * n for s in range(1, 1 << filters) if (n := sum(c for m, c in counts.items() if m & s == s))
        }

    def corner(self, chosen: int) -> int:
        """Its value where the chosen filters are 1 and the others 0: the rows that they remove together."""
        return sum(c for s, c in self.coefficients.items() if s & chosen == s)

    def shapley(self, k: int) -> Fraction:
        """The integral over t from 0 to 1 of the partial derivative by x_k at (t, ..., t)."""
        diagonal = [0] * self.filters  # coefficients of 1, t, t**2, ...
        for s, c in self.coefficients.items():
            if s >> k & 1:
                diagonal[s.bit_count() - 1] += c
        return sum((Fraction(c, power + 1) for power, c in enumerate(diagonal)), Fraction(0))


def interactions(counts: dict[int, tuple[int, int, int]], letters: str) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders, from (rows, good, toxic) by mask."""
    n, everything = len(letters), (1 << len(letters)) - 1
    rows, good, toxic = (RemovalPolynomial({m: c[i] for m, c in counts.items()}, n) for i in range(3))
    total = sum(c[0] for c in counts.values())
    gone, good_gone, toxic_gone = ([p.corner(s) for s in range(1 << n)] for p in (rows, good, toxic))
    values = [factorial(n) * rows.shapley(k) for k in range(n)]
    assert all(v.denominator == 1 for v in values)
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed = gone[after] - gone[before]
            alone = gone[everything] - gone[everything & ~(1 << k)]
            lost = good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before]
            yield "".join(letters[x] for x in order), step, total - gone[after], removed, gone[1 << k] - removed, alone, *lost, int(values[k])
            before = after


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters do to each part of the documents, in every order.

    Filters: A under 200 words, B under half of the words distinct, C over 3 % capitals A-Z, D one of
    ``#$%&*|``, E equal to a smaller doc_id's text anywhere. Parts are the values of lang, with null as the
    empty string. Returns for every part, order and step the rows kept and removed, those that fail but
    were gone already, those that fail this filter only, the good (labels.quality = 1) and toxic rows
    lost, and the filter's removals summed over all orders: its Shapley value, times the number of orders.
    Null texts are empty. A null doc_id has no smaller one and is smaller than none; rows of one id with
    one text don't remove each other; a document is good or toxic if any label row of its id says so. An
    empty table gives no rows; other columns are ignored.

    Spark counts rows by part and mask; a part is then at most 32 rows, from which its polynomials are formed.
    """
    rows, letters = failing(docs, labels)
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def orders(group: pa.Table) -> pa.Table:
        by_mask = {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in group.to_pylist()}
        found = [(group.column("part")[0].as_py(), *x) for x in interactions(by_mask, letters)]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        fields = [x.split(" ") for x in RESULT.split(", ")]
        return pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, zip(*found, strict=True), strict=True)})

    return counts.groupBy("part").applyInArrow(orders, RESULT)
