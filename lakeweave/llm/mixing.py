"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy.

Every document's extra copy has the probability that its source's rate leaves over, but the draws of a source are tied:
its documents are parted into classes of like size, a class gets a seeded, unbiased number of extra copies, which makes
up for what larger classes took too much or too little, and the documents with the lowest seeded numbers get them.
So a source of few documents of very unequal size comes near its target too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, forget, fresh, in_order, join_hot, running, word_count

#: size classes in each octave of sizes
CLASSES = 8
#: rows of a lookup by (source, size class) that may be broadcast (some 10 MB); beyond, ``join_hot`` looks them up
MOST_LOOKUPS = 100_000


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on and share the total by weight. A target
    above ``most`` times its source is held there and the excess goes to the others by weight until none is above.
    Held sources are those with the smallest ``most * size / weight``: in that order source k is held exactly if the
    level reached without the sources before it, (total - held) / weights left, is above its own, so running sums
    over one row per source decide at once.
    """
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("_w", ((F.col("_r") - 1) % 3 + 1).cast("long")).withColumn("_cap", F.col("source_size") * F.lit(most))
    order = running(F.col("_cap") / F.col("_w"), F.col("_r"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, left = F.sum("_cap").over(order) - F.col("_cap"), F.sum("_w").over(every) - F.sum("_w").over(order) + F.col("_w")
    level = weighed.withColumn("_level", (F.sum("source_size").over(every) - before) / left)
    held = level.withColumn("_held", F.col("_cap") < F.col("_w") * F.col("_level"))
    # levels only fall from the first source that is not held, so the highest is the one in force
    final = F.max(F.when(~F.col("_held"), F.col("_level"))).over(every)
    target = F.when(F.col("_held"), F.col("_cap")).otherwise(F.col("_w") * final)
    return held.select("source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """-1 for 0; else a number for each octave of sizes and CLASSES equal parts of it, without rounding."""
    octave = F.length(F.bin(size)) - 1
    part = F.call_function("shiftright", size * CLASSES, octave)
    return F.when(size > 0, octave * CLASSES + part - CLASSES).otherwise(F.lit(-1)).cast("long")


def extra_copies(classes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``source, class, start, many, extra`` from ``source, class, n, words, start``: how many documents of a class get
    one more copy. A source has one row for each of its size classes, whose number doesn't depend on its documents.

    From the largest class down: ``n`` documents of a rate with fraction f are owed n f copies, less what larger classes
    took above their share in documents of this class; a seeded number in [0, 1) is added, and the sum is rounded down.
    """
    each = F.struct((-F.col("class")).alias("down"), "n", "words", "start", uniform(seed, F.concat_ws(":", F.coalesce("source", F.lit("")), F.col("class").cast("string"))).alias("u"))
    per = classes.groupBy("source").agg(F.array_sort(F.collect_list(each)).alias("cs")).join(targets, F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(rate).cast("long")).withColumn("f", rate - F.floor(rate))
    kind = "array<struct<class:bigint,start:bigint,n:bigint,extra:bigint>>"
    none = F.struct(F.lit(0.0).alias("over"), F.array().cast(kind).alias("out"))

    def step(acc, c):
        n, words = c["n"].cast("double"), c["words"].cast("double")
        owed = n * F.col("f") - F.when(words > 0, acc["over"] * n / F.greatest(words, F.lit(1.0))).otherwise(F.lit(0.0))
        extra = F.least(n, F.greatest(F.lit(0.0), F.floor(owed + c["u"]).cast("double")))
        over = acc["over"] + (extra / n - F.col("f")) * words
        row = F.struct((-c["down"]).alias("class"), c["start"].alias("start"), c["n"].alias("n"), extra.cast("bigint").alias("extra"))
        return F.struct(over.alias("over"), F.concat(acc["out"], F.array(row)).alias("out"))

    out = per.select("source", "source_size", "target", "whole", F.explode(F.aggregate("cs", none, step)["out"]).alias("c"))
    return out.select("source", "source_size", "target", "whole", "c.class", "c.start", "c.n", "c.extra")


def repetitions(docs: DataFrame, seed: int = 17, most: float = 3.0) -> tuple[DataFrame, int, int]:
    """A row for each source and size class: ``source, class, source_size, target, whole, n``, and the last document (in the
    order of ``u, id, tie``) that gets an extra copy, ``_u, _id, _tie``, null if none does; the numbers of these rows
    and of documents. ``docs``: doc_id, source, text."""
    narrow = docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    narrow = narrow.select("source", size_class(F.col("size")).alias("class"), uniform(seed, F.col("doc_id")).alias("u"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "tie", "size")
    ranked = cut(in_order(narrow, F.col("source").asc_nulls_first(), F.col("class"), F.col("u"), F.col("id"), F.col("tie")), "ranked")
    classes = cut(ranked.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("position").alias("start")), "classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, most).withColumnRenamed("source", "_s")
    extra = cut(extra_copies(classes, targets, seed), "extra")
    last = extra.where("extra > 0").select(F.col("source").alias("_s"), F.col("class").alias("_c"), (F.col("start") + F.col("extra") - 1).alias("position"))
    last = last.join(ranked, "position").select("_s", "_c", F.col("u").alias("_u"), F.col("id").alias("_id"), F.col("tie").alias("_tie"))
    both = extra.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left")
    out = cut(both.select("source", "class", "source_size", "target", "whole", "n", "_u", "_id", "_tie"), "repetitions")
    lookups, total = out.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    forget(ranked, classes, extra)
    return out, lookups, total


def plan_mix(docs: DataFrame, seed: int = 17, most: float = 3.0, names: tuple[str, ...] = ("size", "source_size", "target", "copies", "taken")) -> DataFrame:
    """Each row of ``docs`` with ``size, source_size, target, copies, taken`` (or other ``names``, in this order).

    A source's rate is target / source_size. A document gets floor(rate) copies, and one more with a probability equal
    to the fraction (see above); reruns and lost tasks agree. Null text has size 0; null is a source of its own; a
    source without words has rate 0; a null doc_id is one more doc_id; an empty table gives no rows. Columns of ``docs``
    named like the results are replaced, so give other ``names`` to keep them; any other columns stay.
    """
    docs = docs.drop(*names)
    lookup, lookups, total = repetitions(docs.select("doc_id", "source", "text"), seed, most)
    size, source_size, target, copies, taken = names
    new = fresh(*docs.columns, *names)
    key, mark, n, u, id_, tie, whole = (new(c) for c in ("key", "class", "n", "u", "id", "tie", "whole"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    sized = docs.withColumn(size, word_count(F.col("text")))
    keyed = sized.withColumn(mark, size_class(F.col(size))).withColumn(key, named(F.col("source")))
    lookup = lookup.select(
        named(F.col("source")).alias(key), F.col("class").alias(mark), F.col("source_size").alias(source_size), F.col("target").alias(target),
        F.col("whole").alias(whole), F.col("n").alias(n), F.col("_u").alias(u), F.col("_id").alias(id_), F.col("_tie").alias(tie),
    )
    both = keyed.join(F.broadcast(lookup), [key, mark]) if lookups <= MOST_LOOKUPS else join_hot(keyed, lookup, [key, mark], n, total)
    own = F.struct(uniform(seed, F.col("doc_id")).alias("u"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.xxhash64("text").alias("t"))
    extra = F.coalesce(own <= F.struct(F.col(u).alias("u"), F.col(id_).alias("i"), F.col(tie).alias("t")), F.lit(False)) & F.col(u).isNotNull()
    both = both.withColumn(copies, (F.col(whole) + extra.cast("long")).cast("int"))
    both = both.withColumn(taken, (F.col(size) * F.col(copies)).cast("long"))
    return both.select(*docs.columns, *names)


def mix(docs: DataFrame, seed: int = 17, most: float = 3.0) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, unchanged whatever their names, each row as often as ``plan_mix`` says.

    Nulls, repeats and empty tables: as there.
    """
    new = fresh(*docs.columns)
    names = tuple(new(c) for c in ("size", "source_size", "target", "copies", "taken"))
    planned = plan_mix(docs, seed, most, names).where(F.col(names[3]) > 0)
    return planned.withColumn(new("copy"), F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*docs.columns)
