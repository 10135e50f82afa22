"""Mixing sources to target weights by Pareto order sampling.

Every document gets a wanted number of copies.  Its whole part is certain; its
fraction is an inclusion probability ``p``.  Documents of a source are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with a seeded random ``u``, and the first ones
are taken until the source's remaining words are reached.  Longer documents get
somewhat more copies (``log2`` of their length), so probabilities differ within
a source as well as between sources.

No step sorts a source: cut points are found from sums over 4096 parts of the
ranks, then of the part with the cut, and only the rest is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.llm.common import materialize, numbered, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 77
PARTS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` for ``sizes(source, source_size)``.

    Sources take the weights in turn, by code point, null last.  A target stops
    at ``most`` times the source's size; what is cut off is shared again by
    weight until no target is above.
    """
    ranked = numbered(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("w")), "mix-weights")
    cap = F.col("source_size") * most
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, held = 0.0, 0
    while True:
        over = F.lit(level) * F.col("w") > cap
        at = ranked.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("w"))).alias("open"), F.sum(over.cast("long")).alias("n")).first()
        if level and at["n"] == held or not at["open"] or not total:
            break
        held, level = at["n"], (share * total - (at["capped"] or 0)) / at["open"]
    return ranked.select("source", "source_size", F.least(F.lit(level) * F.col("w"), cap.cast("double")).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """Wanted copies split into ``certain`` and ``p``, with the rank ``r`` in (0, 1)."""
    wanted = F.round(F.least(F.lit(float(most)), F.col("scale") * F.col("grade")), 9)
    rows = rows.withColumn("certain", F.floor(wanted)).withColumn("p", wanted - F.floor(wanted))
    u = (F.shiftrightunsigned("draw", 11) + 0.5) / float(1 << 53)
    return rows.withColumn("r", F.when(F.col("p") > 0, u * (1 - F.col("p")) / (u * (1 - F.col("p")) + F.col("p") * (1 - u))))


def _cut(sums: DataFrame, part: str) -> DataFrame:
    """The part of each key in which the running sum of ``z`` reaches ``rest``, with the words before it."""
    run = sums.withColumn("upto", F.sum("z").over(Window.partitionBy("key").orderBy(part)))
    hit = run.where(F.col("upto") >= F.col("rest")).groupBy("key").agg(F.min(F.struct(part, (F.col("rest") - F.col("upto") + F.col("z")).alias("rest"))).alias("hit"))
    return hit.select("key", f"hit.{part}", F.col("hit.rest").alias("left"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(row, size, source_size, target, copies)`` for each row of ``docs``; ``row`` holds its columns, whatever their names.

    A null text has size 0; null is a source of its own.  Rows equal in id and
    text share one random draw, so repeated rows are taken alike; equal ranks are
    broken by the draw.  Documents of size 0 add no words; a source without words
    has target 0 and no copies.  An empty table gives an empty result.
    """
    text = F.col(text_col)
    grade = F.floor(F.log2(F.col("z") + 2.0)).cast("int")
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text))
    facts = docs.select(_key(F.col(source_col)).alias("key"), F.col(source_col).alias("source"), word_count(text).alias("z"), draw.alias("draw"))
    facts = materialize(facts.withColumn("grade", grade), "mix-facts")
    graded = materialize(facts.groupBy("key", "source", "grade").agg(F.sum("z").alias("z")), "mix-grades")
    targets = materialize(source_targets(graded.groupBy("source").agg(F.sum("z").alias("source_size")), weights, share, most), "mix-targets").withColumn("key", _key(F.col("source")))
    # scale: copies of a document of grade g are min(most, scale * g); grades above one place are capped there
    by_grade = Window.partitionBy("key").orderBy("grade")
    steps = graded.join(targets.select("key", "target"), "key").select("key", "grade", "target", F.sum(F.col("z") * F.col("grade")).over(by_grade).alias("low"), (F.sum("z").over(Window.partitionBy("key")) - F.sum("z").over(by_grade)).alias("high"))
    steps = steps.withColumn("scale", F.when(F.col("low") > 0, (F.col("target") - most * F.col("high")) / F.col("low")))
    scales = steps.where(F.col("scale") * F.col("grade") <= most + 1e-9).groupBy("key").agg(F.max_by("scale", "grade").alias("scale"))
    sources = materialize(targets.join(scales, "key", "left").select("key", "source_size", "target", F.greatest(F.coalesce("scale", F.lit(0.0)), F.lit(0.0)).alias("scale")), "mix-scales")
    scored = _copies(facts.join(sources.select("key", "scale"), "key"), most)
    certain = scored.groupBy("key").agg(F.sum(F.col("certain") * F.col("z")).alias("sure"))
    rest = sources.join(certain, "key").select("key", (F.col("target") - F.col("sure")).alias("rest"))
    drawn = scored.where("r IS NOT NULL AND z > 0").select("key", "r", "draw", "z", F.floor(F.col("r") * PARTS).alias("one"), F.floor(F.col("r") * PARTS * PARTS).alias("two"))
    one = materialize(_cut(drawn.groupBy("key", "one").agg(F.sum("z").alias("z")).join(rest, "key"), "one"), "mix-cut")
    inner = drawn.join(one.withColumnRenamed("left", "rest"), ["key", "one"])
    two = materialize(_cut(inner.groupBy("key", "two").agg(F.sum("z").alias("z"), F.first("rest").alias("rest")), "two"), "mix-cut")
    last = drawn.join(two.withColumnRenamed("left", "rest"), ["key", "two"]).groupBy("key", "two", "r", "draw").agg(F.sum("z").alias("z"), F.first("rest").alias("rest"))
    upto = F.sum("z").over(Window.partitionBy("key", "two").orderBy("r", "draw"))
    last = last.withColumn("upto", upto).where(F.col("rest") - (F.col("upto") - F.col("z")) > F.col("z") / 2.0)  # taking it comes nearer
    cuts = last.groupBy("key").agg(F.max(F.struct("r", "draw")).alias("cut"))
    ends = sources.join(two.select("key", (F.col("two") / float(PARTS * PARTS)).alias("floor"), F.lit(True).alias("inside")), "key", "left").join(cuts, "key", "left")
    ends = ends.select("key", "source_size", "target", "scale", F.when(F.col("inside").isNull(), 2.0).otherwise(F.coalesce("cut.r", "floor")).alias("cut_r"),
                       F.when(F.col("cut").isNull(), F.lit(-(1 << 63))).otherwise(F.col("cut.draw")).alias("cut_draw"))
    ends = materialize(ends.join(rest, "key").withColumn("cut_r", F.when(F.col("rest") > 0, F.col("cut_r")).otherwise(-1.0)).drop("rest"), "mix-ends")
    return _apply(docs, ends, grade, draw, most, text_col, source_col)


def _apply(docs: DataFrame, ends: DataFrame, grade: Column, draw: Column, most: int, text_col: str, source_col: str) -> DataFrame:
    """Every row decides by itself from its source's scale and cut; texts are not shuffled."""
    rows = docs.select(F.struct("*").alias("row"), _key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("z"), draw.alias("draw")).withColumn("grade", grade)
    rows = _copies(rows.join(ends, "key"), most)
    taken = (F.col("r") < F.col("cut_r")) | ((F.col("r") == F.col("cut_r")) & (F.col("draw") <= F.col("cut_draw")))
    copies = (F.col("certain") + F.when(F.coalesce(taken, F.lit(False)), 1).otherwise(0)).cast("int")
    return rows.select("row", F.col("z").alias("size"), "source_size", "target", copies.alias("copies"))


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
