"""Mixing sources to target weights: whole copies for certain, the rest by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.common import BROADCAST_ROWS, packed, running_sum, word_count
from glucoframe.session import broadcast_if_small, cut_lineage

CYCLE = (5.0, 2.0, 1.0)
SHARE = 1.5  # words of the mix for each word of the corpus
MOST_COPIES = 2
BINS = 1 << 16  # steps of the sampling rank per source in the first pass
# Relative inclusion odds of a document by its number of words: short ones are drawn less often.
SHORT_WORDS, SHORT_ODDS = 100, 0.5


def targets(sources: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Target words per source from rows (source, source_size): columns source, source_size, target.

    Sources in code-point order, null last, weigh the cycle's numbers in turn. They divide share times all words by
    weight; no target exceeds most times its source, and the excess goes to the others by weight until none does.
    That ends at min(most * size, level * weight) for one level: sources reach their bound in the order of
    size / weight, so the level follows from running sums, which are taken over all tasks.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle)).cast("int") + 1)
    placed = running_sum(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "place")
    weighed = placed.select("source", "source_size", "place", weight.alias("weight"), (F.col("source_size") / weight).alias("ratio"))
    order = ["ratio", "place"]
    summed = running_sum(running_sum(weighed, order, "source_size", "size_before"), order, "weight", "weight_before")
    total = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(total.size) * share - F.col("size_before") * most) / (F.lit(total.weight) - F.col("weight_before"))
    # The first source whose bound is at or above its level, and all after it, stay below their bounds.
    still_open = F.col("source_size") * F.lit(float(most)) >= level * F.col("weight")
    final = summed.agg(F.min(F.when(still_open, F.struct("ratio", "place", level.alias("level"))))["level"].alias("level")).first().level
    target = F.least(F.col("source_size") * F.lit(float(most)), F.lit(float("inf") if final is None else final) * F.col("weight"))
    return summed.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number inside (0, 1) that depends on the key and the seed alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def short_odds(size: Column) -> Column:
    return F.when(size < SHORT_WORDS, F.lit(SHORT_ODDS)).otherwise(F.lit(1.0))


def _expected(plan: DataFrame) -> DataFrame:
    """Expected copies of a document per source and odds class, from (source, odds, words, source_size, target).

    Copies are scale * odds, at most MOST_COPIES, with one scale per source at which the expected words are its
    target. Classes reach the bound from the largest odds down, so the scale follows from running sums.
    """
    down = Window.partitionBy("source").orderBy(F.col("odds").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    onward = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum("words").over(before), F.lit(0)) * float(MOST_COPIES)
    scale = (F.col("target") - full) / F.nullif(F.sum(F.col("odds") * F.col("words")).over(onward), F.lit(0.0))
    scaled = plan.withColumn("scale", scale).withColumn("fits", F.col("scale") * F.col("odds") <= MOST_COPIES)
    best = F.max(F.when(F.col("fits"), F.struct("odds", "scale"))).over(Window.partitionBy("source"))["scale"]
    copies = F.least(F.lit(float(MOST_COPIES)), F.coalesce(best, F.lit(float("inf"))) * F.col("odds"))
    # Rounding must not turn whole copies into a fraction just below or above them.
    near = F.round(copies, 9)
    return scaled.select("source", "odds", "source_size", "target", F.when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(near).alias("expected"))


def sample(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    A document expects `expected` copies (0 to MOST_COPIES): its whole part is certain. The fraction is its inclusion
    probability p, and the documents of a source are ranked by the Pareto key [u / (1 - u)] / [p / (1 - p)] with u
    from the id and the seed. A sample has a fixed size in words: documents are taken in rank order as long as the
    source's target holds them, and closed by the one left over whose size comes nearest to what is still missing.
    Where the rank order ends is found from word counts per rank step (combined before the shuffle); only the
    documents of the one step that holds the end are ordered, so a source with a third of all rows never is.

    Null text: size 0, never in need of a draw. Null source: a source of its own, last. Null and repeated ids: equal
    draws, taken one by one. A source without words has target 0 and expects no copies. Further columns are ignored;
    an empty table gives no rows. Reruns agree.
    """
    plan, ends, picked, drawn = _decided(docs, id_column, source_column, text_column, seed)
    final = _with_ends(drawn, ends).join(broadcast_if_small(picked, BROADCAST_ROWS), "row", "left")
    copies = F.col("certain") + (_before_end() | F.col("picked").isNotNull()).cast("long")
    return final.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _decided(docs: DataFrame, id_column: str, source_column: str, text_column: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What decides on every row, written to the shared folder: the plan per source and odds, where each source's draw
    ends, the rows picked in that last step, and all rows with their draw."""
    size = word_count(F.col(f"`{text_column}`"))
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").alias("source"), size.alias("size"))
    narrow = cut_lineage(narrow.withColumn("row", F.monotonically_increasing_id()))
    classes = narrow.groupBy("source", short_odds(F.col("size")).alias("odds")).agg(F.sum("size").alias("words"))
    sources = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    plan = _expected(classes.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own"))
    plan = cut_lineage(plan.select(F.col("source").alias("own"), F.col("odds").alias("own_odds"), "source_size", "target", F.coalesce("expected", F.lit(0.0)).alias("expected")))
    drawn = cut_lineage(_drawn(narrow, plan, seed))
    ends = _ends(drawn)
    near = drawn.where("rank IS NOT NULL").join(broadcast_if_small(ends, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("own")))
    return plan, ends, cut_lineage(_picked(near)), drawn


def _drawn(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, size, ...) with their certain copies and, where a fraction is left, rank and rank step."""
    same = F.col("source").eqNullSafe(F.col("own")) & (short_odds(F.col("size")) == F.col("own_odds"))
    planned = rows.join(broadcast_if_small(plan, BROADCAST_ROWS), same).drop("own", "own_odds")
    p, u = F.col("expected") - F.floor("expected"), uniform(F.col("doc_id"), seed)
    key = (u / (1 - u)) / (p / (1 - p))
    drawn = planned.withColumn("certain", F.floor("expected").cast("long")).withColumn("rank", F.when((p > 0) & (F.col("size") > 0), key / (1 + key)))
    return drawn.drop("expected").withColumn("step", F.floor(F.col("rank") * BINS).cast("int"))


def _with_ends(drawn: DataFrame, ends: DataFrame) -> DataFrame:
    return drawn.join(broadcast_if_small(ends, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("own")), "left")


def _before_end() -> Column:
    """Taken by rank alone. A source without an end takes every document that takes part in the draw."""
    return F.col("rank").isNotNull() & (F.col("last").isNull() | (F.col("step") < F.col("last")))


def _ends(drawn: DataFrame) -> DataFrame:
    """Per source whose draw must end: the rank step `last` in which it does, and the words that step may give."""
    steps = drawn.groupBy("source", "step").agg(
        F.sum(F.when(F.col("step").isNotNull(), F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("size") * F.col("certain")).alias("certain_words"), F.first("target").alias("target"),
    )
    steps = running_sum(steps, [F.col("source").asc_nulls_last(), F.col("step").asc_nulls_first()], "words", "before")
    sources = steps.groupBy(F.col("source").alias("own")).agg(F.min("before").alias("base"), (F.first("target") - F.sum("certain_words")).alias("missing"))
    steps = steps.join(broadcast_if_small(cut_lineage(sources), BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("own")))
    steps = steps.where("step IS NOT NULL AND before - base + words > missing")
    ends = steps.groupBy("source").agg(F.min(F.struct("step", (F.col("missing") - F.col("before") + F.col("base")).alias("rest"))).alias("end"))
    return cut_lineage(ends.select(F.col("source").alias("own"), F.col("end.step").alias("last"), "end.rest"))


def _picked(near: DataFrame) -> DataFrame:
    """The rows taken within the last step of their source, and the row that closes it."""
    edge = running_sum(near.where("step = last").select("row", "own", "rest", "size", "rank"), [F.col("own").asc_nulls_last(), "rank", "row"], "size", "before")
    begins = edge.groupBy(F.col("own").alias("of")).agg(F.min("before").alias("base"))
    edge = edge.join(broadcast_if_small(cut_lineage(begins), BROADCAST_ROWS), F.col("own").eqNullSafe(F.col("of")))
    edge = cut_lineage(edge.select("row", "own", "rest", "size", "rank", (F.col("before") - F.col("base") + F.col("size") <= F.col("rest")).alias("fits")))
    gaps = edge.groupBy(F.col("own").alias("of")).agg((F.first("rest") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap"))
    over = near.where("step > last").select("row", "own", "size", "rank").union(edge.where(~F.col("fits")).select("row", "own", "size", "rank"))
    over = over.join(broadcast_if_small(cut_lineage(gaps), BROADCAST_ROWS), F.col("own").eqNullSafe(F.col("of")))
    off = F.abs(F.col("size") - F.col("gap"))
    closing = over.where(off < F.col("gap")).groupBy("own").agg(F.min(F.struct(off.alias("off"), "rank", "row")).alias("best"))
    return edge.where("fits").select("row").union(closing.select("best.row")).withColumn("picked", F.lit(True))


def mixed(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 7) -> DataFrame:
    """The rows of the mix: every row as often as the sample takes it, columns unchanged.

    A row's copies follow from its id, source and size, the plan and where its source's draw ends; so texts are not
    shuffled. Only the few rows picked in the last rank steps are found by id, source and size; where several rows agree
    in these, the picks are handed out one by one.
    """
    plan, ends, picked, drawn = _decided(docs, id_column, source_column, text_column, seed)
    key = [F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size")]
    edge = _with_ends(drawn, ends).where("rank IS NOT NULL AND step >= last").join(broadcast_if_small(picked, BROADCAST_ROWS), "row", "left")
    groups = edge.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("picked").alias("picks")).where("picks > 0")
    groups = broadcast_if_small(cut_lineage(groups), BROADCAST_ROWS)
    rows = packed(docs, doc_id=F.col(f"`{id_column}`"), source=F.col(f"`{source_column}`"), size=word_count(F.col(f"`{text_column}`")))
    rows = _with_ends(_drawn(rows, plan, seed), ends)
    found = F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    rows = rows.join(groups, found, "left").withColumn("by_rank", _before_end().cast("long"))
    several = F.coalesce(F.col("picks") < F.col("n"), F.lit(False))
    simple = rows.where(~several).select("row", (F.col("certain") + F.when(F.col("picks") > 0, 1).otherwise(F.col("by_rank"))).alias("copies"))
    if groups.where("picks < n").limit(1).count():
        place = F.row_number().over(Window.partitionBy("p_id", "p_source", "p_size").orderBy(F.xxhash64("row")))
        shared = rows.where(several).withColumn("place", place)
        simple = simple.union(shared.select("row", (F.col("certain") + (F.col("place") <= F.col("picks")).cast("long")).alias("copies")))
    kept = simple.where("copies > 0")
    return kept.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
