"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Targets: sources weigh in proportion, and no target exceeds ``max_repeats`` times its source; what lies above is shared out
again by weight. A source is taken whole as often as its target allows (complete epochs); what is left of the target is
filled by a weighted sample without replacement: each document draws an exponential key divided by its quality weight, and the
smallest keys are taken as long as their running size keeps to the budget.

The running size is never computed over a whole source in one task. Keys are put into cells of fixed width on a logarithmic
scale, where no cell can hold more than a small share of a source; cell totals find the cell in which the budget ends, a second
level of cells divides that one, and only the documents of one cell of a cell are put in order. What the budget has left where
the next document is too large goes to the one document, of all those not taken, that comes nearest to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import prepare, store, without, word_count

#: Characters that lower the default quality weight of a text: symbols and digits.
NOISE = "#*$%&|<>{}[]\\/_=~^@+0123456789"

#: Cells of one level per unit of the key's logarithm. The density of that logarithm is below 0.37 per unit whatever the quality
#: weights are, so two levels leave less than 0.37 / CELLS^2 of a source to be put in order.
CELLS = 1024


def text_quality(text: Column) -> Column:
    """Weight from 0.05 to 1: the share of characters that are neither symbols nor digits."""
    size = F.length(text)
    share = F.length(without(text, NOISE)).cast("double") / size
    return F.when(size > 0, F.greatest(F.lit(0.05), share)).otherwise(F.lit(1.0))


def uniform(key: Column, seed: int) -> Column:
    """A number inside (0, 1) drawn from the key; the same in every run."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)


def measured_columns(doc_id: str, source: str, text: str, quality: Column | None, seed: int) -> list[Column]:
    """Document, source key, size in words, and the logarithm of the exponential key over the quality weight."""
    weight = text_quality(F.coalesce(F.col(text), F.lit(""))) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.05)), F.lit(0.01))
    return [
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_source"),
        word_count(F.col(text)).alias("size"),
        (F.log(-F.log(uniform(F.col(doc_id), seed))) - F.log(weight)).alias("_x"),
    ]


def targets(totals: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """Target of every source. ``totals`` has one row per source (a configured list, not data), so one task orders them."""
    listed = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("_source") == "n", F.col("_source"))
    place = ((F.row_number().over(by_name) - 1) % len(weights)) + 1
    ranked = totals.withColumn("_w", F.element_at(listed, place.cast("int"))).withColumn("_cap", max_repeats * F.col("source_size"))
    # The level that meets the total: sources are capped in the order of cap over weight.
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levelled = ranked.withColumn(
        "_level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))),
    )
    met = F.col("_cap") / F.col("_w") >= F.col("_level")
    level = F.min_by(F.when(met, F.col("_level")), F.when(met, F.col("_cap") / F.col("_w"))).over(everything)
    target = F.coalesce(F.least(F.col("_cap").cast("double"), level * F.col("_w")), F.col("_cap").cast("double"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        levelled.withColumn("target", target)
        .withColumn("_epochs", epochs)
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .select("_source", "source_size", "target", "_epochs", "_rest")
    )


def _cell(level: int) -> Column:
    scaled = (F.col("_x") + 64) * CELLS
    return F.floor(scaled) if level == 1 else F.floor((scaled - F.floor(scaled)) * CELLS)


def _crossing(cells: DataFrame, cell: str) -> DataFrame:
    """Of each source, the cell in which the running size reaches ``_rest``, with what is left of it there."""
    order = Window.partitionBy("_source").orderBy(cell)
    running = cells.withColumn("_sum", F.sum("_size").over(order))
    return running.filter((F.col("_sum") >= F.col("_rest")) & (F.col("_sum") - F.col("_size") < F.col("_rest"))).select(
        "_source", cell, (F.col("_rest") - (F.col("_sum") - F.col("_size"))).alias("_rest")
    )


def cut_points(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """Where the fractional selection of each source ends: its two cells and the last document taken inside them."""
    open_plan = plan.filter(F.col("_rest") > 0).select("_source", "_rest")
    first = measured.groupBy("_source", _cell(1).alias("_c1")).agg(F.sum("size").alias("_size")).filter("_size > 0").join(open_plan, "_source")
    first = store(_crossing(first, "_c1"))
    inside = measured.withColumn("_c1", _cell(1)).join(first, ["_source", "_c1"])
    second = inside.groupBy("_source", "_c1", "_rest", _cell(2).alias("_c2")).agg(F.sum("size").alias("_size")).filter("_size > 0")
    second = store(_crossing(second, "_c2").join(first.select("_source", "_c1"), "_source"))
    last = measured.withColumn("_c1", _cell(1)).withColumn("_c2", _cell(2)).join(second, ["_source", "_c1", "_c2"])
    # Repeated rows draw one key; they are taken or left together.
    last = last.groupBy("_source", "_c1", "_c2", "_rest", _place().alias("_place")).agg((F.sum("size")).alias("_size"))
    order = Window.partitionBy("_source").orderBy("_place")
    last = last.withColumn("_sum", F.sum("_size").over(order))
    kept = F.col("_sum") <= F.col("_rest")
    ends = last.groupBy("_source", "_c1", "_c2").agg(F.max(F.when(kept, F.col("_place"))).alias("_last"), (F.first("_rest") - F.max(F.when(kept, F.col("_sum")).otherwise(0))).alias("_left"))
    ends = store(ends)
    off = F.abs(F.col("size") - F.col("_left"))
    open_rows = measured.join(ends, "_source").filter((_inside() == 0) & (off < F.col("_left")))
    extra = open_rows.groupBy("_source").agg(F.min(F.struct(off.alias("off"), _place().alias("place")))["place"].alias("_extra"))
    return ends.join(extra, "_source", "left").drop("_left")


def _place() -> Column:
    return F.struct(F.col("_x"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.col("size"))


def mixing_plan(measured: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """One row per source: size, target, epochs and cut; stored, so that its size is known when it is joined."""
    totals = measured.groupBy("_source").agg(F.sum("size").alias("source_size"))
    plan = store(targets(totals, weights, share, max_repeats))
    return store(plan.join(cut_points(measured, plan), "_source", "left"))


def _inside() -> Column:
    """1 if the document's key lies before the cut of its source."""
    c1, c2 = _cell(1), _cell(2)
    inside = (c1 == F.col("_c1")) & ((c2 < F.col("_c2")) | ((c2 == F.col("_c2")) & F.coalesce(_place() <= F.col("_last"), F.lit(False))))
    return F.coalesce((c1 < F.col("_c1")) | inside, F.lit(False)).cast("long")


def _selected() -> Column:
    return F.greatest(_inside(), F.coalesce(_place() == F.col("_extra"), F.lit(False)).cast("long"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
    quality: Column | None = None,
    seed: int = 7,
    rows: bool = False,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row: how often the mix takes it, and the words of that.

    With ``rows`` the rows of ``docs`` themselves, each as often as the mix takes it; texts then meet only the one row of their
    source. Sizes are words; a null or empty text has none and is taken whenever its key precedes the cut. A null source is a
    source of its own, last in order. Sources without words get the target 0. Rows that repeat a ``doc_id`` draw the same key;
    those equal in size as well are taken or left together. An empty table gives no rows. Other columns are not read, whatever
    their names. The same rows give the same mix in every run.
    """
    prepare(docs.sparkSession)
    columns = measured_columns(doc_id, source, text, quality, seed)
    measured = store(docs.select(*columns))
    plan = mixing_plan(measured, weights, share, max_repeats)
    copies = F.col("_epochs") + _selected()
    if not rows:
        return measured.join(plan, "_source").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), *columns)
    taken = whole.join(plan, "_source").select("_row", copies.cast("int").alias("_copies")).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_n")).select("_row.*")
