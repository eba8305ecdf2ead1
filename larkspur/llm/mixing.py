"""Mix sources to target weights, in DataFrame operations only.

Every row gets a hash-random key.  Inside a source the key range is cut into
slices; rows are sorted inside their slice, the slice totals are summed up
before them, so every row knows how many words of its source come before it.
A source whose target is T and whose size is S is taken floor(T / S) times
whole, and once more up to the exact rest.  A large source is many slices, so
no task holds it; equal rows are counted before the shuffle and their copies
are dealt over slices in bounded runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.skew import BROADCAST_BYTES, broadcast_if_small, join_hot_keys
from larkspur.session import cut_lineage

WEIGHTS = (5, 2, 1)  # by order of the sources, repeating
SHARE = 1.5  # words of the mixture, in sizes of the corpus
MOST_EPOCHS = 2
SLICE_ROWS = 50_000  # rows of a slice of a large source, about
FINE_ROWS, FINE_SLICES = 500, 256  # a smaller source is cut finer, so that its slices are alike
RUN_COPIES = 10_000  # equal rows that go together at most


def word_count(text: Column) -> Column:
    """Runs of characters other than blank and \\t to \\r; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """``source``, ``number``, ``source_size``, ``n``, ``target`` (double) from rows with ``source`` and ``size``.

    Sources by code point, NULL last, take the weights in turn and share
    ``share`` times all words.  A target stops at ``most_epochs`` times its
    source; the excess goes to the others by weight until none is above.  That
    is a common level L with target = min(L * weight, limit): sources in the
    order of limit / weight are full up to the first that the level leaves open.
    """
    totals = cut_lineage(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    )
    order = [F.encode("source", "utf-8").asc_nulls_last()]
    numbered = _before(totals, order, {"number": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    limit = (F.lit(most_epochs) * F.col("source_size")).cast("double")
    weighted = numbered.withColumn("weight", weight).withColumn("limit", limit)
    filled = _before(
        weighted, [F.col("limit") / F.col("weight"), F.col("number")],
        {"limits": F.col("limit"), "weights": F.col("weight").cast("long")},
    )
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(whole["size"] or 0) * share) - F.col("limits")) / (F.lit(whole["weight"] or 0) - F.col("weights"))
    # of sources with equal limit / weight the first that is open has filled all others before it
    first = F.min(F.when(level * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "number", level.alias("level"))))
    final = filled.agg(first.alias("first")).first()["first"]
    target = F.col("limit") if final is None else F.least(F.lit(final["level"]) * F.col("weight"), F.col("limit"))
    return filled.select("source", "number", "source_size", "n", target.alias("target"))


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with each sum over the rows that come before in the order, which must be total; stored.

    Rows are range-sorted into slices; the sums of whole slices are added up, then rows inside their slice.
    """
    sliced = cut_lineage(rows.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    by_slice = Window.partitionBy().orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    starts = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()]).select(
        "_slice", *[F.coalesce(F.sum(f"_{name}").over(by_slice), F.lit(0)).alias(f"_{name}") for name in sums]
    )
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(
        sliced.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(name) for name, c in sums.items()])
        .join(F.broadcast(starts), "_slice")  # as many rows as range partitions
        .select(*rows.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])
    )


def prefix_sums(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` (source, id, size, copies, run) with ``key``, ``slice`` and ``begin``, the words of the source before.

    The order inside a source is key, id, size, run: a hash of the row's own
    values, so it is the same in every run.
    """
    key = F.xxhash64("id", "size", "run")
    slices = F.greatest(
        F.ceil(F.col("n") / SLICE_ROWS), F.least(F.ceil(F.col("n") / FINE_ROWS), F.lit(FINE_SLICES)), F.lit(1)
    )
    part = F.floor((F.shiftrightunsigned(F.col("key"), 33).cast("double") / float(1 << 31)) * slices).cast("long")
    keyed = rows.withColumn("key", key)
    if (sources := totals.count()) * 256 <= BROADCAST_BYTES:
        keyed = keyed.join(broadcast_if_small(totals, sources, 256), rows.source.eqNullSafe(totals.source)).drop(totals.source)
    else:
        keyed = join_hot_keys(keyed, totals, "source", "n", [F.col("key")])
    keyed = keyed.withColumn("slice", part)
    words = F.col("size") * F.col("copies")
    by_slice = Window.partitionBy("number").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("number", "slice").agg(F.sum(words).alias("words"))
        .select("number", "slice", F.coalesce(F.sum("words").over(by_slice), F.lit(0)).alias("slice_begin"))
    )
    inside = (
        Window.partitionBy("number", "slice").orderBy("key", F.col("id").asc_nulls_last(), "size", "run")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return (
        placed.join(starts, ["number", "slice"])
        .withColumn("begin", F.col("slice_begin") + F.col("inside"))
        .drop("slice_begin", "inside")
    )


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """Distinct (id, source, size) with their copies, target and place in the source's order; stored."""
    sizes = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
        )
    )
    totals = cut_lineage(source_targets(sizes, **mix))
    equal = sizes.groupBy("source", "id", "size").agg(F.count("*").alias("count"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / RUN_COPIES)))
    runs = equal.select("source", "id", "size", "count", run.alias("run")).withColumn(
        "copies", F.least(F.lit(RUN_COPIES), F.col("count") - F.col("run") * RUN_COPIES)
    ).drop("count")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    return (
        prefix_sums(runs, totals)
        .withColumn("epochs", whole.cast("long"))
        .withColumn("rest", F.greatest(F.lit(0), rest))
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) of every row.

    A row of ``size`` words is taken ``epochs`` times, and once more as far as
    the rest of its source's budget reaches.  NULL and blank texts have size 0
    and nothing is taken.  NULL is a source of its own.  Repeated rows come out
    as often as they went in and take their turns one after the other; a NULL
    key is a key like any other.  Other columns are not read.
    """
    placed = place(docs, id_col, text_col, source_col, **options)
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    begin = F.col("begin") + F.col("copy") * F.col("size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - begin))
    return each.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"),
    )


def repeat_to_weights(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """``docs`` as the mixture takes them: whole rows, repeated by epoch, the others left out.

    The row at a source's cut is taken if at least half of it is inside, so a
    source is off by half a row at most.  Of rows that are equal in source, key
    and size, as many are taken once more as fit.  Rows without words stay once.
    The columns are those of ``docs``; rows are decided by a comparison with
    their source's cut, so whole rows are not shuffled.  Only rows of equal ones
    that are taken in part are stored with a number, to be told apart by it.
    """
    placed = cut_lineage(place(docs, id_col, text_col, source_col, **options))
    inside, size, copies = F.col("rest") - F.col("begin"), F.col("size"), F.col("copies")
    fitting = F.least(copies, F.greatest(F.lit(0), F.floor((2 * inside + size) / (2 * size))))
    placed = placed.withColumn("more", F.when((size > 0) & (F.col("rest") > 0), fitting).otherwise(0))
    whole = (size > 0) & (F.col("more") == copies)
    order = F.struct("key", F.col("id").isNull().alias("no_id"), "id", "size", "run")
    cuts = placed.groupBy("source").agg(
        F.first("epochs").alias("epochs"), F.max(F.when(whole, order)).alias("cut")
    )
    cuts = cut_lineage(cuts.select(F.struct("source", "epochs", "cut").alias("_cut")))
    # a source's cut divides one run; besides, equal rows of several runs may lie on both sides of it
    several = (F.col("run") > 0) | (copies == RUN_COPIES) | ((F.col("more") > 0) & (F.col("more") < copies))
    divided = (
        placed.where(several).groupBy("source", "id", "size").agg(F.sum("more").alias("more"), F.sum("copies").alias("of"))
        .where("more > 0 AND more < of").withColumn("group", F.monotonically_increasing_id())
    )
    divided = cut_lineage(divided.select(F.struct("source", "id", "size", "more", "group").alias("_part")))
    names = docs.columns
    words = word_count(F.col(f"_row.{text_col}"))
    keyed = docs.select(F.struct(*names).alias("_row")).select("_row", words.alias("_size"))
    key, source = F.col(f"_row.{id_col}"), F.col(f"_row.{source_col}")
    equal = (
        source.eqNullSafe(F.col("_part.source")) & key.eqNullSafe(F.col("_part.id"))
        & (F.col("_size") == F.col("_part.size"))
    )
    joined = (
        keyed.join(broadcast_if_small(cuts, cuts.count(), 512), source.eqNullSafe(F.col("_cut.source")))
        .join(broadcast_if_small(divided, divided.count(), 128), equal, "left")
    )
    own = F.struct(
        F.xxhash64(key, F.col("_size"), F.lit(0).cast("long")).alias("key"), key.isNull().alias("no_id"),
        key.alias("id"), F.col("_size").alias("size"), F.lit(0).cast("long").alias("run"),
    )
    taken = F.col("_cut.epochs") + F.when(own <= F.col("_cut.cut"), 1).otherwise(0)
    times = F.when(F.col("_size") == 0, 1).otherwise(taken).cast("int")
    alone = joined.where(F.col("_part").isNull()).select("_row", times.alias("_times"))
    shared = cut_lineage(
        joined.where(F.col("_part").isNotNull()).select(
            "_row", F.col("_cut.epochs").alias("_epochs"), F.col("_part.group").alias("_group"),
            F.col("_part.more").alias("_more"), F.monotonically_increasing_id().alias("_at"),
        )
    )
    lasts = _last_taken(shared.select("_group", "_more", "_at"))
    turns = shared.join(broadcast_if_small(lasts, lasts.count(), 32), "_group").select(
        "_row", (F.col("_epochs") + F.when(F.col("_at") <= F.col("_last"), 1).otherwise(0)).cast("int").alias("_times")
    )
    return (
        alone.unionAll(turns).where("_times > 0")
        .select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy"))
        .select(*[F.col("_row").getField(name).alias(name) for name in names])
    )


def _last_taken(rows: DataFrame) -> DataFrame:
    """``_last``, the ``_more``-th smallest ``_at`` of every ``_group``; only one block of a group is sorted."""
    blocked = rows.withColumn("_block", F.floor(F.col("_at") / RUN_COPIES))
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy("_group", "_more", "_block").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where("_before < _more AND _more <= _before + _n").select("_group", "_block", "_before")
    )
    turn = F.row_number().over(Window.partitionBy("_group").orderBy("_at"))
    return cut_lineage(
        blocked.join(blocks, ["_group", "_block"]).withColumn("_turn", turn)
        .where("_turn = _more - _before").select("_group", F.col("_at").alias("_last"))
    )
