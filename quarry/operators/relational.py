"""Order-aware relational helpers: every "first" is by an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.durable import saved

Order = list[Column | str]


def _cols(xs: Order) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def unique_by(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """First row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order)))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def top_k(df: DataFrame, keys: list[str], order: Order, k: int) -> DataFrame:
    """The k first rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order)))
    return df.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def latest(df: DataFrame, keys: list[str], at: str, tie: str | None = None) -> DataFrame:
    """Last row of each key by time. A running maximum per key: partial sums travel, not rows."""
    order = F.struct(at, tie) if tie else F.col(at)
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), order).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def ordinals(df: DataFrame, keys: list[str], order: Order, out: str = "ord") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order))))


def ranks(df: DataFrame, keys: list[str], order: Order, out: str) -> DataFrame:
    """Rank of each row within its keys, for keys that may hold any share of the rows. Rows are dealt by ranges of
    (keys, order), so a large key lies in several partitions; a row's rank is its place there plus the rows of its key
    in the partitions before. Rows with equal keys and order are ranked in any order, but only once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*_cols(keys), *_cols(order)]
    placed = saved(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    runs = runs.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    # There may be as many runs as rows, so they are not sent: what Spark guesses from their files is far too small.
    return placed.join(runs.hint("merge"), same).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(out))


#: Rows of one key that a task scans at once.
BLOCK = 1 << 16


def _equal(keys: list[str]) -> Column:
    """Null-safe equality of keys with their renamed copies."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return out


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]


def _blocks(df: DataFrame, keys: list[str], order: Order, block: int) -> DataFrame:
    """Rows with their rank in the key and the block of ranks that they lie in."""
    return ranks(df, keys, order, "__rank").withColumn("__block", F.floor((F.col("__rank") - 1) / block))


def _with_neighbours(df: DataFrame, keys: list[str], order: Order, n: int, block: int) -> DataFrame:
    """Blocks of ranks with up to n rows of the blocks beside them; those rows are not __own."""
    rows = _blocks(df, keys, order, max(block, n))
    place = (F.col("__rank") - 1) % max(block, n)
    held = F.array(F.lit(0), F.when(place < n, F.lit(-1)), F.when(place >= max(block, n) - n, F.lit(1)))
    out = rows.withColumn("__to", F.explode(F.filter(held, lambda x: x.isNotNull())))
    return out.withColumns({"__own": F.col("__to") == 0, "__block": F.col("__block") + F.col("__to")})


def carry_forward(df: DataFrame, keys: list[str], order: Order, column: str, out: str, block: int = BLOCK) -> DataFrame:
    """Last value that was not null, up to and with the row. A key of any size is scanned in blocks; what a block
    leaves is carried over the blocks of its key, one row each."""
    rows = saved(_blocks(df, keys, order, block), "blocks")
    scan = Window.partitionBy(*keys, "__block").orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    lasts = rows.groupBy(*keys, "__block").agg(F.max_by(F.when(F.col(column).isNotNull(), F.col(column)), F.when(F.col(column).isNotNull(), F.col("__rank"))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.select(*_renamed(keys), F.col("__block").alias("__b"), before.alias("__before"))
    return rows.join(carried.hint("merge"), _equal(keys) & (F.col("__block") == F.col("__b"))).select(*df.columns, F.coalesce(F.last(column, ignorenulls=True).over(scan), F.col("__before")).alias(out))


def _framed(df: DataFrame, keys: list[str], order: Order, column: Column, n: int, frame: tuple[int, int], out: str, block: int) -> DataFrame:
    w = Window.partitionBy(*keys, "__block").orderBy("__rank").rowsBetween(*frame)
    return _with_neighbours(df, keys, order, n, block).withColumn(out, column.over(w)).where("__own").select(*df.columns, out)


def look_ahead(df: DataFrame, keys: list[str], order: Order, column: str, n: int, out: str, block: int = BLOCK) -> DataFrame:
    """First value that is not null in the next n rows. Keys are scanned in blocks that overlap by n rows."""
    return _framed(df, keys, order, F.first(column, ignorenulls=True), n, (1, n), out, block)


def nearby(df: DataFrame, keys: list[str], order: Order, column: str, n: int, out: str, block: int = BLOCK) -> DataFrame:
    """First value that is not null from n rows before to n rows after."""
    return _framed(df, keys, order, F.first(column, ignorenulls=True), n, (-n, n), out, block)


def sequence_ids(df: DataFrame, prefix: Column, order: Order, out: str = "seq_id") -> DataFrame:
    """prefix, then prefix-2, prefix-3 within equal prefixes."""
    placed = ranks(df.withColumn("__prefix", prefix), ["__prefix"], order, "__place")
    return placed.withColumn(out, F.when(F.col("__place") == 1, F.col("__prefix")).otherwise(F.concat_ws("-", "__prefix", F.col("__place").cast("string")))).drop("__prefix", "__place")


def chunk(df: DataFrame, keys: list[str], order: Order, size: int) -> DataFrame:
    """Chunk number of each row, and its label i/n."""
    placed = ranks(df, keys, order, "__place")
    last = placed.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max("__place").alias("__last"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    number = lambda c: F.floor((F.col(c) - 1) / size) + 1
    numbered = placed.join(last, same).withColumn("chunk", number("__place"))
    return numbered.withColumn("chunk_label", F.concat_ws("/", F.col("chunk").cast("string"), number("__last").cast("string"))).select(*df.columns, "chunk", "chunk_label")


def pack(df: DataFrame, keys: list[str], order: Order, length: str, cap: int, separator: int = 2) -> DataFrame:
    """Ranked rows until the joined length would pass the cap: sums only grow, so a prefix is exact. Every row takes a
    separator at least, which bounds the rows that can be packed: tasks keep no more of a key than that."""
    if separator > 0:
        df = top_k(df, keys, order, (cap + separator) // separator)
    w = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.col(length), F.lit(0)) + separator).over(w) - separator
    return df.withColumn("packed_length", total).where(F.col("packed_length") <= cap)


def step_pairs(df: DataFrame, keys: list[str], order: Order, node: str, short: bool = False, block: int = BLOCK) -> DataFrame:
    """(node, next_node) of each path. Paths are scanned in blocks that overlap by a row; short paths, of a bounded
    number of rows, in one window each."""
    if short:
        paired = df.withColumn("next_node", F.lead(node).over(Window.partitionBy(*keys).orderBy(*_cols(order))))
    else:
        paired = _framed(df, keys, order, F.first(node), 1, (1, 1), "next_node", block)
    return paired.where("next_node IS NOT NULL")


def priority_union(parts: list[DataFrame], keys: list[str], order: Order) -> DataFrame:
    """Union of sources; of equal keys the earliest source stays."""
    joined = None
    for at, part in enumerate(parts):
        ranked = part.withColumn("source_rank", F.lit(at))
        joined = ranked if joined is None else joined.unionByName(ranked, allowMissingColumns=True)
    return unique_by(joined, keys, ["source_rank", *order])


def round_robin(left: DataFrame, right: DataFrame, left_order: Order, right_order: Order, group: str, shift: int = 0) -> DataFrame:
    """In each group the i-th left row meets the (i + shift mod n)-th right row. Places are ranks, and rows meet by group
    and place, so a group of any size lies in several tasks."""
    placed = saved(ranks(right, [group], right_order, "__at").withColumn("__at", F.col("__at") - 1), "turns")
    sizes = placed.groupBy(group).agg(F.max("__at").alias("__n"))
    own = ranks(left, [group], left_order, "__i")
    asked = own.join(sizes, group).withColumn("__at", F.pmod(F.col("__i") - 1 + shift, F.col("__n") + 1)).drop("__n", "__i")
    return asked.join(placed, [group, "__at"]).drop("__at")


def merge_evidence(base: DataFrame, incoming: DataFrame, key: str, scalars: list[str], flags: list[str], arrays: list[str]) -> DataFrame:
    """Full outer merge: existing scalars stay, flags are joined by or, arrays by union."""
    b, i = base.alias("b"), incoming.alias("i")
    return b.join(i, F.col(f"b.{key}") == F.col(f"i.{key}"), "full_outer").select(
        F.coalesce(f"b.{key}", f"i.{key}").alias(key),
        *(F.coalesce(f"b.{c}", f"i.{c}").alias(c) for c in scalars),
        *((F.coalesce(f"b.{c}", F.lit(False)) | F.coalesce(f"i.{c}", F.lit(False))).alias(c) for c in flags),
        *(F.array_union(F.coalesce(f"b.{c}", F.array().cast("array<string>")), F.coalesce(f"i.{c}", F.array().cast("array<string>"))).alias(c) for c in arrays),
    )


def coverage(expected: DataFrame, actual: DataFrame, key: str, category: str) -> DataFrame:
    """Expected keys that are missing, labelled."""
    return expected.join(actual, key, "left_anti").select(F.lit(category).alias("category"), key)


def cascade_match(tiers: list[DataFrame], key: str) -> DataFrame:
    """Matches of the first tier that has any for a key."""
    joined = None
    for at, tier in enumerate(tiers, 1):
        ranked = tier.withColumn("tier", F.lit(at))
        joined = ranked if joined is None else joined.unionByName(ranked)
    return joined.withColumn("__best", F.min("tier").over(Window.partitionBy(key))).where("tier = __best").drop("__best")


def first_match(pairs: DataFrame, keys: list[str], order: Order) -> DataFrame:
    return unique_by(pairs, keys, order)
