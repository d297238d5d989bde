"""Seeded shuffle, sampling, train/val/test split, epoch order, batches and
the evaluation limit.

Every order is a hash order: ``md5("<seed>:<id>")``, then the id, then the
source position where the rows carry one. The same seed gives the same rows on
any cluster size, and DuckDB computes the same hex.

A sample or a split only needs a few boundary keys, not a rank of every row:
``boundary_keys`` finds them exactly from a fixed-size histogram of the hash,
divided further where it holds a boundary, and every row is labelled by
comparing its own key. No text is moved, and one plan serves every size.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MIN_SELECTED_ROWS, SPLIT_FRACTION
from .rank import exact_rank, remove_table

#: Buckets of the histogram: the first four hex digits of the hash.
BUCKET_DIGITS = 4
#: Digits of the hash, and keys of a bucket that are few enough to be collected.
HASH_DIGITS, COLLECTED_KEYS = 32, 4096


def shuffle_key(seed, id_col: str = "id") -> Column:
    """``md5("<seed>:<id>")``: the seeded order (DuckDB computes the same hex)."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_col.cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def _keys(df: DataFrame, id_col: str) -> list:
    """The key columns: the id, and the source position when rows carry one,
    so even byte-identical copies have distinct keys."""
    return [id_col] + (["row_key"] if "row_key" in df.columns else [])


def order_key(df: DataFrame, seed, id_col: str = "id") -> Column:
    """The whole order as one comparable struct: hash, id[, row_key]."""
    return F.struct(shuffle_key(seed, id_col).alias("h"), *[F.col(c).alias(c) for c in _keys(df, id_col)])


def seeded_shuffle(df: DataFrame, seed: int, id_col: str = "id",
                   rank_col: str = "shuffle_rank", total_col: str | None = "total") -> DataFrame:
    """Position (1-based) of each row in the seeded permutation, as
    ``(id[, row_key], rank, total)``. Only keys are ranked; join them to the
    rows where the rest is needed."""
    keys = _keys(df, id_col)
    keyed = df.select(*keys, shuffle_key(seed, id_col).alias("_shuffle_h"))
    return exact_rank(keyed, ["_shuffle_h", *keys], rank_col=rank_col, total_col=total_col,
                      drop_after_sort=["_shuffle_h"])


def boundary_keys(df: DataFrame, key_col: str, positions) -> tuple[int, dict]:
    """The number of rows, and for each of the 1-based ``positions(number)``
    the literal key of the row there in the order of ``key_col``, a struct that
    starts with a hex hash ``h``.

    An aggregation counts rows per hash bucket (a fixed number of buckets). The
    buckets that hold a position are divided by the next digits of the hash, all
    in one aggregation, until they hold few keys, which are collected. Where all
    digits are used up (a group of copies) the keys are ranked with a range
    exchange, so such a group is spread as well. Rows with equal keys (repeated
    ids without ``row_key``) fall on the same side of a boundary."""
    h = F.col(f"{key_col}.h")

    def counts(rows: DataFrame, digits: int) -> list[tuple[str, int]]:
        """Rows per prefix, in order: 16 ** BUCKET_DIGITS at most per prefix before."""
        return sorted((r[0], r[1]) for r in rows.groupBy(F.substring(h, 1, digits).alias("b")).count().collect())

    hist = counts(df, BUCKET_DIGITS)
    total = sum(n for _, n in hist)
    wanted = sorted({p for p in positions(total) if 1 <= p <= total})
    places, out, digits = _placed(hist, {p: p for p in wanted}), {}, BUCKET_DIGITS
    while True:
        few = {b: (n, at) for b, (n, at) in places.items() if n <= COLLECTED_KEYS}
        if few:
            keys = df.where(F.substring(h, 1, digits).isin(list(few))).select(f"{key_col}.*")
            keys = keys.orderBy(*keys.columns).collect()
            for b, (_, at) in few.items():
                inside = [r for r in keys if r["h"].startswith(b)]
                out |= {p: _literal(df, key_col, inside[i - 1]) for p, i in at.items()}
        places = {b: v for b, v in places.items() if b not in few}
        if not places or digits >= HASH_DIGITS:
            break
        rest = df.where(F.substring(h, 1, digits).isin(list(places)))
        digits += BUCKET_DIGITS
        hist = counts(rest, digits)
        places = {b: v for up, (_, at) in places.items() for b, v in _placed([x for x in hist if x[0].startswith(up)], at).items()}
    for b, (_, at) in places.items():
        keys = df.where(h == b).select(f"{key_col}.*")
        ranked, path = exact_rank(keys, keys.columns, rank_col="_place", with_path=True)
        back = {i: p for p, i in at.items()}
        for r in ranked.where(F.col("_place").isin(list(back))).collect():
            out[back[r["_place"]]] = _literal(df, key_col, r)
        remove_table(df.sparkSession, path)
    return total, out


def _placed(hist: list[tuple[str, int]], at: dict[int, int]) -> dict[str, tuple[int, dict[int, int]]]:
    """The buckets that hold one of the places ``at`` (by position): their size
    and the places counted from their own first row."""
    out, before = {}, 0
    for b, n in hist:
        inside = {p: i - before for p, i in at.items() if before < i <= before + n}
        if inside:
            out[b] = n, inside
        before += n
    return out


def _literal(df: DataFrame, key_col: str, row) -> Column:
    def lit(value, kind):
        if hasattr(kind, "fields"):
            return F.struct(*[lit(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.lit(value).cast(kind)

    return lit(row, df.schema[key_col].dataType)


def split_size(selected: int) -> int:
    """Rows of test, and of val: max(1, round-half-even(0.1 * selected))."""
    return max(1, round(selected * SPLIT_FRACTION))


def first_n(df: DataFrame, n: int, key_col: str) -> DataFrame:
    """The first ``min(n, rows)`` rows in the order of ``key_col``, for any n."""
    if n < 1:
        return df.where(F.lit(False))
    _, at = boundary_keys(df, key_col, lambda _: [n])
    return df.where(F.col(key_col) <= at[n]) if n in at else df


def sample_n(df: DataFrame, n: int | None, seed: int, id_col: str = "id") -> DataFrame:
    """The first ``min(n, total)`` rows of the seeded permutation (all if n is None)."""
    if n is None:
        return df
    if n < MIN_SELECTED_ROWS:
        raise ValueError(f"n must be at least {MIN_SELECTED_ROWS}")
    return first_n(df.withColumn("split_key", order_key(df, seed, id_col)), n, "split_key").drop("split_key")


def split_train_val_test(df: DataFrame, seed: int, max_samples: int | None = None,
                         id_col: str = "id", check_min_rows: bool = True) -> DataFrame:
    """Sample if asked, and label every selected row with ``split``.

    test = the first ``t`` rows of the permutation, val = the next ``v``,
    train = the rest of the selection; ``t = v = max(1, round(0.1 * selected))``.
    Adds ``split``, ``split_key`` (the order) and ``selected`` and ``total`` (the
    selection's and the table's size). The sizes are counted when called; the
    result is a narrow plan. With ``check_min_rows`` a selection under 10 rows
    is an error."""
    keyed = df.withColumn("split_key", order_key(df, seed, id_col))
    keys = keyed.select("split_key")

    def sizes(count: int) -> tuple[int, int, int]:
        """Positions of the last test, val and selected row."""
        selected = count if max_samples is None else min(count, int(max_samples))
        if check_min_rows and selected < MIN_SELECTED_ROWS:
            raise ValueError(f"at least {MIN_SELECTED_ROWS} pairs are needed, got {selected}")
        return min(split_size(selected), selected), min(2 * split_size(selected), selected), selected

    def needed(count: int) -> tuple[int, ...]:
        return sizes(count)[:2 if sizes(count)[2] == count else 3]  # nothing is cut off behind the last row

    count, at = boundary_keys(keys, "split_key", needed)
    test, val, selected = sizes(count)
    out = keyed.where(F.col("split_key") <= at[selected]) if selected < count else keyed
    label = F.lit("train")
    for name, end in (("val", val), ("test", test)):
        if end in at:
            label = F.when(F.col("split_key") <= at[end], F.lit(name)).otherwise(label)
    return out.withColumns({"selected": F.lit(selected).cast("bigint"), "total": F.lit(count).cast("bigint"), "split": label})


def epoch_order(df: DataFrame, seed: int, epoch: int, id_col: str = "id",
                rank_col: str = "epoch_rank") -> DataFrame:
    """A new deterministic order of the training rows for one epoch
    (seed + epoch): ``(id[, row_key], epoch_rank)``, starting at 1. Only keys
    are ranked."""
    keys = _keys(df, id_col)
    keyed = df.select(*keys, shuffle_key(int(seed) + int(epoch), id_col).alias("_epoch_h"))
    return exact_rank(keyed, ["_epoch_h", *keys], rank_col=rank_col, drop_after_sort=["_epoch_h"])


def assign_batches(df: DataFrame, batch_size: int, rank_col: str = "epoch_rank",
                   batch_col: str = "batch_id") -> DataFrame:
    """Consecutive rows in groups of ``batch_size``; the last may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return df.withColumn(batch_col, F.floor((F.col(rank_col) - 1) / F.lit(batch_size)).cast("bigint"))


def epoch_batches(split_df: DataFrame, seed: int, epoch: int, batch_size: int,
                  id_col: str = "id") -> DataFrame:
    """``(id, [row_key,] epoch_rank, batch_id)`` of the training rows of one
    epoch. Only the keys are ranked (and checkpointed), not the texts or
    inputs; join the batch ids to the model inputs by id where needed."""
    train = split_df.where(F.col("split") == "train")
    return assign_batches(epoch_order(train, seed, epoch, id_col), batch_size)


def split_batches(split_df: DataFrame, split: str, batch_size: int, id_col: str = "id") -> DataFrame:
    """``(id, [row_key,] split_rank, batch_id)`` of the validation or test rows,
    which are read in split order in every epoch."""
    rows = split_df.where(F.col("split") == split).select("split_key.*")
    ranked = exact_rank(rows, rows.columns, rank_col="split_rank", drop_after_sort=["h"])
    return assign_batches(ranked, batch_size, rank_col="split_rank")


def eval_limit(split_df: DataFrame, k: int, key_col: str = "split_key") -> DataFrame:
    """The first ``min(k, n)`` test rows in split order; ``k = 0`` keeps all.
    Call it on the length-filtered rows: the limit is over rows that can be scored."""
    test = split_df.where(F.col("split") == "test")
    return first_n(test, int(k), key_col) if k else test
