import hashlib
import random

from pyspark.sql import functions as F

from versio.operators.rank import exact_rank, running_sums
from versio.operators.sampling import (assign_batches, epoch_batches, eval_limit, sample_n,
                                       seeded_shuffle, split_train_val_test)


def _ids(spark, n, parts=7):
    return spark.range(0, n, numPartitions=parts).withColumnRenamed("id", "id")


def _md5_order(seed, ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_exact_rank_matches_python_sort(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long")
    got = {r.id: r["rank"] for r in exact_rank(df, ["k", "id"], num_partitions=5).collect()}
    want = {i: pos for pos, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1)}
    assert got == want


def test_exact_rank_hot_key_is_balanced(spark):
    # a third of the rows share one value of the leading key; the range
    # exchange still splits them because the full key is unique
    df = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    ranked = exact_rank(df, ["k", "id"], num_partitions=6)
    sizes = ranked.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 3000 / 2
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 3001))


def test_rank_total_and_partition_independence(spark):
    df = _ids(spark, 1234)
    a = {r.id: (r.shuffle_rank, r.total) for r in seeded_shuffle(df, 42).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = {r.id: (r.shuffle_rank, r.total) for r in seeded_shuffle(_ids(spark, 1234, 2), 42).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
    order = _md5_order(42, range(1234))
    assert all(a[i] == (pos, 1234) for pos, i in enumerate(order, 1))


def test_split_golden_sizes(spark):
    # 512 selected of 32,332 → 410 / 51 / 51
    df = _ids(spark, 32332)
    split = split_train_val_test(df, 42, max_samples=512)
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 410, "val": 51, "test": 51}


def test_split_sizes_follow_python_rounding(spark):
    sizes = list(range(10, 400)) + [1005, 1015, 2125, 12345]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r.n: r.t for r in df.select("n", F.greatest(F.lit(1), F.bround(F.col("n").cast("double") * 0.1, 0))
                                       .cast("long").alias("t")).collect()}
    assert got == {n: max(1, round(n * 0.1)) for n in sizes}


def test_split_disjoint_covering_deterministic(spark):
    df = _ids(spark, 777)
    a = {r.id: r.split for r in split_train_val_test(df, 9).collect()}
    b = {r.id: r.split for r in split_train_val_test(_ids(spark, 777, 3), 9).collect()}
    c = {r.id: r.split for r in split_train_val_test(df, 10).collect()}
    assert a == b and len(a) == 777 and a != c
    order = _md5_order(9, range(777))
    assert [a[i] for i in order[:78]] == ["test"] * 78
    assert [a[i] for i in order[78:156]] == ["val"] * 78


def test_sample_and_min_rows(spark):
    df = _ids(spark, 300)
    got = sorted(r.id for r in sample_n(df, 25, 1).collect())
    assert got == sorted(_md5_order(1, range(300))[:25])
    try:
        split_train_val_test(_ids(spark, 9), 1)
        raise AssertionError("a selection under 10 rows must fail")
    except Exception as e:  # noqa: BLE001
        assert "at least 10" in str(e)


def test_batches_and_eval_limit(spark):
    split = split_train_val_test(_ids(spark, 470), 42)
    b = epoch_batches(split, 42, 1, 8)
    rows = b.collect()
    n_train = sum(1 for _ in rows)
    assert n_train == 470 - 2 * 47
    sizes = {}
    for r in rows:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert len(sizes) == -(-n_train // 8) and all(v == 8 for k, v in sizes.items() if k < len(sizes) - 1)
    train_ids = [r.id for r in split.where("split = 'train'").collect()]
    order = _md5_order(43, train_ids)
    assert {r.id: r.batch_id for r in rows} == {i: pos // 8 for pos, i in enumerate(order)}
    first = [r.id for r in eval_limit(split, 5).orderBy("split_key").collect()]
    assert first == _md5_order(42, range(470))[:5]
    assert eval_limit(split, 0).count() == 47
    assert assign_batches(b, 100).select(F.max("batch_id")).first()[0] == (n_train - 1) // 100


def test_running_sums_match_cumsum(spark):
    rnd = random.Random(5)
    rows = [("a" if i % 3 else "b", i, float(rnd.randint(1, 9))) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, o long, v double")
    got = {(r.g, r.o): r.cum_v for r in running_sums(df, ["g"], "o", ["v"], block_size=64).collect()}
    acc = {}
    for g, o, v in rows:
        acc[g] = acc.get(g, 0.0) + v
        assert got[(g, o)] == acc[g]


def test_hot_copies_split_across_tasks(spark, scratch):
    from versio.sources.pairs import read_pairs

    # a third of the corpus is one byte-identical pair repeated
    rows = [(i, ("hello there", "ciao")) for i in range(2000)] + [(7, ("same", "stesso"))] * 1000
    spark.createDataFrame(rows, "id long, translation struct<en:string,it:string>") \
        .repartition(4).write.parquet(scratch)
    pairs = read_pairs(spark, scratch)
    ranked = seeded_shuffle(pairs, 42)
    per_task = ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in per_task) < 1000
    got = ranked.collect()
    assert sorted(r.shuffle_rank for r in got) == list(range(1, 3001))
    again = {(r.id, r.row_key.file, r.row_key.row): r.shuffle_rank for r in seeded_shuffle(read_pairs(spark, scratch), 42).collect()}
    assert again == {(r.id, r.row_key.file, r.row_key.row): r.shuffle_rank for r in got}


def test_sample_is_a_prefix_of_the_split_order(spark):
    df = _ids(spark, 500)
    sample = {r.id for r in sample_n(df, 120, 5).collect()}
    assert sample == set(_md5_order(5, range(500))[:120])
    assert {r.id for r in split_train_val_test(df, 5, max_samples=120).collect()} == sample
    assert sample_n(df, 900, 5).count() == 500


def test_boundary_among_copies(spark, scratch):
    """A third of the rows share one id, and the boundaries fall among them."""
    from versio.sources.pairs import read_pairs

    rows = [(i, ("a", "b")) for i in range(100, 160)] + [(7, ("same", "stesso"))] * 600
    spark.createDataFrame(rows, "id long, translation struct<en:string,it:string>").repartition(5).write.parquet(scratch)
    pairs = read_pairs(spark, scratch)
    counts = {r.split: r["count"] for r in split_train_val_test(pairs, 42).groupBy("split").count().collect()}
    assert counts == {"test": 66, "val": 66, "train": 528}
    assert sample_n(pairs, 333, 42).count() == 333


def test_split_moves_nothing(spark):
    plan = split_train_val_test(_ids(spark, 500), 5)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_spread_is_the_callers_choice(spark):
    from versio.operators.partitioning import spread_rows

    df = _ids(spark, 100, parts=1)
    assert spread_rows(df) is df and spread_rows(df, 5).rdd.getNumPartitions() == 5


def test_rank_with_several_files_per_partition(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k long")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        got = {r.id: r["rank"] for r in exact_rank(df, ["k", "id"], num_partitions=4).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    want = {i: pos for pos, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1)}
    assert got == want


def test_boundaries_through_all_levels(spark, monkeypatch):
    """Few collected keys, few digits, and copies that no digit tells apart."""
    from versio.operators import sampling as S
    rows = [(i, 0) for i in range(300)] + [(7, j) for j in range(1, 200)]
    df = spark.createDataFrame(rows, "id long, row_key long").withColumn("key", S.order_key(spark.createDataFrame(rows, "id long, row_key long"), 5))
    want = sorted(rows, key=lambda r: (hashlib.md5(f"5:{r[0]}".encode()).hexdigest(), r))
    places = [1, 2, 50, 100, 250, 333, 400, 498, 499]
    for few, digits in ((4096, 4), (3, 1), (1, 1)):
        monkeypatch.setattr(S, "COLLECTED_KEYS", few)
        monkeypatch.setattr(S, "BUCKET_DIGITS", digits)
        total, at = S.boundary_keys(df, "key", lambda n: places)
        assert total == 499 and sorted(at) == places
        for p in places:
            assert df.where(F.col("key") <= at[p]).count() == p
            assert [tuple(r) for r in df.where(F.col("key") == at[p]).select("id", "row_key").collect()] == [want[p - 1]]
