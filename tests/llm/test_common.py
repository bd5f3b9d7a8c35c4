import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import common


def test_slices_are_bounded_by_rows_and_bytes(spark):
    def sizes(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    many = common.map_batches(spark.range(5000).coalesce(1), "rows long, bytes long", sizes).collect()
    assert sum(r.rows for r in many) == 5000 and max(r.rows for r in many) <= common.ROWS_AT_ONCE
    long = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    got = common.map_batches(long, "rows long, bytes long", sizes).collect()
    assert sum(r.rows for r in got) == 40 and max(r.bytes for r in got) <= common.BYTES_AT_ONCE
    huge = spark.range(1).select(F.repeat(F.lit("x"), 3_000_000).alias("t"))
    assert [r.rows for r in common.map_batches(huge, "rows long, bytes long", sizes).collect()] == [1]


def test_workers_ready_only_lowers(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(name, given)
            common.workers_ready(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_broadcast_only_within_the_limit(spark):
    df = spark.range(100)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(common.broadcast_if_small(df, F.lit(8), 800))
    assert not hinted(common.broadcast_if_small(df, F.lit(8), 799))
    assert hinted(common.broadcast_if_small(df.where("false"), F.lit(8), 0))


def test_written_and_checkpointed_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "i long, s string, a array<double>")
    for cut in (common.written(df), common.checkpointed(df)):
        assert cut.schema == df.schema and sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))
    assert common.written(df.where("false")).count() == 0


def test_hex_of_long(spark):
    got = spark.createDataFrame([(0,), (-1,), (255,)], "x long").select(common.hex_of_long(F.col("x"))).collect()
    assert [r[0] for r in got] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]


def test_a_worker_keeps_one_operators_memory(spark):
    made = []

    def make(x):
        made.append(x)
        return x

    assert [common.kept("one", 1, lambda: make("a")) for _ in range(2)] == ["a", "a"] and made == ["a"]
    common.forget_others("one")
    assert common.kept("one", 1, lambda: make("b")) == "a"
    common.forget_others(None)
    assert common.kept("one", 1, lambda: make("c")) == "c"
    assert common.kept("two", 1, lambda: make("d")) == "d" and len(common._kept) == 1
    common.forget_others(None)
    assert not common._kept

    def holding(batch):
        before = len(common._kept)
        common.kept("three", 0, object)
        return pa.RecordBatch.from_arrays([pa.array([before])], names=["before"])

    def seen(batch):
        return pa.RecordBatch.from_arrays([pa.array([len(common._kept)])], names=["before"])

    rows = spark.range(8).repartition(4)
    common.map_batches(rows, "before long", holding, keeps="three").collect()
    assert all(r.before == 0 for r in common.map_batches(rows, "before long", seen).collect())


def test_workers_ready_lowers_the_rows_of_a_parquet_read(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        for set_to, then in (("4096", common.READ_ROWS), ("7", 7)):
            spark.conf.set(name, set_to)
            common.workers_ready(spark)
            assert int(spark.conf.get(name)) == then
    finally:
        spark.conf.set(name, before)
