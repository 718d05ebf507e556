from quirespark.llm import _store


def test_tables_live_in_the_shared_folder_until_released(spark):
    df = _store.materialise(spark, spark.range(10), "ids")
    assert df.count() == 10 and _store.path_of(df).startswith(_store.shared_dir(spark))
    assert _store.read_shared(_store.path_of(df), ["id"]).num_rows == 10
    other = _store.materialise(spark, spark.range(3), "ids")
    _store.discard(spark, other)
    _store.release(spark)
    jvm = spark.sparkContext._jvm
    for t in (df, other):
        where = jvm.org.apache.hadoop.fs.Path(_store.path_of(t))
        assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "Kept int, kept_ int")
    assert _store.unused(df, "kept", "n", "N") == ["kept__", "n", "N_"]


def test_passing_deletes_what_is_not_kept(spark):
    with _store.passing(spark) as outer:
        with _store.passing(spark) as keep:
            a, b = (_store.materialise(spark, spark.range(3), "ids") for _ in "ab")
            keep(a)
        assert a.count() == 3
        c = _store.materialise(spark, a, "ids")
        outer(c)
    jvm = spark.sparkContext._jvm
    there = [jvm.org.apache.hadoop.fs.Path(_store.path_of(t)) for t in (a, b, c)]
    assert [p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) for p in there] == [False, False, True]


def test_a_cluster_needs_a_shared_folder():
    import pytest

    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://head:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _store.shared_dir(Session)
