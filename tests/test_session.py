"""What the session helpers leave behind."""

import time

from pyspark.sql import functions as F

from transitlapse.session import cut_lineage, shuffles_removed, working_tables


def shuffle_files(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


def there(spark, table) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(table._jdf.queryExecution().analyzed().relation().location().rootPaths().apply(0).toString())
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_shuffles_that_led_to_a_table_go_when_it_is_written(spark):
    wide = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    table = cut_lineage(wide.join(wide.withColumnRenamed("n", "m"), "k").repartition(3, "m"))
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 100 and wide.count() == 100


def test_the_setting_ends_with_the_last_block(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    with shuffles_removed(spark):
        with shuffles_removed(spark):
            pass
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == was


def test_working_tables_go_with_their_block_but_for_kept_ones(spark):
    with working_tables(spark) as keep:
        with working_tables(spark) as keep_inner:
            lost = cut_lineage(spark.range(10))
            handed_on = keep_inner(cut_lineage(lost.selectExpr("id * 2 AS id")))
            dropped_later = keep_inner(cut_lineage(spark.range(3)))
        assert not there(spark, lost) and there(spark, handed_on) and there(spark, dropped_later)
        kept = keep(cut_lineage(handed_on.where("id > 4")))
    assert there(spark, kept) and kept.count() == 7
    assert not there(spark, handed_on) and not there(spark, dropped_later)
    free = cut_lineage(spark.range(4))
    assert there(spark, free)
