from pyspark.sql import functions as F

from tonearm import session
from tonearm.operators import cascade


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_table_is_not_sent_out_by_the_size_of_its_files(spark):
    """200,000 rows of one text take some kB on disk and over 10 MB as rows."""
    many = session.store(spark.range(200_000).withColumn("text", F.lit("the same text in every row, which packs to nothing")))
    few = session.store(spark.range(100))
    assert "BroadcastHashJoin" not in plan(spark.range(5).join(many, "id", "left"))
    assert "BroadcastHashJoin" in plan(spark.range(5).join(few, "id", "left"))


def test_keyed_rows_and_names_are_not_sent_out(spark, tmp_path):
    """Small files on either side: the rows for each tier are many times what the files take."""
    cols = "rid long, primary_key string, audio_id string, artist string, title string, album string, filesize string, playtime_float string, file string, dir string"
    sides = []
    for side, first in (("old", 0), ("new", 1000)):
        spark.createDataFrame([(first + i, f"k{first + i}", "", f"a{i}", f"t{i}", "", "1000", "100.0", f"{i}.mp3", "/:p/:") for i in range(50)], cols).write.parquet(f"{tmp_path}/{side}")
        sides.append(spark.read.parquet(f"{tmp_path}/{side}"))
    reviewed = cascade.review_rows(*sides, "filename")
    for df in (cascade.match(*sides, "filename"), cascade.candidates(*sides, "loose"), reviewed):
        assert "SortMergeJoin [rank#" in plan(df)
    assert "SortMergeJoin [rid#" in plan(reviewed) and "SortMergeJoin [new_rid#" in plan(reviewed)
    assert [tuple(r) for r in reviewed.groupBy("status", "confidence").count().collect()] == [("matched", "Strong", 50)]


def test_what_is_little_may_be_sent_out_under_a_low_threshold(spark):
    """Under 8 MB as rows the planner decides by the files, above that it does not, whatever the session's threshold."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        few, many = (session.store(spark.range(n).withColumn("text", F.lit("the same text in every row"))) for n in (20_000, 150_000))
        assert "BroadcastHashJoin" in plan(spark.range(5).join(few, "id", "left"))
        assert "BroadcastHashJoin" not in plan(spark.range(5).join(many.where("text is not null").select("id").distinct(), "id", "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
