"""Dense numbering inside groups, with a key that holds a third of the rows."""

from pyspark.sql import functions as F

from cataloom.operators.sequence import number_within


def test_hot_key_is_numbered_densely_across_partitions(spark):
    n = 30_000
    df = (spark.range(n)
          .withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") % 997).cast("int")))
          .withColumn("o", (F.col("id") * 7919) % n))
    out = number_within(df, ["k"], ["o"], "rn")
    pdf = out.toPandas()
    want = pdf.sort_values(["k", "o"]).groupby("k").cumcount() + 1
    assert (pdf.sort_values(["k", "o"])["rn"].to_numpy() == want.to_numpy()).all()
    # the hot group was really split over several partitions
    hot = (df.repartitionByRange(8, "k", "o").where("k = 7")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert hot > 1


def test_global_numbering(spark):
    df = spark.range(5000).withColumn("o", (F.col("id") * 31) % 5000)
    rows = number_within(df, [], ["o"], "rn").select("o", "rn").collect()
    assert sorted((r.o + 1) for r in rows) == sorted(r.rn for r in rows)
    assert all(r.o + 1 == r.rn for r in rows)


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (None, 4)], "k int, o int")
    got = sorted((r.k, r.o, r.rn) for r in number_within(df, ["k"], ["o"], "rn").collect()
                 if r.k is not None) + sorted(
        (r.o, r.rn) for r in number_within(df, ["k"], ["o"], "rn").collect() if r.k is None)
    assert got == [(1, 3, 1), (1, 1), (2, 2), (4, 3)]
