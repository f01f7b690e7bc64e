"""Numbers of segments in many ranges."""

from pyspark.sql import functions as F

from termweave.operators import review as R


def test_removed_file_in_many_ranges(spark):
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 20_000, 1, 8)
        text = F.repeat(F.sha2(F.col("id").cast("string"), 256), 3)
        rows = ids.select((F.col("id") * 7 % 20_011).alias("seg_ord"), F.concat(F.lit("s"), "id").alias("sid"), F.when(F.col("id") % 4 == 0, "old").otherwise("f").alias("file"), text.alias("source"), text.alias("target"))
        left, kept = R.remove_file(rows, rows.where("seg_ord % 5 = 0").select("sid", F.lit("X").alias("text")), "old")
        stay = sorted((r["seg_ord"], r["sid"]) for r in rows.where("file = 'f'").select("seg_ord", "sid").collect())
        assert [r["sid"] for r in kept.select("sid").orderBy("sid").collect()] == sorted(s for n, s in stay if n % 5 == 0)
        assert [(r["seg_ord"], r["sid"]) for r in left.select("seg_ord", "sid").orderBy("seg_ord").collect()] == [(i, s) for i, (_, s) in enumerate(stay)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
