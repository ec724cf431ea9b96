"""Counts by two values at once look at the values once."""

from stallkeeper.functions.counts import counts_within


def test_values_are_read_once(spark):
    rows = [(float(i % 17), float(i * 7 % 23)) for i in range(400)]
    seen = spark.sparkContext.accumulator(0)

    def through(row):
        seen.add(1)
        return row

    values = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(through), "x double, y double")
    probes = [("a", 8.0, 11.0), ("b", float("inf"), 5.0), ("c", -1.0, 3.0)]
    found = counts_within(values, spark.createDataFrame(probes, "id string, xa double, ya double"), "x", "xa", "y", "ya", "id").collect()
    expected = {i: (sum(x <= xa for x, _ in rows), sum(x <= xa and y < ya for x, y in rows), len(rows)) for i, xa, ya in probes}
    assert {r.id: (r.upto, r.within, r.of) for r in found} == expected
    assert seen.value == len(rows)
