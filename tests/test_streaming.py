from conftest import SF

from voxelframe.plans.fixtures import table
from voxelframe.streaming import arrivals


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream(spark):
    return spark.readStream.schema(table(spark, SF, "events").schema).parquet(f"{SF}/{{events}}.parquet")


def test_stream_equals_batch(spark):
    got = run(spark, arrivals.latest(arrivals.arrivals(stream(spark))), "latest", "complete")
    want = arrivals.latest(arrivals.arrivals(table(spark, SF, "events")))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_windows_and_duplicates(spark):
    seen = run(spark, arrivals.windowed(arrivals.arrivals(stream(spark))), "windows", "complete")
    assert seen.groupBy().sum("n").first()[0] == table(spark, SF, "events").count()
    once = run(spark, arrivals.deduplicated(arrivals.arrivals(stream(spark)), "3650 days"), "once", "append")
    assert once.count() == arrivals.arrivals(table(spark, SF, "events")).select("cx", "cy", "cz", "state").distinct().count()


def test_tracked_states_follow_the_reports(spark):
    q = arrivals.tracked(arrivals.arrivals(stream(spark)), None).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.cx, r.cy, r.cz): (r.state, r.n_reports) for r in spark.table("tracked").collect()}
    want = {(r.cx, r.cy, r.cz): (r.state, r.n_reports) for r in arrivals.latest(arrivals.arrivals(table(spark, SF, "events"))).collect()}
    assert got == want
