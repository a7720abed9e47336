"""Tables of one run are its own."""

import os
import threading

from chatloom.operators import tables


def test_runs_leave_each_other_alone(spark):
    outside = tables.materialize(spark.range(3), "outside")
    before = list(tables.made())
    results = {}

    def run(n):
        with tables.own_tables() as written:
            tables.materialize(spark.range(n), "first")
            kept = tables.materialize(spark.range(n), "second")
            tables.release(spark, 0, keep=[written[-1]])
            results[n] = (kept, list(written))

    threads = [threading.Thread(target=run, args=(n,)) for n in (4, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    run(6)
    assert outside.count() == 3 and tables.made() == before
    for n, (kept, written) in results.items():
        assert kept.count() == n and len(written) == 1
        assert os.path.isdir(written[0].removeprefix("file://"))


def test_catalogue_entries_go_with_their_folders(spark):
    with tables.own_tables():
        path = tables.fresh_path(spark, "bucketed")
        tables.CATALOGUED[path] = "held_for_a_test"
        spark.range(9).write.bucketBy(2, "id").option("path", path).saveAsTable("held_for_a_test")
        assert spark.catalog.tableExists("held_for_a_test")
        tables.release(spark)
    assert not spark.catalog.tableExists("held_for_a_test") and path not in tables.CATALOGUED
