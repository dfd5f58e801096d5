"""Tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docweave import storage


def test_no_folder_of_one_machine_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    for master, ok in (("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)):
        spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"test-{master}", getConf=lambda: conf))
        if ok:
            assert storage.shared_dir(spark).startswith("file://") and storage.shared_dir(spark) == storage.shared_dir(spark)
        else:
            with pytest.raises(RuntimeError):
                storage.shared_dir(spark)


def test_stored_tables_and_sized_joins(spark, monkeypatch):
    t = storage.stored(spark.range(50).withColumn("v", F.lit("x")), "numbers", by="v")
    path = t.inputFiles()[0].removeprefix("file://")
    assert t.count() == 50 and os.path.exists(path) and storage.bytes_of(t) > 0
    plan = lambda: storage.join_sized(spark.range(9), t, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 10)
    assert "broadcast" not in plan()
    assert storage.dropped(spark) >= 1 and not os.path.exists(path) and storage.dropped(spark) == 0
