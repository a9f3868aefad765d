"""Session helpers: intermediate data goes under the session's checkpoint folder."""

import os
import re
from types import SimpleNamespace

import pytest

from claimspark import session
from claimspark.session import checkpointed, delete_dir, ensure_checkpoint_dir, shared_dir, stored


def test_shared_dir_lives_under_the_checkpoint_folder(spark):
    base = ensure_checkpoint_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a.startswith(base.rstrip("/") + "/claimspark/x-") and a != b


def test_checkpointed_cuts_lineage_and_keeps_rows(spark):
    df = spark.range(0, 100).selectExpr("id", "id * 2 AS twice").filter("id % 7 = 0")
    cp = checkpointed(df)
    assert sorted(cp.collect()) == sorted(df.collect())
    plan = cp._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # reads the checkpoint, not the original plan


def test_a_cluster_without_a_shared_folder_is_an_error():
    def fake(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))

    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(fake(master))
    assert session.is_local(fake("local")) and session.is_local(fake("local[4]"))


def test_written_tables_can_be_deleted(spark):
    assert stored(spark.range(5), "five").count() == 5
    path = shared_dir(spark, "six")
    spark.range(6).write.parquet(path)
    folder = re.sub("^file:/*", "/", path)
    assert os.path.isdir(folder)
    delete_dir(spark, path)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        delete_dir(spark, "/tmp")


def _stored_folders(spark):
    import glob
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return set(glob.glob(f"{base}/claimspark/*"))


def test_scratch_deletes_what_was_stored_inside(spark):
    from claimspark.session import scratch, stored
    before = _stored_folders(spark)
    outside = stored(spark.range(3), "outside")
    mine = _stored_folders(spark) - before
    with scratch(spark) as outer:
        stored(spark.range(5), "a")
        with scratch(spark) as inner:
            stored(spark.range(7), "b")
            kept = inner.kept(spark.range(9), "c")
        assert kept.count() == 9 and len(_stored_folders(spark) - before - mine) == 2  # a and c
        last = outer.kept(kept, "d")
    assert _stored_folders(spark) - before - mine == {outer.last.removeprefix("file:")}
    assert last.count() == 9 and outside.count() == 3
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(spark.range(5), "e")
        raise ZeroDivisionError
    assert len(_stored_folders(spark) - before - mine) == 1


def test_the_ingest_leaves_no_shuffle_files(spark, monkeypatch):
    """They would take twice the room of the claims for as long as the session lasts."""
    from claimspark.sources import mapping

    freed = []
    monkeypatch.setattr(mapping, "free_shuffles", lambda s: freed.append(s))
    mapping.forget(spark, "/root/testdata/sf0.001")
    mapping.load_tables(spark, "/root/testdata/sf0.001", materialize=True)
    assert freed == [spark]
