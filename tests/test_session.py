from pathlib import Path
from types import SimpleNamespace

import pytest

from tallyfield.operators.ranking import global_rank
from tallyfield.session import ensure_checkpoint_dir


def _fake(master, shared=None, current=None):
    chosen = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: current, setCheckpointDir=chosen.append
    )
    conf = SimpleNamespace(get=lambda key, default: shared if shared else default)
    return SimpleNamespace(sparkContext=context, conf=conf), chosen


def test_the_named_folder_is_taken():
    spark, chosen = _fake("spark://host:7077", shared="hdfs:///work")
    ensure_checkpoint_dir(spark)
    assert chosen == ["hdfs:///work"]


def test_a_folder_already_set_stays():
    spark, chosen = _fake("local[2]", shared="/other", current="/set")
    ensure_checkpoint_dir(spark)
    assert chosen == []


def test_only_a_local_session_chooses_its_own():
    spark, chosen = _fake("local[2]")
    ensure_checkpoint_dir(spark)
    assert len(chosen) == 1
    for master in ("yarn", "local-cluster[2,1,1024]"):
        spark, _ = _fake(master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(spark)


def test_checkpoints_go_to_the_named_folder(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS v")
    assert global_rank(df, "v", "place").count() == 10
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    assert any(folder.rglob("part-*"))
