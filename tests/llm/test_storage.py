from pathlib import Path
from types import SimpleNamespace

import pytest

from sparklith.llm import ann, lm, minhash, quality, storage, substring, warc

SF = "/root/testdata/sf0.001"


def fake(master, conf=None, checkpoint=None):
    found = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: found))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf), sparkContext=SimpleNamespace(master=master, _jsc=jsc))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(fake("spark://host:7077"))
    assert storage.shared_root(fake("yarn", conf="hdfs://x/y/")) == "hdfs://x/y"
    assert storage.shared_root(fake("yarn", checkpoint="hdfs://x/c")) == "hdfs://x/c"


def test_nothing_is_left_after_release(spark):
    storage.release()
    root = Path("/" + storage.shared_root(spark).removeprefix("file:").lstrip("/"))
    before = set(root.iterdir())
    for query in (warc.op1_warc, minhash.op3_minhash, lm.op5_kneser_ney, ann.op6_ann, substring.op7_substring, quality.op8_quality_qda):
        assert query(spark, SF).count() and set(root.iterdir()) > before
        storage.release()
        assert set(root.iterdir()) == before, query
