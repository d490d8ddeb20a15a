import os

import pytest

from leafmill.llm import _util


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, *_):
        return self.value

    def getConf(self):  # noqa: N802 - the name that a context has
        return self


class _Session:
    def __init__(self, master, folder):
        self.conf = self.sparkContext = _Conf(folder)
        self.sparkContext.master, self.sparkContext.applicationId = master, "app"


def test_shared_folder_is_the_session_s():
    assert _util.shared_dir(_Session("spark://x", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("spark://x", "yarn", "local-cluster[1,1,1024]"):
        with pytest.raises(ValueError):
            _util.shared_dir(_Session(master, None))


def test_stage_writes_and_reads_back(spark):
    df = spark.range(5).selectExpr("id", "CAST(null AS string) AS s", "array(id) AS a")
    got = _util.stage(df)
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(got.collect()) == sorted(df.collect())
    assert got.inputFiles()[0].startswith("file:") and _util.stage(df.limit(0)).count() == 0


def test_finished_removes_what_was_staged_on_the_way(spark):
    made = []

    def make():
        made.append(_util.stage(spark.range(3)))
        made.append(_util.stage(made[0].selectExpr("id + 1 AS id")))
        return made[1].where("id > 1")

    kept = _util.stage(spark.range(2))
    out = _util.finished(make)
    assert sorted(r["id"] for r in out.collect()) == [2, 3] and kept.count() == 2
    assert not any(os.path.exists(f.removeprefix("file://")) for x in made for f in x.inputFiles())
