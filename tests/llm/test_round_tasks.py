"""Rounds over few rows take few tasks, however many shuffle partitions there are; many rows take the joins, with the same results."""

import uuid

import pytest

from loomstrand.llm import common, components

PATHS = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (5, 5), (1, 2)]
ROOTS = {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200, 202: 200}


@pytest.fixture
def partitions(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield 64
    for k, v in before.items():
        spark.conf.set(k, v)


def test_tasks_of_small_components(spark, partitions):
    group, tracker = str(uuid.uuid4()), spark.sparkContext.statusTracker()
    links = common.materialise(spark.createDataFrame(PATHS, "a long, b long"))
    spark.sparkContext.setJobGroup(group, "components")
    try:
        found = {r.node: r.root for r in components.components(links).collect()}
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == ROOTS
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert 0 < tasks <= 8 * partitions


def test_components_beyond_what_is_broadcast(spark, partitions, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", -1)
    monkeypatch.setattr(common, "PART_ROWS", 1)
    assert {r.node: r.root for r in components.components(spark.createDataFrame(PATHS, "a long, b long")).collect()} == ROOTS
