"""Areas and events in one job come to what each comes to alone."""

import numpy as np
from pyspark.sql import functions as F

from inundata.operators import validate
from inundata.plans.workloads import patch_flood_map


def test_patch_map_of_each_event_is_its_own(spark):
    rng = np.random.default_rng(3)
    rows = [
        (event, time, r, c, float(rng.normal(-14, 3)), float(rng.normal(-20, 3)))
        for event, times in (("a", (1, 2, 3)), ("b", (5, 7, 8, 9))) for time in times for r in range(9) for c in range(8 if event == "a" else 11)
    ]
    stack = spark.createDataFrame(rows, "event string, time int, row int, col int, vv_db double, vh_db double")
    darker = lambda: lambda x: np.where((x[:, 0] < x[:, 2]) & (x[:, 0] < x[:, 4]), 2, 0)
    both = patch_flood_map(stack, darker, 4, (0, 1), ("event",)).collect()
    assert len(both) == 9 * 8 + 9 * 11
    for event in "ab":
        alone = patch_flood_map(stack.where(F.col("event") == event).drop("event"), darker, 4, (0, 1)).collect()
        got = sorted((r.row, r.col, r.cls, r.flooded) for r in both if r.event == event)
        assert got == sorted((r.row, r.col, r.cls, r.flooded) for r in alone)
        assert any(r[3] for r in got)


def test_accuracy_of_each_event_is_its_own(spark):
    value = lambda seed: [(k % 2, k // 2, 0, x) for k, x in enumerate(np.random.default_rng(seed).choice([0.0, 1.0, None], 200).tolist())]
    truth, map_, inside = (spark.createDataFrame(value(s), "event int, row int, col int, value double") for s in (1, 2, 3))
    pairs = validate.compared(truth, map_, inside, keys=("event",))
    measures = {r.event: r for r in validate.accuracy_metrics(pairs, ("event",)).collect()}
    shares = {(r.event, r.truth, r.pred): (r.n, r.percent) for r in validate.confusion_percent(pairs, ("event",)).collect()}
    for event in (0, 1):
        alone = validate.compared(*[d.where(F.col("event") == event).drop("event") for d in (truth, map_, inside)])
        m = validate.accuracy_metrics(alone).first()
        assert tuple(measures[event])[1:] == tuple(m)
        assert {(r.truth, r.pred): (r.n, r.percent) for r in validate.confusion_percent(alone).collect()} == {k[1:]: x for k, x in shares.items() if k[0] == event}
    assert validate.confusion_matrix(pairs.limit(0), ("event",)).count() == 0
