"""Classes against the quartiles of earlier rows, by brute force, and what the plan holds at once."""

import datetime
import random

import numpy as np

from pulsegrid.operators import windows as W

DAY = datetime.date(2024, 1, 1)


def brute(rows, days, least):
    got = {}
    for e, day, ident, x in rows:
        past = [r for r in rows if r[0] == e and day and r[1] and day - datetime.timedelta(days) <= r[1] <= day and (r[1], r[2]) < (day, ident)]
        values = [r[3] for r in past]
        if e is None or x is None or len(past) < least:
            got[ident] = "unknown"
        elif None in values or not [v for v in values if v == v]:
            got[ident] = "typical"
        else:
            low, high = np.quantile([v for v in values if v == v], [0.25, 0.75])
            got[ident] = "above" if x > high else "below" if x < low else "typical"
    return got


def test_classes_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(900):
        x = r.choice([None, float("nan")]) if r.random() < 0.004 else r.uniform(0, 100)
        rows.append((r.choice(["a", "b", "c", None]), None if r.random() < 0.02 else DAY + datetime.timedelta(r.randrange(-40, 400)), f"{i:04d}", x))
    df = spark.createDataFrame(rows, "entity string, day date, id string, load double")
    for days, least in ((60, 5), (7, 2)):
        out = W.rolling_class(df, ["entity"], "day", ["id"], "load", days, least)
        got = {x.id: x.effort for x in out.collect()}
        want = brute(rows, days, least)
        nan = {i for _, _, i, x in rows if x is not None and x != x}
        assert out.columns == [*df.columns, "effort"] and len(got) == len(rows)
        assert {k: v for k, v in got.items() if k not in nan} == {k: v for k, v in want.items() if k not in nan}


def test_no_frame_is_copied_for_each_row(spark):
    df = spark.createDataFrame([("a", DAY, "1", 1.0)], "entity string, day date, id string, load double")
    assert "collect_list" not in W.rolling_class(df, ["entity"], "day", ["id"], "load")._jdf.queryExecution().toString()
