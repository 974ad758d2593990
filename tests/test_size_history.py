"""Size histories: politicians of many trades are dealt once and worked out as a group; beyond a task's size they meet their history."""

import numpy as np

from civicledger.operators import signals as G
from test_round_three import ROWS, TRADES, exchanges


def test_order_of_what_is_earlier():
    rng = np.random.default_rng(3)
    for n, days, sizes in ((0, 1, 1), (1, 1, 1), (40, 5, 3), (300, 40, 200), (257, 300, 1), (500, 9, 64)):
        day, value, counts = rng.integers(0, days, n), rng.integers(0, sizes, n) / 2, rng.random(n) < 0.8
        got = G.grouped_history()[0](day, value, counts)
        for i in range(n):
            earlier = value[counts & (day < day[i])]
            want = (len(earlier), np.median(earlier) if len(earlier) else got[1][i], (earlier < value[i]).sum(), (earlier == value[i]).sum())
            assert tuple(g[i] for g in got) == want


def test_grouped_joined_and_mixed_histories_are_alike(spark, table, monkeypatch):
    trades = table(TRADES, *ROWS)
    results = []
    for carried, grouped in ((256, 1 << 18), (0, 1 << 18), (0, 0), (0, 2)):
        monkeypatch.setattr(G, "CARRIED_TRADES", carried)
        monkeypatch.setattr(G, "GROUPED_TRADES", grouped)
        out = G.size_signal(trades, "2001-01-01", min_history=1)
        results.append(sorted(map(str, out.select(*sorted(out.columns)).collect())))
        if (carried, grouped) == (0, 1 << 18):
            assert exchanges(out) == 1 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert results[0] == results[1] == results[2] == results[3] and len(results[0]) == len(ROWS)


def test_group_functions_travel_with_the_job():
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    sent = pickle.dumps(cloudpickle.dumps(G.grouped_history()[1]))
    told = f"import pickle; print(callable(pickle.loads(pickle.loads({sent!r}))))"
    assert subprocess.run([sys.executable, "-c", told], cwd="/", env={"PYTHONPATH": ""}, capture_output=True, text=True).stdout.strip() == "True"
