import ctypes
import re

import numpy as np
import pytest

from tracelake.llm import common, packing


def _held_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024


def test_a_task_lets_go_of_other_operators_tables():
    made = []
    common.TABLES.append(lambda: made.append(True))
    try:
        assert packing.shared_ids.cache_clear in common.TABLES
        assert list(common.lean(lambda batches: (2 * x for x in batches))([1, 2])) == [2, 4]
        assert made == [True]
    finally:
        common.TABLES.pop()


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only this C library gives memory back when asked")
def test_a_task_gives_its_memory_back():
    def run(batches):
        for n in batches:
            # Many small pieces, the last of which stays: memory below it is not given back unless asked for.
            parts = [np.ones(2000) for _ in range(n)]
            stays.append(parts[-1])
            yield n

    held = []
    for wrap in (lambda f: f, common.lean):
        stays = []
        assert list(wrap(run)([20_000])) == [20_000]
        held.append(_held_mb())
    assert held[1] < held[0] - 200
