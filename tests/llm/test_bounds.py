"""What the operators hold: memory of a cell's join."""

import tracemalloc

import numpy as np

from eventloom.llm import copies


def test_join_of_a_cell_takes_little_beside_its_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400_000, dtype=np.uint64)
    sets = [np.unique(base[i : i + 2200]) for i in range(0, 400_000, 2000)]
    tracemalloc.start()
    links = copies.join_cell(sets + [sets[0][1:]], None, 80, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links in ([(0, 200)], [(200, 0)]) and peak < 4 * sum(s.nbytes for s in sets)  # one sort of all took over 7 times
