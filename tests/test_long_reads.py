import random

import numpy as np
import pytest

from strandloom.functions import kernel, stretch
from strandloom.operators.long_reads import align_long
from tests.test_cover import erring


def runs_of(labels):
    cut = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [(a, b, int(labels[a])) for a, b in zip(cut, cut[1:], strict=False)]


def made(rnd, units, n):
    return erring(rnd, "".join(rnd.choice(units) * rnd.randint(1, 8) for _ in range(n)), rnd.choice([0, 0.1, 0.3]))


def test_stretches_multiply(spark):
    rnd = random.Random(1)
    for _ in range(30):
        units = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(1, 4))]
        cells = stretch.Cells([kernel.encode(u) for u in units])
        codes = kernel.encode(made(rnd, units, 6))
        cut = rnd.randint(0, len(codes))
        zero = np.zeros(cells.count, np.int64)
        both = (zero[:, None] + cells.matrix(codes[:cut])).max(axis=0)
        both = (both[:, None] + cells.matrix(codes[cut:])).max(axis=0)
        assert (both == cells.traced(codes, zero)[0]).all()


@pytest.mark.parametrize("size", [7, 50, 20_000])
def test_labels_are_those_of_one_alignment(spark, size):
    rnd = random.Random(2)
    reads, units, want = [], [], {}
    for k in range(40):
        own = list(dict.fromkeys("".join(rnd.choice("ACGT") for _ in range(rnd.randint(2, 6))) for _ in range(rnd.randint(1, 4))))
        seq = made(rnd, own, rnd.randint(1, 12)) if k % 5 else "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 60)))
        reads.append((k, seq if k % 3 else seq.lower()))
        units += [(k, i, u) for i, u in enumerate(own)]
        labels = kernel.label_batch([kernel.encode(seq)], [[kernel.encode(u) for u in own]], False)[0]
        want[k] = [] if labels[0] < 0 else runs_of(labels)
    reads += [(100, ""), (101, None), (102, "ACAC")]
    units += [(100, 0, "AC"), (103, 0, "AC")]
    got = align_long(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(units, "read_id long, label int, unit string"), size).collect()
    for k in [*want, 100, 101, 102]:
        assert sorted((r.start, r.end, r.label) for r in got if r.read_id == k) == want.get(k, [])
