import random

import pytest

from strandloom.operators.decompose import decompose
from strandloom.operators.staged import decompose_staged
from strandloom.plans.options import Options
from tests.test_cover import mosaic


@pytest.mark.parametrize("smooth", [True, False])
def test_stages_match_the_kernel(spark, smooth):
    rnd = random.Random(9)
    rows = [(k, mosaic(rnd, rnd.choice([0, 0.05, 0.2]))) for k in range(60)] + [(100, "A" * 30), (101, ""), (102, None), (103, "ACGTGGCCACGT"), (104, "acacacagag"), (105, "C")]
    reads = spark.createDataFrame(rows, "read_id int, seq string")
    opts = Options(max_unit=19, smooth=smooth)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = decompose(reads, opts)
    assert key(decompose_staged(reads, opts).select(want.columns)) == key(want)
