import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators.decompose import decompose
from strandloom.streaming.state import ROCKS, stream_library


@pytest.mark.parametrize("files", [1, 4])
def test_library_of_a_stream_survives_restarts(spark, tmp_path, files):
    """The same counts and spellings in any split into batches, also when the query is stopped and started anew between them."""
    rnd = random.Random(10)
    rows = [(k, "".join(rnd.choice(["AC", "CA", "AGG", "GGA", "ACGTC"]) * rnd.randint(4, 9) for _ in range(2))) for k in range(40)]
    want = {}
    for r in decompose(spark.createDataFrame(rows, "read_ord long, seq string"), key="read_ord").select("read_ord", F.explode("units.unit").alias("unit")).select("read_ord", "unit", dna.canon(F.col("unit")).alias("canon")).collect():
        n, first = want.get(r.canon, (0, (10**9, "")))
        want[r.canon] = n + 1, min(first, (r.read_ord, r.unit))
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.canon] = r.freq, (r.first_ord, r.unit)

    try:
        for k in range(files):
            spark.createDataFrame(rows[k::files], "read_ord long, seq string").write.mode("append").json(str(tmp_path / "in"))
            reads = spark.readStream.schema("read_ord long, seq string").json(str(tmp_path / "in"))
            q = stream_library(reads).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want
