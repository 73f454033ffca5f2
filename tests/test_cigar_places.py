"""Places of bases on the reference and back, by walking alignments by hand; no array of elements is built for it."""

import random

from pyspark.sql import functions as F

from siteloom.functions import cigar as C


def test_places_by_hand(spark):
    rng = random.Random(8)
    rows = [(100, [(rng.randrange(9), rng.randint(0, 6)) for _ in range(rng.randint(0, 6))], rng.randint(-2, 22)) for _ in range(400)]
    df = spark.createDataFrame(rows, "pos long, cigar array<struct<op:int,len:int>>, at int")
    got = df.select(C.to_reference(F.col("pos"), F.col("cigar"), F.col("at")), C.to_sequence(F.col("pos"), F.col("cigar"), F.col("pos") + F.col("at"))).collect()
    for (pos, cigar, asked), found in zip(rows, got):
        at = on = 0
        to, back = {}, {}
        for op, n in cigar:
            if op in (0, 7, 8):
                for k in range(n):
                    to[at + k], back[on + k] = pos + on + k, at + k
            at += n * (op in (0, 1, 4, 7, 8))
            on += n * (op in (0, 2, 3, 7, 8))
        assert tuple(found) == (to.get(asked), back.get(asked)), cigar
    assert "concat" not in str(C.to_reference(F.col("pos"), F.col("cigar"), F.col("at")))
