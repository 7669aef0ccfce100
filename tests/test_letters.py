"""match_frequency and consensus_unit over whole texts, against brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillon.functions import sequence
from quillon.plans import driver_tables


def test_whole_texts(spark, tmp_path):
    r = random.Random(6)
    texts = ["", "xyz", "acgta", "ACGTAC", "acg" * 60 + "tt - " * 200, "A cat " * 400]
    texts += ["".join(r.choice("acgtACGTn .é") for _ in range(r.randint(1, 900))) for _ in range(20)]
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, units = {}, {}
    for i, text in [*enumerate(texts), (99, "")]:
        seq = re.sub("[^ACGT]", "", text.upper())
        for p in range(2, 21):
            same = sum(a == b for a, b in zip(seq, seq[p:])) if p <= len(seq) // 2 else 0
            want[i, p] = (same, same / (len(seq) - p) if same else 0.0)
        if len(seq) >= 6:
            units[i] = "".join(max((n, c) for c, n in Counter(seq[k::3]).items())[1] for k in range(3))
    got = driver_tables.match_frequency(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(x.doc_id, x.period): (x.matches, x.frequency) for x in got} == want
    assert sorted(map(tuple, driver_tables.consensus_unit(spark, str(tmp_path)).collect())) == sorted(units.items())
    rows = driver_tables._letters(spark, str(tmp_path)).where("doc_id < 99").select("doc_id", sequence.matches_at_offset("seq", 3).alias("n"), sequence.match_frequency("seq", F.lit(3)).alias("f"))
    assert {(x.doc_id, 3): (x.n, x.f) for x in rows.collect()} == {k: v for k, v in want.items() if k[1] == 3 and k[0] < 99}
