from __future__ import annotations

import random

import pytest

#: Columns whose names the operators use inside; they must not get in the way.
CLASHES = {"same": "x", "uid": 1, "c": 2.0, "words": "w", "registers": None}


def frame(spark, rows, schema, clash=True):
    """Rows with columns of clashing names behind them."""
    df = spark.createDataFrame(rows, schema)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    return df


@pytest.fixture
def texts():
    """Ids and texts: copies, near copies, shared passages, nulls, empty and long texts, repeated rows and ids."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)] + ["é", "ñandú", "日本"]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    passage = prose(70)
    base = prose(300)
    rows = [(i, prose(rnd.randint(1, 120))) for i in range(20)]
    rows += [(20 + i, base) for i in range(4)]
    for i in range(12):
        words = base.split()
        for _ in range(i):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((30 + i, " ".join(words)))
    rows += [(50 + i, f"{prose(30)} {passage} {prose(25)}") for i in range(6)]
    rows += [(60, None), (61, ""), (62, "  \n\t "), (63, "a"), (64, "a b"), (65, "A  B"), (66, "x " * 3000), (67, "x" * 5000), (67, "x" * 5000)]
    rows += [(68, prose(6000)), (None, base), (None, None), (69, prose(80)), (69, prose(80))]
    return rows
