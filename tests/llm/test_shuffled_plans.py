"""The plans that large tables get, where no side is broadcast."""

import random

import pytest

import test_repeats
from sievelake import storage
from sievelake.llm.lines import dedup_lines
from sievelake.llm.neardup import near_duplicates
from sievelake.llm.repeats import repeated_passages


@pytest.fixture
def shuffled(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, -1)
    yield
    for name in names:
        spark.conf.unset(name)


def corpus(n=80):
    rng = random.Random(12)
    rows = []
    for d in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 90))]
        if d % 5 == 4:
            words = rows[d - 3][1].split()
            words[7] = "changed"
        rows.append((d, "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), "en", "s", 1))
    return rows + [(900, rows[0][1], "en", "s", 1), (None, rows[1][1], "en", "s", 1), (901, None, None, None, None), (902, "", "en", "s", 0)]


@pytest.mark.parametrize("operator", [dedup_lines, near_duplicates, lambda d: repeated_passages(d, min_words=12, gram=5)])
def test_same_rows_without_broadcasts(spark, shuffled, monkeypatch, operator):
    docs = spark.createDataFrame(corpus(), test_repeats.SCHEMA).repartition(4).cache()
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    without = operator(docs)
    assert "BroadcastHashJoin" not in without._jdf.queryExecution().toString()
    without = plain(without)
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)
    assert without and without == plain(operator(docs))
    docs.unpersist()


def test_passages_equal_brute_force_without_broadcasts(spark, shuffled):
    rows = test_repeats.corpus(6, 40, 40)
    got = repeated_passages(spark.createDataFrame(rows, test_repeats.SCHEMA), min_words=12, gram=5, shard_words=3000)
    assert sorted(((r.doc_id, r.start, r.words) for r in got.collect()), key=str) == test_repeats.brute(rows, 12)
