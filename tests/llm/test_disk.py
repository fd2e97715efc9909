"""What the corpus operators leave in the shared folder and among the shuffle files."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon import session
from quillon.llm import line_dedup, near_dup
from tests.llm.test_llm import removed_by_brute_force, removed_by_stage


def tables(spark):
    return set(os.listdir(session.shared_dir(spark).removeprefix("file:")))


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def words(k, n=60):
    rng = random.Random(k)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def copies(spark):
    """Texts of one line each, every third with a near copy."""
    rows = [(k, words(k)) for k in range(60)]
    rows += [(100 + k, t[:-3] + "zzz") for k, t in rows if k % 3 == 0]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_write_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    session.materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count"), "grouped")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(session.CLEANUP, "false") == "false"  # the setting is the caller's again


def test_temporary_tables_go(spark):
    before = tables(spark)
    with session.temporary(spark) as keep_outer:
        first = session.materialize(spark.range(3), "outer")
        with session.temporary(spark) as keep:
            one, two = (session.materialize(spark.range(n), "inner") for n in (4, 5))
            kept = keep(one.union(two).where("id > 1"))
            session.materialize(first, "lost")
        assert len(tables(spark) - before) == 3 and kept.count() == 5
        session.discard(first)
        assert len(tables(spark) - before) == 2
        keep_outer(one)
    assert len(tables(spark) - before) == 1 and one.count() == 4
    with pytest.raises(ValueError), session.temporary(spark):
        session.materialize(spark.range(3), "failed")
        raise ValueError
    assert len(tables(spark) - before) == 1


@pytest.mark.parametrize("made", [lambda d: line_dedup.dedup_lines(d, counts=True), near_dup.classes])
def test_operators_leave_only_what_their_result_reads(spark, copies, made):
    before = tables(spark)
    out = made(copies)
    left = tables(spark) - before
    assert len(left) == 1 and out.count() == copies.count()
    assert tables(spark) - before == left


def test_pipeline_leaves_one_stage(spark, copies, monkeypatch):
    def named(s, df, _):
        return session.materialize(df.withColumn("n", F.length("text")), "own")

    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: copies)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", named), ("b", lambda s, df, _: df.where("doc_id < 100")), ("c", lambda s, df, _: df.where("doc_id >= 30")), ("d", lambda s, df, _: df.select("doc_id"))])
    before = tables(spark)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, "").collect()) == list(range(30, 60))
    assert [t.rsplit("-", 1)[0] for t in tables(spark) - before] == ["pipeline-2"]


def test_pairs_of_lines_are_compared_in_parts(spark, monkeypatch):
    """What one job moves is bounded: with a bound of few bytes, the pairs go in several jobs, with the same result."""
    rows = [(k, words(k % 40)[:-1] + "klmnop"[k // 40]) for k in range(240)]
    parts, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: parts.append(name) or write(df, name))
    want = removed_by_brute_force(rows)
    assert len(want) == 200 and removed_by_stage(spark, rows) == want and "edges-of-part" not in parts
    monkeypatch.setattr(line_dedup, "MOVED", 1)
    assert removed_by_stage(spark, rows) == want and parts.count("edges-of-part") > 1
