"""Selection of places by digits, against sorted lists."""

import math
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.functions import quantiles
from quillon.operators.scoring import percentile_histogram

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 2.0**-1023, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 2.0**1023, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), -float("inf"), 0.1, 1e22, 3e-310]


def test_bits_are_the_format_s(spark):
    r = random.Random(1)
    values = EDGES + [s * math.ldexp(m, e) for e in range(-1074, 1024) for s, m in ((1, 1.0), (-1, 1.0), (1, 2 - 2.0**-52), (1, 1 + r.random()))] + [struct.unpack("d", r.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    rows = quantiles.with_bits(rows, "v", "k").collect()
    bits = lambda v: struct.unpack("q", struct.pack("d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert [row.k for row in rows] == [bits(row.v) for row in rows] and len(rows) == len(values)


def places(rows, quantile):
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    return {g: (len(vs), sorted(vs)[math.floor((len(vs) - 1) * quantile)]) for g, vs in groups.items()}


@pytest.mark.parametrize("few, most", [(0, 50_000), (40, 50_000), (250_000, 50_000), (0, 3)])
@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_places_against_sorted_lists(spark, monkeypatch, few, most, kind):
    monkeypatch.setattr(quantiles, "FEW_ROWS", few)
    monkeypatch.setattr(quantiles, "MOST_PLACES", most)
    r = random.Random(few + most)
    numbers = {"double": [*EDGES, *[r.lognormvariate(0, 40) for _ in range(30)], *[1 + r.random() * 1e-12 for _ in range(30)]], "bigint": [0, 1, -1, 2**62, -(2**63), 2**63 - 1, *range(100_000, 100_040)]}[kind]
    rows = [(r.choice(["hot", "hot", None, "a", "b"]), r.choice([None, *numbers, *[numbers[0]] * 20])) for _ in range(1500)]
    df = spark.createDataFrame(rows, f"g string, v {kind}").withColumn("id", F.monotonically_increasing_id())
    found = quantiles.floor_quantiles(df, ["g"], "v", "id", {"low": 0.0, "some": 0.3, "high": 0.995, "top": 1.0}).collect()
    for name, q in (("low", 0.0), ("some", 0.3), ("high", 0.995), ("top", 1.0)):
        assert {x.g: (x.n, x[name]) for x in found} == places(rows, q)
    whole = quantiles.floor_quantiles(df, [], "v", "id", {"some": 0.3}).collect()
    assert [(x.n, x.some) for x in whole] == [*places([(0, v) for _, v in rows], 0.3).values()]


def test_places_of_nothing_and_other_types(spark):
    none = spark.createDataFrame([(1, None)], "g int, v double")
    assert quantiles.medians(none, ["g"], "v").count() == 0 and [x.median for x in quantiles.medians(none, [], "v").collect()] == [None]
    days = spark.sql("select g, date'2020-01-01' + g as v, g as id from (select explode(sequence(0, 10)) as g)")
    assert str(quantiles.floor_quantiles(days, [], "v", "id", {"half": 0.5}).first().half) == "2020-01-06"
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    assert quantiles.medians(odd, [], "v").first().median == 2.0


def test_selection_writes_and_deals_no_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "materialize", None)  # nothing is written
    df = spark.range(100_000).select((F.col("id") % 5).alias("g"), F.sqrt("id").alias("v"), "id")
    monkeypatch.setattr(quantiles, "FEW_ROWS", 0)
    q = quantiles.medians(df, ["g"], "v")
    assert {(x.g, x.median) for x in q.collect()} == {(g, (math.sqrt(49_995 + g) + math.sqrt(50_000 + g)) / 2) for g in range(5)}
    assert "rangepartitioning" not in q._jdf.queryExecution().toString()


def test_percentile_histogram_counts_values(spark):
    r = random.Random(2)
    rows = [(g, r.choice([1.0, 2.0, r.random(), None])) for g in (None, "a", "b") for _ in range(400)]
    edges, counts = [0.5, 0.8, 0.95, 0.99], [0] * 5
    for g, v in rows:
        if v is not None:
            own = [w for h, w in rows if h == g and w is not None]
            counts[sum(sum(w <= v for w in own) / len(own) >= e for e in edges)] += 1
    found = percentile_histogram(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    assert [x.rows for x in sorted(found.collect(), key=lambda x: ["<0.50", "0.50-0.80", "0.80-0.95", "0.95-0.99", ">=0.99"].index(x.bucket))] == counts


@pytest.mark.parametrize("most", [50_000, 2])
def test_shares_at_probes(spark, most):
    r = random.Random(most)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, r.random() * 3])) for _ in range(900)]
    probes = [(g, v) for g in ("a", "b", None, "c") for v in (0.0, 1.0, 1.5, 9.0, None)]
    df, asked = (spark.createDataFrame(x, "g string, v double") for x in (rows, probes))
    got = {(x.g, x.v): x.share for x in quantiles.shares_at(df, ["g"], "v", asked, "share", most).collect()}
    own = lambda g: [v for h, v in rows if h == g and v is not None]
    assert got == {(g, v): sum(w <= v for w in own(g)) / len(own(g)) for g, v in probes if v is not None and own(g)}
    whole = quantiles.shares_at(df, [], "v", asked, "share", most).collect()
    every = [v for _, v in rows if v is not None]
    assert {x.v: x.share for x in whole} == {v: sum(w <= v for w in every) / len(every) for v in (0.0, 1.0, 1.5, 9.0)}
    assert quantiles.shares_at(df, ["g"], "v", asked.limit(0), "share", most).count() == 0
