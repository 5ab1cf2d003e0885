import math

import pytest
from pyspark.sql import functions as F

from barloom.llm.mixing import due, mix, plan

TARGETS = "source string, target_weight double, max_repeats int"


def test_plan():
    exact = {s.source: s for s in plan([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.5, 3)], {"a": 1000, "b": 400, "c": 50}, exact=True)}
    total = sum(s.quota for s in exact.values())
    assert math.isclose(exact["c"].quota, 200) and math.isclose(exact["a"].quota / total, 0.5) and exact["gone"].quota == 0
    assert math.isclose(sum(s.quota * s.slope for s in exact.values()), 0, abs_tol=1e-9)  # weights sum to one at any time
    full = {s.source: s for s in plan([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], {"a": 1000, "b": 400, "c": 50}, total=1500)}
    assert full["c"].quota == 200 and math.isclose(sum(s.quota for s in full.values()), 1500) and math.isclose(full["a"].quota / full["b"].quota, 0.5 / 0.3)
    # Without a total, the mix has as many tokens as there are; c is at its cap, the others make up for it.
    grown = {s.source: s for s in plan([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], {"a": 1000, "b": 400, "c": 50})}
    assert grown["c"].quota == 200 and math.isclose(sum(s.quota for s in grown.values()), 1450) and math.isclose(grown["a"].quota / grown["b"].quota, 0.5 / 0.3)
    over = plan([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 10, "b": 20}, total=1e9)
    assert sum(s.quota for s in over) == 30
    assert plan([], {}) == [] and plan([("a", 1.0, 1)], {})[0].quota == 0


def corpus(spark):
    rows = [(i, s, 50 + i * 37 % 100) for s, lo, n in (("big", 0, 3000), ("mid", 3000, 400), ("small", 3400, 30), ("other", 3430, 50)) for i in range(lo, lo + n)]
    rows += [(9000, " Big ", 80), (9001, None, 80), (9002, "mid", 0), (9003, "mid", None), (9004, "MID", 70), (9004, "MID", 70)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumns({"h": F.lit(1), "c": F.lit(2), "quota": F.lit(3.0)}), rows


def test_mix(spark):
    docs, rows = corpus(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("Small", 0.2, 4), ("absent", 0.1, 3), (None, 0.1, 1)], TARGETS)
    chosen, report = mix(docs, targets, exact=True, chunks=8)
    shares = {r["source"]: r for r in report.collect()}
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[s]["share"] - w) < 0.01, s
    assert shares["absent"]["tokens"] == 0
    got = chosen.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and 0 <= got[0]["position"] and got[-1]["position"] <= 1
    by = {}
    for r in got:
        by.setdefault((r["source"], r["doc_id"]), []).append(r["repeat"])
    assert all(len(v) <= {"big": 1, "mid": 2, "small": 4}[s] for (s, d), v in by.items() if d != 9004)
    assert all(sorted(v) == list(range(len(v))) for (s, d), v in by.items() if d != 9004) and not {"other", None} & {s for s, _ in by}
    # Order follows the schedule: a source's tokens up to time t are its demand.
    s = shares["small"]
    early = sum(r["n_tokens"] for r in got if r["source"] == "small" and r["position"] < 0.5)
    assert early < 0.5 * s["tokens"]  # small sources rise towards the end
    empty, none = mix(docs.filter("false"), targets)
    assert empty.collect() == [] and none.count() == 4


def test_mix_grows_with_the_documents(spark):
    docs, _ = corpus(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("Small", 0.2, 4), ("absent", 0.1, 3)], TARGETS)
    for part in (docs, docs.filter("doc_id % 2 = 0")):  # half of the documents, half of the mix
        chosen, report = mix(part, targets, chunks=8)
        shares = {r["source"]: r for r in report.collect()}
        total = sum(r["tokens_once"] for r in shares.values())
        assert abs(sum(r["tokens"] for r in shares.values()) / total - 1) < 0.01
        assert {s: r["status"] for s, r in shares.items()} == {"big": "met", "mid": "capped", "small": "capped", "absent": "absent"}
        for r in shares.values():
            assert abs(r["tokens"] - r["quota_tokens"]) <= max(0.01 * r["quota_tokens"], 0)
        assert chosen.agg(F.sum("n_tokens")).collect()[0][0] == sum(r["tokens"] for r in shares.values())


@pytest.mark.parametrize("total", [20_000, 33_000, 47_000, 61_500])
def test_long_texts_are_placed(spark, total):
    """One text holds a third of its source; its quota is met all the same, and tokens chosen before a document give its position."""
    rows = [(i, "a", 20 + i * 13 % 60) for i in range(800)] + [(9000, "a", 20_000)] + [(i, "b", 100) for i in range(1000, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2)], TARGETS)
    chosen, report = mix(docs, targets, total=total, chunks=4)
    for r in report.collect():
        assert abs(r["tokens"] - r["quota_tokens"]) <= 0.01 * r["quota_tokens"], r
    got = [r for r in chosen.collect() if r["source"] == "a"]
    q, slope = next((s.quota, s.slope) for s in plan([("a", 0.7, 2), ("b", 0.3, 2)], {"a": sum(n for _, s, n in rows if s == "a"), "b": 40_000}, total) if s.source == "a")
    c = 0
    for r in got:
        x = min(c / q, 1.0)
        t = r["position"]
        assert abs(t + slope * (t * t - t) - x) < 1e-6
        c += r["n_tokens"]


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.7])
def test_due_inverts_demand(spark, slope):
    q = 1000.0
    df = spark.range(11).select((F.col("id") / 10).alias("t")).withColumn("c", q * (F.col("t") + slope * (F.col("t") * F.col("t") - F.col("t"))))
    for r in df.withColumn("back", due(F.col("c"), F.lit(q), F.lit(slope))).collect():
        assert math.isclose(r["t"], r["back"], abs_tol=1e-9)
