import numpy as np
import pytest

from barloom.llm.packing import balance, fill_report, pack
from barloom.llm.tokens import count_tokens, encoder

SIZES = "pack_name string, capacity_tokens int"


def brute(sizes, capacity, linear=1.0, quadratic=1 / 4096):
    """The rule as it is stated, every sequence looked at for every item."""
    rooms, costs, out = [], [], []
    for s in sizes:
        fit = [k for k in range(len(rooms)) if rooms[k] >= s]
        k = min(fit, key=lambda k: (costs[k], k)) if fit else len(rooms)
        if not fit:
            rooms.append(capacity)
            costs.append(0.0)
        rooms[k] -= s
        costs[k] += linear * s + quadratic * s * s
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_rule(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, 120, 400))[::-1]
    got = balance(sizes, 128)
    assert got.tolist() == brute(sizes.tolist(), 128)
    assert np.bincount(got, weights=sizes).max() <= 128


def test_pack(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 300, 500))] + [(900, 1000), (901, 512), (902, 256), (903, 0), (904, None), (5, 17), (5, 17)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 AS piece", "2 AS shard", "3 AS capacity", "4 AS item")
    sizes = spark.createDataFrame([("s", 256), ("s", 999), ("m", 1024), (None, 5), ("zero", 0)], SIZES)
    out = pack(items.select("doc_id", "n_tokens", "piece"), sizes, shard_items=100).collect()
    for name, cap in (("s", 256), ("m", 1024)):
        mine = [r for r in out if r["pack_name"] == name]
        load, by_doc = {}, {}
        for r in mine:
            if r["pack_no"] is not None:
                load[r["shard"], r["pack_no"]] = load.get((r["shard"], r["pack_no"]), 0) + r["n_tokens"]
            by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
        assert max(load.values()) <= cap
        total = sum(n or 0 for _, n in rows)
        assert sum(load.values()) == total
        assert sum(load.values()) / (len(load) * cap) > 0.9
        assert sorted(by_doc[900]) == ([(0, 0, 256), (1, 256, 256), (2, 512, 256), (3, 768, 232)] if cap == 256 else [(0, 0, 1000)])
        assert by_doc[903] == by_doc[904] == [(0, 0, 0)] and len(by_doc[5]) >= 3
        assert all(len(p) == 1 for d, p in by_doc.items() if d not in (5, 900, 901) and sum(x[2] for x in p) <= cap)
    assert {r["pack_name"] for r in out} == {"s", "m"}
    report = {r["pack_name"]: r for r in fill_report(pack(items, sizes), sizes).collect()}
    assert report["m"]["packs"] - report["m"]["fewest"] <= 2
    assert pack(items.filter("false"), sizes).collect() == [] and pack(items, sizes.filter("false")).collect() == []


def test_tokens(spark):
    text = "Día 1: ¿qué?\n<|endoftext|> " * 3
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 300_000)], "doc_id long, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()}
    enc = encoder()
    assert n[1] == len(enc.encode_ordinary(text)) and enc.decode(enc.encode_ordinary(text)) == text and n[2] == n[3] == 0 and n[4] > 1000
