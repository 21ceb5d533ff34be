"""Listings of a bucket are folded together as they would be one by one, and lie on shelves of the state, not each in a call of its own."""

import random
from datetime import datetime, timedelta

from hearthlake.streaming import keyed_state
from hearthlake.streaming.keyed_state import KeyedStore

ORDER = ["ts", "seq"]
SHAPE = "source string, external_id string, ts timestamp_ntz, seq long, price long, type string"


def one_by_one(batches):
    """The rule, a sighting at a time: last row and changes of every listing."""
    held, changes = {}, []
    for rows in batches:
        for r in sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or 0)):
            at, known = (r[2], r[3] is not None, r[3] or 0), r[:2] in held
            h = held.setdefault(r[:2], {"price": (None, None), "type": (None, None), "before": None, "span": [r[2], r[2]]})
            before, price = h["before"], r[4]
            status = "new" if not known else "same" if before is None or price is None or price == before else "price_drop" if price < before else "price_rise"
            if status != "same":
                changes.append((*r[:2], r[2], price, before, status))
            h["before"] = before if price is None else price
            for c, v in (("price", price), ("type", r[5])):
                if v is not None and (h[c][0] is None or at >= h[c][1]):
                    h[c] = (v, at)
            h["span"] = [min(h["span"][0], r[2]), max(h["span"][1], r[2])]
    return {(*k, h["price"][0], h["type"][0], *h["span"]) for k, h in held.items()}, sorted(map(repr, changes))


def test_folds_as_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_state, "BUCKETS", 4)
    monkeypatch.setattr(keyed_state, "SHELVES", 8)
    rng, day = random.Random(5), datetime(2024, 1, 1)
    odd = [None, 0, -3, 2**60, 2**60 + 1, 7]
    row = lambda late: (rng.choice(["a", "b", None]), rng.choice([None, *map(str, range(90))]), day + timedelta(days=rng.randrange(6) + late), rng.choice([None, *range(2000)]), rng.choice(odd), rng.choice([None, "x", ""]))
    # The second batch is late in part, the third has few listings. Two sightings of a listing at the same place would be in no order.
    batches = [list({(r[:4]): r for r in (row(late) for _ in range(n))}.values()) for late, n in ((3, 900), (0, 900), (9, 12))]
    store = KeyedStore(spark, f"{tmp_path}/store", ["price", "type"], ORDER)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SHAPE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = store.start(stream, f"{tmp_path}/cp")
        assert query.awaitTermination(120)
        wanted, changes = one_by_one(batches[: i + 1])
        assert {tuple(r) for r in store.listings().collect()} == wanted
        assert sorted(repr(tuple(r)) for r in store.history().collect()) == changes
        state = query.lastProgress["stateOperators"][0]
        assert len(wanted) > 200 and state["numRowsTotal"] <= 4 * 8
    assert store.log().where("batch = 2").count() == len({r[:2] for r in batches[2]})


def test_a_listing_not_seen_for_so_long_is_new_again(spark, tmp_path):
    """Listings of one shelf age each for itself."""
    import pyarrow as pa

    schema = spark.createDataFrame([], SHAPE).schema
    state = keyed_state.ListingState(["price", "type"], ORDER, schema, 100)
    kept, day = {}, datetime(2024, 1, 1)
    state.state = type("State", (), {"getValue": lambda self, k: kept.get(k), "updateValue": lambda self, k, v: kept.__setitem__(k, v)})()

    def arrive(now, *ids):
        rows = pa.table({"source": ["a"] * len(ids), "external_id": list(ids), "ts": pa.array([day] * len(ids), pa.timestamp("us")), "seq": list(range(len(ids))), "price": [now] * len(ids), "type": ["x"] * len(ids), "_shelf": pa.array([3] * len(ids), pa.int32())})
        clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: now})()
        (out,) = state.handleInputRows((0,), iter([{"rows": keyed_state.written(rows)}]), clock)
        return sorted((r["external_id"], [c["status"] for c in r["changes"]]) for r in pa.ipc.open_stream(out["updates"]).read_all().to_pylist())

    assert arrive(0, "1", "2") == [("1", ["new"]), ("2", ["new"])]
    assert arrive(60, "2") == [("2", ["price_rise"])]
    assert arrive(120, "1", "2") == [("1", ["new"]), ("2", ["price_rise"])]
