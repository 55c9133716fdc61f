from fractions import Fraction

from scriptorium.llm import mixing
from tests.llm.helpers import ODD, SCHEMA, documents


def slow_schedule(rows, weights, block):
    """Earliest deadline first, slot by slot, over all blocks, with a new phase whenever a source runs out."""
    left = {s: -(-n // block) for s, n in rows.items()}
    out = []
    while left:
        q, done = sum(weights[s] for s in left), dict.fromkeys(left, 0)
        for t in range(10**9):
            ready = [s for s in left if done[s] * q // weights[s] <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * q // weights[s]), str(s)))
            out.append(s)
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
    return out


def test_schedule_equals_slot_by_slot(spark):
    texts = [f"t{i}" for i in range(400)]
    df = documents(spark, texts)
    got = mixing.mix(df, {"s0": 5, "s1": 2, "s2": 1, None: 3}, block=4, grain=32).collect()
    rows = {}
    for r in got:
        rows[r["source"]] = rows.get(r["source"], 0) + 1
    own = mixing.whole_weights({"s0": 5, "s1": 2, "s2": 1, None: 3}, 32)
    want = slow_schedule(rows, own, 4)
    slots = {r["slot"]: r["source"] for r in got}
    assert [slots[t] for t in range(len(want))] == want
    assert sorted(r["position"] for r in got) == list(range(400))
    assert [r["source"] for r in sorted(got, key=lambda r: r["position"])] == [s for s, t in ((slots[t], t) for t in range(len(want))) for _ in range(sum(r["slot"] == t for r in got))]


def test_windows_and_deviation():
    own = mixing.whole_weights({f"s{i}": 1 + i * i for i in range(9)}, 200)
    slots, q = mixing.period(own), sum(own.values())
    assert q == 200
    done = dict.fromkeys(own, 0)
    for t, s in enumerate(slots):
        assert done[s] * q // own[s] <= t < -(-(done[s] + 1) * q // own[s])
        done[s] += 1
        assert all(abs(Fraction(done[x]) - Fraction((t + 1) * own[x], q)) < 1 for x in own)
    assert done == own


def test_lag_of_rows_is_below_one_block(spark):
    df = documents(spark, [f"x{i}" for i in range(600)])
    assert all(r["max_lag"] < 1 for r in mixing.lag(mixing.mix(df, block=4)).collect())


def test_mixed_rows_keep_every_row_in_order(spark):
    df = documents(spark, [*ODD, *[f"y{i}" for i in range(100)]], extra=True)
    got = mixing.mixed_rows(df, block=4)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    order = {(r["doc_id"]): r["position"] for r in mixing.mix(df, block=4).collect()}
    places = [order[r["doc_id"]] for r in got.collect()]
    assert places == sorted(places)


def test_small_sources_share_a_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    rows = [(i, f"t{i}", "en", f"s{i % 3}" if i % 5 else f"small{i % 50}", 1) for i in range(500)] + [(900 + i, "x", "en", None, 1) for i in range(4)]
    for weights in (None, {"s1": 4, "small5": 3}):
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, block=4).collect()
        assert sorted(r["position"] for r in got) == list(range(504))
        assert {r["source"] for r in got} == {r[3] for r in rows}
        shares = {s: {round(r["weight"], 9) for r in got if r["source"] == s} for s in {r[3] for r in rows}}
        rest = [s for s in shares if s not in ("s0", "s1", "s2")]
        assert len(set.union(*(shares[s] for s in rest))) == 1 and None in rest
    assert min(shares["s1"]) > min(shares["s0"])


def test_sources_of_a_shared_place_take_turns_by_their_own_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    sizes = {"s0": 300, "s1": 200, **{f"a{i}": 12 for i in range(9)}, **{f"b{i}": 7 for i in range(8)}, "c": 40, "d": 12, None: 3}
    weights = {"s0": 5, "a0": 4, "c": 2, "d": 4}
    rows = [(i, f"t{i}", "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    for most in (512, 2):
        monkeypatch.setattr(mixing, "MOST_KINDS", most)
        for given in (weights, None):
            got = mixing.mix(spark.createDataFrame(rows, SCHEMA), given, block=4).collect()
            assert sorted(r["position"] for r in got) == list(range(len(rows)))
            order = [r["source"] for r in sorted(got, key=lambda r: r["position"]) if r["source"] not in ("s0", "s1")]
            aim = {s: float(given.get(s, 2)) if given else n**mixing.TEMPERATURE for s, n in sizes.items() if s not in ("s0", "s1")}
            members = {}
            for s in aim:
                members.setdefault((sizes[s], aim[s]), []).append(s)
            whole = mixing.whole_weights({k: k[1] * len(m) for k, m in members.items()}, mixing.GRAIN)
            done = dict.fromkeys(aim, 0)
            for t, s in enumerate(order, 1):
                done[s] += 1
                for kind, alike in members.items():
                    part = Fraction(whole[kind], mixing.GRAIN * len(alike))
                    # With one level of kinds the deviation is below a row; a place in a place adds its own, and roundings, to it.
                    assert all(abs(done[x] - t * part) < (1 if most == 512 else 2.5) for x in alike)
                if done[s] == sizes[s]:
                    break
            else:
                raise AssertionError("no source ran out")
            rounds = [s for s in order if s is not None and s[0] == "b"]
            assert all(len(set(rounds[i : i + 8])) == 8 for i in range(0, 56, 8))


def test_repeated_rows_and_empty_table(spark):
    got = mixing.mix(documents(spark, [(1, "a")] * 40 + [(None, None)] * 3), block=4).collect()
    assert sorted(r["position"] for r in got) == list(range(43))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_rows(spark.createDataFrame([], SCHEMA)).count() == 0
