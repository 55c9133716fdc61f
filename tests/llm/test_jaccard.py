import random

import numpy as np
import pytest

from scriptorium.llm import jaccard, shingles
from scriptorium.llm.components import components
from tests.llm.helpers import ODD, SCHEMA, documents, words


def brute(rows, width=3, percent=90):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def corpus(seed, n=160, vocabulary=400):
    """Families of near copies at many distances, exact copies and unrelated texts."""
    r = random.Random(seed)
    make = lambda k: [f"w{r.randrange(vocabulary)}" for _ in range(k)]
    texts = []
    for _ in range(n // 8):
        base = make(r.choice([2, 3, 4, 9, 12, 25, 60, 150, 400]))
        texts.append(" ".join(base))
        for _ in range(7):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, len(base) // 30, len(base) // 15])):
                copy[r.randrange(len(copy))] = f"w{r.randrange(vocabulary)}"
            texts.append(" ".join(copy + make(r.choice([0, 0, 0, 1, 2]))))
    r.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows, **options):
    return sorted([tuple(x) for x in jaccard.similar(documents(spark, rows), **options).collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("width,percent,rows_a_cell", [(5, 80, 4), (3, 90, 2), (1, 50, 1)])
def test_cells_equal_brute_force(spark, monkeypatch, width, percent, rows_a_cell):
    monkeypatch.setattr(jaccard, "ROWS_A_CELL", rows_a_cell)
    rows = corpus(width + 10)
    assert result(spark, rows, width=width, percent=percent) == brute(rows, width, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_both_ends_of_a_link_share_a_cell(percent):
    r = np.random.default_rng(percent)
    draw = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    families = [draw(200) for _ in range(12)]
    vary = lambda own, share: np.unique(np.concatenate([r.permutation(own)[: int(len(own) * (1 - share))], draw(int(len(own) * share))]))
    cells = jaccard.Cells([vary(f, 0.3) for f in families[:8] for _ in range(3)], percent, jaccard.REACH)
    shared, split = 0, 0
    for _ in range(3000):
        one = vary(families[r.integers(12)], r.choice([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]))
        two = vary(one, (1 - percent / 100) / 2)
        both = len(np.intersect1d(one, two))
        if 100 * both >= percent * (len(one) + len(two) - both):
            (a, a_outer), (b, b_outer) = cells.place(one), cells.place(two)
            assert {c for c, _, _ in a} & {c for c, _, _ in b} or (a_outer and b_outer)
            shared += bool({c for c, _, _ in a} & {c for c, _, _ in b})
            split += len(a) > 1
    assert shared > 500 and split > 100


def test_documents_lie_in_several_cells(spark):
    held = jaccard.keyed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")
    pivots = jaccard.first_pivots(held, 3)
    cells = jaccard.describe(held, 3, 90, pivots).selectExpr("inline(cells)").groupBy("cell").count().collect()
    assert len(pivots) > 10 and len(cells) == len(pivots) and any(r["count"] > 1 for r in cells)


def test_a_loose_group_lies_in_few_cells(spark, monkeypatch):
    """Members of one group that are far from each other: no pivot's cell repeats the group."""
    monkeypatch.setattr(jaccard, "ROWS_A_CELL", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(200):
        copy = list(base)
        for at in r.sample(range(200), 16):
            copy[at] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)]
    held = jaccard.keyed(documents(spark, rows), "doc_id", "text")
    cells = jaccard.describe(held, 5, 80, jaccard.first_pivots(held, 5)).selectExpr("inline(cells)").count()
    assert 0 < cells <= 3 * len(rows)
    assert result(spark, rows, width=5, percent=80) == brute(rows, 5, 80)


def test_hot_copies_link_through_one_cell(spark):
    text = [f"w{i}" for i in range(100)]
    near = lambda i: " ".join([*text[: i % 90], f"x{i}", *text[i % 90 + 1 :]])
    rows = [*((i, " ".join(text)) for i in range(1200)), *((2000 + i, near(i)) for i in range(150)), *((3000 + i, f"word{i} " * 5 + "end") for i in range(40))]
    got = {r[0]: r[2] for r in result(spark, rows)}
    assert {got[i] for i, _ in rows[:1350]} == {0} and [got[i] for i, _ in rows[1350:]] == [i for i, _ in rows[1350:]]


def test_heavy_regions_split_and_stay_exact(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            copy[r.randrange(120)] = f"x{r.randrange(999)}"
        rows.append((i, " ".join(copy)))
    assert result(spark, rows, weight=1500) == brute(rows)


def test_odd_rows(spark):
    rows = [*enumerate(ODD), (100, "one two three four"), (100, "quite other words here"), (None, "one two three four"), (None, "alone with null id")]
    assert result(spark, rows) == brute(rows)


def test_linked_sets_share_a_region():
    r = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(5):
            own = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            differing = (2 * len(own)) * 10 // 190
            gone = r.integers(0, differing + 1)
            other = np.unique(np.concatenate([r.permutation(own)[gone:], r.integers(0, 2**63, differing - gone, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            both = len(np.intersect1d(own, other))
            if 100 * both >= 90 * (len(own) + len(other) - both):
                assert set(jaccard.fragments(own, 90)) & set(jaccard.fragments(other, 90)), size


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_with_common_shingles_share_a_region_if_they_link(percent):
    r = np.random.default_rng(percent)
    draw = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    common = draw(40)
    for size in [*range(1, 40), 90, 300, 900]:
        for _ in range(8):
            own = np.unique(np.concatenate([draw(size), r.permutation(common)[: r.integers(0, 41)]]))
            gone = r.integers(0, len(own) * 2 * (100 - percent) // (100 + percent) + 1)
            other = np.unique(np.concatenate([r.permutation(own)[gone:], draw(r.integers(0, gone + 1))]))
            both = len(np.intersect1d(own, other))
            if 100 * both >= percent * (len(own) + len(other) - both):
                assert set(jaccard.fragments(own, percent)) & set(jaccard.fragments(other, percent)), size


def test_a_common_line_makes_few_regions(spark):
    r = random.Random(4)
    line = " ".join(f"c{i}" for i in range(9))
    rows = [(i, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(r.randrange(150, 250))), line])) for i in range(1200)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(10)]
    described = jaccard.describe(jaccard.keyed(documents(spark, rows), "doc_id", "text"), 5, 80, [])
    sizes = [m["count"] for m in jaccard.region_members(described).groupBy("region").count().collect()]
    assert sum(sizes) < 600 and max(sizes) <= 150  # 2,981 and 199 where only empty classes are left out
    found = result(spark, rows, width=5, percent=80)
    assert [x[2] for x in found if x[0] >= 5000] == list(range(10)) and len({x[2] for x in found}) == 1200


def test_rows_that_have_a_partner_already_are_not_compared_again(spark):
    """Ten rows in pairs and three without partner; a row that only one with a partner is near to stays too."""
    sketch = lambda x: bytes([x] * 100)
    chain = [bytes([1] * 60), bytes([1] * 54 + [2] * 6), bytes([1] * 48 + [2] * 12)]  # each is near to the next alone, by 6 bytes of 60
    rows = [(1, i, i, 100, sketch(i // 2)) for i in range(10)] + [(1, 20 + i, i, 100, sketch(30 + i)) for i in range(3)]
    rows += [(2, i, i, 30 + i, c) for i, c in enumerate(chain)] + [(2, 9, 9, 30, sketch(9)[:60])]
    found = jaccard.with_partners(spark.createDataFrame(rows, "region long, node long, k long, n long, sketch binary"), 80).collect()
    assert sorted((x["region"], x["node"]) for x in found) == [(1, i) for i in range(10)] + [(2, i) for i in range(3)]


def test_shingles_equal_tuples():
    texts = ["A b c d a B c", "a b", "", None, "x\x1cy z w", "é É e", " ".join(f"w{i % 7}" for i in range(5000))]
    for t, s in zip(texts, shingles.sets([t.encode() if t else t for t in texts], 3), strict=True):
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        assert len(s) == len({tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def test_dedupe_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text), (3, text), (4, text + " more"), (7, None), (7, None), (8, ""), (9, "other words in here")]
    got = sorted(jaccard.dedupe(documents(spark, rows, extra=True)).select("doc_id", "text").collect(), key=str)
    assert [r["doc_id"] for r in got] == [3, 7, 7, 8, 9]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i != 150], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(301)}


def test_empty_table(spark):
    assert result_empty(spark) == []


def result_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.dedupe(df).count() == 0
    return jaccard.similar(df).collect()


def test_blocks_link_the_ball_of_one_with_the_outside_of_the_other(spark):
    make = lambda changed: " ".join("x" if i in changed else f"w{i}" for i in range(200))
    p, i, j = make(()), make((60, 61)), make((60, 61, 120, 121, 122, 123, 124, 125))
    texts = {n: t for n, t in enumerate((p, i, j))}
    linked = {(a, b) for a, b in ((0, 1), (1, 2), (0, 2)) if len({c for _, _, c in brute([(a, texts[a]), (b, texts[b])])}) == 1}
    assert linked == {(0, 1), (1, 2)}
    # Names of which the first two fall into one block of two and the third into the other.
    block = {r["node"]: r["block"] for r in spark.range(64).selectExpr("id as node", "pmod(xxhash64(id), 2) as block").collect()}
    one, two = ([n for n in block if block[n] == b] for b in (0, 1))
    for x, y in ((one, two), (two, one)):
        names = [x[0], x[1], y[0]]
        rows = [(7, n, 198, t, False, 2) for n, t in zip(names, texts.values(), strict=True)]
        regions = spark.createDataFrame(rows, "region long, node long, n long, text string, ball boolean, chunks long")
        edges = jaccard.join_blocks(regions, 3, 90)
        assert {r["component"] for r in components(edges).collect()} == {min(names)} and components(edges).count() == 3


def test_long_white_space(monkeypatch):
    # Each case meets the table of powers as a new worker has it.
    fresh = shingles._powers[:4096].copy()
    for texts in ([b"a" + b" " * 10_000 + b"b"], [b"a", *[None] * 10_000, b"b c"], [b" " * 10_000 + b"a b"], [b"a b" + b"\n" * 10_000]):
        monkeypatch.setattr(shingles, "_powers", fresh)
        found = list(shingles.sets(texts, 3))
        assert len(found) == len(texts)
        for t, s in zip(texts, found, strict=True):
            monkeypatch.setattr(shingles, "_powers", fresh)
            short = b" ".join((t or b"").split())
            assert s.tolist() == next(shingles.sets([short], 3)).tolist()
