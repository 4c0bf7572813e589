import random
from fractions import Fraction
from itertools import permutations

import pytest
from conftest_twin import same, twin

from textloom.llm import filter_interactions as X

SF = "/root/testdata/sf0.001"


def test_corners_and_values_by_replaying_all_orders():
    r = random.Random(3)
    for n in (1, 2, 3, 5):
        names = "ABCDE"[:n]
        counts = {m: r.randrange(20) for m in range(1 << n)}
        gain = {m: r.randrange(counts[m] + 1) for m in counts}
        summed = dict.fromkeys(names, 0)
        want = []
        for order in permutations(names):
            left = dict(counts)
            for step, name in enumerate(order, 1):
                bit = 1 << names.index(name)
                here = {m: c for m, c in left.items() if m & bit}
                left = {m: c for m, c in left.items() if not m & bit}
                gone = sum(here.values())
                summed[name] += gone
                fails = sum(c for m, c in counts.items() if m & bit)
                want.append(["".join(order), step, sum(left.values()), gone, fails - gone, counts[bit], sum(gain[m] for m in here)])
        got = X.report(names, counts, {"g": gain})
        assert [[x[k] for k in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "g")] for x in got] == want
        assert all(x["shapley"] == summed[x["filter_order"][x["step"] - 1]] for x in got)


def test_values_are_exact_rationals():
    p = X.polynomial({0b111: 1})
    assert [X.shapley(p, i) for i in range(3)] == [Fraction(1, 3)] * 3
    big = 10**18 + 1
    assert X.shapley(X.polynomial({0b11111: big}), 4) * 120 == 24 * big


def run(docs, labels):
    gains = ("good_lost", "toxic_lost")
    return X.interactions(X.mask_counts(X.failed_masks(docs, labels), gains), "ABCDE", gains)


def test_query_against_twin(spark):
    assert same(X.op11_filter_interactions(spark, SF), twin(X.OP11_SQL, SF))


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 0, 0), (5, 1, None), (6, None, 1), (8, 1, 0), (8, 1, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


def test_odd_rows_against_twin(spark, odd, labels):
    more = spark.createDataFrame([(20, "A B C " * 90, None, "t", 1), (21, "A B C " * 90, None, "t", 1), (22, "A B C " * 90, None, "t", 1), (21, "A B C " * 90, None, None, 1), (None, "A B C " * 90, None, "t", 1)], odd.schema)
    docs = odd.union(more)
    got = same(run(docs, labels), twin(X.OP11_SQL, SF, {"documents": docs, "labels": labels}))
    assert {r["part"] for r in got} == {"", "s", "t"} and len(got) == 3 * 600


def test_clashing_columns_change_nothing(clashing, odd, labels):
    from pyspark.sql import functions as F

    own = clashing.withColumns({c: F.lit("own") for c in ("part", "mask", "digest", "words", "first", "n", "good_lost", "step")})
    assert same(run(own, labels), [r.asDict() for r in run(odd, labels).collect()])


def test_empty_tables(nothing, odd, labels):
    assert run(nothing, labels).collect() == []
    assert len(run(odd, labels.limit(0)).collect()) == 1200


def test_copies_over_many_rows_of_one_part(spark, labels):
    docs = spark.createDataFrame([(i, "the same" if i % 3 else f"text {i}", "hot") for i in range(3000)], "doc_id long, text string, source string")
    r = next(r for r in run(docs, labels).collect() if r.filter_order == "EABCD" and r.step == 1)
    assert (r.removed, r.kept) == (1999, 1001)
