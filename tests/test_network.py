"""Networks of many hops."""

from fringeflow.operators import network


def test_reachable_has_no_bound_on_hops(spark):
    chain = [(k, k + 1) for k in range(97)] + [(200, 201), (201, 202)]
    got = network.reachable(spark.createDataFrame(chain, "ref_idx int, sec_idx int"))
    assert got.dtypes == [("epoch_idx", "int")] and sorted(r[0] for r in got.collect()) == list(range(98))


def test_reachable_of_no_pairs(spark):
    assert [r[0] for r in network.reachable(spark.createDataFrame([], "ref_idx int, sec_idx int")).collect()] == [None]
