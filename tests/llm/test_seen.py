import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftline.llm import seen as S

REQUESTS = "request_id long, enqueue_no long, url string, sid string, session_kwargs string, fingerprint string, dont_filter boolean, block string"


@given(st.lists(st.integers(0, (1 << 12) - 1), max_size=200))
@settings(max_examples=100, deadline=None)
def test_packing_is_a_round_trip(values):
    fused = np.unique(np.array(values, dtype=np.uint64) << np.uint64(24))
    assert (S.unpack(*S.pack(fused, 16)) == fused).all()


def test_merging_and_asking():
    a, b = np.array([1, 5, 9], dtype=np.uint64), np.array([5, 7], dtype=np.uint64)
    merged = S.merge_sorted([a, b])
    assert merged.tolist() == [1, 5, 7, 9]
    assert S.contains(merged, np.array([0, 5, 10], dtype=np.uint64)).tolist() == [False, True, False]
    assert S.merge_sorted([]).tolist() == [] and S.contains(a[:0], b).tolist() == [False, False]


def tables(spark):
    key = lambda i: f"{i:040x}"
    rows = [(i, i, f"https://a.test/{i}", "", None, key(i % 50).upper() if i % 2 else key(i % 50), False, "x") for i in range(1, 121)]
    rows += rows[:10] + [(200, 200, "https://a.test/null", "", None, None, True, None), (201, 201, "https://a.test/null#f", "", "{}", None, False, None)]
    seen = [(1, None, bytes.fromhex(key(i))) for i in (3, 4)] + [(2, None, bytes.fromhex(key(4))), (2, None, None)]
    return spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(seen, "checkpoint_no int, saved_at timestamp, fingerprint binary"), key


@pytest.mark.parametrize("geometry", [None, S.Geometry(1000, keys_per_block=16, local_bits=4)])
def test_against_brute_force(spark, geometry):
    requests, seen, key = tables(spark)
    known, want = {key(3), key(4)}, set()
    for i in range(1, 121):
        k = key(i % 50)
        if k in known:
            want.add(i)
        known.add(k)
    got = [r.request_id for r in S.seen_requests(requests, seen, geometry).collect()]
    assert sorted(got) == sorted(want | {201})


def test_collisions_are_counted_and_never_lose_a_key(spark, monkeypatch):
    requests, seen, _ = tables(spark)
    tiny = S.Geometry(1, local_bits=1)
    tiny.fused = lambda fingerprint: F.lit(1).cast("long")  # every key collides
    report = S.error_report(requests, seen, tiny).first()
    assert report.wrong_answers == report.new_requests and report.measured_rate == 1.0
    exact = {r.request_id for r in S.seen_requests(requests, seen).collect()}
    assert {r.request_id for r in S.seen_requests(requests, seen, tiny).collect()} == exact


def test_rates(spark):
    requests, seen, _ = tables(spark)
    report = S.error_report(requests, seen).first()
    assert report.wrong_answers == 0 and 0 < report.derived_rate < 1e-9 and report.asked_requests == 122 and report.new_requests == 49
    g = S.Geometry(1 << 30)
    assert abs(g.wrong_rate(1 << 20) - (1 << 20) / 2.0**g.bits) < 1e-9


def test_empty_tables(spark):
    requests, seen, _ = tables(spark)
    assert S.seen_requests(requests.limit(0), seen).count() == 0
    assert S.seen_requests(requests, seen.limit(0)).count() == 71
    assert S.error_report(requests.limit(0), seen.limit(0)).first().measured_rate is None
    nulls = spark.createDataFrame([(None,) * 8], REQUESTS)
    assert S.seen_requests(nulls, seen).count() == 0


def test_the_filter_decides_what_is_checked(spark, monkeypatch):
    """A filter that says maybe to all gives the same rows, but all keys go to the exact check."""
    requests, seen, _ = tables(spark)
    asked, real = [], S.confirmed
    monkeypatch.setattr(S, "confirmed", lambda maybe, seen: (asked.append(maybe.count()), real(maybe, seen))[1])
    exact = sorted(r.request_id for r in S.seen_requests(requests, seen).collect())
    monkeypatch.setattr(S, "contains", lambda stored, asked: np.ones(len(asked), dtype=bool))
    assert sorted(r.request_id for r in S.seen_requests(requests, seen).collect()) == exact
    assert asked[0] == 2 and asked[1] == 51


def test_filters_stay_between_runs(spark, tmp_path):
    _, seen, key = tables(spark)
    store = S.FilterStore(spark, str(tmp_path / "filters"), S.Geometry(1 << 20))
    store.add(seen.where("checkpoint_no = 1"))
    store.add(seen.where("checkpoint_no = 2"))
    assert sum(r.n for r in store.merged().collect()) == 2


def test_blocks_stay_small_beyond_two_billion_keys():
    assert [S.Geometry(1 << n).block_bits for n in (10, 31, 40)] == [0, 15, 24]
