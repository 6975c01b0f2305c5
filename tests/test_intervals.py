"""The interval queries over every event, by brute force."""

from tessera.plans import catalogue as q


def test_every_event_has_its_interval(spark, sf_dir):
    times: dict[int, list[tuple[int, int]]] = {}
    for r in q.imu(spark, sf_dir).collect():
        times.setdefault(r.seq, []).append((r.stamp_ns, r.event_id))
    inside, covered, sliced = [], [], []
    for rows in times.values():
        last = max(t for t, _ in rows)
        for t0, event in rows:
            t1 = t0 + 12 * q.HOUR
            within = [t for t, _ in rows if t0 < t < t1]
            inside += [(event, t) for t in within]
            covered.append((event, t1 <= last))
            sliced += [(event, t) for t in (t0, *within, t1) if t1 <= last]
    assert "% 20" not in q.ORACLES["interval_join_all"] + q.ORACLES["interval_slice_all"] + q.ORACLES["coverage_all"]
    assert sorted((r.event_id, r.stamp_ns) for r in q.QUERIES["interval_join_all"](spark, sf_dir).collect()) == sorted(inside)
    assert sorted((r.event_id, r.covered) for r in q.QUERIES["coverage_all"](spark, sf_dir).collect()) == sorted(covered)
    assert sorted((r.event_id, r.stamp_ns) for r in q.QUERIES["interval_slice_all"](spark, sf_dir).collect()) == sorted(sliced)
    assert len(covered) == 10_000
