"""Kept pair results equal fresh ones, and only what changed is computed again."""

from transitlapse.operators import diff as D
from transitlapse.operators import pair_results as K
from transitlapse.operators.registry import Registry


def registry(spark, stops, routes=(("F1", "r1", "R1", "1", "A - B", "Bus AG"),)):
    modes = sorted({r[2] for r in routes})
    return Registry(
        stops=spark.createDataFrame(list(stops), "feed_id string, raw_id string, canonical_id string, name string, lat double, lon double"),
        routes=spark.createDataFrame(list(routes), "feed_id string, raw_id string, canonical_id string, short_name string, "
                                                   "long_name string, agency_name string").selectExpr("*", "'bus' mode"),
        canonical_stops=spark.createDataFrame([], "canonical_id string"),
        canonical_routes=spark.createDataFrame([(m, "bus") for m in modes], "canonical_id string, mode string"))


def pairs(spark, *which):
    return spark.createDataFrame(list(which), "feed_a string, feed_b string")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def fresh(reg, wanted):
    return rows(D.stop_diff(reg, wanted)), rows(D.route_diff(reg, wanted))


def found(got):
    return rows(got.stops), rows(got.routes), sorted(map(tuple, got.computed.collect()))


STOPS = [(f, f"s{k}", f"C{k}", f"Stop {k}", 47.0 + k / 100, 15.0 + (k == 2) * int(f[1]) / 1000) for f in ("F1", "F2") for k in range(4)]
NEW = [("F3", "x", "C0", "Stop 0", 47.0, 15.0), ("F3", "y", "C9", "Neu", 48.0, 16.0)]
ROUTES = [("F1", "r1", "R1", "1", "A - B", "Bus AG"), ("F2", "r1", "R2", "2", "A - B", "Bus AG"), ("F3", "r1", "R2", "2", None, None)]


def test_a_new_feed_costs_one_step(spark, tmp_path):
    path = str(tmp_path / "kept")
    first, wanted = registry(spark, STOPS, ROUTES[:2]), pairs(spark, ("F1", "F2"), ("F1", "F2"))
    one = found(K.stored_diffs(first, wanted, path))
    assert one == (*fresh(first, wanted), [("F1", "F2")])
    assert found(K.stored_diffs(first, wanted, path)) == (*one[:2], [])
    more, steps = registry(spark, STOPS + NEW, ROUTES), pairs(spark, ("F1", "F2"), ("F2", "F3"))
    assert found(K.stored_diffs(more, steps, path)) == (*fresh(more, steps), [("F2", "F3")])
    # Rows in another order are the same feed; only the pairs asked for come back.
    assert found(K.stored_diffs(registry(spark, [*NEW, *STOPS][::-1], ROUTES[::-1]), wanted, path)) == (*one[:2], [])


def test_changed_feeds_are_computed_again_and_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "kept")
    steps = pairs(spark, ("F1", "F2"), ("F2", "F3"))
    K.stored_diffs(registry(spark, STOPS + NEW, ROUTES), steps, path)
    for stops, routes in (
            ([(*s[:2], "C99" if s[0] == "F3" else s[2], *s[3:]) for s in STOPS + NEW], ROUTES),  # another id
            (STOPS + NEW + NEW[:1], ROUTES),                                                      # a row twice
            (STOPS + NEW, [*ROUTES[:2], ("F3", "r1", "R2", "2", "", None)]),                      # null is not empty
            (STOPS, ROUTES[:2])):                                                                 # the feed is gone
        reg = registry(spark, stops, routes)
        assert found(K.stored_diffs(reg, steps, path)) == (*fresh(reg, steps), [("F2", "F3")])
        kept = spark.read.parquet(f"{path}/stops").where("feed_b = 'F3'")
        assert kept.count() == D.stop_diff(reg, pairs(spark, ("F2", "F3"))).count()  # one version
    reg = registry(spark, STOPS, ROUTES[:2])
    assert len(found(K.stored_diffs(reg, steps, path, moved_m=1e6))[2]) == 2  # another rule


def test_lost_runs_empty_pairs_and_dropped_feeds(spark, tmp_path):
    path = str(tmp_path / "kept")
    reg, steps = registry(spark, STOPS, ROUTES[:2]), pairs(spark, ("F1", "F2"), ("F8", "F9"), (None, "F1"))
    none = found(K.stored_diffs(reg, pairs(spark), path))
    assert none == ([], [], [])
    one = found(K.stored_diffs(reg, steps, path))
    assert one == (*fresh(reg, pairs(spark, ("F1", "F2"))), [("F1", "F2"), ("F8", "F9")])
    assert found(K.stored_diffs(reg, steps, path))[2] == []
    # A run that began another version and was lost: what it left counts for nothing.
    begun = K.standing(spark, path).where("feed_a = 'F1'")
    K._note(spark, path, begun, done=False)
    spark.read.parquet(f"{path}/stops").limit(1).write.mode("append").partitionBy("pair").parquet(f"{path}/stops")
    assert found(K.stored_diffs(reg, steps, path)) == (*one[:2], [("F1", "F2")])
    # All rows of a pair go when both of its feeds do.
    bare = registry(spark, [], [("F7", "r", "R", "1", "x", "y")])
    assert found(K.stored_diffs(bare, steps, path)) == ([], [], [("F1", "F2")])
    K.stored_diffs(reg, steps, path)
    K.drop_feeds(spark, path, spark.createDataFrame([("F2",)], "feed_id string"))
    assert spark.read.schema("feed_a string, pair string").parquet(f"{path}/stops").count() == 0
    assert found(K.stored_diffs(reg, steps, path)) == (*one[:2], [("F1", "F2")])
