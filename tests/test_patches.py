"""Merge patches as logs of leaves against plain nested dictionaries; tiers of parts; an outbox."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import patches as P
from gaugeline.session import fresh_path
from gaugeline.streaming import feeds as D

KEYS, ORDER, SCHEMA = ["id"], ["t"], "id bigint, t bigint, path array<string>, value string"


def merged(document, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(document) if isinstance(document, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merged(out.get(key), value)
    return out


def flat(document, at=()):
    for key, value in document.items():
        if isinstance(value, dict) and value:
            yield from flat(value, (*at, key))
        elif not isinstance(value, dict):
            yield (*at, key), value


def random_patch(pick, depth=3):
    out = {}
    for key in pick.sample("abc", pick.randint(1, 2)):
        kind = pick.random()
        out[key] = None if kind < 0.25 else pick.randint(0, 9) if kind < 0.45 or depth == 0 else "xé" if kind < 0.5 else [1, 2] if kind < 0.55 else random_patch(pick, depth - 1)
    return out


@pytest.fixture(scope="module")
def patches(spark):
    pick = random.Random(8)
    rows = [(i, t, random_patch(pick)) for i in range(150) for t in range(12)]
    frame = spark.createDataFrame([(i, t, json.dumps(p)) for i, t, p in rows], "id bigint, t bigint, patch string")
    want = {}
    for i, _, p in rows:
        want[i] = merged(want.get(i, {}), p)
    return frame, {(i, path): value for i, d in want.items() for path, value in flat(d)}


def told(df):
    return {(r.id, tuple(r.path)): json.loads(r.value) for r in df.collect()}


def test_documents_are_those_of_nested_merges(patches):
    frame, want = patches
    assert told(P.document(P.leaves(frame, KEYS, ORDER, "patch"), KEYS, ORDER)) == want


def test_compacting_parts_apart_changes_nothing(patches):
    frame, want = patches
    log = P.leaves(frame, KEYS, ORDER, "patch")
    parts = [P.compact(log.where((F.col("t") >= a) & (F.col("t") < a + 4)), KEYS, ORDER) for a in (0, 4, 8)]
    late = P.compact(parts[1].unionByName(parts[2]), KEYS, ORDER)
    assert told(P.document(late.unionByName(parts[0]), KEYS, ORDER)) == want


def test_what_is_no_object_changes_nothing(spark):
    frame = spark.createDataFrame([(1, 1, '{"a": 1}'), (1, 2, "[1]"), (1, 3, None), (1, 4, "{broken"), (1, 5, "{}"), (2, 1, "7")], "id bigint, t bigint, patch string")
    assert told(P.document(P.leaves(frame, KEYS, ORDER, "patch"), KEYS, ORDER)) == {(1, ("a",)): 1}
    deep = spark.createDataFrame([(1, 1, '{"a": {"a": {"a": 1}}}')], "id bigint, t bigint, patch string")
    with pytest.raises(ValueError):
        P.leaves(deep, KEYS, ORDER, "patch", depth=2)


def test_parts_stay_few_and_batches_may_run_again(spark):
    tiers = D.Tiers(spark, fresh_path(spark, "tiers"), "id bigint, n bigint", lambda df: df.groupBy("id").agg(F.max("n").alias("n")), fan=3)
    seen = []
    for number in range(30):
        rows = spark.createDataFrame([(number % 4, number)], "id bigint, n bigint").coalesce(1)
        tiers.add(rows, number)
        if number % 7 == 0:
            tiers.add(rows, number)
        seen.append(len(tiers.parts()))
    assert max(seen) <= 2 * 4 and tiers.parts()[0] == (0, 26)
    assert {(r.id, r.n) for r in tiers.read().groupBy("id").agg(F.max("n").alias("n")).collect()} == {(0, 28), (1, 29), (2, 26), (3, 27)}
    # a merged part whose sources were not removed yet
    spark.createDataFrame([(9, 9)], "id bigint, n bigint").write.parquet(f"{tiers.path}/3-3")
    assert (3, 3) not in tiers.parts()


def test_a_failed_entity_comes_again(spark):
    shrink = lambda log: P.compact(log, KEYS, ORDER)
    tiers, outbox = D.Tiers(spark, fresh_path(spark, "state"), SCHEMA, shrink), fresh_path(spark, "outbox")
    sent = []

    def accepts(entities, number):
        sent.append(sorted(r.id for r in entities.collect()))
        return entities.where((F.col("id") != 1) | (F.lit(number) != 0))

    write = D.delivered_batches(tiers, outbox, KEYS, SCHEMA, accepts, shrink)
    state = lambda: told(P.document(tiers.read(), KEYS, ORDER))
    batch = lambda rows: P.leaves(spark.createDataFrame(rows, "id bigint, t bigint, patch string"), KEYS, ORDER, "patch")
    for _ in range(2):  # run again
        write(batch([(1, 1, '{"a": 1, "b": 1}'), (2, 1, '{"a": 5}')]), 0)
        assert state() == {(2, ("a",)): 5}
    write(batch([(1, 2, '{"a": null, "c": 2}')]), 1)
    assert state() == {(2, ("a",)): 5, (1, ("b",)): 1, (1, ("c",)): 2} and sent == [[1, 2], [1, 2], [1]]
