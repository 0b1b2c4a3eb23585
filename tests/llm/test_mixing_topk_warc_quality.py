import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import mixing, quality, topk, warc
from gaugeline.session import cut_lineage


def test_targets_share_the_excess_until_none_is_above(spark):
    sizes = {"a": 100, "b": 5000, "c": 900, "d": 0, "e": 30, None: 2000}
    rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_docs bigint, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    full, want, left = set(), {}, float(sum(sizes.values()))
    while True:  # the rule as stated: share by weight, stop those above, share again
        share = {s: left * weight[s] / sum(w for t, w in weight.items() if t not in full) for s in sizes if s not in full}
        above = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not above:
            want |= share
            break
        for s in above:
            full.add(s)
            want[s] = 3.0 * sizes[s]
            left -= want[s]
    assert got == {s: pytest.approx(v) for s, v in want.items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix(odd, block_docs=2, shard_words=4000)
    assert rows.columns == [*(c for c in odd.columns if c != "shard"), "shard", "pass"]
    first, second = rows.collect(), mixing.mix(odd.repartition(7), block_docs=2, shard_words=4000).collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and len({r.shard for r in first}) > 1
    assert all((r.text or "").split() for r in first)
    taken = {}
    for r in first:
        taken[(r.doc_id, r.text)] = taken.get((r.doc_id, r.text), 0) + 1
    assert max(taken.values()) <= 6  # the repeated row is two documents
    assert mixing.mix(empty).count() == 0


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([(0, 40), (1, 7), (2, 0), (3, 300)], "source_id bigint, quota bigint")
    rows = mixing.shard_blocks(spark, quotas, 37, seed=3).collect()
    assert sorted((r.source_id, r.v) for r in rows) == [(s, v) for s, n in ((0, 40), (1, 7), (3, 300)) for v in range(n)]
    per_shard = np.bincount([r.shard for r in rows], minlength=37)
    assert per_shard.min() >= 8 and per_shard.max() <= 11
    many = mixing.shard_blocks(spark, quotas, 700, seed=3)  # deeper than one task goes
    assert many.select("source_id", "v").distinct().count() == many.count() == 347


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(0)
    draws = np.array([mixing.draw(rng, np.array([10, 30, 60]), 20) for _ in range(4000)])
    assert (draws.sum(1) == 20).all() and draws.mean(0) == pytest.approx([2, 6, 12], abs=0.1)
    assert draws[:, 0].var() == pytest.approx(20 * 0.1 * 0.9 * 80 / 99, rel=0.1)


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(0, 600)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1050, None), (1051, [float("nan")] * 40), (1052, [None] + [0.1] * 39), (None, [0.0] * 40), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (1150, []), (1200, [float("inf")] * 40)]
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string").repartition(4), rows


def test_topk_against_brute_force(spark):
    df, rows = vectors(spark)
    whole = {i: np.floor(np.array([np.float32(x) for x in v], float) * 256) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q and len(whole[c]) == len(whole[q])))[:5]
        want += [(q, rank, c, -s) for rank, (s, c) in enumerate(best, 1)]
    for blocks in ((1024, 8192), (3, 50)):
        got = topk.search(df, F.col("vec_id") % 50 == 0, 5, *blocks).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(200, 37)) * 100 + 50, rng.normal(size=(20, 37)) * 100
    for s in topk.LEVELS:
        assert (topk.features(x, s) @ topk.features(q, s).T >= x @ q.T - 1e-6).all()


def test_large_components_are_exact_and_saturate():
    assert topk.products(np.array([[2.0**30, 1.0]]), np.array([2.0**30, 1.0])).tolist() == [2**60 + 1]
    assert topk.products(np.array([[1e18, 1e18]]), np.array([1e18, 1e18])).tolist() == [2**63 - 1]


def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i} é\r\n\r\nWARC/1.0</p>" * (i % 7)) for i in range(300)] + [(5, "http://x/5", None), (5, "http://x/5", None), (None, None, "lost"), (None, "http://y", None)]
    return spark.createDataFrame([(*r, "d") for r in rows], "page_id bigint, url string, html string, digest string").repartition(4)


def brute_audit(ours, theirs):
    """Verdicts from plain lists of (file, record_id, record) in file order; shifted records one by one."""
    out = []
    for file in sorted({r[0] for r in ours + theirs}):
        sides = []
        for side in (ours, theirs):
            at, seen, own = 0, {}, {}
            for _, name, record in (r for r in side if r[0] == file):
                seen[name] = seen.get(name, 0) + 1
                own[name, seen[name]] = (at, record)
                at += len(record.encode())
            sides.append(own)
        a, b = sides
        common = [k for k in a if k in b], [k for k in b if k in a]
        for k in {**a, **b}:
            if k not in b:
                out.append((k[0], "missing"))
            elif k not in a:
                out.append((k[0], "duplicate" if any(x[0] == k[0] for x in a) else "extra"))
            elif a[k][1] != b[k][1]:
                out.append((k[0], "changed"))
            elif common[0].index(k) != common[1].index(k):
                out.append((k[0], "moved"))
            elif a[k][0] != b[k][0]:
                out.append((k[0], "shifted"))
    return sorted(out)


@pytest.mark.parametrize("how", ["equal", "reversed", "swapped", "shifted", "twice", "lost", "bytes", "much"])
def test_audit_names_every_difference(spark, monkeypatch, how):
    monkeypatch.setattr(warc, "RANGE_BYTES", 3000)
    base = [(r.file, r.record_id, r.record) for r in warc.records_of(pages(spark), per_file=64).orderBy("file", "page_id", "record_id").collect()]
    other = list(base)
    if how == "reversed":
        other.reverse()
    elif how in ("swapped", "much"):
        other[10], other[11] = other[11], other[10]
        other[70], other[90] = other[90], other[70]
    if how in ("shifted", "much"):
        other.insert(100, (other[100][0], "new", "WARC/1.0 new record"))
    if how in ("twice", "much"):
        other.insert(40, other[37])
    if how in ("lost", "much"):
        del other[200], other[3]
    if how in ("bytes", "much"):
        other[20] = (*other[20][:2], other[20][2][:-5] + "~" + other[20][2][-4:])
        other[150] = (*other[150][:2], other[150][2] + "longer")
    frame = lambda rows: warc.laid_out(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, record_id string, record string, at bigint").repartition(5), ["at"])
    ours, theirs = warc.catalogue(frame(base)), warc.catalogue(frame(other))
    found = warc.audit(ours, theirs).collect()
    by_place = {(r.file, r.offset): r.record_id for r in ours.collect()} | {(r.file, "r", r.offset): r.record_id for r in theirs.collect()}
    got = []
    for r in found:
        if r.verdict == "shifted":
            run = sorted(o for f, o in (k for k in by_place if len(k) == 2) if f == r.file and r.offset <= o < r.offset + r.length)
            assert len(run) == r.n_records and r.length == r.replica_length
            got += [(by_place[r.file, o], "shifted") for o in run]
        else:
            got.append((by_place[(r.file, r.offset) if r.offset is not None else (r.file, "r", r.replica_offset)], r.verdict))
    assert sorted(got) == brute_audit(base, other)
    if how in ("equal", "swapped", "bytes"):
        kinds = {"equal": set(), "swapped": {"moved", "shifted"}, "bytes": {"changed", "shifted"}}[how]
        assert {v for _, v in got} <= kinds


def test_only_differing_ranges_are_opened(spark):
    records = warc.laid_out(warc.records_of(pages(spark), per_file=4096), ["page_id", "record_id"])
    other = records.withColumn("record", F.when(F.col("page_id") == 150, F.regexp_replace("record", "150 é", "151 é")).otherwise(F.col("record")))
    a, b = (warc.tree(warc.catalogue(x)) for x in (records, other))
    opened = warc.open_ranges(a, b).collect()
    assert len(opened) == 1 and a[0].count() > 1
    assert [(r.page_id, r.verdict) for r in warc.audit(warc.catalogue(records), warc.catalogue(other)).collect()] == [(150, "changed")]


def test_audit_of_planted_damage(spark):
    records = warc.records_of(pages(spark), per_file=64)
    got = {(r.page_id, r.verdict) for r in warc.audit(warc.catalogue(records), warc.catalogue(warc.damaged(records, F.col("page_id")))).where("verdict <> 'shifted'").collect()}
    assert got >= {(i, "missing") for i in range(0, 300, 61)} | {(i, "changed") for i in range(300) if i % 61 and (i % 53 == 1 or i % 47 == 2)}
    assert {(3, "moved"), (4, "moved"), (5, "duplicate"), (94, "duplicate")} <= got
    none = records.limit(0)
    assert warc.audit(warc.catalogue(none), warc.catalogue(none)).count() == 0
    assert {r.verdict for r in warc.audit(warc.catalogue(none), warc.catalogue(records)).collect()} == {"extra"}


def test_warc_files_round_trip(spark, tmp_path):
    records = warc.records_of(pages(spark), per_file=64)
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(r.record for r in back.collect()) == sorted(r.record for r in records.collect())
    one = [r for r in back.collect() if r.offset == 0]
    assert len(one) == records.select("file").distinct().count()
    own = warc.laid_out(records, ["page_id", "record"])  # the order in which the files are written
    assert warc.audit(warc.catalogue(own), warc.catalogue(back)).count() == 0


def test_statistics_by_plain_python(odd):
    rows = quality.features(odd.select("doc_id", "text", "lang")).collect()
    names = list(quality.STATISTICS)
    for r in rows:
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id) or ""
        words = text.encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        lines = [tuple(line.split()) for line in text.encode().split(b"\n") if line.split()]
        assert r.x[names.index("words")] == pytest.approx(math.log1p(len(words)))
        assert r.x[names.index("lines")] == pytest.approx(math.log1p(len(lines)))
        assert r.x[names.index("distinct_words")] == pytest.approx(math.log(1e-3 + len(set(words)) / max(len(words), 1)))
        assert r.x[names.index("repeat_windows")] == pytest.approx(math.log(1e-3 + (len(windows) - len(set(windows))) / max(len(windows), 1)))
        assert r.x[names.index("repeat_lines")] == pytest.approx(math.log(1e-3 + (len(lines) - len(set(lines))) / max(len(lines), 1)))


def test_margin_is_the_difference_of_normal_log_densities(spark):
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x = {c: rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) + c for c in (0, 1)}
    labelled = cut_lineage(spark.createDataFrame([(c, [float(v) for v in row]) for c in x for row in x[c]], "label int, x array<double>"))
    made = quality.fit(labelled, pooled_share=0.0, diagonal_share=0.0)
    point = x[1][:5]

    def log_density(c):
        cov, gap = np.cov(x[c].T, bias=True) + 1e-6 * np.eye(d), point - x[c].mean(0)
        return -(np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)) / 2

    assert made.margin(point) * made.temperature == pytest.approx(log_density(1) - log_density(0), rel=1e-5)


def test_quality_of_odd_and_unlabelled_tables(odd, labels, empty):
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in quality.quality(odd, labels.where("quality = 1")).collect()}) == 1
    assert quality.quality(empty, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{base}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95


def test_the_mix_deals_texts_once_and_takes_what_is_drawn(spark):
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (i * 7 % 23)) or None) for i in range(400)] + [(None, None, "a b c")] * 5 + [(7, "s1", "twice here")] * 4
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    settings = {"block_docs": 16, "shard_words": 500}
    mixed = mixing.mix(docs, 3, **settings)
    plan = mixed._jdf.queryExecution().toString()
    wide = [line for line in plan[plan.index("Physical Plan"):].splitlines() if "Exchange hashpartitioning" in line]
    assert not any("hashpartitioning(source_id" in line for line in wide) and sum("hashpartitioning(_shard" in line for line in wide) == 1
    sized = docs.withColumn("size", mixing.document_size(F.col("text")))
    drawn = mixing.draw_mix(sized, mixing.with_targets(sized), 3, **settings)
    want = drawn.select("doc_id", "source", "text", F.explode("drawn").alias("d")).select("doc_id", "source", "text", "d.shard", "d.pass")
    count = lambda df: sorted(map(str, df.groupBy(*df.columns).count().collect()))
    assert count(mixed.select(want.columns)) == count(want) and want.count() > 300
