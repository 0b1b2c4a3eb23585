import os
import re

import pytest

from gaugeline import session
from gaugeline.llm.near_dups import deduplicated, near_duplicates
from gaugeline.llm.passages import without_repeats
from llm_texts import prose

LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)))


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({w[i : i + words] for i in range(max(1, len(w) - words + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize("small", [256, 2])
def test_components_of_odd_rows(odd, small):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in near_duplicates(odd, words=4, small=small).collect()), key=repr)
    assert got == brute_components(rows, 4, 80)


def test_a_chain_and_a_star_of_near_copies(spark):
    """Neighbours of the chain are linked, its ends are not; copies of the star are linked by their base only."""
    base = [f"s{i}" for i in range(300)]
    star = [" ".join(w if (i + 11 * k) % 31 else f"x{k}" for i, w in enumerate(base)) for k in range(40)]
    chain = [" ".join(f"c{i}" for i in range(8 * k, 8 * k + 200)) for k in range(12)]
    rows = [(1000 + i, t) for i, t in enumerate(star)] + [(999, " ".join(base))] + [(i, t) for i, t in enumerate(chain)] + [(500 + i, t) for i, t in enumerate(chain[:3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for small in (256, 4):
        got = sorted((tuple(r) for r in near_duplicates(docs, words=4, percent=70, small=small).collect()), key=repr)
        assert got == brute_components(rows, 4, 70)


def test_one_document_of_each_component_stays(odd, empty):
    kept = deduplicated(odd, words=4)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 5, 6, 7, 8, None, 10, 11, 12, 13], key=repr)
    assert near_duplicates(empty).count() == 0 and deduplicated(empty).count() == 0


def cut(text):
    """Spans of the units: after each newline, and after a stop before white space."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n" or (c in ".!?" and text[i + 1 : i + 2] in tuple(" \t\n\x0b\x0c\r"))]
    edges = sorted({0, *ends, len(text)})
    return list(zip(edges, edges[1:], strict=False))


def brute_passages(rows, min_words, unit_words):
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for k, (a, b) in enumerate(cut(text)):
            w = words_of(text[a:b])
            if len(w) >= unit_words:
                first[w] = min(first.get(w, (i, k)), (i, k))
    out = []
    for i, text in rows:
        units = cut(text or "")
        w = [words_of(text[a:b]) for a, b in units]
        marked = [i is not None and len(x) >= unit_words and first[x] != (i, k) for k, x in enumerate(w)]
        spans, k = [], 0
        while k < len(units):
            end, j = k, k
            while marked[k] and j < len(units) and (marked[j] or len(w[j]) < unit_words):
                end = j + 1 if marked[j] else end
                j += 1
            n = sum(map(len, w[k:end]))
            if n >= min_words:
                spans.append((units[k][0], units[end - 1][1], n))
            k = max(j, k + 1)
        for a, b, _ in reversed(spans):
            text = text[:a] + text[b:]
        out.append((i, text, spans))
    return sorted(out, key=repr)


def test_repeated_passages_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    result = without_repeats(odd, min_words=10)
    assert result.columns == [*(c for c in odd.columns if c != "removed"), "removed"]
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in result.collect()), key=repr)
    assert got == brute_passages(rows, 10, 4)
    assert any(r[2] for r in got)
    assert without_repeats(empty).count() == 0


def test_a_passage_inside_lines_goes_and_short_sentences_stay(spark):
    passage = prose(77, 63)
    rows = [(i, f"{prose(100 + i, 27)} {passage} {prose(200 + i, 45)} A short sentence of five.") for i in range(20)]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].text == rows[0][1] and not got[0].removed
    for i in range(1, 20):
        assert [s.words for s in got[i].removed] == [63] and passage not in got[i].text and got[i].text.endswith("five.")
        assert rows[i][1][got[i].removed[0].start : got[i].removed[0].end].strip() == passage


def brute_runs(rows, n):
    """Numbers of the words of each row in a run of ``n`` words that a document before it has, or the row itself before without overlap."""
    first = {}
    for i, text in rows:
        for k in range(len(w := words_of(text or "")) - n + 1 if i is not None else 0):
            first[w[k : k + n]] = min(first.get(w[k : k + n], i), i)
    out = []
    for i, text in rows:
        own, gone = {}, set()
        for k in range(len(w := words_of(text or "")) - n + 1 if i is not None else 0):
            run = w[k : k + n]
            if first[run] < i or own.setdefault(run, k) + n <= k:
                gone |= set(range(k, k + n))
        out.append(gone)
    return out


def test_runs_go_wherever_sentences_and_lines_end(spark, odd):
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    verse, passage = plain(31, 90).replace(" ", "\n"), plain(32, 70)
    texts = [
        plain(41, 30) + " " + passage + " " + plain(42, 30), plain(43, 11) + " " + passage.upper() + " " + plain(44, 11) + ".", verse, "head\n" + verse + "\ntail", plain(45, 49), plain(45, 49) + " more",
        "é " + " ".join(["ha"] * 180), plain(46, 60) + " x " + plain(46, 60) + " y", plain(47, 80) + "\n" + plain(48, 80), plain(49, 5) + " " + plain(47, 90).replace(" ", "\t") + plain(48, 70),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, plain(50, 70)), (9, plain(50, 70)), (None, passage), (11, passage[:-1]), (12, None), (13, "")]
    rows += [(r.doc_id + 20 if r.doc_id is not None else None, r.text) for r in odd.collect()]
    got = without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), min_words=10**6, run_words=50).collect()
    spans = {(r.doc_id, r.text): [tuple(s) for s in r.removed] for r in got}
    assert len(got) == len(rows)
    for (i, text), gone in zip(rows, brute_runs(rows, 50), strict=True):
        places = [m.span() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or "")]
        heads = [k for k in sorted(gone) if k - 1 not in gone]
        want = [(k, next(m for m in range(k, len(places) + 1) if m not in gone)) for k in heads]
        want = [(places[a][0], places[b - 1][1], b - a) for a, b in want]
        left = text
        for a, b, _ in reversed(want):
            left = left[:a] + left[b:]
        assert spans[i, left] == want
    assert sum(map(bool, spans.values())) >= 6


def brute_both(rows, min_words, unit_words, run_words):
    """(doc_id, text) without the spans of both rules; doc_ids are different."""
    units = {i: spans for i, _, spans in brute_passages(rows, min_words, unit_words)}
    out = []
    for (i, text), gone in zip(rows, brute_runs(rows, run_words), strict=True):
        places = [m.span() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or "")]
        drop = [False] * len(text or "")
        for a, b, _ in units[i]:
            drop[a:b] = [True] * (b - a)
        for k in gone:
            end = places[k + 1][0] if k + 1 in gone else places[k][1]
            drop[places[k][0] : end] = [True] * (end - places[k][0])
        out.append((i, text if text is None else "".join(c for c, d in zip(text, drop, strict=True) if not d)))
    return out


def test_marks_leave_no_files_but_their_own(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"head {i} " + text) for i in range(4)], "doc_id bigint, text string")
    written = lambda: set(session._WRITTEN.get(spark.sparkContext.applicationId, []))
    before = written()
    out = without_repeats(docs, run_words=50)
    left = written() - before
    assert len(left) == 2 and all(os.path.isdir(p) for p in left)  # of the units and of the runs that are marked
    assert [len(r.removed) for r in out.orderBy("doc_id").collect()] == [0, 1, 1, 1]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString()  # marks and texts grow together
