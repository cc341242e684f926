"""N-gram Jaccard join, components and line deduplication against brute force."""

import random
import re
import time
from pathlib import Path

import pytest

from tidewell.llm import common, shingle_join, textkit
from tidewell.llm.graph import components, merged
from tidewell.llm.line_dedup import dedup_lines, dropped_lines
from tidewell.llm.shingle_join import Tiles, shingle_components
from tidewell.llm.textkit import shingle_sets, windows

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"


def words(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, num, den):
    sets, root = {i: shingles(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * den >= num * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed, groups=12, size=9):
    """Copies with few and with many edits, so that pairs lie on both sides of the limit."""
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for k in range(groups):
        base = [g.choice(vocabulary) for _ in range(g.choice([4, 9, 15, 40, 120, 300]))]
        for _ in range(size):
            text = list(base)
            for _ in range(g.randint(0, 1 + len(base) // 30)):
                text[g.randrange(len(text))] = g.choice(vocabulary)
            rows.append((1000 - n, " ".join(text).upper() if n % 7 == 0 else "  ".join(text)))
            n += 1
    return rows


EDGES = [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "x " * 30000), (5007, "x " * 29000)]


@pytest.mark.parametrize(("n", "num", "den", "seed"), [(3, 9, 10, 1), (5, 4, 5, 2), (2, 1, 2, 3)])
def test_components_match_brute_force(spark, monkeypatch, n, num, den, seed):
    rows = corpus(seed) + EDGES + [(6000 + i, "the same text that many have") for i in range(30)]
    monkeypatch.setattr(common, "HOT_PARTS", 200)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", node long, keys long, component_id long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(df, n, num, den).collect()}
    assert got == brute_components(rows, n, num, den)


def test_components_of_an_empty_table(spark):
    assert shingle_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_without_id_leave_the_others_ids_whole(spark):
    rows = [(None, "a b c d"), (2**60 + 1, "a b c d"), (2**60 + 3, "A b c  d"), (-(2**60) - 5, "e f"), (None, ""), (2**60 + 7, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(spark.createDataFrame(rows, SCHEMA), 3, 9, 10).collect()}
    assert got == brute_components([r for r in rows if r[0] is not None], 3, 9, 10)


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data") if f.stat().st_size > 1000}  # counts leave less


def test_disk_holds_keys_and_shuffles_once(spark, monkeypatch):
    stored, stash = [], shingle_join.stash
    monkeypatch.setattr(shingle_join, "stash", lambda df, label: stored.append(df.columns) or stash(df, label))
    before = shuffle_files(spark)
    shingle_components(spark.createDataFrame(corpus(9), SCHEMA))
    assert stored and not any("cells" in columns for columns in stored)
    end = time.time() + 5  # files are deleted a moment after their query
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_likely_rows_hold_all_that_a_join_wants(spark):
    keys = spark.range(0, 5000, 50).withColumnRenamed("id", "key")
    got = {r.id for r in common.likely(spark.range(5000), "id", keys).collect()}
    assert got >= {*range(0, 5000, 50)} and len(got) < 1000
    assert common.likely(spark.range(5), "id", keys.where("key < 0")).count() == 0


def test_near_sets_always_share_a_key():
    g, tiles = random.Random(4), Tiles(4, 5)
    for _ in range(300):
        base = [str(g.random()) for _ in range(g.choice([3, 8, 20, 60, 200]))]
        other = list(base)
        for _ in range(g.randint(0, len(base) // 10 + 1)):
            other[g.randrange(len(other))] = str(g.random())
        a, b = shingle_sets([" ".join(base), " ".join(other)], 1)
        both = len({*a} & {*b})
        if both * 5 >= 4 * len({*a} | {*b}):
            assert {*tiles.keys(a)} & {*tiles.keys(b)}


def test_graph(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    rows = [*chain, (100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 150: 150, 200: 150, 300: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_edges_merge_components(spark):
    first, more = [(1, 2), (3, 4), (10, 11)], [(2, 3), (11, 30), (40, 41), (1, 4)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {r.node: r.component for r in merged(components(table(first)), table(more)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 30: 10, 40: 40, 41: 40}


def test_long_texts_are_hashed_in_windows(monkeypatch):
    rows = ["a bb  ccc\n" * 50, None, "", "x" * 300 + " y", "z " * 400, "\t"]
    whole = [s.tolist() for s in shingle_sets(rows, 2)]
    monkeypatch.setattr(textkit, "windows", lambda data: windows(data, 16))
    assert [s.tolist() for s in shingle_sets(rows, 2)] == whole


def near(a, b):
    m, p, s = min(len(a), len(b)), 0, 0
    while p < m and a[p] == b[p]:
        p += 1
    while s < m and a[-1 - s] == b[-1 - s]:
        s += 1
    return abs(len(a) - len(b)) <= 1 and (a == b or p + s >= max(len(a), len(b)) - 1)


def units(line, exact=5, characters=20):
    """The units of a line and whether near ones count; None for a line that stays."""
    w = [x for x in re.split("[ \t\x0b\x0c\r]+", line.lower()) if x]
    if len(w) >= exact:
        return ("w", *w), len(w) >= 8
    text = " ".join(w)
    return (("c", *text), True) if len(text) >= characters else (None, False)


def brute_lines(rows):
    lines = sorted((i, k, *units(x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")))
    first, out = {}, set()
    for i, k, u, close in lines:
        if u is None:
            continue
        if u in first or (close and any(c and x[0] == u[0] and near(u[1:], x[1:]) for x, c in first.items())):
            out.add((i, k))
        first.setdefault(u, close)
    return out


def test_lines_match_brute_force(spark, monkeypatch):
    g = random.Random(9)
    vocabulary = [f"v{i}" for i in range(6)]
    rows = []
    for i in range(60):
        lines = [" ".join(g.choice(vocabulary) for _ in range(g.choice([1, 4, 5, 7, 8, 8, 9, 9, 10, 11]))) for _ in range(g.randint(1, 6))]
        rows.append((i, "\n".join(lines)))
    base = "one two three four five six seven eight nine"
    rows += [(80 + i, x) for i, x in enumerate(["All rights reserved", "all rights reserved", "東京都千代田区の長い段落がここにあり、繰り返されます。", "東京都千代田区の長い段落がここにあり、繰返されます。", "東京都の段落", "東京都の段落", "Internationalisation considerations apply", "internationalisation  Consideration\tapply ", "inter nationalisation considerations apply", "one two three four 5x"])]
    rows += [(100, base), (101, base.replace("four", "FOUR x")), (102, base + " ten"), (103, None), (104, ""), (105, base.replace("one ", "")), (106, "\n\n"), (107, base + " " + "z " * 5000), (108, base + " " + "z " * 4999), (108, base), (109, "\n".join([base] * 40))]
    rows += [(200 + i, "a line that very many of the documents hold in common" + " again" * (i % 7 == 0)) for i in range(300)]
    monkeypatch.setattr(common, "HOT_PARTS", 10)  # some lines are hot, others not
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_lines(rows)
    assert {(r.doc_id, r.pos) for r in dropped_lines(df).collect()} == want
    clash = spark.createDataFrame([(*r, "a", 7) for r in rows], SCHEMA + ", _gone string, n_lines int")
    kept = {r.doc_id: r for r in dedup_lines(clash).collect()}
    assert {r.doc_id: r["_gone"] for r in kept.values()} == {i: "a" for i, _ in rows}
    for i, t in rows:
        if i == 108:  # two rows are one document
            continue
        lines = [] if t is None else t.split("\n")
        assert kept[i].n_lines == len(lines)
        assert kept[i].text == (None if t is None else "\n".join(x for k, x in enumerate(lines) if (i, k) not in want))
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_line_takes_linear_time(spark):
    g = random.Random(4)
    long = [str(g.randrange(10**6)) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:45_000] + long[45_001:])), (3, " ".join([*long[:20_000], "x", *long[20_001:]])), (4, " ".join([*long[:9], "x", "y", *long[11:]]))]
    start = time.time()
    assert {(r.doc_id, r.pos) for r in dropped_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == {(2, 0), (3, 0)}
    assert time.time() - start < 60
