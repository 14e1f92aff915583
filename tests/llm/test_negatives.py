import math
import random

import duckdb
import numpy as np
import pytest

from postmatch.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank int, no string, parts string"


def vectors(seed, n, width, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(10)]
    out = []
    for k in range(n):
        label = rng.randrange(10)
        out.append((k * 5, [c + rng.gauss(0, 0.5) for c in centres[label]], label))
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 0.5, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)


def plain(rows, relabel=7, every=100, positives=5, negatives_=10):
    whole = []
    for vec_id, vector, label in rows:
        if None in (vec_id, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % relabel == 0 else label
        whole.append((vec_id, tuple(math.floor(256 * float(np.float32(x))) for x in vector), label))
    out = []
    for a, av, al in sorted(set(r for r in whole if r[0] % every == 0)):
        scored = [(-sum(x * y for x, y in zip(av, v)), i, lab) for i, v, lab in whole]
        best = sorted(s for s in scored if s[2] == al and s[1] != a)[:positives]
        for minus, p, _ in best:
            top = -minus
            inside = sorted(s for s in scored if s[2] != al and 30 * top <= -100 * s[0] <= 90 * top)
            out += [(a, p, k + 1, i, top, -s) for k, (s, i, _) in enumerate(inside[:negatives_])]
    return sorted(out)


def found(spark, rows, relabel=7, **more):
    own = negatives.whole_rows(table(spark, rows), relabel=relabel)
    return sorted(map(tuple, negatives.hard_negatives(own, **more).collect()))


@pytest.mark.parametrize("width, sizes", [(6, {"block_rows": 64, "group_rows": 3}), (40, {}), (2, {"block_rows": 33})])
def test_matches_brute_force(spark, width, sizes):
    rows = vectors(width, 400, width)
    want = plain(rows)
    assert found(spark, rows, **sizes) == want and len(want) > 100


def test_odd_rows(spark):
    rows = vectors(1, 120, 4)
    rows += [
        (None, [1.0, 1.0, 1.0, 1.0], 1), (700, None, 1), (800, [1.0, 2.0], None), (900, [1.0, None], 2),
        (1000, [float("nan"), 1.0], 2), (1100, [float("inf"), 1.0], 2), (1200, [], 3), (1300, [0.0] * 4, 3),
        (1400, [2.0], 4), (1401, [2.0, 1.0, 1.0, 1.0, 9.0], 4), (-100, [1.0, -1.0, 0.5, 0.25], 5),
    ]
    rows += [rows[0], rows[0], rows[7], rows[7], (rows[7][0], [0.5] * 4, 8)]  # repeated rows and a repeated id
    assert found(spark, rows, block_rows=16) == plain(rows)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 0.0], 1) for k in range(94, 104)] + [(k, [0.5, 0.0], 2) for k in range(300, 340)]
    got = found(spark, rows, relabel=None, block_rows=7)
    assert got == plain(rows, relabel=1 << 40)
    assert [r[3] for r in got if r[0] == 100 and r[1] == 94] == list(range(300, 310))


def test_large_components_stay_whole(spark):
    rows = [(100, [3e9, 1.0], 1), (1, [1e4, 7.5], 1), (2, [5e3, -3.0], 2), (3, [5e3, 1e9], 2)]
    assert found(spark, rows, relabel=None) == plain(rows, relabel=1 << 40)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, None, 1)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []


def test_walk_stops_before_the_end():
    rng = np.random.default_rng(1)
    parts = np.floor(rng.normal(size=(4000, 3)) * 1000)
    lists = np.argsort(parts, axis=0, kind="stable").T.astype(np.uint16)
    block = negatives.Block(4000, 3, np.arange(4000).tobytes(), np.zeros(4000, np.int64).tobytes(),
                            parts.tobytes(), np.ascontiguousarray(lists).tobytes())
    anchor = np.array([900.0, -400.0, 50.0])
    scores = parts @ anchor
    met = 0
    for fresh, score, bound in block.walk(anchor):
        met += len(fresh)
        assert (score == scores[fresh]).all()
        if bound < np.sort(scores)[-10]:
            break
    assert met < 2000
    (ids, reached), = block.best(anchor, np.ones(4000, bool), [(-np.inf, np.inf)], 10)
    assert ids.tolist() == np.lexsort((np.arange(4000), -scores))[:10].tolist() and (reached == scores[ids]).all()


def test_sql_agrees_with_brute_force():
    rows = vectors(3, 300, 5) + [(2000, [1.0, float("nan")], 2), (2100, None, 2), (2200, [1.0, None], 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(negatives.ORACLE).fetchall()) == plain(rows)
