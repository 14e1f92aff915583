import hashlib
import random
import zlib

import pytest

from postmatch.llm import periodic
from tests.llm import odd_tables as samples


def plain_runs(words, least=12):
    """Every stretch of every period, kept where no smaller period fits."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        same = [k + q < len(words) and words[k] == words[k + q] for k in range(len(words))]
        start = 0
        while start < len(words):
            end = start
            while same[end]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least, 2 * q):
                part = words[start:start + length]
                if all(part[r:] != part[:-r] for r in range(1, q)):
                    out.append((start, length, q))
            start = end + 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def plain_text(doc_id, text):
    words = samples.split(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = plain_text(doc_id, text)
    runs = plain_runs(words)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *shown, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(kept))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 4)):
            words = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 6))) for _ in range(rng.choice((0, 1, 7, 40)))]
            texts.append(words + words[-rng.randint(1, 9):] * rng.randint(0, 5) + words[:rng.randint(0, 6)])
        assert periodic.runs_of(texts, least) == [plain_runs(w, least) for w in texts]


def test_nested_runs_and_equal_starts():
    inner = [b"a", b"a", b"a", b"b"]
    words = inner * 5
    assert periodic.runs_of([words, [b"a"] * 12, words], 2) == [plain_runs(words, 2), [(0, 12, 1)], plain_runs(words, 2)]


def test_a_long_text_of_one_word_and_of_two():
    rng = random.Random(3)
    assert periodic.runs_of([[b"na"] * 50_000]) == [[(0, 50_000, 1)]]
    block = [b"%d" % rng.randrange(10_000) for _ in range(20_000)]
    assert periodic.runs_of([block * 3]) == [[(0, 60_000, 20_000)]]


def test_query_matches_brute_force(spark):
    rows = [(d, t) for d, t, *_ in samples.rows() if len(t or "") < 4000]
    rows += [(k, samples.prose(random.Random(k), 90)) for k in range(2000, 2060)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(repr, map(tuple, periodic.run_digests(docs).collect())))
    want = sorted(repr(plain_row(d, t)) for d, t in rows)
    assert got == want
    assert sum("None, None, None, None" not in row for row in want) > 5


def test_operator_gives_runs_and_texts(spark):
    docs = spark.createDataFrame(
        [("k", "x " + "ab cd " * 6 + "y", "1", "2"), (None, None, None, None), ("e", " \t", "", "")],
        "doc_id string, text string, runs string, collapsed string")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got["k"].runs] == [(1, 12, 2)] and got["k"].collapsed == "x ab cd y"
    assert got[None].runs == got["e"].runs == [] and got[None].collapsed == got["e"].collapsed == ""


def test_odd_tables(spark):
    assert periodic.run_digests(samples.empty(spark)).count() == 0
    assert periodic.run_digests(samples.documents(spark)).count() == len(samples.rows())
