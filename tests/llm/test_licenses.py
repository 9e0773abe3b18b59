import random

import pytest

from tessera.llm import licenses as L
from tests.llm.helpers import ODD, docs, prose, words
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.01"


def brute(text):
    w, found = words(text), []
    for order, x in enumerate(L.LICENSES):
        h, spans = len(x.words), []
        for lo in range(0, len(w), h):
            at = [i for i in range(lo, min(lo + 2 * h, len(w)) - 2) if " ".join(w[i : i + 3]) in x.shingles]
            if len({" ".join(w[i : i + 3]) for i in at}) >= 0.8 * len(x.shingles) - 1e-9:
                if spans and spans[-1][1] > at[0]:
                    spans[-1][1] = max(spans[-1][1], at[-1] + 3)
                else:
                    spans.append([at[0], at[-1] + 3])
        found += [(a, order, b) for a, b in spans]
    return sorted(found)


def run(spark, texts):
    return {r.doc_id: [tuple(s) for s in r.spans] for r in L.scanned(docs(spark, list(enumerate(texts)), extra=True)).collect()}


def edited(text, seed, every):
    """Every so manieth word changed."""
    rng = random.Random(seed)
    return " ".join("zz" if i % every == rng.randrange(every) else w for i, w in enumerate(text.split()))


@pytest.fixture(scope="module")
def texts():
    out = [t for _, t in ODD]
    for n, x in enumerate(L.LICENSES):
        for k in (0, 1, len(x.words) - 1, 777, 20_000):  # far into a text, and at any place against the windows
            out.append(f"{prose(n, k)} {x.text} {prose(k, 40)}")
        out += [x.text, x.text.upper(), f"{x.text} {x.text}\n{prose(n, 300)}\n{x.text}", " ".join(x.text.split()[: len(x.words) // 2])]
        out += [f"{prose(n, 13 + n)} {edited(x.text, s, e)} end" for s, e in enumerate((8, 15, 25, 40))]
    return out + [" ".join(x.text for x in L.LICENSES), "Released under the MIT Licence"]


def test_against_python(spark, texts):
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert run(spark, texts) == want
    assert {o for spans in want.values() for _, o, _ in spans} == set(range(len(L.LICENSES)))


def test_whole_texts_are_found_anywhere(spark):
    rows = [(n, k) for n in range(len(L.LICENSES)) for k in (0, 5, 61, 400)]
    got = run(spark, [f"{prose(k, k)} {L.LICENSES[n].text} {prose(n, k)}" for n, k in rows])
    for i, (n, k) in enumerate(rows):
        assert any(o == n and a <= k and b >= k + len(L.LICENSES[n].words) for a, o, b in got[i])


def test_bands_find_the_least_similar_windows():
    for x in L.LICENSES:
        most = 2 * len(x.words) - L.SHINGLE + 1  # shingles of a window
        assert (1 - x.least / (most + len(x.shingles) - x.least)) ** L.BANDS < 1e-5


def test_rows_stay(spark):
    assert L.scanned(docs(spark, ODD)).count() == len(ODD)
    assert L.scanned(docs(spark, [])).count() == 0


def test_matches_sql(spark):
    got = rows_of(L.op6_licenses(spark, SF))
    assert got == rows_of_sql(connect(SF), L.OP6_SQL)
    assert sum(r[1] > 0 for r in L.op6_licenses(spark, SF).collect()) == 39


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["op6_licenses"] is L.op6_licenses and entry.oracle_sql()["op6_licenses"] == L.OP6_SQL
