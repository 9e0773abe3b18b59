import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import _words as W
from tests.llm.helpers import words


def hashes(texts, monkey=None):
    out = []
    for found in W.words(pa.array(texts, pa.string())):
        h = found.hashes()
        out += [tuple(h[a:b]) for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aB é,.1", max_size=40)), max_size=12))
def test_words_are_the_regexes(texts):
    got = hashes(texts)
    assert len(got) == len(texts)
    seen = {}
    for text, mine in zip(texts, got, strict=True):
        want = words(text)
        assert len(mine) == len(want)
        for w, h in zip(want, mine, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_change_nothing(monkeypatch):
    texts = ["a b c", None, "longer text here " * 50, "", "É x"] * 7
    whole = hashes(texts)
    monkeypatch.setattr(W, "SLICE_BYTES", 64)
    assert [t for t in hashes(texts)] == whole
    parts = pa.array(["skip me", *texts], pa.string()).slice(1)
    assert [tuple(f.hashes()[a:b]) for f in W.words(parts) for a, b in zip(f.bounds[:-1], f.bounds[1:], strict=True)] == whole


def test_shingles():
    (found,) = W.words(pa.array(["", "a b", "a b c d e", "A-B-C-D-E f", "e d c b a"]))
    values, bounds = W.shingles(found, 5)
    assert list(bounds) == [0, 0, 1, 2, 4, 5]
    assert values[1] == values[2] and len(set(values.tolist())) == 4
