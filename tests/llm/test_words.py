"""Words, hashes and sliding windows against plain Python."""

import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm import words as w
from shelfcast.llm.repeats import ByteSymbols, WordSymbols, sliding_min, stretches

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXT = st.text(alphabet=st.sampled_from("aBz09 \n\t\x0b\x00|é  漢-"), max_size=60)


def plain(form, text):
    if form is w.SPACED:
        return re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("form", [w.SPACED, w.FOLDED])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.none() | TEXT, min_size=1, max_size=6))
def test_words_match_the_pattern(form, texts):
    found = w.find_words([None if t is None else t.encode() for t in texts], form)
    data, by_hash = found.data.tobytes(), {}
    for k, text in enumerate(texts):
        a, b = found.first[k], found.first[k + 1]
        own = [data[x:y].decode() for x, y in zip(found.starts[a:b], found.ends[a:b])]
        own = [x.translate(LOWER) for x in own] if form is w.FOLDED else own
        assert own == plain(form, text)
        for word, h in zip(own, found.hashes[a:b].tolist()):
            assert by_hash.setdefault(word, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_a_word_longer_than_a_piece():
    long = b"ab" * w.PIECE
    found = w.find_words([long + b" x " + long, long], w.SPACED)
    assert found.counts.tolist() == [3, 1]
    assert found.hashes[0] == found.hashes[2] == found.hashes[3] != found.hashes[1]


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_rolling_names_equal_runs(symbols, n):
    codes = w.mix(np.array(symbols, np.uint64))
    hashes = w.rolling(codes, n).tolist()
    runs = [tuple(symbols[i : i + n]) for i in range(len(symbols) - n + 1)]
    assert len(hashes) == len(runs)
    assert len(set(zip(runs, hashes))) == len(set(runs)) == len(set(hashes))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.data())
def test_sliding_min(values, data):
    n = data.draw(st.integers(1, len(values)))
    assert sliding_min(np.array(values), n).tolist() == [min(values[i : i + n]) for i in range(len(values) - n + 1)]


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.text("ab ", max_size=30), min_size=1, max_size=5), kind=st.sampled_from([WordSymbols, ByteSymbols]))
def test_segments_hold_every_window_once(texts, kind):
    symbols = kind([t.encode() for t in texts])
    window, gram = 5, 2
    seen = []
    for s in stretches(symbols, window, gram):
        for start, n, anchor in zip((s.at + s.start).tolist(), s.windows.tolist(), (s.at + s.anchor).tolist()):
            seen += range(start, start + n)
            assert start + n - 1 <= anchor <= start + window - gram
    first = symbols.first.tolist()
    assert seen == [i for a, b in zip(first, first[1:]) for i in range(a, b - window + 1)]


def test_segments_across_stretches(monkeypatch):
    from shelfcast.llm import repeats

    monkeypatch.setattr(repeats, "PIECE", 16)
    symbols = ByteSymbols([bytes(range(65, 91)) * 4])
    seen = [i for s in stretches(symbols, 5, 2) for a, n in zip(s.at + s.start, s.windows) for i in range(a, a + n)]
    assert seen == list(range(len(symbols) - 4))


def test_long_words_of_two_letters_differ():
    """A Thue-Morse word and its complement, which polynomial hashes modulo a power of two cannot tell apart."""
    for form in (w.SPACED, w.FOLDED):
        for size in (256, 1024, 4096):
            word = bytes(b"ab"[bin(i).count("1") % 2] for i in range(size))
            other = word.translate(bytes.maketrans(b"ab", b"ba"))
            hashes = w.find_words([word + b" " + other + b" " + word], form).hashes
            assert hashes[0] == hashes[2] != hashes[1]
    upper = w.find_words([b"A" * 300 + b" " + b"a" * 300], w.FOLDED).hashes
    assert upper[0] == upper[1]
