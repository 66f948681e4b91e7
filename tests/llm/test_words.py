import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from grantlake.llm import _words as W

text = st.text(alphabet=st.sampled_from("aAbZ\t\n \x0b\x1c\x85é€x."), max_size=40)


@given(st.lists(st.one_of(st.none(), text), max_size=6))
@settings(max_examples=200, deadline=None)
def test_hashes_are_those_of_the_words(texts):
    hashes, at = W.word_hashes(pa.array(texts, pa.string()))
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert [int(b - a) for a, b in zip(at, at[1:])] == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_blocks_do_not_cut_words(monkeypatch):
    texts = pa.array(["ab " * 50 + "long" * 30, None, "", "tail  x"] * 5, pa.string())
    whole = W.word_hashes(texts)
    monkeypatch.setattr(W, "_BLOCK", 7)
    small = W.word_hashes(texts)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()


def test_sliced_columns():
    texts = pa.array(["a b", "c", "d e f"])
    part = W.word_hashes(texts.slice(1))
    whole = W.word_hashes(texts)
    assert (part[0] == whole[0][2:]).all() and part[1].tolist() == [0, 1, 4]


def test_short_texts_are_one_shingle():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(W.shingles(h[:0])) == 0 and len(W.shingles(h[:4])) == 1 and len(W.shingles(h)) == 3
