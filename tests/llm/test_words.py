import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textward.llm import words

from .cases import words as plain

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB cé\t\n\x0b\x1c\x85漢", max_size=40)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 64))
def test_words_are_those_of_the_contract(texts, piece):
    old, words.PIECE_BYTES = words.PIECE_BYTES, piece
    try:
        raw, offs = words.utf8(pa.array(texts, pa.string()))
        h, rows, starts, ends = words.word_hashes(raw, offs, spans=True)
    finally:
        words.PIECE_BYTES = old
    each = [plain(t) for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in each]
    flat = [w for ws in each for w in ws]
    assert [raw[a:b].tobytes().decode().translate({c: c + 32 for c in range(65, 91)}) for a, b in zip(starts, ends)] == flat
    code = {}
    for w, x in zip(flat, h.tolist()):
        assert code.setdefault(w, x) == x
    assert len(set(code.values())) == len(code)


def test_windows_stay_inside_rows():
    rows = np.array([0, 3, 3, 4, 9])
    at, out = words.windows(rows, 3)
    assert at.tolist() == [0, 4, 5, 6]
    assert out.tolist() == [0, 1, 1, 1, 4]


def test_slices_cover_all_rows_in_order():
    column = pa.array(["a" * 10, None, "b" * 300, "", "c"])
    assert list(words.slices(column, 20)) == [(0, 2), (2, 3), (3, 5)]
    assert list(words.slices(pa.array([], pa.string()))) == []
