import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import packing
from lamina.llm.pieces import SegmentCache, one_by_one, text_ids


def brute(lengths, size):
    rows, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [r for r in range(len(rows)) if free[r] >= lengths[i]]
        if fit:
            r = min(fit, key=lambda r: (free[r], r))
        else:
            rows.append([])
            free.append(size)
            r = len(rows) - 1
        rows[r].append(i)
        free[r] -= lengths[i]
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_equals_search_of_all_rows(lengths):
    assert packing.best_fit_decreasing(np.array(lengths, np.int64), 16) == brute(lengths, 16)


@pytest.fixture(scope="module")
def enc():
    return packing.encoder(open(packing.RANKS, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ é 　 \n\t  '.!9sll漢"), max_size=24), min_size=1, max_size=6))
def test_segments_encode_like_whole_texts(texts):
    import pyarrow as pa

    enc = packing.encoder(open(packing.RANKS, "rb").read())
    cache = SegmentCache(one_by_one(lambda b: enc.encode_ordinary(b.decode())))
    got = []
    for lo, hi, ids, at in text_ids(pa.array(texts), packing.cuts, cache):
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [enc.encode_ordinary(t) for t in texts]


def test_rows_hold_every_token_once(spark, enc):
    rows = [(i, t) for i, t in enumerate(["hello world", None, "", "a b c " * 500, "x" * 5000, "hello world"])] + [(None, "no id"), (0, "hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as input_ids")
    out = packing.packed(df, row_tokens=64, window=1000).collect()
    got = {}
    for r in out:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert (ids[r.n_tokens :] == packing.PAD).all() and len(r.doc_ids) == r.n_segments
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            got.setdefault((d, p), []).append(ids[a:b].tolist())
    assert len({r.bin_id for r in out}) == len(out)
    for d, text in {(d, t) for d, t in rows}:
        want = enc.encode_ordinary(text or "")
        times = rows.count((d, text))
        for k in range(0, len(want), 64):
            assert got.pop((d, k // 64)) == [want[k : k + 64]] * times
    assert not got
    assert packing.packed(df.where("false")).count() == 0
