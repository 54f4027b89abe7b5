import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substring
from tessera.llm._common import Words, grams


def thue_morse(n, swapped=False):
    return "".join("ab"[(bin(i).count("1") + swapped) % 2] for i in range(n))


def test_structured_words_do_not_clash(spark, tmp_path):
    """A polynomial modulo a power of two can't tell a long Thue-Morse word from its complement."""
    head = " ".join(f"w{i}" for i in range(34))
    for n in (8, 64, 256, 1024, 4096):
        words = Words([f"{head} {thue_morse(n)} {thue_morse(n, True)}".encode()])
        for lane in (0, 1):
            h = words.hashes(lane)
            assert len(set(h.tolist())) == 36
            assert len(set(grams(h, 35).tolist())) == 2
    rows = [(1, f"{head} {thue_morse(1024)}"), (2, f"{head} {thue_morse(1024, True)}"), (3, f"{head} same"), (4, f"{head} same")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.n_removed for r in substring.op7_substring_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {1: 0, 2: 0, 3: 35, 4: 35}


def test_order_of_two_words_counts():
    """Thue-Morse orders of two words, as windows."""
    order = [("x", "y")[c == "b"] for c in thue_morse(4096)]
    other = [("x", "y")[c == "b"] for c in thue_morse(4096, True)]
    a, b = (grams(Words([" ".join(o).encode()]).hashes(), 32) for o in (order, other))
    plain = [{tuple(o[i : i + 32]) for i in range(len(o) - 31)} for o in (order, other)]
    assert len(set(a.tolist())) == len(plain[0]) and len(set(a.tolist()) & set(b.tolist())) == len(plain[0] & plain[1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc \t", max_size=60), min_size=1, max_size=5), st.integers(1, 40))
def test_equal_hashes_are_equal_words(texts, size):
    words = Words([t.encode() for t in texts])
    plain = [w for t in texts for w in t.split()]
    for lane in (0, 1):
        h = words.hashes(lane)
        assert len({*zip(plain, h.tolist())}) == len(set(plain)) == len(set(h.tolist()))
        runs = [tuple(plain[i : i + size]) for i in range(len(plain) - size + 1)]
        found = grams(h, size).tolist()
        assert len(found) == len(runs) and len({*zip(runs, found)}) == len(set(runs)) == len(set(found))


def test_long_words_and_lanes():
    texts = [b"x" * n for n in (1, 7, 8, 9, 16, 255, 256, 257, 100_000)]
    a, b = Words(texts).hashes(), Words(texts).hashes(1)
    assert len(set(a.tolist()) | set(b.tolist())) == 2 * len(texts)
    assert (np.concatenate([Words([t]).hashes() for t in texts]) == a).all()
