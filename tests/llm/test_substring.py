from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substring


def result(docs):
    return sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring.op7_substring_dedup(docs).collect())


def texts(docs):
    return [(r[0] or "").encode() for r in docs.select("text").collect()]


def test_brute_force_on_documents(spark, sf01, odd_docs, tmp_path):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    expected = sorted(substring.plain_removal(texts(docs)))
    assert result(docs) == expected
    # in many files, copies are rarely in one batch
    docs.repartition(12).write.parquet(str(tmp_path / "d"))
    assert result(spark.read.parquet(str(tmp_path / "d"))) == expected
    assert result(odd_docs) == sorted(substring.plain_removal(texts(odd_docs)))


def test_whole_rows_stay_in_place(spark, odd_docs):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.op7_substring_dedup(odd_docs).collect()}
    assert (5, 60, 60) in got and (6, 64, 60) in got and (1, 0, 0) in got and (2, 0, 0) in got
    kept = substring.remove_repeats(odd_docs).where("doc_id = 6").first()
    assert kept.kept == "before this after that" and kept.score == "clash" and kept.repeats == [[2, 62]]


def test_empty(empty_docs):
    assert result(empty_docs) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4))
def test_every_window_is_led_by_a_position(parts):
    from tessera.llm._common import Words

    for window in (5, 6, 9):
        words = Words([" ".join(p).encode() for p in parts])
        _, first, low = substring.leaders(words, window)
        text, anchor = substring.anchor_positions(words, window)
        of = words.text_of()[first] if len(first) else []
        assert {(int(t), int(a)) for t, a in zip(of, low)} == {(int(t), int(a)) for t, a in zip(text, anchor)}
