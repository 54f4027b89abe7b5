import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import decontam, toxicity
from tessera.llm._common import LETTER, LOWER, Words


def plain(word: bytes) -> bytes:
    at = [i for i, c in enumerate(word) if LETTER[LOWER[c]]]
    out = word[at[0] : at[-1] + 1] if at else word[len(word) // 2 :][:1]
    return bytes(LOWER[c] for c in out)


@given(st.lists(st.text(alphabet="aZ9é.*!-(\x01 \n", max_size=30), max_size=5))
def test_bare_equals_the_plain_rule(texts):
    words = Words([t.encode() for t in texts])
    start, end, lower = words.bare()
    got = [bytes(lower[a:b]) for a, b in zip(start, end)]
    assert got == [plain(bytes(words.raw[a:b])) for a, b in zip(words.start, words.end)]


def test_many_marks_are_stripped(spark):
    same = decontam.bare_hashes(Words([b"answer..... ****word**** idiot!!!! ((((((quoted"]))
    assert (same == decontam.bare_hashes(Words([b"Answer word idiot quoted"]))).all()
    assert (toxicity.features(Words([b"idiot!!!!!"])) == toxicity.features(Words([b"idiot"]))).all()
    item = "which river runs through the old town of nowhere? the long green river of stones"
    text = " ".join(f"****{w}****" for w in item.split())
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontam.op4_decontamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in got] == [(1, 7, 1.0, 1.0)]
    assert np.isclose(got[0].score, 1.0)
