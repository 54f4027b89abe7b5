import random
import time

from pyspark.sql import functions as F

from tessera.llm import pii


def plain_redaction(text, spans):
    """Overlapping spans become one mark of the first's kind."""
    merged = []
    for start, end, kind in sorted(spans):
        if merged and merged[-1][1] > start:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = "", 0
    for start, end, kind in merged:
        out, at = out + text[at:start] + f"[{pii.KINDS[kind].upper()}]", end
    return out + text[at:]


def many(n, seed=5):
    rng = random.Random(seed)
    kinds = ("é mail{}@host.org,", "ip 10.0.{}.7;", "call (030) 555-1{:03d}", "order {}", "2 555-123-4{:03d}", "🎉+49 30 1234{}", "x{}@1.2.3.4", "amex 3782 822463 10005")
    return " ".join(rng.choice(kinds).format(rng.randrange(200)) for _ in range(n))


def test_blocks_equal_the_plain_rule(spark, monkeypatch):
    texts = [many(n, n) for n in (1, 3, 4, 5, 40, 300)] + ["", None, "a@b.co" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "GROWING", 4)
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        spans = [(s.start, s.end, s.kind) for s in (*found[i]._base, *found[i]._added)]
        assert clean[i] == (None if text is None else plain_redaction(text, spans))
        for s in found[i]._added:
            assert not any(t.start < s.end and s.start < t.end for t in (*found[i]._base, *found[i]._added) if t is not s)
    monkeypatch.undo()
    assert clean == {r.doc_id: r.text for r in pii.redact(docs).collect()}


def test_very_many_spans_take_linear_work(spark):
    sizes = (2_000, 20_000)
    took = []
    for n in sizes:
        docs = spark.createDataFrame([(1, many(n))], "doc_id long, text string")
        began = time.time()
        row = pii.redact(docs).select(F.length("text").alias("n")).first()
        took.append(time.time() - began)
        assert row.n > n
    assert took[1] < 25 * took[0] + 10, took


def test_candidates_compete(spark):
    """A run of groups that is no number as a whole may hold one; the surest candidate wins, and one only."""
    texts = ["call 7 555-123-4567 now", "call (030) 555-1234 now", "mail jo@x.org 555-123-4567 phone", "order 2024 10 22 17 45 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.op9_pii(docs).collect()}
    assert got[0] == "phone:7:19" and got[1] == "phone:5:19" and got[3] == ""
    assert got[2].startswith("email:5:13")


def test_variants_as_columns(spark):
    samples = [("(030) 555-1234", "call ", "."), ("2 555-123-4567", "call ", ". x"), ("12345678", "no ", ""), ("+49 30 1234567 99", "a" * 30, "b" * 9), ("1 2 3 4 5 6 7 8", "", "")]
    rows = spark.createDataFrame([(7, 7 + len(t), t, b[-pii.BEFORE :], a[: pii.AFTER]) for t, b, a in samples], "start int, end int, text string, before string, after string")
    got = rows.selectExpr("struct(*) AS c").selectExpr(f"{pii._variants('c')} AS v").collect()
    for r, (t, b, a) in zip(got, samples):
        plain = pii.variants(t, b[-pii.BEFORE :], a[: pii.AFTER])
        assert [(v.text, v.before, v.after) for v in r.v] == plain
        assert all(v.end - v.start == len(v.text) and t[v.start - 7 : v.end - 7] == v.text for v in r.v)
