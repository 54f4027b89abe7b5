import zlib
from array import array

import corpus_pipeline
from tessera.llm.tokens import WordEncoder, tokenizer_path


def test_packing_stage_returns_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = {}
    for p in corpus_pipeline.packed(spark, docs, sf).collect():
        assert len(p.ids) == 4 * p.length == 4 << p.bucket and zlib.crc32(p.ids) == p.ids_crc32
        pieces.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    encoder = WordEncoder(tokenizer_path())
    for r in docs.collect():
        expected = next(encoder.encode([(r.text or "").encode()])) + array("I", [1]).tobytes()
        assert b"".join(x for _, x in sorted(pieces[r.doc_id])) == expected
