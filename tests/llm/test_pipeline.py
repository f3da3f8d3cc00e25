"""The pipeline against a brute-force version of its stages."""

import hashlib
import struct

import public_tokenizers as P
import tiktoken

from millrace.llm import byte_bpe

from test_models import brute_classes
from test_native import brute_contamination


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    made = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    last = {t or "": i for i, t in rows if any(c.isalpha() for c in t or "")}
    kept = [(i, t) for t, i in last.items()]
    classes = brute_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][1] == i]
    hits = brute_contamination(kept, items)
    kept = [(i, t) for i, t in kept if not hits[i][3]]
    assert sorted(made) == sorted(i for i, _ in kept)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(byte_bpe.RANKS)), special_tokens={})
    for i, t in kept:
        ids = library.encode_ordinary(t)
        assert made[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert made[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
