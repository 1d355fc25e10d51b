import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe
from tests.llm.helpers import docs

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encode(codec, texts):
    ids, ends = codec.encode(texts)
    raw, stops = codec.decode(ids, ends)
    return [(i.tolist(), r.tobytes()) for i, r in zip(np.split(ids, ends[:-1]), np.split(raw, stops[:-1]))]


CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)


def test_perfect_hash():
    slots = CODEC.whole.find(list(RANKS))
    assert sorted(slots) == list(range(len(RANKS)))
    assert CODEC.whole.find([b"", b"notatokenatall", "é".encode() * 9]) == [-1, -1, -1] and bpe.PerfectHash([]).find([b"a"]) == [-1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library(text):
    assert encode(CODEC, [text, "", text]) == [(LIBRARY.encode_ordinary(t), t.encode()) for t in (text, "", text)]


def test_both_ways_of_merging_agree():
    rng = random.Random(0)
    for size in (2, 3, 7, 20, 40):
        words = [bytes(rng.choice(b"abehitnors \xc3\xa9") for _ in range(size)) for _ in range(200)]
        assert CODEC.pairs.merge(words, size) == [bpe.merge(w, RANKS) for w in words]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(15))
        assert encode(codec, [text, text]) == [(LIBRARY.encode_ordinary(text), text.encode())] * 2


def test_what_a_worker_keeps_is_compact():
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(5)
    encode(codec, [" ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(1, 60))) for _ in range(500))])
    assert len(codec.recent) > 400 and all(isinstance(v, bytes) and len(v) % 4 == 0 for v in codec.recent.values())


def test_pipeline_batches(spark, tmp_path):
    import corpus_pipeline
    seen, key = [], corpus_pipeline.BATCH_ROWS

    def stage(s, d, sf_dir):
        seen.append(int(s.conf.get(key)))
        return d

    docs(spark, [(1, "a")]).write.parquet(f"{tmp_path}/documents.parquet")
    before, stages = spark.conf.get(key), corpus_pipeline.STAGES
    try:
        corpus_pipeline.STAGES = [("x", stage)]
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    finally:
        corpus_pipeline.STAGES = stages
    assert seen == [corpus_pipeline.BATCH] and seen[0] < int(before) and spark.conf.get(key) == before


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "Hello <|endoftext|> world"), (4, "x" * 100_000), (5, "ab cd " * 50_000), (5, "again"), (None, "\U0001f600é"), (7, " \n\n\t "), (7, " \n\n\t ")]
    out = bpe.report(bpe.encode(docs(spark, rows), bpe.share(spark))).collect()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)
    assert bpe.encode(docs(spark, []), bpe.share(spark)).count() == 0
