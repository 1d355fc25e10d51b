import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import suffix_dedup
from tests.llm.helpers import docs, prose


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    passage, other = prose(rng, 30), prose(rng, 12)
    texts = [prose(rng, 60) + " " + passage + " " + prose(rng, 20) for _ in range(6)] + [passage[i:] + prose(rng, 5) for i in range(0, 90, 7)]
    texts += [other + f"{i}" + other + passage[:70] for i in range(5)] + ["ab" * 300, "ab" * 200 + "c", "short", "", None, None, "é" * 120, "xé" * 120]
    texts += [texts[0], texts[0], prose(rng, 3000) + passage, prose(rng, 50)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [1 << 25, 0])  # contexts of all anchors merged, and all counted by window
def test_equals_brute_force(spark, hot):
    rows = corpus()
    out = suffix_dedup.report(suffix_dedup.cut(docs(spark, rows), length=60, anchor=20, hot=hot)).collect()
    have = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert have == sorted((i or -1, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], 60)))


def test_interleave_of_shards(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 100)
    rng = random.Random(4)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(25, 60))) for _ in range(40)]
    contexts += [c[3:] + b"x" for c in contexts if len(c) > 30]
    for length in (8, 9, 16, 25):
        count = Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
        for c, mask in zip(contexts, suffix_dedup.shared_windows(contexts, length)):
            assert mask.tolist() == [count[c[i : i + length]] > 1 for i in range(len(c) - length + 1)]


def test_passages_of_399_400_and_401_bytes(spark):
    """Passages of over 50 words in two documents each, at the contract's length: one byte short of it nothing goes."""
    rng = random.Random(12)
    rows = []
    for size in (399, 400, 401):
        for k in range(4):
            passage = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 8))) for _ in range(90))[:size]
            assert len(passage.split()) > 50
            for half in (0, 1):
                rows.append((len(rows), "".join(rng.choices("qrstuvwxyz", k=700)) + "qr"[half] + passage + "st"[half] + "".join(rng.choices("qrstuvwxyz", k=900))))
    out = {r.doc_id: r for r in suffix_dedup.report(suffix_dedup.cut(docs(spark, rows, 11))).collect()}
    assert [out[i].n_removed for i in range(24)] == [0] * 8 + [400] * 8 + [401] * 8
    assert {out[i].n_spans for i in range(8, 24)} == {1}


def test_empty_table(spark):
    assert suffix_dedup.cut(docs(spark, [])).count() == 0
