import hashlib
import random

import numpy as np
import pytest

from spanloom.llm import fingerprints as fp
from spanloom.llm.common import mix
from tests.llm.helpers import docs, prose


def plain(text):
    """The walk and the samples one step at a time."""
    jumps, written = fp._jumps(), []
    for c in text:
        kind = ((ord(c) * 0x9E3779B1) & 0xFFFFFFFF) >> 26
        written += [ord(c)] * int(jumps[kind, len(written) % fp.PERIOD])
    bits = []
    for b, samples in enumerate(fp._samples()):
        if not written:
            h = mix(np.array([b], np.uint64) ^ fp._SEED)
        else:
            at = max(s for s in samples.tolist() if s < len(written))
            x = mix(np.array([written[at] + (b << 32)], np.uint64)) ^ (np.array([at], np.uint64) * fp._SEED)
            h = mix(x)
        bits.append(int(h[0]) & 1)
    return np.packbits(bits)


def test_jumps_lead_to_set_bits():
    bits = mix(np.arange(fp.CLASSES * fp.PERIOD, dtype=np.uint64) ^ fp._SEED).reshape(fp.CLASSES, fp.PERIOD) & np.uint64(1)
    for c, j in ((0, 0), (5, 4095), (63, 4000), (7, 4094)):
        k = j
        while not bits[c, k % fp.PERIOD]:
            k += 1
        assert fp._jumps()[c, j] == k - j + 1


def corpus():
    rng = random.Random(2)
    base = prose(rng, 300)
    texts = ["", None, "a", "ab", "é🎉x", base, base, base[:700] + "edit" + base[703:], base + " tail", prose(rng, 200), "x" * 5000, prose(rng, 30), "\n \n", "東京" * 40]
    return [(i * 3 if i != 5 else None, t) for i, t in enumerate(texts)] + [(9, "same id"), (9, "same id"), (9, "another")]


@pytest.mark.parametrize("few", [1, 64])  # all walks in step, and one by one
def test_equals_plain_walk(monkeypatch, few):
    monkeypatch.setattr(fp, "FEW", few)
    texts = [t or "" for _, t in corpus()]
    assert (fp.fingerprints(texts) == np.stack([plain(t) for t in texts])).all()


def test_long_texts():
    rng = random.Random(3)
    text = prose(rng, 300_000)  # over two steps of 1 MiB
    a, b = fp.fingerprints([text, "short", text])[::2]
    assert (a == b).all() and fp.likeness(*fp.fingerprints([text, text[: len(text) // 2]])) > 0.4


def test_likeness_follows_edits():
    rng = random.Random(4)
    texts = [prose(rng, 400) for _ in range(40)]

    def mean(edits):
        out = []
        for t in texts:
            x = list(t)
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice(["", "#", "##"])
            out.append(fp.likeness(*fp.fingerprints([t, "".join(x)])))
        return np.mean(out)

    means = [mean(k) for k in (0, 1, 5, 25)]
    assert means[0] == 1 and means[1] > 0.93 and means[2] > 0.8 and means == sorted(means, reverse=True)
    other = fp.fingerprints(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2000)) for _ in range(40)])
    assert fp.likeness(other[:-1], other[1:]).mean() < 0.15 < means[3]


@pytest.mark.parametrize("parts", [1, 4])
def test_against_edited(spark, parts):
    rows = corpus()
    out = {(r.doc_id, r.n_chars, r.fingerprint): r for r in fp.against_edited(docs(spark, rows, parts)).collect()}
    plain_rows = [(i, t or "") for i, t in rows if i != 9]
    ring = sorted((r for r in plain_rows if r[0] is not None)) + [r for r in plain_rows if r[0] is None]
    hexed = lambda t: plain(t).tobytes().hex()
    for k, (i, t) in enumerate(ring):
        if i == 6 or i == 9:
            continue  # its next one is one of the rows of equal id
        after = ring[(k + 1) % len(ring)][1]
        r = out[(i, len(t), hexed(t))]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.edited_fingerprint == hexed(new)
        assert r.near_edited == fp.likeness(plain(t), plain(new)) and r.near_next == fp.likeness(plain(t), plain(after))
    assert fp.against_edited(docs(spark, rows, parts)).count() == len(rows)


def test_one_row_follows_itself(spark):
    r = fp.against_edited(docs(spark, [(1, "abcd")])).collect()
    assert len(r) == 1 and r[0].near_next == 1 and r[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_neighbours_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(5)
        rows = [(i, prose(rng, 8)) for i in rng.sample(range(1000), 120)]
        out = {r.doc_id: r for r in fp.against_edited(docs(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ring = sorted(rows)
    assert len(out) == 120
    for k, (i, t) in enumerate(ring):
        assert out[i].edited_sha256 == hashlib.sha256(fp.edited(t, ring[(k + 1) % 120][1]).encode()).hexdigest()


@pytest.mark.parametrize("group", [4096, 5])  # groups whole, and in blocks
def test_classes_equal_brute_force(spark, group):
    rng = random.Random(6)
    base = [prose(rng, 200) for _ in range(12)]
    texts = [b for b in base for _ in range(2)]
    for b in base[:6]:
        for _ in range(5):
            p = rng.randrange(len(b) - 10)
            texts.append(b[:p] + "new words" + b[p + 9 :])
    texts += ["", None, ""]
    rows = list(enumerate(texts))
    codes = fp.fingerprints([t or "" for t in texts])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero(fp.likeness(codes, codes[i]) >= 0.8).tolist():
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    have = {r.doc_id: r.class_id for r in fp.classes(docs(spark, rows), group=group).collect()}
    assert have == dict(enumerate(root)) and len(set(root)) < 30


def test_empty_table(spark):
    for f in (fp.fingerprint, fp.against_edited, fp.classes):
        assert f(docs(spark, [])).count() == 0
