import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanloom.llm import token_align
from tests.llm.helpers import docs, prose

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
LETTERS = token_align.byte_alphabet()


def segments(text):
    """Ids and byte ends of both tokenizers on whole texts; none where the bytes differ."""
    if not text:
        return [], []
    raw = f" {text}".encode()
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("\u2581", " ").encode()) for i in B.encode(text)]
    if any(b"".join(x for _, x in side) != raw for side in (a, b)):
        return [], []
    return a, b


def plain(texts):
    rows, count = [], Counter()
    for t in texts:
        a, b = segments(t)
        at, spans = 0, [[], []]
        for side, toks in enumerate((a, b)):
            at = 0
            for i, raw in toks:
                spans[side].append((i, at, at + len(raw)))
                at += len(raw)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]] if len(a) < 600 else None
        if links is None:  # the same by two pointers
            links, j = [], 0
            for x in spans[0]:
                while spans[1][j][2] <= x[1]:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][1] < x[2]:
                    links.append((x[0], spans[1][k][0]))
                    k += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= c) for side in spans) if len(cuts) < 300 else None)
            lo = c
        rows.append((len(a), len(b), len(cuts), links, groups))
        count.update(set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for n_a, n_b, n_groups, links, groups in rows:
        sha = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, n_groups, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), sha))
    return out


def corpus():
    rng = random.Random(5)
    mixed = ["naïve café — 東京タワー 🎉🎉 done", "tab\tand\r\nlines\r\n\r\n  x   y ", "\n\nlead", " ", "   ", "\u2581odd", "<|endoftext|> <s></s> <0x41> <unk>", "a" * 300, "x\u3000y\u00a0z\u2028w\x1cq",
             "e\u0301 \u0301 ﬁ \u200d", "';\r };\r\n\tif (x) {\r}", "1234567 89,000.5", "don't we'll 'S", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 \ufeff x"]
    texts = [*mixed, None, "", *mixed[:4], *(prose(rng, rng.randrange(1, 40)) for _ in range(30))]
    texts += ["".join(rng.choice("ab \n\t\r.é東<>") for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return [(i if i % 11 else None, t) for i, t in enumerate(texts)]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [1 << 23, 300])  # one block a partition, and many
def test_equals_brute_force(spark, block):
    rows = corpus()
    have = sorted((r.doc_id or -1, *(r[c] for c in FIELDS)) for r in token_align.align(docs(spark, rows), block=block).collect())
    assert have == sorted((i or -1, *w) for (i, _), w in zip(rows, plain([t for _, t in rows])))


def test_texts_over_a_step(spark):
    rng = random.Random(6)
    rows = [(1, prose(rng, 300_000, 50)), (2, "ab" * 4000 + " c"), (3, prose(rng, 10, 50))]  # 1: over two steps of 1 MiB
    have = {r.doc_id: tuple(r[c] for c in FIELDS) for r in token_align.align(docs(spark, rows)).collect()}
    for (i, _), w in zip(rows, plain([t for _, t in rows])):
        assert have[i][: 6] == w[:6] and (w[6] is None or have[i][6] == w[6])


def test_groups_column(spark):
    r = token_align.align(docs(spark, [(1, "unbelievable naïve")]), keep_groups=True).collect()[0]
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") == r.n_groups - 1


def test_shared_cuts():
    rng = random.Random(7)
    for n in (1, 2, 3, 10, 1000):
        for density in (0.05, 0.5, 0.9):
            a = np.array([i for i in range(n) if rng.random() < density] + [n])
            b = np.array([i for i in range(n) if rng.random() < density] + [n])
            assert token_align.shared_cuts(a, b).tolist() == np.isin(a, b).tolist()


def test_empty_table(spark):
    assert token_align.align(docs(spark, [])).count() == 0
