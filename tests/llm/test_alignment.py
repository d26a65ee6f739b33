"""Alignment of two tokenizers against loops over tokens."""

import collections
import hashlib

import numpy as np
import pytest

from jobscope.llm import alignment

SCHEMA = "doc_id long, text string, n_a string, pairs string, times int, _row string"
TEXTS = [
    "Hello world, this is a test.", "hello   world\n\n\ttabs and  spaces ", "naïve café — “quotes” … 日本語のテキスト 😀😀 zero​width", "Ünïcödé \U0001f469‍\U0001f52c done",
    "<|endoftext|> in text <s> </s> <unk> <0x41>", "a▁b is not given back", "", None, " ", "x", "\n", "123456 789 3.14159", "internationalization antidisestablishmentarianism", "αβγδε жизнь 北京市 مرحبا",
    "é combining", "ﬁ ligature ① ² ½", "\u0000 nul \u0007", "the the the the", "the end", "the end",
]


def plain(texts):
    """A result for each text, from tokenizers loaded here, by loops."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    of = alignment._byte_characters()
    held, found = collections.Counter(), []
    for text in texts:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
            yb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                i = j = at_a = at_b = 0
                group = ([], [])
                while i < len(x) or j < len(y):
                    if at_a <= at_b:
                        group[0].append(x[i])
                        at_a, i = at_a + len(xb[i]), i + 1
                    else:
                        group[1].append(y[j])
                        at_b, j = at_b + len(yb[j]), j + 1
                    if at_a == at_b:
                        groups.append(group)
                        group = ([], [])
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(links))
        found.append((groups, links))
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for groups, links in found:
        digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), digest))
    return out


def result(spark, texts, ids=None):
    df = spark.createDataFrame([(i, t, "n", "p", 1, "r") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)
    got = alignment.align_tokenizers(df.repartition(4)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("pair_rows", [2_000_000, 7])
def test_alignment_against_loops(spark, monkeypatch, pair_rows):
    monkeypatch.setattr(alignment, "PAIR_ROWS", pair_rows)
    texts = [*TEXTS, " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000)), "日本語" * 3000]
    want = sorted(((i, *r) for i, r in enumerate(plain(texts))), key=str)
    assert result(spark, texts) == want
    some = [r for r in want if r[1]]
    assert len(some) >= 15 and all(r[1] == 0 and r[7] == "" for r in want if texts[r[0]] in (None, "", "a▁b is not given back"))


def test_repeats_null_ids_and_empty(spark):
    texts = ["the end", "the end", "the start", None]
    assert [r[1:] for r in result(spark, texts, [1, 1, None, None])] == [r[1:] for r in sorted(((i, *r) for i, r in zip([1, 1, None, None], plain(texts))), key=str)]
    assert result(spark, []) == []


def test_pieces_of_any_size_and_large_groups():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(np.append(rng.integers(1, 100, rng.integers(1, 70)), 100)) for _ in range(2))
        both = np.intersect1d(a, b)
        for steps in (1, 2, 3, 5, 1000):
            x, y = alignment.aligned_groups(a, b, steps)
            assert (a[x - 1] == both).all() and (b[y - 1] == both).all()
    a, b = np.sort(rng.choice(10**6, 50_000, replace=False)), np.sort(rng.choice(10**6, 30_000, replace=False))
    i = alignment.path_crossings(a, b, np.arange(0, 80_001, 1000))
    assert (np.diff(i) + np.diff(np.arange(0, 80_001, 1000) - i) == 1000).all()  # equal work
    # one group of many tokens: distinct ids with the products of how often they occur
    x, y = rng.integers(0, 30, 400), rng.integers(0, 20, 300)
    want = collections.Counter((p, q) for p in x.tolist() for q in y.tolist())
    keys, counts = alignment.linked_pairs(x, y, np.array([400]), np.array([300]), np.array([0]), 20, 600)
    assert dict(zip(keys.tolist(), counts.tolist())) == {p * 20 + q: n for (p, q), n in want.items()}
