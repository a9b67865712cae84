import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import align

ODD = ["<s> </s> <unk> <|endoftext|>", "a  b   c", "  leading", "trailing  ", " ", "   ", "\n", "a\n b\n  c\r\n d", "tab\tand \t both", "don't we'll I'M  it's",
       "日本語 テキスト 漢字かな", "emoji 👩‍👩‍👧‍👦 ‍ x", "▁ marker", "a▁ b", "x ▁▁ y", "　wide space x", "nul \x00 byte \x1c x", "<0x41> <0x0A>", "é é ﬁ ½",
       "﻿ bom", "12345 67890.5 1,000", "word" * 300, "\x85 next", "नमस्ते दुनिया مرحبا", "a᠎ b ​ c", "'s 't", "x\xa0 y"]


@pytest.fixture(scope="module")
def tools():
    with open(align.BYTE_PAIRS, "rb") as a, open(align.PIECES, "rb") as b:
        return align.Aligner(align.BytePairs(a.read()), align.MarkedPieces(b.read()))


def tokens(tools, text):
    """The ids of the whole text and their bytes on both sides, straight from the libraries; None if they do not spell it."""
    if not text:
        return None
    a = tools.a.library.encode(" " + text, add_special_tokens=False).ids
    b = tools.b.library.encode(text)
    spelt = [[side.bytes[i] for i in ids] for side, ids in ((tools.a, a), (tools.b, b))]
    want = (" " + text).encode()
    return (a, b, *spelt) if b"".join(spelt[0]) == want == b"".join(spelt[1]) else None


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def links_of(found):
    a, b = spans(found[2]), spans(found[3])
    return [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]]


def groups_of(found):
    a, b = spans(found[2]), spans(found[3])
    cuts = sorted({x[1] for x in a} & {y[1] for y in b})
    return [([i for i, x in enumerate(a) if lo <= x[0] < hi], [j for j, y in enumerate(b) if lo <= y[0] < hi]) for lo, hi in zip([0, *cuts], cuts)]


def brute_force(tools, rows):
    held = [(i, tokens(tools, t)) for i, t in rows]
    links = [[(f[0][x], f[1][y]) for x, y, _ in links_of(f)] if f else [] for _, f in held]
    count = Counter(p for l in links for p in l)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (i, f), l in zip(held, links):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        groups = groups_of(f)
        form = ";".join(",".join(str(f[0][x]) for x in p) + "|" + ",".join(str(f[1][y]) for y in q) for p, q in groups)
        out.append((i, len(f[0]), len(f[1]), len(groups), len(l), sum(count[p] == top[p[1]] for p in l), sum(count[p] for p in l),
                    hashlib.sha256(form.encode()).hexdigest(), sum(len(p) * len(q) for p, q in groups)))
    return Counter(out)


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "Tokenization", "über", "ción", "naïve", "x1", "(2039),", "https://a.b/c?d=1", "日本", "###", "don't", "\n", "\n\n", "", "e.g."] + [
        "".join(rng.choice("abcdeghinorst") for _ in range(rng.randrange(2, 12))) for _ in range(80)]
    return [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(n)]


def test_cut_pieces_encode_like_whole_texts(tools):
    for text in ODD + prose(1, 200):
        pieces, at, _ = align.dealt([text])
        if not text or "▁" in text:
            continue  # such a text is not spelt and has no tokens
        for side, whole in ((tools.a, tools.a.library.encode(" " + text, add_special_tokens=False).ids), (tools.b, tools.b.library.encode(text))):
            encoded = side.encode(pieces)
            assert [i for p in at for i in encoded[p]] == whole, text


@pytest.mark.parametrize("head", [1_000_000, 40, 0])
def test_equals_brute_force(tools, documents, head):
    rows = list(enumerate(ODD + prose(2, 120))) + [(1000, None), (1001, ""), (None, "no id here"), (7, "again and again"), (7, "again and again")]
    docs = documents(rows).repartition(6).withColumn("row", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("rare", F.lit(None).cast("int"))
    found = align.aligned(docs, head_pairs=head)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string", "bigint"]
    assert Counter(tuple(r) for r in found.collect()) == brute_force(tools, rows)


def test_a_third_of_all_rows_is_one_text(tools, documents):
    rows = [(i, "one hot text, held by many rows") for i in range(200)] + list(enumerate(prose(3, 400), 200))
    assert Counter(tuple(r) for r in align.aligned(documents(rows), head_pairs=100).collect()) == brute_force(tools, rows)


def test_small_slices_and_task_counts(tools, documents, monkeypatch):
    monkeypatch.setattr(align, "SLICE_CHARS", 50)
    texts = prose(4, 20) + [None, "", "x" * 200]
    cuts = list(align.slices(pa.array(texts)))
    assert [t for i, j in cuts for t in texts[i:j]] == texts
    assert all(sum(len(t or "") for t in texts[i:j - 1]) < 50 for i, j in cuts)
    monkeypatch.setattr(align, "ENCODE", 3)
    monkeypatch.setattr(align, "ROWS", 2)
    found = tools.align(list(dict.fromkeys(align.CUT.split(" " + " ".join(t for t in texts if t)))))
    assert found.right.all() and len(found.links.indices) == found.links.indptr[-1]


def test_links_and_group_links(tools, documents):
    rows = list(enumerate(["Tokenization of naïve ción", "don't (2039), x", None, "", "a\n b"] + prose(5, 15)))
    docs = documents(rows)
    for by_group in (False, True):
        want = set()
        for i, text in rows:
            f = tokens(tools, text)
            if f:
                pairs = [(x, y, 1) for p, q in groups_of(f) for x in p for y in q] if by_group else links_of(f)
                want |= {(i, x, y, f[0][x], f[1][y], n) for x, y, n in pairs}
        got = [tuple(r) for r in align.token_links(docs, by_group=by_group).collect()]
        assert len(got) == len(want) and set(got) == want


def test_product_equals_dense_product():
    rng = np.random.default_rng(6)
    for shape in ((5, 7, 4), (1, 1, 1), (6, 3, 9), (4, 5, 0), (0, 3, 2), (3, 0, 2)):
        x, y = rng.integers(0, 3, shape[:2]), rng.integers(0, 3, shape[1:])

        def sparse(m):
            r, c = np.nonzero(m)
            return align.Csr(np.concatenate(([0], np.cumsum(np.bincount(r, minlength=m.shape[0])))).astype(np.int64), c, m[r, c], m.shape[1])

        found = align.product(sparse(x), sparse(y))
        dense = np.zeros((shape[0], shape[2]), dtype=np.int64)
        dense[found.rows, found.indices] = found.values
        assert (dense == x @ y).all()
        back = align.transposed(sparse(x))
        again = np.zeros((shape[1], shape[0]), dtype=np.int64)
        again[back.rows, back.indices] = back.values
        assert (again == x.T).all()


def test_empty_table_and_long_text(tools, documents):
    none = documents([(1, "x")]).limit(0)
    assert align.aligned(none).collect() == [] and align.token_links(none).collect() == []
    rows = [(1, " ".join(prose(7, 400))), (2, "y" * 20_000)]
    assert Counter(tuple(r)[:6] for r in align.aligned(documents(rows)).collect()) == Counter(tuple(r)[:6] for r in brute_force_long(tools, rows))


def brute_force_long(tools, rows):
    """As above, with the links from sorted spans."""
    out, held = [], []
    for i, text in rows:
        f = tokens(tools, text)
        a, b = spans(f[2]), spans(f[3])
        x = y = 0
        links = []
        while x < len(a) and y < len(b):
            links.append((f[0][x], f[1][y]))
            ends = a[x][1], b[y][1]
            x, y = x + (ends[0] <= ends[1]), y + (ends[1] <= ends[0])
        held.append((i, f, links, len({s[1] for s in a} & {s[1] for s in b})))
    count = Counter(p for h in held for p in h[2])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    for i, f, links, groups in held:
        out.append((i, len(f[0]), len(f[1]), groups, len(links), sum(count[p] == top[p[1]] for p in links)))
    return out
