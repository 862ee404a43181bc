"""Prefix tables, token links and ranked search against the libraries and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleaner.llm import k2_treap, piece_bpe, prefix_table, ranked_search, token_links
from gleaner.llm.wordcache import default_tokenizer

SCHEMA = "doc_id long, text string, key string, copies long, n long, terms string, item int"
A, B = default_tokenizer("byte_bpe_50k.json"), default_tokenizer("piece_bpe_32k.model")
ODD = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "😀", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "ñ", "中文", "0", "2024", "...", "}\r", "==", "    ", "\x00", "　", "\xa0", "Th", "aaaa", "'s", "'ll", "it's", "\x1c", "½", "ж"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    mixed = ["".join(draw.choice(ODD) for _ in range(draw.randint(1, 50))) for _ in range(1500)]
    words = ["".join(draw.choice("abetions") for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    strange = ["".join(chr(draw.choice([draw.randint(32, 126), draw.randint(0x80, 0x2FFF), draw.randint(0x1F000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    runs = [c * n for c in " =a" for n in (1, 2, 15, 16, 17, 33, 100)]
    return [*mixed, *words, *strange, *runs, "a▁b ▁", "", "ab" * 4000, " ".join(words)]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=B)


def test_pieces_equal_the_library(texts, model):
    for text, (n, ids, decoded) in zip(texts, piece_bpe.encode_texts(B, texts), strict=True):
        expected = model.encode(text, add_eos=True)
        assert (n, ids, decoded) == (len(expected), " ".join(map(str, expected)), model.decode(expected)), text


def test_windows_of_a_long_string(monkeypatch, model):
    monkeypatch.setattr(prefix_table, "LONG", 200)
    monkeypatch.setattr(prefix_table, "WINDOW", 64)
    monkeypatch.setattr(prefix_table, "OVERLAP", 48)
    draw = random.Random(11)
    kinds = ["".join(draw.choice("abetions") for _ in range(5000)), "=" * 1001, "a" * 777, "ab" * 500, "x" * 199 + "=" * 500]
    own = piece_bpe.Pieces(B)
    ids, first = own.encode(kinds)
    whole = [model.encode(k)[:] for k in kinds]
    for k, expected, a, b in zip(kinds, whole, first, first[1:], strict=False):
        # The library puts a space before the text; its first piece may hold it.
        alone = model.id_to_piece(expected[0]) == "▁"
        got = ids[a:b].tolist()
        assert "".join(model.id_to_piece(i) for i in got) == k
        if alone:
            assert got == expected[1:]


def test_old_strings_are_kept_in_two_generations():
    made = []

    def make(strings):
        made.extend(strings)
        return [s.upper() for s in strings]

    kept = prefix_table.Kept(make, limit=2, longest=3)
    assert kept.all(["a", "b", "a"]) == ["A", "B", "A"]
    assert kept.all(["c", "a"]) == ["C", "A"]
    assert kept.all(["a", "c", "b"]) == ["A", "C", "B"]
    assert made == ["a", "b", "c"]
    kept.all(["long words", "long words"])
    kept.all(["long words"])
    assert made.count("long words") == 2


def test_encoding_of_documents(spark, texts, model):
    rows = [(i, t, "k", 1, 1, "t", 1) for i, t in enumerate(texts[:400])]
    rows += [(None, None, None, None, None, None, None), rows[5], (None, "the end", None, None, None, None, None)]
    got = piece_bpe.encode(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()

    def expected(i, text):
        ids = model.encode(text or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))

    assert Counter(map(tuple, got)) == Counter(expected(r[0], r[1]) for r in rows)
    assert piece_bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def _aligned(text, tokenizer, model, spelling):
    """Groups as (a ids, b ids), None where the tokens do not spell the text."""
    if not text:
        return None
    a = [(i, spelling[i]) for i in tokenizer.encode(f" {text}", add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = f" {text}".encode()
    if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
        return None

    def ends(tokens):
        at, out = 0, []
        for _, t in tokens:
            at += len(t)
            out.append(at)
        return out

    a_end, b_end = ends(a), ends(b)
    groups, i, j = [], 0, 0
    for e in sorted(set(a_end) & set(b_end)):
        x, y = a_end.index(e) + 1, b_end.index(e) + 1
        groups.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
        i, j = x, y
    return groups


def test_token_links(spark, texts, model):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    spelling = token_links.pair(A, B).a.text
    some = [t for t in texts if len(t) < 2000][::3] + ["it's the end", "it's the end", "the end\n\n of it"]
    rows = [(i, t, "k", 5, 7, "t", 1) for i, t in enumerate(some)]
    rows += [(None, None, None, None, None, None, None), (None, "it's the end", None, None, None, None, None), rows[0], (9001, "", "", 1, 1, "", 1)]
    found = [(r[0], _aligned(r[1], tokenizer, model, spelling)) for r in rows]
    counts = Counter((a[-1], b[-1]) for _, g in found for a, b in g or ())
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    expected = Counter()
    for i, g in found:
        if g is None:
            expected[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        form = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        links = [(a[-1], b[-1]) for a, b in g]
        best = sum(counts[x] == highest[x[1]] for x in links)
        sums = sum(counts[x] for x in links)
        n_a, n_b = sum(len(a) for a, _ in g), sum(len(b) for _, b in g)
        expected[i, n_a, n_b, len(g), len(links), best, sums, hashlib.sha256(form.encode()).hexdigest()] += 1
    got = token_links.alignment(spark.createDataFrame(rows, SCHEMA).repartition(4))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == expected
    assert token_links.alignment(spark.createDataFrame([], SCHEMA)).count() == 0


def test_treap_finds_the_best_columns():
    draw = np.random.default_rng(2)
    for trial in range(30):
        n_rows, n_columns = int(draw.integers(1, 40)), int(draw.integers(1, 300))
        cells = draw.random((n_rows, n_columns)) < 0.2
        values = draw.integers(1, 6, (n_rows, n_columns)) * cells
        r, c = np.nonzero(values)
        order = draw.permutation(len(r))
        treap = k2_treap.K2Treap(r[order], c[order], values[r, c][order])
        rows = draw.choice(n_rows, min(n_rows, 7), replace=False)
        weights = draw.integers(1, 4, len(rows))
        keys = np.sort(draw.integers(0, 200, n_columns))
        sums = (values[rows] * weights[:, None]).sum(axis=0)
        expected = sorted(((-int(s), int(keys[i])) for i, s in enumerate(sums) if s > 0))[:10]
        got = treap.best(rows, weights, keys, 10)
        assert [(-s, int(keys[i])) for s, i in got] == expected, trial
        assert all(s == sums[i] for s, i in got)
        if len(expected) > 4:
            floor = (-expected[4][0], expected[4][1])
            above = [x for x in expected if x < expected[4]]
            floored = [(-s, int(keys[i])) for s, i in treap.best(rows, weights, keys, 10, floor)]
            assert [x for x in floored if x < expected[4]] == above


def _ranked(docs, items, k):
    terms = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, missing, i) in enumerate(sorted(scores)[:k], 1):
            out.add((item, rank, None if missing else i, -s))
    return out


@pytest.mark.parametrize(("tile", "chars"), [(ranked_search.TILE, ranked_search.ITEM_CHARS), (7, 300)])
def test_ranked_search(spark, tile, chars):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "中文", "a1", "THE", "the"]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(i, say(draw.randint(1, 60))) for i in range(120)]
    docs += [(200 + i, "the w1 w2 w3 same copy") for i in range(40)]
    docs += [(300, None), (301, ""), (302, "!?\x00 -"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (303, say(5000))]
    docs += [docs[0], docs[0]]
    items = [(1, "w1 w2 w3, The the"), (2, say(20)), (3, None), (4, "nothing-at-all"), (5, ""), (6, say(200)), (None, "w5")]
    frame = spark.createDataFrame([(i, t, "k", 1, 1, "t", 1) for i, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in [*items, items[0]]], "item_id long, text string, doc_id string")
    got = ranked_search.search(frame, asked, tile=tile, item_chars=chars).collect()
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == _ranked(docs, items, 20)
    assert ranked_search.search(spark.createDataFrame([], SCHEMA), asked).count() == 0
    assert ranked_search.search(frame, asked.limit(0)).count() == 0


def test_texts_are_cut_between_terms():
    text = "".join(random.Random(1).choice("ab é-. ") for _ in range(3000))
    for size in (1, 7, 100):
        assert ranked_search.term_counts(text, None, size) == ranked_search.term_counts(text)
