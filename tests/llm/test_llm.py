"""Each operator against brute force on odd rows: nulls, empty and long texts, copies, other columns."""

import hashlib
import zlib

import numpy as np
import pytest

from gleaner.llm import bpe_tree, learned_ann, line_crf, near_dup, packing, pseudonyms, repetition, revisits, suffix_dedup, toxicity, wordcache

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, length long, key string"
TOKEN = r"[^\x20\x09-\x0D]+"


def _texts():
    draw = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(draw.choice(words, n))
    base, passage = say(120), say(40)
    near = base.split()
    near[60] = "other"
    return [
        (0, base),
        (1, base),
        (2, " ".join(near)),
        (3, None),
        (4, ""),
        (5, "  \n\t "),
        (6, f"{say(50)} {passage} {say(30)}"),
        (7, f"{say(20)}\n{passage} {say(60)}"),
        (8, say(9000)),
        (9, "x" * 5000),
        (10, "Ünï 😀 café " * 40),
        (11, "one two three"),
        (12, "One TWO three"),
        (13, f"{say(60)}\n<b> # $ %\n{say(5)}\n{say(5)}"),
        (14, base.upper()),
    ]


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "a", 1, None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Copies of one row and rows without id beside the others."""
    more = [*rows, rows[6], (None, None), (None, rows[0][1])]
    return spark.createDataFrame([(i, t, None, None, None, "a", 1, None) for i, t in more], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i, _ in rows], "doc_id long, toxic int, quality int")


def test_odd_rows_keep_their_number(spark, odd, rows):
    labels = _labels(spark, rows)
    total = len(rows) + 3
    assert repetition.coverage(odd).count() == total
    assert bpe_tree.encode(odd).count() == total
    assert suffix_dedup.deduplicate(odd).count() == total
    assert toxicity.toxicity(odd, labels).count() == total
    assert line_crf.quality(odd, labels).count() == total
    assert pseudonyms.pseudonymise(odd, "k").count() == total
    assert packing.pack(odd).filter("doc_id IS NULL AND piece = 0").count() == 2
    found = near_dup.near_duplicates(odd).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows} | {None}
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)


def test_empty_tables(spark, none, rows):
    labels = _labels(spark, rows)
    assert repetition.coverage(none).count() == 0
    assert bpe_tree.encode(none).count() == 0
    assert suffix_dedup.deduplicate(none).count() == 0
    assert packing.pack(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert pseudonyms.pseudonymise(none, "k").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert line_crf.quality(none, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert learned_ann.search(vectors, vectors).count() == 0


def test_near_duplicates(docs, rows):
    import re

    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(TOKEN, low)
        if not words:
            return set()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, percent=85).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def _without_repeats(rows):
    seen, want = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - 99):
            piece = data[at : at + 100]
            if piece in seen:
                gone[at : at + 100] = True
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return want


def _deduplicated(docs):
    found = suffix_dedup.deduplicate(docs).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


def test_suffix_dedup(docs, rows):
    assert _deduplicated(docs) == _without_repeats(rows)


def test_suffix_dedup_over_cut_ties(spark, monkeypatch):
    """Small buckets, so that splitters fall between equal strings in different surroundings."""
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    say = lambda n: " ".join(draw.choice(words, n))
    passage = say(40)
    rows = [(i, f"{say(25)} {passage} {say(25)}") for i in range(60)]
    rows += [(60 + i, say(10) + " " * (105 + i) + say(10)) for i in range(20)]
    rows += [(80, "y" * 3000 + say(30)), (81, say(30) + "y" * 2999), (82, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRINGS", 40)
    monkeypatch.setattr(suffix_dedup, "KEYS_PER_BUCKET", 1000)
    kept, ends = suffix_dedup.materialize, []

    def watch(df, label):
        out = kept(df, label)
        if label == "strings":
            ends.extend(out.filter("bucket IS NOT NULL").select("bucket", "first_key", "last_key").collect())
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", watch)
    assert _deduplicated(given) == _without_repeats(rows)
    last = {r.bucket: r.last_key for r in ends}
    assert len(ends) > 20 and any(last.get(r.bucket - 1) == r.first_key for r in ends)


def test_suffix_dedup_carries_columns_of_any_name(spark):
    given = spark.createDataFrame([(1, "x" * 300, 7, "a", "b")], "doc_id long, text string, id int, entries string, text_key string")
    out = suffix_dedup.deduplicate(given, ("id", "entries", "text_key")).first()
    assert (out.doc_id, out.id, out.entries, out.text_key, out.n_removed) == (1, 7, "a", "b", 299)


def test_multikey_order():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 3, 500) for _ in range(4)]
    order, again = suffix_dedup.multikey_order(500, [c.__getitem__ for c in columns], 3)
    rows = np.stack(columns, axis=1)[order].tolist()
    assert rows == sorted(rows)
    assert again.tolist() == [i > 0 and rows[i][:3] == rows[i - 1][:3] for i in range(500)]


def test_bpe_tree(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(wordcache.default_tokenizer("word_bpe_49k.json"))
    whole.no_truncation()
    whole.no_padding()
    want = {}
    for i, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    for leaf in (300, bpe_tree.LEAF):
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.encode(docs, leaf=leaf).collect()}
        assert got == want


@pytest.mark.parametrize("part_pieces", [4, packing.PART_PIECES])
def test_packing(docs, rows, part_pieces):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(wordcache.default_tokenizer("byte_bpe_50k.json"))
    whole.no_truncation()
    whole.no_padding()
    found = packing.pack(docs, part_pieces=part_pieces).collect()
    sequences = {}
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // 2048) and all(r.length == 2048 for r in mine[1:])
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    if part_pieces > len(found):
        assert len(sequences) == packing.lower_bound(np.bincount([r.length for r in found], minlength=2049), 2048)


def test_lower_bound_never_exceeds_the_packing():
    draw = np.random.default_rng(3)
    for _ in range(30):
        lengths = draw.integers(1, 101, 40)
        sequence = packing.best_fit(np.sort(lengths)[::-1], 100)[0]
        counts = np.bincount(lengths, minlength=101)
        assert -(-lengths.sum() // 100) <= packing.lower_bound(counts, 100) <= len(np.unique(sequence))


def test_repetition(docs, rows):
    import re
    from collections import Counter

    want = {}
    for i, text in rows:
        text = text or ""
        words = re.findall(TOKEN, text)
        lines = [x for x in text.split("\n") if re.search(TOKEN, x)]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(grams)
        inside = {k + d for k, g in enumerate(grams) if times[g] > 1 for d in range(3)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        want[i] = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed)
    found = repetition.coverage(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r[n] for n in names) for r in found} == want
    assert not any(r.kept for r in found if r.base_failed)


PERSONAL = "mail Ann.Lee@mail.example.org card 4111 1111 1111 1111, ip 10.0.0.7, born 1990-02-28, call 415-555-2671, 4111-1111-1111-1111"


def test_pseudonyms_go_back_and_stay_linked(spark):
    texts = [(1, PERSONAL), (2, PERSONAL), (3, None), (4, "")]
    given = spark.createDataFrame(texts, "doc_id long, text string")
    moved = pseudonyms.pseudonymise(given, "k")
    out = {r.doc_id: r.text for r in moved.collect()}
    assert out[1] == out[2] != PERSONAL and out[3] is None and out[4] == ""
    assert "4111" not in out[1] and "1990-02-28" not in out[1] and "Ann" not in out[1]
    numbers = out[1].split("card ")[1][:19], out[1][-19:]
    assert numbers[0].replace(" ", "") == numbers[1].replace("-", "")
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(moved, "k", back=True).collect()}
    assert back == dict(texts)


def test_learned_partitions(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (None, [1.0] * 8), (603, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = learned_ann.search(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    full = np.vstack([x, x[:1]]).astype(float)
    ids = [*range(600), 603]
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        score = dict(zip(ids, full @ full[q]))
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 and r.vec_id != q for r in mine)
        best = sorted((i for i in ids if i != q), key=lambda i: (-score[i], i))[:20]
        hits += len({r.vec_id for r in mine} & set(best))
    assert hits >= 0.9 * 20 * 30


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): v for a, v in k.items()}
    rows = [
        (1, "http://www.a.org/x/?utm_a=1", 10, 200, h(etag='"1"', content_type="t", date="d1")),
        (2, "https://A.org/x#f", 10, 304, h(etag='"1"')),
        (3, "https://a.org/x", 20, 304, h(etag='W/"1"', date="d2", content_type="no")),
        (4, "https://a.org/x", 30, 304, h(etag='"2"')),
        (5, "https://a.org/x", 40, 304, None),
        (6, None, 40, 304, None),
        (7, "https://a.org/x", None, 200, None),
        (8, "https://a.org/x", 10**6, 304, h(etag='"1"')),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, at long, status int, headers map<string,string>")
    got = {r.record_id: (r.response_id, r.outcome, r.headers) for r in revisits.resolve(records).collect()}
    assert got == {
        2: (None, "no earlier response", None),
        3: (1, "resolved", 'content-type: t\ndate: d2\netag: W/"1"'),
        4: (None, "validators differ", None),
        5: (None, "no validator", None),
        6: (None, "no earlier response", None),
        8: (1, "resolved", 'content-type: t\ndate: d1\netag: "1"'),
    }
    assert revisits.resolve(records.limit(0)).count() == 0


def test_index_finds_the_exact_nearest():
    draw = np.random.default_rng(9)
    vectors = []
    for _ in range(500):
        terms = np.sort(draw.choice(60, 5, replace=False))
        weights = draw.random(5)
        vectors.append([(int(t), float(w)) for t, w in zip(terms, weights / np.linalg.norm(weights))])
    dense = np.zeros((500, 60))
    for i, v in enumerate(vectors):
        for t, w in v:
            dense[i, t] = w
    index = toxicity.Index(vectors, 60)
    for q in range(0, 500, 25):
        scores = [s for _, s in index.nearest(vectors[q], 10)] if isinstance(index.nearest(vectors[q], 10)[0][1], float) else None
        assert np.allclose(sorted(scores, reverse=True), np.sort(dense @ dense[q])[::-1][:10])


def _shifted(digits, radix, key, kind):
    """The Feistel permutation in plain Python."""
    half = len(digits) // 2
    parts, radixes = [digits[:half], digits[half:]], [radix[:half], radix[half:]]
    for turn in range(pseudonyms.ROUNDS):
        side = 1 if turn % 2 == 0 else 0
        seed = f"{key}|{kind}|{turn}|" + ",".join(map(str, parts[1 - side]))
        parts[side] = [
            (v + int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:12], 16)) % r
            for i, (v, r) in enumerate(zip(parts[side], radixes[side]), 1)
        ]
    return parts[0] + parts[1]


def _date_moved(y, m, d, key):
    late = [(a, b) for a in range(1, 13) for b in (29, 30, 31) if a != 2 and (b < 31 or a not in (4, 6, 9, 11))]
    if d <= 28:
        low, size = (1, 12) if d <= 12 else (13, 16)
        n = _shifted([d - low, m - 1, y - 1900], [size, 12, 200], key, "date")
        return n[2] + 1900, n[1] + 1, n[0] + low
    if m == 2:
        n = _shifted(list(divmod((y - 1904) // 4, 7)), [7, 7], key, "date")
        return 1904 + 4 * (7 * n[0] + n[1]), 2, 29
    n = _shifted([late.index((m, d)), y - 1900], [len(late), 200], key, "date")
    return n[1] + 1900, *late[n[0]]


def _values(spark, values, **options):
    given = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    found = pseudonyms.pseudonymise(given, "secret", **options).orderBy("doc_id").collect()
    return [r.text for r in found], [r.n_values for r in found]


def test_dates_are_linked_over_layouts_and_recomputed(spark):
    import datetime

    draw = np.random.default_rng(2)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(int(n)) for n in draw.integers(0, 73_049, 200)]
    days += [datetime.date(*x) for x in ((2020, 12, 25), (2000, 2, 29), (1904, 2, 29), (2096, 2, 29), (1999, 12, 31), (1900, 1, 1))]
    assert len(pseudonyms._LATE) == 29
    iso = [f"{d:%Y-%m-%d}" for d in days]
    month_first = [f"{d:%m/%d/%Y}" for d in days]
    day_first = [f"{d:%d/%m/%Y}" for d in days if d.day > 12]
    want = [_date_moved(d.year, d.month, d.day, "secret") for d in days]
    assert all(datetime.date(*w) for w in want)
    got = _values(spark, iso + month_first + day_first)[0]
    n = len(days)
    assert got[:n] == ["%04d-%02d-%02d" % w for w in want]
    assert got[n : 2 * n] == ["%02d/%02d/%04d" % (m, d, y) for y, m, d in want]
    assert got[2 * n :] == ["%02d/%02d/%04d" % (d, m, y) for (y, m, d), day in zip(want, days) if day.day > 12]
    assert _values(spark, got, back=True)[0] == iso + month_first + day_first


def test_social_security_numbers_stay_valid(spark):
    draw = np.random.default_rng(4)
    parts = [(a, g, s) for a, g, s in zip(draw.integers(1, 900, 300), draw.integers(1, 100, 300), draw.integers(1, 10_000, 300))]
    parts = [p for p in parts if p[0] != 666] + [(665, 1, 1), (667, 99, 9999), (899, 1, 1), (1, 1, 1)]
    given = ["%03d-%02d-%04d" % p for p in parts]
    want = []
    for a, g, s in parts:
        n = _shifted([int(a) - 1 - (a > 666), int(g) - 1, int(s) - 1], [898, 99, 9999], "secret", "ssn")
        want.append("%03d-%02d-%04d" % (n[0] + 1 + (n[0] + 1 >= 666), n[1] + 1, n[2] + 1))
    got, counts = _values(spark, given)
    assert got == want and all(x[:3] not in ("000", "666") and x[:3] < "900" for x in got)
    assert _values(spark, got, back=True)[0] == given
    invalid = ["666-12-3456", "123-00-0000", "900-11-1111", "000-11-1111", "4111 1111 1111 1112", "2021-02-30", "300.1.1.1"]
    assert _values(spark, invalid) == (invalid, [0] * len(invalid))


def test_other_values_are_recomputed(spark):
    ip, phone, card = "10.0.0.7", "415-555-2671", "4111 1111 1111 1111"
    moved = _shifted([10, 0, 0, 7], [256] * 4, "secret", "ip")
    least = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
    digits = [int(c) - x for c, x in zip(phone.replace("-", ""), least)]
    called = "".join(str(n + x) for n, x in zip(_shifted(digits, [10 - x for x in least], "secret", "phone"), least))
    body = _shifted([int(c) for c in card.replace(" ", "")[:-1]], [10] * 15, "secret", "card")
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(body))
    paid = "".join(map(str, body)) + str(-total % 10)
    want = [
        ".".join(map(str, moved)),
        f"{called[:3]}-{called[3:6]}-{called[6:]}",
        " ".join(paid[i : i + 4] for i in range(0, 16, 4)),
    ]
    assert _values(spark, [ip, phone, card])[0] == want


def test_pseudonyms_keep_columns_of_clashing_names(spark):
    given = spark.createDataFrame([(1, "born 1990-02-28", "x", "y", 5)], "doc_id long, text string, _found string, _moved string, N_VALUES int")
    out = pseudonyms.pseudonymise(given, "k")
    assert sorted(c.lower() for c in out.columns) == ["_found", "_moved", "doc_id", "n_values", "text"]
    row = out.first()
    assert (row["_found"], row["_moved"]) == ("x", "y") and row[out.columns[-1]] == 1
