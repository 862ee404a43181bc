"""Typos drawn for whole batches: the same words as one by one."""

import hashlib

from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.hashing import numbered_md5, row_key


def test_numbered_md5_is_md5():
    prefixes, counts = [b"7|a|", b"7|" + b"k" * 60 + b"|", b"", b"x" * 51], [12_345, 30, 0, 1_234]
    for prefix, count, found in zip(prefixes, counts, numbered_md5(prefixes, counts), strict=True):
        expected = [hashlib.md5(b"%b%d" % (prefix, i)).hexdigest() for i in range(count)]
        assert ["".join(f"{x:08x}" for x in column) for column in found.T.tolist()] == expected


def _plain(words, seed, key, share):
    for i, word in enumerate(words):
        digest = hashlib.md5(f"{seed}|{key}|{i}".encode()).hexdigest()
        one, two, three = (int(digest[k : k + 7], 16) for k in (8, 16, 24))
        if int(digest[:8], 16) >= int(share * 2**32):
            yield word
        elif len(word) == 1:
            yield word + chr(97 + three % 26)
        else:
            letters, first = list(word), one % len(word)
            second = (first + 1 + two % (len(word) - 1)) % len(word)
            letters[first], letters[second] = letters[second], letters[first]
            yield "".join(letters)


def test_typos_word_by_word(spark):
    many = [f"w{i}é" for i in range(2_000)]
    rows = [(1, "a bc　déf\x1cg\u0085 hij  "), (2, None), (3, " \n"), (4, " ".join(many)), (None, "x yz")]
    df = spark.createDataFrame(rows, "id long, t string")
    picked = text.typos("t", 0.5, 7, row_key("id"))
    found = {r["id"]: r["o"] for r in df.select("id", picked.alias("o")).collect()}
    split = {1: ["a", "bc", "déf\x1cg", "hij"], 3: [], 4: many, None: ["x", "yz"]}
    assert found == {2: None} | {i: " ".join(_plain(w, 7, "" if i is None else i, 0.5)) for i, w in split.items()}
    # No lambda is interpreted word by word.
    assert "lambdafunction" not in df.select(F.length(picked))._jdf.queryExecution().toString().lower()
