"""Links found tile by tile against all pairs, at similarities around the threshold."""

import numpy as np
import pytest

from gleaner.llm import near_dup


def _copies():
    """Copies of a few texts with changes at places of their own: any two copies of a
    text are about as similar as the threshold asks."""
    draw = np.random.default_rng(11)
    rows = []
    for _ in range(3):
        base = draw.choice([f"w{i}" for i in range(900)], 300).tolist()
        for _ in range(40):
            text = list(base)
            for at in draw.choice(300, int(draw.integers(1, 7)), replace=False):
                text[at] = f"x{draw.integers(10**9)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def _components(rows, percent):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    least = {i: i for i in sets}
    while True:
        before = dict(least)
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            return least


@pytest.mark.parametrize("rounds", [0, 1])
def test_tiles_lose_no_link(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "TILE", 15)
    monkeypatch.setattr(near_dup, "TILE_SHINGLES", 9_000)
    rows = _copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, percent=85).collect()}
    want = _components(rows, 85)
    assert got == want
    assert 3 < len(set(want.values())) < 100


def test_a_tile_gives_fewer_links_than_classes(spark):
    import pandas as pd

    docs = spark.createDataFrame(_copies(), "doc_id long, text string")
    tile = near_dup.sets_of(docs).toPandas()
    tile = tile.assign(component=tile["id"], bucket=1, block=0, b1=0, b2=0)
    links = near_dup._joined(near_dup.least_equal(85), 85)(tile)
    assert isinstance(links, pd.DataFrame) and 0 < len(links) < len(tile)
