"""Reading order: layouts worked out by hand, and pages at random against loops over every point."""

import numpy as np
import pytest

from fitgrid.operators import layout

WIDTH = 595.0
BLOCKS = "page long, pos long, x0 double, y0 double, x1 double, y1 double, name string"


def read(spark, *blocks):
    df = spark.createDataFrame([(1, i, *map(float, b[1:]), b[0]) for i, b in enumerate(blocks)], BLOCKS)
    rows = layout.reading_order(df, WIDTH).orderBy("place").collect()
    return [r["name"] for r in rows], {r["gutter"] for r in rows}


def test_one_column(spark):
    assert read(spark, ("second", 50, 200, 500, 240), ("first", 50, 100, 500, 140), ("short", 50, 150, 120, 160)) == (["first", "short", "second"], {None})


def test_a_wide_block_cuts_columns_into_bands(spark):
    names, gutter = read(spark, ("R2", 320, 210, 555, 260), ("L1", 40, 100, 270, 150), ("R1", 320, 100, 555, 150), ("WIDE", 40, 170, 555, 190), ("L2", 40, 210, 270, 260))
    assert names == ["L1", "R1", "WIDE", "L2", "R2"] and 270 <= gutter.pop() <= 320


def test_a_narrow_block_beside_columns_leaves_no_gutter(spark):
    assert read(spark, ("left", 40, 100, 200, 140), ("right", 400, 100, 555, 140), ("middle", 180, 110, 420, 130))[1] == {None}
    # one above them does not stand in the way, and comes first
    names, gutter = read(spark, ("right", 400, 100, 555, 140), ("left", 40, 100, 200, 140), ("name", 180, 20, 420, 40))
    assert names == ["name", "left", "right"] and gutter != {None}


def test_a_lone_date_on_the_right_is_no_column(spark):
    assert read(spark, ("date", 450, 20, 555, 30), ("text", 40, 100, 300, 200), ("more", 40, 220, 300, 300))[1] == {None}


def by_hand(blocks):
    """Blocks (pos, x0, y0, x1, y1) of a page; tries every point."""
    lo = WIDTH * 0.25
    fine = []
    for i in range(int(WIDTH * 0.5) + 1):
        x = lo + i
        left, right = [b for b in blocks if b[3] <= x], [b for b in blocks if b[1] >= x]
        ok = left and right and min(b[2] for b in left) < max(b[4] for b in right) and min(b[2] for b in right) < max(b[4] for b in left)
        for b in blocks:
            if ok and b[1] < x < b[3] and b[3] - b[1] <= 0.6 * WIDTH:
                ok = not any(b[2] < s[4] and s[2] < b[4] for s in left + right)
        fine.append(bool(ok))
    best, start = None, None
    for i, ok in enumerate([*fine, False]):
        if ok and start is None:
            start = i
        elif not ok and start is not None:
            if i - 1 - start >= 4 and (best is None or i - 1 - start > best[1] - best[0]):
                best = (start, i - 1)
            start = None

    def top(b):
        return (round(b[2], 1), b[1], b[0])

    if best is None:
        return [b[0] for b in sorted(blocks, key=top)], None
    g = lo + sum(best) / 2
    out, upper = [], float("-inf")
    across = sorted((b for b in blocks if b[1] < g < b[3]), key=top)
    for cut in [*across, None]:
        lower = (cut[2] + cut[4]) / 2 if cut else float("inf")
        for side in ([b for b in blocks if b[3] <= g], [b for b in blocks if b[1] >= g]):
            out += [b[0] for b in sorted((b for b in side if upper <= (b[2] + b[4]) / 2 < lower), key=top)]
        if cut:
            out.append(cut[0])
            upper = lower
    return out, g


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_point(spark, seed):
    rng = np.random.default_rng(seed)
    pages = {}
    for page in range(150):
        blocks = []
        for pos in range(int(rng.integers(1, 15))):
            column = rng.integers(0, 2)
            kind = rng.random()
            x0, w = (40, 500) if kind < 0.1 else (int(rng.integers(150, 350)), 60) if kind < 0.15 else (40 + 280 * column + int(rng.integers(0, 8)) / 4, int(rng.integers(100, 270)))
            y0 = int(rng.integers(0, 1400)) / 2
            blocks.append((pos, float(x0), y0, float(x0 + w), y0 + int(rng.integers(8, 60))))
        pages[page] = blocks
    df = spark.createDataFrame([(p, *b, "x") for p, bs in pages.items() for b in bs], BLOCKS)
    got, gutters = {}, {}
    for r in layout.reading_order(df, WIDTH).orderBy("page", "place").collect():
        got.setdefault(r["page"], []).append(r["pos"])
        gutters[r["page"]] = r["gutter"]
    want = {p: by_hand(bs) for p, bs in pages.items()}
    assert got == {p: w[0] for p, w in want.items()}
    assert gutters == {p: w[1] for p, w in want.items()}
    assert sum(g is not None for g in gutters.values()) > 20


def test_no_blocks(spark):
    assert layout.reading_order(spark.createDataFrame([], BLOCKS), WIDTH).collect() == []
