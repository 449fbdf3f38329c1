"""Colours in every CSS notation."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from chromaspan.functions import css

#: Texts with their colour in hex and alpha; None for what is no colour.
SAID = {
    "red": ("#ff0000", 1), "RebeccaPurple": ("#663399", 1), "  aliceblue ": ("#f0f8ff", 1), "transparent": ("#000000", 0), "currentcolor": None, "inherit": None, "none": None, "auto": None, "": None, "notacolor": None, "srgb": None,
    "#abc": ("#aabbcc", 1), "#AABBCC": ("#aabbcc", 1), "#abcd": ("#aabbcc", 0xDD / 255), "#aabbccdd": ("#aabbcc", 0xDD / 255), "#ab": None, "#abcde": None, "#gggggg": None, "#aabbccddee": None, "aabbcc": None,
    "rgb(255, 0, 0)": ("#ff0000", 1), "rgb(255 0 0)": ("#ff0000", 1), "rgba(255, 0, 0, 50%)": ("#ff0000", 0.5), "rgb(100% 0% 50% / 0.25)": ("#ff0080", 0.25), "rgb(300 -5 12.5)": ("#ff000d", 1), "rgb(255 none 0)": ("#ff0000", 1),
    "rgb(255 0)": None, "rgb(255, 0)": None, "rgb(255, 0, 0, 0.5, 9)": None, "rgb(a b c)": None, "rgb()": None, "rgb(1 2 3 /)": None, "rgb(1px 2 3)": None, "rgb(1, , 3)": None,
    "hsl(120, 100%, 50%)": ("#00ff00", 1), "hsl(120 100 50)": ("#00ff00", 1), "hsl(-120 100% 50% / .5)": ("#0000ff", 0.5), "hsl(0.5turn 100% 50%)": ("#00ffff", 1), "hsl(200grad 100% 50%)": ("#00ffff", 1), "hsla(0 0% 50% / 2)": ("#808080", 1), "hsl(120furlong 1 1)": None,
    "hwb(0 0% 0%)": ("#ff0000", 1), "hwb(0 50% 50%)": ("#808080", 1), "hwb(120 20% 20%)": ("#33cc33", 1), "hwb(0 100% 100%)": ("#808080", 1),
    "lab(100 0 0)": ("#ffffff", 1), "lab(0 0 0)": ("#000000", 1), "lch(0 0 0)": ("#000000", 1), "oklab(1 0 0)": ("#ffffff", 1), "oklab(0.5 0 0)": ("#636363", 1), "oklch(0.627966 0.257704 29.2346)": ("#ff0000", 1), "oklch(62.7966% 0.257704 29.2346deg / 40%)": ("#ff0000", 0.4),
    "oklch(1.2 0.3 20)": ("#fffaf9", 1), "oklch(-1 0.3 20)": ("#000000", 1), "color(srgb 1 0.5 0)": ("#ff8000", 1), "color(srgb-linear 0.5 0.5 0.5)": ("#bcbcbc", 1), "color(display-p3 1 1 1)": ("#ffffff", 1), "color(magic 1 0 0)": None, "color(srgb 1 0)": None,
    "color(xyz 0.4124564 0.2126729 0.0193339)": ("#ff0000", 1), "color(xyz-d65 0 0 0)": ("#000000", 1), "color(xyz-d50 0.96422 1 0.82521)": ("#ffffff", 1), "var(--x)": None,
    "oklch(0.879 0.169 91.605)": ("#ffd230", 1), "lch(14.03% 7.44 268.93)": ("#1f242e", 1), "color(srgb 0.072 0.168 0.12)": ("#122b1f", 1), "oklab(0.363344 -0.0549272 0.0203635 / 0.3)": ("#1f4733", 0.3), "hsl(133.3333grad 100% 25%)": ("#008000", 1),
}


def test_values_of_all_notations(spark):
    rows = spark.createDataFrame([(t,) for t in SAID] + [(None,)], "t string").select("t", css.css_color(F.col("t")).alias("c"))
    got = {r["t"]: r["c"] for r in rows.collect()}
    assert got[None] is None
    for t, want in SAID.items():
        if want is None:
            assert got[t] is None, t
        else:
            c = got[t]
            near = all(abs(a - b) <= 1 for a, b in zip(c[:3], bytes.fromhex(want[0][1:]), strict=True))
            assert near and math.isclose(c["a"], want[1]), (t, c)


def test_there_are_all_names():
    assert len(css.NAMES) == 148 and all(css.parse([n])[0] == (*bytes.fromhex(h), 1.0) for n, h in css.NAMES.items())


def test_colors_outside_the_gamut_keep_lightness_and_hue():
    rng = random.Random(3)
    lab = np.array([(rng.uniform(0.1, 0.95), rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4)) for _ in range(400)])
    linear = css._from_oklab(lab)
    out = css.mapped(linear)
    inside = ((linear >= -css.EDGE) & (linear <= 1 + css.EDGE)).all(axis=1)
    assert 20 < inside.sum() < 380 and ((out >= 0) & (out <= 1)).all()
    assert np.allclose(out[inside], np.clip(linear[inside], 0, 1))
    back = css._oklab(out[~inside])
    before = lab[~inside]
    assert np.abs(back[:, 0] - before[:, 0]).max() < 0.021  # at most what is just seen
    assert (np.hypot(back[:, 1], back[:, 2]) <= np.hypot(before[:, 1], before[:, 2]) + 0.021).all()
    vivid = np.hypot(back[:, 1], back[:, 2]) > 0.1
    turn = np.arctan2(back[:, 2], back[:, 1]) - np.arctan2(before[:, 2], before[:, 1])
    assert np.abs(np.angle(np.exp(1j * turn)))[vivid].max() < 0.25


def test_mapping_one_by_one():
    """The same bisection, a colour at a time."""

    def alone(rgb):
        fits = lambda c: all(-css.EDGE <= x <= 1 + css.EDGE for x in c)
        if fits(rgb):
            return np.clip(rgb, 0, 1)
        light, a, b = css._oklab(np.array([rgb]))[0]
        if not 0 < light < 1:
            return np.full(3, 1.0 if light >= 1 else 0.0)
        chroma = math.hypot(a, b)
        low, high, plain = 0.0, chroma, True
        now = np.array(rgb)
        while high - low > css.CLOSE:
            mid = (low + high) / 2
            want = np.array([light, a / chroma * mid, b / chroma * mid])
            now = css._from_oklab(want[None])[0]
            off = np.linalg.norm(css._oklab(np.clip(now, 0, 1)[None])[0] - want)
            if plain and fits(now):
                low = mid
            elif off >= css.JUST_SEEN:
                high = mid
            elif css.JUST_SEEN - off < css.CLOSE:
                break
            else:
                low, plain = mid, False
        return np.clip(now, 0, 1)

    rng = np.random.default_rng(4)
    colors = rng.uniform(-0.6, 1.6, (300, 3))
    assert np.allclose(css.mapped(colors), [alone(c) for c in colors], atol=1e-12)
