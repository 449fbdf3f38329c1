"""CSS colours in every notation to bytes of sRGB and alpha, as an Arrow-batched function over distinct strings.

Texts are taken apart into a notation and three numbers; all the rest is array arithmetic by notation: to linear sRGB, and,
for what sRGB does not hold, to the nearest colour of the same lightness and hue, by bisection on the chroma in OKLCH.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chromaspan.functions.color import LMS_TO_RGB, OKLAB_TO_LMS

RGBA = "r int, g int, b int, a double"
#: The names of colours.
NAMES = dict(x.split(":") for x in """
aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000 blanchedalmond:ffebcd
blue:0000ff blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00 chocolate:d2691e coral:ff7f50 cornflowerblue:6495ed
cornsilk:fff8dc crimson:dc143c cyan:00ffff darkblue:00008b darkcyan:008b8b darkgoldenrod:b8860b darkgray:a9a9a9 darkgreen:006400 darkgrey:a9a9a9
darkkhaki:bdb76b darkmagenta:8b008b darkolivegreen:556b2f darkorange:ff8c00 darkorchid:9932cc darkred:8b0000 darksalmon:e9967a darkseagreen:8fbc8f
darkslateblue:483d8b darkslategray:2f4f4f darkslategrey:2f4f4f darkturquoise:00ced1 darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff dimgray:696969
dimgrey:696969 dodgerblue:1e90ff firebrick:b22222 floralwhite:fffaf0 forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700
goldenrod:daa520 gray:808080 green:008000 greenyellow:adff2f grey:808080 honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082 ivory:fffff0
khaki:f0e68c lavender:e6e6fa lavenderblush:fff0f5 lawngreen:7cfc00 lemonchiffon:fffacd lightblue:add8e6 lightcoral:f08080 lightcyan:e0ffff
lightgoldenrodyellow:fafad2 lightgray:d3d3d3 lightgreen:90ee90 lightgrey:d3d3d3 lightpink:ffb6c1 lightsalmon:ffa07a lightseagreen:20b2aa
lightskyblue:87cefa lightslategray:778899 lightslategrey:778899 lightsteelblue:b0c4de lightyellow:ffffe0 lime:00ff00 limegreen:32cd32 linen:faf0e6
magenta:ff00ff maroon:800000 mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3 mediumpurple:9370db mediumseagreen:3cb371
mediumslateblue:7b68ee mediumspringgreen:00fa9a mediumturquoise:48d1cc mediumvioletred:c71585 midnightblue:191970 mintcream:f5fffa mistyrose:ffe4e1
moccasin:ffe4b5 navajowhite:ffdead navy:000080 oldlace:fdf5e6 olive:808000 olivedrab:6b8e23 orange:ffa500 orangered:ff4500 orchid:da70d6
palegoldenrod:eee8aa palegreen:98fb98 paleturquoise:afeeee palevioletred:db7093 papayawhip:ffefd5 peachpuff:ffdab9 peru:cd853f pink:ffc0cb plum:dda0dd
powderblue:b0e0e6 purple:800080 rebeccapurple:663399 red:ff0000 rosybrown:bc8f8f royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072 sandybrown:f4a460
seagreen:2e8b57 seashell:fff5ee sienna:a0522d silver:c0c0c0 skyblue:87ceeb slateblue:6a5acd slategray:708090 slategrey:708090 snow:fffafa
springgreen:00ff7f steelblue:4682b4 tan:d2b48c teal:008080 thistle:d8bfd8 tomato:ff6347 turquoise:40e0d0 violet:ee82ee wheat:f5deb3 white:ffffff
whitesmoke:f5f5f5 yellow:ffff00 yellowgreen:9acd32""".split())
#: What 100 % is of each argument, by notation. "hue" is an angle, "share" a percentage with or without its sign.
ARGUMENTS = {
    "rgb": (255, 255, 255), "rgba": (255, 255, 255), "hsl": ("hue", "share", "share"), "hsla": ("hue", "share", "share"), "hwb": ("hue", "share", "share"),
    "lab": (100, 125, 125), "lch": (100, 150, "hue"), "oklab": (1, 0.4, 0.4), "oklch": (1, 0.4, "hue"),
    **{f"color {s}": (1, 1, 1) for s in ("srgb", "srgb-linear", "display-p3", "xyz", "xyz-d65", "xyz-d50")},
}
#: Degrees of an angle's units, matrices between linear spaces, the white of D50, limits of the mapping.
DEGREES = {"": 1.0, "deg": 1.0, "rad": 180 / math.pi, "grad": 0.9, "turn": 360.0}
XYZ_TO_RGB = np.array([[3.2404542, -1.5371385, -0.4985314], [-0.9692660, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0572252]])
P3_TO_XYZ = np.array([[0.4865709486482162, 0.26566769316909306, 0.19821728523436247], [0.2289745640697488, 0.6917385218365064, 0.079286914093745], [0.0, 0.04511338185890264, 1.043944368900976]])
D50_TO_D65 = np.array([[0.9554734527042182, -0.023098536874261423, 0.0632593086610217], [-0.028369706963208136, 1.0099954580058226, 0.021041398966943008], [0.012314001688319899, -0.020507696433477912, 1.3303659366080753]])
RGB_TO_LMS = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
LMS_TO_OKLAB = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])
WHITE_D50 = np.array([0.96422, 1.0, 0.82521])
EDGE, JUST_SEEN, CLOSE = 0.000075, 0.02, 0.0001

_HEX = re.compile(r"#([0-9a-f]{3,8})$")
_CALL = re.compile(r"([a-z-]+)\(\s*([^)]*)\s*\)$")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?")


def _number(word: str, whole) -> float | None:
    """An argument's value; None if it is no number of that kind."""
    if word == "none":
        return 0.0
    found = _NUMBER.match(word)
    if not found:
        return None
    value, unit = float(found[0]), word[found.end() :]
    if whole == "hue":
        return value * DEGREES[unit] if unit in DEGREES else None
    if unit not in ("", "%"):
        return None
    if whole == "share":
        return value / 100
    return value / 100 * whole if unit else value


def _taken_apart(text: str) -> tuple[str, float, float, float, float] | None:
    """(notation, three numbers, alpha) of a colour in lower case; names and hex digits count as rgb."""
    if text == "transparent":
        return ("rgb", 0.0, 0.0, 0.0, 0.0)
    digits = _HEX.match("#" + NAMES[text] if text in NAMES else text)
    if digits:
        h = digits[1]
        h = "".join(c * 2 for c in h) if len(h) < 5 else h
        if len(h) not in (6, 8) or len(digits[1]) == 5:
            return None
        r, g, b, a = bytes.fromhex(h.ljust(8, "f"))
        return ("rgb", r, g, b, a / 255)
    call = _CALL.match(text)
    if not call:
        return None
    name, body = call[1], call[2].strip()
    if "," in body:
        words = [w.strip() for w in body.split(",")]
        alpha = words.pop() if len(words) == 4 else None
    else:
        front, slash, back = body.partition("/")
        words, alpha = front.split(), back.strip() if slash else None
    if name == "color" and words:
        name, words = f"color {words[0]}", words[1:]
    if name not in ARGUMENTS or len(words) != 3:
        return None
    values = [_number(w, k) for w, k in zip(words, ARGUMENTS[name], strict=True)]
    a = 1.0 if alpha is None else _number(alpha, 1)
    if a is None or None in values:
        return None
    return (name.replace("rgba", "rgb").replace("hsla", "hsl"), *values, min(1.0, max(0.0, a)))


def _linear(c):
    size = np.abs(c)
    return np.where(size <= 0.04045, c / 12.92, np.sign(c) * ((size + 0.055) / 1.055) ** 2.4)


def _encoded(c):
    size = np.abs(c)
    return np.where(size <= 0.0031308, c * 12.92, np.sign(c) * (1.055 * size ** (1 / 2.4) - 0.055))


def _oklab(rgb):
    return np.cbrt(rgb @ RGB_TO_LMS.T) @ LMS_TO_OKLAB.T


def _from_oklab(lab):
    return (lab @ np.array(OKLAB_TO_LMS).T) ** 3 @ np.array(LMS_TO_RGB).T


def _rounded(x):
    return np.floor(x + 0.5)


def mapped(rgb):
    """Linear sRGB (n x 3) in the gamut: colours outside keep lightness and hue and lose as much chroma as they must."""
    inside = lambda c: ((c >= -EDGE) & (c <= 1 + EDGE)).all(axis=1)
    out = np.clip(rgb, 0, 1)
    todo = np.flatnonzero(~inside(rgb))
    lab = _oklab(rgb[todo])
    out[todo[lab[:, 0] >= 1]], out[todo[lab[:, 0] <= 0]] = 1.0, 0.0
    mid_light = (lab[:, 0] > 0) & (lab[:, 0] < 1)
    todo, lab = todo[mid_light], lab[mid_light]
    high = np.hypot(lab[:, 1], lab[:, 2])
    tint = np.where(high[:, None] == 0, 0.0, lab[:, 1:] / np.where(high == 0, 1, high)[:, None])
    low, fits, best = np.zeros(len(todo)), np.ones(len(todo), bool), out[todo]
    open_ = high - low > CLOSE
    while open_.any():
        k = np.flatnonzero(open_)
        mid = (low[k] + high[k]) / 2
        want = np.column_stack((lab[k, 0], tint[k] * mid[:, None]))
        now = _from_oklab(want)
        clipped = np.clip(now, 0, 1)
        best[k] = clipped
        good = fits[k] & inside(now)
        off = np.sqrt(((_oklab(clipped) - want) ** 2).sum(axis=1))
        near = ~good & (off < JUST_SEEN)
        fits[k[near]] = False
        low[k[good | near]] = mid[good | near]
        high[k[~good & ~near]] = mid[~good & ~near]
        open_ = high - low > CLOSE
        open_[k[near & (JUST_SEEN - off < CLOSE)]] = False
        done = k[near & (JUST_SEEN - off < CLOSE)]
        high[done] = low[done]
    out[todo] = best
    return out


def _hue_bytes(h, s, light):
    """Bytes of HSL colours; s and light from 0 to 1."""
    c = (1 - np.abs(2 * light - 1)) * s
    k = (np.array([[0.0, 8.0, 4.0]]) + np.mod(h, 360)[:, None] / 30) % 12
    ramp = np.clip(np.minimum(k - 3, 9 - k), -1, 1)
    return _rounded((light[:, None] - c[:, None] / 2 * ramp) * 255)


def _cie(light, a, b):
    """Linear sRGB of CIE Lab under D50."""
    mid = (np.clip(light, 0, 100) + 16) / 116
    f = np.column_stack((mid + a / 500, mid, mid - b / 200))
    xyz = np.where(f**3 > 0.008856, f**3, (116 * f - 16) / 903.3) * WHITE_D50
    return xyz @ D50_TO_D65.T @ XYZ_TO_RGB.T


def _bytes(name: str, x):
    """Bytes of sRGB (n x 3) of one notation's numbers (n x 3)."""
    one, two, three = x.T
    if name == "rgb":
        return np.clip(_rounded(x), 0, 255)
    if name == "hsl":
        return _hue_bytes(one, np.clip(two, 0, 1), np.clip(three, 0, 1))
    if name == "hwb":
        white, black = np.clip(two, 0, 1), np.clip(three, 0, 1)
        both = white + black
        full = np.ones(len(x))
        pure = _hue_bytes(one, full, full / 2) / 255 * (1 - both)[:, None] + white[:, None]
        grey = np.repeat((white / np.where(both == 0, 1, both))[:, None], 3, axis=1)
        return _rounded(np.where((both >= 1)[:, None], grey, pure) * 255)
    turn = np.radians(three)
    if name in ("lch", "oklch"):
        two, three = np.maximum(two, 0) * np.cos(turn), np.maximum(two, 0) * np.sin(turn)
    if name in ("lab", "lch"):
        linear = _cie(one, two, three)
    elif name in ("oklab", "oklch"):
        linear = _from_oklab(np.column_stack((np.clip(one, 0, 1), two, three)))
    else:
        linear = {
            "color srgb": lambda: _linear(x), "color srgb-linear": lambda: x, "color display-p3": lambda: _linear(x) @ P3_TO_XYZ.T @ XYZ_TO_RGB.T,
            "color xyz-d50": lambda: x @ D50_TO_D65.T @ XYZ_TO_RGB.T,
        }.get(name, lambda: x @ XYZ_TO_RGB.T)()
    return _rounded(np.clip(_encoded(mapped(linear)), 0, 1) * 255)


def parse(texts: list[str | None]) -> list[tuple[int, int, int, float] | None]:
    """(r, g, b, a) of each text; None for what is no colour by itself."""
    parts = [None if t is None else _taken_apart(t.strip().lower()) for t in texts]
    out: list = [None] * len(texts)
    for name in {p[0] for p in parts if p}:
        at = [k for k, p in enumerate(parts) if p and p[0] == name]
        made = _bytes(name, np.array([parts[k][1:4] for k in at], float))
        for k, (r, g, b) in zip(at, made.astype(int).tolist(), strict=True):
            out[k] = (r, g, b, parts[k][4])
    return out


def css_color(value: Column) -> Column:
    """struct<r, g, b, a> of a colour in any notation; null for others. Each batch's distinct strings are parsed once."""
    @F.pandas_udf(RGBA)
    def parsed(said: pd.Series) -> pd.DataFrame:
        code, each = pd.factorize(said)
        found = [*parse(list(each)), None]
        rows = pd.DataFrame([x or (None, None, None, None) for x in found], columns=list("rgba"))
        return rows.astype({"r": "Int32", "g": "Int32", "b": "Int32", "a": "float64"}).iloc[code].reset_index(drop=True)

    seen = parsed(value)
    return F.when(seen["a"].isNotNull(), seen)
