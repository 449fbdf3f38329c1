"""Byte-pair encoding by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token t such that the encoding of what stands before t, followed
by t, is stable under the merges. So each prefix's last token and count follow from shorter prefixes. The
states of prefixes are stored and shared: a word that begins as an earlier one starts from what is known.
"""

from __future__ import annotations

import functools
import json
import re

#: Prefix states that a worker stores before it begins anew.
STATES_KEPT = 600_000
#: Bytes up to which prefixes are stored; longer pieces are worked out in arrays.
SHORT = 40


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def backward_tree(ids: dict[bytes, int]) -> tuple[dict[int, int], list[int]]:
    """The tokens read from their ends: (node << 8 | byte) -> node, and the token that a node completes or -1."""
    step: dict[int, int] = {}
    ends = [-1]
    for raw, i in ids.items():
        node = 0
        for byte in reversed(raw):
            node = step.setdefault(node << 8 | byte, len(ends))
            if node == len(ends):
                ends.append(-1)
        ends[node] = i
    return step, ends


class PrefixBpe:
    """Prefix states under one tokenizer file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a byte-level vocabulary without normalizer and with the usual pre-split")
        letters, names = byte_letters(), spec["model"]["vocab"]
        specials = {t["content"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        inner = {bytes(letters[c] for c in name): i for name, i in names.items() if name not in specials}
        self.ids = inner
        self.step, self.ends = backward_tree(inner)
        #: rank of the merge that makes a token (-1: none), its parts, and the rank of each pair
        self.made = dict.fromkeys(names.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole_id = (names[a], names[b]), names[a + b]
            self.rank[pair] = r
            if self.made[whole_id] < 0:
                self.made[whole_id], self.parts[whole_id] = r, pair
        self.pairs: dict[int, bool] = {}
        self.states: dict[bytes, tuple[int, int, int, bytes]] = {}

    def boundary_stays(self, a: int, b: int) -> bool:
        """Whether no merge crosses the boundary when a and b are built up side by side.

        Both are taken apart, latest merge first (of equal ranks the right one, as merges run left to
        right); at each state the facing tokens must not have a merge that comes before the one undone.
        """
        limit, made, parts, rank = 1 << 60, self.made, self.parts, self.rank
        while True:
            if rank.get((a, b), limit) < limit:
                return False
            ra, rb = made[a], made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def stays(self, a: int, b: int) -> bool:
        ok = self.pairs.get(a << 20 | b)
        if ok is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            ok = self.pairs[a << 20 | b] = self.boundary_stays(a, b)
        return ok

    def fits(self, raw: bytes, i: int) -> list[tuple[int, int]]:
        """(begin, token) of the tokens that end at i, longest first."""
        found, node, j, get, ends = [], 0, i, self.step.get, self.ends
        while j:
            node = get(node << 8 | raw[j - 1])
            if node is None:
                break
            j -= 1
            if (t := ends[node]) >= 0:
                found.append((j, t))
        found.reverse()
        return found

    def state(self, raw: bytes) -> tuple[int, int, int, bytes]:
        """(last token, where it begins, the token before it or -1, count of every prefix) of a short non-empty prefix.

        Only one last token leaves the encoding stable, so the likely ones are tried first: the last token of the
        prefix one byte shorter with the new byte, then the new byte alone.
        """
        states, ids, pairs = self.states, self.ids, self.pairs
        if len(states) > STATES_KEPT:
            states.clear()
        k, s = len(raw), None
        while k and (s := states.get(raw[:k])) is None:
            k -= 1
        for i in range(k + 1, len(raw) + 1):
            if s is None:
                s = (ids[raw[:1]], 0, -1, b"\x01")
            else:
                last, begin, before, counts = s
                t = ids.get(raw[begin:i])
                if t is not None and (before < 0 or pairs.get(before << 20 | t) or self.stays(before, t)):
                    s = (t, begin, before, counts + counts[-1:])
                else:
                    t = ids[raw[i - 1 : i]]
                    if pairs.get(last << 20 | t) or self.stays(last, t):
                        s = (t, i - 1, last, counts + bytes((counts[-1] + 1,)))
                    else:
                        for j, t in self.fits(raw, i):
                            if not j:
                                s = (t, 0, -1, counts + b"\x01")
                                break
                            own = states.get(raw[:j]) or self.state(raw[:j])
                            if self.stays(own[0], t):
                                s = (t, j, own[0], counts + bytes((own[3][-1] + 1,)))
                                break
            states[raw[:i]] = s
        return s

    def counts(self, raw: bytes) -> bytes | list[int]:
        """Token count of every prefix of a piece but the empty one, by byte."""
        return self.state(raw)[3] if len(raw) <= SHORT else self.table(raw)[1:]

    def table(self, raw: bytes) -> list[int]:
        """Token count of every prefix of a piece of any length, by byte."""
        n = len(raw)
        counts, last = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j, t in self.fits(raw, i):
                if not j or self.stays(last[j], t):
                    counts[i], last[i] = counts[j] + 1, t
                    break
        return counts

    def size(self, raw: bytes) -> int:
        return self.counts(raw)[-1] if raw else 0


@functools.lru_cache(maxsize=2)
def prefix_bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)
