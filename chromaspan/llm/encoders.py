"""Tokenizers by file path, one instance per Python worker."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable

from . import prefix_bpe

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words outside Latin-1 texts that a worker remembers.
WORDS_KEPT = 100_000
#: White space of Unicode: what the word tokenizer drops between words.
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: What keeps a text from the quick way: characters beyond Latin-1, control characters, and what may be a special string.
HARD = re.compile("[^\t-\r -~\x85\xa0-\xff]|<\\|")
#: Pieces other than runs of letters, in lower-cased Latin-1 (fixed values: the pre-split of the word tokenizer).
SIGNS = re.compile("'(?:s|t|re|ve|m|ll|d)|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾ \t-\r\x85\xa0]+|[0-9²³¹¼-¾]")
#: The normalizer and the pre-split that the two expressions above stand for (fixed values of the tokenizer file).
NORMALIZERS = ("NFC", "Replace", "Lowercase")
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of a tokenizer that drops white space and marks word ends, as little-endian 32-bit bytes.

    Most texts take the quick way: lower case, pieces set apart by single spaces, and one call of tiktoken's core,
    for which a space behind a piece is the mark of its end (no piece holds one). Other texts go word by word
    through the tokenizer itself: white space ends every word and never joins a token.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = tuple(n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ()))
        splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        if kinds != NORMALIZERS or splits[:1] != [PRE_SPLIT] or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: not a lower-casing word tokenizer with the pre-split that this encoder knows")
        self.tok = tokenizer(path)
        letters, special = prefix_bpe.byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for name, i in spec["model"]["vocab"].items():
            if name not in special:
                whole = name.endswith("</w>")
                ranks.setdefault(bytes(letters[c] for c in name.removesuffix("</w>")) + b" " * whole, i)
        self.core = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [self.hard(t) if HARD.search(t) else self.quick(t) for t in texts]

    def quick(self, text: str) -> bytes:
        pieces = " ".join(SIGNS.sub(r" \g<0> ", text.lower()).split())
        return self.core.encode_to_numpy(pieces + " ").tobytes() if pieces else b""

    def hard(self, text: str) -> bytes:
        words = [w for w in WHITE.split(text) if w]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        self.known.update(self.encode_words(list(set(words).difference(self.known))))
        return b"".join(map(self.known.__getitem__, words))

    def encode_words(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        """The words as one text; where each one's ids begin and end is read from the offsets."""
        import numpy as np

        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            found = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts = np.searchsorted(np.array([a for a, _ in found.offsets] or [0])[: len(ids)], begins).tolist()
            raw = ids.tobytes()
            yield from ((w, raw[4 * cuts[k] : 4 * cuts[k + 1]]) for k, w in enumerate(part))


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
