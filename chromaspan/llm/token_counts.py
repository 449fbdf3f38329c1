"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Pieces of the pre-split are independent: a text's prefix count is the count of the pieces before plus that of
the started piece, which prefix_bpe finds from shorter prefixes. The counts of a word's prefixes are stored, a
text's table is put together from its words', and every question is a lookup in that table: the number of
tokens, the longest prefix within a budget, the tokens of a truncated text. Nothing is encoded again.

Defined cases: a null text is the empty text with 0 tokens; repeated rows give repeated results; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, prefix_bpe

#: The pre-split of byte-level vocabularies; the white space is Unicode's.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
WHITE = regex.compile(r"\p{White_Space}+")
#: Contractions that split differently while they are unfinished.
LONG_CONTRACTIONS = frozenset(["'re", "'ve", "'ll"])
#: A space beside other white space: there the cut at spaces does not hold.
DOUBLE = regex.compile(r" \p{White_Space}|\p{White_Space} ")
#: Words that a worker remembers, in two generations, so that frequent ones stay.
WORDS_KEPT = 250_000


class PrefixCounter:
    """Prefix counts of texts under one byte-level BPE file."""

    def __init__(self, path: str):
        self.bpe = prefix_bpe.prefix_bpe(path)
        self.special = self.bpe.special
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}

    def by_character(self, piece: str) -> list[int]:
        """counts[k] of piece[:k]; for unfinished contractions as the pre-split would take them."""
        out = [0, *self.ends(piece)]
        if piece in LONG_CONTRACTIONS:
            out[2] = 2
        return out

    def ends(self, piece: str) -> bytes | list[int]:
        """Counts of piece[:k], k from 1, read where characters end."""
        raw = piece.encode()
        counts = self.bpe.counts(raw)
        if len(raw) > len(piece):
            inner = [c for k, c in enumerate(counts[:-1], 1) if raw[k] & 192 != 128]
            inner.append(counts[-1])
            return bytes(inner) if len(raw) <= prefix_bpe.SHORT else inner
        return counts

    def size(self, piece: str) -> int:
        """Tokens of one piece."""
        return self.bpe.size(piece.encode())

    def word(self, word: str) -> bytes:
        """The stored table of a text part that begins where a piece must begin: counts of word[:k], k from 1, as bytes;
        nothing if they are too large for that."""
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha():
            counts = self.ends(word)
        elif bare[-1:] in ".,#$%&*" and bare[:-1].isalpha():
            counts = self.ends(word[:-1])
            counts = [*counts, counts[-1] + 1]
        else:
            counts = self._plain(word)[1:]
        if max(counts[-1], len(counts) >> 8) > 250:
            return b""
        if len(self.words) > WORDS_KEPT:
            self.words, self.words_before = {}, self.words
        table = self.words[word] = bytes(counts)
        return table

    def word_again(self, word: str) -> bytes:
        table = self.words_before.get(word)
        if table is None:
            return self.word(word)
        self.words[word] = table
        return table

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings; these stand at the odd places and are one token each."""
        return self.special.split(text) if self.special and "<" in text else [text]

    def parts(self, text: str) -> list[str] | None:
        """The text cut before every space that stands between two characters that are no white space: a piece
        begins there in the text and in each of its prefixes. None if spaces stand beside other white space."""
        if DOUBLE.search(text) or text[:1] == " " or WHITE.match(text[-1:]):
            return None
        words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        return words

    def table(self, text: str):
        """numpy array: element k is the token count of text[:k], read as a text of its own."""
        import numpy as np

        if not text:
            return np.zeros(1, np.int32)
        words = None if self.special and self.special.search(text) else self.parts(text)
        if words is None:
            return np.array(self.prefixes(text), np.int32)
        tables = [self.words.get(w) or self.word_again(w) for w in words]
        sizes = np.fromiter(map(len, tables), np.int64, len(tables))
        if not sizes.all():
            return np.array(self.prefixes(text), np.int32)
        counts = np.frombuffer(b"".join(tables), np.uint8).astype(np.int32)
        last = counts[np.cumsum(sizes) - 1]
        return np.concatenate((np.zeros(1, np.int32), counts + np.repeat((np.cumsum(last) - last).astype(np.int32), sizes)))

    def count(self, text: str) -> int:
        """Tokens of the text."""
        return int(self.table(text)[-1])

    def prefixes(self, text: str) -> list[int]:
        """Token count of every prefix text[:k], k from 0 to len(text), each read as a text of its own."""
        out, base, before = [0], 0, ""
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                started = base - sum(map(self.size, SPLIT.findall(before)))
                out += [started + sum(map(self.size, SPLIT.findall(before + part[:j]))) for j in range(1, len(part))] + [base + 1]
                base += 1
            elif part:
                inner = self._plain(part)
                out += [base + n for n in inner[1:]]
                base += inner[-1]
            before = "" if k % 2 else part
        return out

    def _plain(self, part: str) -> list[int]:
        out, base, at = [0], 0, 0
        runs = {m.start(): m.group() for m in WHITE.finditer(part)}
        for p in SPLIT.findall(part):
            begin, at = at, at + len(p)
            if begin in runs:
                run = runs[begin]
                out += [base + n for n in self.by_character(run)[1:]]
            rest = len(out) - 1 - begin  # what the run of white space has already told
            if rest < len(p):
                out += [base + n for n in self.by_character(p)[1 + max(0, rest) :]]
            base += self.size(p)
        return out


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def within(table, budget: int) -> int:
    """Code points of the longest prefix within the budget, by lookup in a text's table."""
    import numpy as np

    return int(np.flatnonzero(table <= budget)[-1])


def token_counts(docs: DataFrame, path: str, budget: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and cut_chars: the longest prefix, in code points, of at most ``budget`` tokens;
    both are read from each text's prefix table."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = prefix_counter(path)
        for b in batches:
            counts, cuts = [], []
            for t in b.column(1).to_pylist():
                table = counter.table(t)
                counts.append(int(table[-1]))
                cuts.append(within(table, budget))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "cut_chars"])

    rows = common.whole_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, cut_chars long")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, counts array<int>: element k is the token count of the first k code points; every later budget
    question is a lookup in it (see tokens_before and longest_within)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = prefix_counter(path)
        for b in batches:
            for k, t in enumerate(b.column(1).to_pylist()):
                table = counter.table(t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table, pa.int32()))], names=["doc_id", "counts"])

    return common.whole_texts(docs).mapInArrow(run, "doc_id long, counts array<int>")


def tokens_before(counts: F.Column, chars: F.Column) -> F.Column:
    """Tokens of the first ``chars`` code points, from a prefix table."""
    return F.get(counts, F.least(chars, F.size(counts) - 1))


def longest_within(counts: F.Column, budget: int) -> F.Column:
    """Code points of the longest prefix within the budget, from a prefix table."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda k: F.get(counts, k) <= budget))
