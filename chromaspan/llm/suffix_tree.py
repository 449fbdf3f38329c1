"""Scores of texts by a probabilistic suffix tree.

A text is lower-cased (A-Z) and taken as its words (runs of bytes other than 0x20 and 0x09-0x0D), joined by single
spaces, and an end. The tree's symbols are the bytes of that form, so it gives every sequence of words a probability,
new words too. Its states are contexts of 0 to DEPTH bytes; before a text's first byte stand begin marks.

- Candidates are all contexts that occur LEAST_COUNT times in training texts, with all their next symbols, however large
  the corpus (LEAST_SHARE may ask for a share of the training symbols, too; then symbols with a LISTED-th of it are listed).
- A next symbol's probability is its count less DISCOUNT, and the discounted mass spread as the next shorter context
  has it; the empty context is smoothed by adding 0.1 to each symbol.
- A context is a state if its distribution diverges from that of the next shorter one by GAIN nats over its
  occurrences (Kullback-Leibler), or if a longer state ends with it.
- Each symbol of a text is scored in the longest state that its past ends with.

fit() counts windows of DEPTH + 1 bytes in tasks and sums them by Spark. Contexts of up to SHORT bytes are grown at the
driver (at most 256 ** (SHORT + 1) entries, whatever the corpus); longer ones by tasks, each with all contexts that end with
the same SHORT + 1 bytes, so a task has every shorter context that it needs. These parts of the tree stay in the shared folder.
scores() looks up windows with a share of at least HOT_WINDOWS of the training symbols (at most 1 / HOT_WINDOWS of them) in a
broadcast table, and sends the others to the parts of the tree, with the documents that hold them.

The base score needs each word's count over all training
texts: words with a share of at least HOT_SHARE (at most 1 / HOT_SHARE of them) are broadcast with their counts, the
others' occurrences are sent to buckets of word hashes, where their counts and each document's sum are found, so no key
has more than that share of the tokens. Words are told apart by 64-bit hashes.

Defined cases: a null text is the empty one, which holds only the end; a null doc_id counts as held out; repeated rows
are rows of their own and count as often; without training documents (or any rows) the tree has one state that knows
no symbol, and counts are 0; other columns, whatever their names, are left out; a very long text is read in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 6
SHORT = 2
LEAST_SHARE, LEAST_COUNT, LISTED = 0.0, 3, 4
DISCOUNT, GAIN = 0.6, 3.0
HOT_SHARE, HOT_WINDOWS = 1e-5, 2.5e-7
#: Distinct windows and training symbols of a part of the tree, and entries of it in one row.
PART_WINDOWS, PART_SYMBOLS, ROW_ENTRIES = 1 << 19, 1 << 26, 1 << 16
#: Symbols worked at once, bytes of text and documents that a task gathers, bytes of text of a bucket of words and the
#: least number of buckets.
BLOCK, FLUSH_BYTES, FLUSH_DOCS, BUCKET_BYTES, LEAST_BUCKETS = 1 << 21, 8 << 20, 60_000, 16 << 20, 64
#: Distinct windows (or words) of a task that wait to be summed, and about how many of them are summed at once.
HELD_KEYS, MERGED_AT_ONCE = 3_000_000, 1 << 18
BEGIN, END = b"\t", b"\n"
PLACES = 257  # 256 bytes and one more for what cannot occur

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def normal(text: str) -> bytes:
    """Words joined by single spaces, and the end."""
    raw = text.encode().translate(_LOWER)
    if len(raw) < BLOCK:
        return b" ".join(raw.split()) + END
    return _SPACES.sub(b" ", raw).strip(b" ") + END


def held_out(share: int = 10) -> Column:
    """Documents from whose texts nothing is learned: crc32 of the id's decimal text divisible by ``share``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % share == 0


def _rows(docs: DataFrame, held: Column) -> DataFrame:
    rows = common.whole_texts(docs).withColumn("held", held)
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "held", "text")


def _gathered(batches: Iterator, names: tuple[str, ...]) -> Iterator[tuple[list, list[bytes]]]:
    """Documents of several batches: their other columns, a tuple each, and their normal texts."""
    others, texts, size = [], [], 0
    for b in batches:
        at = [b.column(b.schema.names.index(n)) for n in names]
        text = b.column(b.schema.names.index("text"))
        for k in range(b.num_rows):
            raw = normal(text[k].as_py())
            if texts and (size + len(raw) > FLUSH_BYTES or len(texts) >= FLUSH_DOCS):
                yield others, texts
                others, texts, size = [], [], 0
            others.append(tuple(c[k].as_py() for c in at))
            texts.append(raw)
            size += len(raw)
    if texts:
        yield others, texts


def _framed(texts: list[bytes]):
    """The texts with begin marks before each, as bytes, and where each text begins."""
    import numpy as np

    marks = BEGIN * (DEPTH + 1)
    sizes = np.array([len(t) + len(marks) for t in texts], np.int64)
    return marks + marks.join(texts), np.concatenate(([0], np.cumsum(sizes)))[:-1] + len(marks)


def _windows(raw: bytes) -> Iterator[tuple]:
    """By blocks: the places of its symbols, and each symbol's window as an integer.

    The window's highest byte is the symbol, below it its past, latest first; so contexts of all lengths are prefixes.
    """
    import numpy as np

    n, lead = len(raw) - DEPTH, 7 - DEPTH
    padded = np.frombuffer(b"\0" * lead + raw + b"\0" * 8, np.uint8)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        whole = -(-(hi - lo) // 8) * 8
        block = padded[lo : lo + whole + 7]
        x = np.empty(whole, np.uint64)
        for j in range(8):
            x[j::8] = np.frombuffer(block[j : j + whole], "<u8")
        symbol = padded[lo + 7 : hi + 7] != BEGIN[0]
        yield lo + DEPTH + np.flatnonzero(symbol), x[: hi - lo][symbol] >> np.uint64(8 * lead)


def _merged(parts: list[tuple]) -> tuple:
    """Sorted keys and summed counts of several such pairs."""
    import numpy as np

    key, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first, dtype=np.int64)


def _counted(x) -> tuple:
    """Sorted distinct keys of an array, which is sorted in place, and how often each occurs there."""
    import numpy as np

    x.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[first], np.diff(first, append=len(x)).astype(np.int32)


def _merged_ranges(parts: list[tuple], most: int = MERGED_AT_ONCE) -> Iterator[tuple]:
    """The same of sorted pairs, in ascending ranges of keys, so that beside the pairs only one range is held."""
    import numpy as np

    total = sum(len(k) for k, _ in parts)
    guide = np.sort(np.concatenate([k[:: max(1, most // (8 * len(parts)))] for k, _ in parts]))
    marks = np.unique(guide[:: max(1, len(guide) * most // max(1, total))])[1:]
    cuts = [np.concatenate(([0], np.searchsorted(k, marks), [len(k)])) for k, _ in parts]
    for r in range(len(marks) + 1):
        yield _merged([(k[c[r] : c[r + 1]], n[c[r] : c[r + 1]]) for (k, n), c in zip(parts, cuts, strict=True)])


def _counter(batches: Iterator) -> Iterator:
    """Counts of windows (kind 0) and of words (kind 1) of training texts; the texts themselves are kind 2."""
    import numpy as np
    import pyarrow as pa

    from .shingles import words

    held: dict[int, list[tuple]] = {0: [], 1: [], 2: []}

    def out(kind: int):
        parts, held[kind] = held[kind], []
        for key, n in _merged_ranges(parts) if parts else ():
            for lo in range(0, len(key), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), kind, np.int8)), pa.array(key[part].view(np.int64)), pa.array(n[part])], names=["kind", "key", "n"])

    for _, texts in _gathered(batches, ()):
        raw, _ = _framed(texts)
        for _, x in _windows(raw):
            held[0].append(_counted(x))
        h, _ = words(np.frombuffer(raw, np.uint8))
        held[1].append(_counted(h))
        held[2].append((np.zeros(1, np.uint64), np.array([len(texts)])))
        for kind in (0, 1):
            if sum(len(k) for k, _ in held[kind]) > HELD_KEYS:
                yield from out(kind)
    for kind in held:
        yield from out(kind)


@dataclass
class Tree:
    """By length of context: sorted keys of states and the log of what they leave to the shorter context; sorted keys
    of listed symbols and their log probability. ``blank`` is that of a symbol that training does not know."""

    states: list
    rest: list
    listed: list
    logs: list
    blank: float

    def descended(self, x, least: int):
        """Natural logs as far as states of ``least`` symbols and more give them (sorted windows are faster), and the places
        of windows whose symbol none of these lists."""
        import numpy as np

        past = np.uint64((1 << (8 * DEPTH)) - 1)
        out, open_ = np.zeros(len(x)), np.arange(len(x))
        y = x
        for k in range(DEPTH, least - 1, -1):
            shift = np.uint64(8 * (DEPTH - k))
            found, j = _find(self.listed[k], y >> shift)
            out[open_[found]] += self.logs[k][j[found]]
            open_, y = open_[~found], y[~found]
            if k:
                state, j = _find(self.states[k], (y & past) >> shift)
                out[open_[state]] += self.rest[k][j[state]]
        return out, open_

    def log_probability(self, x):
        """Natural logs for windows (sorted ones are faster)."""
        out, open_ = self.descended(x, 0)
        out[open_] += self.blank
        return out

    def lengthened(self, levels: dict[int, list]) -> "Tree":
        """The tree with these (states, rest, listed, logs) for some lengths of context in place of its own."""
        own = [list(x) for x in (self.states, self.rest, self.listed, self.logs)]
        for k, level in levels.items():
            for x, new in zip(own, level, strict=True):
                x[k] = new
        return Tree(*own, self.blank)

    def probability_sums(self, contexts):
        """The sum of all symbols' probabilities after each context (windows whose highest byte is 0); for tests."""
        import numpy as np

        top = np.uint64(8 * DEPTH)
        return sum(np.exp(self.log_probability(contexts | (np.uint64(s) << top))) for s in range(256)) + np.exp(self.log_probability(contexts | (np.uint64(256) << top)))


def _find(keys, wanted):
    import numpy as np

    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    j = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[j] == wanted, j


def _rolled(key, c, longest: int, shortest: int, symbols: int) -> Iterator[tuple]:
    """From sorted distinct (symbol, context) of ``longest`` symbols and their counts: by length of context, ascending, the
    entries (context, symbol, count, the context's count and kinds of symbols) of contexts that occur often enough."""
    import numpy as np

    least, entry = max(LEAST_COUNT, LEAST_SHARE * symbols), max(1.0, LEAST_SHARE * symbols / LISTED)
    levels = []
    for k in range(longest, shortest - 1, -1):
        if k < longest:  # keys are sorted by symbol and latest past, so shorter ones are too
            key = key >> np.uint64(8)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
            key, c = key[first], np.add.reduceat(c, first) if len(first) else c
        context, s = key & np.uint64((1 << (8 * k)) - 1), key >> np.uint64(8 * k)
        each, own, kinds = np.unique(context, return_inverse=True, return_counts=True)
        n = np.bincount(own, c, len(each))
        keep = (n[own] >= least) & (c >= entry) if k else np.ones(len(key), bool)
        levels.append((k, context[keep], s[keep], c[keep].astype(float), n[own][keep], kinds[own][keep].astype(float)))
    yield from reversed(levels)


def _grow(tree: Tree, k: int, context, symbol, count, total, kinds_of):
    """Adds the states of k symbols, smoothed by the shorter ones that the tree has; which of them pass the test."""
    import numpy as np

    own, first, o = np.unique(context, return_index=True, return_inverse=True)
    n, kinds = total[first], kinds_of[first]
    x = (symbol << np.uint64(8 * DEPTH)) | (context << np.uint64(8 * (DEPTH - k)))
    shorter = np.exp(tree.log_probability(x))  # the tree has no states of k symbols yet
    p = np.maximum(count - DISCOUNT, 0) / n[o] + DISCOUNT * kinds[o] / n[o] * shorter
    left = np.maximum(1 - np.bincount(o, p, len(own)), 1e-12)
    theirs = np.maximum(1 - np.bincount(o, shorter, len(own)), 1e-12)
    gain = n * (np.bincount(o, p * np.log(p / shorter), len(own)) + left * np.log(left / theirs))
    key = x >> np.uint64(8 * (DEPTH - k))
    order = np.argsort(key)
    tree.states[k], tree.rest[k] = own, np.log(left / theirs)
    tree.listed[k], tree.logs[k] = key[order], np.log(p[order])
    return gain >= GAIN


def _cleared(tree: Tree, passed: dict, longest: int, shortest: int) -> None:
    """Keeps the states that passed, and those that a longer state ends with."""
    import numpy as np

    for k in range(longest, shortest - 1, -1):
        keep = passed[k]
        tree.states[k], tree.rest[k] = tree.states[k][keep], tree.rest[k][keep]
        listed = _find(tree.states[k], tree.listed[k] & np.uint64((1 << (8 * k)) - 1))[0]
        tree.listed[k], tree.logs[k] = tree.listed[k][listed], tree.logs[k][listed]
        if k > shortest:
            passed[k - 1] |= np.isin(tree.states[k - 1], tree.states[k] >> np.uint64(8))


def short_tree(key, c, symbols: int) -> tuple[Tree, dict]:
    """Contexts of up to SHORT symbols from the sorted (symbol, context) of SHORT symbols, and which of them pass the test."""
    import numpy as np

    none = np.zeros(0, np.uint64)
    tree = Tree([none] * (DEPTH + 1), [np.zeros(0)] * (DEPTH + 1), [none] * (DEPTH + 1), [np.zeros(0)] * (DEPTH + 1), float(np.log(0.1 / (symbols + 0.1 * PLACES))))
    passed = {}
    for k, *entries in _rolled(key, c, SHORT, 0, symbols):
        if k:
            passed[k] = _grow(tree, k, *entries)
        else:  # in the order of the symbols
            tree.listed[0], tree.logs[0] = entries[1], np.log((entries[2] + 0.1) / (symbols + 0.1 * PLACES))
    return tree, passed


#: Rows of the tree's parts: states (what they leave), listed symbols (logs), frequent windows (logs so far) that are listed
#: and that are left to shorter contexts, and contexts of SHORT symbols that longer states end with.
STATES, LISTS, HOT, HOT_OPEN, ABOVE = range(5)
PARTS = "part int, kind int, depth int, keys binary, logs binary"
_TURN = 2654435761


def _part_of(x, parts: int):
    """The part of the tree that a window belongs to, by the last SHORT + 1 bytes of its past."""
    import numpy as np

    tail = (x >> np.uint64(8 * (DEPTH - SHORT - 1))) & np.uint64((1 << (8 * (SHORT + 1))) - 1)
    return ((((tail * np.uint64(_TURN)) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)


def _part_column(parts: int) -> Column:
    tail = F.shiftright("key", 8 * (DEPTH - SHORT - 1)).bitwiseAND(F.lit((1 << (8 * (SHORT + 1))) - 1).cast("long"))
    return (F.shiftright((tail * F.lit(_TURN).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 8) % parts).cast("int")


def long_parts(windows: DataFrame, short: Tree, symbols: int, parts: int) -> DataFrame:
    """PARTS of the tree for contexts of more than SHORT symbols, from (key, n), the distinct windows and their counts."""
    shared = windows.sparkSession.sparkContext.broadcast(short)
    frequent, lengths = HOT_WINDOWS * symbols, range(SHORT + 1, DEPTH + 1)

    def grow(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found = [(b.column(0).to_numpy().astype(np.int64).view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not found:
            return
        every, n = _merged(found)
        del found
        own = _part_of(every, parts)
        for part in np.unique(own):
            key, c = every[own == part], n[own == part]
            tree = shared.value.lengthened({})
            passed = {k: _grow(tree, k, *entries) for k, *entries in _rolled(key, c, DEPTH, SHORT + 1, symbols)}
            _cleared(tree, passed, DEPTH, SHORT + 1)
            hot = key[c >= frequent]
            so_far, open_ = tree.descended(hot, SHORT + 1)
            left = np.isin(np.arange(len(hot)), open_)
            above = np.unique(tree.states[SHORT + 1] >> np.uint64(8))
            rows = [(STATES, k, tree.states[k], tree.rest[k]) for k in lengths] + [(LISTS, k, tree.listed[k], tree.logs[k]) for k in lengths]
            for kind, k, keys, logs in [*rows, (HOT, 0, hot[~left], so_far[~left]), (HOT_OPEN, 0, hot[left], so_far[left]), (ABOVE, 0, above, np.zeros(0))]:
                for lo in range(0, len(keys), ROW_ENTRIES):
                    piece = slice(lo, lo + ROW_ENTRIES)
                    row = [[int(part)], [kind], [k], [keys[piece].tobytes()], [logs[piece].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in row[:3]] + [pa.array(x, pa.binary()) for x in row[3:]], names=[x.split()[0] for x in PARTS.split(", ")])

    return common.staged(windows.repartition(parts, _part_column(parts)).mapInArrow(grow, PARTS))


def _levels(rows: list[tuple]) -> dict[int, list]:
    """Of (kind, depth, keys, logs) of parts of the tree, what Tree.lengthened takes: sorted, by length of context."""
    import numpy as np

    out = {k: [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)] for k in range(SHORT + 1, DEPTH + 1)}
    for k, level in out.items():
        for kind, at in ((STATES, 0), (LISTS, 2)):
            mine = [r for r in rows if r[0] == kind and r[1] == k]
            if mine:
                keys, logs = np.frombuffer(b"".join(r[2] for r in mine), np.uint64), np.frombuffer(b"".join(r[3] for r in mine))
                order = np.argsort(keys)
                level[at], level[at + 1] = keys[order], logs[order]
    return out


@dataclass
class Model:
    """The tree's contexts of up to SHORT symbols and the parts with the longer ones (PARTS, in ``n_parts``), frequent windows
    and their log probabilities, the number of training tokens and of different ones, counts of frequent words (hash, count,
    sorted by hash), the count of ends, and which documents were left out."""

    short: Tree
    parts: DataFrame
    n_parts: int
    windows: tuple
    tokens: int
    kinds: int
    hot: tuple
    ends: int
    held: Column

    @cached_property
    def tree(self) -> Tree:
        """The whole tree at the driver, to look into trees of small corpora; scores() does not use it."""
        rows = self.parts.where(F.col("kind").isin(STATES, LISTS)).select("kind", "depth", "keys", "logs").collect()
        return self.short.lengthened(_levels([tuple(r) for r in rows]))


def fit(docs: DataFrame, held: Column | None = None) -> Model:
    import numpy as np

    held = held_out() if held is None else held
    training = _rows(docs, held).where(~F.col("held")).select("text")
    counts = common.staged(training.mapInArrow(_counter, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    sums = {r["kind"]: (r["n"], r["kinds"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    (symbols, windows), (tokens, kinds), ends = sums.get(0, (0, 0)), sums.get(1, (0, 0)), sums.get(2, (0, 0))[0]
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    frequent = counts.where((F.col("kind") == 1) & (F.col("n") >= HOT_SHARE * tokens)).select("key", "n").toArrow()
    h, c = frequent.column("key").to_numpy().astype(np.int64).view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(h)

    seen = counts.where("kind = 0").select("key", "n")
    brief = seen.groupBy(F.shiftright("key", 8 * (DEPTH - SHORT)).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    short, passed = short_tree(brief.column("key").to_numpy().astype(np.int64).view(np.uint64), brief.column("n").to_numpy(), symbols)
    n_parts = max(LEAST_BUCKETS, windows // PART_WINDOWS, symbols // PART_SYMBOLS)
    parts = long_parts(seen, short, symbols, n_parts)
    more = {HOT: [], HOT_OPEN: [], ABOVE: []}
    for r in parts.where(F.col("kind") >= HOT).select("kind", "keys", "logs").toArrow().to_batches():
        for kind, keys, logs in zip(*(x.to_pylist() for x in r.columns), strict=True):
            more[kind].append((np.frombuffer(keys, np.uint64), np.frombuffer(logs)))
    above, listed, left = ([np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint64, float), zip(*more[kind], strict=True), strict=False)] or [np.zeros(0, np.uint64), np.zeros(0)] for kind in (ABOVE, HOT, HOT_OPEN))
    passed[SHORT] |= np.isin(short.states[SHORT], above[0])
    _cleared(short, passed, SHORT, 1)
    x, log = np.concatenate((listed[0], left[0])), np.concatenate((listed[1], left[1] + short.log_probability(left[0])))
    at = np.argsort(x)
    return Model(short, parts, n_parts, (x[at], log[at]), tokens, kinds, (h[order], c[order]), ends, held)


BLOB = "bucket int, words binary, sizes binary, docs binary, times binary, keys binary, held binary, sums binary, known binary"


def base_sums(docs: DataFrame, model: Model) -> DataFrame:
    """(key, rows, known, base): summed over the rows of a key, the tokens that training knows and the base score's logs."""
    import numpy as np

    size = common.whole_texts(docs).agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, size // (4 * BUCKET_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(model.hot)  # at most 1 / HOT_SHARE words
    ends = model.ends
    names = [c.split()[0] for c in BLOB.split(", ")]

    def log(c):
        return np.log10(c + 0.1)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .shingles import words

        hot, hot_count = shared.value
        for others, texts in _gathered(batches, ("key", "held")):
            keys, held = np.array([o[0] for o in others], np.int64), np.array([o[1] for o in others], bool)
            raw, begins = _framed(texts)
            h, at = words(np.frombuffer(raw, np.uint8))
            own = np.searchsorted(begins, at, "right") - 1
            frequent, j = _find(hot, h)
            n = len(keys)
            sums = np.bincount(own[frequent], log(hot_count[j[frequent]]) if frequent.any() else None, n) + log(ends)
            known = np.bincount(own[frequent], minlength=n) + (ends > 0)
            rows = [(int(keys[0] % buckets), b"", b"", b"", b"", keys.tobytes(), b"", sums.astype(float).tobytes(), known.astype(np.int64).tobytes())]
            h, own = h[~frequent], own[~frequent]
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate((first, [len(h)]))).astype(np.uint32)
            h, own = h[first], own[first].astype(np.uint16)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, own, times, bucket = h[order], own[order], times[order], bucket[order]
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                word = np.concatenate(([True], h[lo + 1 : hi] != h[lo : hi - 1]))
                begin = np.flatnonzero(word)
                there, place = np.unique(own[lo:hi], return_inverse=True)
                sizes = np.diff(np.concatenate((begin, [hi - lo]))).astype(np.uint32)
                rows.append((int(bucket[lo]), h[lo:hi][begin].tobytes(), sizes.tobytes(), place.astype(np.uint16).tobytes(), times[lo:hi].tobytes(), keys[there].tobytes(), held[there].tobytes(), b"", b""))
            for lo in range(0, len(rows), 256):
                part = list(zip(*rows[lo : lo + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(c, pa.binary()) for c in part[1:])], names=names)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def settle(blobs: list[dict]) -> pa.RecordBatch:
            keys, base, known, rows = [], [], [], []
            hash_ = np.concatenate([np.frombuffer(b["words"], np.uint64) for b in blobs])
            _, word = np.unique(hash_, return_inverse=True)
            count, at = np.zeros(word.max() + 1 if len(word) else 0), 0
            held = []
            for b in blobs:
                sizes = np.frombuffer(b["sizes"], np.uint32)
                b["word"] = np.repeat(word[at : at + len(sizes)], sizes)
                at += len(sizes)
                b["at"], b["n"] = np.frombuffer(b["docs"], np.uint16), np.frombuffer(b["times"], np.uint32)
                learned = ~np.frombuffer(b["held"], bool)[b["at"]] if len(b["at"]) else np.zeros(0, bool)
                if len(learned):
                    count += np.bincount(b["word"][learned], b["n"][learned], len(count))
            for b in blobs:
                k = np.frombuffer(b["keys"], np.int64)
                if b["sums"]:
                    s, kn, r = np.frombuffer(b["sums"]), np.frombuffer(b["known"], np.int64), np.ones(len(k), np.int64)
                else:
                    c = count[b["word"]]
                    s, kn, r = np.bincount(b["at"], log(c) * b["n"], len(k)), np.bincount(b["at"], (c > 0) * b["n"], len(k)).astype(np.int64), np.zeros(len(k), np.int64)
                keys.append(k), base.append(s), known.append(kn), rows.append(r)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, rows, known, base)], names=["key", "rows", "known", "base"])

        now, blobs = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != now and blobs:
                    yield settle(blobs)
                    blobs = []
                now = row["bucket"]
                blobs.append(row)
        if blobs:
            yield settle(blobs)

    dealt = _rows(docs, model.held).mapInArrow(deal, BLOB).repartition(parts, "bucket").sortWithinPartitions("bucket")
    summed = dealt.mapInArrow(add, "key long, rows long, known long, base double")
    return summed.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.sum("base").alias("base"))


DEALT = "part int, kind int, depth int, keys binary, logs binary, sizes binary, docs binary, owners binary"
#: Rows of DEALT beside the tree's: windows with their documents, and documents with what is known of them.
WINDOWS, DOCUMENTS = 5, 6


def window_sums(docs: DataFrame, model: Model) -> DataFrame:
    """(key, tokens, score): summed over the rows of a key, the tokens and the natural logs of the tree's probabilities."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast((model.short, model.windows))  # bounded by SHORT and HOT_WINDOWS
    n_parts = model.n_parts
    names = [c.split()[0] for c in DEALT.split(", ")]

    def deal(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        hot, hot_log = shared.value[1]

        def batched(rows: list[tuple]) -> Iterator:
            for lo in range(0, len(rows), 64):
                columns = list(zip(*rows[lo : lo + 64], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), *(pa.array(c, pa.binary()) for c in columns[3:])], names=names)

        def sent(x, own, keys) -> Iterator[tuple]:
            """Rows of windows and the documents that hold them, a row a part of the tree."""
            part = _part_of(x, n_parts)
            order = np.lexsort((x, part))
            x, own, part = x[order], own[order], part[order]
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, int)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                begin = np.flatnonzero(np.concatenate(([True], x[lo + 1 : hi] != x[lo : hi - 1])))
                there = np.zeros(len(keys), bool)
                there[own[lo:hi]] = True
                place = (np.cumsum(there) - 1)[own[lo:hi]]
                yield int(part[lo]), WINDOWS, 0, x[lo:hi][begin].tobytes(), b"", np.diff(begin, append=hi - lo).astype(np.uint32).tobytes(), place.astype(np.uint16).tobytes(), keys[there].tobytes()

        for others, texts in _gathered(batches, ("key",)):
            keys = np.array([o[0] for o in others], np.int64)
            raw, begins = _framed(texts)
            total = np.zeros(len(texts))
            tokens = np.array([t.count(b" ") + 2 if len(t) > 1 else 1 for t in texts], np.int64)
            for place, x in _windows(raw):
                if not len(x):
                    continue
                code, each = pd.factorize(x)
                order = np.argsort(each)
                found, j = _find(hot, each[order])
                log, known = np.zeros(len(each)), np.zeros(len(each), bool)
                log[order[found]], known[order] = hot_log[j[found]], found
                first, last = (int(np.searchsorted(begins, p, "right")) - 1 for p in (place[0], place[-1]))
                cuts = np.searchsorted(place, begins[first : last + 1])
                cuts[0] = 0  # a text may go on from the block before
                total[first : last + 1] += np.add.reduceat(log[code], cuts)
                rare = np.flatnonzero(~known[code])
                x, own = x[rare], (np.searchsorted(cuts, rare, "right") - 1).astype(np.uint16)
                del code, each, order, found, j, log, known, place, rare  # only the rare ones wait for what is sent
                yield from batched(list(sent(x, own, keys[first : last + 1])))
            yield from batched([(int(keys[0] % n_parts), DOCUMENTS, 0, b"", total.tobytes(), tokens.tobytes(), b"", keys.tobytes())])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        short, _ = shared.value
        now, grown, tree = None, [], None
        for b in batches:
            for k in range(b.num_rows):  # a row at a time: a batch may be large
                row = {name: b.column(at)[k].as_py() for at, name in enumerate(names)}
                if row["part"] != now:
                    now, grown, tree = row["part"], [], None
                if row["kind"] in (STATES, LISTS):  # a part's rows are in the order of their kinds
                    grown.append((row["kind"], row["depth"], row["keys"], row["logs"]))
                    continue
                keys = np.frombuffer(row["owners"], np.int64)
                if row["kind"] == DOCUMENTS:
                    tokens, score = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["logs"])
                else:
                    if tree is None:
                        tree, grown = short.lengthened(_levels(grown)), []
                    log = tree.log_probability(np.frombuffer(row["keys"], np.uint64))
                    times = np.repeat(log, np.frombuffer(row["sizes"], np.uint32))
                    tokens, score = np.zeros(len(keys), np.int64), np.bincount(np.frombuffer(row["docs"], np.uint16), times, len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, tokens, score)], names=["key", "tokens", "score"])

    dealt = _rows(docs, model.held).mapInArrow(deal, DEALT)
    grown = model.parts.where(F.col("kind").isin(STATES, LISTS)).select("*", *(F.lit(b"").alias(c) for c in names[5:]))
    summed = dealt.union(grown).repartition(n_parts, "part").sortWithinPartitions("part", "kind").mapInArrow(add, "key long, tokens long, score double")
    return summed.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.sum("score").alias("score"))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    import numpy as np

    both = _rows(docs, model.held).select("doc_id", "key", "held").join(base_sums(docs, model), "key").join(window_sums(docs, model), "key")
    both = both.withColumn("n_tokens", (F.col("tokens") / F.col("rows")).cast("long"))
    known = (F.col("known") / F.col("rows")).cast("long")
    base = F.col("base") / F.col("rows") - F.col("n_tokens") * float(np.log10(model.tokens + 0.1 * (model.kinds + 1)))
    score = F.col("score") / F.col("rows") / float(np.log(10))
    return both.select("doc_id", F.col("held").alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
