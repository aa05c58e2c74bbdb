"""Byte-level BPE by DuckDB recursive queries, one database in each Python worker.

Encoding. A text's pre-tokens (matches of the pattern) are encoded one by one;
those that are tokens themselves are done. The bytes of the others become
token-position rows (word, place, token). A recursive query joins each row and
its neighbour with the merge table, contracts the leftmost pair of least rank
of every word that has a pair, and ends where no word has one.

A long word (LONG) contracts, in each round, every pair of least rank among
those near it, instead of one. With m the bytes of the longest token
that the word's classes of bytes permit, words are cut into cells of m bytes by their
first byte, and near are the pairs of the cell before, the own and the next
two. The result is the same: until such a pair's turn comes only pairs of lower
rank are contracted, all of which begin more than m bytes away; what they
change grows as one token that holds their place, and it would have to be longer
than m to reach the pair. Equal pairs that overlap (in a run, as in "aaaa") are
taken from its left, every other one, and a run that begins outside is left
for later. If the new token is part of one of lower rank, equal pairs aren't
taken together but from the left.

Decoding. Token-position rows join the vocabulary and are put together by an
ordered aggregation. In both directions only distinct words are looked at
twice: a bounded cache of encoded words is kept.

The merge table holds every split of a token into two tokens, so ranks alone
decide, as in the rank files' own library.

Memory. A recursive query keeps the rows of all its rounds, so the words of
one are bounded by the rows they can make (ROWS); long words stop after as
many rounds as ROWS permits and go on from there. Where DuckDB still reports
that its memory is used up, the share is halved; a single word of megabytes
without a break gets more memory, about 200 times its bytes.

Defined results: a null text is empty and has no tokens; bytes come back as
they were; texts, words and lists of ids of any length work. Ids that aren't in
the vocabulary raise an error in decoding. Keys, repeated rows and extra
columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, text_of
from .hashing import HELD, trim
from .ship import ship

#: Words in one recursive query, ids in one decoding query and record batch, characters that are encoded at once, words and characters in the cache.
WORDS, IDS, CHARS, CACHE, CACHE_CHARS = 15_000, 300_000, 6_000_000, 400_000, 12_000_000
#: Rows that all rounds of a query make, about, and rows of long words in one.
ROWS, LONG_ROWS = 2_000_000, 250_000
#: Bytes from which a word is long. Either query gives the same result for any word; this one has fewer rounds, of more work.
LONG = 48
#: DuckDB's memory.
MEGABYTES = 200

# The usual pattern, the same for ``re`` on texts without odd characters, and those: all beyond Latin, numbers that aren't
# digits, and separators on which the two libraries disagree.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_ODD = "[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]"

_ONE = """
    WITH RECURSIVE state(step, w, pos, id) AS (
        SELECT 0, w, pos, id FROM start
        UNION ALL (
            WITH near AS (
                SELECT step, w, pos, id, lead(id) OVER place AS next_id, lag(pos) OVER place AS before FROM state WINDOW place AS (PARTITION BY w ORDER BY pos)),
            pair AS (SELECT near.*, merges.rank FROM near LEFT JOIN merges ON merges.l = near.id AND merges.r = near.next_id),
            best AS (SELECT w, min(CAST(rank AS BIGINT) << 32 | pos) AS least FROM pair WHERE rank IS NOT NULL GROUP BY w)
            SELECT step + 1, pair.w, pair.pos, CASE WHEN pair.pos = best.least & 4294967295 THEN CAST(best.least >> 32 AS INTEGER) ELSE pair.id END
            FROM pair JOIN best ON pair.w = best.w
            WHERE pair.before IS DISTINCT FROM best.least & 4294967295))
"""
_NEAR = """
    WITH RECURSIVE state(step, w, pos, id) AS (
        SELECT 0, w, pos, id FROM start
        UNION ALL (
            WITH near AS (
                SELECT step, w, pos, id, pos // {reach} AS cell, lead(id) OVER place AS next_id, row_number() OVER place AS nth FROM state WHERE step < {steps} WINDOW place AS (PARTITION BY w ORDER BY pos)),
            pair AS MATERIALIZED (
                SELECT near.*, merges.rank, CAST(merges.rank AS BIGINT) << 32 | CASE WHEN merges.early THEN pos ELSE 0 END AS key FROM near LEFT JOIN merges ON merges.l = near.id AND merges.r = near.next_id),
            cells AS MATERIALIZED (SELECT w, cell, min(key) AS least FROM pair WHERE rank IS NOT NULL GROUP BY w, cell),
            around AS (SELECT w, cell, least, min(least) OVER (PARTITION BY w ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS lowest FROM cells),
            hit AS MATERIALIZED (
                SELECT pair.w, pair.nth, pair.rank, pair.nth - row_number() OVER (PARTITION BY pair.w ORDER BY pair.nth) AS run
                FROM pair JOIN around ON pair.w = around.w AND pair.cell = around.cell WHERE pair.key = around.least AND around.least = around.lowest),
            cut AS (
                SELECT hit.w, hit.run FROM hit JOIN pair ON pair.w = hit.w AND pair.nth = hit.nth - 1 AND pair.rank = hit.rank
                WHERE NOT EXISTS (SELECT 1 FROM hit before WHERE before.w = hit.w AND before.nth = hit.nth - 1)),
            taken AS MATERIALIZED (
                SELECT w, nth, rank FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY nth) AS odd FROM hit) h
                WHERE odd % 2 = 1 AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.w = h.w AND cut.run = h.run))
            SELECT step + 1, pair.w, pair.pos, coalesce(here.rank, pair.id)
            FROM pair LEFT JOIN taken here ON here.w = pair.w AND here.nth = pair.nth LEFT JOIN taken gone ON gone.w = pair.w AND gone.nth = pair.nth - 1
            WHERE gone.w IS NULL AND pair.w IN (SELECT w FROM cells)))
"""
_LAST = "SELECT w, pos, id, step FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step) ORDER BY w, pos"

ship(__name__)


def load(path: str) -> bytes:
    """A rank file's bytes: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return f.read()


class _Words(dict):
    """Numbers words as they are met; ``new`` are those that have no ids yet."""

    def __init__(self):
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.chars += len(word)
        return n


def _shares(items: np.ndarray, work: np.ndarray, most: int):
    """Runs of items of about ``most`` work and at most WORDS items, or one of more work."""
    ends, at = np.cumsum(work), 0
    while at < len(items):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield items[at : (to := min(to, at + WORDS))]
        at = to


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then those of the next."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _classes() -> np.ndarray:
    """Bytes by class: small and capital letters, digits, each mark, control characters, and eight groups each of bytes that begin and go on with a character."""
    out = np.zeros(256, np.uint64)
    for b in range(256):
        c = chr(b)
        if b < 128:
            n = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b < 32 or b == 127 else 4 + b % 36
        else:
            n = 40 + (b - 128) // 8 if b < 192 else 48 + (b - 192) // 4
        out[b] = 1 << n
    return out


_CLASSES = _classes()


def _classes_in(word: bytes) -> int:
    return int(np.bitwise_or.reduce(_CLASSES[np.frombuffer(word, np.uint8)]))


class Coder:
    """The vocabulary in a DuckDB database of this process."""

    def __init__(self, ranks: bytes, pattern: str):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        if pattern == _PATTERN:
            plain, odd, full = re.compile(_PLAIN).findall, re.compile(_ODD).search, self.find
            self.find = lambda text: full(text) if odd(text) else plain(text)
        self.rank = {base64.b64decode(t): int(r) for t, _, r in (line.partition(b" ") for line in ranks.splitlines() if line)}
        merges = [(a, b, r) for t, r in self.rank.items() for i in range(1, len(t)) if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None]
        l, r, rank = (np.array(x, np.int64) for x in zip(*merges)) if merges else [np.zeros(0, np.int64)] * 3  # noqa: E741
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.sizes = np.array([len(t) for t in self.rank], np.int64)
        self.classes = np.array([_classes_in(t) for t in self.rank], np.uint64)
        self.reaches: dict[int, int] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEGABYTES}MB", "temp_directory": ""})
        entries = pa.table([pa.array(x, pa.int32()) for x in (l, r, rank)], ["l", "r", "rank"])  # noqa: F841
        # Whether a merge's token is part of a token of lower rank.
        self.db.execute("CREATE TABLE merges AS SELECT *, rank IN (SELECT l FROM entries WHERE rank < l UNION SELECT r FROM entries WHERE rank < r) AS early FROM entries")
        # A byte b is written as the character 256 + b, whose low byte in UTF-16 is b again.
        entries = pa.table({"id": pa.array(self.rank.values(), pa.int32()), "chars": ["".join(chr(256 + b) for b in t) for t in self.rank]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM entries")
        self.forget()

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        counts, parts = np.ones(len(words), np.int64), []
        known = np.array([self.rank.get(w, -1) for w in words], np.int64)
        open_ = np.flatnonzero(known < 0)
        sizes = np.array([len(words[i]) for i in open_], np.int64)
        parts.append((np.flatnonzero(known >= 0), known[known >= 0].astype(np.int32)))
        for some, work, most, how in (
            # A word of n bytes makes fewer than n * n / 2 rows in all its rounds.
            (sizes <= LONG, sizes * (sizes + 1) // 2, ROWS, self._one), (sizes > LONG, sizes, LONG_ROWS, self._near),
        ):
            chosen, work = open_[some], work[some]
            if how == self._near:  # words of like reach together
                order = np.argsort([self._reach(words[i]) for i in chosen], kind="stable")
                chosen, work = chosen[order], work[order]
            for share in _shares(chosen, work, most):
                for share, ids, n in self._halving(how, share, words):
                    counts[share] = n
                    parts.append((share, ids))
        flat, starts = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
        for share, ids in parts:
            flat[_ranges(starts[share], counts[share])] = ids
        return flat, counts

    def _halving(self, how, share: np.ndarray, words: list[bytes]):
        """Yields (share, ids, how many each word has), of smaller shares where memory doesn't suffice."""
        from duckdb import OutOfMemoryException

        try:
            yield share, *how([words[i] for i in share])
        except OutOfMemoryException:
            if len(share) > 1:
                for half in np.array_split(share, 2):
                    yield from self._halving(how, half, words)
                return
            self.db.execute(f"SET memory_limit = '{2 * MEGABYTES + 200 * len(words[share[0]]) // 1_000_000}MB'")
            yield share, *how([words[share[0]]])
            self.db.execute(f"SET memory_limit = '{MEGABYTES}MB'")

    def _reach(self, word: bytes) -> int:
        """The longest token that the word's classes of bytes permit."""
        if (own := _classes_in(word)) not in self.reaches:
            self.reaches[own] = int(self.sizes[(self.classes & ~np.uint64(own)) == 0].max())
        return self.reaches[own]

    def _run(self, query: str, w: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """The rows (w, pos, id, step) of the last round of each word."""
        start = pa.table([pa.array(x, pa.int32()) for x in (w, pos, ids)], ["w", "pos", "id"])  # noqa: F841
        got = self.db.execute(query + _LAST).fetchnumpy()
        return [np.asarray(got[x], np.int32) for x in ("w", "pos", "id", "step")]

    def _rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token-position rows of the words' bytes."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(x) for x in words])
        pos = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.repeat(np.arange(len(words)), lengths), pos, self.byte[data]

    def _one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w, _, ids, _ = self._run(_ONE, *self._rows(words))
        return ids, np.bincount(w, minlength=len(words))

    def _near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        reach = max(map(self._reach, words))
        left, done = self._rows(words), []
        while len(left[0]):
            steps = max(1, ROWS // len(left[0]))
            *rows, step = self._run(_NEAR.format(steps=steps, reach=reach), *left)
            last = step < steps
            done.append([x[last] for x in rows])
            left = [x[~last] for x in rows]
        w, pos, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.lexsort((pos, w))], np.bincount(w, minlength=len(words))

    def encode(self, texts):
        """Yields (ids one after the other, how many each text has) for groups of texts, in order, of about IDS ids or one longer text. texts: an iterable of strings."""
        if len(self.words) > CACHE or self.words.chars > CACHE_CHARS:
            self.forget()
        places = []
        for text in texts:
            found = self.find(text)
            places.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        if self.words.new:
            new, self.words.new = self.words.new, []
            flat, counts = self.contract([p.encode() for p in new])
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
            self.starts = np.cumsum(self.counts) - self.counts
            del new, flat, counts
            trim()
        sizes = np.array([int(self.counts[p].sum()) for p in places], np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(places):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IDS, "right")))
            each = np.concatenate(places[at:to])
            yield self.flat[_ranges(self.starts[each], self.counts[each])], sizes[at:to]
            at = to

    def forget(self) -> None:
        """Empty the cache of words."""
        self.words = _Words()
        self.flat, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each of the lists of ids that offsets cut. Lists are cut into pieces of at most IDS ids; shares have about as many."""
        lengths = np.diff(offsets)
        pieces = np.maximum(1, -(-lengths // IDS))
        owner = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cuts = np.append(np.asarray(offsets)[:-1][owner] + nth * IDS, offsets[-1])
        out, at = [], 0
        while at + 1 < len(cuts):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + IDS, "right")) - 1)
            out += self._decode(ids[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
            at = to
        if len(out) == len(lengths):
            return out
        firsts = np.cumsum(pieces) - pieces
        return [b"".join(out[a : a + k]) for a, k in zip(firsts.tolist(), pieces.tolist())]

    def _decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        lengths = np.diff(offsets)
        n = len(lengths)
        doc = np.repeat(np.arange(n), lengths)
        tokens = pa.table([pa.array(x, pa.int32()) for x in (doc, np.arange(len(ids)), ids)], ["doc", "pos", "id"])  # noqa: F841
        got = self.db.execute(
            "SELECT doc, string_agg(chars, '' ORDER BY pos) AS chars, count(*) AS n FROM tokens JOIN vocabulary USING (id) GROUP BY doc"
        ).fetchnumpy()
        out = [b""] * n
        for d, chars, k in zip(got["doc"].tolist(), got["chars"], got["n"].tolist()):
            if k != lengths[d]:
                raise ValueError("an id is not in the vocabulary")
            out[d] = chars.encode("utf-16-le")[::2]
        if sum(x > 0 for x in lengths.tolist()) != len(got["doc"]):
            raise ValueError("an id is not in the vocabulary")
        return out


def _coder(ranks: bytes, pattern: str) -> Coder:
    """One for each vocabulary and process: workers are used again for later tasks."""
    held = sys.modules.setdefault(HELD, types.ModuleType(HELD)).__dict__.setdefault("coders", {})
    if (key := (hash(ranks), pattern)) not in held:
        held.clear()
        held[key] = Coder(ranks, pattern)
    return held[key]


def _encode(ranks, pattern: str, back: bool):
    """(key, text) -> (key, ids), and if ``back`` the bytes decoded from the ids."""

    def run(batches):
        trim()
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at, ends = 0, np.cumsum(pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, "right")))
                first = at
                for flat, counts in coder.encode(x.as_py() for x in texts.slice(at, to - at)):
                    cuts = np.append(0, np.cumsum(counts))
                    out = [keys.slice(first, len(counts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))]
                    if back:
                        out.append(pa.array(coder.decode(flat, cuts), pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, ["key", "ids", "decoded"][: len(out)])
                    first += len(counts)
                at = to
                out = flat = None
                trim()
        if len(coder.words) > CACHE or coder.words.chars > CACHE_CHARS:
            coder.forget()
        trim()

    return run


def _decode(ranks, pattern: str):
    def run(batches):
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            lists = batch.column(1)
            lengths = np.array([x or 0 for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            ends, at = np.cumsum(lengths), 0
            while at < len(lists):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + IDS, "right")))
                part = lists.slice(at, to - at)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                decoded = coder.decode(flat, np.append(0, np.cumsum(lengths[at:to])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), part, pa.array(decoded, pa.binary())], ["key", "ids", "decoded"])
                at = to

    return run


def encode(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ids. ranks: a rank file's bytes (see ``load``), which every worker gets."""
    rows = df.select(col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    vocabulary = df.sparkSession.sparkContext.broadcast(ranks)
    return rows.mapInArrow(_encode(vocabulary, pattern, False), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def round_trip(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode and decode in one worker: one row per input row, key, ids, decoded (the binary that the ids give)."""
    rows = df.select(col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    vocabulary = df.sparkSession.sparkContext.broadcast(ranks)
    return rows.mapInArrow(_encode(vocabulary, pattern, True), f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def decode(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per input row: key, ids, decoded (binary)."""
    rows = df.select(col(key).alias("key"), F.coalesce(col(ids), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    vocabulary = df.sparkSession.sparkContext.broadcast(ranks)
    return rows.mapInArrow(_decode(vocabulary, pattern), f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)
