"""Substring dedup by relative Lempel-Ziv parsing: words covered by a window of ``window`` words that also starts elsewhere are removed.

The reference is the corpus itself, in blocks of texts (by a hash of the row),
indexed by the hashes of its phrases; each text is factored against every block
that holds a phrase of its own.

1. Phrases. Every window has an anchor, its least ``gram``-word hash; the
   windows that share an anchor form a phrase (28 windows at most). Equal
   windows have equal anchors, so a window that occurs elsewhere does so in a
   phrase with the same anchor. Tasks send (anchor, phrase, place) to the share
   of the index that the anchor is in, a packed row for each share; an anchor
   that a task has met more than once is settled there and sent once, so a
   frequent passage costs its share one entry a task.
2. The index answers: phrase occurs elsewhere and no other has its anchor; it
   occurs elsewhere, and others have its anchor; or only its anchor does. With
   the first two goes a place where it occurs: the first occurrence, or for
   that one itself the second.
3. Where only the anchor occurs elsewhere, a factor begins or ends inside the
   phrase: at these boundaries the windows themselves are looked up, among
   them those of the factors with such an anchor.
4. Each text is parsed greedily from its start: a factor takes the place of its
   first window in the reference and runs on while the following windows occur
   at the following words of that text; another source begins the next factor
   at the word where it ends, and a word in no such window is a literal. Every
   window that touches a factor's boundary has been looked up, so short factors
   that go on from another are kept, and nothing is removed for which no whole
   window occurs elsewhere. A factor is (start, end, block, source, position):
   its words are those of row ``source`` from word ``position`` on, so factors
   and literals give the text back.

Windows are judged on the input. Hashes have 64 bits; nothing is capped.

Defined results: null text has no words and keeps the empty text. Texts of any
length work. Rows are told apart by nothing but their place: rows repeated with
the same key and text count as occurrences of each other. Keys play no part in
the result, so null keys do no harm; extra columns play none. An empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut
from .hashing import chunks, grams, least_places, mix, spans, trim, words
from .ship import ship

#: Entries that a task packs at once, and entries in a block, about.
PACK, BLOCK = 1_000_000, 3_000_000
#: Row keys up to which their list is broadcast (8 bytes each) to choose texts; beyond, they are joined by shuffling.
BROADCAST_KEYS = 500_000
#: What a block answers.
ALONE, SHARED, EDGE = 1, 2, 3

ship(__name__)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(a)))


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """The range of hashes, of n equal ones, that each is in."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


#: Of an entry that asks: row, anchor and phrase (or twice the window), 0, its place. Of an answer: row, phrase or window, the source's row, code, and place.
_PACKED = [("part", pa.int64()), *[(x, pa.binary()) for x in ("rows", "a", "b", "codes", "places")]]
PACKED = "part long, rows binary, a binary, b binary, codes binary, places binary"
_KINDS = (np.uint64, np.uint64, np.uint64, np.uint8, np.uint32)


def _packed(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part; columns as in PACKED."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    starts, lengths = _runs(part)
    data = [pa.array(part[starts], pa.int64())]
    data += [pa.array([c[s : s + n].tobytes() for s, n in zip(starts, lengths)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(data, [x for x, _ in _PACKED])


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(x).to_pylist()), t) for (x, _), t in zip(_PACKED[1:], _KINDS)]


def _sources(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of entries in runs of equal ones, the entry that is each one's source: the first of its run, or of that the second."""
    out = np.repeat(starts, lengths)
    out[starts[lengths > 1]] += 1
    return out


def _phrases(h: np.ndarray, a: int, b: int, window: int, gram: int, all_grams: np.ndarray):
    """Of the words a to before b: each phrase's first and last-plus-one window, anchor and hash."""
    anchors = least_places(all_grams[a : b - gram + 1], window - gram + 1)
    starts, lengths = _runs(anchors)
    ends = starts + lengths
    anchor = all_grams[a + anchors[starts]]
    phrase = mix(spans(h[a:b], starts, ends + window - 1) ^ anchor)
    return starts, ends, mix(anchor + np.uint64(1)), phrase


def _texts(texts, window: int, gram: int):
    """Yields (row, hashes of the text's words, its phrases or None)."""
    for at, data, bounds in chunks(texts):
        h, firsts, _, _ = words(data, bounds, False)
        all_grams = grams(h, gram)
        for i in range(len(bounds) - 1):
            a, b = int(firsts[i]), int(firsts[i + 1])
            yield at + i, h[a:b], _phrases(h, a, b, window, gram, all_grams) if b - a >= window else None


# part: a share of the index, or ``blocks`` + the block of the row for an answer. An entry of code > 0 is sent for its task and doesn't ask.
MANY, MIXED = 1, 2


def _ask_phrases(window: int, gram: int, blocks: int):
    def flush(rows, anchors, phrases, places):
        row, anchor, phrase = np.repeat(np.array(rows, np.uint64), [len(x) for x in anchors]), np.concatenate(anchors), np.concatenate(phrases)
        place = np.concatenate(places).astype(np.uint32)
        order = np.lexsort((phrase, anchor))
        row, anchor, phrase, place = row[order], anchor[order], phrase[order], place[order]
        starts, lengths = _runs(anchor)
        single = np.repeat(lengths == 1, lengths)
        same = np.logical_and.reduceat(phrase == np.repeat(phrase[starts], lengths), starts)
        many = lengths > 1
        first, zero = starts[many], np.zeros(int(single.sum()), np.uint8)
        yield _packed(
            np.concatenate([_range(anchor[single], blocks), _range(anchor[first], blocks)]),
            *[np.concatenate([x[single], x[first]]) for x in (row, anchor, phrase)],
            np.concatenate([zero, np.where(same[many], MANY, MIXED).astype(np.uint8)]),
            np.concatenate([place[single], place[first]]),
        )
        if not single.all():
            row, phrase, place = row[~single], phrase[~single], place[~single]
            # Equal phrases have equal anchors, so they are neighbours.
            starts, lengths = _runs(phrase)
            source = _sources(starts, lengths)
            yield _packed(blocks + _range(mix(row), blocks), row, phrase, row[source], np.where(np.repeat(lengths, lengths) > 1, SHARED, EDGE).astype(np.uint8), place[source])

    def run(batches):
        rows, anchors, phrases, places, held = [], [], [], [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for row, _, found in _texts(batch.column(1), window, gram):
                if found:
                    rows.append(keys[row])
                    anchors.append(found[2])
                    phrases.append(found[3])
                    places.append(found[0])
                    held += len(found[2])
                    if held >= PACK:
                        yield from flush(rows, anchors, phrases, places)
                        rows, anchors, phrases, places, held = [], [], [], [], 0
                        trim()
        if held:
            yield from flush(rows, anchors, phrases, places)
        rows = anchors = phrases = places = None
        trim()

    return run


def _answer_phrases(blocks: int):
    def run(table: pa.Table) -> pa.Table:
        trim()
        row, anchor, phrase, code, place = _unpacked(table)
        part = table.column("part")[0].as_py()
        if part >= blocks:
            return pa.Table.from_batches([_packed(np.full(len(row), part - blocks), row, anchor, phrase, code, place)])
        order = np.lexsort((place, row, phrase, anchor))
        row, anchor, phrase, code, place = row[order], anchor[order], phrase[order], code[order], place[order]
        starts, lengths = _runs(anchor)
        if not len(starts):
            return table.slice(0, 0)
        weight = np.where(code > 0, 2, 1)
        often = np.repeat(np.add.reduceat(weight, starts) > 1, lengths)
        own_starts = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (phrase[1:] != phrase[:-1]))))
        own_lengths = np.diff(np.append(own_starts, len(anchor)))
        copies = np.repeat(np.add.reduceat(np.where(code == MIXED, 1, weight), own_starts), own_lengths)
        other = np.logical_or.reduceat((code == MIXED) | (phrase != np.repeat(phrase[starts], lengths)), starts)
        reply = np.where(copies > 1, np.where(np.repeat(other, lengths), SHARED, ALONE), EDGE).astype(np.uint8)
        source = _sources(own_starts, own_lengths)
        asks = (code == 0) & often
        source = source[asks]
        return pa.Table.from_batches([_packed(_range(mix(row[asks]), blocks), row[asks], phrase[asks], row[source], reply[asks], place[source])])

    return run


def _by_row(table: pa.Table) -> pa.Table:
    """Of one block, the answers to each row: (row, keys, sources, codes, places, open), by key and source."""
    row, key, source, code, place = _unpacked(table)
    order = np.lexsort((place, source, key, row))
    row, key, source, code, place = row[order], key[order], source[order], code[order], place[order]
    starts, lengths = _runs(row)
    cut_ = list(zip(starts, lengths))
    packed = {n: pa.array([x[s : s + n_].tobytes() for s, n_ in cut_], pa.binary()) for n, x in (("keys", key), ("sources", source), ("codes", code), ("places", place))}
    return pa.table({
        "row": pa.array(row[starts].view(np.int64), pa.int64()), **packed,
        "open": pa.array([bool((code[s : s + n] != ALONE).any()) for s, n in cut_], pa.bool_()),
    })


BY_ROW = "row long, keys binary, sources binary, codes binary, places binary, open boolean"


class _Answers:
    """The answers to one row."""

    def __init__(self, keys: bytes | None, sources: bytes | None, codes: bytes | None, places: bytes | None):
        self.keys, self.sources, self.codes, self.places = (np.frombuffer(x or b"", t) for x, t in zip((keys, sources, codes, places), (np.uint64, np.uint64, np.uint8, np.uint32)))

    def codes_of(self, asked: np.ndarray) -> np.ndarray:
        """The code of each phrase or window, 0 if there was no answer."""
        if not len(self.keys):
            return np.zeros(len(asked), np.uint8)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.codes[at], 0)

    def sources_of(self, asked: np.ndarray, row: np.uint64, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the phrases or windows, all answered, occurs elsewhere. One that occurs in its own row more than once has several answers, of which the first or last isn't itself."""
        at = np.searchsorted(self.keys, asked)
        own = (self.sources[at] == row) & (self.places[at] == place)
        at[own] = np.searchsorted(self.keys, asked[own], "right") - 1
        return self.sources[at], self.places[at].astype(np.int64)


def _ask_windows(window: int, gram: int, blocks: int):
    def flush(rows, keys, asked, places):
        row, key, ask = np.repeat(np.array(rows, np.uint64), [len(x) for x in keys]), np.concatenate(keys), np.concatenate(asked)
        place = np.concatenate(places).astype(np.uint32)
        order = np.lexsort((ask, key))
        row, key, ask, place = row[order], key[order], ask[order], place[order]
        starts, lengths = _runs(key)
        known = (lengths > 1) | ~ask[starts]  # met twice here, or part of a factor
        known_each = np.repeat(known, lengths)
        single, first = ~known_each, starts[known]
        yield _packed(
            np.concatenate([_range(key[single], blocks), _range(key[first], blocks)]),
            *[np.concatenate([x[single], x[first]]) for x in (row, key, key)],
            np.concatenate([np.zeros(int(single.sum()), np.uint8), np.full(int(known.sum()), MANY, np.uint8)]),
            np.concatenate([place[single], place[first]]),
        )
        told = known_each & ask
        if told.any():
            source = _sources(starts, lengths)[told]
            yield _packed(blocks + _range(mix(row[told]), blocks), row[told], key[told], row[source], np.full(int(told.sum()), SHARED, np.uint8), place[source])

    def run(batches):
        rows, keys, asked, places, held = [], [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            known, codes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, h, found in _texts(batch.column(1), window, gram):
                if not found:
                    continue
                starts, ends, _, phrase = found
                code = _Answers(known[row], None, codes[row], None).codes_of(phrase)
                each = np.repeat(code, ends - starts)
                take = each >= SHARED
                if not take.any():
                    continue
                rows.append(ids[row])
                keys.append(grams(h, window)[take])
                asked.append(each[take] == EDGE)
                places.append(np.flatnonzero(take))
                held += len(keys[-1])
                if held >= PACK:
                    yield from flush(rows, keys, asked, places)
                    rows, keys, asked, places, held = [], [], [], [], 0
                    trim()
        if held:
            yield from flush(rows, keys, asked, places)
        rows = keys = asked = places = None
        trim()

    return run


def _answer_windows(blocks: int):
    def run(table: pa.Table) -> pa.Table:
        trim()
        row, key, source, code, place = _unpacked(table)
        part = table.column("part")[0].as_py()
        if part >= blocks:
            return pa.Table.from_batches([_packed(np.full(len(row), part - blocks), row, key, source, code, place)])
        order = np.lexsort((place, row, key))
        row, key, code, place = row[order], key[order], code[order], place[order]
        starts, lengths = _runs(key)
        if not len(starts):
            return table.slice(0, 0)
        often = np.repeat(np.add.reduceat(np.where(code > 0, 2, 1), starts) > 1, lengths) & (code == 0)
        source = _sources(starts, lengths)[often]
        return pa.Table.from_batches([_packed(_range(mix(row[often]), blocks), row[often], key[often], row[source], np.full(len(source), SHARED, np.uint8), place[source])])

    return run


def parse(hit: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (first word, last-plus-one word, source, first word there) of each factor. hit: which windows occur elsewhere; source, place: where."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    source, shift = source[at], place[at] - at
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    ends = at[last] + window
    # A factor begins where the one before it ends, if that is later than its first window.
    starts = np.maximum(at[first], np.append(0, ends[:-1]))
    return list(zip(starts.tolist(), ends.tolist(), source[first].tolist(), (starts + shift[first]).tolist()))


_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "block", "source", "position")]))
SPANS = "array<struct<start:long,end:long,block:long,source:long,position:long>>"


def _remove(window: int, gram: int, blocks: int):
    """(key, row, text, answers to phrases, answers to windows) -> (key, row, n_words, n_removed, kept, spans)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            phrases, windows = (list(zip(*(batch.column(i).to_pylist() for i in range(a, a + 4)))) for a in (3, 7))
            texts = batch.column(2)
            n_words, removed, kept, cuts = [], [], [], []
            plain = texts.to_pylist()
            for row, h, found in _texts(texts, window, gram):
                parts = (plain[row] or "").encode().split()
                factors = []
                if found and (phrases[row][0] or windows[row][0]):
                    starts, ends, _, phrase = found
                    answers, me = _Answers(*phrases[row]), ids[row]
                    code = answers.codes_of(phrase)
                    sizes, whole = ends - starts, (code == ALONE) | (code == SHARED)
                    hit, at = np.repeat(whole, sizes), np.arange(ends[-1])
                    source, place = np.zeros(len(hit), np.uint64), np.zeros(len(hit), np.int64)
                    where, first = answers.sources_of(phrase[whole], me, starts[whole])
                    source[hit], place[hit] = np.repeat(where, sizes[whole]), np.repeat(first - starts[whole], sizes[whole]) + at[hit]
                    if windows[row][0]:
                        ask = np.flatnonzero(np.repeat(code == EDGE, sizes))
                        mine, answers = grams(h, window)[ask], _Answers(*windows[row])
                        known = answers.codes_of(mine) > 0
                        ask, mine = ask[known], mine[known]
                        hit[ask] = True
                        source[ask], place[ask] = answers.sources_of(mine, me, ask)
                    factors = parse(hit, source, place, window)
                n_words.append(len(parts))
                removed.append(sum(f[1] - f[0] for f in factors))
                for f in reversed(factors):
                    del parts[f[0] : f[1]]
                kept.append(b" ".join(parts).decode())
                sources = np.array([f[2] for f in factors], np.uint64)
                cuts.append([
                    {"start": f[0], "end": f[1], "block": block, "source": source, "position": f[3]}
                    for f, block, source in zip(factors, _range(mix(sources), blocks).tolist(), sources.view(np.int64).tolist())
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(cuts, _SPANS)],
                ["key", "row", "n_words", "n_removed", "kept", "spans"],
            )
            trim()

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """One row per input row: key, row (its name as a source), n_words, n_removed, kept (the words that stay, joined by one space), spans (the factors, in words)."""
    texts = df.select(col(key).alias("key"), col(text).cast("string").alias("text"))
    texts = texts.select("key", F.xxhash64("key", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Six bytes a word, and a phrase for every 14 words or so.
    blocks = max(1, -(-total // (80 * BLOCK)) * 4)

    asked = texts.select("row", "text").mapInArrow(_ask_phrases(window, gram, blocks), PACKED)
    answers = asked.groupBy("part").applyInArrow(_answer_phrases(blocks), PACKED)
    phrases = cut(answers.groupBy("part").applyInArrow(_by_row, BY_ROW), "phrases")

    doubtful = phrases.filter("open").select("row", "keys", "codes")
    ids = doubtful.select("row")
    some = texts.select("row", "text")
    if ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        some = some.join(F.broadcast(ids), "row", "left_semi")
    asked = some.join(doubtful, "row").select("row", "text", "keys", "codes").mapInArrow(_ask_windows(window, gram, blocks), PACKED)
    answers = asked.groupBy("part").applyInArrow(_answer_windows(blocks), PACKED)
    found = ("keys", "sources", "codes", "places")
    windows = cut(answers.groupBy("part").applyInArrow(_by_row, BY_ROW).select("row", *[F.col(x).alias(f"w_{x}") for x in found]), "windows")

    rows = texts.join(phrases.select("row", *found), "row", "left").join(windows, "row", "left")
    kind = texts.schema["key"].dataType.simpleString()
    out = rows.select("key", "row", "text", *found, *[f"w_{x}" for x in found]).mapInArrow(
        _remove(window, gram, blocks), f"key {kind}, row long, n_words long, n_removed long, kept string, spans {SPANS}"
    )
    return out.select(F.col("key").alias(key), *[c for c in out.columns if c != "key"])
