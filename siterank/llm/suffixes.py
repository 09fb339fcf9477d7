"""Exact removal of long repeated byte strings, decided by suffix arrays.

A byte goes when it lies in a string of ``length`` bytes that also starts anywhere
else in the collection.  Equal strings are brought together first: the smallest of the
hashed short grams inside a string is its anchor, which depends on its content alone,
so all places of a string have the same anchor value.  Around an anchor lies one
fragment, the strings the anchor is the smallest of.  Fragments of one anchor value
that differ are sorted by suffix, and a string whose suffix shares ``length`` bytes
with a neighbour in that order is repeated.

The suffix array is built in linear time by grouping: suffixes are grouped by their
first byte; groups are processed from the highest, and every suffix that is the
previous smaller one of a processed suffix moves to a new group just above its old
one.  In the end a group holds the suffixes with one longest Lyndon prefix, and one
pass from the lowest suffix emits each group in order.  No names are given anew and
nothing is sorted twice.  Many small collections are worked on in step, as arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.setjoin import FEW_ROWS, SLICE_BYTES, mixed, per_slice, powers
from siterank.llm.tables import utf8
from siterank.session import materialize, settings_of

#: Bytes of the grams among which an anchor is chosen.
GRAM = 64
#: Groups with more different fragments than this are split before they are sorted.
TOGETHER = 16
#: Strings per fragment of a group that was split.
NARROW = 8


# --- suffix arrays by grouping -------------------------------------------------


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of many ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class SuffixArrays:
    """Suffix arrays of many texts at once.

    ``symbols`` are the texts in a row, each ending in a symbol that is smaller than
    all its others and occurs once; ``bounds`` is where they begin and end.  ``order``
    holds the suffixes of each text between its bounds, smallest first.  Places are numbers
    of 32 bits, so there may be 2 ** 30 symbols at most.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        self.symbols, self.bounds = symbols, bounds
        self._group()
        self._emit()

    def _group(self) -> None:
        n, sizes = len(self.symbols), np.diff(self.bounds)
        base = np.repeat(self.bounds[:-1], sizes)
        order = np.lexsort((self.symbols, base))
        key_change = np.ones(n, bool)
        key_change[1:] = (self.symbols[order][1:] != self.symbols[order][:-1]) | (base[order][1:] != base[order][:-1])
        first = np.flatnonzero(key_change)
        count = np.diff(np.append(first, n))
        # A group is named by the first of its places in the final order.
        group = np.empty(n, np.int32)
        group[order] = np.repeat(first, count)
        size = np.zeros(n, np.int32)
        size[first] = count
        at_end = np.zeros(n, np.int32)
        at_end[first + count - 1] = first
        # Members as they came into a group; those that left it since have another group.
        members = np.empty(2 * n, np.int32)
        members[:n] = order
        listed = n
        list_at, list_size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        list_at[first], list_size[first] = first, count
        previous = np.arange(-1, n - 1)
        upto, low = self.bounds[1:].copy(), self.bounds[:-1]
        active = np.flatnonzero(sizes > 1)
        while len(active):
            start = at_end[upto[active] - 1]
            upto[active] = start
            lengths = list_size[start]
            inside = members[ranges(list_at[start], lengths)]
            own = np.repeat(start, lengths)
            floor = np.repeat(low[active], lengths)
            still = group[inside] == own
            inside, own, floor = inside[still], own[still], floor[still]
            # Previous smaller suffixes: what lies between is in this group or a higher one,
            # whose pointers skip all of it.
            pending = np.arange(len(inside))
            while len(pending):
                i = inside[pending]
                p = previous[i]
                pending = pending[(p >= floor[pending]) & (group[p] >= own[pending])]
                i = inside[pending]
                previous[i] = previous[previous[i]]
            found = previous[inside]
            found = np.sort(found[found >= floor])
            if len(found):
                new = np.ones(len(found), bool)
                new[1:] = found[1:] != found[:-1]
                at = np.flatnonzero(new)
                moved, times = found[at], np.diff(np.append(at, len(found)))
                old = group[moved]
                by = np.lexsort((times, old))
                moved, times, old = moved[by], times[by], old[by]
                m = len(moved)
                old_new = np.ones(m, bool)
                old_new[1:] = old[1:] != old[:-1]
                run_new = old_new.copy()
                run_new[1:] |= times[1:] != times[:-1]
                old_at, run_at = np.flatnonzero(old_new), np.flatnonzero(run_new)
                leaving = np.diff(np.append(old_at, m))
                names = old[old_at]
                left = size[names] - leaving
                # Moved suffixes take the upper places of their old group, more repeats higher.
                top = np.repeat(names + left - old_at, leaving)
                run_count = np.diff(np.append(run_at, m))
                run_name = (top + np.arange(m))[run_at]
                rest = left > 0
                size[names[rest]] = left[rest]
                at_end[(names + left - 1)[rest]] = names[rest]
                size[run_name] = run_count
                at_end[run_name + run_count - 1] = run_name
                members[listed : listed + m] = moved
                list_at[run_name], list_size[run_name] = listed + run_at, run_count
                listed += m
                group[moved] = np.repeat(run_name, run_count)
            active = active[upto[active] - 1 > low[active]]
        self.group, self.previous = group, previous

    def _emit(self) -> None:
        n, low, high = len(self.symbols), self.bounds[:-1], self.bounds[1:]
        order, filled = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        placed = np.zeros(n, bool)
        # The last symbol of a text is its smallest suffix.
        some = high > low
        order[low[some]] = high[some] - 1
        placed[high[some] - 1] = True
        sizes = high - low
        by_size = np.argsort(-sizes, kind="stable")
        live = np.searchsorted(-sizes[by_size], -np.arange(int(sizes.max(initial=0))), "left")
        for t, count in enumerate(live.tolist()):
            texts = low[by_size[:count]]
            j = order[texts + t] - 1
            while True:
                ok = j >= texts
                j, texts = j[ok], texts[ok]
                ok = ~placed[j]
                j, texts = j[ok], texts[ok]
                if not len(j):
                    break
                name = self.group[j]
                order[name + filled[name]] = j
                filled[name] += 1
                placed[j] = True
                j = self.previous[j]
        self.order = order

    def shared(self, most: int) -> np.ndarray:
        """For every suffix the symbols it shares with the next smaller suffix, up to ``most``.

        Along a text the shared length falls by one at most from place to place, so each
        text walks once, all texts in step.
        """
        n, low, high = len(self.symbols), self.bounds[:-1], self.bounds[1:]
        out = np.zeros(n, np.int32)
        before = np.full(n, -1, np.int32)
        inner = np.ones(n, bool)
        inner[low[high > low]] = False
        at = np.flatnonzero(inner)
        before[self.order[at]] = self.order[at - 1]
        place, end = low[high > low].copy(), high[high > low]
        length = np.zeros(len(place), np.int32)
        padded = np.append(self.symbols, -1)
        while len(place):
            other = before[place]
            same = (other >= 0) & (length < most)
            same &= padded[place + length] == padded[np.where(same, other + length, n)]
            length += same
            done = ~same
            out[place[done]] = length[done]
            length[done] = np.maximum(length[done] - 1, 0)
            place += done
            if done.any():
                ok = place < end
                if not ok.all():
                    place, end, length = place[ok], end[ok], length[ok]
        return out


def repeated_starts(groups: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For every fragment of every group the places whose ``length`` bytes stand elsewhere in the group."""
    symbols, bounds, where = [], [0], []
    for fragments in groups:
        k = len(fragments)
        for j, fragment in enumerate(fragments):
            # Separators differ and are smaller than all bytes, so nothing is shared across one.
            where.append(bounds[-1])
            symbols.append(np.frombuffer(fragment, np.uint8).astype(np.int32) + k)
            symbols.append(np.array([k - 1 - j], np.int32))
            bounds[-1] += len(fragment) + 1
        bounds.append(bounds[-1])
    bounds = np.array([0, *bounds[:-1]])
    arrays = SuffixArrays(np.concatenate(symbols), bounds)
    long = arrays.shared(length) >= length
    marked = long.copy()
    # The neighbour below shares as much.
    inverse = np.empty(len(long), np.int64)
    inverse[arrays.order] = np.arange(len(long))
    marked[arrays.order[inverse[np.flatnonzero(long)] - 1]] = True
    out, i = [], 0
    for fragments in groups:
        found = []
        for fragment in fragments:
            found.append(np.flatnonzero(marked[where[i] : where[i] + len(fragment)]))
            i += 1
        out.append(found)
    return out


def intervals(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive numbers."""
    if not len(places):
        return places, places
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])]


# --- anchors ---------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchor value, fragment hash, text, first and last string and place of every anchor.

    Texts must be below 16 MB in sum, so that a place fits beside a hash in 64 bits;
    a longer single text is walked in overlapping parts by the caller.
    """
    window = length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up)])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    packed = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    least, step = packed, 1
    while step * 2 <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    n = len(packed) - window + 1
    least = np.minimum(least[:n], least[window - step : window - step + n])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.arange(n)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    ok = start + length <= offsets[1:][text]
    start, place, text = start[ok], place[ok], text[ok]
    if not len(start):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    first, last = start[at], np.append(start[at[1:] - 1], start[-1])
    place, text = place[at], text[at]
    shape = (last - first).astype(np.uint64) * np.uint64(7919) + (place - first).astype(np.uint64)
    content = mixed((sums[last + length] - sums[first]) * down[first] + shape)
    return grams[place], content, text, first - offsets[text], last - offsets[text], place - offsets[text]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values))


ROWS = "_g long, _h long, _lo int, _hi int, _at int"


def text_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``_key, _size, _anchors`` of every row of ``(_key, text)``."""

    def parts(data: np.ndarray, offsets: np.ndarray):
        """The anchors of a slice; a text too long for one pass in overlapping parts."""
        if len(data) < 1 << 24:
            return anchors(data, offsets, length)
        found, step = [], (1 << 23)
        for start in range(0, len(data), step):
            part = data[start : start + step + length - 1]
            g, h, text, lo, hi, at = anchors(part, np.array([0, len(part)]), length)
            found.append((g, h, text, lo + start, hi + start, at + start))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in per_slice(whole, SLICE_BYTES):
                data, offsets = utf8(batch.column(1))
                g, h, text, lo, hi, at = parts(data, offsets)
                counts = np.bincount(text, minlength=batch.num_rows)
                small = [lists(x.astype(np.int32), counts) for x in (lo, hi, at)]
                columns = [batch.column(0), pa.array(np.diff(offsets)), lists(signed(g), counts), lists(signed(h), counts)]
                names = ["_key", "_size", "_g", "_h", "_lo", "_hi", "_at"]
                yield pa.RecordBatch.from_arrays([*columns, *small], names)

    schema = "_key binary, _size long, _g array<long>, _h array<long>, _lo array<int>, _hi array<int>, _at array<int>"
    return texts.select("_key", "text").mapInArrow(run, schema)


# --- groups ------------------------------------------------------------------------


def split(rows: DataFrame, reference: list[str]):
    """Spans that are repeated as they are, and the fragments whose group must be sorted.

    ``rows`` has ``_g, _h``, the number of places ``_n``, ``_id, _lo, _hi, _at`` and the
    columns of ``reference``.  Rows of one group and hash are one fragment: with two
    places all its strings are repeated.  Of a group of different fragments one row
    each is handed on, unless all of them are known to be repeated.
    """
    one = F.min(F.struct("_id", "_lo", "_hi", "_at", *reference))
    kinds = materialize(rows.groupBy("_g", "_h").agg(F.sum("_n").alias("_n"), one.alias("_one")))
    twice = kinds.filter("_n > 1").select("_g", "_h")
    whole = rows.filter("_n = 1").join(twice, ["_g", "_h"]).select("_id", "_lo", "_hi")
    groups = kinds.groupBy("_g").agg(F.count(F.lit(1)).alias("_m"), F.min("_n").alias("_least"))
    groups = groups.filter("_m > 1 and _least = 1").select("_g", "_m")
    need = kinds.join(groups, "_g").select("_g", "_h", "_n", "_m", "_one.*")
    return whole, need


def sorted_groups(fragments: DataFrame, length: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """Spans of repeated strings of the fragments with one place, group by group."""

    def solve(held: list[list[tuple]]) -> pa.RecordBatch:
        held.sort(key=lambda rows: sum(len(r[2]) for r in rows))
        ids, los, his = [], [], []
        for rows, found in zip(held, repeated_starts([[r[2] for r in rows] for rows in held], length)):
            for (n, (text, lo), _), places in zip(rows, found):
                if n == 1:
                    first, last = intervals(places)
                    ids += [text] * len(first)
                    los += (first + lo).tolist()
                    his += (last + lo).tolist()
        columns = [pa.array(ids, pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["_id", "_lo", "_hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        group, size = None, 0
        for batch in batches:
            for g, n, text, lo, data in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if g != group:
                    if size >= batch_bytes:
                        yield solve(held)
                        held, size = [], 0
                    held.append([])
                    group = g
                held[-1].append((n, (text, lo), data))
                size += len(data)
        if held:
            yield solve(held)

    ordered = fragments.select("_g", "_n", "_id", "_lo", "_bytes").repartition("_g").sortWithinPartitions("_g")
    return ordered.mapInArrow(run, "_id long, _lo int, _hi int")


def narrower(fragments: DataFrame, length: int, width: int) -> DataFrame:
    """Cut fragments into those of ``width`` neighbouring strings, grouped by what these have in common.

    Strings at the same distance from their anchor fall in the same cut, so equal
    strings stay in one group; only strings that share all but ``width`` bytes do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for g, h, n, text, lo, hi, at, data in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                raw = np.frombuffer(data, np.uint8)
                up, down = powers(len(raw) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[:-1])])
                # Strings that begin cut * width to cut * width + width - 1 before the anchor.
                cut = np.arange((at - hi) // width, (at - lo) // width + 1)
                near = at - cut * width
                a, b = np.maximum(lo, near - width + 1), np.minimum(hi, near)
                # What all strings of a cut have in common, also where the fragment ends within it.
                i, j = near - lo, near - width + 1 + length - lo
                common = (sums[j] - sums[i]) * down[i]
                content = (sums[b - lo + length] - sums[a - lo]) * down[a - lo]
                salt = np.uint64(g & (1 << 64) - 1) ^ (cut.astype(np.uint64) * np.uint64(0x9E3779B1))
                shape = (b - a).astype(np.uint64) * np.uint64(width) + (at - a).astype(np.uint64)
                keys, values = signed(mixed(common + salt)).tolist(), signed(mixed(content + shape)).tolist()
                out += [(k, v, n, text, x, y, at, g, h) for k, v, x, y in zip(keys, values, a.tolist(), b.tolist())]
            columns = list(zip(*out)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["_g", "_h", "_n", "_id", "_lo", "_hi", "_at", "_fg", "_fh"]
    schema = "_g long, _h long, _n long, _id long, _lo int, _hi int, _at int, _fg long, _fh long"
    return fragments.select("_g", "_h", "_n", "_id", "_lo", "_hi", "_at", "_bytes").mapInArrow(run, schema)


def repeated_spans(texts: DataFrame, length: int):
    """``(ids, spans, candidates)``: texts with their number, spans of repeated strings, texts that have any.

    ``texts`` is ``(_key, text)`` with copies.  ``ids`` is ``_key, _id, _size, _copies``,
    ``spans`` ``_id, _lo, _hi`` (first places of repeated strings, inclusive) and
    ``candidates`` ``_id, text``.
    """
    arrays = ["_g", "_h", "_lo", "_hi", "_at"]
    found = text_anchors(texts, length).groupBy("_key")
    found = found.agg(F.first(F.struct("_size", *arrays)).alias("_x"), F.count(F.lit(1)).alias("_copies"))
    found = materialize(found.select("_key", F.monotonically_increasing_id().alias("_id"), "_copies", "_x.*"))
    ids = found.select("_key", "_id", "_size", "_copies")
    rows = found.select("_id", F.explode(F.arrays_zip(*arrays)).alias("_x")).select("_id", F.lit(1).cast("long").alias("_n"), "_x.*")
    whole, need = split(rows, [])
    need = materialize(need)
    whole = materialize(whole)
    wanted = need.groupBy("_id").agg(F.collect_list(F.struct("_g", "_h", "_n", "_m", "_lo", "_hi", "_at")).alias("_need"))
    having = whole.select("_id").distinct().join(wanted, "_id", "full_outer")
    having = having.join(ids.select("_id", "_key"), "_id")
    once = texts.select("_key", "text").join(having.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.first("text").alias("text"))
    candidates = materialize(once.join(having, "_key").select("_id", F.col("text").cast("binary").alias("_text"), "_need"))
    fragments = candidates.select("_id", "_text", F.explode("_need").alias("_x")).select("_id", "_text", "_x.*")
    cut = F.substring(F.col("_text"), F.col("_lo") + 1, F.col("_hi") - F.col("_lo") + length)
    fragments = materialize(fragments.select("_g", "_h", "_n", "_m", "_id", "_lo", "_hi", "_at", cut.alias("_bytes")))
    spans = [whole, sorted_groups(fragments.filter(F.col("_m") <= TOGETHER), length)]
    # Large groups: fragments of a few strings each, then strings one by one.
    for width in (NARROW, 1):
        large = fragments.filter(F.col("_m") > TOGETHER)
        if large.isEmpty():
            break
        rows = materialize(narrower(large, length, width))
        whole, need = split(rows, ["_fg", "_fh"])
        spans.append(whole)
        if width == 1:
            break
        inner = large.select(F.col("_g").alias("_fg"), F.col("_h").alias("_fh"), F.col("_lo").alias("_from"), "_bytes")
        cut = F.substring(F.col("_bytes"), F.col("_lo") - F.col("_from") + 1, F.col("_hi") - F.col("_lo") + length)
        fragments = need.join(inner, ["_fg", "_fh"])
        fragments = materialize(fragments.select("_g", "_h", "_n", "_m", "_id", "_lo", "_hi", "_at", cut.alias("_bytes")))
        spans.append(sorted_groups(fragments.filter(F.col("_m") <= TOGETHER), length))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return ids, every, candidates.select("_id", "_text")


def removed_runs(los: np.ndarray, his: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that begin in these spans."""
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(los, his)):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi + length))
        else:
            runs.append((lo, hi + length))
    return runs


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def deduplicate(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """Add ``n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``) to every document.

    Texts are UTF-8 bytes, null and empty ones have none.  Strings are judged on the
    input, overlaps count, matches never cross texts; a text that stands in two rows
    repeats itself, so all its bytes go if it has ``length`` or more.  ``kept_text`` is
    what is left with incomplete characters at the cuts dropped.  Rows repeat as they
    came, columns of the added names are replaced, all others stay.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    docs = docs.drop(*[c for c in added if c in docs.columns])
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumn("_key", F.unhex(F.md5(content)))
    with settings_of(docs.sparkSession, FEW_ROWS):
        ids, spans, candidates = repeated_spans(keyed.filter("text is not null"), length)
    spans = spans.groupBy("_id").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, data, found in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                runs = removed_runs([s["_lo"] for s in found], [s["_hi"] for s in found], length)
                left = kept_bytes(data, runs)
                kept = left.decode("utf-8", "ignore") if with_text else None
                out.append((text, sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), kept))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["_id", "_removed", "_runs", "_sha", "_left"]
    changed = candidates.join(spans, "_id").select("_id", "_text", "_spans")
    changed = changed.mapInArrow(cut, "_id long, _removed long, _runs long, _sha string, _left string")
    copied = (F.col("_copies") > 1) & (F.col("_size") >= length)
    results = ids.join(changed, "_id", "left").filter(copied | F.col("_removed").isNotNull())
    empty = hashlib.sha256(b"").hexdigest()
    results = results.select(
        "_key",
        F.when(copied, F.col("_size")).otherwise(F.col("_removed")).alias("_removed"),
        F.when(copied, F.lit(1)).otherwise(F.col("_runs")).cast("long").alias("_runs"),
        F.when(copied, F.lit(empty)).otherwise(F.col("_sha")).alias("_sha"),
        F.when(copied, F.lit("")).otherwise(F.col("_left")).alias("_left"),
    )
    with settings_of(docs.sparkSession, FEW_ROWS):
        results = materialize(results)
    sized = keyed.withColumns({"n_bytes": F.octet_length(content).cast("long"), "_own": F.sha2(content, 256)})
    joined = sized.join(results, "_key", "left").withColumns(
        {
            "n_removed": F.coalesce("_removed", F.lit(0)).cast("long"),
            "n_spans": F.coalesce("_runs", F.lit(0)).cast("long"),
            "kept_sha256": F.coalesce("_sha", "_own"),
        }
    )
    if with_text:
        joined = joined.withColumn("kept_text", F.coalesce("_left", "text"))
    return joined.drop("_key", "_own", "_removed", "_runs", "_sha", "_left")
