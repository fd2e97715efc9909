"""Removal of repeated strings by hash-compared suffix sorting.

Every byte goes that a string of ``length`` bytes covers which also starts anywhere else in the corpus. Sorting every suffix of a corpus
is out of reach, and needless: each window of ``length`` bytes names one anchor, the place of the least hash among its
``gram``-byte strings (the leftmost of equals), so equal windows have equal anchors at equal places. Only anchors whose gram occurs
more than once go on, with the bytes of their own windows around them.

For each gram the suffixes at its anchors are sorted, rightwards and leftwards: a merge sort whose comparisons find the common
extension by binary search over prefix polynomial hashes. The neighbours in these orders bound how far an anchor's repeats reach, and
so which of its windows can repeat; these are matched by their hashes, and every match is verified byte by byte. A gram with many
anchors is dealt out in chunks; what a chunk cannot settle is settled by counting its windows' 128-bit BLAKE2 digests across chunks.

Texts are UTF-8 bytes, null counts as empty, and no string crosses documents. A text of at least ``length`` bytes that is there more
than once goes altogether. Texts are known by a 64-bit hash and their length. doc_ids may be null or tie; repeated rows count as
copies. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions, small_batches
from quillon.llm.linking import bitmap, maybe_in
from quillon.llm.near_dup import BASE, U, mix, powers

#: Bits of a place in a text: Spark's strings have less than 2 GiB.
POSITION_BITS = 31


def prefix_sums(data: np.ndarray, add: int = 1) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    return np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(add)) * up[: len(data)], dtype=U)])


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first window, last window) of each run of windows that share an anchor."""
    n = len(text) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none
    sums = prefix_sums(np.frombuffer(text, np.uint8))
    _, down = powers(len(text) + 1)
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1])
    w = length - gram + 1
    packed = (hashes >> U(POSITION_BITS) << U(POSITION_BITS)) | np.arange(len(hashes), dtype=U)
    padded = np.full(-(-len(packed) // w) * w, ~U(0))
    padded[: len(packed)] = packed
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & U((1 << POSITION_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return hashes[at[first]], at[first], first, last


class Suffixes:
    """Suffixes of a byte buffer, each from ``start`` up to ``end``, compared by hashed common extensions."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end, self.sums = data, start, end, prefix_sums(data)
        _, self.down = powers(len(data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes x and y: binary search for the longest extension of equal hash."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = (self.sums[a + mid] - self.sums[a]) * self.down[a] == (self.sums[b + mid] - self.sums[b]) * self.down[b]
            low, high = np.where(same, mid, low), np.where(same, high, np.minimum(high, mid - 1))
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(x, y)
        a, b = self.start[x] + n, self.start[y] + n
        x_over, y_over = a >= self.end[x], b >= self.end[y]
        p, q = self.data[np.where(x_over, 0, a)], self.data[np.where(y_over, 0, b)]
        return np.where(x_over, True if or_equal else ~y_over, ~y_over & (p < q))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (ascending group numbers): a bottom-up merge sort of all groups at once."""
        n = len(group)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([first, [n]]))
        of = np.repeat(np.arange(len(first)), size)
        begin, stop, order = first[of], (first + size)[of], np.arange(n)
        width = 1
        while width < size.max(initial=0):
            within = np.arange(n) - begin
            left = (within // width) % 2 == 0
            other = np.where(left, begin + (within // width + 1) * width, begin + (within // width - 1) * width)
            low, high = np.minimum(other, stop), np.minimum(other + width, stop)
            base = low.copy()
            active = np.flatnonzero(low < high)
            while len(active):
                mid = (low[active] + high[active]) // 2
                # from the left run count the lesser ones, from the right run also the equal ones
                up = np.where(left[active], self.less(order[mid], order[active], False), self.less(order[mid], order[active], True))
                low[active[up]] = mid[up] + 1
                high[active[~up]] = mid[~up]
                active = active[low[active] < high[active]]
            run = begin + within // (2 * width) * (2 * width)
            own = np.where(left, within % width, within % width)
            target = run + own + (low - base)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, width * 2
        return order

    def reach(self, group: np.ndarray) -> np.ndarray:
        """Per suffix the longest common beginning with another of its group: that with a neighbour in the sorted order."""
        order, out = self.sort(group), np.zeros(len(group), np.int64)
        x, y = order[:-1], order[1:]
        near = np.flatnonzero(group[x] == group[y])
        n = self.common(x[near], y[near])
        np.maximum.at(out, x[near], n)
        np.maximum.at(out, y[near], n)
        return out


def runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all whole numbers in the ranges [first, last]; empty ranges have last < first."""
    n = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(first)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]


def repeats(group: np.ndarray, open_: np.ndarray, key: np.ndarray, at: np.ndarray, first: np.ndarray, contexts: list[bytes], length: int) -> tuple[tuple, tuple]:
    """Repeated windows of the anchors, which come in ascending groups.

    ``contexts`` are the bytes of each anchor's windows, from the window at ``first`` on. Returns (anchor, begin, end) of stretches of
    repeated windows, and for open groups, of which other chunks hold a part, (digest in two numbers, anchor or -1, window) of each
    different window: -1 if it repeats here.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(sizes) - sizes
    anchor = base + (at - first)
    right = Suffixes(data, anchor, base + sizes).reach(group)
    n = len(data)
    left = Suffixes(data[::-1], n - anchor, n - base).reach(group)
    low = np.where(open_, 0, np.maximum(0, at - first - left))
    high = np.where(open_, sizes - length, np.minimum(sizes - length, at - first + right - length))
    owner, j = runs(low, high)
    sums = prefix_sums(data)
    down = powers(n + 1)[1]
    p = base[owner] + j
    h = mix((sums[p + length] - sums[p]) * down[p] + group[owner].astype(U) * BASE)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    x, y = order[same], order[same + 1]
    good = verified(data, base, owner, j, x, y, length)
    x, y = x[good], y[good]
    again = np.zeros(len(h), bool)
    again[x] = again[y] = True
    mine = np.flatnonzero(again)
    o, v = owner[mine], j[mine]
    cut = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1] + 1)])) if len(o) else np.zeros(0, np.int64)
    to = np.concatenate([cut[1:], [len(o)]])[: len(cut)] - 1
    found = (o[cut], first[o[cut]] + v[cut], first[o[cut]] + v[to] + length)
    lead = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])] if len(h) else order
    lead = lead[open_[owner[lead]]]
    # windows meet those of other chunks without their bytes, so by a digest that no two strings are known to share
    raw = data.tobytes()
    digests = b"".join([hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for k in p[lead].tolist()])
    whole = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return found, (whole[:, 0], whole[:, 1], np.where(again[lead], -1, owner[lead]), first[owner[lead]] + j[lead])


def verified(data: np.ndarray, base: np.ndarray, owner: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Which of the window pairs (x, y) are truly equal: bytes are compared once for each stretch that two anchors share."""
    if not len(x):
        return np.zeros(0, bool)
    a, b = base[owner[x]] + j[x], base[owner[y]] + j[y]
    order = np.lexsort((a, b - a, owner[y], owner[x]))
    a, b, ox, oy = a[order], b[order], owner[x][order], owner[y][order]
    new = np.concatenate([[True], (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1) | (ox[1:] != ox[:-1]) | (oy[1:] != oy[:-1])])
    begin = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    last = np.concatenate([begin[1:], [len(a)]]) - 1
    good = np.zeros(len(a), bool)
    for part in np.array_split(np.arange(len(begin)), max(1, len(begin) // 4000)):
        o, k = runs(a[begin[part]], a[last[part]] + length - 1)
        differs = np.bincount(o, data[k] != data[k + (b - a)[begin[part]][o]], minlength=len(part)) > 0
        wrong = set(part[differs].tolist())
        mine = np.flatnonzero((stretch >= part[0]) & (stretch <= part[-1])) if len(part) else part
        good[mine] = ~differs[stretch[mine] - part[0]] if len(part) else False
        for s in wrong:  # a hash collision somewhere in the stretch: each window by itself
            for i in range(begin[s], last[s] + 1):
                good[i] = bool((data[a[i] : a[i] + length] == data[b[i] : b[i] + length]).all())
    out = np.zeros(len(x), bool)
    out[order] = good
    return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 64, chunk: int = 2000) -> DataFrame:
    """(key, n, begin, end): stretches of the texts, known by hash and length, that repeated strings cover; they may overlap."""
    texts = docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length("text").alias("n"), "text").where(F.col("n") >= length)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # copies met in this task
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for key, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (key, n) in done:
                    continue
                done.add((key, n))
                h, at, first, last = anchors(text.as_py().encode("utf-8", "surrogatepass"), length, gram)
                out.append([h.view(np.int64), np.full(len(h), key), np.full(len(h), n, np.int32), at.astype(np.int32), first.astype(np.int32), last.astype(np.int32)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["gram", "key", "n", "at", "first", "last"])

    every = materialize(texts.select("key", "n", "text").mapInArrow(anchored, "gram long, key long, n int, at int, first int, last int"), "anchors")
    grams = every.groupBy("gram").agg(F.count("*").alias("c"), *[f(x).alias(f"{x}_{k}") for x in ("key", "at") for k, f in (("lo", F.min), ("hi", F.max))])
    grams = materialize(grams.where("key_lo <> key_hi or at_lo <> at_hi").select("gram", "c"), "repeated-grams")
    near = maybe_in(every, "gram", bitmap(grams, "gram")).join(grams, "gram").distinct()
    by_text = materialize(near.groupBy("key", "n").agg(F.collect_list(F.struct("gram", "c", "at", "first", "last")).alias("anchors")), "anchors-by-text")
    reps = texts.groupBy("key", "n").agg(F.min("doc_id").alias("rep"))
    wanted = by_text.join(reps, ["key", "n"])
    source = maybe_in(texts, "key", bitmap(by_text, "key"))
    joined = source.join(wanted, ["key", "n"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "n", "text", "anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "salt", "key", "n", "at", "first", "context"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for key, n, text, found in zip(*[c for c in batch.columns], strict=True):
                key, n, data = key.as_py(), n.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                rows = [(a["gram"], hash((key, a["at"])) % (-(-a["c"] // chunk)) if a["c"] > chunk else -1, key, n, a["at"], a["first"], data[a["first"] : a["last"] + length]) for a in found.as_py()]
                for k in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000], strict=True), kinds, strict=True)], names=names)

    contexts = joined.mapInArrow(cut, "gram long, salt int, key long, n int, at int, first int, context binary")
    dealt = contexts.repartition(partitions(docs.sparkSession), "gram", "salt").sortWithinPartitions("gram", "salt")

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"key": pa.int64(), "n": pa.int32(), "begin": pa.int32(), "end": pa.int32(), "h": pa.int64(), "h2": pa.int64()}

        def settled(t: pa.Table) -> pa.RecordBatch:
            gram_, salt, key, n, at, first = (t.column(k).to_numpy() for k in ("gram", "salt", "key", "n", "at", "first"))
            group = np.cumsum(np.concatenate([[False], (gram_[1:] != gram_[:-1]) | (salt[1:] != salt[:-1])]))
            (o, a, b), (h, h2, w, s) = repeats(group, salt >= 0, key, at.astype(np.int64), first.astype(np.int64), t.column("context").to_pylist(), length)
            closed, own = np.zeros(len(o), np.int64), np.maximum(w, 0)
            columns = [
                pa.array(np.concatenate([key[o], key[own]]), pa.int64(), mask=np.concatenate([np.zeros(len(o), bool), w < 0])),
                *[pa.array(np.concatenate(c).astype(np.int32)) for c in ((n[o], n[own]), (a, s), (b, s + length))],
                *[pa.array(np.concatenate([closed, x]), pa.int64(), mask=np.arange(len(o) + len(h)) < len(o)) for x in (h, h2)],
            ]
            return pa.RecordBatch.from_arrays(columns, names=list(schema))

        held: pa.Table | None = None
        # a few thousand anchors at a time: each brings up to 337 windows of some ten numbers
        for new in (pa.Table.from_batches([batch.slice(k, chunk)]) for batch in batches for k in range(0, batch.num_rows, chunk)):
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= chunk:
                g, s = held.column("gram").to_numpy(), held.column("salt").to_numpy()
                whole = np.flatnonzero((g[1:] != g[:-1]) | (s[1:] != s[:-1]))
                if len(whole):
                    yield settled(held.slice(0, int(whole[-1]) + 1))
                    held = held.slice(int(whole[-1]) + 1)
        if held is not None and held.num_rows:
            yield settled(held)

    spans = materialize(dealt.mapInArrow(sorted_out, "key long, n int, begin int, end int, h long, h2 long"), "repeated-spans")
    across = spans.where("h is not null")
    known = across.groupBy("h", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h", "h2")
    more = across.where("key is not null").join(known, ["h", "h2"]).select("key", "n", "begin", "end")
    return spans.where("h is null").select("key", "n", "begin", "end").union(more)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (n_removed is above 0) and spans (merged, null where none or all is removed)."""
    small_batches(docs.sparkSession)
    spans = materialize(repeated_spans(docs, length, gram).groupBy("key", "n").agg(F.collect_list(F.struct("begin", "end")).alias("parts")), "spans-by-text")
    texts = docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length("text").alias("n"), "text")
    groups = texts.where(F.col("n") >= length).groupBy("key", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    copied = groups.where("copies > 1").select("key", "n")
    single = spans.join(copied, ["key", "n"], "left_anti")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, text, parts in zip(*batch.columns, strict=True):
                data, left, at = text.as_py().encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
                found = merged([(p["begin"], p["end"]) for p in parts.as_py()])
                for a, b in found:
                    left.update(data[at:a])
                    at = b
                left.update(data[at:])
                rows.append((key.as_py(), n.as_py(), sum(b - a for a, b in found), len(found), left.hexdigest(), [{"begin": a, "end": b} for a, b in found]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "n_removed", "n_spans", "sha", "spans"])

    source = maybe_in(texts, "key", bitmap(single, "key")).join(single, ["key", "n"]).select("key", "n", "text", "parts")
    cut = source.mapInArrow(kept, "key long, n int, n_removed long, n_spans long, sha string, spans array<struct<begin: int, end: int>>")
    all_gone = copied.select("key", "n", F.col("n").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("sha"), F.lit(None).cast("array<struct<begin: int, end: int>>").alias("spans"))
    changed = materialize(cut.union(all_gone), "changed-texts")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(text).alias("key"), F.octet_length(text).alias("n"), F.sha2(F.encode(text, "UTF-8"), 256).alias("_lm_sha"))
    zero = F.lit(0).cast("long")
    return rows.join(changed, ["key", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "_lm_sha").alias("kept_sha256"), (F.coalesce("n_removed", zero) > 0).alias("repeats"), "spans")
