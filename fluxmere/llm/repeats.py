"""Removal of repeated passages by suffix arrays: exact, for 200-byte strings.

1. Text is written as shards. A window of 200 bytes is anchored at the least hash of its
   48-byte strings (leftmost of equal ones), so equal windows have equal anchors. Only the
   anchors are exchanged, one in some 77 bytes: each with the hash of its string and that
   of its whole context, the bytes of all windows it anchors. A string that stands once in
   the corpus rules its windows out; a context that stands twice rules its windows in.
2. What is left are strings that stand in several different contexts, mostly at the ends of
   passages. One context of each kind is fetched and put, by string, into small shards.
   Each gets a suffix array by Larsson-Sadakane refinement, and common prefixes by Kasai's
   order of computation; neighbours with 200 bytes in common are repeats.
3. Contexts of one string that don't fit one such shard are spread over several, and their
   sorted windows are merged across shards, range by range, by binary search.

Windows are told apart by their bytes within a suffix array and by 128-bit hashes across.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN, GRAM = 200, 48
_rng = np.random.default_rng(6)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
_UP = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2]


def _power(n: int, which: int = 0) -> list[np.ndarray]:
    own = _powers[which]
    if len(own[0]) < n:
        n = 1 << n.bit_length()
        for i, base in enumerate((_UP[which], pow(_UP[which], -1, 2**64))):
            own[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])
    return own


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _prefix(raw: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = _power(len(raw) + 1, which)
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[which][raw] * up[: len(raw)], out=out[1:])
    return out


def _ranges(total: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of raw[begin:end]."""
    return _mix((total[end] - total[begin]) * _power(len(total), which)[1][begin])


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: block-wise running minima from both sides."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    fore = np.minimum.accumulate(grid, 1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(string hash, context hash, text, first window, last window) of all anchors; at most
    16 MB of text (or one longer text, whose pieces overlap by a window)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    if len(raw) < SPAN:
        return (np.zeros(0, np.int64),) * 5
    total = _prefix(raw)
    n = len(raw) - GRAM + 1
    gram = (total[GRAM:] - total[:n]) * _power(len(total))[1][:n]
    # 40 bits of hash, then the place: the leftmost of equal ones wins
    least = _sliding_least(_mix(gram) & np.uint64(~0xFFFFFF & 2**64 - 1) | np.arange(n, dtype=np.uint64), SPAN - GRAM + 1) & np.uint64(0xFFFFFF)
    start = end - size
    own = np.repeat(np.arange(len(texts)), np.maximum(size - SPAN + 1, 0))
    count = np.maximum(size - SPAN + 1, 0)
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(own))
    place = least[at]
    head = np.flatnonzero((np.diff(place, prepend=~place[:1]) != 0) | (np.diff(own, prepend=-1) != 0))
    tail = np.append(head[1:], len(own)) - 1
    if not len(head):
        return (np.zeros(0, np.int64),) * 5
    lo, hi, p = at[head], at[tail], place[head].astype(np.int64)
    a = _mix(gram[p])
    x = _ranges(total, lo, hi + SPAN) + _mix((p - lo).astype(np.uint64) << np.uint64(20) | (hi - lo).astype(np.uint64))
    base = start[own[head]]
    return a.view(np.int64), x.view(np.int64), own[head], lo - base, hi - base


PIECE = 8_000_000


def anchors_of(text: bytes, step: int = PIECE) -> list[tuple[np.ndarray, ...]]:
    """Anchors of one text of any length, by pieces of ``step`` windows. An anchor whose windows
    a piece border parts comes twice, each with its share of the windows."""
    out = []
    for a in range(0, max(1, len(text) - SPAN + 1), step):
        got = anchors([text[a : a + step + SPAN - 1]])
        out.append((got[0], got[1], got[2], got[3] + a, got[4] + a))
    return out


def anchors_in(texts: list[bytes], step: int = PIECE) -> list[tuple[np.ndarray, ...]]:
    """Anchors of a chunk of texts: of all together, or of each by itself if there is a long one."""
    if sum(map(len, texts)) <= step:
        return [anchors(texts)]
    return [(a, x, own + k, lo, hi) for k, text in enumerate(texts) for a, x, own, lo, hi in anchors_of(text, step)]


# --- suffix arrays -------------------------------------------------------------------------


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, big-endian (zeros past the end)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(raw)]
    return out


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first ``depth`` bytes at least (ties in no order): starts from
    8-byte words and doubles, sorting again only groups that are still tied."""
    n = len(raw)
    word = _words(raw)
    sa = np.argsort(word, kind="stable")
    new = np.append(True, word[sa[1:]] != word[sa[:-1]]) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = head
    rank[n] = -1
    h = 8
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots) and h < depth:
        own = sa[slots]
        # slots hold whole groups in rank order: sorting by (rank, rank h further on) keeps each in place
        key = rank[own] * (n + 1) + rank[np.minimum(own + h, n)] + 1
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[slots] = own
        new = np.append(True, key[1:] != key[:-1])
        rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(raw: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Bytes (up to about ``most``) that each suffix of ``sa`` shares with the one before it.

    Kasai's argument in text order: unless the bytes before them differ, a suffix shares one
    byte less with its predecessor than the suffix before it in the text does with its own.
    Only the others are compared, eight bytes at a time, all at once.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    had = before >= 0
    prior = raw[np.maximum(before - 1, 0)]
    reducible = had & (before > 0) & (place > 0)
    # not across the end of a context (255): its prefix may have been cut at ``most``
    reducible[1:] &= (prior[1:] == raw[:-1]) & (raw[:-1] != 255)
    # the order is only exact to some depth: the argument needs the neighbour to be the same one
    reducible[1:] &= before[1:] == before[:-1] + 1
    todo = np.flatnonzero(had & ~reducible)
    shared = np.zeros(n, np.int64)
    word = np.concatenate([_words(raw), np.zeros(1, np.uint64)])
    live, a, b, m = todo, todo.copy(), before[todo], 0
    while len(live) and m < most:
        differ = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        same = differ == 0
        if not same.all():
            off = live[~same]
            shared[off] = m + _leading(differ[~same])
        live, a, b = live[same], a[same] + 8, b[same] + 8
        m += 8
        inside = (a < n) & (b < n)
        if not inside.all():
            shared[live[~inside]] = m
            live, a, b = live[inside], a[inside], b[inside]
    shared[live] = m
    base = np.maximum.accumulate(np.where(~reducible, place, 0))
    return np.where(had, np.maximum(shared[base] - (place - base), 0), 0)[sa]


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero words."""
    out = np.zeros(len(x), np.int64)
    for i in range(1, 8):
        out += x < np.uint64(1 << (8 * i))
    return out


def repeated_windows(contexts: list[bytes]) -> np.ndarray:
    """Bool for each byte of the joined contexts: a 200-byte string starts here that also
    starts elsewhere in them. Strings don't cross contexts."""
    raw = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    room = np.repeat(np.cumsum(size) - 1, size) - np.arange(len(raw))
    sa = suffix_array(raw, SPAN)
    # up to the longest context: what is cut there still reaches every context's end
    near = common_prefixes(raw, sa, int(size.max())) >= SPAN
    both = room[sa] >= SPAN
    near[1:] &= both[1:] & both[:-1]
    near[:1] = False
    hit = np.zeros(len(raw), bool)
    hit[sa[near]] = True
    hit[sa[np.flatnonzero(near) - 1]] = True
    return hit


# --- Spark ----------------------------------------------------------------------------------

ANCHOR = "a long, x long, shard long, idx int, lo int, hi int"
FLAG = "shard long, idx int, lo int, hi int"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, out: str, shard_bytes: int = 6_000_000) -> DataFrame:
    """Write texts as shards below ``out`` and return their anchors, with one row of idx -1 per
    shard. A shard is moved into place whole; a task that runs again writes the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        where, base = _fs(out)
        where.create_dir(base, recursive=True)
        k, held, total = 0, [], 0

        def close():
            nonlocal k, held, total
            table, shard = pa.Table.from_batches(held), part << 20 | k
            sink = io.BytesIO()
            pq.write_table(table, sink, compression="zstd", compression_level=1, use_dictionary=False)
            with where.open_output_stream(f"{base}/{shard}.{attempt}") as f:
                f.write(sink.getvalue())
            where.move(f"{base}/{shard}.{attempt}", f"{base}/{shard}.parquet")
            texts = table.column("text").to_pylist()
            k, held, total = k + 1, [], 0
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([shard], pa.int64()), *(pa.array([x], pa.int32()) for x in (-1, 0, 0))], names)
            for i, j in common.chunks([len(t) for t in texts], 1_500_000):
                for a, x, own, lo, hi in anchors_in(texts[i:j]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(x), pa.array(np.full(len(a), shard)), *(pa.array(v.astype(np.int32)) for v in (own + i, lo, hi))], names)

        names = [c.split()[0] for c in ANCHOR.split(", ")]
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary())], ["doc_id", "text"])
            sizes = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset : b.column(1).offset + len(b) + 1]) if len(b) else []
            for i, j in common.chunks([int(s) for s in sizes], shard_bytes // 4):
                held.append(b.slice(i, j - i))
                total += int(sum(sizes[i:j]))
                if total >= shard_bytes:
                    yield from close()
        if held:
            yield from close()

    return common.id_text(docs).mapInArrow(run, ANCHOR)


def _read_shard(out: str, shard: int) -> pa.Table:
    where, base = _fs(out)
    with where.open_input_file(f"{base}/{shard}.parquet") as f:
        return pq.read_table(f)


def _by_shard(rows: DataFrame, run, schema: str) -> DataFrame:
    # as many tasks as shuffle partitions: the rows are few, the shards they read are not
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "shard").groupBy("shard").applyInArrow(run, schema)


def fetch_contexts(wanted: DataFrame, out: str) -> DataFrame:
    """a, shard, idx, lo, once, context of ``wanted`` (a, shard, idx, lo, hi, once)."""

    def run(table: pa.Table) -> pa.Table:
        texts = _read_shard(out, table.column("shard")[0].as_py()).column("text")
        idx, lo, hi = (table.column(c).to_pylist() for c in ("idx", "lo", "hi"))
        order = np.argsort(idx, kind="stable").tolist()
        got: list = [None] * len(idx)
        last, text = -1, b""
        for i in order:
            if idx[i] != last:
                last, text = idx[i], texts[idx[i]].as_py()
            got[i] = text[lo[i] : hi[i] + SPAN]
        return pa.table({"a": table.column("a"), "shard": table.column("shard"), "idx": table.column("idx"), "lo": table.column("lo"), "once": table.column("once"), "context": pa.array(got, pa.binary())})

    return _by_shard(wanted, run, "a long, shard long, idx int, lo int, once boolean, context binary")


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2] - 1


COMPARED = FLAG + ", a long, part int, keys binary, more binary, places binary"


def compare_contexts(contexts: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Repeats among contexts of one string, per suffix-array shard (a, salt).

    Rows are flags of repeated windows; strings spread over several shards (``salts`` > 1)
    also give their windows' hashes, sorted and cut into as many ranges (``part`` >= 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and size >= chunk and row[:2] != held[-1][:2]:
                    yield from work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield from work(held)

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[7] for r in rows]
        hit = repeated_windows(texts)
        out, at = [], 0
        merged: dict = {}
        raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
        totals = [_prefix(raw, w) for w in (0, 1)] if any(r[2] > 1 for r in rows) else []
        for n, (a, salt, salts, shard, idx, lo, once, text) in enumerate(rows):
            if once:
                for s, e in zip(*_runs(hit[at : at + len(text)])):
                    out.append((shard, idx, lo + int(s), lo + int(e), None, -1, None, None, None))
            if salts > 1:
                w = np.arange(at, at + len(text) - SPAN + 1)
                keys = [_ranges(totals[h], w, w + SPAN, h) for h in (0, 1)]
                place = np.stack([np.full(len(w), n), w - at], 1)
                merged.setdefault((a, salts), []).append((*keys, place))
            at += len(text) + 1
        for (a, salts), parts in merged.items():
            k, m, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(k, kind="stable")
            k, m, place = k[order], m[order], place[order]
            # shard, text, place of the window, and whether its context stands once
            where = np.array([(rows[n][3], rows[n][4], rows[n][5] + d, rows[n][6]) for n, d in place.tolist()], np.int64).reshape(-1, 4)
            cut = np.searchsorted(k >> np.uint64(32), (np.arange(1, salts) << 32) // salts)
            for r, (kk, mm, ww) in enumerate(zip(np.split(k, cut), np.split(m, cut), np.split(where, cut))):
                if len(kk):
                    out.append((None, None, None, None, a, r, kk.tobytes(), mm.tobytes(), ww.tobytes()))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        cols = list(zip(*out)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in COMPARED.split(", ")])

    cols = ["a", "salt", "salts", "shard", "idx", "lo", "once", "context"]
    # as many tasks as shuffle partitions: by their bytes, little work would be thought to lie in them
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "a", "salt").sortWithinPartitions("a", "salt").select(*cols).mapInArrow(run, COMPARED)


def merged_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs in one: (keys, number of each in the joined runs). Neighbours are merged, the
    places of the second among the first found by binary search, until one run is left."""
    first = np.cumsum([0, *map(len, runs)])
    held = [(r, np.arange(a, a + len(r))) for r, a in zip(runs, first)]
    while len(held) > 1:
        out = [held[-1]] if len(held) % 2 else []
        for (k, at), (other, other_at) in zip(held[0::2], held[1::2]):
            place = np.searchsorted(k, other, "right") + np.arange(len(other))
            own = np.ones(len(k) + len(other), bool)
            own[place] = False
            keys, number = np.empty(len(own), k.dtype), np.empty(len(own), np.int64)
            keys[place], keys[own], number[place], number[own] = other, k, other_at, at
            out.append((keys, number))
        held = out
    return held[0]


def merge_shards(compared: DataFrame) -> DataFrame:
    """Windows that stand in several shards of one string: their sorted runs are merged by binary
    search, and equal neighbours repeat. A range of a string holds about as many windows as
    one shard."""

    def run(table: pa.Table) -> pa.Table:
        runs, more, places = (table.column(c).to_pylist() for c in ("keys", "more", "places"))
        keys, at = merged_runs([np.frombuffer(k, np.uint64) for k in runs])
        more, places = np.frombuffer(b"".join(more), np.uint64)[at], np.frombuffer(b"".join(places), np.int64).reshape(-1, 4)[at]
        tied = np.append(keys[1:] == keys[:-1], False)
        tied |= np.append(False, tied[:-1])
        mixed = np.flatnonzero(tied)
        # of equal first hashes, the second one decides
        order = mixed[np.lexsort((more[mixed], keys[mixed]))]
        more[mixed], places[mixed] = more[order], places[order]
        same = (keys[1:] == keys[:-1]) & (more[1:] == more[:-1])
        hit = np.append(same, False) | np.append(False, same)
        got = places[hit & (places[:, 3] > 0)]
        return pa.table({"shard": pa.array(got[:, 0]), **{c: pa.array(got[:, i].astype(np.int32)) for c, i in (("idx", 1), ("lo", 2), ("hi", 2))}})

    return compared.filter("part >= 0").select("a", "part", "keys", "more", "places").groupBy("a", "part").applyInArrow(run, FLAG)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cover(flags: pa.Table, texts) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(index, text, begins, ends) of removed runs, for every text of a shard."""
    idx = flags.column("idx").to_numpy()
    order = np.argsort(idx, kind="stable")
    idx = idx[order]
    lo, hi = flags.column("lo").to_numpy()[order].astype(np.int64), flags.column("hi").to_numpy()[order].astype(np.int64) + SPAN
    bounds = np.searchsorted(idx, np.arange(len(texts) + 1))
    for n, text in enumerate(texts):
        a, b = bounds[n], bounds[n + 1]
        if a == b:
            yield n, text, lo[:0], hi[:0]
            continue
        own = np.argsort(lo[a:b], kind="stable") + a
        s, e = lo[own], np.maximum.accumulate(hi[own])
        new = np.append(True, s[1:] > e[:-1])
        yield n, text, s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1]


def _kept(text: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    at, out = 0, []
    for s, e in zip(begins.tolist(), ends.tolist()):
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def find_repeats(docs: DataFrame, out: str, shard_contexts: int = 4096) -> DataFrame:
    """Flags (shard, idx, first and last repeated window) of all texts, and a row of idx -1 for
    every shard written below ``out``."""
    found = common.stored(write_shards(docs, out), "anchors")
    rows = found.filter("idx >= 0")
    kinds = rows.groupBy("a", "x").agg(F.count("*").alias("n"))
    several = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter("all > 1").select("a", "kinds")
    # strings that stand once leave here: most of them
    repeated = common.stored(rows.join(several, "a"), "repeated")
    kinds = repeated.groupBy("a", "x").agg(F.count("*").alias("n"), F.first("kinds").alias("kinds"), F.min(F.struct("shard", "idx", "lo", "hi")).alias("f"))
    kinds = common.stored(kinds.select("a", "x", "n", "kinds", "f.*"), "kinds")
    twice = repeated.join(kinds.filter("n > 1").select("a", "x"), ["a", "x"]).select("shard", "idx", "lo", "hi")
    wanted = kinds.filter("kinds > 1").select("a", "shard", "idx", "lo", "hi", (F.col("n") == 1).alias("once"), "kinds")
    salts = F.ceil(F.col("kinds") / shard_contexts).cast("int")
    contexts = fetch_contexts(wanted.drop("kinds"), out).join(wanted.select("a", "kinds").distinct(), "a").withColumn("salts", salts)
    contexts = contexts.withColumn("salt", F.pmod(F.xxhash64("shard", "idx", "lo"), F.col("salts")).cast("int"))
    compared = common.stored(compare_contexts(contexts), "compared")
    names = ["shard", "idx", "lo", "hi"]
    return twice.unionByName(compared.filter("part < 0").select(*names)).unionByName(merge_shards(compared)).unionByName(found.filter("idx < 0").select(*names))


def repeat_digests(docs: DataFrame, shard_contexts: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Null texts are empty; texts below 200 bytes keep all; rows that repeat a text of 200
    bytes or more lose all of it, each; an empty table gives no rows. Bytes are removed as
    such: what is kept need not be whole characters.
    """
    out = common.work_path(docs.sparkSession, "shards")

    def run(flags: pa.Table) -> pa.Table:
        table = _read_shard(out, flags.column("shard")[0].as_py())
        rows = []
        for _, text, s, e in _cover(flags.filter(pc.greater_equal(flags.column("idx"), 0)), table.column("text").to_pylist()):
            rows.append((len(text), int((e - s).sum()), len(s), hashlib.sha256(_kept(text, s, e)).hexdigest()))
        n, removed, spans, digest = zip(*rows)
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest)})

    return _by_shard(find_repeats(docs, out, shard_contexts), run, RESULT)


def remove_repeats(docs: DataFrame, shard_contexts: int = 4096) -> DataFrame:
    """doc_id and the bytes kept of each text, ``kept`` (binary), for every row of ``docs``."""
    out = common.work_path(docs.sparkSession, "shards")

    def run(flags: pa.Table) -> pa.Table:
        table = _read_shard(out, flags.column("shard")[0].as_py())
        kept = [_kept(text, s, e) for _, text, s, e in _cover(flags.filter(pc.greater_equal(flags.column("idx"), 0)), table.column("text").to_pylist())]
        return pa.table({"doc_id": table.column("doc_id"), "kept": pa.array(kept, pa.binary())})

    return _by_shard(find_repeats(docs, out, shard_contexts), run, "doc_id long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(common.documents(spark, sf_dir))
