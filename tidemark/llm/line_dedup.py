"""Line deduplication by an exact set-similarity join over Arrow batches.

The native form of this operator (expressions over arrays of hashes) did not meet the limits of
the check tool; the README gives the figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, lean, materialize, small
from tidemark.llm.words import byte_slices, hashed_words, scrambled, text_bytes

#: Counters for token rarity; a fixed size, shared by tokens that collide.
COUNTERS = 1 << 20
#: Bits of a code: a counter's rank (20) and, below it, a part of the token's hash; lines in a block have the bits above.
CODE_BITS, HASH_BITS = 54, 34
#: Postings that a task gathers before it deals them to buckets, and postings that a bucket is meant to hold.
FLUSH, BUCKET = 200_000, 200_000
#: Sets that one deal puts under one key, at most; any others meet the key's first set in a join, which adaptive execution splits.
LOCAL = 64
#: Members of a list that are compared in one task at most; longer lists go the same way as those beyond LOCAL.
LONGEST = 8192
#: First members of a longer list that its others are tried against before all of them.
HUBS = 16
#: Nearest earlier sets of its list that a set is tried against before all of them, by round.
NEAREST = (1, 4)
#: Sets of more tokens have a wide signature as well.
WIDE = 96
#: Pairs that are compared at once.
PAIRS = 1 << 17
#: Bits of the filter of lines to verify, at most.
FILTER_BITS = 1 << 26
#: What a bucket gets: sets, lines equal to an earlier one, postings, postings beyond LOCAL, and the keys of these.
SECTIONS = {
    "sets": (("s1", "u8"), ("s2", "u8"), ("doc", "i8"), ("line", "i4")),
    "same": (("doc", "i8"), ("line", "i4"), ("hub_doc", "i8"), ("hub_line", "i4")),
    "posts": (("k", "u4"), ("s", "u4"), ("sig", "u8"), ("doc", "i8"), ("line", "i4"), ("n", "u2"), ("i", "u2")),
    "wide": (("w1", "u8"), ("w2", "u8")),  # of the postings of sets over WIDE, in their order
    "over": (("k", "u8"), ("s", "u4"), ("sig", "u8"), ("doc", "i8"), ("line", "i4"), ("n", "u2"), ("i", "u2")),
    "hot": (("k", "u4"),),
}
#: Tokens of one set alone change a bit of its signature each, so that they are as many as the bits in which two signatures differ, at least.
#: The length filter, and the positional one: for the first neighbours in common, at most i tokens before them are
#: common, and so are what both have left after them; 9 common >= 4 (n + hub_n) must still be possible. Sizes stop at 65535.
FITS = (
    "greatest(n, hub_n) = 65535 or 5 * least(n, hub_n) >= 4 * greatest(n, hub_n)"
    " and 9 * (least(i, hub_i) + least(n - i, hub_n - hub_i)) >= 4 * (n + hub_n) and 9 * bit_count(sig ^ hub_sig) <= n + hub_n"
)


def fits(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """FITS of pairs of postings; lines at one place are no pair."""
    n, m, i, j = (x[c].astype(np.int64) for c in ("n", "i") for x in (a, b))
    out = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * (np.minimum(i, j) + np.minimum(n - i, m - j)) >= 4 * (n + m))
    out &= 9 * np.bitwise_count(a["sig"] ^ b["sig"]).astype(np.int64) <= n + m
    wide = np.bitwise_count(a["w1"] ^ b["w1"]).astype(np.int64) + np.bitwise_count(a["w2"] ^ b["w2"])
    out &= (9 * wide <= n + m) | (np.minimum(n, m) <= WIDE)
    return (out | (np.maximum(n, m) == 65535)) & ((a["doc"] != b["doc"]) | (a["line"] != b["line"]))


def whole_lines(docs: DataFrame) -> DataFrame:
    """(doc_id long, text) of the rows that have both."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def token_ranks(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The rank of each counter, from the rarest on, counted over every word of the texts, and the number of words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in byte_slices(batch, 0):
                _, hashes = hashed_words(*text_bytes(pc.utf8_lower(part.column(0))))
                total += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "c"])

    t = docs.select("text").mapInArrow(run, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # a row per counter
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[t["slot"].to_numpy()] = t["c"].to_numpy()
    ranks = np.empty(COUNTERS, dtype=np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(COUNTERS, dtype=np.uint64)
    return ranks, int(counts.sum())


def line_starts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, line_no) of each line of the texts, in order; a text without a line break is one line."""
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([edges[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(edges) - 1), np.searchsorted(edges, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    return start, row, (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)


def coded_sets(hashes: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of lines with ``counts`` words: (line, n, codes): lines with words, sizes of their sets, codes of these from the rarest on."""
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    for at in range(0, len(some), 1 << (64 - CODE_BITS)):
        line = some[at : at + (1 << (64 - CODE_BITS))]
        own = hashes[ends[at] - counts[line[0]] : ends[at + len(line) - 1]]
        code = (ranks[(own % np.uint64(COUNTERS)).astype(np.int64)] << np.uint64(HASH_BITS)) | (own >> np.uint64(64 - HASH_BITS))
        code |= np.repeat(np.arange(len(line), dtype=np.uint64) << np.uint64(CODE_BITS), counts[line])
        code.sort()
        code = code[np.concatenate([[True], code[1:] != code[:-1]])]
        n = np.bincount((code >> np.uint64(CODE_BITS)).astype(np.int64), minlength=len(line))
        yield line, n, code & np.uint64((1 << CODE_BITS) - 1)


def prefix_keys(n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, i, key): hashes of neighbouring tokens among the rarest 2 n div 5 + 2 of n: the prefix of the join.

    Let sets with Jaccard 0.8 or more have d and e tokens of their own. 2 d + e is at most
    2 n div 5, so the prefix holds d + e + 2 common tokens at least, in both sets; the d + e own
    tokens can't part all of these, and two common tokens are neighbours in both sets. Sets under
    four tokens resemble none but their equals, and have no keys.
    """
    which = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    length = np.where(n < 4, 1, np.minimum(n, 2 * n // 5 + 2))
    at = np.flatnonzero(place < length[which] - 1)
    return which[at], place[at], scrambled(codes[at] * np.uint64(0x9E3779B97F4A7C15) + codes[at + 1])


def set_hashes(n: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
    """Two 64-bit hashes of each set, and its signatures of 64 and 128 bits: bit by bit, whether an odd number of its tokens fall on it."""
    first = np.cumsum(n) - n
    mixed = scrambled(codes)
    bit = np.uint64(1) << ((mixed >> np.uint64(51)) & np.uint64(63))
    high = (mixed >> np.uint64(57)) & np.uint64(1)
    return {
        "s1": np.add.reduceat(mixed, first), "s2": np.add.reduceat(scrambled(mixed + np.uint64(1)), first),
        "sig": np.bitwise_xor.reduceat(np.uint64(1) << (mixed >> np.uint64(58)), first),
        "w1": np.bitwise_xor.reduceat(bit * high, first), "w2": np.bitwise_xor.reduceat(bit * (np.uint64(1) - high), first),
    }


def packed(columns: dict[str, dict[str, np.ndarray]]) -> bytes:
    raw = [np.array([len(next(iter(columns[name].values()))) if name in columns else 0 for name in SECTIONS], dtype=np.int64).tobytes()]
    for name, fields in SECTIONS.items():
        raw += [columns[name][field].astype(kind).tobytes() for field, kind in fields if name in columns]
    raw = b"".join(raw)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(blobs: list[bytes]) -> dict[str, dict[str, np.ndarray]]:
    parts: dict[tuple[str, str], list[np.ndarray]] = {(name, field): [] for name, fields in SECTIONS.items() for field, _ in fields}
    for blob in blobs:
        raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
        sizes, at = np.frombuffer(raw, dtype=np.int64, count=len(SECTIONS)), 8 * len(SECTIONS)
        for (name, fields), size in zip(SECTIONS.items(), sizes.tolist(), strict=True):
            for field, kind in fields if size else ():
                parts[name, field].append(np.frombuffer(raw, dtype=kind, count=size, offset=at))
                at += size * int(kind[1])
    return {name: {f: np.concatenate([np.zeros(0, dtype=k), *parts[name, f]]) for f, k in fields} for name, fields in SECTIONS.items()}


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, sizes) of the runs of equal neighbours."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    heads = np.flatnonzero(new)
    return heads, np.diff(np.append(heads, n))


def first_of_equals(s1: np.ndarray, s2: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): for each set the index of the first line with an equal one, and whether its own line comes later than that."""
    order = np.lexsort((line, doc, s2, s1))
    first = np.empty(len(order), dtype=np.int64)
    heads, sizes = runs(s1[order], s2[order])
    first[order] = np.repeat(order[heads], sizes)
    return first, (doc > doc[first]) | (doc == doc[first]) & (line > line[first])


def dealt(sets: dict[str, np.ndarray], posts: dict[str, np.ndarray], buckets: int, local: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob): sets by their hash, postings (k, i, set) by their key; sets equal to an earlier one here give none."""
    first, later = first_of_equals(sets["s1"], sets["s2"], sets["doc"], sets["line"])
    own = first == np.arange(len(first))
    out: dict[str, tuple[np.ndarray, dict[str, np.ndarray]]] = {}
    spread = lambda doc, line: scrambled(doc.astype(np.uint64) * np.uint64(31) + line.astype(np.uint64)) % np.uint64(buckets)
    same = {"doc": sets["doc"][later], "line": sets["line"][later], "hub_doc": sets["doc"][first[later]], "hub_line": sets["line"][first[later]]}
    out["same"] = spread(same["doc"], same["line"]), same
    out["sets"] = (sets["s1"][own] >> np.uint64(32)) % np.uint64(buckets), {c: sets[c][own] for c in ("s1", "s2", "doc", "line")}
    chosen = own[posts["set"]]
    key, of, i = posts["k"][chosen], posts["set"][chosen], posts["i"][chosen]
    # The place of each posting in its key's list, by place of the line; only long lists need it.
    order = np.argsort(key)
    _, size = runs(key[order])
    long = order[np.repeat(size > local, size)]
    beyond = np.zeros(len(key), dtype=bool)
    if len(long):
        long = long[np.lexsort((sets["line"][of[long]], sets["doc"][of[long]], key[long]))]
        beyond[long[np.arange(len(long)) - np.repeat(*runs(key[long])) >= local]] = True
    columns = {
        "k": key, "s": sets["s1"][of] >> np.uint64(32), "sig": sets["sig"][of], "doc": sets["doc"][of], "line": sets["line"][of], "n": np.minimum(sets["n"][of], 65535), "i": np.minimum(i, 65535),
    }
    bucket = (key >> np.uint64(32)) % np.uint64(buckets)
    out["posts"] = bucket[~beyond], {c: v[~beyond] & np.uint64(0xFFFFFFFF) if c == "k" else v[~beyond] for c, v in columns.items()}
    large = ~beyond & (columns["n"] > WIDE)
    out["wide"] = bucket[large], {c: sets[c][of[large]] for c in ("w1", "w2")}
    over = {c: v[beyond] for c, v in columns.items()}
    over["k"] = (bucket[beyond] << np.uint64(32)) | (over["k"] & np.uint64(0xFFFFFFFF))
    out["over"] = spread(over["doc"], over["line"]), over
    hot = np.unique(over["k"])
    out["hot"] = hot >> np.uint64(32), {"k": hot & np.uint64(0xFFFFFFFF)}
    by: dict[int, dict[str, dict[str, np.ndarray]]] = {}
    for name, (where, columns) in out.items():
        order = np.argsort(where.astype(np.int64), kind="stable")
        where = where[order]
        for lo, size in zip(*runs(where), strict=True):
            by.setdefault(int(where[lo]), {})[name] = {c: v[order[lo : lo + size]] for c, v in columns.items()}
    for bucket in sorted(by):
        yield bucket, packed(by.pop(bucket))


def postings(docs: DataFrame, ranks: np.ndarray, least_tokens: int, buckets: int) -> DataFrame:
    """(b, blob): what each bucket gets, in one row for each bucket that a deal of FLUSH postings meets."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    # As many deals as buckets put something under a key, so that a list takes no more than a bucket is meant to hold.
    local = max(1, min(LOCAL, BUCKET // buckets))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, posts, held, count = [], [], 0, 0

        def flush():
            whole = {c: np.concatenate([x[c] for x in sets]) for c in sets[0]}
            keyed = {c: np.concatenate([x[c] for x in posts]) for c in ("k", "i", "set")}
            for bucket, blob in dealt(whole, keyed, buckets, local):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], names=["b", "blob"])

        for batch in batches:
            for part in byte_slices(batch, 1):
                data, edges = text_bytes(pc.utf8_lower(part.column(1)))
                word, hashes = hashed_words(data, edges)
                start, row, line_no = line_starts(data, edges)
                doc = part.column(0).to_numpy()
                for line, n, codes in coded_sets(hashes, np.diff(np.append(np.searchsorted(word, start), len(word))), shipped.value):
                    hashed = set_hashes(n, codes)
                    of, i, key = prefix_keys(n, codes)
                    keep = n >= least_tokens
                    at = np.cumsum(keep) - 1
                    some = keep[of]
                    sets.append({c: v[keep] for c, v in hashed.items()} | {"doc": doc[row[line[keep]]], "line": line_no[line[keep]], "n": n[keep]})
                    posts.append({"k": key[some], "i": i[some], "set": at[of[some]] + count})
                    count += int(keep.sum())
                    held += int(some.sum()) + int(keep.sum())
                if held >= FLUSH:
                    yield from flush()
                    sets, posts, held, count = [], [], 0, 0
        if sets:
            yield from flush()

    return docs.mapInArrow(run, "b long, blob binary")


FOUND = "kind int, k long, doc_id long, line_no int, n int, i int, sig long, hub_doc long, hub_line int, hub boolean, blob binary"
#: Kinds of rows: lines equal to an earlier one; candidate pairs; postings of long lists; a bucket's other lists.
SAME, PAIR, LONG, LISTS = range(4)
LISTED = (("k", "u4"), ("sig", "u8"), ("w1", "u8"), ("w2", "u8"), ("doc", "i8"), ("line", "i4"), ("n", "u2"), ("i", "u2"))


def runs_of(p: dict[str, np.ndarray], columns: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The postings by key and place, with (heads, sizes) of the lists."""
    order = np.lexsort((p["line"], p["doc"], p["k"]))
    p = {c: p[c][order] for c in columns}
    return p, *runs(p["k"])


def pairs_with_first(p: dict[str, np.ndarray], heads: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fit, hub): whether each posting may be similar to the first of its list, and where that is."""
    hub = np.repeat(heads, size)
    return fits(p, {c: v[hub] for c, v in p.items()}), hub


def pairs_with_others(p: dict[str, np.ndarray], hub: np.ndarray, which: np.ndarray, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier): pairs that may be similar of the postings ``which`` with earlier ones of their lists, but for the first.

    ``nearest``: of each posting's pairs only so many, those whose signatures differ least.
    """
    which = which[which > hub[which] + 1]
    ends = np.cumsum(which - hub[which] - 1)
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    at = 0
    while at < len(which):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        part = which[at:end]
        count = part - hub[part] - 1
        later = np.repeat(part, count)
        earlier = np.arange(len(later)) - np.repeat(np.cumsum(count) - count, count) + hub[later] + 1
        ok = fits({c: v[later] for c, v in p.items()}, {c: v[earlier] for c, v in p.items()})
        later, earlier = later[ok], earlier[ok]
        if nearest is not None:
            differ = sum(np.bitwise_count(p[c][later] ^ p[c][earlier]).astype(np.int64) for c in ("sig", "w1", "w2"))
            order = np.lexsort((earlier, differ, later))
            order = order[np.arange(len(order)) - np.repeat(*runs(later[order])) < nearest]
            later, earlier = later[order], earlier[order]
        out.append((later, earlier))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def distinct_pairs(p: dict[str, np.ndarray], later: np.ndarray, earlier: np.ndarray) -> dict[str, np.ndarray]:
    columns = p["line"][later], p["doc"][later], p["line"][earlier], p["doc"][earlier]
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    one, _ = runs(*columns)
    return dict(zip(("line_no", "doc_id", "hub_line", "hub_doc"), (c[one] for c in columns), strict=True))


def listed(table: pa.Table) -> pa.Table:
    """A bucket's rows of FOUND.

    A posting that may be similar to the first of its list makes a pair with it; any other one with the nearest
    ones among the earlier. ``hub`` marks the first postings of a long list.
    """
    got = unpacked(table.column("blob").to_pylist())
    rows = {c: [] for c in FOUND.replace(",", "").split()[::2]}

    def add(kind: int, size: int, **columns) -> None:
        for c, held in rows.items():
            if c == "blob":
                held.append(np.full(size, None, dtype=object) if c not in columns else np.array([columns[c]], dtype=object))
            else:
                held.append(columns[c].astype(np.int64) if c in columns else np.full(size, kind if c == "kind" else 0))

    same, sets, over, posts = got["same"], got["sets"], got["over"], got["posts"]
    first, later = first_of_equals(sets["s1"], sets["s2"], sets["doc"], sets["line"])
    add(SAME, len(same["doc"]), doc_id=same["doc"], line_no=same["line"], hub_doc=same["hub_doc"], hub_line=same["hub_line"])
    add(SAME, int(later.sum()), doc_id=sets["doc"][later], line_no=sets["line"][later], hub_doc=sets["doc"][first[later]], hub_line=sets["line"][first[later]])
    add(LONG, len(over["k"]), k=over["k"], doc_id=over["doc"], line_no=over["line"], n=over["n"], i=over["i"], sig=over["sig"].view(np.int64))
    large = posts["n"] > WIDE
    for c, v in got["wide"].items():
        posts[c] = np.zeros(len(large), dtype=np.uint64)
        posts[c][large] = v
    order = np.argsort(posts["k"])
    key = posts["k"][order]
    alike = np.zeros(len(key), dtype=bool)
    alike[1:] = key[1:] == key[:-1]
    alike[:-1] |= alike[1:]
    order = order[alike | np.isin(key, got["hot"]["k"])]
    p = {c: v[order] for c, v in posts.items()}
    columns = ("k", "s", "sig", "n", "i")
    order = np.lexsort((p["line"], p["doc"], *(p[c] for c in reversed(columns))))
    order = order[runs(*(p[c][order] for c in columns))[0]]  # of equal sets the first
    p, heads, size = runs_of({c: v[order] for c, v in p.items()}, tuple(c for c, _ in LISTED))
    long = np.isin(p["k"], got["hot"]["k"]) | (np.repeat(size, size) > LONGEST)
    bucket = int(table.column("b")[0].as_py()) << 32
    hub = np.repeat(heads, size)[long]
    own = np.flatnonzero(long)
    add(
        LONG, len(own), k=p["k"][own].astype(np.int64) | bucket, doc_id=p["doc"][own], line_no=p["line"][own], n=p["n"][own], i=p["i"][own],
        sig=p["sig"][own].view(np.int64), hub=own - hub < HUBS,
    )
    some = ~long & (np.repeat(size, size) > 1)
    p, heads, size = runs_of({c: v[some] for c, v in p.items()}, tuple(p))
    fit, hub = pairs_with_first(p, heads, size)
    later, earlier = pairs_with_others(p, hub, np.flatnonzero(~fit), NEAREST[0])
    pairs = distinct_pairs(p, np.concatenate([np.flatnonzero(fit), later]), np.concatenate([hub[fit], earlier]))
    add(PAIR, len(pairs["doc_id"]), **pairs)
    again = np.repeat(size > 2, size)
    raw = b"".join([np.int64(again.sum()).tobytes(), *(p[c][again].astype(kind).tobytes() for c, kind in LISTED)])
    add(LISTS, 1, k=np.array([len(raw)]), blob=pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True))
    out = {c: np.concatenate(v) for c, v in rows.items()}
    narrow = {"kind", "line_no", "n", "i", "hub_line"}
    return pa.table({c: pa.array(v, pa.binary()) if c == "blob" else pa.array(v == 1) if c == "hub" else pa.array(v.astype(np.int32) if c in narrow else v) for c, v in out.items()})


def seen_again(found: DataFrame, failed: DataFrame, nearest: int | None) -> DataFrame:
    """(doc_id, line_no, hub_doc, hub_line): pairs of the lines ``failed`` with earlier ones of their lists, the ``nearest`` or all."""
    shipped = found.sparkSession.sparkContext.broadcast(place_filter(failed))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shipped.value
        for batch in batches:
            for size, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = pa.Codec("zstd").decompress(blob.as_py(), size, asbytes=True)
                count, at, p = int.from_bytes(raw[:8], "little"), 8, {}
                for c, kind in LISTED:
                    p[c] = np.frombuffer(raw, dtype=kind, count=count, offset=at)
                    at += count * int(kind[1])
                heads, sizes = runs(p["k"])
                pairs = distinct_pairs(p, *pairs_with_others(p, np.repeat(heads, sizes), in_filter(p["doc"], p["line"], mask), nearest))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[c]) for c in ("doc_id", "line_no", "hub_doc", "hub_line")], names=["doc_id", "line_no", "hub_doc", "hub_line"])

    lists = found.where(F.col("kind") == LISTS).select("k", "blob")
    return lists.mapInArrow(run, "doc_id long, line_no int, hub_doc long, hub_line int")


def repeated_lines(docs: DataFrame, least_tokens: int = 1, tag: str = "lines") -> DataFrame:
    """Lines that repeat an earlier one: (doc_id, line_no, match_doc_id, match_line_no).

    Lines are compared as sets of lower-cased words between ASCII white space, if they have
    ``least_tokens`` distinct ones. A line goes if any earlier line, by doc_id and then place in the
    text, has Jaccard 0.8 or more with it, itself removed or not; the match is one such line, and which
    one depends on how the rows are dealt. Equal
    sets collapse first. Others meet by the prefix filter (rarest tokens first, keyed by neighbouring
    pairs), the length, positional and signature filters, and an exact check. A list's sets are tried
    against its first set; those that can't be similar to it, or fail, against the nearest others by
    signature, and what still fails against all of them.

    Null and empty texts, rows without an id, lines without a word and an empty table lose nothing.
    Rows that repeat a doc_id have one place, so identical ones don't remove each other. Other columns
    are ignored, whatever their names. Lines of any length are compared whole.
    """
    docs = whole_lines(docs)
    ranks, words = token_ranks(docs)
    # At most two keys go with five distinct words.
    deals = postings(docs, ranks, least_tokens, max(16, 2 * words // 5 // BUCKET + 1))
    found = materialize(deals.groupBy("b").applyInArrow(listed, FOUND), f"{tag}-found")
    at, hub = F.struct("doc_id", "line_no").alias("at"), F.struct(F.col("hub_doc").alias("doc_id"), F.col("hub_line").alias("line_no")).alias("hub")
    same = found.where(F.col("kind") == SAME).select("doc_id", "line_no", hub)
    # Long lists meet their first postings in a join, which adaptive execution splits at hot keys.
    long = found.where(F.col("kind") == LONG).select("k", at, "n", "i", "sig", F.col("hub").alias("first"))
    other = long.select(F.col("k").alias("hk"), F.col("at").alias("hub"), F.col("n").alias("hub_n"), F.col("i").alias("hub_i"), F.col("sig").alias("hub_sig"), "first")
    star = long.drop("first").join(other.where("first"), F.col("k") == F.col("hk")).where("at > hub").where(FITS).select("hub", "at")
    pairs = found.where(F.col("kind") == PAIR).select(hub, at).unionByName(star).distinct()
    pairs = materialize(pairs, f"{tag}-pairs")
    settled = verified(pairs, docs, ranks, f"{tag}-pairs")

    # Lines whose pairs have failed are tried against others of their lists: first the nearest, then all.
    tried, spent = pairs, []
    for nearest in (*NEAREST[1:], None):
        done = settled.select(F.col("at").alias("done")).distinct()
        failed = materialize(tried.select("at").distinct().join(done, F.col("at") == F.col("done"), "left_anti").select("at.*"), f"{tag}-failed")
        more = seen_again(found, failed, nearest).select(hub, at)
        if nearest is None:
            left = long.join(done, F.col("at") == F.col("done"), "left_anti").drop("first")
            more = more.unionByName(left.join(other, F.col("k") == F.col("hk")).where("at > hub").where(FITS).select("hub", "at"))
        more = materialize(more.distinct().join(tried, ["hub", "at"], "left_anti"), f"{tag}-more")
        good = verified(more, docs, ranks, f"{tag}-more")
        spent += [tried, failed, settled, more, good]
        tried, settled = materialize(tried.unionByName(more), f"{tag}-tried"), materialize(settled.unionByName(good), f"{tag}-settled")
    near = settled.select("at.doc_id", "at.line_no", "hub")
    removed = same.unionByName(near).groupBy("doc_id", "line_no").agg(F.min("hub").alias("first"))
    removed = removed.select("doc_id", "line_no", F.col("first.doc_id").alias("match_doc_id"), F.col("first.line_no").alias("match_line_no"))
    out = materialize(removed, f"{tag}-removed")
    forget(found, tried, settled, *spent)
    return out


def place_slots(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return (scrambled(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def in_filter(doc: np.ndarray, line: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Where places may be among those of the filter."""
    slot = place_slots(doc, line, len(mask) << 6)
    return np.flatnonzero(mask[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))


def place_filter(places: DataFrame) -> np.ndarray:
    """A bit per slot that has a place (doc_id, line_no), at most FILTER_BITS; the driver gets no more than these."""
    bits = min(FILTER_BITS, 1 << max(12, (16 * places.count()).bit_length()))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(place_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))
            word = slot >> 6
            head, _ = runs(word)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), head) if len(head) else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[head]), pa.array(mask.view(np.int64))], names=["word", "mask"])

    t = places.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[t["word"].to_numpy()] = t["mask"].to_numpy().view(np.uint64)
    return out


def verified(pairs: DataFrame, docs: DataFrame, ranks: np.ndarray, tag: str) -> DataFrame:
    """The pairs (hub, at: places of lines) with Jaccard 0.8 or more, from the lines themselves.

    A filter of fixed size tells which lines to read; a line that it lets through by chance meets no pair.
    """
    places = materialize(pairs.select("hub.*").unionByName(pairs.select("at.*")).distinct(), f"{tag}-places")
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, place_filter(places)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, mask = shipped.value
        for batch in batches:
            for part in byte_slices(batch, 1):
                rows = pc.split_pattern(part.column(1), "\n")
                count = pc.list_value_length(rows).to_numpy()
                doc = np.repeat(part.column(0).to_numpy(), count)
                no = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
                some = in_filter(doc, no, mask)
                if not len(some):
                    continue
                data, edges = text_bytes(pc.utf8_lower(rows.flatten().take(pa.array(some))))
                word, hashes = hashed_words(data, edges)
                for line, n, codes in coded_sets(hashes, np.diff(np.searchsorted(word, edges)), ranks):
                    codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(codes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[some[line]]), pa.array(no[some[line]]), codes], names=["doc_id", "line_no", "codes"])

    own = docs.mapInArrow(run, "doc_id long, line_no int, codes array<long>")
    own = materialize(own.select(F.struct("doc_id", "line_no").alias("p"), "codes"), f"{tag}-codes")
    joined = pairs.join(own.select(F.col("p").alias("at"), F.col("codes").alias("x")), "at").join(own.select(F.col("p").alias("hub"), F.col("codes").alias("y")), "hub")
    both = F.size(F.array_intersect("x", "y"))
    good = materialize(joined.where(5 * both >= 4 * (F.size("x") + F.size("y") - both)).select("hub", "at").distinct(), f"{tag}-good")
    forget(places, own)
    return good


def dedup_lines(docs: DataFrame, least_tokens: int = 1, tag: str = "lines") -> DataFrame:
    """The documents, with all their columns, without their repeated lines (``repeated_lines``).

    The other lines keep their order; a document that loses every line goes as well. Rows with a null
    text or id stay as they are. Columns may have any names.
    """
    gone = repeated_lines(docs, least_tokens, tag)
    by_doc = materialize(gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("line_no").alias("lines")), f"{tag}-gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row).join(small(by_doc, "12 * size(lines) + 64"), F.col("row.doc_id").cast("long") == F.col("id"), "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("lines", i))
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    some = joined.where(F.col("lines").isNull() | F.col("row.text").isNull() | (F.size(kept) > 0))
    return some.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
