"""SimHash near-duplicates: links between 64-bit fingerprints found by bit-sliced comparison.

Fingerprints are counted with DataFrame expressions. Distinct fingerprints are then dealt into pigeonhole buckets: the 64 bits
are cut into ``m`` blocks, and two fingerprints within ``radius`` bits agree on at least ``m - radius`` of them, so some table
of ``m - radius`` blocks puts them together. In a bucket, bit plane ``b`` holds bit ``b`` of 64 fingerprints in each word;
XOR with a query's bit and a carry-save counter update 64 distances at once, and words whose 64 distances all exceed the
radius are abandoned. A bucket reports a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import ROW, components, discard, keyed, lower_ascii, stash, steps_of, tidied, with_row, words

RADIUS = 4
SHINGLE = 4
#: Fingerprints of one bucket that a task compares at once; larger buckets are cut and their parts compared two by two.
PART = 8192


def vote_columns(h: Column, tag: str = "v") -> list[Column]:
    """32 sums that count each bit of ``h``: bit j in the low half of sum j, bit j + 32 in its high half (2**31 terms at most)."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0000000100000001))).alias(f"{tag}{j}") for j in range(32)]


def majority(total: Column, tag: str = "v") -> Column:
    """The 64-bit number whose bit is 1 where over half of ``total`` votes set it."""
    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"{tag}{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"{tag}{j}"), 32)
        top = (1 << (j + 32)) - (1 << 64 if j == 31 else 0)
        out = out.bitwiseOR(F.when(low * 2 > total, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
        out = out.bitwiseOR(F.when(high * 2 > total, F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``_row``, the ``keep`` columns and ``fp`` (long) for each row; texts without words (null, empty) get 0."""
    p = F.col("_p")
    joined = F.concat_ws(" ", *[F.get("_w", p + i if i else p) for i in range(shingle)])
    hashed = (
        keyed(docs.select(*keep, F.col(text).alias("_t"))).select("_row", *keep, words(lower_ascii(F.col("_t"))).alias("_w"))
        .select("_row", *keep, "_w", F.size("_w").alias("_n"), F.posexplode("_w").alias("_p", "_x"))
        .where((p == 0) | (p + (shingle - 1) < F.col("_n")))
        .select("_row", *keep, ((F.col("_n") == 1) & (F.col("_x") == "")).alias("_none"), F.xxhash64(joined).alias("_h"))
    )
    hashed = hashed.select("_row", *keep, F.when(F.col("_none"), F.lit(0).cast("long")).otherwise(F.col("_h")).alias("_h"))
    counted = hashed.groupBy("_row", *keep).agg(F.count("*").alias("_total"), *vote_columns(F.col("_h")))
    return counted.select("_row", *keep, majority(F.col("_total")).alias("fp"))


def tables_for(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Tables of (shift, width) blocks for ``n`` fingerprints: more blocks, and so smaller buckets, as ``n`` grows."""
    blocks = radius + 1
    while blocks < 2 * radius and n >> (64 * (blocks - radius) // blocks) > 2048:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return [list(x) for x in combinations(own, blocks - radius)]


def bucket_keys(fp: Column, tables: list[list[tuple[int, int]]]) -> Column:
    """One long for each table: the table's number over the bits of its blocks."""
    out = []
    for k, blocks in enumerate(tables):
        key = F.lit(k).cast("long")
        for shift, width in blocks:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(key)
    return F.array(*out)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w in plane b is bit b of fingerprint 64 w + i."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    words = np.packbits(bits.T.reshape(64, n // 64, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(words).view(np.uint64).reshape(64, n // 64)


def within(planes: np.ndarray, queries: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (query, word) pairs those with a fingerprint within the radius, and a word whose set bits say which.

    ``planes``: (64 x parts, words); ``queries``: (parts, pairs), or (pairs,) for fingerprints of one part.
    """
    queries = np.atleast_2d(queries)
    width = max(1, radius.bit_length())
    at = np.arange(queries.shape[1])
    sums = [np.zeros(len(at), np.uint64) for _ in range(width)]
    over = np.zeros(len(at), np.uint64)
    for b in range(len(planes)):
        carry = planes[b][word] ^ (np.uint64(0) - ((queries[b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
        for s in sums:
            s_and = s & carry
            s ^= carry
            carry = s_and
        over |= carry
        if b % 8 == 7:
            # A counter that has passed the radius stays beyond it; compare bit by bit from the top.
            more, same = np.zeros_like(over), ~np.zeros_like(over)
            for i in reversed(range(width)):
                if radius >> i & 1:
                    same = same & sums[i]
                else:
                    more = more | (same & sums[i])
                    same = same & ~sums[i]
            open_ = ~(over | more)
            keep = np.flatnonzero(open_)
            if b == len(planes) - 1:
                return at[keep], open_[keep]
            if len(keep) < len(at):
                at, word, queries, over = at[keep], word[keep], queries[:, keep], over[keep]
                sums = [s[keep] for s in sums]
    raise AssertionError


def pairs_within(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller row, larger row) of one bucket within the radius, some at a time. ``fps``: (parts, rows); rows of bucket i
    are ``starts[i]:ends[i]``."""
    planes = np.concatenate([bit_planes(f) for f in fps])
    end = np.repeat(ends, ends - starts)
    rows = np.repeat(starts, ends - starts) + np.arange(len(end)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    first = (rows + 1) >> 6
    count = np.where(rows + 1 < end, ((end - 1) >> 6) - first + 1, 0)
    rows, first, count, end = rows[count > 0], first[count > 0], count[count > 0], end[count > 0]
    cuts = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + step, "right")) - 1)
        c = count[lo:hi]
        who = np.repeat(np.arange(lo, hi), c)
        word = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(c) - c, c)
        at, bits = within(planes, fps[:, rows[who]], word, radius)
        lanes = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(lanes)
        u, v = rows[who[at[i]]], word[at[i]] * 64 + lane
        ok = (v > u) & (v < end[who[at[i]]])
        yield u[ok], v[ok]
        lo = hi


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = parent[x]
        if np.array_equal(x, y):
            return x
        x = y


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    while len(u):
        ru, rv = _root(parent, u), _root(parent, v)
        differ = ru != rv
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        if len(u):
            np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))


def forest(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Row -> smallest row linked to it in its bucket."""
    parent = np.arange(fps.shape[-1])
    for u, v in pairs_within(np.atleast_2d(fps), starts, ends, radius):
        _unite(parent, u, v)
    return _root(parent, parent)


def closest_forest(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the links of a minimum spanning forest by ``d``: it joins, at each distance, what all links up to it join."""
    rank = np.empty(len(d), np.int64)
    rank[np.argsort(d, kind="stable")] = np.arange(len(d))
    parent, chosen, left = np.arange(n), [], np.arange(len(d))
    while len(left):
        ru, rv = _root(parent, u[left]), _root(parent, v[left])
        differ = ru != rv
        left, ru, rv = left[differ], ru[differ], rv[differ]
        if len(left):
            best = np.full(n, len(d))
            np.minimum.at(best, ru, rank[left])
            np.minimum.at(best, rv, rank[left])
            take = left[(best[ru] == rank[left]) | (best[rv] == rank[left])]
            chosen.append(take)
            _unite(parent, u[take], v[take])
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int = 0) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows sorted by ``key``, some whole buckets (of ``rows`` rows in all, or a few more) at a time: the columns, and where the
    buckets of two rows or more start and end."""

    def cut(keys: np.ndarray, rest: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        many = ends - starts > 1
        return rest, starts[many], ends[many]

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", *columns)])
        size += batch.num_rows
        if size >= (rows or 4 * PART):
            keys, *rest = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on
            if last:
                yield cut(keys[:last], [x[:last] for x in rest])
            held, size = [[keys[last:], *[x[last:] for x in rest]]], len(keys) - last
    if size:
        keys, *rest = (np.concatenate(x) for x in zip(*held))
        yield cut(keys, rest)


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for (fps,), starts, ends in _buckets(batches, ("fp",)):
        to = forest(fps.view(np.uint64), starts, ends, radius)
        own = np.flatnonzero(to != np.arange(len(to)))
        yield pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[to[own]])], names=["a", "b"])


def _close_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for (node, fp, fp2), starts, ends in _buckets(batches, ("node", "fp", "fp2")):
        fps = np.stack([fp.view(np.uint64), fp2.view(np.uint64)])
        u, v, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for more_u, more_v in pairs_within(fps, starts, ends, radius):
            u, v = np.concatenate([u, more_u]), np.concatenate([v, more_v])
            d = np.concatenate([d, np.bitwise_count(fps[:, more_u] ^ fps[:, more_v]).sum(axis=0, dtype=np.int64)])
            keep = closest_forest(len(node), u, v, d)  # never more than a link a row is held from one step to the next
            u, v, d = u[keep], v[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[u], node[v])), pa.array(np.minimum(node[u], node[v]))], names=["a", "b"])


def _open_rows(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows with another within the radius to which no confirmed link joins them, unless the forest of their bucket had all such pairs."""
    names = ["key", "node", "root", "fp", "fp2"]
    for columns, starts, ends in _buckets(batches, tuple(names)):
        root, n = columns[2], len(columns[2])
        fps = np.stack([columns[3].view(np.uint64), columns[4].view(np.uint64)])
        parent, pairs, apart = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
        for u, v in pairs_within(fps, starts, ends, radius):
            _unite(parent, u, v)
            pairs += np.bincount(u, minlength=n)
            differ = root[u] != root[v]
            apart[u[differ]] = apart[v[differ]] = True
        top = _root(parent, parent)
        left_out = np.bincount(top, pairs, n) >= np.bincount(top, minlength=n)  # more pairs than a forest has
        # The parts of a large bucket may have been other parts before.
        crowded = np.repeat(ends - starts >= PART // 4, ends - starts)
        left_out = left_out[top]
        left_out[np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts) + np.arange(len(crowded))] |= crowded
        own = np.flatnonzero(apart & left_out)
        yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in columns], names=names)


def _confirmed_links(batches: Iterator[pa.RecordBatch], radius: int, similarity: float, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Links between rows whose sets ``s`` are similar, of all pairs within the radius but those that confirmed links join already."""
    for (node, root, fp, fp2, sets), starts, ends in _buckets(batches, ("node", "root", "fp", "fp2", "s"), PART // 4):
        fps = np.stack([fp.view(np.uint64), fp2.view(np.uint64)])
        size = np.array([len(x) for x in sets])
        begin = np.cumsum(size) - size
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(len(flat), np.int64)
        _, first, place = np.unique(root, return_index=True, return_inverse=True)
        parent, a, b = first[place], [], []
        for u, v in pairs_within(fps, starts, ends, radius):
            cuts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(u))):
                x, others = u[lo], v[lo:hi]
                mine = flat[begin[x] : begin[x] + size[x]]
                mark[mine] = 1
                while len(others):
                    others = others[_root(parent, others) != _root(parent, x)]
                    now = others[: max(1, int(np.searchsorted(np.cumsum(size[others]), most)))]
                    others = others[len(now) :]
                    if len(now):
                        at = np.cumsum(size[now]) - size[now]
                        both = np.add.reduceat(mark[flat[np.repeat(begin[now] - at, size[now]) + np.arange(size[now].sum())]], at)
                        now = now[both >= similarity * (size[x] + size[now] - both)]
                        now = now[np.unique(_root(parent, now), return_index=True)[1]]
                        a.append(np.maximum(node[now], node[x]))
                        b.append(np.minimum(node[now], node[x]))
                        _unite(parent, np.full(len(now), x), now)
                mark[mine] = 0
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in (a, b)], names=["a", "b"])


def in_buckets(rows: DataFrame, keys: Column, by: str) -> DataFrame:
    """``rows`` with ``key``, once for each of the bucket ``keys`` (an array of longs), dealt and sorted by it.

    A bucket of over ``PART`` rows is cut into parts by a hash of ``by``; each two parts meet in a group of their own, so a task
    holds two parts at most and no pair is lost.
    """
    dealt = rows.select("*", F.explode(keys).alias("k"))
    large = dealt.groupBy("k").count().where(F.col("count") > PART).select("k", F.ceil(F.col("count") / (PART // 2)).cast("int").alias("n"))
    large = stash(large, "large")  # written first: if it is small, as it is unless data are crowded, the join below needs no shuffle
    own = F.pmod(F.xxhash64(by), F.col("n")).cast("int")
    parts = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce(F.col("n"), F.lit(1)) - 1), lambda o: (F.least(own, o) * F.col("n") + F.greatest(own, o)).cast("long"))
    )
    dealt = dealt.join(large, "k", "left").select(*rows.columns, "k", F.explode(parts).alias("p"))
    # One number for bucket and parts: buckets that this mixes are compared as one, which adds no false link.
    dealt = dealt.select(*rows.columns, F.when(F.col("p") == 0, F.col("k")).otherwise(F.xxhash64("k", "p")).alias("key"))
    return dealt.repartition("key").sortWithinPartitions("key")


def link_components(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` for the fingerprints of ``distinct(fp)`` that are linked to a smaller one, directly or over others."""
    dealt = in_buckets(distinct.select("fp"), bucket_keys(F.col("fp"), tables_for(distinct.count(), radius)), "fp")
    edges = dealt.mapInArrow(lambda it: _links(it, radius), "a long, b long")
    return components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``_row, doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay rows; ``component_id`` is the
    smallest non-null doc_id reachable (null if none); long texts are fingerprinted whole; other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    prints = stash(fingerprints(docs), "fp")
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = link_components(distinct.select("fp"), radius)
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(named.join(least, "root").select("fp", "component_id"), "named")
    discard(distinct)
    return prints.join(named, "fp").select("_row", "doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Least hashes of a shingle set in a bucket key, and bucket keys: sets of similarity 0.8 share a key with probability 0.991
#: (1 - (1 - 0.8**4)**9), more similar ones more surely, and unrelated ones never, however many rows there are.
BAND, BANDS = 4, 9


_U = np.uint64
#: Of each byte, its bits as the bytes of a number: sums of up to 255 of them count eight bits at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(_U).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _majorities(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each stretch of hashes the number whose bit is 1 where over half of them set it."""
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(starts, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    parts = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    set_ = np.empty((len(starts), 64), bool)
    for k in range(8):
        counts = np.add.reduceat(_SPREAD[parts[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        set_[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(counts, first, axis=0, dtype=np.int64) > sizes[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


def _band_keys(h: np.ndarray, starts: np.ndarray, seed: int = 2) -> np.ndarray:
    """(sets, ``BANDS``): for each of ``BAND * BANDS`` random numbers the member nearest to it by exclusive or, ``BAND`` in a key. Two
    sets agree on such a member as often as a member of their union is one of both."""
    out = np.empty((len(starts), BANDS), _U)
    for k, masks in enumerate(np.random.default_rng(seed).integers(0, 1 << 63, (BANDS, BAND)).astype(_U) * _U(2) + _U(1)):
        key = np.full(len(starts), k, _U)
        for m in masks:
            key = _mixed(key + np.minimum.reduceat(h ^ m, starts))
        out[:, k] = key
    return out


def _shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as hashes, sorted within the text, one text's after another's; and how many are each text's. A text
    of fewer words has the whole sequence, one of none has one hash that no shingle has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, n = split.flatten(), np.diff(split.offsets.to_numpy()).astype(np.int64)
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if blank.any():  # at the ends of a text
        n -= np.bincount(np.repeat(np.arange(len(n)), n), blank, len(n)).astype(np.int64)
        words = words.filter(pa.array(~blank))
    coded = words.cast(pa.binary()).dictionary_encode()
    own = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), _U, len(coded.dictionary))
    w = np.concatenate([own[coded.indices.to_numpy()] if len(words) else own, np.zeros(shingle, _U)])
    many = np.maximum(n - shingle + 1, 1)  # shingles, repeats included
    ends = np.cumsum(many)
    row = np.repeat(np.arange(len(n)), many)
    at = (np.cumsum(n) - n)[row] + np.arange(int(ends[-1]) if len(ends) else 0) - (ends - many)[row]
    h = np.zeros(len(at), _U)
    for j in range(shingle):
        h = _mixed(h + np.where(j < n[row], w[at + j], _U(0)) + _U(j))
    # A text's number and 51 bits of the hash make a key: its sorted order brings repeats together.
    keys = row.astype(_U) << _U(51) | np.where(n[row] > 0, h >> _U(13), _U(0))
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return _mixed(keys & _U((1 << 51) - 1)), np.bincount((keys >> _U(51)).astype(np.int64), minlength=len(n))


def _set_prints(batches: Iterator[pa.RecordBatch], shingle: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in steps_of(whole, "text", 1 << 22, 1 << 12):
            h, n = _shingle_hashes(batch.column("text").fill_null(""), shingle)
            starts = np.cumsum(n) - n
            more = _mixed(h + _U(1))
            signed = lambda x: pa.array(x.astype(_U).view(np.int64))
            keys = pa.ListArray.from_arrays(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32), signed(_band_keys(h, starts).ravel()))
            made = [_majorities(h, starts, n), _majorities(more, starts, n), n, np.bitwise_xor.reduceat(h, starts), np.bitwise_xor.reduceat(more, starts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(signed, made), keys], names=[*kept, "fp", "fp2", "n", "x", "y", "keys"])


def shingle_sets(rows: DataFrame, shingle: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_row``, the ``keep`` columns and ``s`` of ``rows(_row, text)``: distinct hashes of a text's shingles; of the whole sequence
    where it has fewer words; 0 alone where it has none.

    The words are the column of a generator: a lambda over an expression would split the text again for each shingle.
    """
    split = rows.select("_row", *keep, F.explode(F.array(words(lower_ascii(F.col("text"))))).alias("_w"))
    hashed = lambda p: F.xxhash64(F.concat_ws(" ", *[F.get("_w", p + i if i else p) for i in range(shingle)]))
    at = F.sequence(F.lit(0), F.greatest(F.size("_w") - shingle, F.lit(0)))
    none = (F.size("_w") == 1) & (F.get("_w", F.lit(0)) == "")
    return split.select("_row", *keep, F.when(none, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(at, hashed))).alias("s"))


def set_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``ROW``, ``fp, fp2, n, x, y`` and ``keys`` for each row of ``docs(doc_id, text)``: 128 bits (``fp2`` from the hashes
    of the hashes) to which each distinct shingle of a text adds one vote, so that they tell how alike the sets are, however often a line
    is repeated; ``n, x, y`` (size, and 128 bits of all members) are equal for equal sets alone; ``keys``: the bucket keys of the set."""
    kept = ["doc_id", *ROW]
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    made = "_none boolean, _id long, _t1 long, _t2 long, fp long, fp2 long, n long, x long, y long, keys array<long>"
    return rows.mapInArrow(lambda it: tidied(_set_prints(it, shingle, kept)), f"doc_id long, {made}")


def radius_of(similarity: float) -> int:
    """Bits of 128 within which 99.9% of pairs of sets of this similarity lie (of one size; others lie nearer than their share of common
    members says)."""
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(128 * differ + 3.1 * (128 * differ * (1 - differ)) ** 0.5))


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``doc_id``, ``ROW``, ``root`` for each row of ``docs(doc_id, text)``: rows of one ``root`` are joined by links between texts
    whose sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or more.

    Sets that agree on ``BAND`` least hashes meet in a bucket, in ``BANDS`` tables at any number of rows. There 128-bit fingerprints
    propose links: rows within the radius that such a pair keeps are joined by a minimum spanning forest, closest first. Each proposed
    link is then confirmed on the texts' shingles. Where links fail, the forest may have kept them in place of true ones: rows beside a
    failed link meet in their buckets again, with their sets, and each pair within the radius is compared that no confirmed link joins by
    then. Equal sets (so also null and empty texts) are one node; different texts of equal fingerprints are confirmed like others.
    """
    prints = stash(set_fingerprints(docs, shingle), "fp")
    same, row = ["fp", "fp2", "n", "x", "y"], F.struct(*ROW)
    # The number of a node is written with it; one row of the node stands for its text.
    nodes = prints.groupBy(*same).agg(F.min(row).alias("at"), F.any_value("keys").alias("keys"))
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    radius = radius_of(similarity)
    dealt = in_buckets(nodes.select("node", "fp", "fp2", "keys"), F.col("keys"), "node").select("key", "node", "fp", "fp2")
    proposed = stash(dealt.mapInArrow(lambda it: _close_links(it, radius), "a long, b long").distinct(), "proposed")
    named = nodes.join(proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "at.*")
    texts = with_row(docs.select("doc_id", "text")).join(named, ROW).select(F.col("node").alias("_row"), "text")
    sets = stash(shingle_sets(texts, shingle).dropDuplicates(["_row"]), "sets")  # repeated rows have one set
    met = proposed.join(sets.select(F.col("_row").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("_row").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = stash(met.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    roots = components(links)
    rooted = stash(nodes.join(roots, "node", "left").select("node", "fp", "fp2", "keys", F.coalesce("root", "node").alias("root")), "rooted")
    discard(roots)
    ends = [rooted.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    failed = proposed.join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select(F.explode(F.array("ra", "rb")).alias("root")).distinct()
    again = stash(rooted.join(failed, "root", "left_semi").select("node", "root", "fp", "fp2", "keys"), "again")
    beside = in_buckets(again, F.col("keys"), "node").select("key", "node", "root", "fp", "fp2")
    open_ = stash(beside.mapInArrow(lambda it: _open_rows(it, radius), "key long, node long, root long, fp long, fp2 long"), "open")
    met = open_.join(sets.select(F.col("_row").alias("node"), "s"), "node").repartition("key").sortWithinPartitions("key")
    more = met.mapInArrow(lambda it: _confirmed_links(it, radius, similarity), "a long, b long")
    roots = components(links.unionByName(more))
    named = nodes.join(roots, "node", "left").select(*same, F.coalesce("root", "node").alias("root"))
    out = stash(prints.join(named, same).select("doc_id", *ROW, "root"), "similar")
    for df in (prints, nodes, proposed, sets, links, rooted, again, open_, roots):
        discard(df)
    return out


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, one of each group of similar texts: that with the smallest doc_id (null last; of repeated rows one).

    Texts without words (null, empty, blank) are one group; one of fewer than five words is one shingle; long texts are compared whole;
    columns stay as they were, whatever their names; an empty table gives no rows.
    """
    first = similar_components(docs, similarity, shingle).groupBy("root").agg(F.min(F.struct(*ROW)).alias("at")).select("at.*")
    # Columns of the input may have these names: they travel in a struct.
    rows = with_row(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_all"))).join(first, ROW)
    one = F.row_number().over(Window.partitionBy(*ROW).orderBy("_t1"))
    return rows.select("_all", one.alias("_one")).where("_one = 1").select("_all.*")


def query(spark, sf_dir: str) -> DataFrame:
    from docloom.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
