"""Near-duplicate records by word-set similarity: a T-occurrence search.

Two records of one block are alike when their word sets have a Jaccard
similarity of at least ``t``.  Then, of sizes p and q, their symmetric
difference holds at most ``(1 - t) / (1 + t) * (p + q)`` words.

Lists of single words are useless here, as most words stand in a tenth of all
records.  So the inverted lists are those of *cells*: the hashed words fall
into ``m`` cells, and what a record has in a cell is one element.  Each word
that differs spoils at most one cell, so of two alike records at least
``T = m - H`` cells are equal, ``H`` being the bound above.  That is a
T-occurrence problem, solved as DivideSkip does:

* the longest lists of a record, by the frequency of their words, are set aside;
  of the T common lists of two alike records as many as T less those set aside
  are among the short ones,
* the short lists are merged by sorting (key, record), in parallel by key, and the
  lists that two records have in common are counted; pairs with fewer than that
  many drop out,
* what was set aside is probed, for each pair met in a list, through a 128-bit
  parity sketch of all cells at once: its Hamming distance never exceeds the
  symmetric difference, so no alike pair is lost,
* pairs that are left pass a sketch of 512 bits of the same kind and are
  checked exactly on their words.

``m`` follows from the size class (steps of ``1 / t``) of the larger record; the
smaller one is in the same class or the one below, so each record is listed for
two classes.  Records with equal word sets are one class of copies throughout:
their rows in a list coincide and count once.  A list too long for one task is
cut into blocks that meet each other in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, drop, is_empty

#: Cells beyond H + 1, so that a record can leave out its longest lists.
SPARE = 2
#: Longest list merged in one task; longer ones are cut into blocks of about half that.
LONG = 8192
#: Records for each part of the lists.
RECORDS = 25_000
#: Buckets of the word frequencies that order the lists; a fixed number.
BUCKETS = 1 << 16

_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ _U(salt)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(text: Column) -> Column:
    """The distinct words of ``text``, separated by blanks, hashed and sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.xxhash64(w))))


class Classes:
    """Size classes of word sets for a similarity, in exact arithmetic."""

    def __init__(self, t: float):
        self.t = Fraction(str(t))
        if not 0 < self.t <= 1:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.lo = [1]
        while self.lo[-1] < 1 << 24:
            self.lo.append(max(self.lo[-1] + 1, math.floor(self.lo[-1] / self.t) + 1))
        self.low = np.array(self.lo, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def differ(self, both: np.ndarray) -> np.ndarray:
        """Most words in which alike sets of ``both`` words together can differ."""
        r = (1 - self.t) / (1 + self.t)
        return both * r.numerator // r.denominator

    def largest(self, n: np.ndarray) -> np.ndarray:
        """Largest set that can be alike one of n words."""
        return n * self.t.denominator // self.t.numerator


def _tokens(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(name)
    flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    off = col.offsets.to_numpy()
    return flat, np.diff(off)


def _sketches(flat: np.ndarray, size: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """Of each record, the parity of the number of its words on each of ``bits``
    bits: two sketches differ in no more bits than the sets in words."""
    odd = np.zeros((len(size), bits), np.uint8)
    np.add.at(odd, (np.repeat(np.arange(len(size)), size), (_mix(flat, salt) & _U(bits - 1)).astype(np.int64)), 1)
    return np.packbits(odd & 1, axis=1)


_SEEN = "idx {}, h long, size int, sketch binary, bucket int, n long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each record (idx, h, size and a sketch of 512 bits), and of each
    bucket the number of records in which a word of it occurs."""
    total = np.zeros(BUCKETS, np.int64)
    none = lambda n, t: pa.nulls(n, t)
    names = ["idx", "h", "size", "sketch", "bucket", "n"]
    kind = pa.int64()
    for b in batches:
        flat, size = _tokens(b, "toks")
        total += np.bincount((_mix(flat, 11) % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        k, kind = len(size), b.column("idx").type
        off = pa.py_buffer((np.arange(k + 1, dtype=np.int32) * 64).tobytes())
        sketch = pa.BinaryArray.from_buffers(pa.binary(), k, [None, off, pa.py_buffer(_sketches(flat, size, 512, 29).tobytes())])
        yield pa.RecordBatch.from_arrays([b.column("idx"), b.column("h"), pa.array(size.astype(np.int32)), sketch, none(k, pa.int32()), none(k, pa.int64())], names)
    at = np.nonzero(total)[0]
    k = len(at)
    if k:
        yield pa.RecordBatch.from_arrays([none(k, kind), none(k, pa.int64()), none(k, pa.int32()), none(k, pa.binary()), pa.array(at.astype(np.int32)), pa.array(total[at])], names)


def _frequencies(seen: DataFrame) -> np.ndarray:
    """Number of records in which a word of each bucket occurs, over all of them."""
    out = np.zeros(BUCKETS, np.int64)
    rows = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _near(t: float):
    """Keep the candidates (ha, hb, na, nb, sa, sb) whose longer sketches allow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classes(t)
        for b in batches:
            if not b.num_rows:
                continue
            s = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, 8) for k in ("sa", "sb")]
            d = np.bitwise_count(s[0] ^ s[1]).sum(1, dtype=np.int64)
            both = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
            yield b.select(["ha", "hb"]).filter(pa.array(d <= c.differ(both)))

    return run


def _emitter(t: float, freq: np.ndarray, spread: int):
    """Rows (part, h, n, s0, s1, role, keys) of the short lists of each record,
    those for one part of the shuffle packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classes(t)
        weight = -np.log((freq + 1.0) / (freq.max() + 1.0)) + 1e-3
        seen: set[int] = set()
        for b in batches:
            flat, size = _tokens(b, "toks")
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            # Copies within the task are listed once; others meet in the merge.
            _, first = np.unique(h, return_index=True)
            fresh = np.zeros(len(h), bool)
            fresh[first] = True
            fresh &= (size > 0) & np.fromiter((int(x) not in seen for x in h), bool, len(h))
            if len(seen) < 1 << 20:
                seen.update(h[fresh].tolist())
            if not fresh.any():
                continue
            pick = np.repeat(fresh, size)
            flat, h, n = flat[pick], h[fresh], size[fresh].astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            s = _sketches(flat, n, 128, 23).view(np.uint64)
            w = weight[(_mix(flat, 11) % _U(BUCKETS)).astype(np.int64)]
            base, own, value = _mix(flat, 37), c.of(n), _mix(flat, 53)
            outs = []
            for role in (0, 1):
                k = own + role
                top = c.low[k + 1] - 1
                use = np.ones(len(n), bool) if role == 0 else c.low[k] <= c.largest(n)
                m = c.differ(2 * top) + 1 + SPARE
                keep = _keep(c, n, top)
                first_cell = np.concatenate([[0], np.cumsum(m)])
                tot = int(first_cell[-1])
                at = first_cell[doc] + (base % m[doc].astype(np.uint64)).astype(np.int64)
                sig = np.zeros(tot, np.uint64)
                np.add.at(sig, at, value)
                rare = np.bincount(at, w, tot)
                d = np.repeat(np.arange(len(n)), m)
                cell = np.arange(tot) - first_cell[d]
                # A cell's key: block and class by way of h's block hash, place, content.
                key = _mix(sig + _mix((k[d].astype(np.uint64) << _U(20)) + cell.astype(np.uint64), 71), 0) ^ block_of(b, fresh)[d]
                order = np.lexsort((key, -np.round(rare, 6), d))
                rank = np.arange(tot) - first_cell[d]
                ok = (rank < keep[d]) & use[d]
                outs.append((d[ok], key[order][ok], np.full(int(ok.sum()), role)))
            d, key, role = (np.concatenate(x) for x in zip(*outs))
            part = (key % _U(spread)).astype(np.int64)
            order = np.lexsort((role, part, d))
            d, key, role, part = d[order], key[order], role[order], part[order]
            new = np.nonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)]))[0]
            off = np.concatenate([new, [len(d)]]).astype(np.int32) * 8
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(key.tobytes())])
            g = d[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[new].astype(np.int32)), pa.array(h[g].view(np.int64)), pa.array((n[g] * 2 + role[new]).astype(np.int32)), pa.array(s[g, 0].view(np.int64)), pa.array(s[g, 1].view(np.int64)), packed],
                ["part", "h", "size", "s0", "s1", "keys"],
            )

    def block_of(b: pa.RecordBatch, fresh: np.ndarray) -> np.ndarray:
        return _mix(b.column("block").to_numpy(zero_copy_only=False).view(np.uint64)[fresh], 97)

    return run


_LISTS = "part int, h long, size int, s0 long, s1 long, keys binary"
_MET = "ha long, hb long, met int, least int, key long, part int, h long, size int, s0 long, s1 long"


def _keep(c: Classes, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Short lists of sets of ``n`` words in a class up to ``top``: the other set is at
    most as large as the class and the similarity allow."""
    return c.differ(n + np.minimum(top, c.largest(n))) + 1


def _meet(t: float, h, size, role, s, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the index pairs left, right those that may be alike: rows of (ha, hb, lists
    in common here, lists they must have in common in all)."""
    c = Classes(t)
    d = np.bitwise_count(s[left, 0] ^ s[right, 0]).astype(np.int64) + np.bitwise_count(s[left, 1] ^ s[right, 1])
    p, q = size[left], size[right]
    # Two records listed for the class above their own meet in their own class.
    ok = (d <= c.differ(p + q)) & (np.maximum(p, q) <= c.largest(np.minimum(p, q))) & ((role[left] == 0) | (role[right] == 0)) & (h[left] != h[right])
    left, right, p, q = left[ok], right[ok], p[ok], q[ok]
    a, b = h[left].view(np.int64), h[right].view(np.int64)
    top = c.low[c.of(np.maximum(p, q)) + 1] - 1
    need = np.minimum(_keep(c, p, top), _keep(c, q, top)) - c.differ(p + q)
    rows, n = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), need], 1).reshape(-1, 3), axis=0, return_counts=True)
    return np.concatenate([rows[:, :2], n[:, None], rows[:, 2:]], 1)


def _run_pairs(lo: np.ndarray, ln: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs (start, length), at most ``most`` at a time or those of
    one member; a run that has more is taken member by member, over several times."""
    # each member with those after it in its run
    member = np.repeat(lo, ln) + np.arange(int(ln.sum())) - np.repeat(np.cumsum(ln) - ln, ln)
    after = np.repeat(lo + ln, ln) - member - 1
    upto = np.cumsum(after)
    done = 0
    while done < len(member):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + most, side="right")))
        m, n = member[done:stop], after[done:stop]
        left = np.repeat(m, n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        done = stop


def _merger(t: float, long: int):
    """Merge the lists of a part.  Runs longer than ``long`` are handed on, one
    row for each member, to be met in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        cols = {k: np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in ("part", "h", "size", "s0", "s1")}
        keys = np.concatenate([np.frombuffer(x.buffers()[2], np.uint64, count=int(o[-1] - o[0]) // 8, offset=int(o[0])) for x, o in ((b.column("keys"), np.frombuffer(b.column("keys").buffers()[1], np.int32)[b.column("keys").offset : b.column("keys").offset + b.num_rows + 1]) for b in got)])
        count = np.concatenate([np.diff(np.frombuffer(b.column("keys").buffers()[1], np.int32)[b.column("keys").offset : b.column("keys").offset + b.num_rows + 1]) for b in got]) // 8
        del got
        row = np.repeat(np.arange(len(count), dtype=np.int32), count)
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], row[order]
        h, s = cols["h"].view(np.uint64), np.stack([cols["s0"], cols["s1"]], 1).view(np.uint64)
        edge = np.concatenate([[True], keys[1:] != keys[:-1], [True]])
        ln = np.diff(np.nonzero(edge)[0])
        # only runs of two or more; copies in a run, equal in h, count once
        keep = np.repeat(ln > 1, ln)
        keys, row = keys[keep], row[keep]
        if not len(keys):
            return
        hh = h[row]
        order = np.lexsort((cols["size"][row] & 1, hh, keys))
        keys, row, hh = keys[order], row[order], hh[order]
        keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (hh[1:] != hh[:-1])])
        keys, row = keys[keep], row[keep]
        begin = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        ln = np.diff(np.concatenate([begin, [len(keys)]]))
        h, s, size, role = h[row], s[row], (cols["size"][row] >> 1).astype(np.int64), cols["size"][row] & 1
        sel = ln > long
        if sel.any():
            big = np.repeat(sel, ln)
            z = np.zeros(int(big.sum()), np.int64)
            yield _met(np.zeros((len(z), 4), np.int64), keys[big].view(np.int64), np.repeat(ln, ln)[big], h[big], cols["size"][row][big], s[big])
        for left, right in _run_pairs(begin[~sel & (ln > 1)], ln[~sel & (ln > 1)], 1 << 19):
            pairs = _meet(t, h, size, role, s, left, right)
            if len(pairs):
                z = np.zeros(len(pairs), np.int64)
                yield _met(pairs, z, z, z.view(np.uint64), z, np.zeros((len(pairs), 2), np.uint64))

    return run


def _met(pairs, key, part, h, size, s) -> pa.RecordBatch:
    i32 = lambda x: pa.array(np.asarray(x).astype(np.int32))
    i64 = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays([i64(pairs[:, 0]), i64(pairs[:, 1]), i32(pairs[:, 2]), i32(pairs[:, 3]), i64(key), i32(part), i64(h), i32(size), i64(s[:, 0]), i64(s[:, 1])], ["ha", "hb", "met", "least", "key", "part", "h", "size", "s0", "s1"])


def _long_lists(met: DataFrame, t: float, long: int) -> DataFrame:
    """(ha, hb, met, least) from lists that were cut: members fall into blocks by hash,
    and each pair of blocks is a task's group of its own."""
    half = max(1, long // 2)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("part") / half)).cast("int")
    m = met.where("part > 0").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "own", "h", "size", "s0", "s1")

    def meet(table: pa.Table) -> pa.Table:
        g = {k: table.column(k).to_numpy() for k in ("h", "size", "s0", "s1", "own", "i", "j")}
        h, s = g["h"].view(np.uint64), np.stack([g["s0"], g["s1"]], 1).view(np.uint64)
        size, role = (g["size"] >> 1).astype(np.int64), g["size"] & 1
        i, j = int(g["i"][0]), int(g["j"][0])
        x, y = np.nonzero(g["own"] == i)[0], np.nonzero(g["own"] == j)[0]
        out = []
        for at in range(0, len(x), 64):
            left, right = np.repeat(x[at : at + 64], len(y)), np.tile(y, len(x[at : at + 64]))
            if i == j:
                left, right = left[left < right], right[left < right]
            out.append(_meet(t, h, size, role, s, left, right))
        got = np.concatenate(out or [np.zeros((0, 4), np.int64)])
        return pa.table({k: pa.array(got[:, i].astype(kind)) for i, (k, kind) in enumerate((("ha", np.int64), ("hb", np.int64), ("met", np.int32), ("least", np.int32)))})

    return m.groupBy("key", "i", "j").applyInArrow(meet, "ha long, hb long, met int, least int")


def alike_sets(records: DataFrame, idx: str, block: str, text: str, t: float = 0.8, min_chars: int = 80, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the records whose word sets are alike.

    ``members`` has (idx, h) of each record that takes part: ``h`` is its class of
    copies, records of one block with the same words.  ``pairs`` has (ha, hb,
    common, words), ha < hb, of the classes with a similarity of at least ``t``, in
    full; copies aren't expanded into pairs.  Words are separated by blanks.

    A null idx, block or text, or a text of fewer than ``min_chars`` characters,
    takes no part, nor does a text of blanks only.  Repeated rows count once.
    Texts are used whole, however long.  Nothing but word frequencies in a fixed number of buckets reaches
    the driver.
    """
    spark = records.sparkSession
    base = records.select(F.col(idx).alias("idx"), F.col(block).cast("string").alias("b"), F.col(text).alias("text"))
    base = base.where(F.col("idx").isNotNull() & F.col("b").isNotNull() & (F.length("text") >= min_chars))
    docs = base.select("idx", F.xxhash64("b").alias("block"), word_hashes(F.col("text")).alias("toks"), "text").withColumn("h", F.xxhash64("block", "toks")).where(F.size("toks") > 0)
    kind = records.schema[idx].dataType.simpleString()
    # read three times; hashing the words again costs more than the table
    docs = cut(docs.select("idx", "h", "block", "toks"), "sets")
    seen = cut(docs.select("idx", "h", "toks").mapInArrow(_survey, _SEEN.format(kind)), "seen")
    freq = _frequencies(seen)
    # a part of the lists fits a task, whatever the number of shuffle partitions
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen.where("h is not null").count() // RECORDS))
    lists = docs.select("h", "block", "toks").mapInArrow(_emitter(t, freq, spread), _LISTS)
    met = cut(lists.repartitionById(spread, F.col("part")).mapInArrow(_merger(t, long), _MET), "met")
    cand = met.where("part = 0").select("ha", "hb", "met", "least")
    if not is_empty(met.where("part > 0")):
        cand = cand.unionByName(_long_lists(met, t, long))
    cand = cut(cand.groupBy("ha", "hb").agg(F.sum("met").alias("met"), F.max("least").alias("least")).where("met >= least").select("ha", "hb"), "cand")
    drop(met)
    members = seen.where("h is not null").select("idx", "h").distinct()
    sketch = seen.where("h is not null").groupBy("h").agg(F.first("size").alias("n"), F.first("sketch").alias("s"))
    one = cand.join(sketch.select(F.col("h").alias("ha"), F.col("n").alias("na"), F.col("s").alias("sa")), "ha")
    two = one.join(sketch.select(F.col("h").alias("hb"), F.col("n").alias("nb"), F.col("s").alias("sb")), "hb")
    wide = cand
    cand = cut(two.select("ha", "hb", "na", "nb", "sa", "sb").mapInArrow(_near(t), "ha long, hb long"), "near")
    drop(wide)
    # The exact check, on the words of one record of each class that is left.
    need = cand.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    words = docs.select("h", "toks").join(need, "h", "left_semi").dropDuplicates(["h"])
    one = cand.join(words.select(F.col("h").alias("ha"), F.col("toks").alias("ta")), "ha")
    two = one.join(words.select(F.col("h").alias("hb"), F.col("toks").alias("tb")), "hb")
    common = two.select("ha", "hb", F.size(F.array_intersect("ta", "tb")).alias("common"), F.size("ta").alias("na"), F.size("tb").alias("nb"))
    words_in_either = F.col("na") + F.col("nb") - F.col("common")
    f = Fraction(str(t))
    pairs = common.withColumn("words", words_in_either).where(F.col("common") * f.denominator >= F.col("words") * f.numerator)
    return members, pairs.select("ha", "hb", "common", "words")


def alike_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(idx_a, idx_b), idx_a < idx_b: every two records that are alike, copies
    included.  Of use only where all pairs are wanted."""
    a, b = members.select(F.col("idx").alias("x"), F.col("h").alias("ha")), members.select(F.col("idx").alias("y"), F.col("h").alias("hb"))
    across = pairs.join(a, "ha").join(b, "hb").select("x", "y")
    within = a.join(b, F.col("ha") == F.col("hb")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("idx_a"), F.greatest("x", "y").alias("idx_b")).where("idx_a < idx_b")
