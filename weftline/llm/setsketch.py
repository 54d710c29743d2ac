"""Near-duplicate texts: SetSketch registers, banded, estimated jointly by likelihood, verified on full sets.

A document's set holds its distinct five-word shingles. A SetSketch register is floor(1 - log_b x), clipped to
0..q+1, of the least of exponential variates x that the set's elements draw; registers of a union are the maxima of
the parts' registers. With base b near 1 two sets agree in a register with a probability close to their Jaccard
similarity. Registers are cut into bands; sets that agree in a band are candidates.

Equal sets are one class, whatever their number. No bucket's pairs are written out: each bucket has a pseudo-random
leader, (leader, member) pairs are weighed by the joint likelihood of their registers, and each class first verifies
one likely partner on the full sets. Where many members of buckets are then still in different components, a member of
another component leads, and so on. In the buckets that stay apart all pairs between components are weighed inside
tasks, in blocks of a bounded number of sketches; members with a likely partner then meet again with their
texts, once a block, and the likely pairs are verified there. So every link between texts that share a band is found or implied.

With the defaults (40 bands of 5) a pair of similarity 0.75 shares no band with probability 2e-5.

Defined cases: a null text, or one without words, has an empty set and links with nothing; with fewer than five words
the whole sequence is the one element; rows with one doc_id are one document (linked if any of its rows is); rows
with a null doc_id are kept and link with nothing; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bytes_np import U64, mix, shingle_sets
from weftline.llm.common import connected_components, release, written
from weftline.llm.vectors import blocks, by_block, spread_blocks

WORDS = 5
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Shares of the buckets, by their keys, that are made one after the other: disk holds the shuffles of one.
SHARES = 4
#: Classes of a bucket that one block holds at most, about.
BLOCK = 1024
#: Signs of each register for the first weighing inside a block.
BITS = 4
#: Times that other leaders are tried at most before blocks.
ROUNDS = 3
#: Base, rate and largest register of the sketch; 16 bits a register.
B, A, Q = 1.001, 20.0, 65534
FACTORS = mix(np.arange(REGISTERS, dtype=U64), 11) | U64(1)
SHIFTS = mix(np.arange(REGISTERS, dtype=U64), 12)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for the empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(hashes), 512):
        drawn = hashes[None, i : i + 512] * FACTORS[:, None]
        drawn += SHIFTS[:, None]
        np.minimum(least, drawn.min(axis=1), out=least)
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def likely_similarity(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of pairs of sets, from registers and set sizes."""
    more, less = (u > v).sum(axis=1), (u < v).sum(axis=1)
    same = u.shape[1] - more - less
    share_u, share_v = nu / (nu + nv), nv / (nu + nv)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in np.linspace(0, 1, 101):
        up, down = p(share_u - share_v * j), p(share_v - share_u * j)
        like = more * np.log(np.maximum(up, 1e-9)) + less * np.log(np.maximum(down, 1e-9)) + same * np.log(np.maximum(1 - up - down, 1e-9))
        better = like > best
        best[better], at[better] = like[better], j
    return at


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, s1, s2, regs = [], [], [], []
        for h in shingle_sets(batch.column(1), WORDS):
            n.append(len(h))
            s1.append(mix(h, 1).sum(dtype=U64))
            s2.append(mix(h, 2).sum(dtype=U64))
            regs.append(registers(h).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(s, U64).view(np.int64)) for s in (s1, s2)), pa.array(regs, pa.binary())],
            ["doc_id", "n_shingles", "s1", "s2", "registers"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, registers) -> (cid, key, tab): a row for each band."""
    factors = mix(np.arange(REGISTERS, dtype=U64), 21) | U64(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.stack([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]).astype(U64)
        keys = mix((mix(regs) * factors).reshape(len(regs), BANDS, ROWS).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64), 22)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(regs)))],
            ["cid", "key", "tab"],
        )


def _members(classes: DataFrame) -> list[DataFrame]:
    """Tables (key, cid, tab, lead): the classes in buckets of several, and each bucket's leader. A bucket's rows are
    dealt by its key, whatever their bands."""
    out = []
    for share in range(SHARES):
        bands = classes.select("cid", "registers").mapInArrow(_bands, "cid long, key long, tab int").where(F.pmod("key", F.lit(SHARES)) == share)
        leads = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("l"), F.max("cid").alias("x"), F.min("cid").alias("y"))
        leads = leads.where("x <> y").select("key", F.col("l.cid").alias("lead"))
        # written as joined, so that a hot key's rows can be split; ids of several texts may repeat until `placed`
        out.append(written(bands.join(leads.hint("merge"), "key"), "members"))
    return out


def _estimates(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, threshold: float) -> np.ndarray:
    """Joint estimates, 0 where sizes or agreeing registers leave no chance of `threshold`."""
    out = np.zeros(len(u))
    some = np.flatnonzero((np.minimum(nu, nv) >= 0.75 * np.maximum(nu, nv)) & ((u == v).sum(axis=1) >= (threshold - 0.2) * REGISTERS))
    if len(some):
        out[some] = likely_similarity(u[some], v[some], nu[some].astype(float), nv[some].astype(float))
    return out


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _weighed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, ra, rb = batch.columns
            found = _estimates(_sketch_matrix(ra), _sketch_matrix(rb), na.to_numpy(), nb.to_numpy(), threshold)
            keep = pa.array(found >= threshold)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(found).filter(keep)], ["a", "b", "likely"])

    return run


def _signs(regs: np.ndarray) -> np.ndarray:
    """BITS pseudo-random signs of each register: the mean product of two rows estimates how many registers agree."""
    words = mix(regs.astype(U64) * U64(REGISTERS) + np.arange(REGISTERS, dtype=U64), 41)
    signs = [((words >> U64(j)) & U64(1)).astype(np.float32) * 2 - 1 for j in range(BITS)]
    return np.concatenate(signs, axis=1)


def similar(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= 75 * union, the intersection not empty."""
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= 75 * (len(both) - shared)


def _across(threshold: float):
    """Blocks of buckets -> those of their rows that have a likely partner in another component: never more than a block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in blocks(batches):
            comp, n, side, tab = (table.column(c).to_numpy() for c in ("comp", "n_shingles", "side", "tab"))
            regs, us, vs, waiting = _sketch_matrix(table.column("registers").combine_chunks()), [], [], 0
            chosen = np.zeros(len(regs), bool)

            def likely(us=us, vs=vs, n=n, regs=regs, chosen=chosen):
                u, v = np.concatenate(us), np.concatenate(vs)
                hit = _estimates(regs[u], regs[v], n[u], n[v], threshold) >= threshold
                chosen[u[hit]] = chosen[v[hit]] = True
                us.clear(), vs.clear()

            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                if b - a <= 32:
                    p, q = np.triu_indices(b - a, 1)
                else:
                    bits = _signs(regs[a:b])
                    p, q = np.nonzero(np.triu(bits @ bits.T, 1) >= (threshold - 0.05) * bits.shape[1])
                p, q = a + p, a + q
                once = comp[p] != comp[q]
                if side[a:b].any():
                    once &= side[p] != side[q]
                p, q = p[once], q[once]
                for i in range(0, len(p), 4096):
                    u, v = p[i : i + 4096], q[i : i + 4096]
                    earlier = (regs[u, : tab[a] * ROWS] == regs[v, : tab[a] * ROWS]).reshape(len(u), tab[a], ROWS)
                    new = ~earlier.all(axis=2).any(axis=1)
                    us.append(u[new])
                    vs.append(v[new])
                    waiting += int(new.sum())
                    if waiting >= 4096:
                        likely()
                        waiting = 0
            if waiting:
                likely()
            yield from table.filter(pa.array(chosen)).to_batches()

    return run


def _joined(threshold: float):
    """Blocks of buckets -> links that join different components: every pair of a block that no earlier band holds is
    either verified on the full sets, too unlikely, or already joined inside the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in blocks(batches):
            cid, comp, n, side, tab = (table.column(c).to_numpy() for c in ("cid", "comp", "n_shingles", "side", "tab"))
            all_regs, texts, xs, ys = table.column("registers").combine_chunks(), table.column("text").combine_chunks(), [], []
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                size = n[a:b].astype(float)
                regs, half = _sketch_matrix(all_regs.slice(a, b - a)), side[a:b]
                bits, root = _signs(regs), {}
                p, q = np.nonzero(bits @ bits.T >= (threshold - 0.05) * bits.shape[1])
                once = (p < q) & (comp[a:b][p] != comp[a:b][q]) & (np.minimum(size[p], size[q]) >= 0.75 * np.maximum(size[p], size[q]))
                if (half != 0).any():
                    once &= half[p] != half[q]
                p, q = p[once], q[once]
                if not len(p):
                    continue
                earlier = (regs[:, : tab[a] * ROWS]).reshape(b - a, tab[a], ROWS)
                sets: dict[int, np.ndarray] = {}
                for i in range(0, len(p), 4096):
                    u, v = p[i : i + 4096], q[i : i + 4096]
                    new = ~(earlier[u] == earlier[v]).all(axis=2).any(axis=1)
                    u, v = u[new], v[new]
                    hit = likely_similarity(regs[u], regs[v], size[u], size[v]) >= threshold if len(u) else np.zeros(0, bool)
                    for x, y in zip(u[hit].tolist(), v[hit].tolist(), strict=True):
                        rx, ry = comp[a + x], comp[a + y]
                        while rx in root:
                            rx = root[rx]
                        while ry in root:
                            ry = root[ry]
                        if rx == ry:
                            continue
                        for z in (x, y):
                            if z not in sets:
                                sets[z] = next(shingle_sets(texts.slice(a + z, 1), WORDS))
                        if similar(sets[x], sets[y]):
                            root[max(rx, ry)] = min(rx, ry)
                            xs.append(cid[a + x])
                            ys.append(cid[a + y])
            if xs:
                x, y = np.array(xs), np.array(ys)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> the pairs whose full sets are similar."""
    for batch in batches:
        keep = [similar(u, v) for u, v in zip(shingle_sets(batch.column(2), WORDS), shingle_sets(batch.column(3), WORDS), strict=True)]
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar. Only texts of the pairs' members are kept and shuffled
    again; where the pairs are few, Spark sends their ids to the texts."""
    pairs = written(pairs, "pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "wanted")
    texts = written(docs.select(F.col("doc_id").alias("cid"), "text").join(wanted, "cid", "left_semi"), "texts")
    full = (
        pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
        .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
        .select("a", "b", "ta", "tb")
    )
    links = written(full.mapInArrow(_verified, "a long, b long").distinct(), "links")
    for used in (pairs, wanted, texts):
        release(used)
    return links


def _star_links(stars: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links among pairs (a, b) of a leader and a member: each class that has likely partners verifies one, where it can
    one that many others verify too."""
    side = lambda n: classes.select(F.col("cid").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("registers").alias(f"r{n}")).hint("merge")
    weighed = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    likely = written(weighed.mapInArrow(_weighed(threshold), "a long, b long, likely double"), "likely")
    both = likely.select(F.col("a").alias("x"), F.col("b").alias("y"), "likely").unionAll(likely.select(F.col("b").alias("x"), F.col("a").alias("y"), "likely"))
    picks = both.groupBy("x").agg(F.min(F.struct(F.col("likely") < 0.8, F.xxhash64("y"), F.col("y").alias("y"))).alias("p"))
    links = _links(picks.select(F.least("x", "p.y").alias("a"), F.greatest("x", "p.y").alias("b")).distinct(), docs)
    release(likely)
    return links


def _block_links(placed: DataFrame, apart: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links that join the components inside buckets: all pairs between components are weighed, in blocks."""
    apart = apart.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    spread = spread_blocks(placed.join(apart, "key"), ["tab", "cid", "comp"])
    spread = spread.join(classes.select("cid", "n_shingles", "registers").hint("merge"), "cid")
    spread = spread.select("block", "cid", "comp", "side", "tab", "n_shingles", "registers")
    some = written(by_block(spread).mapInArrow(_across(threshold), "block long, cid long, comp long, side int, tab int, n_shingles long, registers binary"), "some")
    wanted = written(some.select("cid").distinct(), "wanted")
    texts = written(docs.select(F.col("doc_id").alias("cid"), "text").join(wanted, "cid", "left_semi"), "texts")
    links = written(by_block(some.join(texts.hint("merge"), "cid")).mapInArrow(_joined(threshold), "a long, b long").distinct(), "links")
    for used in (some, wanted, texts):
        release(used)
    return links


def near_duplicates(docs: DataFrame, doubt: float = 0.12, work: float = 4.0) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs (doc_id: long, text: string).

    Pairs whose estimate is below 0.75 - doubt (four standard deviations) are not verified. While blocks would hold more
    than `work` times the members of all buckets, further leaders are tried first; links are the same for any value.
    """
    docs, threshold = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 0.75 - doubt
    sketches = written(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, s1 long, s2 long, registers binary"), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "classes",
    )
    parts = _members(classes)
    members = reduce(DataFrame.unionAll, parts)
    pair = [F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")]
    links = _star_links(members.where("cid <> lead").select(*pair).distinct(), classes, docs, threshold)
    # a doc_id with several texts is one document: its classes are linked
    ids = written(filled.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "cid"), ["s1", "s2"]).select("doc_id", "cid").distinct(), "ids")
    own = ids.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("a", "b")
    found, all_members, used = written(own.unionAll(links), "found"), None, [*parts, links]
    for turn in range(ROUNDS + 1):
        labels = connected_components(found).withColumnRenamed("id", "cid")
        placed = members.select("key", "tab", "cid").distinct().join(labels, "cid", "left")
        placed = written(placed.select("key", "tab", "cid", F.coalesce("component", "cid").alias("comp")), "placed")
        apart = placed.groupBy("key").agg(
            F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("comp", "key", F.lit(turn)), F.xxhash64("cid"), "cid", "comp")).alias("l")
        )
        apart = written(apart.where("x <> y").select("key", "c", F.col("l.cid").alias("lead"), F.col("l.comp").alias("lead_comp")), "apart")
        used += [placed, apart, found]
        rows = apart.agg(F.sum("c"), F.sum(F.col("c") * F.ceil(F.col("c") / BLOCK))).first()
        if rows[0] is None:
            break
        all_members = all_members or placed.count()
        if turn == ROUNDS or rows[1] <= work * all_members:
            links = _block_links(placed, apart, classes, docs, threshold)
            found = written(found.unionAll(links), "found")
            labels = connected_components(found).withColumnRenamed("id", "cid")
            used += [links, found]
            break
        links = _star_links(placed.join(apart, "key").where("comp <> lead_comp").select(*pair).distinct(), classes, docs, threshold)
        found = written(found.unionAll(links), "found")
        used.append(links)
    of_id = ids.join(labels, "cid", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "cid")).alias("component_id"))
    result = sketches.select("doc_id", "n_shingles").join(of_id, "doc_id", "left")
    result = written(
        result.select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        ),
        "near",
    )
    for table in (sketches, classes, ids, *used):
        release(table)
    return result
