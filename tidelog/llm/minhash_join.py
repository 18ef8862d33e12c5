"""Operator 4, MinHash near-dedup: chosen-path set similarity join.

Every document is a set of word shingles. A tree's node picks BRANCHES coordinates of the MinHash signature;
a document goes to one child for each, keyed by its value there. Nodes of up to LEAF documents are compared
exhaustively on one-bit sketches; larger nodes branch on. TREES independent trees are walked: a pair at
similarity 0.8 meets in a leaf of one tree with probability 0.94, of five trees with 1 - 5e-7.

What keeps it whole and linear under skew:
- equal sets are one class, found by a pre-aggregated fingerprint, before any tree;
- nodes propose links by sketch, and of those only a forest: a pair is left out if others connect it. A node
  over LEAF proposes a star around one pivot; members that aren't near the pivot meet every chunk of the
  node, if they are up to STRAY, or else all members branch on, to DEEPEST levels, and what is still large
  then is compared tile by tile;
- a connected group of proposals gets each member's full set once. Its links are confirmed there, in memory,
  by exact similarity, and a link inside an already confirmed component is not looked for. A group over GROUP
  is first confirmed against a few hubs, chunk by chunk; then members outside its largest component meet
  every chunk, or, where they are many, tiles cover all pairs of chunks. No node, bucket or group is capped.

Shingles are equal here if their 64-bit hashes are.

Defined results: a null, empty or blank text has an empty set and links with nothing (it is its own
component); a text with fewer words than the width is one shingle. Rows that share a doc_id share a vertex:
links of either are links of both. A null doc_id links with nothing, has a null component and is kept. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Forest, components, drop, free, small_batches, table, tidy, whole, written

TREES, BRANCHES, COORDS, LEAF, DEEPEST = 5, 2, 128, 256, 6
STRAY, GROUP, HUBS = 1024, 512, 16
IDS = 1 << 19  # ids that may be broadcast: up to 50 MB as Spark holds them, with their groups
TEXTS = 1000  # texts or full sets that Python gets at once
FEW = 50_000  # large nodes that may be broadcast: 3 MB
FAR = 34  # differing bits of 128 that a pair at similarity 0.8 exceeds with probability under 1e-6
U = np.uint64
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, COORDS, dtype=np.uint64) * U(2) + U(1)
_B = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    if len(words) < width:
        got = [h(b" ".join(words))]
    elif width == 2:
        got = [h(a + b" " + b) for a, b in zip(words, words[1:])]
    else:
        got = [h(b" ".join(words[k : k + width])) for k in range(len(words) - width + 1)]
    return np.unique(np.array(got, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signature(s: np.ndarray) -> np.ndarray:
    """COORDS minwise values of 32 bits."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(low, (s[k : k + 4096, None] * _A + _B).min(0), out=low)
    return (low >> U(32)).astype(np.uint32)


def _describe(width):
    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                s = shingles(t, width)
                sig = signature(s)
                bits = np.packbits((mix(sig.astype(np.uint64)) & U(1)).astype(np.uint8)).view("<i8")
                f = mix(s ^ U(0x9E3779B97F4A7C15))
                rows.append((len(s), int(np.bitwise_xor.reduce(f)) if len(s) else 0, int(f.sum()), sig.tobytes(), int(bits[0]), int(bits[1])))
            n, f1, f2, sig, s1, s2 = zip(*rows) if rows else ((),) * 6
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": np.array(n, "int32"), "f1": np.array(f1, "uint64").view("int64"), "f2": np.array(f2, "uint64").view("int64"), "sig": list(sig), "s1": np.array(s1, "int64"), "s2": np.array(s2, "int64")})

    return run


def children(keys: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The BRANCHES child keys (rows x BRANCHES) of each row's node, by the coordinates that the node picks."""
    first = mix(keys ^ U(0xD6E8FEB86659FD93))
    step = (first >> U(32)) % U(COORDS // 2) * U(2) + U(1)
    out = []
    for j in range(BRANCHES):
        c = ((first + step * U(j)) % U(COORDS)).astype(np.int64)
        out.append(mix(keys * U(0x9E3779B97F4A7C15) + (c.astype(np.uint64) << U(32)) + sig[np.arange(len(sig)), c] + U(1)))
    return np.stack(out, 1)


ROW = "node long, id long, n int, s1 long, s2 long, label long"


def _expand(pdf: pd.DataFrame, nodes: np.ndarray) -> pd.DataFrame:
    """A row for each (row, node), without signatures: these are joined to the few rows that branch on."""
    at = np.repeat(np.arange(len(pdf)), nodes.shape[1])
    return pdf[["id", "n", "s1", "s2", "label"]].iloc[at].assign(node=nodes.ravel().view("int64"))


def _sig(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), COORDS)


def _plant(batches):
    """Members of the nodes at the second level of every tree."""
    for pdf in batches:
        for k in range(0, len(pdf), 2000):
            some = pdf.iloc[k : k + 2000]
            sig, found = _sig(some), []
            for t in range(TREES):
                root = mix(np.full(len(some), t + 1, np.uint64))
                for key in children(root, sig).T:
                    found += list(children(key, sig).T)
            yield _expand(some, np.stack(found, 1))


def _branch(batches):
    for pdf in batches:
        if len(pdf):
            yield _expand(pdf, children(pdf["node"].to_numpy("int64").view("uint64"), _sig(pdf)))


def _near(percent: int):
    def check(n1, n2, a1, b1, a2, b2):
        far = np.bitwise_count(a1 ^ a2).astype(np.int32) + np.bitwise_count(b1 ^ b2)
        return (far <= FAR) & (100 * np.minimum(n1, n2).astype(np.int64) >= percent * np.maximum(n1, n2).astype(np.int64)), far

    return check


def _compare(percent: int):
    """A forest of the likely pairs (a, b) of different labels in each node, from rows sorted by node."""
    near = _near(percent)

    def run(batches):
        rest = None
        for pdf, last in _ended(batches):
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            node = pdf["node"].to_numpy()
            cut = len(pdf) if last or not len(pdf) else int(np.searchsorted(node, node[-1]))
            rest, pdf, node = pdf.iloc[cut:], pdf.iloc[:cut], node[:cut]
            v = {c: pdf[c].to_numpy() for c in ("id", "n", "s1", "s2", "label")}
            v["s1"], v["s2"] = v["s1"].view("uint64"), v["s2"].view("uint64")
            i, k, found, f = np.arange(len(pdf)), 0, [], Forest()
            while len(i):
                k += 1
                i = i[i + k < len(pdf)]
                i = i[node[i] == node[i + k]]
                at = v["label"][i] != v["label"][i + k]
                x, y = i[at], i[at] + k
                ok, _ = near(v["n"][x], v["n"][y], v["s1"][x], v["s2"][x], v["s1"][y], v["s2"][y])
                a, b = v["id"][x[ok]], v["id"][y[ok]]
                found += [(p, q) for p, q in zip(a.tolist(), b.tolist()) if f.join(p, q)]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _ended(batches):
    """Each batch, and whether it is the last."""
    have = None
    for pdf in batches:
        if have is not None:
            yield have, False
        have = pdf
    if have is not None:
        yield have, True


def _small(members: DataFrame, percent: int) -> DataFrame:
    return members.select(*[c.split()[0] for c in ROW.split(", ")]).repartition("node").sortWithinPartitions("node").mapInPandas(_compare(percent), "a long, b long").distinct()


def _bitmap(ids: DataFrame, n: int):
    """A broadcast bitmap of these n ids, of 16 MB at most, and a column's place in it."""
    bits = 1 << min(27, max(15, int(16 * n).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = np.zeros(bits // 8, np.uint8)
    for r in ids.select((slot("id") / 32768).cast("int").alias("k"), (slot("id") % 32768).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator():
        marks[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(marks), slot


def _marked(marks: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (marks[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the full sets of the documents with these ids, made anew from whole texts.

    A bitmap of the ids spares other texts the work; the join that follows decides.
    """
    sent, slot = _bitmap(ids, ids.count())

    def run(batches):
        for pdf in batches:
            pdf = pdf[_marked(sent.value, pdf["slot"].to_numpy())]
            yield pd.DataFrame({"id": pdf["id"], "s": [shingles(t, width).tobytes() for t in pdf["text"]]})

    named = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    return named.select("id", "text", slot("id").alias("slot")).mapInPandas(run, "id long, s binary")


def without(docs: DataFrame, ids: DataFrame, few: int | None = None) -> DataFrame:
    """docs without the rows whose doc_id is in ids (id, distinct).

    Up to `few` ids are broadcast. Beyond that a bitmap of them lets most other rows by, and only rows that it marks
    are joined, so that the texts of what stays are hardly shuffled."""
    ids, few = written(ids, "gone"), IDS if few is None else few
    n = ids.count()
    gone, slot = free(docs, "gone", "slot")
    named = ids.select(F.col("id").alias(gone))
    if n <= few:
        return docs.join(F.broadcast(named), F.col("doc_id") == F.col(gone), "left_anti")
    sent, at = _bitmap(ids, n)

    @pandas_udf("boolean")
    def maybe(p: pd.Series) -> pd.Series:
        return pd.Series(_marked(sent.value, p.to_numpy()))

    docs = docs.withColumn(slot, maybe(at(F.col("doc_id").cast("long"))))
    rest = docs.where(F.col(slot)).join(named, F.col("doc_id") == F.col(gone), "left_anti")
    return docs.where(~F.col(slot)).union(rest).drop(slot)


def links_within(ids: list[int], labels: list[int], active: np.ndarray, sets: list[np.ndarray], percent: int):
    """Links that connect what is similar across labels, if one end is active; fewer than there are members."""
    f, sizes = Forest(), np.array([len(x) for x in sets])
    for x in (*ids, *labels):
        f.up.setdefault(x, x)
    for x, y in zip(ids, labels):
        f.join(x, y)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    del order
    left = len({f.find(x) for x in ids})
    for k in np.argsort(~active, kind="stable").tolist():
        if left == 1 or not active[k]:
            return
        lo, hi = np.searchsorted(every, sets[k]), np.searchsorted(every, sets[k], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        same = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * same >= percent * (sizes + sizes[k] - same)).tolist():
            if f.join(ids[k], ids[j]):
                left -= 1
                yield ids[k], ids[j]


def _stored(rows: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in rows]


def _judge(rows: DataFrame, percent: int, read=_stored) -> DataFrame:
    """Confirmed links (a, b) within each grp of (grp, id, label, active, s); read gives the sets of rows from their s."""

    def run(batches):
        for pdf in batches:
            found, grp = [], pdf["grp"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]])
            ids, labels, active = pdf["id"].tolist(), pdf["label"].tolist(), pdf["active"].to_numpy(bool)
            sets = read(pdf["s"].tolist())
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    found += links_within(ids[a:b], labels[a:b], active[a:b], sets[a:b], percent)
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    rows = rows.select("grp", "id", "label", "active", "s").repartition("grp").sortWithinPartitions("grp")
    return rows.mapInPandas(whole("grp", run), "a long, b long")


def _in_chunks(rows: DataFrame, everywhere: Column) -> DataFrame:
    """Each group's rows in chunks of about LEAF; rows that are `everywhere` go to every chunk, and are active."""
    chunks = F.ceil(F.col("size") / LEAF).cast("long")
    own, every = F.array(F.pmod(F.xxhash64("id"), chunks)), F.sequence(F.lit(0).cast("long"), chunks - 1)
    rows = rows.withColumn("active", everywhere).withColumn("chunk", F.explode(F.when(everywhere, every).otherwise(own)))
    return rows.withColumn("grp", F.xxhash64("grp", "chunk"))


def confirm(sets: DataFrame, groups: DataFrame, percent: int, read=_stored) -> DataFrame:
    """The links (a, b) that connect exactly what the confirmed pairs among each group of proposals connect.

    sets: id, s, from which read makes the full sets."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = written(groups.join(sizes, "component"), "sized")
    sized = F.broadcast(sized) if sized.count() <= IDS else sized
    rows = sets.join(sized, "id").select(F.col("component").alias("grp"), "id", "size", F.col("id").alias("label"), "s")
    rows = written(rows, "groups")
    links = _judge(rows.where(F.col("size") <= GROUP).withColumn("active", F.lit(True)), percent, read)
    big = rows.where(F.col("size") > GROUP)
    if big.limit(1).count():
        hub = F.pmod(F.xxhash64("id", "grp"), F.ceil(F.col("size") / HUBS).cast("long")) == 0
        first = written(_judge(_in_chunks(big, hub), percent, read), "links")
        big = _labelled(big, components(first))
        counts = big.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("label", "n").alias("lead"), F.max("n").alias("most"), F.sum("n").alias("all"))
        big = written(big.join(counts.where("most < all"), "grp"), "groups")
        strays = F.col("all") - F.col("most")
        second = _judge(_in_chunks(big.where(strays <= STRAY), F.col("label") != F.col("lead")), percent, read)
        third = _judge(_in_tiles(big.where(strays > STRAY).withColumnRenamed("grp", "node")).withColumnRenamed("node", "grp").withColumn("active", F.lit(True)), percent, read)
        links = links.union(first).union(second).union(third)
    return written(links, "links")


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.drop("label").join(comps.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))


def _with_sizes(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of the nodes in `sizes`; a join that AQE splits for hot nodes."""
    return members.join(sizes.select("node", "size"), "node")


def _in_tiles(large: DataFrame) -> DataFrame:
    """Nodes that never split: every two chunks of a node meet in a tile."""
    chunks = F.ceil(F.col("size") / (LEAF // 2)).cast("long")
    own = F.pmod(F.xxhash64("id"), chunks)
    tile = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("node", tile)


def _stray_or_split(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of large nodes: what members that aren't near the pivot propose, where they are few; the members of the rest.

    The label of a member is the pivot's id, or its own if it isn't near."""
    lead = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("label") != F.col("id"), F.col("label"))).alias("lead"), F.count_if(F.col("label") == F.col("id")).alias("strays"))
    members = members.join(lead, "node").withColumnRenamed("node", "grp")
    stray = F.coalesce(F.col("label") != F.col("lead"), F.lit(True))
    few = _in_chunks(members.where(F.col("strays") <= STRAY), stray).withColumnRenamed("grp", "node")
    return _small(few, percent), members.where(F.col("strays") > STRAY).withColumnRenamed("grp", "node").drop("lead", "strays")


def large_nodes(members: DataFrame, large: DataFrame, percent: int, sigs: DataFrame | None) -> list[DataFrame]:
    """What nodes over LEAF propose. large: node, p (the pivot: id, n, s1, s2). Without sigs nodes don't branch."""
    far = F.bit_count(F.col("s1").bitwiseXOR(F.col("p.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("p.s2")))
    sized = 100 * F.least("n", "p.n").cast("long") >= percent * F.greatest("n", "p.n").cast("long")
    near = (far <= FAR) & sized
    members = members.join(large.select("node", "p"), "node").withColumn("label", F.when(near, F.col("p.id")).otherwise(F.col("id")))
    members = written(members.select(*[c.split()[0] for c in ROW.split(", ")]), "members")
    found = [members.where("label <> id").select(F.col("label").alias("a"), F.col("id").alias("b")).distinct()]
    mixed = _sizes(members).where("lo <> hi").select("node")
    left = written(members.join(mixed, "node", "left_semi"), "members")
    for _ in range(3, DEEPEST + 1) if sigs is not None else ():
        pairs, split = _stray_or_split(left, percent)
        found.append(pairs)
        members = written(split.drop("size"), "members")
        if not members.limit(1).count():
            return found
        child = members.join(sigs, "id").mapInPandas(_branch, ROW)
        sizes = written(_sizes(child).where("size > 1 and lo <> hi"), "sizes")
        found.append(_small(_with_sizes(child, sizes.where(F.col("size") <= LEAF)), percent))
        left = written(_with_sizes(child, sizes.where(F.col("size") > LEAF)).drop("size"), "members")
    pairs, split = _stray_or_split(left, percent)
    return [*found, pairs, _small(_in_tiles(split), percent)]


def similar_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(described rows: doc_id, n, f1, f2; components over class representatives: id, component)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession, TEXTS):
        described = written(docs.mapInPandas(_describe(width), "doc_id long, n int, f1 long, f2 long, sig binary, s1 long, s2 long"), "described")
    reps = described.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    reps = written(reps.select("id", "n", "s1", "s2", F.col("id").alias("label"), "sig"), "classes")
    members = reps.mapInPandas(_plant, ROW)
    large = written(members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n", "s1", "s2")).alias("p")).where(F.col("size") > LEAF), "large")
    known = large.count()
    large = F.broadcast(large) if known <= FEW else large
    found = [_small(members.join(large.select("node"), "node", "left_anti"), percent)]
    if known:
        found += large_nodes(members, large, percent, reps.select("id", "sig"))
    proposed = found[0]
    for x in found[1:]:
        proposed = proposed.union(x)
    proposed = written(proposed.distinct(), "proposed")
    drop(reps)
    groups = components(proposed)
    with small_batches(docs.sparkSession, TEXTS):
        links = confirm(sets_of(docs, groups.select("id"), width), groups, percent)
    return described, components(links)


@tidy
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is component_id)."""
    described, comps = similar_classes(docs, width, percent)
    copies = described.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"))
    copies = written(copies, "copies")  # apart from the join, so that a hot class's part of it is split
    # Rows of one class, and rows that share a doc_id, meet in the components of (row's doc_id, class).
    kin = described.where("n > 0 and doc_id is not null").select("doc_id", "n", "f1", "f2").join(copies, ["n", "f1", "f2"]).select("doc_id", "id")
    rows = described.select("doc_id", "n").withColumnRenamed("n", "n_shingles")
    kin = kin.join(comps, "id", "left").select("doc_id", F.coalesce("component", "id").alias("c"))
    shared = written(kin.groupBy("doc_id").agg(F.min("c").alias("c1"), F.max("c").alias("c2")), "shared")
    split = shared.where("c1 <> c2")
    if split.limit(1).count():  # a doc_id with texts in several components
        join = components(kin.join(split.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("c").alias("b")))
        found = shared.select("doc_id", "c1").join(join, F.col("c1") == F.col("id"), "left").select("doc_id", F.coalesce("component", "c1").alias("component_id"))
    else:
        found = shared.select("doc_id", F.col("c1").alias("component_id"))
    out = rows.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_minhash_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles at 0.8; the columns of documents.

    Of a doc_id that stays, all rows stay; so do rows of a null doc_id, and null and empty texts."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return without(docs, near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("id")).distinct())
