"""MinHash near-dedup by a chosen-path set similarity join.

Documents become sets of hashed word shingles and, from those, signatures of minwise tokens.
Documents with equal sets are one class, named by a hash of the set; one document of each class goes on. Each of several
independent trees sends a representative down by the token at a position the node selects;
small nodes are compared exhaustively (on signatures), and larger ones recurse: blocks of a node
pick the member nearest to the block's majority signature as a centre, points that surely belong
to a centre leave the node, and the rest branch again on the positions that their node selects.
Candidate links are confirmed on full sets, first those of a spanning forest of each node, then
those between groups that are still apart; confirmed links are joined into components. A point that
leaves a node is compared with all members of the node outside its group, as the method compares
points of high average similarity; inside its group no link is needed.

Nothing is capped: nodes that are still large after the last level are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, ship_package, stored, table, with_key

SHINGLE, THRESHOLD = 5, 0.75
SIG = 256  # minwise tokens of a signature
#: Each level of a large node takes BRANCHES positions. A pair at the threshold s meets in a tree with probability q = s without
#: levels, and 1 - (1 - s * q) ** BRANCHES with one more; two positions keep it from falling below s at any depth (see recall()).
BRANCHES = 2
TREES = 8
SMALL = 1000  # members of a node that is compared exhaustively
BLOCK = 500  # members of a block of a larger node
LEVELS = 5
#: Signature agreement: below MAYBE a pair is not checked (over four standard errors under the
#: threshold); members of a large node that agree with a centre from SURE on leave the node.
MAYBE, SURE = 0.63, 0.85
_MULT = np.random.default_rng(20250101).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(20250102).integers(1, 2**63, SIG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITIONS = np.random.default_rng(20250103).permutation(SIG)


def recall(depth: int, similarity: float = THRESHOLD) -> float:
    """Share of the pairs of a similarity that meet in one of the trees at least and pass MAYBE, if every large node has so many levels."""
    n = np.arange(SIG + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, SIG + 1)))])
    share = np.exp(logs[SIG] - logs - logs[::-1] + n * np.log(similarity) + (SIG - n) * np.log(1 - similarity))
    s = n / SIG  # trees share one signature, so all of them see its agreement
    q = s
    for _ in range(depth):
        q = 1 - (1 - s * q) ** BRANCHES
    return float((share * np.where(s >= MAYBE, 1 - (1 - q) ** TREES, 0)).sum())


class _WordHash(dict):
    def __missing__(self, w):
        if len(self) > 400_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str | None, hashes: _WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    with np.errstate(over="ignore"):
        x = np.full(n - k + 1, np.uint64(k)) * _MULT[SHINGLE]
        for j in range(k):
            x += h[j:n - k + 1 + j] * _MULT[j]
    return np.unique(_mix(x))


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, as SIG unsigned 32-bit numbers."""
    out = np.full(SIG, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for a in range(0, len(s), 256):
            part = s[a:a + 256, None] * _SEEDS[None, :]
            np.minimum(out, part.min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _short(sig: np.ndarray) -> np.ndarray:
    return (sig ^ (sig >> np.uint32(16))).astype(np.uint16)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, sig binary, nodes array<long>): one row per document; cls names its set."""
    def run(batches):
        hashes = _WordHash()
        for pdf in batches:
            n, keys, sigs, nodes = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, hashes)
                n.append(len(s))
                if not len(s):
                    keys.append(None), sigs.append(None), nodes.append(None)
                    continue
                keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1)  # never negative
                sig = signature(s)
                sigs.append(_short(sig).tobytes())
                at = _POSITIONS[:TREES]
                x = sig[at].astype(np.uint64) | (np.arange(TREES, dtype=np.uint64) << np.uint64(40))
                nodes.append(_mix(x).astype(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_shingles": n, "cls": pd.array(keys, "Int64"), "sig": sigs, "nodes": nodes})
    rows = docs.select("doc_id", "text", text_key(docs["text"]).alias("text_key"))
    return with_key(rows, "doc_id", run, "doc_id long, text_key long, n_shingles long, cls long, sig binary, nodes array<bigint>")


def text_key(text):
    """With doc_id, what tells rows apart: ids may be null or repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SIG)


def agreement(sigs: np.ndarray) -> np.ndarray:
    """Share of equal minwise tokens of every two members; the diagonal and below are zero."""
    n = len(sigs)
    est = np.zeros((n, n), np.float32)
    for i in range(n - 1):
        est[i, i + 1:] = (sigs[i + 1:] == sigs[i]).mean(1)
    return est


def forest(est: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of the pairs that may link, between the groups that label gives."""
    sym = est + est.T
    label, out = label.copy(), []
    while True:
        open_ = np.where(label[:, None] != label[None, :], sym, 0)
        to = open_.argmax(1)
        best = open_[np.arange(len(label)), to]
        found = False
        for i in np.argsort(-best, kind="stable").tolist():
            if best[i] < MAYBE:
                break
            if label[i] != label[to[i]]:
                label[label == label[to[i]]] = label[i]
                out.append((i, int(to[i])))
                found = True
        if not found:
            return out


def _runs(node: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
    yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _whole_nodes(f):
    """For mapInPandas over rows sorted by node, each node whole in one task: f over many whole nodes at once."""
    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            held = (pdf["node"] == pdf["node"].iloc[-1]).to_numpy()
            rest, ready = pdf[held], pdf[~held]
            if len(ready):
                yield f(ready)
        if rest is not None and len(rest):
            yield f(rest)
    return run


def _first_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (u, v, node 0) of a spanning forest in each node; a row (-1, -1, node) for a node with more pairs that may link."""
    node, ids, sigs = pdf["node"].to_numpy(), pdf["id"].to_numpy(), _matrix(pdf["sig"])
    cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
    sizes = np.diff(cut)
    two = cut[:-1][sizes == 2]
    ok = (sigs[two] == sigs[two + 1]).mean(1) >= MAYBE if len(two) else np.empty(0, bool)
    out = [(int(ids[i]), int(ids[i + 1]), 0) for i in two[ok].tolist()]
    for a, n in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        est = agreement(sigs[a:a + n])
        tree = forest(est, np.arange(n))
        out += [(int(ids[a + i]), int(ids[a + j]), 0) for i, j in tree]
        if int((est >= MAYBE).sum()) > len(tree):
            out.append((-1, -1, int(node[a])))
    return _ordered(out)


def _ordered(out) -> pd.DataFrame:
    got = np.array(out, np.int64).reshape(-1, 3)
    return pd.DataFrame({"u": got[:, :2].min(1), "v": got[:, :2].max(1), "node": got[:, 2]})


def _split_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of a large node: links to the block's centre, and rows for the next level.

    kind 0: a candidate link (id, to). kind 1: a centre (its node goes on without a branch).
    kind 2: a member that is not surely linked to the centre, or a centre, on a branch.
    kind 3: a member that leaves its node (node is the node left).
    """
    ids, sigs, node = pdf["id"].to_numpy(), _matrix(pdf["sig"]), int(pdf["node"].iloc[0])
    order = np.sort(sigs, axis=0)
    # the majority token of each position: the median is it, where one token has over half
    major = order[len(ids) // 2]
    centre = int(np.lexsort((ids, -(sigs == major).sum(1)))[0])
    near = (sigs == sigs[centre]).mean(1)
    rows = [(0, 0, int(i), int(ids[centre]), None) for i, s in zip(ids, near, strict=True) if s >= MAYBE and i != ids[centre]]
    up = np.array([node ^ 0x5851F42D4C957F2D], np.int64).astype(np.uint64)
    rows.append((1, int(_mix(up)[0].astype(np.int64)), int(ids[centre]), 0, sigs[centre].tobytes()))
    stays = (near < SURE) | (np.arange(len(ids)) == centre)
    rows += [(3, node, int(i), 0, None) for i in ids[~stays]]
    stay = np.flatnonzero(stays)
    if len(stay) > 1 or (len(stay) and len(ids) > 1):
        rng = np.random.default_rng(node & 0x7FFFFFFFFFFFFFFF)  # the node selects: the same positions in all of its blocks
        chosen = rng.permutation(SIG)[:BRANCHES]
        for p in chosen.tolist():
            x = (np.uint64(node & 0xFFFFFFFFFFFFFFFF) ^ (np.uint64(p + 1) << np.uint64(48))) + sigs[stay, p].astype(np.uint64) * _MULT[0]
            keys = _mix(x).astype(np.int64)
            rows += [(2, int(k), int(ids[i]), 0, sigs[i].tobytes()) for k, i in zip(keys, stay, strict=True)]
    return pd.DataFrame(rows, columns=["kind", "node", "id", "to", "sig"])


def _grid(rows: DataFrame) -> DataFrame:
    """Large nodes left after the last level, as nodes of two blocks each, so that every two members meet."""
    g = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = rows.withColumn("g", g).withColumn("b", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    return blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        F.xxhash64("node", F.least("b", "o"), F.greatest("b", "o")).alias("node"), "id", "sig")


def _left_cells(rows: DataFrame, gone: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes (node, id, sig, comp, role) in which every member that left a large node meets all members of it in other groups.

    rows: members (node, id, sig) of large nodes; gone: those that left (node, id). Of two members in different groups one at
    least is outside the node's commonest group, so those outside (role bit 1) meet all members (bit 2), in blocks; bit 4: left.
    """
    spark = rows.sparkSession
    left, _ = stored(spark, gone.select("node").distinct(), "join-left-nodes")
    held = _with_node(rows, left, "left_semi").join(gone.withColumn("left", F.lit(4)), ["node", "id"], "left").join(
        groups, "id", "left").select("node", "id", "sig", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("component_id", "id").alias("comp"))
    held, _ = stored(spark, held, "join-left")
    counted = held.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
    common = counted.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("n > top.n").select(
        "node", F.col("top.comp").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("gm"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("gd"))
    members = _with_node(held, stored(spark, common, "join-common")[0])
    every = members.withColumn("bm", F.pmod(F.xxhash64("id"), F.col("gm")).cast("int")).withColumn("bd", F.explode(F.sequence(F.lit(0), F.col("gd") - 1))).withColumn("role", F.col("left") + 2)
    out = members.where("comp <> top").withColumn("bd", F.pmod(F.xxhash64("id", F.lit(1)), F.col("gd")).cast("int")).withColumn(
        "bm", F.explode(F.sequence(F.lit(0), F.col("gm") - 1))).withColumn("role", F.col("left") + 1)
    return every.unionByName(out.select(every.columns)).select(F.xxhash64("node", "bd", "bm").alias("node"), "id", "sig", "comp", "role")


def _may_link(role, comp, sigs, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of one cell's rows: each i with the rows in other groups that it meets there and may link with, nearest first."""
    meets, left = at[role[at] & 2 > 0], at[role[at] & 6 == 6]
    for i in at[role[at] & 1 > 0].tolist():
        to = meets if role[i] & 4 else left
        to = to[comp[to] != comp[i]]
        if len(to):
            near = (sigs[to] == sigs[i]).mean(1)
            order = np.argsort(-near, kind="stable")
            to = to[order][:int((near >= MAYBE).sum())]
            if len(to):
                yield i, to


def _apart(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of cells, the members that may link with a member of another group: at most all of them, however many pairs they make."""
    node, comp, role, sigs = pdf["node"].to_numpy(), pdf["comp"].to_numpy(), pdf["role"].to_numpy(), _matrix(pdf["sig"])
    hit = np.zeros(len(pdf), bool)
    for a, b in _runs(node):
        if (comp[a:b] != comp[a]).any():
            for i, to in _may_link(role, comp, sigs, np.arange(a, b)):
                hit[i] = True
                hit[to] = True
    return pdf[hit]


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements the sorted set x has in common with each of the others (none is empty)."""
    flat = np.concatenate(others)
    found = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(found.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def _apart_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of cells with full sets (column s), links that join every two groups of which some pair that meets there links."""
    node, ids, comp, role, sigs = pdf["node"].to_numpy(), pdf["id"].to_numpy(), pdf["comp"].to_numpy().copy(), pdf["role"].to_numpy(), _matrix(pdf["sig"])
    sets = [np.frombuffer(x, np.uint64) for x in pdf["s"]]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    need, out = int(round(100 * THRESHOLD)), []
    for a, b in _runs(node):
        at = np.arange(a, b)
        for i, to in _may_link(role, comp, sigs, at):
            step = 8  # the nearest first: where one links, its group needs no more
            while len(to := to[comp[to] != comp[i]]):
                some, to = to[:step], to[step:]
                both = _shared(sets[i], [sets[j] for j in some])
                for j in some[100 * both >= need * (size[i] + size[some] - both)].tolist():
                    if comp[j] != comp[i]:
                        out.append((int(ids[i]), int(ids[j]), 0))
                        comp[at[comp[at] == comp[j]]] = comp[i]
                step *= 4
    return _ordered(out)


def _by_node(rows: DataFrame, f, schema: str) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node").mapInPandas(_whole_nodes(f), schema)


def _compare(rows: DataFrame, f) -> DataFrame:
    return _by_node(rows, f, "u long, v long, node long").distinct()


#: Large nodes up to so many are broadcast; with more of them a node's rows are dealt over SALTS.
BROADCAST_NODES, SALTS = 500_000, 16


def _with_node(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows (node, id, ...) joined with a written table of one row for each large node, without dealing a node's rows to one task."""
    if table.count() <= BROADCAST_NODES:
        return rows.join(F.broadcast(table), "node", how)
    copies = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(copies, ["node", "salt_"], how).drop("salt_")


def _sized(rows: DataFrame) -> DataFrame:
    """rows (node, id, ...) with n, the number of members of their node; members that are alone fall."""
    sizes, _ = stored(rows.sparkSession, rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "join-sizes")
    large = sizes.where(f"n > {SMALL}")
    rest = _with_node(rows, large.select("node"), "left_anti").join(sizes.where(f"n <= {SMALL}"), "node")
    return rest.unionByName(_with_node(rows, large).select(rest.columns))


def tree_nodes(reps: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """reps (id, sig, nodes) -> (tables (node, id, sig) of nodes to be compared exhaustively, tables of links (u, v) to centres,
    by level the members (node, id, sig) of large nodes and those that left them (node, id))."""
    spark = reps.sparkSession
    first = reps.select("id", F.explode("nodes").alias("node"))
    held, _ = stored(spark, _sized(first), "join-level0")
    rows = held.join(reps.select("id", "sig"), "id")
    small, centres, gone = [], [], []
    for level in range(levels + 1):
        rows, _ = stored(spark, rows.select("node", "n", "id", "sig"), f"join-rows{level}")
        small.append(rows.where(f"n <= {SMALL}").select("node", "id", "sig"))
        large = rows.where(f"n > {SMALL}")
        if large.limit(1).count() == 0:
            break
        if level == levels:
            small.append(_grid(large))
            break
        block = F.pmod(F.xxhash64("id", F.lit(level)), F.ceil(F.col("n") / BLOCK)).cast("int")
        split, _ = stored(spark, large.withColumn("block", block).groupBy("node", "block").applyInPandas(
            _split_block, "kind int, node long, id long, to long, sig binary"), f"join-split{level}")
        centres.append(split.where("kind = 0").select(F.least("id", "to").alias("u"), F.greatest("id", "to").alias("v")))
        gone.append((large.select("node", "id", "sig"), split.where("kind = 3").select("node", "id")))
        down, _ = stored(spark, split.where("kind in (1, 2)").select("node", "id", "sig").dropDuplicates(["node", "id"]), f"join-down{level}")
        rows = _sized(down)
    return small, centres, gone


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def link(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Confirmed links (u, v) that join every two representatives which the trees bring together and whose full sets reach the threshold.

    First a spanning forest of each node is confirmed, which joins most groups. Then members of nodes that may link with a member
    of another group take their full sets to the node, and every such pair is confirmed there; links alone come back. A pair
    inside a group needs no link of its own, and no pairs are dealt, so a group of any size costs a few rows a member.
    """
    spark = docs.sparkSession
    small, centres, gone = tree_nodes(reps)
    nodes = _union(small)
    found, _ = stored(spark, _compare(nodes, _first_links), "join-forest")
    pairs, _ = stored(spark, _union([found.where("u >= 0").select("u", "v"), *centres]).where("u <> v").distinct(), "join-pairs")
    links, _ = stored(spark, confirm(docs, reps, pairs), "join-links")
    more = found.where("u < 0").select("node")
    groups = components(spark, links, "forest")
    columns = ["node", "id", "sig", "comp", "role"]
    cells = nodes.join(more, "node", "left_semi").join(groups, "id", "left").select(
        "node", "id", "sig", F.coalesce("component_id", "id").alias("comp"), F.lit(7).alias("role")).select(columns)
    if gone:
        cells = cells.unionByName(_left_cells(_union([x for x, _ in gone]), _union([x for _, x in gone]), groups).select(columns))
    schema = "node long, id long, sig binary, comp long, role int"
    apart, _ = stored(spark, _by_node(cells, _apart, schema), "join-apart")
    sets = set_table(docs, reps, apart.select("id").distinct())
    return links.unionByName(_compare(apart.join(sets, "id"), _apart_links).select("u", "v"))


def set_table(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, s): the full sets of the wanted classes (id), as sorted 64-bit hashes; a written table."""
    wanted = wanted.join(reps.select("id", F.col("doc_id").alias("at"), F.col("text_key").alias("key")), "id")
    # always by merge: what moves then follows the input at every size
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    texts = rows.join(wanted.hint("merge"), rows["doc_id"].eqNullSafe(wanted["at"]) & (rows["text_key"] == wanted["key"])).select("id", "text")

    def sets(batches):
        hashes = _WordHash()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "s": [shingle_set(t, hashes).tobytes() for t in pdf["text"]]})

    return stored(docs.sparkSession, texts.mapInPandas(sets, "id long, s binary").dropDuplicates(["id"]), "join-sets", "uncompressed")[0]


def confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of candidate links (u, v) between classes, those whose full sets have 100 * |A and B| >= 100 * threshold * |A or B|."""
    held = set_table(docs, reps, pairs.select(F.col("u").alias("id")).unionAll(pairs.select("v")).distinct())
    need = int(round(100 * threshold))

    def check(batches):
        for pdf in batches:
            ok = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if min(len(x), len(y)) * 100 < need * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= need * (len(x) + len(y) - both) and both > 0)
            yield pdf.loc[ok, ["u", "v"]]

    a, b = held.select(F.col("id").alias("u"), F.col("s").alias("a")), held.select(F.col("id").alias("v"), F.col("s").alias("b"))
    return pairs.join(a, "u").join(b, "v").mapInPandas(check, "u long, v long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Texts without words (null, empty) have no
    shingles and link with nothing; texts of fewer than five words have one shingle, the whole
    sequence. Rows that share a doc_id are each compared by their own text. A row without a doc_id links
    as any other; component_id is the smallest doc_id of the component, null where it has none, and such a row
    is kept only there. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches, _ = stored(spark, sketch(docs), "sketches")
    # one row of each class stands for it: that of the smallest doc_id; equal sets have equal signatures
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "sig", "nodes")).alias("r")
    reps, _ = stored(spark, sketches.where("cls is not null").groupBy(F.col("cls").alias("id")).agg(first).select("id", "r.doc_id", "r.text_key", "r.sig", "r.nodes"), "classes")
    groups = components(spark, link(docs, reps), "near")
    named, _ = stored(spark, reps.select("id", "doc_id").join(groups, "id", "left").select("id", "doc_id", F.coalesce("component_id", "id").alias("comp")), "named")
    lowest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    told = named.select(F.col("id").alias("cls"), "comp").join(lowest, "comp").select("cls", "component_id")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sketches.select("doc_id", "text_key", "n_shingles", "cls").join(told, "cls", "left").select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with its own columns."""
    ids = verdict.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]) & (text_key(docs["text"]) == ids["kept_key"]), "left_semi")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("text_key")


# Sets, links and components of a small table, by plain comparison of all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM pairs WHERE 100 * k >= 75 * (na + nb - k)),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT w.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
"""
