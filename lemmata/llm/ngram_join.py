"""N-gram Jaccard join by grouped prefixes, and the components of its links.

1. A batch's shingles get classes of document frequency (``sharing``).  A text can
   only link if ``threshold`` of its shingles occur in another text; all others
   are done.  Texts of equal sets become one class.
2. A set's shingles are ordered rarest class first.  Its prefix has
   n - ceil(threshold * n) + 1 shingles, and linked sets share one of them.  Sets
   of equal prefix and size form one group, and groups are indexed by prefix
   shingle.
3. Per shingle, the member with the smallest share of unshared shingles is the
   pivot.  Pivots are verified against all members of the blocks in which
   groups of their shingles lie, which links most of a large group of copies with as
   many verifications as it has members.
4. Each member whose component differs from that of a shingle's pivot is verified
   against the blocks of that shingle.  Of two linked members of different
   components, one at least differs from the pivot's, so no link between
   components is lost.

Blocks hold about ``BLOCK_SETS`` sets each; a query set is sent once to a block
and compared to all its members by their exact sets.  Pairs are never listed.

Null text counts as empty; texts without words have an empty set, link with
nothing and are their own component.  Rows of equal text, and rows of equal id,
keep a row each.  A null id is no candidate for ``component_id``.  An empty table gives no rows; columns
other than id and text are not read, so their names do not matter; a text is never cut, a very
long one is a slice of its own and its set one entry of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm import arrays, sharing
from lemmata.llm.components import components
from lemmata.llm.skew import hot_join
from lemmata.llm.shingles import WIDTH, shingle_sets
from lemmata.llm.storage import stored

#: Jaccard similarity in percent, sets of a block, text bytes of a slice.
PERCENT, BLOCK_SETS, SLICE = 75, 600, 1 << 20
_C1, _C2 = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407)


def _digests(keys: np.ndarray, off: np.ndarray) -> list[bytes]:
    """128 bits that depend on each set (or list) alone."""
    with np.errstate(over="ignore"):
        parts = []
        for c in (_C1, _C2):
            total = np.concatenate([[np.uint64(0)], np.cumsum(arrays.mix(keys * c + c))])
            parts.append(arrays.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64) * c))
    return [a.tobytes() for a in np.ascontiguousarray(np.stack(parts, 1)).astype(">u8")]


def _sets(df: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """A row per document: n; for those that may link also node (set digest), group, rank, prefix shingles, and once per batch and node the set."""
    _, docs, buckets = sharing.batched(df, id_col, text_col)
    kind = dict(docs.dtypes)["doc"]

    def keys_of(table: pa.Table) -> np.ndarray:
        return np.concatenate([shingle_sets(arrays.text_of(p, "text"), width)[0] for p in sharing.parts(table, SLICE)] or [np.zeros(0, np.uint64)])

    def sets(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        got = [shingle_sets(arrays.text_of(p, "text"), width) for p in sharing.parts(table, SLICE)]
        keys = np.concatenate([k for k, _ in got])
        sizes = np.concatenate([np.diff(o) for _, o in got])
        classes = sharing.class_of(keys, answers, buckets)
        off = np.concatenate([[0], np.cumsum(sizes)])
        shared = np.concatenate([[0], np.cumsum(classes > 0)])
        shared = shared[off[1:]] - shared[off[:-1]]
        may = np.flatnonzero((sizes > 0) & (100 * shared >= percent * sizes))
        nodes = [None] * len(sizes)
        groups, prefixes, bodies, rank = list(nodes), list(nodes), list(nodes), list(nodes)
        seen: set[bytes] = set()
        for i in may.tolist():
            a, b = off[i], off[i + 1]
            own, cls = keys[a:b], classes[a:b]
            n = b - a
            order = np.lexsort((own, cls))[: n - -(-percent * n // 100) + 1]
            prefix = own[order]
            nodes[i] = digest = _digests(own, np.array([0, n]))[0]
            if digest in seen:
                continue
            seen.add(digest)
            groups[i] = _digests(np.append(prefix, np.uint64(n)), np.array([0, len(prefix) + 1]))[0]
            prefixes[i] = prefix[cls[order] > 0].view(np.int64)
            bodies[i] = own.tobytes()
            rank[i] = float(1 - shared[i] / n)
        docs_ = pa.concat_arrays([c for c in table.column("doc").chunks])
        return pa.table([docs_, pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(groups, pa.binary()), pa.array(rank, pa.float64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bodies, pa.binary())], names=names)

    names = ["doc", "n", "node", "group", "rank", "prefix", "body"]
    doc_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    empty = pa.table([pa.array([], k) for k in (doc_kind, pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.binary())], names=names)
    answers = sharing.shared_classes(docs, keys_of, buckets)
    out = docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(sharing.lean(sets), f"doc {kind}, n long, node binary, group binary, rank double, prefix array<long>, body binary")
    return stored(out, "sets")


def _verified(requests: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the requests (node, block): per block a spanning forest of those found there."""
    asked = requests.join(sets.select("node", F.col("component").alias("own"), "body"), "node").select(*(F.col(c).alias(f"q_{c}") for c in ("block", "node", "own", "body")))
    held = sets.select(*(F.col(c).alias(f"m_{c}") for c in ("block", "node", "component", "body")))

    def verify(queries: pa.Table, members: pa.Table) -> pa.Table:
        out_a, out_b, parent = [], [], {}

        def top(x: bytes) -> bytes:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        if queries.num_rows and members.num_rows:
            names, comps = members.column("m_node").to_pylist(), members.column("m_component").to_pylist()
            bodies = [np.frombuffer(b, np.uint64) for b in members.column("m_body").to_pylist()]
            sizes = np.array([len(b) for b in bodies])
            tokens = np.concatenate(bodies)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], np.repeat(np.arange(len(bodies)), sizes)[order]
            for node, own, body in zip(*(queries.column(c).to_pylist() for c in ("q_node", "q_own", "q_body"))):
                q = np.frombuffer(body, np.uint64)
                lo, hi = np.searchsorted(tokens, q, "left"), np.searchsorted(tokens, q, "right")
                width = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
                both = np.bincount(owner[at], minlength=len(bodies))
                for m in np.flatnonzero(100 * both >= percent * (len(q) + sizes - both)).tolist():
                    x, y = top(own), top(comps[m])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out_a.append(node)
                        out_b.append(names[m])
        return pa.table([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return asked.groupBy("q_block").cogroup(held.groupBy("m_block")).applyInArrow(sharing.lean(verify), "a binary, b binary")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that connect each component of the link graph."""
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100)
    groups = sets.groupBy("group").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"), F.min(F.struct("rank", "node")).alias("pivot"), F.count("*").alias("members"))
    index = groups.select("group", "n", "pivot", "members", F.explode("prefix").alias("token"))
    tops = index.groupBy("token").agg(F.min("pivot").alias("pivot"), F.sum("members").alias("members")).filter("members > 1").select("token", F.col("pivot.node").alias("node"))
    tops = stored(tops, "pivots")
    lying = sets.select("group", "block").distinct()
    cells = index.select("group", "n", "token").join(tops.select("token"), "token", "left_semi").join(lying, "group").groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    cells = stored(cells, "cells")
    sizes = sets.select("node", "n")
    first = tops.join(sizes, "node").join(cells, "token").filter(fits).select("node", "block").distinct()
    links = stored(_verified(first, sets, percent), "links")
    label = components(links)
    sets = stored(sets.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    lead = tops.join(sets.select("node", F.col("component").alias("lead")), "node").select("token", "lead")
    members = sets.select("node", "n", "component", F.explode("prefix").alias("token"))
    strays = members.join(lead, "token").filter(F.col("component") != F.col("lead")).select("token", "node", "n")
    second = strays.join(cells, "token").filter(fits).select("node", "block").distinct()
    return links.unionByName(_verified(second, sets, percent))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows = _sets(df, id_col, text_col, percent, width)
    first = rows.filter(F.col("body").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "n", "group", "rank", "prefix", "body")).alias("s"))
    count = rows.filter(F.col("body").isNotNull()).count()
    blocks = max(1, count // BLOCK_SETS)
    sets = stored(first.select("node", "s.n", "s.group", "s.rank", "s.prefix", "s.body", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block"), F.col("node").alias("component")), "classes")
    label = components(_links(sets, percent)).withColumnRenamed("component", "top")
    some = rows.filter(F.col("node").isNotNull()).select("doc", "n", "node").join(label, "node", "left").withColumn("top", F.coalesce("top", "node"))
    some = stored(some.select("doc", "n", "top"), "members")
    lowest = stored(some.groupBy("top").agg(F.min("doc").alias("lowest"), F.count("*").alias("members")), "lowest")
    linked = hot_join(some, lowest, "top", "members", "doc").select("doc", "n", F.coalesce("lowest", "doc").alias("component_id"))
    alone = rows.filter(F.col("node").isNull()).select("doc", "n", F.col("doc").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
