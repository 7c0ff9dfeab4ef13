"""Merkle manifest of a table as a tree of SHA-256 midstates.

A parent hashes the hex digests of its children one after the other. A hex digest has 64 bytes, which is
one block of SHA-256, so the state of the hash before each child slot is eight words. Parents keep a copy of
that state for every slot: when one child changes, folding resumes the state of its slot with the
replacement and the siblings to its right; nothing on the left is hashed again.

1. Leaves are hashed in the JVM and numbered within their group (``operators.passes``), the only sort.
2. Rows meet in subtrees of ``ARITY ** LEVELS`` leaves, which are dealt to cells of bounded size; a cell
   hashes one level of all its subtrees at once in NumPy. A hot group is many subtrees.
3. The roots of the subtrees (a six-thousandth of the rows) are climbed in the same way until one is left per
   group, then the groups' roots until one is left at all. Each such node keeps its path as records of
   (siblings on either side, state before its slot, siblings' digests).
4. Rows meet the path of their subtree's root by (group, subtree), a key of bounded frequency, and are
   folded to the root.

Defined results: a NULL value is hashed as ``-``, NULL and empty values differ; rows of a NULL group form a
group of its own, before all others; equal ids are ordered by their leaf, so equal rows may be
exchanged; a NULL id comes first; an empty table has no rows and no root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.passes import Walk, ordered_pass
from panelwright.runtime import stage

ARITY = 3
LEVELS = 8  # of a subtree: 6,561 leaves
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_U = np.uint32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r**3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


# SHA-256 takes its constants from the fractional parts of square and cube roots of primes.
_ROUND = [_U(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=_U)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> _U(n)) | (x << _U(32 - n))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (n x 8 words) after one more block (n x 16 words) each."""
    w = [np.ascontiguousarray(blocks[:, k]) for k in range(16)]
    for k in range(16, 64):
        x, y = w[k - 15], w[k - 2]
        w.append(w[k - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> _U(3))) + w[k - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> _U(10))))
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(states[:, k]) for k in range(8))
    for k in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[k] + w[k]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 8 words) as the 16 words of their hex text."""
    raw = np.ascontiguousarray(digests).astype(">u4").view(np.uint8).reshape(len(digests), 32)
    nibbles = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(digests), 64)
    text = np.where(nibbles < 10, nibbles + ord("0"), nibbles + ord("a") - 10).astype(np.uint8)
    return text.view(">u4").astype(_U)


def finished(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of so many whole blocks, by the block that ends a message."""
    last = np.zeros((len(states), 16), dtype=_U)
    last[:, 0] = 0x80000000
    last[:, 14], last[:, 15] = (blocks.astype(np.uint64) >> np.uint64(23)).astype(_U), (blocks * 512).astype(_U)
    return compress(states, last)


def words_of(column: pa.Array) -> np.ndarray:
    """Digests held as 32 bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").astype(_U).reshape(-1, 8)


def bytes_of(words: np.ndarray) -> pa.Array:
    raw = words.astype(">u4").tobytes()
    return pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary())


def levels_above(n: np.ndarray) -> np.ndarray:
    """Levels until one of ``n`` nodes is left."""
    out, left = np.zeros(len(n), dtype=np.int64), n.astype(np.int64)
    while (left > 1).any():
        out += left > 1
        left = -(-left // ARITY)
    return out


class Level:
    """One level of many trees: parents of nodes (tree, position, digest), sorted by tree and position.

    A node whose tree is finished is handed on as it is.
    """

    def __init__(self, tree: np.ndarray, position: np.ndarray, digest: np.ndarray, active: np.ndarray) -> None:
        up = np.where(active, position // ARITY, position)
        new = np.ones(len(tree), dtype=bool)
        new[1:] = (tree[1:] != tree[:-1]) | (up[1:] != up[:-1])
        self.parent = np.cumsum(new) - 1
        self.slot = np.where(active, position % ARITY, 0)
        self.active = active
        self.digest, n = digest, int(self.parent[-1]) + 1
        self.child = np.full((n, ARITY), -1)
        self.child[self.parent, self.slot] = np.arange(len(tree))
        self.size = (self.child >= 0).sum(axis=1)
        self.states = np.empty((n, ARITY, 8), dtype=_U)  # the copy that is kept before each slot
        state = np.tile(START, (n, 1))
        for k in range(ARITY):
            self.states[:, k] = state
            has = self.child[:, k] >= 0
            state[has] = compress(state[has], hex_block(digest[self.child[has, k]]))
        self.up_tree, self.up_position, self.up_active = tree[new], up[new], active[new]
        alone = digest[self.child[:, 0]]
        self.up_digest = np.where(self.up_active[:, None], finished(state, self.size), alone)

    def fold(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Digests of the parents of ``node`` with ``value`` in its place, from the kept states and the right siblings."""
        out = value.copy()
        moved = np.flatnonzero(self.active[node])
        parent, slot = self.parent[node[moved]], self.slot[node[moved]]
        state = compress(self.states[parent, slot], hex_block(value[moved]))
        for k in range(1, ARITY):
            sibling = self.child[parent, k]
            at = (k > slot) & (sibling >= 0)
            state[at] = compress(state[at], hex_block(self.digest[sibling[at]]))
        out[moved] = finished(state, self.size[parent])
        return out

    def prove(self, node: np.ndarray, state: np.ndarray, blocks: np.ndarray) -> None:
        """Feeds the siblings of ``node`` to the running hash of its proof."""
        parent, slot = self.parent[node], self.slot[node]
        for k in range(ARITY):
            sibling = self.child[parent, k]
            at = self.active[node] & (k != slot) & (sibling >= 0)
            state[at] = compress(state[at], hex_block(self.digest[sibling[at]]))
            blocks += at

    def record(self, node: np.ndarray) -> list[bytes]:
        """What folding and proving at ``node`` need, as bytes: siblings on the left, on the right, state, their digests."""
        parent, slot = self.parent[node], self.slot[node]
        right = self.size[parent] - 1 - slot
        state = self.states[parent, slot].astype(">u4").view(np.uint8).reshape(len(node), 32)
        siblings = np.zeros((len(node), ARITY - 1, 32), dtype=np.uint8)
        for k in range(ARITY):
            sibling = self.child[parent, k]
            at = np.flatnonzero((k != slot) & (sibling >= 0))
            raw = self.digest[sibling[at]].astype(">u4").view(np.uint8).reshape(len(at), 32)
            siblings[at, k - (k > slot[at])] = raw
        table = np.concatenate([slot[:, None].astype(np.uint8), right[:, None].astype(np.uint8), state, siblings.reshape(len(node), -1)], axis=1)
        return [row.tobytes() if go else b"" for row, go in zip(table, self.active[node], strict=True)]


RECORD = 2 + 32 + 32 * (ARITY - 1)


def _trees(rows: pa.Table, sizes: pa.Table):
    """Rows of a cell sorted by tree and position: order, tree, position, digests, levels to climb by tree."""
    keys = sizes.column("key").to_pylist()
    number = {k: i for i, k in enumerate(zip(keys, sizes.column("up").to_pylist(), strict=True))}
    position = rows.column("pos").to_numpy()
    up = position // ARITY**LEVELS
    tree = np.array([number[k] for k in zip(rows.column("key").to_pylist(), up.tolist(), strict=True)])
    order = np.lexsort((position, tree))
    levels = np.minimum(levels_above(sizes.column("n").to_numpy()), LEVELS)
    return order, tree[order], position[order], words_of(rows.column("digest"))[order], levels


def _climb(tree: np.ndarray, position: np.ndarray, digest: np.ndarray, levels: np.ndarray) -> Iterator[tuple[Level, np.ndarray]]:
    """Every level together with the node at which each row stands there."""
    at = np.arange(len(tree))
    for k in range(int(levels.max(initial=0))):
        level = Level(tree, position, digest, levels[tree] > k)
        yield level, at
        at = level.parent[at]
        tree, position, digest = level.up_tree, level.up_position, level.up_digest


def _folded_subtrees(_, rows: pa.Table, sizes: pa.Table) -> pa.Table:
    """Leaves of a cell with their subtree's root, what their changed leaf makes of it, and the hash of their proof so far."""
    order, tree, position, digest, levels = _trees(rows, sizes)
    folded = words_of(rows.column("changed"))[order]
    node, proof, blocks = digest.copy(), np.tile(START, (len(order), 1)), np.zeros(len(order), dtype=np.int64)
    for level, at in _climb(tree, position, digest, levels):
        folded = level.fold(at, folded)
        level.prove(at, proof, blocks)
        node = level.up_digest[level.parent[at]]
    rows = rows.take(pa.array(order))
    return pa.table({
        "key": rows.column("key"), "doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "up": pa.array(position // ARITY**LEVELS),
        "node": bytes_of(node), "folded": bytes_of(folded), "proof": bytes_of(proof), "blocks": pa.array(blocks),
    })


def _paths(_, rows: pa.Table, sizes: pa.Table) -> pa.Table:
    """Nodes of a cell with the records of their path to their subtree's root."""
    order, tree, position, digest, levels = _trees(rows, sizes)
    node, path = digest.copy(), [b""] * len(order)
    for level, at in _climb(tree, position, digest, levels):
        path = [a + b for a, b in zip(path, level.record(at), strict=True)]
        node = level.up_digest[level.parent[at]]
    rows = rows.take(pa.array(order))
    return pa.table({"key": rows.column("key"), "pos": pa.array(position), "path": pa.array(path, pa.binary()), "up": pa.array(position // ARITY**LEVELS), "node": bytes_of(node)})


def _by_cell(nodes: DataFrame, counts: DataFrame, total: int, run, schema: str) -> DataFrame:
    """``run`` on cells of whole subtrees: so many cells that one holds about a subtree's number of nodes."""
    cells = total // ARITY**LEVELS + 1
    cell = F.pmod(F.xxhash64("key", "up"), F.lit(cells)).alias("cell")
    rows = nodes.withColumn("up", F.expr(f"pos div {ARITY**LEVELS}")).withColumn("cell", cell).drop("up")
    trees = counts.withColumn("up", F.explode(F.expr(f"sequence(0L, (n - 1) div {ARITY**LEVELS})"))).withColumn("cell", cell)
    return rows.groupBy("cell").cogroup(trees.groupBy("cell")).applyInArrow(run, schema)


def paths(nodes: DataFrame) -> DataFrame:
    """``key``, ``pos``, ``path`` and ``root`` for nodes (key, pos from 0, digest): the records that lead each node to the
    root of its key. A few rounds, each on a six-thousandth of the rows of the one before."""
    counts = stage(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    rungs = []
    while True:
        most, total = counts.agg(F.max("n"), F.sum("n")).first()
        rungs.append(stage(_by_cell(nodes, counts, total or 0, _paths, "key string, pos long, path binary, up long, node binary")))
        if (most or 0) <= ARITY**LEVELS:
            break
        nodes = rungs[-1].select("key", F.col("up").alias("pos"), F.col("node").alias("digest")).distinct()
        counts = counts.withColumn("n", F.expr(f"(n + {ARITY**LEVELS} - 1) div {ARITY**LEVELS}"))
    out = rungs[-1].select("key", "pos", "path", F.col("node").alias("root"))
    for rung in reversed(rungs[:-1]):
        above = out.select("key", F.col("pos").alias("up"), F.col("path").alias("rest"), "root")
        out = rung.join(above, ["key", "up"]).select("key", "pos", F.concat("path", "rest").alias("path"), "root")
    return stage(out)


def _resume(paths_column: pa.Array, folded: np.ndarray, proof: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Folds along records, a level of all rows at a time; the proof's hash goes on in place."""
    held = paths_column.to_pylist()
    for k in range(max((len(p) for p in held), default=0) // RECORD):
        at = np.array([i for i, p in enumerate(held) if len(p) > k * RECORD])
        table = np.frombuffer(b"".join(held[i][k * RECORD : (k + 1) * RECORD] for i in at), np.uint8).reshape(len(at), RECORD)
        left, right = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64)
        state = np.ascontiguousarray(table[:, 2:34]).view(">u4").astype(_U)
        siblings = np.ascontiguousarray(table[:, 34:]).view(">u4").astype(_U).reshape(len(at), ARITY - 1, 8)
        state = compress(state, hex_block(folded[at]))
        for j in range(ARITY - 1):
            seen = np.flatnonzero(j < left + right)
            proof[at[seen]] = compress(proof[at[seen]], hex_block(siblings[seen, j]))
            after = seen[j >= left[seen]]
            state[after] = compress(state[after], hex_block(siblings[after, j]))
        blocks[at] += left + right
        folded[at] = finished(state, left + right + 1)
    return folded


def _to_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        folded, proof = words_of(batch.column("folded")), words_of(batch.column("proof"))
        blocks = batch.column("blocks").to_numpy().copy()
        folded = _resume(batch.column("path"), folded, proof, blocks)
        out = batch.select(["key", "doc_id", "leaf", "subroot", "root"])
        yield out.append_column("proof", bytes_of(finished(proof, blocks))).append_column("folded", bytes_of(folded))


def leaf(columns: list[Column]) -> Column:
    """Hex digest of values: ``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(docs: DataFrame, changed: dict[str, Column], fields: list[str] = FIELDS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """Every row's place in the tree and what a change of its own does to the root.

    ``changed`` has the new value of columns (from columns of ``docs``). Returns ``order``, ``group``, ``leaf``, ``subroot``,
    ``root``, ``proof_sha256`` (hash of the siblings up to the root), ``folded_root`` (from the changed leaf, the kept states and
    the right siblings) and ``verified``.
    """
    now = [F.col(f"`{c}`") for c in fields]
    new = [changed.get(c, F.col(f"`{c}`")) for c in fields]
    differs = ~F.lit(True)
    for c in changed:
        differs = differs | ~F.col(f"`{c}`").eqNullSafe(changed[c])
    before = leaf(now)
    # A group is never empty text here, so that NULL comes first and joins need no NULLs.
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("key"),
        F.col(f"`{order}`").alias("doc_id"),
        F.unhex(before).alias("digest"),
        F.when(differs, F.unhex(leaf(new))).alias("other"),
    )
    numbered = ordered_pass(rows.withColumn("twin", F.monotonically_increasing_id()), Walk(["key"]), [F.col("doc_id"), F.col("digest"), F.col("other"), F.col("twin")])
    leaves = numbered.select("key", "doc_id", "digest", F.coalesce("other", "digest").alias("changed"), (F.col("row_number") - 1).alias("pos"))
    counts = stage(leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"key string, doc_id {kind}, leaf binary, up long, node binary, folded binary, proof binary, blocks long"
    low = stage(_by_cell(leaves, counts, total, _folded_subtrees, schema))

    within = paths(low.select("key", F.col("up").alias("pos"), F.col("node").alias("digest")).distinct())
    subroots = within.select("key", F.col("root").alias("digest")).distinct()
    placed = ordered_pass(subroots, Walk([]), [F.col("key")]).select(F.lit("").alias("key"), F.col("key").alias("group"), "digest", (F.col("row_number") - 1).alias("pos"))
    groups = stage(placed)
    top = paths(groups.select("key", "pos", "digest")).select("pos", F.col("path").alias("rest"), F.col("root").alias("top"))
    above = groups.join(top, "pos").select(F.col("group").alias("key"), "rest", "top")
    whole = within.join(above, "key").select("key", F.col("pos").alias("up"), F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))

    folded = low.join(whole, ["key", "up"]).mapInArrow(_to_root, f"key string, doc_id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary")
    text = lambda c: F.lower(F.hex(c))
    return folded.select(
        F.col("doc_id").alias(order),
        F.when(F.col("key") != "", F.expr("substr(key, 2)")).alias(group),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
