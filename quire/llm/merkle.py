"""A Merkle manifest of a dataset: a leaf for each row, a tree for each partition value, and one over the roots of these.

Leaves are hashed by DataFrame functions and placed by a range sort. Blocks of 8**4 consecutive nodes are then single rows,
reduced to one node each by tasks; that is repeated until few nodes are left. The driver builds the top of the trees from
these and broadcasts it; from it tasks make each block's path to the root, and give every row its proof and its fold.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_groups, materialise, released
from .sharding import ranked

ARITY = 8
LEVELS = 4  # levels of a block: 4,096 leaves at most, a row of 400 kB
TOP = 1 << 16  # nodes that the driver takes at most: 6 MB with their tree
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "path array<struct<before:string,after:string>>"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """The hash of a row's values, each as `-` for null, else its UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def next_level(nodes: list[str]) -> list[str]:
    return [H("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]


def levels_of(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The levels of a tree from `nodes` up: until one node remains, or `most` levels of runs are hashed."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        out.append(next_level(out[-1]))
    return out


def depth(n: int) -> int:
    """How many levels of runs lie above n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after a node in its run, joined, level by level from place `at` of the lowest."""
    out = []
    for nodes in levels[:-1]:
        a = at - at % ARITY
        out.append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + ARITY])))
        at //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = H(before + node + after)
    return node


# ---------------------------------------------------------------- blocks

def _blocks(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """Nodes (tree, pos, n, hash, ...) as rows (tree, block, n, items, node): n nodes has the tree on this level, node is the block's."""
    rest = [c for c in nodes.columns if c not in ("tree", "n")]
    items = F.sort_array(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("items")  # ARITY ** levels at most
    rows = nodes.groupBy("tree", F.expr(f"pos div {ARITY ** levels}").alias("block"), "n").agg(items)
    names = [*rows.columns, "node"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hashes = [[x["hash"] for x in row] for row in batch.column(3).to_pylist()]
            made = [levels_of(h, min(levels, depth(n)))[-1][0] for h, n in zip(hashes, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=names)

    return materialise(rows.mapInArrow(released(run), f"tree bigint, block bigint, n bigint, items {rows.schema['items'].dataType.simpleString()}, node string"), name)


def _above(blocks: DataFrame, levels: int) -> DataFrame:
    """The blocks' nodes as nodes of the next pass."""
    size = ARITY**levels
    return blocks.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("node").alias("hash"))


def _top(nodes: list[tuple[int, int, str]], roots: bool):
    """From the last pass's nodes (tree, pos, hash): (levels of each tree, the place of each tree in the upper tree, the upper tree's levels).

    roots: the nodes are of the upper tree itself.
    """
    trees: dict[int, list[str]] = {}
    for tree, _, node in sorted(nodes):
        trees.setdefault(tree, []).append(node)
    own = {t: levels_of(v) for t, v in trees.items()}
    upper = own[-1] if roots else levels_of([own[t][-1][0] for t in sorted(own)])
    return own, {t: i for i, t in enumerate(sorted(own))}, upper


def _top_paths(nodes: DataFrame, top, roots: bool) -> DataFrame:
    """Each node's path to the root: (tree, block, path, subroot), made by tasks from the broadcast top."""
    held = nodes.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        own, place, upper = held.value
        for batch in batches:
            trees, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            paths, subroots = [], []
            for t, p in zip(trees, at):
                path = siblings(own[t], p)
                if not roots:
                    path += siblings(upper, place[t])
                paths.append([{"before": a, "after": b} for a, b in path])
                subroots.append(None if roots else own[t][-1][0])
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.array(at, pa.int64()), pa.array(paths, kind), pa.array(subroots, pa.string())], names=["tree", "block", "path", "subroot"])

    return nodes.select("tree", "pos").mapInArrow(run, f"tree bigint, block bigint, {PATH}, subroot string")


def _paths_below(blocks: DataFrame, paths: DataFrame, levels: int, roots: bool) -> DataFrame:
    """The paths of a pass's nodes, which are the blocks of the pass below it. roots: these nodes are the trees' own roots."""
    rows = blocks.join(paths, ["tree", "block"]).select("tree", "n", "items", "path", "subroot")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for tree, n, items, path, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                own = levels_of([x["hash"] for x in items], min(levels, depth(n)))
                made = [[{"before": a, "after": b} for a, b in siblings(own, i)] + path for i in range(len(items))]
                pos = [x["pos"] for x in items]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pos if roots else [tree] * len(pos), pa.int64()), pa.array([0] * len(pos) if roots else pos, pa.int64()), pa.array(made, kind), pa.array([x["hash"] if roots else subroot for x in items], pa.string())],
                    names=["tree", "block", "path", "subroot"],
                )

    return rows.mapInArrow(released(run), f"tree bigint, block bigint, {PATH}, subroot string")


def _finished(blocks: DataFrame, paths: DataFrame, root: str, levels: int, id_type: str, proofs: bool) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]) of the lowest blocks."""
    rows = blocks.join(paths, ["tree", "block"]).select("n", "items", "path", "subroot")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids_of, at = batch.column(1), 0
            every = pc.struct_field(ids_of.flatten(), "id")
            for n, items, path, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                leaves = [x["hash"] for x in items]
                own, rest = levels_of(leaves, min(levels, depth(n))), [(x["before"], x["after"]) for x in path]
                tail = "".join(a + b for a, b in rest).encode()
                digests, folds, kept = [], [], []
                for i, x in enumerate(items):
                    mine = siblings(own, i)
                    proof = hashlib.sha256("".join(a + b for a, b in mine).encode())
                    proof.update(tail)
                    digests.append(proof.hexdigest())
                    folds.append(fold(x["other"] or x["hash"], mine + rest))
                    if proofs:
                        kept.append([{"before": a, "after": b} for a, b in mine + rest])
                k = len(items)
                columns = [every.slice(at, k), pa.array(leaves), pa.array([subroot] * k), pa.array([root] * k), pa.array(digests), pa.array(folds), pa.array([f == root for f in folds])]
                names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if proofs:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], [*names, "proof"]
                at += k
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = f", {PATH.replace('path', 'proof', 1)}" if proofs else ""
    return rows.mapInArrow(released(run), f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{more}")


def manifest(df: DataFrame, columns: tuple[str, ...] = COLUMNS, tree_col: str = "lang", id_col: str = "doc_id", other: dict[str, Column] | None = None, proofs: bool = False, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """Each row's id, leaf, its tree's root, the root of all, and its proof and fold; one row for each row of df.

    other: columns as they are found now, where they may differ from what the manifest was built of; the leaf of these is
    folded along the row's path, and `verified` tells whether it gives the root. proofs: with the path itself, as `proof`.

    Trees go by tree_col, null first, then bytewise; leaves by id, null first, then by hash, so repeated rows are leaves of
    their own side by side. An empty table gives no rows. Texts are hashed where they are read and travel no further;
    columns that aren't named are ignored. A tree may hold all rows, or each row may be a tree of its own.
    """
    spark, tree = df.sparkSession, F.col(tree_col).cast("string")
    now = leaf_hash([(other or {}).get(c, F.col(c)) for c in columns])
    rows = df.select(tree.alias("name"), F.col(id_col).alias("id"), leaf_hash([F.col(c) for c in columns]).alias("hash"), (now if other else F.lit(None).cast("string")).alias("other"))
    rows = materialise(rows.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other"))), "leaves")
    order = ranked(rows, ["name", "id", "hash", "other"], "at")
    trees = materialise(order.groupBy("name").agg(F.count("*").alias("n_rows"), F.min("at").alias("first"), F.count("*").alias("n")), "trees")
    trees = materialise(ranked(trees, ["name"], "tree").drop("tree_of"), "trees")
    placed = join_groups(order.drop("at_of"), trees, "name", "n_rows").selectExpr("tree", "at - first as pos", "n", "hash", "id", "other")
    passes, roots = [_blocks(placed, levels, "blocks")], [False]
    nodes = _above(passes[-1], levels)
    while (found := nodes.agg(F.count("*").alias("n"), F.max("n").alias("most")).first())["n"] > top:
        flat = found["most"] == 1 and not any(roots)  # only roots are left, and they are too many
        if flat:
            nodes = nodes.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(found["n"]).cast("long").alias("n"), "hash")
        roots.append(flat)
        passes.append(_blocks(nodes, levels, "blocks"))
        nodes = _above(passes[-1], levels)
    got = [(r["tree"], r["pos"], r["hash"]) for r in nodes.collect()]  # `top` at most
    if not got:
        kinds = f"id {df.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame([], kinds + (f", {PATH.replace('path', 'proof', 1)}" if proofs else ""))
    upper = _top(got, any(roots))
    paths = _top_paths(nodes, upper, any(roots))
    for held, flat in zip(passes[:0:-1], roots[:0:-1]):
        paths = materialise(_paths_below(held, paths, levels, flat), "paths")
    return _finished(passes[0], paths, upper[2][-1][0], levels, df.schema[id_col].dataType.simpleString(), proofs)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what folds from a table of which a third has lost its capitals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    third = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    other = F.when(third, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))
    return manifest(docs, other={"text": other}).withColumnRenamed("id", "doc_id")


def _oracle(below: int = 7, above: int = 3) -> str:
    """The same in SQL, level by level, for trees of up to 8 ** below leaves and 8 ** above trees."""
    values = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)")
    part = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode(cast(doc_id as varchar))), '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(c >> 8, t[cast(xor(c & 255, b) as int) + 1])), 4294967295)"
    lower = f"translate(text, '{CAPITALS}', '{SMALL}')"
    head = " || ".join(part(v) for v in values)
    ctes = [
        f"k as (select {table} as t)",
        f"l as materialized (select doc_id, lang, sha256({head} || {part('text')}) as leaf, case when {crc} % 3 = 0 then sha256({head} || {part(lower)}) else sha256({head} || {part('text')}) end as other from documents cross join k)",
        "r as materialized (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from l)",
        "n0 as materialized (select tree, pos, leaf as h from r)",
        "p0 as materialized (select doc_id, leaf, tree, pos, '' as proof, other as f from r)",
    ]

    def level(i: int, tree: str) -> None:
        ctes.append(f"n{i + 1} as materialized (select tree, pos // {ARITY} as pos, case when max(many) then sha256(string_agg(h, '' order by pos)) else max(h) end as h from (select *, count(*) over (partition by tree) > 1 as many from n{i}) group by tree, pos // {ARITY})")
        sides = f"select a.tree, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as x, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as y, any_value(a.many) as many from (select *, count(*) over (partition by tree) > 1 as many from n{i}) a join n{i} b on a.tree = b.tree and a.pos // {ARITY} = b.pos // {ARITY} group by a.tree, a.pos"
        ctes.append(f"p{i + 1} as materialized (select doc_id, leaf, tree, pos // {ARITY} as pos, proof || x || y as proof, case when many then sha256(x || f || y) else f end as f{', subroot' if tree else ''} from p{i} join ({sides}) using (tree, pos))")

    for i in range(below):
        level(i, "")
    i = below
    ctes.append(f"n{i + 1} as materialized (select -1 as tree, tree as pos, h from n{i})")
    ctes.append(f"p{i + 1} as materialized (select doc_id, leaf, -1 as tree, tree as pos, proof, f, h as subroot from p{i} join (select tree, h from n{i}) using (tree))")
    for j in range(i + 1, i + 1 + above):
        level(j, "upper")
    last = i + 1 + above
    return f"with {', '.join(ctes)} select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from p{last} cross join (select h from n{last})"


QUERIES = {"op13_merkle": op13_merkle}
ORACLES = {"op13_merkle": _oracle()}
