"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources, and every row's proof.

Leaves of a source are ordered, numbered and dealt to aligned blocks of a power of the fanout. A block hashes its own
subtree. Then the blocks climb in rounds of a butterfly exchange: in round r the block numbered b meets those whose
number differs from b in its r-th digit to the base of the fanout only, at most as many as the fanout. They swap the roots of
the subtrees they have reached, and each hashes the common parent for itself. Ancestors are hashed redundantly, but every block
ends with the top and all siblings on its way, and nothing is sent back down. Where the last subtree of a round is short
of blocks, its blocks take over the meetings of the missing ones in turn.

H is the lowercase hex SHA-256; a node is H of its children's hex digests concatenated. The last run of a level may be
shorter than the fanout, even one node, and is hashed alike; a tree of one leaf is that leaf.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.llm.common import stored
from conceptspark.operators.joins import join_counted
from conceptspark.operators.ranking import rank_by_range

FANOUT = 16
BLOCK = 4096  # leaves of a block, a power of the fanout: rows of one task at a time
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"  # digests before and after the own one in its run


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def parent(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, b, top, steps): top of each tree and the steps from node b up to it.

    ``nodes`` has tree (not null), b (0 to n - 1 without gaps), n and node. Each round is one shuffle in which a block sends its
    node once (or, in a subtree short of blocks, as often as blocks are missing), written to the shared folder.
    """
    state = nodes.select("tree", "b", "n", F.col("node").alias("top"), F.expr(f"CAST(array() AS array<{STEP}>)").alias("steps"))
    widest = state.agg(F.max("n")).first()[0] or 0
    done, span = None, 1  # span: blocks below a node of this round
    while span < widest:
        over = state.where(F.col("n") <= span)
        done = over if done is None else done.unionByName(over)
        place = F.floor(F.col("b") / span)
        members = F.least(F.lit(span), F.col("n") - place * span)
        climbing = state.where(F.col("n") > span).withColumns({"place": place, "low": F.col("b") % span, "members": members})
        # a block sits at its own low digits; those of a short subtree also stand in for the missing ones, in turn
        sent = climbing.withColumn("seat", F.explode(F.sequence(F.col("low"), F.lit(span - 1), F.col("members"))))
        own = F.when(F.col("seat") == F.col("low"), F.struct("b", "place", "steps"))
        met = sent.groupBy("tree", "n", F.floor(F.col("place") / fanout).alias("run"), "seat").agg(
            F.array_sort(F.collect_list(F.struct("place", F.col("top").alias("node")))).alias("run_nodes"),
            F.collect_list(own).alias("blocks"),  # nulls are left out
        )
        each = met.withColumn("block", F.explode("blocks"))
        digests = lambda keep: F.array_join(F.transform(F.filter("run_nodes", keep), lambda x: x["node"]), "")
        step = F.struct(
            digests(lambda x: x["place"] < F.col("block.place")).alias("left"), digests(lambda x: x["place"] > F.col("block.place")).alias("right")
        )
        raised = each.select(
            "tree", F.col("block.b").alias("b"), "n", parent(F.transform("run_nodes", lambda x: x["node"])).alias("top"),
            F.concat("block.steps", F.array(step)).alias("steps"),
        )
        state = stored(raised, "butterfly")
        span *= fanout
    out = state if done is None else done.unionByName(state)
    return out.select("tree", "b", "top", "steps")


def _levels(digests: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """All levels of a tree, leaves first, up to one node or over ``height`` levels."""
    levels = [digests]
    while (len(levels[-1]) > 1) if height is None else (len(levels) <= height):
        below = levels[-1]
        levels.append([sha256("".join(below[k : k + fanout]).encode()).hexdigest() for k in range(0, len(below), fanout)])
    return levels


def _block_levels(rows: pa.Table, fanout: int, height: int) -> tuple[np.ndarray, list[list[str]]]:
    """Order of a block's rows and the levels of its subtree: of full height where the source has other blocks."""
    order = np.argsort(rows["position"].to_numpy(), kind="stable")
    leaves = rows["leaf"].take(pa.array(order)).to_pylist()
    return order, _levels(leaves, fanout, height if rows["n"][0].as_py() > 1 else None)


def _subtree(key: tuple[pa.Scalar, ...], rows: pa.Table, fanout: int, height: int) -> pa.Table:
    _, levels = _block_levels(rows, fanout, height)
    return pa.table({"tree": [key[0].as_py()], "b": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([rows["n"][0].as_py()], pa.int64()), "node": levels[-1]})


def _proofs(rows: pa.Table, above: pa.Table, fanout: int, height: int, names: list[str]) -> pa.Table:
    """Proof, recomputed root and verdict of every row of a block, from its subtree and the steps above it."""
    order, levels = _block_levels(rows, fanout, height)
    upper = above.to_pylist()[0]
    steps = [(s["left"], s["right"]) for s in upper["steps"]]
    tail = "".join(a + b for a, b in steps)
    now = rows["tampered"].take(pa.array(order)).to_pylist()
    runs = []  # per level: the digests of a run joined, and where the own digest stands in it
    for level in levels[:-1]:
        runs.append(["".join(level[k : k + fanout]) for k in range(0, len(level), fanout)])
    proofs, folded = [], []
    for k, mine in enumerate(now):
        parts, place, digest = [], k, mine
        for run in runs:
            joined, at = run[place // fanout], place % fanout * 64
            left, right = joined[:at], joined[at + 64 :]
            parts += (left, right)
            digest = sha256((left + digest + right).encode()).hexdigest()
            place //= fanout
        for left, right in steps:
            digest = sha256((left + digest + right).encode()).hexdigest()
        proofs.append(sha256(("".join(parts) + tail).encode()).hexdigest())
        folded.append(digest)
    kept = rows.take(pa.array(order))
    columns = {
        "subroot": [upper["subroot"]] * len(order), "root": [upper["root"]] * len(order), "proof_sha256": proofs, "folded_root": folded,
        "verified": [f == upper["root"] for f in folded],
    }
    return pa.table({n: columns[n] if n in columns else kept[n] for n in names})


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", group: str = "source", fields: list[str] = FIELDS, tampered: list[Column] | None = None,
    fanout: int = FANOUT, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``fields`` make the leaf; ``tampered`` are the same fields as they are found later (default: unchanged), from which the root
    is recomputed along the original siblings. Rows of a source are ordered by id (null first), equal ids by their leaves, so
    that repeated rows have places of their own. A null source is a source of its own, before all others. An empty table gives
    no rows. Other columns are not read, so their names cannot clash.
    """
    height = 0
    while fanout**height < block:
        height += 1
    if fanout**height != block:
        raise ValueError("block must be a power of fanout")
    # a key that is never null and keeps the bytewise order, the null source first
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit(""))
    original = [F.col(f"`{c}`") for c in fields]
    leaves = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), tree.alias("tree"), leaf(original).alias("leaf"), leaf(tampered or original).alias("tampered"))
    placed = rank_by_range(leaves, ["tree"], ["doc_id", "leaf", "tampered"], "place")
    placed = stored(placed.select("doc_id", "tree", "leaf", "tampered", (F.col("place") - 1).cast("long").alias("position")), "leaves")
    sizes = placed.groupBy("tree").agg(F.ceil((F.max("position") + 1) / block).cast("long").alias("n"))
    rows = join_counted(placed, sizes, ["tree"]).withColumn("b", F.floor(F.col("position") / block))

    subtrees = rows.select("tree", "b", "position", "n", "leaf").groupBy("tree", "b").applyInArrow(
        lambda key, table: _subtree(key, table, fanout, height), "tree string, b bigint, n bigint, node string"
    )
    within = stored(butterfly(stored(subtrees, "subtrees"), fanout), "within")
    sources = rank_by_range(within.where("b = 0").select(F.col("tree").alias("source"), F.col("top").alias("node")), [], ["source"], "place")
    sources = stored(sources, "sources")
    total = sources.count()
    numbered = sources.select(F.lit("").alias("tree"), (F.col("place") - 1).cast("long").alias("b"), F.lit(total).cast("long").alias("n"), "node")
    over = butterfly(numbered, fanout).select((F.col("b") + 1).alias("place"), F.col("top").alias("root"), F.col("steps").alias("upper"))
    roots = sources.select(F.col("source").alias("tree"), "place").join(over, "place").drop("place")
    above = join_counted(within.withColumnRenamed("top", "subroot"), roots, ["tree"]).select(
        "tree", "b", "subroot", "root", F.concat("steps", "upper").alias("steps")
    )
    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = [part.strip().split()[0] for part in schema.split(",")]
    return (
        rows.groupBy("tree", "b")
        .cogroup(above.groupBy("tree", "b"))
        .applyInArrow(lambda left, right: _proofs(left, right, fanout, height, names), schema)
    )


def lowercased_every_fifth(doc_id: str = "doc_id", fields: list[str] = FIELDS, text: str = "text") -> list[Column]:
    """The fields with A-Z of the text lower-cased where 5 divides the unsigned crc32 of the decimal id; a null id changes nothing."""
    hit = F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 0
    changed = F.when(hit, F.translate(F.col(f"`{text}`"), UPPER, LOWER)).otherwise(F.col(f"`{text}`"))
    return [changed if c == text else F.col(f"`{c}`") for c in fields]


def _oracle(levels: int = 5) -> str:
    """DuckDB SQL for the manifest of documents: five levels per tree, enough for 16^5 rows a source and as many sources."""
    # crc32 of the decimal id, bit by bit
    byte = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, x: {byte}), 4294967295)"
    part = lambda v, size: f"coalesce({size} || ':' || {v}, '-')"
    fixed = " || ".join(part(f"{c}::VARCHAR", f"strlen({c}::VARCHAR)") for c in FIELDS[:-1])
    text = lambda v: part(v, f"strlen({v})")
    lowered = f"CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    ctes = [
        f"""r AS (SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS place, * FROM (
            SELECT doc_id, source, sha256({fixed} || {text('text')}) AS leaf, sha256({fixed} || {text('now')}) AS tampered
            FROM (SELECT *, {lowered} AS now FROM documents)))""",
        "a0 AS (SELECT source, place AS p, leaf AS node FROM r)",
    ]
    run = "PARTITION BY source, p // 16 ORDER BY p ROWS BETWEEN"

    def climb(name):
        for k in range(levels):
            ctes.append(f"""{name}s{k} AS (SELECT source, p, p // 16 AS up,
                coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g,
                count(*) OVER (PARTITION BY source) > 1 AS more FROM {name}{k})""")
            ctes.append(f"""{name}{k + 1} AS (SELECT source, p // 16 AS p, CASE WHEN (SELECT count(*) FROM {name}{k} o WHERE o.source IS NOT DISTINCT FROM t.source) > 1
                THEN sha256(string_agg(node, '' ORDER BY p)) ELSE any_value(node) END AS node FROM {name}{k} t GROUP BY source, p // 16)""")

    climb("a")
    ctes.append(f"""b0 AS (SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, node FROM a{levels})""")
    ctes.append(f"""n AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS q FROM a{levels})""")
    climb("b")
    ctes.append("""f0 AS (SELECT r.*, subroot, place AS p, q, '' AS proof, tampered AS folded FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source)""")
    for step in range(2 * levels):
        name, k = ("a", step) if step < levels else ("b", step - levels)
        key = "s.source IS NOT DISTINCT FROM f.source AND s.p = f.p" if name == "a" else "s.p = f.q"
        moved = "s.up AS p, q" if name == "a" else "f.p, s.up AS q"
        ctes.append(f"""f{step + 1} AS (SELECT doc_id, f.source, leaf, subroot, {moved}, CASE WHEN more THEN proof || l || g ELSE proof END AS proof,
            CASE WHEN more THEN sha256(l || folded || g) ELSE folded END AS folded FROM f{step} f JOIN {name}s{k} s ON {key})""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, b{levels}.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b{levels}.node AS verified
FROM f{2 * levels}, b{levels}"""


ORACLE = _oracle()
