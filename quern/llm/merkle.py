"""A Merkle manifest of a table: hashes of rows, of runs of rows by source, and of the sources, with a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import keep, materialize, quoted, temporary

#: Nodes of one run, whose hash is their parent.
FAN = 3
#: Levels that one pass climbs: FAN ** LEVELS nodes of one source stand in a window, and no more.
LEVELS = 6


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(*map(field, columns))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, their place from 0 within their group, and n, its size.

    One range exchange over group and order deals the rows, so that a large group takes many tasks; ties are parted by
    their place in the input. Counts by task and group then say where each task begins within the group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    marked = materialize(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    marked = marked.withColumn("_part", F.shiftright("_at", 33))
    counts = marked.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_group")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_part").alias("_p"), "_group", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    met = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))
    pos = (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos")
    return marked.join(counts, met).select(*(c for c in rows.columns), pos, "n")


def climb(nodes: DataFrame, group: str) -> DataFrame:
    """LEVELS levels above nodes (group, pos, n, node and others), by window functions within FAN ** LEVELS neighbours.

    At level k the nodes stand in the rows whose pos is a multiple of FAN ** k, so its neighbours are FAN ** k rows
    away: lag and lead by that offset, masked by the slot in the run, are the siblings; lead is null where the run is
    shorter. The row of the first child hashes the parent. Rows between take the siblings of their ancestor, the last
    node before them. Adds chunk, path (left and right siblings by level, while the group has several nodes) and, in
    the first row of each chunk, top.
    """
    rows = nodes.withColumn("chunk", F.expr(f"pos div {FAN**LEVELS}")).withColumn("_h", F.col("node"))
    near = Window.partitionBy(group, "chunk").orderBy("pos")
    sofar = near.rowsBetween(Window.unboundedPreceding, 0)
    for k in range(LEVELS):
        step = FAN**k
        sides = {f"_lag{i}": F.lag("_h", i * step).over(near) for i in range(1, FAN)}
        sides |= {f"_lead{i}": F.lead("_h", i * step).over(near) for i in range(1, FAN)}
        rows = rows.withColumns(sides)
        slot, is_node, several = F.expr(f"(pos div {step}) % {FAN}"), F.expr(f"pos % {step} = 0"), F.col("n") > step
        nothing = F.lit("")
        left = F.concat(*(F.when(slot >= i, F.col(f"_lag{i}")).otherwise(nothing) for i in range(FAN - 1, 0, -1)))
        right = F.concat(*(F.when(slot < FAN - i, F.coalesce(f"_lead{i}", nothing)).otherwise(nothing) for i in range(1, FAN)))
        own = F.when(is_node, F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(several, digest("_h", *(F.coalesce(f"_lead{i}", nothing) for i in range(1, FAN)))).otherwise(F.col("_h"))
        rows = rows.withColumns({f"_s{k}": own, "_h": F.when(F.expr(f"pos % {FAN * step} = 0"), parent)})
    siblings = [F.when(F.col("n") > FAN**k, F.last(f"_s{k}", ignorenulls=True).over(sofar)) for k in range(LEVELS)]
    path = F.filter(F.array(*siblings), lambda x: x.isNotNull()).alias("path")
    return rows.select(*(quoted(c) for c in nodes.columns), "chunk", path, F.col("_h").alias("top"))


def _passes(nodes: DataFrame, group: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of all passes, from the leaves up, and the last node of each group (group, node)."""
    done: list[DataFrame] = []
    while True:
        rows = materialize(climb(nodes, group), f"{name}{len(done)}")
        done.append(rows)
        up = F.expr(f"(n + {FAN**LEVELS - 1}) div {FAN**LEVELS}").alias("n")
        nodes = rows.filter("top IS NOT NULL").select(group, F.col("chunk").alias("pos"), up, F.col("top").alias("node"))
        if rows.filter(F.col("n") > FAN**LEVELS).isEmpty():
            return done, nodes.select(group, "node")


def _joined(rows: DataFrame, above: DataFrame, group: str) -> DataFrame:
    """rows with the path of their chunk's node after their own, and the other columns of above (_g, _pos, _path, ...)."""
    met = rows[quoted(group)].eqNullSafe(above["_g"]) & (rows["chunk"] == above["_pos"])
    more = [c for c in above.columns if c not in ("_g", "_pos", "_path")]
    path = F.concat("path", "_path").alias("path")
    return rows.join(above, met).select(*(rows[quoted(c)] for c in rows.columns if c not in ("path", "top", "chunk")), path, *more)


def _full_paths(passes: list[DataFrame], above: DataFrame, group: str) -> DataFrame:
    """The first pass's rows with their whole path: passes from the top down, each joined with the one above it."""
    for rows in reversed(passes):
        joined = _joined(rows, above, group)
        others = [c for c in above.columns if c not in ("_g", "_pos", "_path")]
        above = joined.select(F.col(group).alias("_g"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *others)
    return joined


def merkle_tree(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves (group, order columns, node and others, none of them named pos, n, path, subroot or root) with subroot,
    root and path: left and right siblings, level by level, from the leaf to the root.

    Leaves of a group ascend by order, equal ones in any order, nulls first; while several nodes are left, each FAN of
    them become their digest, the last run even of one. The last nodes of the groups, ordered by group with null first,
    likewise give the root. Runs in passes of LEVELS levels: a pass deals its rows by group and by FAN ** LEVELS
    neighbours, so no task holds a group, and writes its table; the next has a row for each such chunk.
    """
    with temporary():
        own, tops = _passes(placed(leaves, group, [*order, "node"]), group, "nodes")
        tops = tops.select(F.col(group).alias("_g"), "node", F.lit(0).alias("_all"))
        upper, root = _passes(placed(tops, "_all", ["_g"]), "_all", "groups")
        root = root.select(F.col("_all").alias("_g"), F.lit(0).cast("long").alias("_pos"), F.array().cast(upper[0].schema["path"].dataType).alias("_path"), F.col("node").alias("root"))
        groups = _full_paths(upper, root, "_all").select("_g", F.lit(0).cast("long").alias("_pos"), F.col("path").alias("_path"), F.col("node").alias("subroot"), "root")
        return keep(_full_paths(own, materialize(groups, "groups"), group).drop("pos", "n"), "tree")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda a, x: digest(x["left"], a, x["right"]))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Trees are built by source over untampered leaves.
    Where crc32 of the decimal doc_id is even, the text then loses its line feeds and the leaf is made again; folding
    the proof from there gives folded_root, which equals root unless there was a line feed. A null in any column counts
    as `-`; a null doc_id stands first in its source and is not tampered with; a null source is a source of its own.
    Repeated rows are leaves of their own; an empty table gives no rows; other columns are not read. The texts are read
    once; from there on a row is two digests, an id and its proof.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(F.contains("text", F.lit("\n")) & changed.isNotNull(), leaf([*columns[:-1], changed]))
    with temporary():
        rows = docs.select(F.col("doc_id"), F.col("source").alias("_source"), leaf(columns).alias("node"), tampered.alias("_tampered"))
        tree = merkle_tree(materialize(rows, "leaves"), "_source", ["doc_id"])
        proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
        back = folded(F.coalesce("_tampered", "node"), F.col("path"))
        out = tree.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), back.alias("folded_root"))
        return keep(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")


def merkle_sql(depth: int = 12, group_depth: int = 5) -> str:
    """The same rows in DuckDB SQL, level by level, for at most FAN ** depth leaves of a source."""
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    whole = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # CRC-32, least bit first: only its parity is used.
    bits = "flatten(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: list_transform(range(8), lambda b: (CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INT), 1)) AS BIGINT) >> CAST(b AS BIGINT)) & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * CAST(3988292384 AS BIGINT))), CAST(4294967295 AS BIGINT))"
    parts = [
        f"d AS MATERIALIZED (SELECT *, {whole('text')} AS leaf, {crc} % 2 = 0 AS even, {whole(chr(39).join(['replace(text, chr(10), ', '', ')']))} AS bare FROM documents)",
        "x0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, CASE WHEN even THEN bare ELSE leaf END AS cur, '' AS proof FROM d)",
        "n0 AS MATERIALIZED (SELECT source, p, leaf AS h FROM x0)",
    ]

    def level(k: int, prefix: str, source: str) -> None:
        over = f"OVER (PARTITION BY {source}, p // 3 ORDER BY p)"
        left = f"coalesce(lag(h, 2) {over}, '') || coalesce(lag(h, 1) {over}, '')"
        right = f"coalesce(lead(h, 1) {over}, '') || coalesce(lead(h, 2) {over}, '')"
        parts.append(f"{prefix}s{k} AS MATERIALIZED (SELECT {source}, p, {left} AS l, {right} AS r, h, count(*) OVER (PARTITION BY {source}) AS m FROM {prefix}n{k})")
        up = "sha256(string_agg(h, '' ORDER BY p))"
        parts.append(f"{prefix}n{k + 1} AS MATERIALIZED (SELECT {source}, p // 3 AS p, CASE WHEN max(m) > 1 THEN {up} ELSE max(h) END AS h FROM {prefix}s{k} GROUP BY 1, 2)")

    columns = "x.doc_id, x.leaf, x.source, x.p, x.n"
    for k in range(depth):
        level(k, "", "source")
        fold = f"CASE WHEN x.n > {FAN**k} THEN sha256(s.l || x.cur || s.r) ELSE x.cur END AS cur, x.proof || s.l || s.r AS proof"
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT {columns}, {fold} FROM x{k} x JOIN s{k} s ON x.source IS NOT DISTINCT FROM s.source AND x.p // {FAN**k} = s.p)")
    parts.append(f"gn0 AS MATERIALIZED (SELECT 0 AS a, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, h, source AS src FROM n{depth})")
    parts.append("g AS MATERIALIZED (SELECT src, p, h AS subroot, count(*) OVER () AS n FROM gn0)")
    parts.append(f"y0 AS MATERIALIZED (SELECT x.doc_id, x.leaf, x.cur, x.proof, g.p, g.n, g.subroot FROM x{depth} x JOIN g ON x.source IS NOT DISTINCT FROM g.src)")
    for k in range(group_depth):
        level(k, "g", "a")
        fold = f"CASE WHEN y.n > {FAN**k} THEN sha256(s.l || y.cur || s.r) ELSE y.cur END AS cur, y.proof || s.l || s.r AS proof"
        parts.append(f"y{k + 1} AS MATERIALIZED (SELECT y.doc_id, y.leaf, y.p, y.n, y.subroot, {fold} FROM y{k} y JOIN gs{k} s ON y.p // {FAN**k} = s.p)")
    final = f"SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM y{group_depth}, gn{group_depth}"
    return f"WITH {', '.join(parts)} {final}"
