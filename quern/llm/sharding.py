"""Operator 10: sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child makes a
draw -ln(u) / weight with u hashed from the document and the child's path, and
the least draw wins, so a child receives its weight's share. Changing weights
inside one subtree moves documents only within that subtree, and between
children only towards those whose weight rose or away from those whose fell.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import fresh_name

#: region -> rack -> shard -> weight; a node weighs what its shards weigh.
TOPOLOGY = {
    "eu": {"a": {"0": 1.0, "1": 1.0, "2": 2.0}, "b": {"0": 1.0, "1": 1.0, "2": 1.0}},
    "us": {"a": {"0": 2.0, "1": 2.0, "2": 1.0}, "b": {"0": 2.0, "1": 1.0, "2": 1.0}, "c": {"0": 1.0, "1": 1.0}},
    "ap": {"a": {"0": 1.0, "1": 1.0}, "b": {"0": 1.0, "1": 0.5, "2": 0.5}},
}
LEVELS = ("region", "rack", "shard")


def weight(node) -> float:
    return float(node) if not isinstance(node, Mapping) else sum(weight(x) for x in node.values())


def _draw(key: Column, path: str, w: float) -> Column:
    # 52 bits of the digest, moved off zero so that the logarithm exists
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{path}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(2.0**52)) / F.lit(w)


def _choice(key: Column, node: Mapping, path: str) -> Column:
    live = {k: weight(v) for k, v in node.items() if weight(v) > 0}
    if not live:
        raise ValueError(f"no child of {path or 'the root'} has a weight")
    draws = [F.struct(_draw(key, f"{path}/{k}", w).alias("d"), F.lit(k).alias("k")) for k, w in sorted(live.items())]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["k"]


def _pick(column: Column, cases: list[tuple[str, Column]]) -> Column:
    """The case of the value that ``column`` has."""
    out = F.when(column == cases[0][0], cases[0][1])
    for value, then in cases[1:]:
        out = out.when(column == value, then)
    return out


def assign_shards(df: DataFrame, topology: Mapping = TOPOLOGY, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Place of every row: (id, carried columns, region, rack, shard).

    Rows with equal ids go to one place, whatever else they hold; ties of draws
    go to the child that is first by name. A null id is placed as the text
    ``null`` would be. Nodes of weight 0 get nothing; a tree without any weight
    is an error, and so is an id column named region, rack or shard. Carried
    columns of these names are replaced; other names are free. Repeated rows
    stay, an empty table gives none. Expressions only: no shuffle, no Python.
    """
    if id_col.lower() in LEVELS:
        raise ValueError(f"the id column may not be called {id_col}: places are")
    name = fresh_name(df, "__quern_key")
    live = {r: racks for r, racks in topology.items() if weight(racks) > 0}
    keep = [c for c in carry if c.lower() not in LEVELS and c.lower() != id_col.lower()]
    out = df.select(F.col(id_col), *(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias(name))
    k = F.col(name)
    out = out.withColumn("region", _choice(k, topology, ""))
    racks = [(r, _choice(k, x, f"/{r}")) for r, x in sorted(live.items())]
    out = out.withColumn("rack", _pick(F.col("region"), racks))
    shards = [(f"{r}/{c}", _choice(k, s, f"/{r}/{c}")) for r, x in sorted(live.items()) for c, s in sorted(x.items()) if weight(s) > 0]
    out = out.withColumn("shard", _pick(F.concat_ws("/", "region", "rack"), shards))
    return out.drop(name)


def write_sharded(df: DataFrame, path: str, topology: Mapping = TOPOLOGY, id_col: str = "doc_id", tasks: int = 16) -> None:
    """Write all rows and columns under region=/rack=/shard=.

    Names, null ids, repeated rows and empty tables are as in
    ``assign_shards``. A place's rows are spread over ``tasks`` tasks by a hash
    of the id, so that a place with a third of all rows isn't one task's work.
    """
    placed = assign_shards(df, topology, id_col, tuple(df.columns))
    placed.repartition(*LEVELS, F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(tasks))).write.partitionBy(*LEVELS).parquet(path)


def oracle(topology: Mapping = TOPOLOGY) -> str:
    """The same over table ``documents`` in DuckDB SQL."""
    rows = []
    for r, racks in topology.items():
        rows.append(("", r, weight(racks)))
        for c, shards in racks.items():
            rows.append((f"/{r}", c, weight(shards)))
            rows += [(f"/{r}/{c}", s, float(w)) for s, w in shards.items()]
    values = ", ".join(f"('{p}', '{k}', {w!r}::DOUBLE)" for p, k, w in rows if w > 0)
    draw = "-ln((('0x' || substr(md5({key} || '|' || n.path || '/' || n.child), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / n.w"
    level = "SELECT d.doc_id, d.key{cols}, arg_min(n.child, ({draw}, n.child)) AS {name} FROM {src} d JOIN nodes n ON n.path = {at} GROUP BY ALL"
    ids = "SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents"
    d = draw.format(key="d.key")
    return f"""
WITH nodes(path, child, w) AS (VALUES {values}), ids AS ({ids}),
regions AS ({level.format(cols="", draw=d, name="region", src="ids", at="''")}),
racks AS ({level.format(cols=", d.region", draw=d, name="rack", src="regions", at="'/' || d.region")}),
shards AS ({level.format(cols=", d.region, d.rack", draw=d, name="shard", src="racks", at="'/' || d.region || '/' || d.rack")})
SELECT x.doc_id, s.region, s.rack, s.shard FROM documents x JOIN shards s ON x.doc_id IS NOT DISTINCT FROM s.doc_id"""
