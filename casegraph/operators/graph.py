"""The person graph: edges from shared cases, checks, bounded traversal under access rules, statistics, export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.functions.scores import half_up
from casegraph.operators.components import components
from casegraph.sources.shared import materialise

# The types of edges, and those that count both ways.
EDGE_TYPES = ("CO_ACCUSED", "ACCUSED_TO_VICTIM", "CANDIDATE_MATCH", "SHARED_LOCATION")
MOST_HOPS = 3


def edge_id(kind: Column, a: Column, b: Column, case: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(kind, a, b, case)), 16, "0"))


def _edges(rows: DataFrame, kind: str) -> DataFrame:
    out = rows.select(F.lit(kind).alias("edge_type"), "source", "target", "case_id", F.lit(1.0).alias("confidence"))
    return out.withColumn("edge_id", edge_id(F.col("edge_type"), F.col("source"), F.col("target"), F.col("case_id")))


def groups(shared: DataFrame, by: str, cell: int = 500) -> DataFrame:
    """(by, xs, ys): the different persons (person_id) that share a value, in order, each of ``xs`` to be met with each of ``ys``. Written once, a row a value,
    so edges of a value with n persons take the room of n. A value of more than ``cell`` rows is dealt to chunks, of which each meets each."""
    keyed = shared.where(F.col(by).isNotNull() & F.col("person_id").isNotNull()).select(F.col(by).alias("k"), F.col("person_id").alias("p"))
    hot = materialise(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("k", F.ceil(F.col("n") / cell).cast("int").alias("chunks")), "hot")
    rows = keyed.join(hot, "k", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    sets = rows.groupBy("k", "chunks", F.pmod(F.xxhash64("p"), F.col("chunks")).alias("c")).agg(F.array_sort(F.collect_set("p")).alias("xs"))
    sets = materialise(sets.where((F.col("chunks") > 1) | (F.size("xs") > 1)), "groups")
    chunks = sets.where("chunks > 1").select("k", "xs")
    met = chunks.join(chunks.withColumnRenamed("xs", "ys"), "k")
    return sets.where("chunks = 1").select(F.col("k").alias(by), "xs", F.col("xs").alias("ys")).unionByName(met.withColumnRenamed("k", by))


def ways(met: DataFrame, by: str) -> DataFrame:
    """(by, source, target) of the persons of ``groups``, both ways."""
    return met.select(by, F.explode("xs").alias("source"), "ys").select(by, "source", F.explode("ys").alias("target")).where("source <> target")


def star(met: DataFrame) -> DataFrame:
    """(a, b): links that connect the persons of ``groups`` as all their edges do, about one a person and value."""
    first = met.select(F.col("xs")[0].alias("a"), F.explode("ys").alias("b"))
    return first.where("a <> b")


def shared_values(met: DataFrame, by: str) -> DataFrame:
    """(source, target, n, first): of each two persons of ``groups``, both ways, how many values they share and the least. Two persons meet once, not once a way."""
    one = ways(met, by).where("source < target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("first"))
    both = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    return one.select(F.inline(both), "n", "first")


def _both_ways(shared: DataFrame, by: str) -> DataFrame:
    """(by, source, target) of persons (person_id) that share a value, both ways, each once."""
    return ways(groups(shared, by), by)


def co_accused(accused: DataFrame) -> DataFrame:
    """Edges both ways between persons accused in a case (person_id, case_id), one for each case they share."""
    return co_accused_of(groups(accused, "case_id"))


def co_accused_of(met: DataFrame) -> DataFrame:
    """As ``co_accused``, of the cases' ``groups``."""
    return _edges(ways(met, "case_id"), "CO_ACCUSED")


def accused_to_victim(accused: DataFrame, victims: DataFrame) -> DataFrame:
    """Edges from a case's accused to its victims, not to themselves."""
    a = accused.select("case_id", F.col("person_id").alias("source")).distinct()
    v = victims.select("case_id", F.col("person_id").alias("target")).distinct()
    return _edges(a.join(v, "case_id").where("source <> target"), "ACCUSED_TO_VICTIM")


def shared_location(residents: DataFrame) -> DataFrame:
    """Edges both ways between persons (person_id, unit_id) of a station, without a case."""
    return _edges(_both_ways(residents, "unit_id").select("source", "target").distinct().withColumn("case_id", F.lit(None).cast("string")), "SHARED_LOCATION")


def candidate_matches(scored: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges both ways between different persons with an unconfirmed pair of records, with what kept the score low."""
    pairs = scored.where(F.col("decision") == "UNCONFIRMED")
    own = lambda n: owners.select(F.col("source_key").alias(n), F.col("person_id").alias(f"p_{n}"))
    met = pairs.join(own("a"), "a").join(own("b"), "b").where("p_a <> p_b")
    why = F.concat_ws("; ", F.when(F.col("age_score") < 0.7, "age differs"), F.when(F.col("location_score") < 0.6, "location differs"), F.when(F.col("name_score") < 0.8, "name differs"))
    best = met.groupBy(F.least("p_a", "p_b").alias("x"), F.greatest("p_a", "p_b").alias("y")).agg(F.max("score").alias("confidence"), F.max_by(why, "score").alias("reason"))
    both = best.select(F.col("x").alias("source"), F.col("y").alias("target"), "confidence", "reason").unionByName(best.select(F.col("y").alias("source"), F.col("x").alias("target"), "confidence", "reason"))
    return both.withColumns({"edge_type": F.lit("CANDIDATE_MATCH"), "case_id": F.lit(None).cast("string")}).withColumn("edge_id", edge_id(F.col("edge_type"), F.col("source"), F.col("target"), F.lit("")))


def dedupe(edges: DataFrame) -> DataFrame:
    """One edge an id, the first by type, source and target, with the highest confidence, and its cases gathered."""
    first = F.min(F.struct("edge_type", "source", "target"))
    one = edges.groupBy("edge_id").agg(first.alias("e"), F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("case_id")).alias("case_ids"))
    return one.select("edge_id", "e.edge_type", "e.source", "e.target", "confidence", "case_ids")


def checked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``fault``: malformed, unknown type, self-loop, dangling, duplicate or null."""
    known = nodes.select(F.col("person_id").alias("node")).distinct()
    out = edges.join(known.withColumnRenamed("node", "target").withColumn("there", F.lit(True)), "target", "left")
    out = out.join(edges.groupBy("edge_id").agg(F.count(F.lit(1)).alias("same")), "edge_id", "left")
    fault = (
        F.when(F.col("edge_id").isNull() | F.col("source").isNull() | F.col("target").isNull(), "malformed").when(~F.upper("edge_type").isin(*EDGE_TYPES), "unknown_type")
        .when(F.col("source") == F.col("target"), "self_loop").when(F.col("there").isNull(), "dangling").when(F.col("same") > 1, "duplicate")
    )
    return out.withColumn("fault", fault).drop("there", "same")


def diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return checked(edges, nodes).groupBy(F.coalesce("fault", F.lit("ok")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(person_id, edge_type, degree): distinct edges at a person."""
    ends = edges.select("edge_id", "edge_type", F.explode(F.array("source", "target")).alias("person_id")).distinct()
    return ends.groupBy("person_id", "edge_type").agg(F.count(F.lit(1)).alias("degree"))


def component_sizes(nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(size, components): how many components have a size, lone nodes among them. ``links``: (a, b) that connect what the edges do."""
    found = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")) if links is None else links)
    label = nodes.select("person_id").distinct().join(found, F.col("person_id") == F.col("node"), "left").select(F.coalesce("component", "person_id").alias("c"))
    return label.groupBy("c").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def statistics(nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """One row: nodes, edges, mean degree over all nodes, largest degree, components.

    ``unique``: no edge's id comes twice, none is null and none leads to its own beginning, so that edges can be counted where they are. ``links``: as for ``component_sizes``."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("person_id")).groupBy("person_id").agg(F.count(F.lit(1)).alias("degree"))
    degree = (ends if unique else degrees(edges)).groupBy("person_id").agg(F.sum("degree").alias("d")).agg(F.sum("d").alias("ends"), F.max("d").alias("max_degree"))
    n = nodes.select("person_id").distinct().agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg((F.count(F.lit(1)) if unique else F.countDistinct("edge_id")).alias("edges"))
    c = component_sizes(nodes, edges, links).agg(F.sum("components").alias("components"), F.max("size").alias("largest"))
    one = lambda df: df.withColumn("one", F.lit(1))
    out = one(n).join(one(e), "one").join(one(degree), "one").join(one(c), "one")
    return out.select("nodes", "edges", half_up(F.coalesce(F.col("ends"), F.lit(0)) / F.col("nodes"), 2).alias("avg_degree"), F.coalesce("max_degree", F.lit(0)).alias("max_degree"), "components", "largest")


def may_see(scope: dict) -> Column:
    """Whether a caller's scope covers a person: unit_ids and district_ids are arrays over the person's records."""
    if scope.get("role") == "Policymaker":
        return F.lit(False)
    some = F.size("unit_ids") > 0
    if scope.get("state_wide"):
        return some
    own = lambda ids, key: F.coalesce(F.array_contains(ids, F.lit(scope.get(key)).cast("string")), F.lit(False))
    return some & (own("unit_ids", "unit_id") | own("district_ids", "district_id"))


def request(person_id: str | None, max_hops: int | str | None = None, edge_types: list[str] | str | None = None, include_unconfirmed: bool | str | None = None) -> dict:
    """The options for ``traverse`` that a request gives: two hops, all types and no candidates unless it says otherwise. ValueError tells all that is wrong."""
    wrong = []
    if not isinstance(person_id, str) or not re.fullmatch(r"PM_[0-9a-f]{8}", person_id):
        wrong.append("person_id must be PM_ and eight hex digits")
    hops = 2 if max_hops is None else int(max_hops) if str(max_hops).lstrip("-").isdigit() else None
    if hops is None or not 1 <= hops <= MOST_HOPS:
        wrong.append(f"max_hops must be a number from 1 to {MOST_HOPS}")
    types = edge_types.split(",") if isinstance(edge_types, str) else edge_types
    if types is not None and (not types or any(t not in EDGE_TYPES for t in types)):
        wrong.append(f"edge types must be some of {', '.join(EDGE_TYPES)}")
    if include_unconfirmed not in (None, True, False, "true", "false"):
        wrong.append("include_unconfirmed must be true or false")
    if wrong:
        raise ValueError("; ".join(wrong))
    return {"start": person_id, "hops": hops, "types": types, "include_unconfirmed": include_unconfirmed in (True, "true")}


def traverse(nodes: DataFrame, edges: DataFrame, start: str, hops: int = 2, types: list[str] | None = None, least_confidence: float = 0.0, scope: dict | None = None, most_nodes: int | None = None, include_unconfirmed: bool = True, terminal: list[str] | None = None) -> DataFrame:
    """(person_id, hop, truncated) reachable from a person along edges in up to ``hops`` (1 to 3) steps, through persons that the caller may see.

    ACCUSED_TO_VICTIM leads one way, other types both ways. With ``most_nodes`` the nearest are kept, by hop and id, and
    ``truncated`` is true in all rows if some were left out. ``include_unconfirmed``: whether CANDIDATE_MATCH edges count.
    ``terminal``: types that are followed to their ends, but not beyond. Each step reads the edges and meets them with those
    just reached, which are written; edges are neither written nor grouped."""
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError("hops must be 1 to 3")
    seen = nodes.where(may_see(scope)) if scope is not None else nodes
    ids = seen.select("person_id").distinct()
    live = edges.where(F.col("confidence") >= least_confidence)
    if types:
        live = live.where(F.upper("edge_type").isin(*[t.upper() for t in types]))
    if not include_unconfirmed:
        live = live.where(F.upper("edge_type") != "CANDIDATE_MATCH")
    last = F.upper("edge_type").isin(*[t.upper() for t in terminal or ["-"]])
    one_way = live.select("source", "target", last.alias("last"))
    back = live.where(F.upper("edge_type") != "ACCUSED_TO_VICTIM").select(F.col("target").alias("source"), F.col("source").alias("target"), last.alias("last"))
    on_foot = one_way.unionByName(back)
    reached = ids.where(F.col("person_id") == start).select("person_id", F.lit(0).alias("hop"))
    front = reached.withColumn("last", F.lit(False))
    for hop in range(1, hops + 1):
        on = front.where(~F.col("last")).select(F.col("person_id").alias("source"))
        step = on_foot.join(on, "source").groupBy(F.col("target").alias("person_id")).agg(F.min("last").alias("last")).join(ids, "person_id", "left_semi")
        front = materialise(step.join(reached, "person_id", "left_anti"), "front")
        reached = reached.unionByName(front.select("person_id", F.lit(hop).alias("hop")))
    if most_nodes is None:
        return reached.withColumn("truncated", F.lit(False))
    nearest = reached.orderBy("hop", "person_id").limit(most_nodes + 1)  # one more shows whether some are left out
    place = F.row_number().over(Window.orderBy("hop", "person_id"))
    return nearest.withColumns({"truncated": F.count(F.lit(1)).over(Window.partitionBy()) > most_nodes, "place": place}).where(F.col("place") <= most_nodes).drop("place")


def between(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose both ends were reached."""
    end = lambda c: reached.select(F.col("person_id").alias(c))
    return edges.join(end("source"), "source", "left_semi").join(end("target"), "target", "left_semi")


def known_associates(nodes: DataFrame, edges: DataFrame, start: str, hops: int = 2, include_unconfirmed: bool = False, most_nodes: int = 100, **options) -> DataFrame:
    """(person_id, hop, truncated) of the persons around one, without that one."""
    return traverse(nodes, edges, start, hops, most_nodes=most_nodes, include_unconfirmed=include_unconfirmed, **options).where(F.col("person_id") != start)


def co_accused_network(nodes: DataFrame, edges: DataFrame, start: str, most_nodes: int = 100, **options) -> DataFrame:
    return traverse(nodes, edges, start, 3, ["CO_ACCUSED"], most_nodes=most_nodes, **options).where(F.col("person_id") != start)


def victim_relationships(nodes: DataFrame, edges: DataFrame, start: str, most_nodes: int = 100, **options) -> DataFrame:
    return traverse(nodes, edges, start, 3, ["ACCUSED_TO_VICTIM"], most_nodes=most_nodes, **options).where(F.col("person_id") != start)


def network_summary(nodes: DataFrame, edges: DataFrame, start: str, most_nodes: int | None = 100, **options) -> DataFrame:
    """One row on a person within three hops of confirmed edges: degree, known associates, victim and co-accused links (edges at
    the person whose other end was reached), edges by type, and whether the traversal was cut off."""
    reached = materialise(traverse(nodes, edges, start, 3, most_nodes=most_nodes, include_unconfirmed=False, **options), "reached")
    at = between(reached, edges).where((F.col("source") == start) | (F.col("target") == start)).dropDuplicates(["edge_id"])
    kind = F.upper("edge_type")
    by_type = at.groupBy(kind.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    links = at.agg(F.count(F.lit(1)).alias("degree"), F.count_if((kind == "ACCUSED_TO_VICTIM") & (F.col("source") == start)).alias("victim_links"), F.count_if(kind == "CO_ACCUSED").alias("co_accused"))
    breakdown = by_type.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "n")))).alias("edge_breakdown"))
    known = reached.agg((F.count(F.lit(1)) - 1).alias("known_associates"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(links).join(one(known), "one").join(one(breakdown), "one").select(F.lit(start).alias("person_id"), "degree", "known_associates", "victim_links", "co_accused", "edge_breakdown", "truncated")


def neighbours(nodes: DataFrame, edges: DataFrame, person_id: str) -> DataFrame:
    """The persons at the other ends of a person's edges, in whichever direction."""
    here = edges.where((F.col("source") == person_id) | (F.col("target") == person_id))
    other = here.select(F.when(F.col("source") == person_id, F.col("target")).otherwise(F.col("source")).alias("person_id")).distinct()
    return nodes.join(other, "person_id", "left_semi")


def edges_of(edges: DataFrame, person_id: str) -> DataFrame:
    return edges.where((F.col("source") == person_id) | (F.col("target") == person_id)).dropDuplicates(["edge_id"])


def by_ids(rows: DataFrame, ids: DataFrame | list[str], key: str = "person_id") -> DataFrame:
    """The rows of the given keys: an empty result tells that there are none."""
    wanted = ids if isinstance(ids, DataFrame) else rows.sparkSession.createDataFrame([(i,) for i in ids], f"{key} string")
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def persons_by_role(persons: DataFrame, role: str) -> DataFrame:
    """(person_id, role, count) of persons that appear in a role at all; an unknown role has none."""
    count = {"accused": "accused_count", "victim": "victim_count", "complainant": "complainant_count", "complainantdetails": "complainant_count"}.get(role.lower())
    rows = persons.select("person_id", F.lit(role).alias("role"), (F.col(count) if count else F.lit(0)).alias("count"))
    return rows.where("count > 0")


def owner_of(persons: DataFrame, source_key: str) -> DataFrame:
    """The person whose ``source_keys`` hold a record."""
    return persons.where(F.array_contains(F.col("source_keys").cast("array<string>"), source_key)).select("person_id")


def profile_degree(edges: DataFrame) -> DataFrame:
    """(person_id, confirmed, unconfirmed, degree): the edges that each person stores, candidates apart."""
    candidate = F.upper("edge_type") == "CANDIDATE_MATCH"
    return edges.groupBy(F.col("source").alias("person_id")).agg(F.count_if(~candidate).alias("confirmed"), F.count_if(candidate).alias("unconfirmed"), F.count(F.lit(1)).alias("degree"))


def named(persons: DataFrame, text: str) -> DataFrame:
    """Persons whose id, name or spellings contain a text, in any case, by id."""
    q = F.lit(text.lower())
    spelt = F.exists(F.coalesce("name_variants", F.array().cast("array<string>")), lambda v: F.contains(F.lower(v), q))
    return persons.where(F.contains(F.lower("person_id"), q) | F.contains(F.lower("name_normalised"), q) | spelt)


def network_of_name(persons: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """The surroundings of the first person by id that a text names: one hop if it names several, else two; empty without a match."""
    first = [r[0] for r in named(persons, text).select("person_id").orderBy("person_id").limit(2).collect()]
    if not first:
        return persons.select("person_id", F.lit(0).alias("hop"), F.lit(False).alias("truncated")).where("false")
    return traverse(persons, edges, first[0], 1 if len(first) > 1 else 2, most_nodes=100)


def compact(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(person_id, hop, neighbours): each reached person with the reached ones that its edges lead to, in order."""
    out = between(reached, edges).groupBy(F.col("source").alias("person_id")).agg(F.array_sort(F.collect_set("target")).alias("neighbours"))
    return reached.join(out, "person_id", "left").select("person_id", "hop", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def debug_counts(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, key, n): how many persons stand at each hop, edges of each type among them, edges that leave them."""
    inside = between(reached, edges)
    hops = reached.groupBy(F.col("hop").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("hop").alias("what"), "key", "n")
    kinds = inside.groupBy(F.upper("edge_type").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge_type").alias("what"), "key", "n")
    source = reached.select(F.col("person_id").alias("source"))
    leaving = edges.join(source, "source", "left_semi").join(reached.select(F.col("person_id").alias("target")), "target", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return hops.unionByName(kinds).unionByName(leaving.select(F.lit("missing_endpoint").alias("what"), F.lit("").alias("key"), "n"))


def export_elements(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements for drawing: nodes with hop and degree, edges between them."""
    inside = between(reached, edges)
    degree = degrees(inside).groupBy("person_id").agg(F.sum("degree").alias("degree"))
    points = reached.join(degree, "person_id", "left").select(F.lit("nodes").alias("group"), F.col("person_id").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), "hop", F.coalesce("degree", F.lit(0)).alias("degree"))
    lines = inside.select(F.lit("edges").alias("group"), F.col("edge_id").alias("id"), "source", "target", F.lit(None).cast("int").alias("hop"), F.lit(None).cast("long").alias("degree"))
    return points.unionByName(lines)


# Size and colour of a person by its roles; colour, width and line of an edge by its type.
ROLE_STYLES = {"accused": (50, "#E53935"), "victim": (45, "#FF9800"), "complainant": (45, "#43A047"), "mixed": (55, "#7B1FA2"), "default": (40, "#757575")}
EDGE_STYLES = {"CO_ACCUSED": ("#E53935", 3, "solid"), "ACCUSED_TO_VICTIM": ("#FF9800", 2, "solid"), "CANDIDATE_MATCH": ("#9E9E9E", 1, "dashed"), "SHARED_LOCATION": ("#2196F3", 2, "dotted"), "default": ("#757575", 1, "solid")}


def _looked_up(key: Column, table: dict[str, tuple], fields: tuple[str, ...]) -> Column:
    rows = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.struct(F.lit(k).alias("key"), *(F.lit(y).alias(f) for y, f in zip(v, fields, strict=True))))))
    return F.coalesce(rows[key], rows[F.lit("default")])


def node_style(accused: Column, victim: Column, complainant: Column) -> Column:
    """STRUCT<key, size, color>: of the only role that a person has, mixed for several, default for none."""
    roles = {"accused": accused, "victim": victim, "complainant": complainant}
    several = sum((F.when(c > 0, 1).otherwise(0) for c in roles.values()), F.lit(0))
    only = F.coalesce(*(F.when(c > 0, F.lit(r)) for r, c in roles.items()), F.lit("default"))
    return _looked_up(F.when(several > 1, F.lit("mixed")).otherwise(only), ROLE_STYLES, ("size", "color"))


def edge_style(edge_type: Column) -> Column:
    """STRUCT<key, color, width, style>."""
    return _looked_up(F.coalesce(edge_type, F.lit("default")), EDGE_STYLES, ("color", "width", "style"))


def primary_role(accused: Column, victim: Column, complainant: Column) -> Column:
    """The commonest role, in brackets after Mixed unless it has three quarters or more of the appearances; Unknown without any."""
    roles = {"Accused": accused, "Victim": victim, "Complainant": complainant}
    most, total = F.greatest(*roles.values()), accused + victim + complainant
    first = F.coalesce(*(F.when(c == most, F.lit(r)) for r, c in roles.items()))
    return F.when(F.coalesce(total, F.lit(0)) == 0, "Unknown").when(most / total >= 0.75, first).otherwise(F.concat(F.lit("Mixed ("), first, F.lit(")")))
