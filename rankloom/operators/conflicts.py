"""Contradictions counted by value classes, without pairs of claims.

Claims of one group (an entity's attribute, or two attributes or labels that align) with equal value are a class; a class
row has its number of claims and of links, the contradicting claims of other documents, summed over the class's claims.
Each pair of claims that `claims.contradictions` and its like would give is counted once at both ends, so half the
links of a group is its number of pairs. Output and work are linear in the claims: links are all claims of the group but
those that don't conflict, which are counted

- for numbers by sums over sorted distinct values within the tolerance, exactly as floating-point differences decide;
- for other values by equality of their canonical forms;

and less what is so counted among the claims of one document.

Sorted values are cut into cells of CELL tolerances; each cell also sees its neighbours' values within two tolerances,
so a group with most of all claims is spread over its range of values. Equal values are summed before they are sorted.

Groups of up to SMALL claims, all of them finite numbers, are counted first and need none of this: a group's claims lie in
one row, where each is compared with the others, at most SMALL comparisons a claim. All other groups are sorted.

Defined cases: claims with a null entity, attribute, value or document conflict with nothing and are in no class; a
number that is not finite (NaN, infinite) conflicts with every number of another document; repeated claims count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, stage
from .claims import SIMILARITY, TOLERANCE, aligned_vectors, canonical_value, label_vectors, similar_attributes

CELL = 1000
#: The part of the tolerance that sums alone decide; between it and the tolerance each distinct value is compared.
INNER = 1 - 2.0**-10
#: Beyond this many tolerances a number's neighbours are too far apart for INNER; half the tolerance is right for any.
FINE = 2.0**40
SIDES = (0, 1)
#: Claims of a group up to which they are compared where they lie.
SMALL = 64


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _near(values: DataFrame, group: list[str], weights: list[str], tolerance: float) -> DataFrame:
    """values(group, x, weights), one row for each x: with each weight w as near_w, summed over all y of the group with
    abs(x - y) <= tolerance."""
    width = tolerance * CELL
    at = lambda c: F.floor(c / F.lit(width)).cast("double")
    cells = F.array_distinct(F.array(at(F.col("x")), at(F.col("x") - 2 * tolerance), at(F.col("x") + 2 * tolerance)))
    spread = values.withColumn("own", at(F.col("x"))).withColumn("cell", F.explode(cells))
    over = f"OVER (PARTITION BY {', '.join(group)}, cell ORDER BY x RANGE BETWEEN {{}}D {{}} AND {{}}D {{}})"
    sums = ", ".join(f"'{w}', {w}" for w in weights)
    out = None
    for fine, inner in ((True, tolerance * INNER), (False, tolerance / 2)):
        part = spread.filter((F.col("widest") <= FINE * tolerance) == fine)
        named = f"named_struct('x', x, {sums})"
        part = part.select(
            "*",
            *[F.expr(f"sum({w}) {over.format(inner, 'PRECEDING', inner, 'FOLLOWING')}").alias(f"in_{w}") for w in weights],
            F.expr(f"collect_list({named}) {over.format(inner, 'FOLLOWING', tolerance, 'FOLLOWING')}").alias("above"),
            F.expr(f"collect_list({named}) {over.format(tolerance, 'PRECEDING', inner, 'PRECEDING')}").alias("below"),
        )
        up = F.filter("above", lambda y: (y["x"] > F.col("x") + inner) & (y["x"] - F.col("x") <= tolerance))  # noqa: B023
        down = F.filter("below", lambda y: (y["x"] < F.col("x") - inner) & (F.col("x") - y["x"] <= tolerance))  # noqa: B023
        shell = F.concat(up, down)
        total = lambda w: F.aggregate(shell, F.lit(0).cast("bigint"), lambda n, y: n + y[w])  # noqa: B023, E731
        part = part.filter("cell = own").select(*group, "x", *[(F.col(f"in_{w}") + total(w)).alias(f"near_{w}") for w in weights])
        out = part if out is None else out.unionByName(part)
    return out


def _links(cells: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """cells(group, side, ask, value, n): for each of them the claims of its group on the side that it asks that conflict
    with its value, as links. An ask of 2 means both sides."""
    distinct = cells.groupBy(*group, "side", "ask", "value").agg(F.sum("n").alias("n"))
    canonical = canonical_value(F.col("value"))
    kinds = distinct.withColumns({"raw": _number(F.col("value")), "canon": canonical}).withColumns({"r": _finite(F.col("raw")), "k": _finite(_number(F.col("canon")))})
    kinds = kinds.withColumns({f"{kind}{s}": F.when((F.col("side") == s) & (F.col("raw").isNotNull() == (kind == "a")), F.col("n")).otherwise(F.lit(0)) for kind in "at" for s in SIDES})
    kinds = stage(kinds, "value-classes")
    numbers, texts = [f"a{s}" for s in SIDES], [f"t{s}" for s in SIDES]
    sums = lambda names: [F.sum(w).alias(w) for w in names]
    totals = kinds.groupBy(*group).agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n1"), F.max(F.greatest(F.coalesce(F.abs("r"), F.lit(0.0)), F.coalesce(F.abs("k"), F.lit(0.0)))).alias("widest"))
    out = kinds.join(totals, group)
    asked = lambda names: F.when(F.col("ask") == 2, F.col(names[0]) + F.col(names[1])).when(F.col("ask") == 0, F.col(names[0])).otherwise(F.col(names[1]))
    wide = kinds.join(totals.select(*group, "widest"), group)
    by_number = _near(wide.filter("r IS NOT NULL").groupBy(*group, F.col("r").alias("x"), "widest").agg(*sums(numbers)), group, numbers, tolerance)
    out = out.join(by_number.withColumnRenamed("x", "r"), [*group, "r"], "left")
    alike = F.when(F.col("raw").isNotNull(), F.coalesce(asked([f"near_{w}" for w in numbers]), (F.col("ask") == 2).cast("bigint"))).otherwise(F.lit(0))
    if not kinds.filter("raw IS NULL").isEmpty():
        both = [*numbers, *texts]
        rename = {f"near_{w}": f"canon_{w}" for w in both}
        by_canon = _near(wide.filter("k IS NOT NULL").groupBy(*group, F.col("k").alias("x"), "widest").agg(*sums(both)), group, both, tolerance).withColumnsRenamed(rename).withColumnRenamed("x", "k")
        by_text = kinds.filter("k IS NULL").groupBy(*group, "canon").agg(*[F.sum(w).alias(f"same_{w}") for w in both])
        out = out.join(by_canon, [*group, "k"], "left").join(by_text, [*group, "canon"], "left")
        held = lambda names: F.coalesce(asked([f"canon_{w}" for w in names]), asked([f"same_{w}" for w in names]), F.lit(0))
        alike = alike + held(texts) + F.when(F.col("raw").isNull(), held(numbers)).otherwise(F.lit(0))
    return out.select(*group, "side", "ask", "value", (asked(["n0", "n1"]) - alike).alias("links"))


def _counted(rows: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """rows(group, side, ask, claim_id, doc_id, value) as cells of a group, document and value: n claims, the smallest
    claim_id, and links of each of these claims with other documents."""
    rows = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*group, "value", "doc_id"]))
    odd = F.count(F.when(_finite(_number(F.col("value"))).isNull(), True))
    large = stage(rows.groupBy(*group).agg(F.count("*").alias("n"), odd.alias("odd")).filter(f"n > {SMALL} OR odd > 0").select(*group), "large-groups")
    if large.isEmpty():
        return _compared(rows, group, tolerance)
    large = few(large)
    return _compared(rows.join(large, group, "left_anti"), group, tolerance).unionByName(_sorted(rows.join(large, group, "left_semi"), group, tolerance))


def _cells(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.groupBy(*group, "side", "ask", "value", "doc_id").agg(F.count("*").alias("n"), F.min("claim_id").alias("claim_id"))


def _compared(rows: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """_counted for small groups of finite numbers, each of them dealt to one task and then in one row."""
    cells = _cells(rows.repartition(*group), group).withColumn("x", _number(F.col("value")))
    met = cells.groupBy(*group).agg(F.collect_list(F.struct("side", "ask", "value", "doc_id", "n", "claim_id", "x")).alias("cells"))

    def links(c: Column) -> Column:
        meets = lambda o: (o["doc_id"] != c["doc_id"]) & ((c["ask"] == 2) | (o["side"] == c["ask"])) & (F.abs(c["x"] - o["x"]) > tolerance)
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, o: n + F.when(meets(o), o["n"]).otherwise(0))

    counted = F.transform("cells", lambda c: c.withField("links", links(c)))
    return met.select(*group, F.inline(counted)).drop("x")


def _sorted(rows: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """_counted for groups of any size and values of any kind."""
    keys = [*group, "side", "ask", "value"]
    cells = stage(_cells(rows, group), "claim-cells")
    of_all = _links(cells, group, tolerance)
    several = cells.groupBy(*group, "doc_id").agg(F.sum("n").alias("of_doc")).filter("of_doc > 1").drop("of_doc")
    of_own = _links(cells.join(several, [*group, "doc_id"], "left_semi"), [*group, "doc_id"], tolerance).withColumnRenamed("links", "own")
    return cells.join(of_all, keys).join(of_own, [*keys, "doc_id"], "left").withColumn("links", F.col("links") - F.coalesce("own", F.lit(0))).drop("own")


def _named(claims: DataFrame) -> DataFrame:
    return claims.filter("attribute <> 'raw_text'").withColumn("entity_key", F.lower(F.trim("entity")))


def _one_sided(claims: DataFrame) -> DataFrame:
    return _named(claims).select("entity_key", "attribute", F.lit(0).alias("side"), F.lit(2).alias("ask"), "claim_id", "doc_id", "value")


def _classes(counted: DataFrame, *by: str) -> DataFrame:
    return counted.groupBy(*by, "value").agg(F.min("claim_id").alias("class_id"), F.sum("n").alias("n_claims"), F.sum(F.col("n") * F.col("links")).alias("n_links"))


def contradiction_classes(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """claims(claim_id, doc_id, entity, attribute, value): entity_key, attribute, value, class_id (the smallest
    claim_id), n_claims, n_links."""
    return _classes(_counted(_one_sided(claims), ["entity_key", "attribute"], tolerance), "entity_key", "attribute")


def penalties(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, penalty): the contradictions of the same entity and attribute that each document takes part in."""
    counted = _counted(_one_sided(claims), ["entity_key", "attribute"], tolerance)
    return counted.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("links")).cast("double").alias("penalty")).filter("penalty > 0")


def fuzzy_classes(claims: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """As contradiction_classes, of conflicts between an entity's similar attributes; only classes of such attributes."""
    pairs = similar_attributes(claims, similarity)
    ends = pairs.select("attribute", "attribute", "other", F.lit(0), F.lit(1)).toDF("attribute", "first", "second", "side", "ask")
    ends = ends.unionByName(pairs.select("other", "attribute", "other", F.lit(1), F.lit(0)).toDF("attribute", "first", "second", "side", "ask"))
    rows = _named(claims).join(ends, "attribute").select("entity_key", "first", "second", "side", "ask", "claim_id", "doc_id", "value")
    counted = _counted(rows, ["entity_key", "first", "second"], tolerance)
    one = counted.withColumn("attribute", F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("second")))
    # an attribute with several similar ones stands in a group with each of them
    once = one.groupBy("entity_key", "attribute", "value", "doc_id").agg(F.max("n").alias("n"), F.min("claim_id").alias("claim_id"), F.sum("links").alias("links"))
    return _classes(once, "entity_key", "attribute")


def raw_classes(claims: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """label ("entity attribute"), value, class_id, n_claims, n_links of raw-text claims, whose labels align with
    themselves and others. Labels with one vector are one label as far as links go: groups are pairs of vectors."""
    rows = claims.filter("attribute = 'raw_text' AND value IS NOT NULL AND doc_id IS NOT NULL").withColumn("label", F.concat_ws(" ", "entity", "attribute"))
    names, vectors = label_vectors(rows)
    pairs = aligned_vectors(vectors, similarity)
    self = pairs.filter("vector = other").select("vector", F.col("vector").alias("first"), F.col("vector").alias("second"), F.lit(0).alias("side"), F.lit(2).alias("ask"))
    apart = pairs.filter("vector < other").select(F.col("vector").alias("first"), F.col("other").alias("second"))
    ends = self.unionByName(apart.select(F.col("first").alias("vector"), "first", "second", F.lit(0).alias("side"), F.lit(1).alias("ask"))).unionByName(apart.select(F.col("second").alias("vector"), "first", "second", F.lit(1).alias("side"), F.lit(0).alias("ask")))
    rows = stage(rows.join(names, "label", "left").select("label", "vector", "claim_id", "doc_id", "value"), "raw-claims")
    counted = _counted(rows.join(ends, "vector").select("first", "second", "side", "ask", "claim_id", "doc_id", "value"), ["first", "second"], tolerance)
    one = counted.withColumn("vector", F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("second")))
    links = one.groupBy("vector", "value", "doc_id").agg(F.sum("links").alias("links"))
    own = rows.groupBy("label", "vector", "value", "doc_id").agg(F.count("*").alias("n"), F.min("claim_id").alias("claim_id"))
    return _classes(own.join(links, ["vector", "value", "doc_id"], "left").fillna(0, ["links"]), "label")
