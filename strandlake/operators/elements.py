"""Elements on a reference: strand-aware coordinates, variations, sites, connections, regions and tracks.

Elements are (element_id, ref, start, end, forward) with half-open reference
intervals.  Element positions count from the first base along the strand.
Variations are arrays of struct(type, start, end, seq) on the reference, type
S (substitution), I (insertion at start) or D (deletion).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement

VARIATION = "struct<type:string,start:bigint,end:bigint,seq:string>"


def to_reference(pos: Column, start: Column, end: Column, forward: Column) -> Column:
    """Element position to reference position."""
    return F.when(forward, start + pos).otherwise(end - 1 - pos)


def to_element(pos: Column, start: Column, end: Column, forward: Column) -> Column:
    """Reference position to element position."""
    return F.when(forward, pos - start).otherwise(end - 1 - pos)


def interval_to_reference(s: Column, e: Column, start: Column, end: Column, forward: Column) -> tuple[Column, Column]:
    """Half-open element interval to the reference."""
    return F.when(forward, start + s).otherwise(end - e), F.when(forward, start + e).otherwise(end - s)


def interval_to_element(s: Column, e: Column, start: Column, end: Column, forward: Column) -> tuple[Column, Column]:
    return F.when(forward, s - start).otherwise(end - e), F.when(forward, e - start).otherwise(end - s)


def map_positions(positions: DataFrame, elements: DataFrame, others: DataFrame) -> DataFrame:
    """(element_id, pos, other_id, other_pos): positions of one element on another; null on a different reference.

    ``positions``: (element_id, pos, other_id).
    """
    a, b = elements.alias("a"), others.select(F.col("element_id").alias("other_id"), *[F.col(c).alias(f"o_{c}") for c in ("ref", "start", "end", "forward")])
    at = to_reference(F.col("pos"), F.col("start"), F.col("end"), F.col("forward"))
    there = to_element(at, F.col("o_start"), F.col("o_end"), F.col("o_forward"))
    return positions.join(a, "element_id").join(b, "other_id").select("element_id", "pos", "other_id", F.when(F.col("ref") == F.col("o_ref"), there).alias("other_pos"))


def sub_element(s: Column, e: Column, reverse: Column, start: Column, end: Column, forward: Column) -> dict[str, Column]:
    """Interval and strand of a part of an element; strands compose."""
    lo, hi = interval_to_reference(s, e, start, end, forward)
    return {"start": lo, "end": hi, "forward": forward != reverse}


def with_variation(variations: Column, kind: str, start: Column, end: Column, seq: Column, forward: Column | None = None) -> Column:
    """The array with one more variation, sorted by start; sequences of reverse elements are turned."""
    s = seq if forward is None else F.when(forward, seq).otherwise(reverse_complement(seq))
    one = F.struct(F.lit(kind).alias("type"), start.cast("long").alias("start"), end.cast("long").alias("end"), s.alias("seq"))
    return F.array_sort(F.array_append(F.coalesce(variations, F.array().cast(f"array<{VARIATION}>")), one), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def region_position(pos: Column, start: Column, variations: Column) -> Column:
    """Reference position to position in the varied region that begins at ``start``; null inside a deletion."""

    def step(shift, v):
        longer = F.when((v["type"] == "I") & (v["start"] <= pos), F.length(v["seq"]).cast("long")).otherwise(0)
        shorter = F.when((v["type"] == "D") & (v["end"] <= pos), v["end"] - v["start"]).otherwise(0)
        return shift + longer - shorter

    gone = F.exists(variations, lambda v: (v["type"] == "D") & (v["start"] <= pos) & (pos < v["end"]))
    return F.when(~gone, pos - start + F.aggregate(variations, F.lit(0).cast("long"), step))


def reference_position(pos: Column, start: Column, variations: Column) -> tuple[Column, Column]:
    """Region position to (reference position, displacement): inside an insertion null and the offset in it."""
    state = F.struct(start.cast("long").alias("ref"), F.lit(0).cast("long").alias("reg"), F.lit(None).cast("long").alias("hit"), F.lit(0).cast("long").alias("disp"), F.lit(False).alias("done"))

    def step(s, v):
        here = s["reg"] + (v["start"] - s["ref"])  # region position of the variation
        before = pos < here
        n = F.length(v["seq"]).cast("long")
        inside = (v["type"] == "I") & (pos < here + n)
        found = F.struct(s["ref"].alias("ref"), s["reg"].alias("reg"), (s["ref"] + pos - s["reg"]).alias("hit"), F.lit(0).cast("long").alias("disp"), F.lit(True).alias("done"))
        lost = F.struct(s["ref"].alias("ref"), s["reg"].alias("reg"), F.lit(None).cast("long").alias("hit"), (pos - here + 1).alias("disp"), F.lit(True).alias("done"))
        ref = F.when(v["type"] == "D", v["end"]).otherwise(v["start"])
        reg = F.when(v["type"] == "I", here + n).otherwise(here)
        on = F.struct(ref.alias("ref"), reg.alias("reg"), s["hit"].alias("hit"), s["disp"].alias("disp"), F.lit(False).alias("done"))
        return F.when(s["done"], s).when(before, found).when(inside, lost).otherwise(on)

    last = F.aggregate(variations, state, step)
    return F.when(last["done"], last["hit"]).otherwise(last["ref"] + pos - last["reg"]), last["disp"]


def varied(seq: Column, start: Column, variations: Column) -> Column:
    """``seq`` of the region that begins at ``start`` with its variations applied, from the last to the first."""

    def step(s, v):
        at = (v["start"] - start).cast("int")
        head = F.substring(s, F.lit(1), at)
        tail = lambda n: F.substring(s, (at + n + 1).cast("int"), F.length(s))
        gone = (v["end"] - v["start"]).cast("int")
        return F.when(v["type"] == "I", F.concat(head, v["seq"], tail(F.lit(0)))).when(v["type"] == "D", F.concat(head, tail(gone))).otherwise(F.concat(head, v["seq"], tail(F.length(v["seq"]))))

    return F.aggregate(F.reverse(variations), seq, step)


def sequence(seq: Column, s: Column, e: Column, forward: Column) -> Column:
    """Part of a reference string, turned on the reverse strand."""
    part = seq.substr((s + 1).cast("int"), (e - s).cast("int"))
    return F.when(forward, part).otherwise(reverse_complement(part))


def sites(connections: DataFrame) -> DataFrame:
    """(element_id, site, pos): distinct ends of (element_id, s, e), numbered by position from 0."""
    ends = connections.select("element_id", F.explode(F.array("s", "e")).alias("pos")).distinct()
    return ends.withColumn("site", (F.row_number().over(Window.partitionBy("element_id").orderBy("pos")) - 1).cast("long"))


def connected(connections: DataFrame, site_table: DataFrame) -> DataFrame:
    """(element_id, connection, from_site, to_site, forward): distinct edges; repeats share a number."""
    s = site_table.select("element_id", F.col("pos").alias("s"), F.col("site").alias("from_site"))
    e = site_table.select("element_id", F.col("pos").alias("e"), F.col("site").alias("to_site"))
    edges = connections.select("element_id", "s", "e").distinct().join(s, ["element_id", "s"]).join(e, ["element_id", "e"])
    n = F.row_number().over(Window.partitionBy("element_id").orderBy("from_site", "to_site")) - 1
    return edges.select("element_id", n.cast("long").alias("connection"), "from_site", "to_site", (F.col("from_site") < F.col("to_site")).alias("forward"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(element_id, connection, next): connections that start where one ends."""
    after = edges.select("element_id", F.col("from_site").alias("to_site"), F.col("connection").alias("next"))
    return edges.select("element_id", "connection", "to_site").join(after, ["element_id", "to_site"]).select("element_id", "connection", "next")


def site_regions(site_table: DataFrame, before: int, after: int, control: str = "none") -> DataFrame:
    """(element_id, site, s, e): half-open regions around sites.

    ``control``: none; ``sites`` ends a region at its neighbouring sites;
    ``regions`` splits overlaps with neighbouring regions at their middle.
    """
    w = Window.partitionBy("element_id").orderBy("pos")
    t = site_table.withColumns({"s": F.col("pos") - before, "e": F.col("pos") + after + 1})
    if control == "sites":
        t = t.withColumns({"s": F.greatest("s", F.coalesce(F.lag("pos").over(w) + 1, F.col("s"))), "e": F.least("e", F.coalesce(F.lead("pos").over(w), F.col("e")))})
    elif control == "regions":
        left, right = F.lag("e").over(w), F.lead("s").over(w)
        t = t.withColumns({"_l": left, "_r": right})
        t = t.withColumns({"s2": F.when(F.col("_l") > F.col("s"), F.floor((F.col("_l") + F.col("s")) / 2)).otherwise(F.col("s")), "e2": F.when(F.col("_r") < F.col("e"), F.floor((F.col("_r") + F.col("e")) / 2)).otherwise(F.col("e"))}).drop("s", "e", "_l", "_r").withColumnsRenamed({"s2": "s", "e2": "e"})
    elif control != "none":
        raise ValueError(f"unknown control {control}")
    return t.select("element_id", "site", "s", "e")


def region_features(regions: DataFrame, track: DataFrame, before: int, after: int) -> DataFrame:
    """(element_id, site, offset, value): a track at each offset of untrimmed regions; null outside the trimmed ones.

    ``regions``: as ``site_regions`` with the site's ``pos``; ``track``: (element_id, pos, value).
    """
    grid = regions.select("element_id", "site", "s", "e", F.col("pos").alias("_at"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("pos", F.col("_at") + F.col("offset"))
    held = grid.join(track, ["element_id", "pos"], "left")
    return held.select("element_id", "site", "offset", F.when((F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e")), F.col("value")).alias("value"))


def find_connections(wanted: DataFrame, site_table: DataFrame, edges: DataFrame) -> DataFrame:
    """``wanted`` (element_id, s, e, reversed) with from_site, to_site and connection, null where there is none.

    On a reversed element the ends swap.
    """
    turned = wanted.withColumns({"_f": F.when(F.col("reversed"), F.col("e")).otherwise(F.col("s")), "_u": F.when(F.col("reversed"), F.col("s")).otherwise(F.col("e"))})
    at = lambda pos, site: site_table.select("element_id", F.col("pos").alias(pos), F.col("site").alias(site))
    held = turned.join(at("_f", "from_site"), ["element_id", "_f"], "left").join(at("_u", "to_site"), ["element_id", "_u"], "left")
    return held.join(edges.select("element_id", "from_site", "to_site", "connection"), ["element_id", "from_site", "to_site"], "left").select(*wanted.columns, "from_site", "to_site", "connection")


def connection_elements(edges: DataFrame, site_table: DataFrame, before: int, after: int) -> DataFrame:
    """(element_id, connection, s, e, forward): the part each connection spans, ``before`` its first site and ``after`` its last.

    Along a reverse connection the first site is the right one, so the offsets swap.
    """
    at = lambda site, pos: site_table.select("element_id", F.col("site").alias(site), F.col("pos").alias(pos))
    t = edges.join(at("from_site", "_p"), ["element_id", "from_site"]).join(at("to_site", "_q"), ["element_id", "to_site"])
    s = F.when(F.col("forward"), F.col("_p") - before).otherwise(F.col("_q") - after)
    e = F.when(F.col("forward"), F.col("_q") + 1 + after).otherwise(F.col("_p") + 1 + before)
    return t.select("element_id", "connection", s.alias("s"), e.alias("e"), "forward")


def map_connections(connections: DataFrame, elements: DataFrame, others: DataFrame) -> DataFrame:
    """(element_id, other_id, s, e, other_s, other_e): both ends of each connection on another element, null on a different reference."""
    a = elements.select("element_id", *[F.col(c).alias(f"_{c}") for c in ("ref", "start", "end", "forward")])
    b = others.select(F.col("element_id").alias("other_id"), *[F.col(c).alias(f"_o_{c}") for c in ("ref", "start", "end", "forward")])

    def there(pos):
        at = to_reference(F.col(pos), F.col("_start"), F.col("_end"), F.col("_forward"))
        return F.when(F.col("_ref") == F.col("_o_ref"), to_element(at, F.col("_o_start"), F.col("_o_end"), F.col("_o_forward")))

    return connections.join(a, "element_id").join(b, "other_id").select("element_id", "other_id", "s", "e", there("s").alias("other_s"), there("e").alias("other_e"))
