"""Dictionary similarity join: all stretches of a text within an edit distance of a dictionary entry.

A naive join would compare every text with every entry. Instead an entry is cut into d + 1 pieces: a
window within d edits of it holds one of them unchanged (pigeonhole principle), at a place that is off by
d at most. So texts and entries are equi-joined on pieces, windows around each seed are verified by
``levenshtein``, and the plan has no nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..settle import by_address, settle


def candidates(entries: DataFrame) -> DataFrame:
    """(possibility, origins): keys in upper case, empty ones dropped, origins of equal keys united and sorted."""
    rows = entries.select(F.upper("possibility").alias("possibility"), F.explode("origins").alias("origin")).where("possibility <> ''")
    return rows.groupBy("possibility").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def pieces(entries: DataFrame, tolerance: int) -> DataFrame:
    """(possibility, size, d, piece, offset): entries of up to two characters match exactly, as one piece."""
    size = F.length("possibility")
    d = F.when(size <= 2, 0).otherwise(F.least(F.lit(tolerance), size - 1))
    rows = entries.select("possibility", size.alias("size"), d.alias("d"))
    cut = F.transform(F.sequence(F.lit(0), F.col("d")), lambda k: F.floor(k * F.col("size") / (F.col("d") + 1)).cast("int"))
    rows = rows.withColumn("cuts", F.concat(cut, F.array(F.col("size"))))
    parts = F.transform(F.sequence(F.lit(0), F.col("d")), lambda k: F.struct(F.get("cuts", k).alias("offset"), F.substring("possibility", F.get("cuts", k) + 1, F.get("cuts", k + 1) - F.get("cuts", k)).alias("piece")))
    return rows.select("possibility", "size", "d", F.explode(parts).alias("p")).select("possibility", "size", "d", "p.piece", "p.offset")


def seeded(texts: DataFrame, entries: DataFrame, tolerance: int, held: list[str] | None = None) -> DataFrame:
    """(addr_id, text, possibility, d, bases): the places where a window of an entry may begin, a row for each pair of a text and an entry.

    A text's substrings of the lengths that occur are made in one projection; only they are exploded, not the
    text. The pieces are settled, so their true size decides whether they are sent out or shuffled.
    """
    parts = settle(pieces(entries, tolerance), "pieces", held)
    # the dictionary's few lengths: one row
    sizes = parts.agg(F.collect_set(F.length("piece")).alias("sizes"))
    spots = F.transform(F.col("sizes"), lambda n: F.transform(F.sequence(F.lit(0), F.length("text") - n), lambda at: F.struct(at.alias("at"), F.substring(F.col("text"), at + 1, n).alias("piece"))))
    fitting = F.filter(F.col("sizes"), lambda n: n <= F.length("text"))
    seeds = texts.select("addr_id", "text").join(F.broadcast(sizes)).withColumn("sizes", fitting).select("addr_id", F.explode(F.flatten(spots)).alias("s")).select("addr_id", "s.at", "s.piece")
    hits = seeds.join(parts, "piece").groupBy("addr_id", "possibility", "d").agg(F.array_sort(F.collect_set(F.col("at") - F.col("offset"))).alias("bases"))
    return hits.join(by_address(texts.select("addr_id", "text")), "addr_id")


def within(text: Column, possibility: Column, d: Column, bases: Column, tolerance: int | None = None) -> Column:
    """Sorted structs (dist, start, stop, matched) of all windows within d edits around the bases; distances beyond ``tolerance`` (d at least) need not be counted to their end."""
    spread = F.sequence(-d, d)
    starts = F.array_distinct(F.flatten(F.transform(bases, lambda b: F.transform(spread, lambda s: b + s))))
    places = F.flatten(F.transform(starts, lambda b: F.transform(spread, lambda g: F.struct(b.alias("start"), (F.length(possibility) + g).alias("width")))))
    fitting = F.filter(places, lambda p: (p["start"] >= 0) & (p["width"] > 0) & (p["start"] + p["width"] <= F.length(text)))
    # beyond the threshold the distance is -1
    made = F.transform(fitting, lambda p: X.let(X.at(text, p["start"], p["width"]), lambda m: F.struct(F.levenshtein(m, possibility, tolerance).alias("dist"), p["start"].cast("int").alias("start"), (p["start"] + p["width"]).cast("int").alias("stop"), m.alias("matched"))))
    return F.array_sort(F.filter(made, lambda w: (w["dist"] >= 0) & (w["dist"] <= d)))


def windows(texts: DataFrame, entries: DataFrame, tolerance: int) -> DataFrame:
    """(addr_id, possibility, start, stop, matched, dist) of all windows within the tolerance."""
    pairs = seeded(texts, entries, tolerance)
    found = pairs.select("addr_id", "possibility", F.explode(within(F.col("text"), F.col("possibility"), F.col("d"), F.col("bases"), tolerance)).alias("w"))
    return found.select("addr_id", "possibility", "w.start", "w.stop", "w.matched", "w.dist")


def open_gate(found: Column, possibility: Column, cutoff: int) -> Column:
    """Whether the partial ratio of an entry in its text reaches the cutoff: 100 where contained, else the best floor(100 (m - dist) / m), m the longer length."""

    def ratio(w: Column) -> Column:
        longer = F.greatest(F.length(possibility), F.length(w["matched"]))
        return F.when(w["dist"] == 0, 100).otherwise(F.floor(100 * (longer - w["dist"]) / longer))

    return F.exists(found, lambda w: ratio(w) >= cutoff)


def greedy(found: Column) -> Column:
    """Non-overlapping windows, the least (dist, start, stop) first."""
    kind = "array<struct<dist:int,start:int,stop:int,matched:string>>"
    meets = lambda got, w: F.exists(got, lambda g: (w["start"] < g["stop"]) & (g["start"] < w["stop"]))
    return F.aggregate(found, F.array().cast(kind), lambda got, w: F.when(meets(got, w), got).otherwise(F.concat(got, F.array(w))))


def match_dictionaries(texts: DataFrame, entries: DataFrame, *, cutoff: int = 80, tolerance: int = 1, held: list[str] | None = None) -> DataFrame:
    """(addr_id, kind, start, stop, matched, possibility, dist, flags, origin): the fuzzy matches of texts (addr_id, text) with entries (kind, possibility, origins) of several dictionaries, in one scan."""
    listed = entries.select("kind", F.upper("possibility").alias("possibility"), F.explode("origins").alias("origin")).where("possibility <> ''")
    listed = settle(listed.groupBy("possibility", "kind").agg(F.array_sort(F.collect_set("origin")).alias("origins")), "entries", held)
    pairs = seeded(texts, listed.select("possibility").distinct(), tolerance, held)
    # a filter isn't moved below a generator, so the windows aren't made again for the gate
    found = pairs.withColumn("found", F.explode(F.array(within(F.col("text"), F.col("possibility"), F.col("d"), F.col("bases"), tolerance))))
    found = found.where(open_gate(F.col("found"), F.col("possibility"), cutoff))
    chosen = found.select("addr_id", "text", "possibility", F.explode(greedy(F.col("found"))).alias("w")).select("addr_id", "text", "possibility", "w.*")
    inside = X.inside_word(F.col("text"), F.col("start"), F.col("stop"), F.col("matched"))
    chosen = chosen.withColumn("inside", inside).where((F.length("possibility") > 2) | ~F.col("inside"))
    chosen = chosen.withColumn("dist", X.newline_discount(F.col("matched"), F.col("dist")))
    flags = F.when(F.col("inside"), F.array(F.lit("IS_INSIDE_ANOTHER_WORD"))).otherwise(F.array().cast("array<string>"))
    return chosen.join(listed, "possibility").select("addr_id", "kind", "start", "stop", "matched", "possibility", "dist", flags.alias("flags"), F.explode("origins").alias("origin"))


def match_dictionary(texts: DataFrame, entries: DataFrame, *, cutoff: int = 80, tolerance: int = 1) -> DataFrame:
    """The matches with the entries (possibility, origins) of one dictionary."""
    return match_dictionaries(texts, entries.withColumn("kind", F.lit(0)), cutoff=cutoff, tolerance=tolerance).drop("kind")
