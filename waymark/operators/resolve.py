"""From fuzzy matches to resolved addresses: flags, scores, combinations, the structured row.

Everything is keyed by addr_id. Lists that order matters in carry explicit ordinals: ``ord`` (kind,
possibility, start, stop, dist, origin), ``rank`` (dist, crf descending, ord), ``place`` (countries: codes first,
then by rank; towns: rank).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import score as K
from ..functions import text as X
from ..settle import by_address, settle
from . import fuzzy, postcode
from .gazetteer import ReferenceData

MATCH = ["addr_id", "kind", "start", "stop", "matched", "possibility", "dist", "flags", "origin", "crf"]


def flag_if(flags: Column, **conditions: Column) -> Column:
    """flags with the names whose conditions hold, distinct and sorted."""
    added = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))
    return F.array_sort(F.array_distinct(F.concat(flags, added)))


def clean_addresses(addresses: DataFrame, *, most: int = S.LIMITS.max_length) -> DataFrame:
    """Adds ``text`` in clean form; texts longer than the limit raise an error, as the whole run would otherwise be cut."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    checked = F.when(F.length(raw) <= most, raw).otherwise(F.raise_error(F.concat(F.lit("address is too long: "), F.length(raw).cast("string"))).cast("string"))
    return addresses.withColumn("text", X.clean(checked))


def too_long(addresses: DataFrame, *, most: int = S.LIMITS.max_length) -> DataFrame:
    """The rows that clean_addresses would refuse."""
    return addresses.where(F.length("text") > most)


def scored_by_crf(matches: DataFrame, probabilities: DataFrame | None, tag: str, default: float) -> DataFrame:
    """crf: the mean of the tag's probabilities (addr_id, tag, series) over the match, or the default without a model."""
    if probabilities is None:
        return matches.withColumn("crf", F.lit(default))
    from .seqmodel import span_mean

    series = probabilities.where(F.col("tag") == tag).select("addr_id", "series")
    return matches.join(by_address(series), "addr_id", "left").withColumn("crf", F.coalesce(span_mean(F.col("series"), F.col("start"), F.col("stop")), F.lit(0.0))).drop("series")


def suggested(countries: DataFrame, addresses: DataFrame, score: float) -> DataFrame:
    """Codes equal to the hint are marked and raised to ``score``; each hinted address gets a generated match behind its text."""
    hint = addresses.select("addr_id", "suggested")
    marked = countries.join(by_address(hint), "addr_id", "left")
    is_hint = (F.col("kind") == 1) & (F.col("suggested") != "") & (F.col("origin") == F.col("suggested"))
    marked = marked.withColumn("crf", F.when(is_hint, F.greatest("crf", F.lit(score))).otherwise(F.col("crf"))).withColumn("flags", flag_if(F.col("flags"), IS_SUGGESTED_COUNTRY=F.coalesce(is_hint, F.lit(False))))
    made = addresses.where((F.col("suggested") != "") & (F.col("suggested") != S.NO_COUNTRY)).select("addr_id", F.lit(2).alias("kind"), (F.length("text") + 2).alias("start"), (F.length("text") + 2 + F.length("suggested")).alias("stop"), F.col("suggested").alias("matched"), F.col("suggested").alias("possibility"), F.lit(0).alias("dist"), F.array(F.lit("GENERATED_BY_SUGGESTED_COUNTRY")).alias("flags"), F.col("suggested").alias("origin"), F.lit(score).alias("crf"))
    return marked.select(*MATCH).unionByName(made)


def separator_typo() -> Column:
    return (F.col("dist") > 0) & (X.without_separators(F.col("matched")) == X.without_separators(F.col("possibility")))


def street_overlap(spans: Column) -> Column:
    """Whether STREET spans (array of start, stop, tag) cover half of the match."""
    covered = F.aggregate(F.filter(spans, lambda s: s["tag"] == "STREET"), F.lit(0), lambda a, s: a + F.greatest(F.lit(0), F.least(s["stop"], F.col("stop")) - F.greatest(s["start"], F.col("start"))))
    return (F.col("stop") > F.col("start")) & (covered / (F.col("stop") - F.col("start")) >= S.LIMITS.street_share)


def town_flags(towns: DataFrame, addresses: DataFrame, index: DataFrame) -> DataFrame:
    """Separator, population, street and line flags; addresses may have ``spans``."""
    names = index.select(F.col("alias").alias("possibility"), "population", "largest")
    rows = towns.join(names, "possibility", "left").join(by_address(addresses), "addr_id")
    street = street_overlap(F.col("spans")) if "spans" in addresses.columns else F.lit(False)
    flags = flag_if(
        F.col("flags"),
        IS_SEPARATOR_TYPO=separator_typo(),
        IS_METROPOLIS=F.col("population") >= S.LIMITS.metropolis,
        IS_SMALL_TOWN=F.col("population") <= S.LIMITS.small_town,
        IS_NOT_LARGEST_TOWN_WITH_NAME=F.col("largest") != F.col("origin"),
        IS_INSIDE_STREET=F.coalesce(street, F.lit(False)),
        IS_ALONE_ON_LINE=X.alone_on_line(F.col("text"), F.col("start"), F.col("stop")),
        IS_FROM_EXTENDED_DATA=F.col("kind") == 1,
    )
    return rows.withColumn("flags", flags).select(*MATCH)


def country_flags(countries: DataFrame, addresses: DataFrame, ref: ReferenceData) -> DataFrame:
    """Separator, IBAN, street, province, country-head, phone, domain and postal-code flags; addresses may have ``spans``, ``head`` (country, confidence) and ``predictions`` (tag, text)."""
    rows = countries.join(by_address(addresses), "addr_id")
    has = set(addresses.columns)
    street = street_overlap(F.col("spans")) if "spans" in has else F.lit(False)
    iban = F.exists(X.ibans(F.col("text")), lambda i: F.upper(F.substring(i, 1, 2)) == F.upper("origin"))
    confidence = F.when(F.col("head.country") == F.col("origin"), F.col("head.confidence")).otherwise(0.0) if "head" in has else F.lit(0.0)
    never = F.lit(False)
    province = phone = domain = postal = never
    if ref.provinces is not None:
        listed = ref.provinces.groupBy("origin").agg(F.collect_set(X.lookup_name(F.col("alias"))).alias("provinces"))
        rows = rows.join(listed, "origin", "left")
        province = (F.length("possibility") <= 2) & F.coalesce(F.array_contains("provinces", F.col("possibility")), never)
    if ref.specs is not None:
        rows = rows.join(ref.specs.select("origin", "domain_extensions", "phone_prefixes", "postal_code_regex"), "origin", "left")
        phone = F.coalesce(F.exists("phone_prefixes", lambda p: (p != "") & F.contains(F.col("text"), p)), never)
        domain = F.coalesce(F.exists("domain_extensions", lambda d: (d != "") & F.contains(F.lower("text"), F.lower(d))), never)
        if "predictions" in has:
            postal = F.coalesce(F.exists(F.filter("predictions", lambda p: p["tag"] == "POSTAL_CODE"), lambda p: F.regexp_like(p["text"], F.col("postal_code_regex"))), never)
            rows = rows.withColumn("postal_code_regex", usable_regex(ref.specs)[F.col("origin")])
    common = F.col("origin").isin(*S.COMMON_PROVINCE_ORIGINS)
    flags = flag_if(
        F.col("flags"),
        IS_SEPARATOR_TYPO=separator_typo(),
        IBAN_IS_PRESENT=iban,
        IS_INSIDE_STREET=F.coalesce(street, never),
        IS_COMMON_STATE_PROVINCE_ALIAS=province & common,
        IS_UNCOMMON_STATE_PROVINCE_ALIAS=province & ~common,
        MLP_STRONGLY_AGREES=confidence >= 0.99,
        MLP_AGREES=(confidence >= 0.90) & (confidence < 0.99),
        MLP_DOESNT_DISAGREE=(confidence >= 0.50) & (confidence < 0.90),
        PHONE_PREFIX_IS_PRESENT=phone,
        DOMAIN_IS_PRESENT=domain,
        POSTAL_CODE_IS_PRESENT=postal,
    )
    return rows.withColumn("flags", F.when(F.col("kind") == 2, F.col("flags")).otherwise(flags)).select(*MATCH)


def usable_regex(specs: DataFrame) -> Column:
    """A map of country to postal-code pattern, of patterns that compile: a bad one matches nothing. A row a country."""
    found = {}
    for origin, pattern in specs.select("origin", "postal_code_regex").where("postal_code_regex <> ''").collect():
        try:
            specs.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:  # the JVM's syntax error
            continue
        found[origin] = pattern
    return F.create_map(*[F.lit(x) for pair in found.items() for x in pair]) if found else F.create_map(F.lit(""), F.lit(None).cast("string"))


def ranked(matches: DataFrame, codes_first: bool) -> DataFrame:
    """Adds ``rank`` and ``place`` and the flags of inclusion and position; matches need ``length`` of their text."""
    w = W.partitionBy("addr_id")
    order = ["dist", F.desc("crf"), "kind", "possibility", "start", "stop", "origin"]
    rows = matches.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    # an address has few matches: its list rides along and inclusion is an expression
    rows = rows.withColumn("all", F.collect_list(F.struct("start", "stop", "rank", "dist")).over(w))
    larger = lambda o: ((o["start"] < F.col("start")) & (o["stop"] >= F.col("stop"))) | ((o["stop"] > F.col("stop")) & (o["start"] <= F.col("start")))
    inside = lambda around: flag_if(
        F.col("flags"),
        IS_INSIDE_ANOTHER_LOWER_RANKED_MATCH=F.exists(around, lambda o: (o["rank"] >= F.col("rank")) & (o["dist"] < 1)),
        IS_INSIDE_ANOTHER_HIGHER_RANKED_MATCH=F.exists(around, lambda o: o["rank"] < F.col("rank")),
        IS_SHORT=F.col("stop") - F.col("start") <= 2,
        IS_IN_FIRST_THIRD=F.col("start") <= F.col("length") / 3,
        IS_IN_LAST_THIRD=F.col("start") >= 2 * F.col("length") / 3,
    )
    flags = X.let(F.filter("all", larger), inside)
    rows = rows.withColumn("flags", F.when(F.array_contains("flags", "GENERATED_BY_SUGGESTED_COUNTRY"), F.col("flags")).otherwise(flags)).drop("all")
    place = F.row_number().over(w.orderBy(F.length("possibility") > 2, "rank")) if codes_first else F.col("rank")
    return rows.withColumn("place", place)


def relationships(towns: DataFrame, countries: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists with the flags that pairs of one origin give each other: one equi-join, summed up for each side."""
    t = towns.select("addr_id", "origin", F.col("place").alias("t_place"), F.struct("start", "stop", "flags", "dist").alias("t"))
    c = countries.select("addr_id", "origin", F.col("place").alias("c_place"), F.struct("start", "stop", "flags", "dist").alias("c"))
    pairs = t.join(by_address(c), ["addr_id", "origin"]).join(by_address(addresses.select("addr_id", "text")), "addr_id")
    h = lambda side, k: F.array_contains(F.col(f"{side}.flags"), k)
    valid = (F.col("origin") != "") & (F.col("t.dist") == 0) & (F.col("c.dist") == 0) & ~h("t", "IS_INSIDE_ANOTHER_WORD") & ~(h("c", "IS_SHORT") & h("c", "IS_INSIDE_ANOTHER_WORD"))
    gap = X.between(F.col("text"), F.col("t.start"), F.col("t.stop"), F.col("c.start"), F.col("c.stop"))
    near = ~h("c", "IS_COMMON_STATE_PROVINCE_ALIAS") & ~h("c", "IS_UNCOMMON_STATE_PROVINCE_ALIAS") & ~h("c", "GENERATED_BY_SUGGESTED_COUNTRY")
    pairs = pairs.where(valid).select("addr_id", "t_place", "c_place", h("t", "IS_FROM_EXTENDED_DATA").alias("extended"), (h("c", "IS_SUGGESTED_COUNTRY") | h("c", "GENERATED_BY_SUGGESTED_COUNTRY")).alias("hinted"), (near & (F.length(gap) <= S.LIMITS.close)).alias("close"), (near & ~F.contains(gap, F.lit("\n"))).alias("line"))
    by_town = pairs.groupBy("addr_id", F.col("t_place").alias("place")).agg(*[F.bool_or(k).alias(k) for k in ("hinted", "close", "line")])
    by_country = pairs.where(~F.col("extended")).groupBy("addr_id", F.col("c_place").alias("place")).agg(*[F.bool_or(k).alias(k) for k in ("close", "line")])
    yes = lambda k: F.coalesce(F.col(k), F.lit(False))
    out_t = towns.join(by_address(by_town), ["addr_id", "place"], "left").withColumn("flags", flag_if(F.col("flags"), COUNTRY_IS_PRESENT=F.col("hinted").isNotNull(), SUGGESTED_COUNTRY_IS_PRESENT=yes("hinted"), IS_VERY_CLOSE_TO_COUNTRY=yes("close"), IS_ON_SAME_LINE_AS_COUNTRY=yes("line"))).drop("hinted", "close", "line")
    out_c = countries.join(by_address(by_country), ["addr_id", "place"], "left").withColumn("flags", flag_if(F.col("flags"), TOWN_IS_PRESENT=F.col("close").isNotNull(), IS_VERY_CLOSE_TO_TOWN=yes("close"), IS_ON_SAME_LINE_AS_TOWN=yes("line"))).drop("close", "line")
    if "head" in addresses.columns:
        out_t = out_t.join(by_address(addresses.select("addr_id", "head")), "addr_id").withColumn("flags", flag_if(F.col("flags"), MLP_COUNTRY_IS_PRESENT=(F.col("head.confidence") >= 0.99) & (F.col("head.country") == F.col("origin")))).drop("head")
    if "predictions" in addresses.columns:
        mistaken = lambda tag: F.exists(F.filter("predictions", lambda p: p["tag"] == tag), lambda p: F.contains(p["text"], F.col("matched")))
        p = by_address(addresses.select("addr_id", "predictions"))
        out_t = out_t.join(p, "addr_id").withColumn("flags", flag_if(F.col("flags"), COULD_BE_REASONABLE_MISTAKE=mistaken("COUNTRY"))).drop("predictions")
        out_c = out_c.join(p, "addr_id").withColumn("flags", flag_if(F.col("flags"), COULD_BE_REASONABLE_MISTAKE=mistaken("TOWN"))).drop("predictions")
    return out_t, out_c


def postcode_flags(towns: DataFrame, postcodes: DataFrame) -> DataFrame:
    """POSTCODE_FOR_TOWN_FOUND on towns that a postal code (addr_id, possibility, origin) of the text belongs to, under any alias."""
    keys = postcodes.select("addr_id", "origin", F.explode(X.aliases(X.lookup_name(F.col("possibility")))).alias("possibility")).distinct().withColumn("found", F.lit(True))
    return towns.join(by_address(keys), ["addr_id", "origin", "possibility"], "left").withColumn("flags", flag_if(F.col("flags"), POSTCODE_FOR_TOWN_FOUND=F.coalesce("found", F.lit(False)))).drop("found")


def combinations(countries: DataFrame, towns: DataFrame, addresses: DataFrame, same_name: DataFrame | None = None) -> DataFrame:
    """(addr_id, country, country_possibility, town_origin, town, scores, score, phase, number): all pairs and single matches, best first, each country and town once.

    Inputs have ``score`` and ``place``; addresses have ``suggested`` and ``force``. An address without any
    gets the placeholder pair.
    """
    hints = by_address(addresses.select("addr_id", "suggested", "force"))
    forced = F.col("force") & (F.col("suggested") != "")
    cs = countries.join(hints, "addr_id").where(~forced | (F.col("origin") == F.col("suggested"))).drop("suggested", "force")
    ts = towns.join(hints, "addr_id").withColumn("solo", ~(forced & (F.col("suggested") != S.NO_COUNTRY))).drop("force")
    matched = lambda d: F.col("matched") if "matched" in d.columns else F.col("possibility")
    pick = lambda d, p: d.select("addr_id", "origin", matched(d).alias(f"{p}_matched"), *[F.col(x).alias(f"{p}_{x}") for x in ("start", "stop", "possibility", "score", "place", "flags")], *(["solo", "suggested"] if p == "t" else []))
    c, t = pick(cs, "c"), pick(ts, "t")
    pairs = c.join(by_address(t), ["addr_id", "origin"])
    if same_name is not None:
        pairs = pairs.join(same_name.select(F.col("possibility").alias("t_possibility"), F.col("origin").alias("named")), "t_possibility", "left")
    else:
        pairs = pairs.withColumn("named", F.lit(None).cast("string"))
    same = (F.col("c_start") == F.col("t_start")) & (F.col("c_stop") == F.col("t_stop"))
    holds = lambda a, b: ((F.col(f"{b}_start") > F.col(f"{a}_start")) & (F.col(f"{b}_stop") <= F.col(f"{a}_stop"))) | ((F.col(f"{b}_start") >= F.col(f"{a}_start")) & (F.col(f"{b}_stop") < F.col(f"{a}_stop")))
    skip = F.when(same, ~F.coalesce(F.col("named") == F.col("origin"), F.lit(False))).otherwise(holds("c", "t") | holds("t", "c"))
    empty = F.lit("")
    row = lambda d, phase, country, cp, town, to, sc, st, score, i, j: d.select("addr_id", (F.col("c_matched") if "c_matched" in d.columns else empty).alias("country_matched"), (F.col("t_matched") if "t_matched" in d.columns else empty).alias("town_matched"), country.alias("country"), cp.alias("country_possibility"), town.alias("town"), to.alias("town_origin"), sc.alias("country_score"), st.alias("town_score"), score.alias("score"), F.lit(phase).alias("phase"), i.alias("i"), j.alias("j"))
    zero, none_c, none_t = F.lit(0), F.lit(S.NO_COUNTRY), F.lit(S.NO_TOWN)
    # the hint that there is no country raises the placeholder's own score, not the pair's
    least_c = F.when(F.col("suggested") == S.NO_COUNTRY, S.LIMITS.suggested_score).otherwise(S.LIMITS.country_least)
    least_t = F.lit(S.LIMITS.town_least)
    found = [
        row(pairs.where(~skip), 0, F.col("origin"), F.col("c_possibility"), F.col("t_possibility"), F.col("origin"), F.col("c_score"), F.col("t_score"), (F.col("c_score") + F.col("t_score")) / 2, F.col("c_place"), F.col("t_place")),
        row(c, 1, F.col("origin"), F.col("c_possibility"), none_t, F.lit(""), F.col("c_score"), least_t, K.solo_country(F.col("c_score"), F.col("c_flags")), F.col("c_place"), zero),
        row(t.where("solo"), 2, none_c, F.lit(""), F.col("t_possibility"), F.col("origin"), least_c, F.col("t_score"), K.solo_town(F.col("t_score"), F.col("t_flags")), zero, F.col("t_place")),
    ]
    # each address brings its placeholder, which goes if there is anything else: an anti join would need all the joins above twice
    found.append(row(addresses.select("addr_id", "suggested"), 3, none_c, F.lit(""), none_t, F.lit(""), least_c, least_t, F.lit((S.LIMITS.country_least + S.LIMITS.town_least) / 2), zero, zero))
    rows = reduce(DataFrame.unionByName, found).withColumn("first", F.min("phase").over(W.partitionBy("addr_id"))).where("phase < 3 or first = 3").drop("first")
    order = [F.desc("score"), "phase", "i", "j"]
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("addr_id", "country", F.replace("town", F.lit("-"), F.lit(" "))).orderBy(*order))).where("nth = 1").drop("nth")
    return rows.withColumn("number", F.row_number().over(W.partitionBy("addr_id").orderBy(*order)))


def structured(combos: DataFrame, addresses: DataFrame) -> DataFrame:
    """addr_id, address_line, country, town, postal_code, street and confidences: the first real country and the first real town, each on its own."""
    real_c = (F.col("country") != S.NO_COUNTRY) & (F.col("country") != "")
    real_t = (F.col("town") != S.NO_TOWN) & (F.col("town") != "")
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("number")))
    got = combos.groupBy("addr_id").agg(first("country", real_c).alias("country"), first("country_score", real_c).alias("country_confidence"), first("town", real_t).alias("town"), first("town_score", real_t).alias("town_confidence"), F.bool_or(real_c).alias("has_c"), F.bool_or(real_t).alias("has_t"))
    out = addresses.join(by_address(got), "addr_id", "left")
    if "predictions" in addresses.columns:
        codes = F.filter("predictions", lambda p: p["tag"] == "POSTAL_CODE")
        best = F.array_max(F.transform(codes, lambda p, i: F.struct(p["confidence"].alias("c"), (-i).alias("o"), F.trim(p["text"]).alias("t"))))
        streets = F.transform(F.array_sort(F.transform(F.filter("predictions", lambda p: p["tag"] == "STREET"), lambda p: F.struct(p["start"].alias("s"), F.trim(p["text"]).alias("t")))), lambda p: p["t"])
        postal, street = F.coalesce(best["t"], F.lit("")), F.array_join(F.filter(streets, lambda s: s != ""), " ")
    else:
        postal = street = F.lit("")
    pick = lambda c, ok, empty: F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(F.lit(empty)).alias(c)
    raw = ["input"] if "input" in addresses.columns else []
    return out.select("addr_id", *raw, F.col("text").alias("address_line"), pick("country", F.col("has_c"), ""), pick("town", F.col("has_t"), ""), postal.alias("postal_code"), street.alias("street"), pick("country_confidence", F.col("has_c"), 0.0), pick("town_confidence", F.col("has_t"), 0.0))


def n_best(combos: DataFrame, n: int = 2) -> DataFrame:
    """One row per address with the n best combinations as columns."""
    aggs = []
    for i in range(1, n + 1):
        aggs += [F.max(F.when(F.col("number") == i, F.col(c))).alias(f"{c}_{i}") for c in ("country", "town", "score")]
    return combos.groupBy("addr_id").agg(*aggs)


def match_all(addresses: DataFrame, ref: ReferenceData, *, probabilities: DataFrame | None = None, crf: float = 0.5, limits: S.Limits = S.LIMITS, postcodes: DataFrame | None = None, held: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored countries and towns of clean addresses (addr_id, text, suggested, force, ...).

    Lists that several later steps read are settled; their paths are added to ``held``.
    """
    keep = lambda df, name: settle(df, name, held)
    texts = addresses.select("addr_id", "text")
    # one scan for all dictionaries: countries 0, codes 1, towns 2, extended towns 3
    listed = [ref.countries, ref.codes, ref.towns] + ([ref.extended_towns] if ref.extended_towns is not None else [])
    entries = reduce(DataFrame.unionByName, [d.select("possibility", "origins", F.lit(k).alias("kind")) for k, d in enumerate(listed)])
    found = keep(fuzzy.match_dictionaries(texts, entries, cutoff=limits.cutoff, tolerance=limits.tolerance, held=held), "matches")
    countries = scored_by_crf(found.where("kind < 2"), probabilities, "COUNTRY", crf)
    countries = suggested(countries, addresses, limits.suggested_score)
    head = F.col("head.country") if "head" in addresses.columns else F.lit("")
    countries = countries.join(by_address(addresses.select("addr_id", head.alias("__head"))), "addr_id").where((F.col("kind") != 1) | (F.col("crf") > 0) | (F.col("origin") == F.col("__head"))).drop("__head")
    towns = scored_by_crf(found.where("kind >= 2").withColumn("kind", F.col("kind") - 2), probabilities, "TOWN", crf)
    length = by_address(addresses.select("addr_id", F.length("text").alias("length")))
    towns = keep(ranked(town_flags(towns, addresses, ref.town_index).join(length, "addr_id"), False), "towns")
    countries = keep(ranked(country_flags(countries, addresses, ref).join(length, "addr_id"), True), "countries")
    towns, countries = relationships(towns, countries, addresses)
    if postcodes is not None:
        towns = postcode_flags(towns, postcodes)
    # settled before they are filtered: a filter moved below the score would make the flags again for each of their uses in it
    score = lambda side: K.match_score(side, F.col("flags"), F.col("dist"), F.col("crf"))
    towns = keep(towns.withColumn("score", score("town")), "scored-towns").where(F.col("score") >= limits.town_least)
    countries = keep(countries.withColumn("score", score("country")), "scored-countries").where(F.col("score") >= limits.country_least)
    return countries, towns


def resolve(addresses: DataFrame, ref: ReferenceData, **options) -> DataFrame:
    """Raw addresses (addr_id, text, and optionally suggested, force, spans, head, predictions) to structured rows with quality.

    ``input`` is the raw text, ``address_line`` the cleaned one. Postal codes are looked up where the reference
    data have them. ``settle.release`` removes the settled tables behind the rows.
    """
    for name, value in (("suggested", ""), ("force", False)):
        if name not in addresses.columns:
            addresses = addresses.withColumn(name, F.lit(value))
    held: list[str] = []
    # a small file of many addresses is much work: it is dealt out, so that not one task does it all
    dealt = addresses.withColumn("input", F.coalesce(F.col("text"), F.lit(""))).repartition("addr_id")
    ready = settle(clean_addresses(dealt), "addresses", held)
    if ref.postcodes is not None:
        options.setdefault("postcodes", postcode.match_postcodes(ready, ref.postcodes))
    countries, towns = match_all(ready, ref, held=held, **options)
    rows = structured(combinations(countries, towns, ready, ref.same_name), ready)
    rows = rows.withColumn("quality", K.quality(F.col("country"), F.col("town"), F.col("country_confidence"), F.col("town_confidence"))).select("*", "quality.*").drop("quality")
    rows.held = held
    return rows
