"""Further queries: flags, hints, solo scores, the model path, the cascade, filling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import score as K
from ..functions import text as X
from ..operators import cache as C
from ..operators import evaluate as V
from ..operators import fill as L
from ..operators import gazetteer as G
from ..operators import resolve, seqmodel, services, tagging
from ..sources import sinks
from .catalog import _COMBOS, _PLAN, _QUALITY, _SPANS, _assessed, _hinted, _labelled, _lists, _span_matches, query, table

# ---------------------------------------------------------------- guards, inputs


@query("select doc_id, length(text) as size from documents where length(text) > 224")
def length_guard(s, d):
    return resolve.too_long(table(s, d, "documents")).select("doc_id", F.length("text").cast("long").alias("size"))


@query("""select c_custkey, concat_ws(chr(10), c_name, case when c_nationkey % 3 <> 0 then c_mktsegment end) as plain, c_name as address, concat_ws(chr(10), c_name, case when c_nationkey % 3 <> 0 then c_mktsegment end, 'N' || c_nationkey) as whole from customer""")
def input_modes(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("address"), F.when(F.col("c_nationkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("town"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("country"))
    return c.select("c_custkey", V.input_text("other").alias("plain"), V.input_text("address").alias("address"), V.input_text("address-town-country").alias("whole"))


@query("select vec_id, '[' || ((vec_id % 7) / 2) || ',' || ((vec_id % 5) * 0.25)::double || ']' as literal from embeddings")
def vector_literal(s, d):
    k = F.col("vec_id")
    return table(s, d, "embeddings").select("vec_id", sinks.vector_literal(F.array(k % 7 / F.lit(2.0), (k % 5) * F.lit(0.25))).alias("literal"))


@query("select source, count(*) as n from (select case when doc_id % 3 = 0 then 'human_verified' else 'crf_pipeline' end as source from documents) group by source")
def count_by_source(s, d):
    return services.count_by_source(table(s, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "human_verified").otherwise("crf_pipeline").alias("source")))


# ---------------------------------------------------------------- flags

_TEXT = "XXXX\nYYYY ZZZZ\n  QQQQ  \nEND"
_SPOTS = ((0, 4), (5, 9), (10, 14), (17, 21), (24, 27))


def _spot(k, n):
    """(start, stop) of the k-th spot of the fixed text."""
    return [F.get(F.array(*[F.lit(x[i]) for x in _SPOTS]), (k % n).cast("int")) for i in (0, 1)]


def _spots_sql(k, n):
    return f"[{', '.join(str(a) for a, _ in _SPOTS)}][{k} % {n} + 1] as start, [{', '.join(str(b) for _, b in _SPOTS)}][{k} % {n} + 1] as stop"


def _joined(flags="flags"):
    return F.array_join(flags, ",").alias("flags")


def _flags_sql(pairs):
    return "array_to_string(list_sort([x for x in [" + ", ".join(f"case when {c} then '{f}' end" for f, c in pairs) + "] if x is not null]), ',') as flags"


@query(f"""with m as (select o_orderkey as id, o_orderkey % 11 as t, o_orderkey % 3 = 0 as typo, o_orderkey % 5 as o, o_orderkey % 2 as kind, o_orderkey % 4 as w from orders)
select id, {_flags_sql([("IS_SEPARATOR_TYPO", "typo"), ("IS_METROPOLIS", "t * 150000 >= 1000000"), ("IS_SMALL_TOWN", "t * 6000 <= 12000 and t > 0"), ("IS_NOT_LARGEST_TOWN_WITH_NAME", "t > 0 and t % 5 <> o"), ("IS_INSIDE_STREET", "w in (1, 2)"), ("IS_ALONE_ON_LINE", "w in (0, 3)"), ("IS_FROM_EXTENDED_DATA", "kind = 1")])} from m""".replace("t * 150000 >= 1000000", "pop >= 1000000").replace("t * 6000 <= 12000 and t > 0", "pop <= 12000 and pop > 0").replace("as t, o_orderkey % 3", "as t, case when o_orderkey % 11 < 5 then (o_orderkey % 11) * 4000 else (o_orderkey % 11) * 150000 end as pop, o_orderkey % 3"))
def town_flags(s, d):
    k = F.col("o_orderkey")
    t = k % 11
    start, stop = _spot(k, 4)
    name = F.concat(F.lit("T-"), t)
    typo = k % 3 == 0
    m = table(s, d, "orders").select(k.alias("addr_id"), (k % 2).cast("int").alias("kind"), start.alias("start"), stop.alias("stop"), F.when(typo, F.replace(name, F.lit("-"), F.lit(" "))).otherwise("x").alias("matched"), name.alias("possibility"), F.when(typo, 1).otherwise(0).alias("dist"), F.array().cast("array<string>").alias("flags"), F.concat(F.lit("R"), k % 5).alias("origin"), F.lit(0.5).alias("crf"))
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(12).alias("stop"), F.lit("STREET").alias("tag")))
    addresses = m.select("addr_id", F.lit(_TEXT).alias("text"), spans.alias("spans"))
    n = s.range(1, 11)
    index = n.select(F.concat(F.lit("T-"), "id").alias("alias"), F.when(F.col("id") < 5, F.col("id") * 4000).otherwise(F.col("id") * 150000).alias("population"), F.concat(F.lit("R"), F.col("id") % 5).alias("largest"))
    return resolve.town_flags(m, addresses, index).select(F.col("addr_id").alias("id"), _joined())


_C_FLAGS = [("IS_SEPARATOR_TYPO", "k % 7 = 0"), ("IBAN_IS_PRESENT", "o = 0 and k % 3 = 0"), ("IS_INSIDE_STREET", "w = 1"), ("IS_COMMON_STATE_PROVINCE_ALIAS", "o = 1 and k % 2 = 0"), ("IS_UNCOMMON_STATE_PROVINCE_ALIAS", "o = 2 and k % 2 = 0"), ("MLP_STRONGLY_AGREES", "h = o and c >= 0.99"), ("MLP_AGREES", "h = o and c >= 0.9 and c < 0.99"), ("MLP_DOESNT_DISAGREE", "h = o and c >= 0.5 and c < 0.9"), ("PHONE_PREFIX_IS_PRESENT", "o = 1 and k % 4 = 0"), ("DOMAIN_IS_PRESENT", "o = 0 and k % 5 = 0"), ("POSTAL_CODE_IS_PRESENT", "o = 2 and k % 6 < 3")]


@query(f"with m as (select o_orderkey as id, o_orderkey as k, o_orderkey % 3 as o, o_orderkey % 4 as w, o_orderkey % 4 as h, [0.2, 0.5, 0.9, 0.99, 0.95][o_orderkey % 5 + 1] as c from orders) select id, {_flags_sql(_C_FLAGS)} from m")
def country_flags(s, d):
    """Countries DE, US and FR; the last one's postal pattern is checked against predictions, the first one's is broken and ignored."""
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("DE", "US", "FR", "IT")])
    origin = F.get(names, (k % 3).cast("int"))
    start, stop = _spot(k, 4)
    province = k % 2 == 0
    m = table(s, d, "orders").select(k.alias("addr_id"), F.lit(0).alias("kind"), start.alias("start"), stop.alias("stop"), F.when(k % 7 == 0, "N Y").otherwise("x").alias("matched"), F.when(province, "NY").when(k % 7 == 0, "NY").otherwise("LONGER").alias("possibility"), F.when(k % 7 == 0, 1).otherwise(0).alias("dist"), F.array().cast("array<string>").alias("flags"), origin.alias("origin"), F.lit(0.5).alias("crf"))
    m = m.withColumn("possibility", F.when(~(F.col("addr_id") % 2 == 0) & (F.col("addr_id") % 7 == 0), "N-Y").otherwise(F.col("possibility")))
    text = F.concat(F.lit(_TEXT), F.when(k % 3 == 0, "\nDE12 ABCD EFGH").otherwise(""), F.when(k % 4 == 0, " +1 555").otherwise(""), F.when(k % 5 == 0, " WWW.X.DE").otherwise(""))
    head = F.struct(F.get(names, (k % 4).cast("int")).alias("country"), F.get(F.array(*[F.lit(x) for x in (0.2, 0.5, 0.9, 0.99, 0.95)]), (k % 5).cast("int")).alias("confidence"))
    prediction = F.array(F.struct(F.lit("POSTAL_CODE").alias("tag"), F.when(k % 6 < 3, "F75001").otherwise("75").alias("text")))
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("stop"), F.lit("STREET").alias("tag")))
    addresses = table(s, d, "orders").select(k.alias("addr_id"), text.alias("text"), head.alias("head"), prediction.alias("predictions"), spans.alias("spans"))
    specs = s.createDataFrame([("DE", [".de"], ["+49"], "[0-9"), ("US", [".us"], ["+1 "], ""), ("FR", [], [""], "[0-9]{5}")], "origin string, domain_extensions array<string>, phone_prefixes array<string>, postal_code_regex string")
    provinces = s.createDataFrame([("US", "ny"), ("FR", "NY"), ("DE", "BY")], "origin string, alias string")
    none = s.createDataFrame([], "possibility string, origins array<string>")
    ref = G.ReferenceData(none, none, none, s.createDataFrame([], "alias string, population long, largest string"), provinces=provinces, specs=specs)
    return resolve.country_flags(m, addresses, ref).select(F.col("addr_id").alias("id"), _joined())


_PAIRED = f"""p as (select o_custkey as a, o_orderkey as k, 'R' || o_orderkey % 4 as origin, {_spots_sql('o_orderkey', 5)}, o_orderkey % 6 = 0 as typo, o_orderkey % 5 = 0 as inside, o_orderkey % 7 = 0 as short, o_orderkey % 3 = 0 as is_c, o_orderkey % 8 = 0 as hint, o_orderkey % 9 = 0 as prov, o_orderkey % 2 = 0 as ext from orders),
t as (select * from p where not is_c), c as (select * from p where is_c),
pairs as (select t.a, t.k as tk, c.k as ck, t.ext, c.hint, not c.prov as near, case when t.start <= c.start then t.stop else c.stop end as l, case when t.start <= c.start then c.start else t.start end as r from t join c on t.a = c.a and t.origin = c.origin where not t.typo and not c.typo and not t.inside and not (c.short and c.inside)),
g as (select *, case when r > l then substring({"'" + _TEXT.replace(chr(10), "' || chr(10) || '") + "'"}, l + 1, r - l) else '' end as gap from pairs)"""


def _pair_lists(s, d):
    k = F.col("o_orderkey")
    start, stop = _spot(k, 5)
    add = lambda name, n: F.when(k % n == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(add("IS_INSIDE_ANOTHER_WORD", 5), add("IS_SHORT", 7), F.when(k % 3 == 0, F.concat(add("IS_SUGGESTED_COUNTRY", 8), add("IS_UNCOMMON_STATE_PROVINCE_ALIAS", 9))).otherwise(add("IS_FROM_EXTENDED_DATA", 2)))
    m = table(s, d, "orders").select(F.col("o_custkey").alias("addr_id"), k.alias("place"), F.concat(F.lit("R"), k % 4).alias("origin"), start.alias("start"), stop.alias("stop"), F.when(k % 6 == 0, 1).otherwise(0).alias("dist"), flags.alias("flags"), F.concat(F.lit("M"), k % 10).alias("matched"))
    heads = table(s, d, "customer").select(F.col("c_custkey").alias("addr_id"), F.lit(_TEXT).alias("text"))
    return m.where("place % 3 <> 0"), m.where("place % 3 = 0"), heads


@query(f"""with {_PAIRED} select k, {_flags_sql([("IS_INSIDE_ANOTHER_WORD", "inside"), ("IS_SHORT", "short"), ("IS_FROM_EXTENDED_DATA", "ext"), ("COUNTRY_IS_PRESENT", "n > 0"), ("SUGGESTED_COUNTRY_IS_PRESENT", "hinted"), ("IS_VERY_CLOSE_TO_COUNTRY", "close"), ("IS_ON_SAME_LINE_AS_COUNTRY", "line")])} from
t left join (select tk, count(*) as n, bool_or(hint) as hinted, bool_or(near and length(gap) <= 15) as close, bool_or(near and not contains(gap, chr(10))) as line from g group by tk) on k = tk""")
def relationship_towns(s, d):
    towns, countries, addresses = _pair_lists(s, d)
    return resolve.relationships(towns, countries, addresses)[0].select(F.col("place").alias("k"), _joined(F.array_sort("flags")))


@query(f"""with {_PAIRED} select k, {_flags_sql([("IS_INSIDE_ANOTHER_WORD", "inside"), ("IS_SHORT", "short"), ("IS_SUGGESTED_COUNTRY", "hint"), ("IS_UNCOMMON_STATE_PROVINCE_ALIAS", "prov"), ("TOWN_IS_PRESENT", "n > 0"), ("IS_VERY_CLOSE_TO_TOWN", "close"), ("IS_ON_SAME_LINE_AS_TOWN", "line")])} from
c left join (select ck, count(*) as n, bool_or(near and length(gap) <= 15) as close, bool_or(near and not contains(gap, chr(10))) as line from g where not ext group by ck) on k = ck""")
def relationship_countries(s, d):
    towns, countries, addresses = _pair_lists(s, d)
    return resolve.relationships(towns, countries, addresses)[1].select(F.col("place").alias("k"), _joined(F.array_sort("flags")))


@query("""with p as (select o_custkey as a, o_orderkey as k, 'R' || o_orderkey % 4 as origin, 'M' || o_orderkey % 10 as matched, o_orderkey % 3 = 0 as is_c from orders)
select k, is_c, case when is_c then a % 10 = k % 10 else (a + 1) % 10 = k % 10 end as mistake, not is_c and a % 4 = k % 4 and a % 2 = 0 as headed from p""")
def mistake_and_head_flags(s, d):
    """COULD_BE_REASONABLE_MISTAKE by predictions of the other tag, MLP_COUNTRY_IS_PRESENT by a sure country head."""
    towns, countries, addresses = _pair_lists(s, d)
    a = F.col("addr_id")
    prediction = lambda tag, n: F.struct(F.lit(tag).alias("tag"), F.concat(F.lit("IN M"), n % 10, F.lit(" X")).alias("text"))
    addresses = addresses.withColumn("predictions", F.array(prediction("TOWN", a), prediction("COUNTRY", a + 1))).withColumn("head", F.struct(F.concat(F.lit("R"), a % 4).alias("country"), F.when(a % 2 == 0, 0.99).otherwise(0.98).alias("confidence")))
    t, c = resolve.relationships(towns, countries, addresses)
    h = lambda k: F.array_contains("flags", k)
    pick = lambda df, is_c: df.select(F.col("place").alias("k"), F.lit(is_c).alias("is_c"), h("COULD_BE_REASONABLE_MISTAKE").alias("mistake"), h("MLP_COUNTRY_IS_PRESENT").alias("headed"))
    return pick(t, False).union(pick(c, True))


@query("select o_orderkey as k, 'T ' || o_orderkey % 6 as possibility, o_orderkey % 6 < 3 and o_orderkey % 4 = (o_orderkey % 6) % 4 as found from orders")
def postcode_town_flags(s, d):
    """Towns that a postal code of the text belongs to, under another writing of their name."""
    k = F.col("o_orderkey")
    towns = table(s, d, "orders").select(k.alias("addr_id"), F.concat(F.lit("T "), k % 6).alias("possibility"), F.concat(F.lit("R"), k % 4).alias("origin"), F.array().cast("array<string>").alias("flags"))
    codes = table(s, d, "orders").select(k.alias("addr_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).select("addr_id", F.concat(F.lit("t-"), "n").alias("possibility"), F.concat(F.lit("R"), F.col("n") % 4).alias("origin"))
    return resolve.postcode_flags(towns, codes).select(F.col("addr_id").alias("k"), "possibility", F.array_contains("flags", "POSTCODE_FOR_TOWN_FOUND").alias("found"))


# ---------------------------------------------------------------- hints and scores

_HINTS = "hints as (select c_custkey as addr_id, case when c_nationkey % 4 = 0 then '' when c_nationkey % 4 = 1 then 'NO COUNTRY' else 'R' || c_nationkey % 5 end as hint, length(c_name) as n from customer)"


@query(f"""with {_SPANS}, {_HINTS}, l as (select m.*, id % 2 as kind, 'R' || id % 5 as origin, hint, id % 2 = 1 and hint <> '' and hint = 'R' || id % 5 as is_hint from m left join hints using (addr_id))
select addr_id, kind, start, stop, origin, round(case when is_hint then greatest(crf, 0.95) else crf end, 6) as crf, case when is_hint then 'IS_SUGGESTED_COUNTRY' else '' end as flags from l
union all select addr_id, 2, n + 2, n + 2 + length(hint), hint, 0.95, 'GENERATED_BY_SUGGESTED_COUNTRY' from hints where hint not in ('', 'NO COUNTRY')""")
def suggested_matches(s, d):
    n = F.col("c_nationkey")
    hint = F.when(n % 4 == 0, "").when(n % 4 == 1, S.NO_COUNTRY).otherwise(F.concat(F.lit("R"), n % 5))
    addresses = table(s, d, "customer").select(F.col("c_custkey").alias("addr_id"), hint.alias("suggested"), F.col("c_name").alias("text"))
    m = _span_matches(s, d).withColumn("kind", (F.col("id") % 2).cast("int"))
    got = resolve.suggested(m, addresses, S.LIMITS.suggested_score)
    return got.select("addr_id", "kind", "start", "stop", "origin", F.round("crf", 6).alias("crf"), _joined())


@query("""select c_custkey, round(((c_custkey * 37 % 101) / 100 + 0.15 - 0.7 * (case when c_custkey % 2 = 1 then 0.2 else 0 end + case when c_custkey // 2 % 2 = 1 then 0.2 else 0 end + case when c_custkey // 4 % 2 = 1 then 0.1 else 0 end)) / 2, 6) as country,
round((0.15 + (c_custkey * 37 % 101) / 100 - 0.1 * (case when c_custkey % 2 = 1 then 0.15 else 0 end + case when c_custkey // 2 % 2 = 1 then 0.65 else 0 end + case when c_custkey // 4 % 2 = 1 then 0.3 else 0 end + case when c_custkey // 8 % 2 = 1 then 0.15 else 0 end)) / 2, 6) as town from customer""")
def solo_scores(s, d):
    k = F.col("c_custkey")
    flags = lambda names: F.array_compact(F.array(*[F.when(F.floor(k / 2**i) % 2 == 1, f) for i, f in enumerate(names)]))
    score = k * 37 % 101 / F.lit(100.0)
    c = K.solo_country(score, flags(("TOWN_IS_PRESENT", "IS_VERY_CLOSE_TO_TOWN", "IS_ON_SAME_LINE_AS_TOWN")))
    t = K.solo_town(score, flags(("COUNTRY_IS_PRESENT", "SUGGESTED_COUNTRY_IS_PRESENT", "IS_VERY_CLOSE_TO_COUNTRY", "IS_ON_SAME_LINE_AS_COUNTRY")))
    return table(s, d, "customer").select("c_custkey", F.round(c, 6).alias("country"), F.round(t, 6).alias("town"))


_NONE_COMBOS = _COMBOS.replace("'R' || c_nationkey % 7 as suggested", "'NO COUNTRY' as suggested").replace("not force as solo", "true as solo").replace("origin, 0.15, score, (0.15 + score) / 2, 2", "origin, 0.95, score, (0.15 + score) / 2, 2").replace("'NO TOWN', '', 0.15, 0.15, 0.15, 3", "'NO TOWN', '', 0.95, 0.15, 0.15, 3")


@query(f"with {_NONE_COMBOS} select addr_id, country, town, round(country_score, 6) as country_score, round(score, 6) as score, number from combos")
def no_country_hint(s, d):
    """The hint that there is no country: placeholders score 0.95, forced addresses keep towns alone."""
    got = resolve.combinations(*_lists(s, d), _hinted(s, d).withColumn("suggested", F.lit(S.NO_COUNTRY)))
    return got.select("addr_id", "country", "town", F.round("country_score", 6).alias("country_score"), F.round("score", 6).alias("score"), "number")


_SHOWN = ", ".join(f"""coalesce(max(case when number = {i} and country <> 'NO COUNTRY' then 'x' end), '') as "{i}th_best_country", max(case when number = {i} then printf('%.2f%%', country_score * 100) end) as "{i}th_best_country_confidence", max(case when number = {i} then country end) as "{i}th_best_country_resolved_code", coalesce(max(case when number = {i} and town <> 'NO TOWN' then 'x' end), '') as "{i}th_best_town", max(case when number = {i} then printf('%.2f%%', town_score * 100) end) as "{i}th_best_town_confidence", max(case when number = {i} then town end) as "{i}th_best_town_resolved\"""" for i in (1, 2)).replace("max(case when number = 2 then printf('%.2f%%', country_score * 100) end)", "coalesce(max(case when number = 2 then printf('%.2f%%', country_score * 100) end), '')").replace("max(case when number = 2 then country end)", "coalesce(max(case when number = 2 then country end), '')").replace("max(case when number = 2 then printf('%.2f%%', town_score * 100) end)", "coalesce(max(case when number = 2 then printf('%.2f%%', town_score * 100) end), '')").replace("max(case when number = 2 then town end)", "coalesce(max(case when number = 2 then town end), '')")


@query(f"with {_COMBOS} select h.addr_id, c_name as address, h.suggested as suggested_country, h.force::varchar as force_suggested_country, {_SHOWN} from h join customer on c_custkey = h.addr_id join combos using (addr_id) group by all")
def readable_table(s, d):
    h = _hinted(s, d)
    return sinks.readable(resolve.combinations(*_lists(s, d), h), h)


# ---------------------------------------------------------------- sequence model

_T = [[0.5, 0.1, -0.3, 0.0], [0.0, 0.4, 0.2, -0.5], [-0.1, 0.3, 0.6, 0.0], [0.2, -0.2, 0.1, 0.3]]
_START, _END = [0.1, 0.0, -0.1, 0.2], [0.0, 0.1, 0.0, -0.2]


def crf_sql() -> str:
    """CTEs ``path`` (vec_id, path: list of states) and ``post`` (vec_id, pos, p: list of marginals) of the fixed CRF over 16 positions of four scores."""
    r = range(4)
    e = lambda k, pos="n.pos + 1": f"(e.embedding[({pos}) * 4 + {k + 1}]::double * 5)"
    step = ", ".join(f"list_max([{', '.join(f'n.s[{i + 1}] + {_T[i][j]}' for i in r)}]) + {e(j)}" for j in r)
    best = lambda x: f"list_position({x}, list_max({x}))"
    back = ", ".join("list_append(n.h[" + best(f"[{', '.join(f'n.s[{i + 1}] + {_T[i][j]}' for i in r)}]") + f"], {j})" for j in r)
    total = f"[{', '.join(f's[{j + 1}] + {_END[j]}' for j in r)}]"
    lse = lambda xs: f"(list_max([{xs}]) + ln(list_sum([exp(x - list_max([{xs}])) for x in [{xs}]])))"
    fore = ", ".join(lse(", ".join(f"n.s[{i + 1}] + {_T[i][j]}" for i in r)) + f" + {e(j)}" for j in r)
    aft = ", ".join(lse(", ".join(f"n.s[{j + 1}] + {_T[i][j]} + {e(j, 'n.pos')}" for j in r)) for i in r)
    return f"""vit as (select vec_id, 0 as pos, [{', '.join(f"{_START[j]} + {e(j, '0')}" for j in r)}] as s, [{', '.join(f'[{j}]' for j in r)}] as h from embeddings e
 union all select n.vec_id, n.pos + 1, [{step}], [{back}] from vit n join embeddings e using (vec_id) where n.pos < 15),
path as (select vec_id, h[{best(total)}] as path from vit where pos = 15),
fw as (select vec_id, 0 as pos, [{', '.join(f"{_START[j]} + {e(j, '0')}" for j in r)}] as s from embeddings e union all select n.vec_id, n.pos + 1, [{fore}] from fw n join embeddings e using (vec_id) where n.pos < 15),
bw as (select vec_id, 15 as pos, [{', '.join(f'{x}::double' for x in _END)}] as s from embeddings union all select n.vec_id, n.pos - 1, [{aft}] from bw n join embeddings e using (vec_id) where n.pos > 0),
z as (select vec_id, {lse(', '.join(f's[{j + 1}] + {_END[j]}' for j in r))} as z from fw where pos = 15),
post as (select vec_id, pos, [{', '.join(f'exp(fw.s[{j + 1}] + bw.s[{j + 1}] - z)' for j in r)}] as p from fw join bw using (vec_id, pos) join z using (vec_id))"""


def _emissions(s, d):
    return table(s, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, 4), lambda v: v.cast("double") * 5)).alias("emissions"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 10).alias("country_logits"))


@query(f"with recursive {crf_sql()} select vec_id, array_to_string(path, ',') as path, array_to_string([round(x, 4) for x in c], ',') as confidence from path join (select vec_id, list(p[path[pos + 1] + 1] order by pos) as c from post join path using (vec_id) group by vec_id) using (vec_id)".replace("array_to_string([round(x, 4) for x in c], ',') as confidence", "[round(x, 6) for x in c] as confidence"))
def crf_decode(s, d):
    """Paths and the marginals of each position's tag."""
    got = seqmodel.crf_apply(_emissions(s, d).select("vec_id", "emissions"), seqmodel.Crf(_START, _END, _T))
    best = F.zip_with("marginals", "path", lambda m, t: F.round(F.get(m, t), 6))
    return got.select("vec_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), best.alias("confidence"))


_STATES = [("OTHER", "OTHER"), ("B", "TOWN"), ("I", "TOWN"), ("B", "COUNTRY")]


@query(f"""with recursive {crf_sql()}, u as (select vec_id, generate_subscripts(path, 1) - 1 as pos, unnest(path) as st from path),
v as (select *, coalesce(max(case when st <> 2 then pos end) over (partition by vec_id order by pos rows between unbounded preceding and 1 preceding), -1) as prior from u),
x as (select v.vec_id, v.pos, v.st, case v.st when 1 then 'TOWN' when 3 then 'COUNTRY' when 2 then case when q.st = 1 then 'TOWN' else 'OTHER' end else 'OTHER' end as tag from v left join u q on q.vec_id = v.vec_id and q.pos = v.prior),
y as (select *, case when st in (1, 3) or lag(tag) over w is null or lag(tag) over w <> tag then 1 else 0 end as fresh from x window w as (partition by vec_id order by pos)),
g as (select *, sum(fresh) over (partition by vec_id order by pos) as isle from y)
select g.vec_id, min(pos)::int as start, (max(pos) + 1)::int as stop, min(tag) as tag, round(avg(case tag when 'TOWN' then p[2] + p[3] when 'COUNTRY' then p[4] else p[1] end), 6) as confidence from g join post using (vec_id, pos) group by g.vec_id, isle""")
def model_spans(s, d):
    """The whole model path: recorded emissions, CRF, strict spans and their confidences."""
    rows = _emissions(s, d).withColumnRenamed("vec_id", "addr_id")
    runner = tagging.ModelRunner(seqmodel.EmissionProvider(table=rows), seqmodel.Crf(_START, _END, _T), _STATES, ["DE", "FR", "US"])
    addresses, _ = runner.tag(rows.select("addr_id", F.lit("ABCDEFGHIJKLMNOP").alias("text")))
    got = addresses.select(F.col("addr_id").alias("vec_id"), F.explode("predictions").alias("p"))
    return got.select("vec_id", "p.start", "p.stop", "p.tag", F.round("p.confidence", 6).alias("confidence"))


@query(f"""with recursive {crf_sql()}, has as (select vec_id, list_has_any(path, [3]) as c from path)
select vec_id, round(list_sum([case when c then x else 0 end for x in l]), 5) as country_sum from (select vec_id, list(p[4] order by pos) as l from post group by vec_id) join has using (vec_id)""")
def tag_series(s, d):
    """A tag's series of marginals, zeros where the decoded path lacks the tag."""
    got = seqmodel.crf_apply(_emissions(s, d).select("vec_id", "emissions"), seqmodel.Crf(_START, _END, _T))
    tags = F.transform("path", lambda t: F.when(t == 3, "COUNTRY").otherwise("OTHER"))
    series = seqmodel.tag_probabilities(seqmodel.tag_series(F.col("marginals"), [3]), "COUNTRY", tags)
    return got.select("vec_id", F.round(F.aggregate(series, F.lit(0.0), lambda a, v: a + v), 5).alias("country_sum"))


@query("select p_partkey, array_to_string([case when strpos('abcdefghijklm ', c) > 0 then c else '<UNKNOWN>' end for c in string_split(substring(p_name, 1, 12), '')], '') || repeat('<PAD>', greatest(0, 12 - length(p_name))::int) as shown from part")
def char_decode(s, d):
    ids, _ = seqmodel.char_tokens(F.col("p_name"), list("abcdefghijklm "), 12)
    return table(s, d, "part").select("p_partkey", seqmodel.char_decode(ids, list("abcdefghijklm ")).alias("shown"))


# ---------------------------------------------------------------- cascade, filling, evaluation


def _structure(country, town):
    return F.struct(F.lit("x").alias("address_line"), country.alias("country"), town.alias("town"), F.lit("").alias("postal_code"), F.lit("").alias("street"), F.lit(0.96).alias("country_confidence"), F.lit(0.97).alias("town_confidence"))


def _cascade(s, d, embed):
    k = F.col("vec_id")
    e = table(s, d, "embeddings")
    source = F.get(F.array(*[F.lit(x) for x in S.SOURCES]), (k % 4).cast("int"))
    cache = e.where(k % 3 == 0).select(F.concat(F.lit("ENTRY "), k).alias("normalized_address"), F.col("embedding").cast("array<double>").alias("embedding"), source.alias("source"), _structure(F.lit("DE"), F.lit("BERLIN")).alias("structured"))
    # the stated query set of a search: ids divisible by 20
    requests = e.where(k % 20 == 0).select(k.alias("item"), F.concat(F.lit("entry  "), k).alias("text"))
    vectors = e.select(F.concat(F.lit("ENTRY "), k).alias("key"), F.when(k % 100 != 0, F.col("embedding").cast("array<double>")).alias("embedding"))
    resolver = lambda rows: rows.select("addr_id", _structure(F.lit("FR"), F.lit("")).alias("m")).select("addr_id", "m.*")
    return C.convert(requests, cache, resolver, services.table_embedder(vectors) if embed else None, S.Limits(semantic=0.3, lexical=0.5))


_CASCADE = f"""r as (select vec_id as item, 'ENTRY ' || vec_id as key, embedding from embeddings where vec_id % 20 = 0),
c as (select vec_id, 'ENTRY ' || vec_id as key, embedding, ['human_verified', 'crf_pipeline', 'sonnet_seed', 'llm_assisted'][vec_id % 4 + 1] as source from embeddings where vec_id % 3 = 0),
x as (select r.*, c.source as exact, c.source in ('human_verified', 'crf_pipeline') as ok from r left join c using (key)),
k as (select x.item, x.key, c.key as entry, c.source, list_cosine_similarity(x.embedding::double[], c.embedding::double[]) as sem, row_number() over (partition by x.item order by list_cosine_similarity(x.embedding::double[], c.embedding::double[]) desc, c.key) as rank from x, c where not coalesce(ok, false) and item % 100 <> 0 qualify rank <= 5),
j as (select *, {X.lexical_identity_sql('key', 'entry')} as lex from k), w as (select *, case when sem < 0.3 then 'semantic_gate_failed' when lex < 0.5 then 'lexical_gate_failed' when source in ('sonnet_seed', 'llm_assisted') then 'untrusted_cache_source' end as why from j),
b as (select item, count(*) filter (why is null) > 0 as served, coalesce(arg_min(source, rank) filter (why is null), arg_max(source, rank)) as source, coalesce(arg_min(sem, rank) filter (why is null), arg_max(sem, rank)) as sem, coalesce(arg_min(lex, rank) filter (why is null), arg_max(lex, rank)) as lex, arg_max(why, rank) as why from w group by item)"""


@query(f"""with {_CASCADE} select x.item, case when coalesce(ok, false) or coalesce(served, false) then 'stage1_cache' else 'stage2_pipeline' end as served_by, case when coalesce(ok, false) then exact when served then b.source else 'crf_pipeline' end as cache_source, round(sem, 5) as semantic_score, round(case when coalesce(ok, false) then 1.0 else lex end, 6) as lexical_score,
case when coalesce(ok, false) or coalesce(served, false) then null when b.item is null then 'embedding_error' else why end as fallback_reason, case when coalesce(ok, false) or coalesce(served, false) then 'resolved' else 'partial' end as resolution_status from x left join b using (item)""")
def cascade_items(s, d):
    items, _ = _cascade(s, d, True)
    return items.select("item", "served_by", "cache_source", F.round("semantic_score", 5).alias("semantic_score"), F.round("lexical_score", 6).alias("lexical_score"), "fallback_reason", "resolution_status")


@query(f"with {_CASCADE} select 'ENTRY ' || x.item as normalized_address, 'entry  ' || x.item as raw_address, 'crf_pipeline' as source, 'FR' as country_code from x left join b using (item) where not coalesce(ok, false) and not coalesce(served, false) and b.item is not null")
def cascade_write_back(s, d):
    """Misses go back to the cache only where there is an embedding."""
    return _cascade(s, d, True)[1].select("normalized_address", "raw_address", "source", "country_code")


@query("select vec_id as item, case when vec_id % 3 = 0 and vec_id % 4 < 2 then 'stage1_cache' else 'stage2_pipeline' end as served_by, case when vec_id % 3 <> 0 then 'cache_miss' when vec_id % 4 >= 2 then 'untrusted_cache_source' end as fallback_reason, case when vec_id % 3 = 0 then 1.0::double end as lexical_score from embeddings where vec_id % 20 = 0")
def cascade_without_embedder(s, d):
    return _cascade(s, d, False)[0].select("item", "served_by", "fallback_reason", "lexical_score")


@query(f"""with {_QUALITY}, x as (select *, band = 'high' as high, doc_id % 2 = 0 as asked, doc_id % 4 = 0 as good from assessed)
select doc_id, case when high or (asked and good) then 'cache' else 'review' end as action, case when high then 'crf_pipeline' when asked and good then 'llm_assisted' end as source, case when not high and not (asked and good) then case when asked then 'judge_unresolved' when country = '' then 'missing_country' when town = '' then 'missing_town' when c < 0.85 or t < 0.85 then 'low_confidence' else reason end end as review,
case when not high and asked and good then 'FR' else country end as country, (case when not high and asked and good then 0.7 else c end)::double as country_confidence from x""")
def judged_decisions(s, d):
    """Decisions of a judge: valid ones are cached, others reviewed, and rows it wasn't asked about follow the rules."""
    rows = _assessed(s, d).withColumnRenamed("doc_id", "addr_id")
    k = F.col("addr_id")
    said = s.createDataFrame([("FR", 0.7)], "code string, score double").select(F.array(F.struct("code", "score")).alias("countries"), F.array(F.struct(F.lit("Paris").alias("name"), F.lit("fr").alias("country_code"), F.lit(0.6).alias("score"))).alias("towns"))
    decisions = rows.where(k % 2 == 0).select("addr_id", F.lit(True).alias("resolved"), F.lit(" fr").alias("judge_country"), F.when(k % 4 == 0, "PARIS").otherwise("LYON").alias("judge_town")).crossJoin(F.broadcast(said))
    return L.decide(rows, decisions).select(F.col("addr_id").alias("doc_id"), "action", "source", "review", "country", "country_confidence")


@query(f"""with {_PLAN}, placed as (select *, row_number() over (partition by country, town order by id) - 1 as off from lab), s as (select distinct placed.id, plan.stratum from placed join plan using (country, town, off)),
k as (select stratum, id % 5 <> 0 as c, id % 4 <> 0 as t from s)
select stratum, count(*) as total, count(*) filter (c) as country_correct, count(*) filter (t) as town_correct, count(*) filter (c and t) as both_correct, round(count(*) filter (c) / count(*), 6) as country_rate, round(count(*) filter (t) / count(*), 6) as town_rate, round(count(*) filter (c and t) / count(*), 6) as both_rate from k group by grouping sets ((stratum), ())""")
def evaluate_sample(s, d):
    """The evaluator around a resolver that errs on some ids."""
    labelled = _labelled(s, d)
    known = labelled.select(F.col("id").alias("addr_id"), F.when(F.col("id") % 5 == 0, "XX").otherwise(F.upper("country")).alias("country"), F.when(F.col("id") % 4 == 0, "").otherwise(F.replace("town", F.lit(" "), F.lit("-"))).alias("town"))
    return services.evaluate(labelled, lambda rows: rows.select("addr_id").join(known, "addr_id"), limit=100)["accuracy"]

