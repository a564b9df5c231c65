"""All queries of the address engine over the driver's tables, with their DuckDB equivalents.

The tables hold no addresses, so inputs are derived from them by expressions that both engines share:
regions stand for countries, nations for towns, customers for addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import score as K
from ..functions import text as X
from ..operators import cache as C
from ..operators import evaluate as V
from ..operators import fill as L
from ..operators import fuzzy, postcode, resolve, seqmodel
from ..operators import gazetteer as G
from ..sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- text


@query(f"select doc_id, md5({X.clean_sql('text')}) as cleaned from documents")
def clean_text(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("cleaned"))


@query(f"select doc_id, md5({X.normalize_address_sql('text')}) as key from documents")
def normalize_address(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(X.normalize_address(F.col("text"))).alias("key"))


@query(r"""
with n as (select distinct 'MONT-SAINT-' || upper(replace(p_name, ' ', '-')) as name from part union select distinct upper(p_name) from part),
s as (select name, unnest(case when regexp_matches(name, '\b(?:SAINT|ST\.|ST)(?:[^\s\w]|\s)') then [name, regexp_replace(name, '\b(?:SAINT|ST\.|ST)(?:[^\s\w]|\s)', 'SAINT-', 'g'), regexp_replace(name, '\b(?:SAINT|ST\.|ST)(?:[^\s\w]|\s)', 'ST. ', 'g'), regexp_replace(name, '\b(?:SAINT|ST\.|ST)(?:[^\s\w]|\s)', 'ST-', 'g')] else [name] end) as a from n)
select distinct name, unnest([name, a, replace(a, '-', ' '), replace(a, ' ', '-')]) as alias from s""")
def alias_expand(s, d):
    names = table(s, d, "part").select(F.upper("p_name").alias("n")).distinct()
    names = names.select(F.concat(F.lit("MONT-SAINT-"), F.replace("n", F.lit(" "), F.lit("-"))).alias("name")).union(names).distinct()
    return names.select("name", F.explode(X.aliases(F.col("name"))).alias("alias"))


_PAIRS = "with n as (select distinct upper(p_name) as p from part) select a.p as left_name, b.p as right_name, round({0}, 6) as value from n a join n b on a.p < b.p and split_part(a.p, ' ', 1) = split_part(b.p, ' ', 1)"


def _name_pairs(s, d):
    # names that share their first word: an equi-join, not all pairs
    n = table(s, d, "part").select(F.upper("p_name").alias("p")).distinct().withColumn("w", F.split_part("p", F.lit(" "), F.lit(1)))
    return n.alias("a").join(n.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.p") < F.col("b.p"))).select(F.col("a.p").alias("left_name"), F.col("b.p").alias("right_name"))


@query(_PAIRS.format(X.lexical_identity_sql("a.p", "b.p")))
def lexical_identity(s, d):
    return _name_pairs(s, d).withColumn("value", F.round(X.lexical_identity(F.col("left_name"), F.col("right_name")), 6))


@query(_PAIRS.format(X.trigram_jaccard_sql("a.p", "b.p")))
def trigram_jaccard(s, d):
    return _name_pairs(s, d).withColumn("value", F.round(X.trigram_jaccard(F.col("left_name"), F.col("right_name")), 6))


@query(r"""select c_custkey, unnest(regexp_extract_all('PAY TO DE' || lpad(c_custkey::varchar, 2, '4') || ' AB12 CD34 EF56 OR GB11ABCD' || lpad(c_nationkey::varchar, 4, '0'), '([A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){1,7})', 1)) as iban from customer""")
def iban_extract(s, d):
    text = F.concat(F.lit("PAY TO DE"), F.lpad(F.col("c_custkey").cast("string"), 2, "4"), F.lit(" AB12 CD34 EF56 OR GB11ABCD"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))
    return table(s, d, "customer").select("c_custkey", F.explode(X.ibans(text)).alias("iban"))


@query("select doc_id, md5(array_to_string(regexp_extract_all(lower(" + X.transliterate_sql("text") + r"), '([a-z0-9]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e])', 1), ' ')) as tokens from documents")
def basic_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.array_join(X.basic_tokens(F.col("text")), " ")).alias("tokens"))


@query(r"""select c_custkey, array_to_string([x for x in [case when c_custkey < 100 then '' else c_custkey::varchar || ' ' || c_mktsegment end, case when c_nationkey < 5 then 'NIL' else 'UNIT ' || c_nationkey end, lpad(c_nationkey::varchar, 5, '0') || ' Town', case when c_nationkey > 20 then 'Unit ' || c_nationkey else 'D' end, 'n/a'] if x <> '' and lower(trim(x)) not in ('nil', 'null', 'none', 'n/a', 'na') and not (x = 'Unit ' || c_nationkey and c_nationkey > 20)], chr(10)) as text from customer""")
def openaddresses_text(s, d):
    num = F.when(F.col("c_custkey") >= 100, F.col("c_custkey"))
    props = F.struct(num.alias("NUMBER"), F.when(F.col("c_custkey") >= 100, F.col("c_mktsegment")).alias("street"), F.when(F.col("c_nationkey") < 5, "NIL").otherwise(F.concat(F.lit("UNIT "), F.col("c_nationkey"))).alias("Unit"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("postcode"), F.lit("Town").alias("city"), F.when(F.col("c_nationkey") > 20, F.concat(F.lit("Unit "), F.col("c_nationkey"))).otherwise("D").alias("district"), F.lit("n/a").alias("region"), F.lit(True).alias("flag"))
    lines = table(s, d, "customer").select("c_custkey", F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"))).alias("value"))
    return readers.features(lines).select("c_custkey", "text")


# ---------------------------------------------------------------- gazetteer

_TOWNS = "towns as (select n_name as name, 'R' || n_regionkey as country, n_nationkey as ord, 1000 * (select count(*) from customer where c_nationkey = n_nationkey) as population from nation union all select 'CITY ' || (n_nationkey // 5), 'R' || n_regionkey, 100 + n_nationkey, 1000 * (n_nationkey // 2) from nation)"


def _towns(s, d):
    n = table(s, d, "nation")
    people = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((1000 * F.count(F.lit(1))).alias("population"))
    own = n.join(people, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("country"), F.col("n_nationkey").alias("ord"), F.coalesce("population", F.lit(0)).alias("population"))
    city = n.select(F.concat(F.lit("CITY "), F.floor(F.col("n_nationkey") / 5)).alias("name"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("country"), (100 + F.col("n_nationkey")).alias("ord"), (1000 * F.floor(F.col("n_nationkey") / 2)).alias("population"))
    return own.unionByName(city)


_ALIASES = "aliased as (select distinct unnest([name, replace(name, '-', ' '), replace(name, ' ', '-')]) as alias, country, population, ord from towns)"


@query(f"with {_TOWNS}, {_ALIASES} select alias, max(population)::bigint as population, first(country order by population desc, ord) as largest from aliased where population > 0 group by alias")
def population_argmax(s, d):
    return G.town_index(_towns(s, d))


@query(f"with {_TOWNS}, {_ALIASES} select alias, array_to_string(list_sort(list(distinct country)), ',') as origins from aliased group by alias")
def alias_origins(s, d):
    return G.town_origins(_towns(s, d)).select("alias", F.array_join("origins", ",").alias("origins"))


def _reference(s, d) -> G.ReferenceData:
    countries = table(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("origin"), F.col("r_name").alias("name"))
    return G.ReferenceData.build(countries, _towns(s, d))


# ---------------------------------------------------------------- fuzzy join

_WINDOWS = """
texts as (select p_partkey as addr_id, upper(replace(p_name, 'e', '3')) as text from part),
words as (select distinct upper(unnest(string_split(p_name, ' '))) as possibility from part),
wins as (select addr_id, text, s as start, w as width, substring(text, s + 1, w) as matched from texts, range(0, 40) r(s), range(1, 14) q(w) where s + w <= length(text)),
found as (select addr_id, possibility, start::int as start, (start + width)::int as stop, matched, levenshtein(matched, possibility)::int as dist from wins, words where abs(width - length(possibility)) <= 1 and levenshtein(matched, possibility) <= case when length(possibility) <= 2 then 0 else 1 end)"""


def _typo_texts(s, d):
    p = table(s, d, "part")
    texts = p.select(F.col("p_partkey").alias("addr_id"), F.upper(F.replace("p_name", F.lit("e"), F.lit("3"))).alias("text"))
    words = p.select(F.explode(F.split(F.upper("p_name"), " ")).alias("possibility")).distinct().select("possibility", F.array(F.lit("W")).alias("origins"))
    return texts, words


@query(f"with {_WINDOWS} select * from found")
def fuzzy_windows(s, d):
    texts, words = _typo_texts(s, d)
    return fuzzy.windows(texts, fuzzy.candidates(words), 1).select("addr_id", "possibility", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "matched", F.col("dist").cast("int").alias("dist"))


@query(f"""with recursive {_WINDOWS},
open as (select addr_id, possibility from found group by 1, 2 having max(case when dist = 0 then 100 else floor(100 * (greatest(length(possibility), length(matched)) - dist) / greatest(length(possibility), length(matched))) end) >= 80),
cand as (select f.*, row_number() over (partition by addr_id, possibility order by dist, start, stop) as n from found f join open using (addr_id, possibility)),
pick as (select addr_id, possibility, n, [struct_pack(a := start, b := stop)] as taken, true as kept from cand where n = 1
 union all select c.addr_id, c.possibility, c.n, case when len([t for t in p.taken if t.a < c.stop and c.start < t.b]) = 0 then list_append(p.taken, struct_pack(a := c.start, b := c.stop)) else p.taken end, len([t for t in p.taken if t.a < c.stop and c.start < t.b]) = 0 from pick p join cand c on c.addr_id = p.addr_id and c.possibility = p.possibility and c.n = p.n + 1)
select c.addr_id, c.start, c.stop, c.matched, c.possibility, c.dist, not ((start = 0 or not regexp_matches(substring(t.text, start, 1), '[A-Za-z0-9_]')) and (stop = length(t.text) or not regexp_matches(substring(t.text, stop + 1, 1), '[A-Za-z0-9_]'))) as inside, 'W' as origin
from cand c join pick p using (addr_id, possibility, n) join texts t using (addr_id) where p.kept""")
def fuzzy_typo(s, d):
    got = fuzzy.match_dictionary(*_typo_texts(s, d))
    return got.select("addr_id", "start", "stop", "matched", "possibility", "dist", F.array_contains("flags", "IS_INSIDE_ANOTHER_WORD").alias("inside"), "origin")


@query("""with texts as (select c_custkey as addr_id, upper(c_name || chr(10) || n_name) as text from customer join nation on c_nationkey = n_nationkey),
wins as (select addr_id, text, n_name as possibility, s::int as start, (s + length(n_name))::int as stop from texts, nation, range(0, 60) r(s) where substring(text, s + 1, length(n_name)) = n_name)
select addr_id, start, stop, possibility, not (regexp_matches(substring(text, start, 1) || ' ', '^[^A-Za-z0-9_]') and regexp_matches(substring(text, stop + 1, 1) || ' ', '^[^A-Za-z0-9_]')) as inside from wins""")
def word_boundary_flags(s, d):
    texts = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("addr_id"), F.upper(F.concat_ws("\n", "c_name", "n_name")).alias("text"))
    names = table(s, d, "nation").select(F.col("n_name").alias("possibility"), F.array(F.lit("N")).alias("origins"))
    got = fuzzy.match_dictionary(texts, names, tolerance=0)
    return got.select("addr_id", "start", "stop", "possibility", F.array_contains("flags", "IS_INSIDE_ANOTHER_WORD").alias("inside"))


@query("""select c_custkey as addr_id, 7 as start, 12 as stop, lpad((n_nationkey * 137)::varchar, 5, '0') as matched, n_name as possibility, 'R' || n_regionkey as origin from customer join nation on c_nationkey = n_nationkey""")
def postcode_extract(s, d):
    n = table(s, d, "nation").withColumn("code", F.lpad((F.col("n_nationkey") * 137).cast("string"), 5, "0"))
    texts = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("addr_id"), F.concat(F.lit("STREET "), F.col("code"), F.lit(" "), F.col("n_name"), F.lit(" X12345")).alias("text"))
    codes = n.select(F.concat(F.lit("R"), F.col("n_regionkey")).alias("origin"), "code", F.col("n_name").alias("town"), F.lit("[0-9]{5}").alias("regex"), F.lit("").alias("suffix"))
    return postcode.match_postcodes(texts, codes)


# ---------------------------------------------------------------- sequence model

_LETTERS = "abcdefghijklmnopqrstuvwxy "


@query(f"select p_partkey, array_to_string(list_concat([case when strpos('{_LETTERS}', c) = 0 then 0 else strpos('{_LETTERS}', c) + 1 end for c in string_split(substring(p_name, 1, 12), '')], [1 for x in range(0, greatest(0, 12 - length(p_name)))]), ',') as ids, least(length(p_name), 12)::int as valid from part")
def char_tokenize(s, d):
    ids, mask = seqmodel.char_tokens(F.col("p_name"), list(_LETTERS), 12)
    return table(s, d, "part").select("p_partkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.size(F.filter(mask, lambda m: m)).alias("valid"))


@query("""with p as (select vec_id, [exp(v::double * 20 - list_max(embedding)::double * 20) for v in embedding] as e from embeddings)
select vec_id, 'C' || (list_position(e, list_max(e)) - 1) as country, round(list_max(e) / list_sum(e), 6) as confidence from p""")
def softmax_argmax(s, d):
    head = seqmodel.country_head(F.transform("embedding", lambda v: v.cast("double") * 20), [f"C{i}" for i in range(64)])
    return table(s, d, "embeddings").select("vec_id", head.alias("h")).select("vec_id", "h.country", F.round("h.confidence", 6).alias("confidence"))


@query("select vec_id, round(list_avg([v::double for v in embedding[(vec_id % 10 + 1):(vec_id % 10 + 5)]]), 6) as value from embeddings")
def span_mean(s, d):
    start = F.col("vec_id") % 10
    return table(s, d, "embeddings").select("vec_id", F.round(seqmodel.span_mean(F.col("embedding"), start, start + 5), 6).alias("value"))


_BIO = "t as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, case when event_type = 'error' then 'OTHER' when value < 20 then 'B' else 'I' end as bio, case when event_type = 'error' then 'OTHER' when event_type in ('view', 'click', 'signup') then 'STREET' else 'TOWN' end as tag from events)"


def _bio(s, d, strict):
    e = table(s, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "OTHER").when(F.col("value") < 20, "B").otherwise("I").alias("bio"), F.when(F.col("event_type").isin("view", "click", "signup"), "STREET").otherwise("TOWN").alias("tag"))
    got = seqmodel.bio_spans(e, ["user_id"], ["ts", "event_id"], strict)
    return got.select("user_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "tag")


@query(f"with {_BIO}, u as (select *, coalesce(lag(tag) over w <> tag, true) as fresh from t window w as (partition by user_id order by pos)), v as (select *, sum(fresh::int) over (partition by user_id order by pos) as g from u) select user_id, min(pos)::bigint as start, (max(pos) + 1)::bigint as stop, min(tag) as tag from v group by user_id, g")
def bio_spans_loose(s, d):
    return _bio(s, d, False)


@query(f"""with {_BIO}, u as (select *, (bio in ('B', 'OTHER') or coalesce(lag(tag) over w <> tag, true)) as edge from t window w as (partition by user_id order by pos)),
v as (select *, sum(edge::int) over (partition by user_id order by pos) as run from u), x as (select *, case when first_value(bio) over (partition by user_id, run order by pos) = 'B' then tag else 'OTHER' end as kept from v),
y as (select *, (bio = 'B' or coalesce(lag(kept) over (partition by user_id order by pos) <> kept, true)) as fresh from x), z as (select *, sum(fresh::int) over (partition by user_id order by pos) as g from y)
select user_id, min(pos)::bigint as start, (max(pos) + 1)::bigint as stop, min(kept) as tag from z group by user_id, g""")
def bio_spans_strict(s, d):
    return _bio(s, d, True)


# ---------------------------------------------------------------- scores, flags, combinations

_FLAGS = {"town": ("IS_SHORT", "IS_SMALL_TOWN", "COUNTRY_IS_PRESENT", "IS_INSIDE_ANOTHER_WORD", "IS_SEPARATOR_TYPO", "IS_ALONE_ON_LINE", "POSTCODE_FOR_TOWN_FOUND"), "country": ("IS_SHORT", "MLP_AGREES", "TOWN_IS_PRESENT", "IS_INSIDE_ANOTHER_WORD", "IS_SEPARATOR_TYPO", "IBAN_IS_PRESENT", "GENERATED_BY_SUGGESTED_COUNTRY")}


def _flags_sql(side):
    return "[x for x in [" + ", ".join(f"case when (c_custkey // {2**i}) % 2 = 1 then '{f}' end" for i, f in enumerate(_FLAGS[side])) + "] if x is not null]"


def _scored(s, d, side):
    flags = F.array_compact(F.array(*[F.when(F.floor(F.col("c_custkey") / 2**i) % 2 == 1, f) for i, f in enumerate(_FLAGS[side])]))
    rows = table(s, d, "customer").select("c_custkey", flags.alias("flags"), (F.col("c_nationkey") % 3).alias("dist"), ((F.col("c_custkey") * 37 % 101) / 100).alias("crf"))
    return rows.select("c_custkey", F.round(K.match_score(side, F.col("flags"), F.col("dist"), F.col("crf")), 6).alias("score"))


def _scored_sql(side):
    return f"with r as (select c_custkey, {_flags_sql(side)} as flags, c_nationkey % 3 as dist, (c_custkey * 37 % 101) / 100 as crf from customer) select c_custkey, round({K.match_score_sql(side, 'flags', 'dist', 'crf')}, 6) as score from r"


@query(_scored_sql("town"))
def match_score_town(s, d):
    return _scored(s, d, "town")


@query(_scored_sql("country"))
def match_score_country(s, d):
    return _scored(s, d, "country")


_SPANS = "m as (select o_custkey as addr_id, o_orderkey as id, (o_orderkey * 7 % 40)::int as start, (o_orderkey * 7 % 40 + 1 + o_orderkey * 3 % 9)::int as stop, (o_orderkey % 2)::int as dist, (o_orderkey * 13 % 100) / 100 as crf from orders)"


def _span_matches(s, d):
    k = F.col("o_orderkey")
    start = (k * 7 % 40).cast("int")
    return table(s, d, "orders").select(F.col("o_custkey").alias("addr_id"), F.lit(0).alias("kind"), start.alias("start"), (start + 1 + k * 3 % 9).cast("int").alias("stop"), F.lit("x").alias("matched"), F.lpad(k.cast("string"), 12, "0").alias("possibility"), (k % 2).cast("int").alias("dist"), F.array().cast("array<string>").alias("flags"), F.concat(F.lit("R"), k % 5).alias("origin"), (k * 13 % 100 / 100).alias("crf"), k.alias("id"))


@query(f"""with {_SPANS}, r as (select *, row_number() over (partition by addr_id order by dist, crf desc, id) as rank from m),
o as (select a.id, bool_or(b.rank >= a.rank and b.dist < 1) as low, bool_or(b.rank < a.rank) as high from r a join r b on a.addr_id = b.addr_id and ((b.start < a.start and b.stop >= a.stop) or (b.stop > a.stop and b.start <= a.start)) group by a.id)
select r.id, r.rank::int as rank, coalesce(low, false) as lower_ranked, coalesce(high, false) as higher_ranked, stop - start <= 2 as short, start <= 45 / 3.0 as first_third, start >= 2 * 45 / 3.0 as last_third from r left join o using (id)""")
def inclusion_flags(s, d):
    got = resolve.ranked(_span_matches(s, d).withColumn("length", F.lit(45)), False)
    h = lambda k: F.array_contains("flags", k)
    return got.select("id", "rank", h("IS_INSIDE_ANOTHER_LOWER_RANKED_MATCH").alias("lower_ranked"), h("IS_INSIDE_ANOTHER_HIGHER_RANKED_MATCH").alias("higher_ranked"), h("IS_SHORT").alias("short"), h("IS_IN_FIRST_THIRD").alias("first_third"), h("IS_IN_LAST_THIRD").alias("last_third"))


@query(f"""with {_SPANS} select id, (greatest(0, least(stop, 12) - greatest(start, 3)) + greatest(0, least(stop, 30) - greatest(start, 20))) / (stop - start) >= 0.5 as inside_street from m""")
def street_overlap(s, d):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(t).alias("tag")) for a, b, t in ((3, 12, "STREET"), (14, 18, "TOWN"), (20, 30, "STREET"))])
    return _span_matches(s, d).withColumn("spans", spans).select("id", resolve.street_overlap(F.col("spans")).alias("inside_street"))


def _lists(s, d):
    """Countries and towns of customers from their orders, with scores and places."""
    m = _span_matches(s, d).withColumn("score", F.round(0.15 + F.col("crf") * 0.85, 4)).withColumn("place", F.col("id"))
    return m.where("id % 3 = 0").withColumn("possibility", F.concat(F.lit("C"), F.col("id") % 7)), m.where("id % 3 <> 0").withColumn("possibility", F.concat(F.lit("T-"), F.col("id") % 11))


def _hinted(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("addr_id"), F.concat(F.lit("R"), F.col("c_nationkey") % 7).alias("suggested"), (F.col("c_nationkey") < 5).alias("force"), F.col("c_name").alias("text"))


_COMBOS = f"""{_SPANS}, l as (select m.*, 'R' || id % 5 as origin, round(0.15 + crf * 0.85, 4) as score from m),
h as (select c_custkey as addr_id, 'R' || c_nationkey % 7 as suggested, c_nationkey < 5 as force from customer),
c as (select l.*, 'C' || id % 7 as possibility from l join h using (addr_id) where id % 3 = 0 and (not force or origin = suggested)),
t as (select l.*, 'T-' || id % 11 as possibility, not force as solo from l join h using (addr_id) where id % 3 <> 0),
allc as (select c.addr_id, c.origin as country, c.possibility as country_possibility, t.possibility as town, t.origin as town_origin, c.score as country_score, t.score as town_score, (c.score + t.score) / 2 as score, 0 as phase, c.id as i, t.id as j from c join t on c.addr_id = t.addr_id and c.origin = t.origin
  where not (c.start = t.start and c.stop = t.stop) and not ((t.start > c.start and t.stop <= c.stop) or (t.start >= c.start and t.stop < c.stop)) and not ((c.start > t.start and c.stop <= t.stop) or (c.start >= t.start and c.stop < t.stop))
 union all select addr_id, origin, possibility, 'NO TOWN', '', score, 0.15, (score + 0.15) / 2, 1, id, 0 from c
 union all select addr_id, 'NO COUNTRY', '', possibility, origin, 0.15, score, (0.15 + score) / 2, 2, 0, id from t where solo),
full_ as (select * from allc union all select addr_id, 'NO COUNTRY', '', 'NO TOWN', '', 0.15, 0.15, 0.15, 3, 0, 0 from h where addr_id not in (select addr_id from allc)),
d as (select *, row_number() over (partition by addr_id, country, replace(town, '-', ' ') order by score desc, phase, i, j) as nth from full_),
combos as (select addr_id, country, country_possibility, town, town_origin, country_score, town_score, score, row_number() over (partition by addr_id order by score desc, phase, i, j)::int as number from d where nth = 1)"""


@query(f"with {_COMBOS} select addr_id, country, country_possibility, town, town_origin, round(score, 6) as score, number from combos")
def combinations(s, d):
    got = resolve.combinations(*_lists(s, d), _hinted(s, d))
    return got.select("addr_id", "country", "country_possibility", "town", "town_origin", F.round("score", 6).alias("score"), "number")


@query(f"""with {_COMBOS} select c_custkey as addr_id, c_name as address_line, coalesce((select country from combos where addr_id = c_custkey and country <> 'NO COUNTRY' order by number limit 1), '') as country, coalesce((select town from combos where addr_id = c_custkey and town <> 'NO TOWN' order by number limit 1), '') as town,
round(coalesce((select country_score from combos where addr_id = c_custkey and country <> 'NO COUNTRY' order by number limit 1), 0), 6) as country_confidence, round(coalesce((select town_score from combos where addr_id = c_custkey and town <> 'NO TOWN' order by number limit 1), 0), 6) as town_confidence from customer""")
def structured_top(s, d):
    h = _hinted(s, d)
    got = resolve.structured(resolve.combinations(*_lists(s, d), h), h)
    return got.select("addr_id", "address_line", "country", "town", F.round("country_confidence", 6).alias("country_confidence"), F.round("town_confidence", 6).alias("town_confidence"))


@query(f"with {_COMBOS} select addr_id, max(case when number = 1 then country end) as country_1, max(case when number = 1 then town end) as town_1, round(max(case when number = 1 then score end), 6) as score_1, max(case when number = 2 then country end) as country_2, max(case when number = 2 then town end) as town_2, round(max(case when number = 2 then score end), 6) as score_2 from combos group by addr_id")
def nbest_pivot(s, d):
    got = resolve.n_best(resolve.combinations(*_lists(s, d), _hinted(s, d)))
    return got.withColumns({f"score_{i}": F.round(f"score_{i}", 6) for i in (1, 2)})


_QUALITY = """q as (select doc_id, case when doc_id % 5 = 0 then '' else lang end as country, case when doc_id % 7 = 0 then '' else source end as town, (doc_id * 31 % 101) / 100 as c, (doc_id * 17 % 101) / 100 as t from documents),
a as (select *, least(c, t) as low, case when country <> '' then c else t end as one from q),
assessed as (select doc_id, country, town, c, t,
case when country <> '' and town <> '' and low >= 0.95 then 'resolved' when country <> '' and town <> '' then 'needs_review' when country <> '' or town <> '' then 'partial' else 'needs_review' end as status,
case when country <> '' and town <> '' then case when low >= 0.95 then 'high' when low >= 0.8 then 'medium' else 'low' end when (country <> '' or town <> '') and one >= 0.8 then 'medium' else 'low' end as band,
case when country <> '' and town <> '' then case when low >= 0.95 then 'high_confidence' when low >= 0.8 then 'confidence_below_high' else 'low_confidence' end when country <> '' then 'missing_town' else 'missing_country' end as reason from a)"""


def _assessed(s, d):
    k = F.col("doc_id")
    rows = table(s, d, "documents").select("doc_id", F.when(k % 5 == 0, "").otherwise(F.col("lang")).alias("country"), F.when(k % 7 == 0, "").otherwise(F.col("source")).alias("town"), (k * 31 % 101 / 100).alias("country_confidence"), (k * 17 % 101 / 100).alias("town_confidence"))
    return rows.withColumn("q", K.quality(F.col("country"), F.col("town"), F.col("country_confidence"), F.col("town_confidence"))).select("*", "q.*").drop("q")


@query(f"with {_QUALITY} select doc_id, status, band, reason from assessed")
def quality_bands(s, d):
    return _assessed(s, d).select("doc_id", "status", "band", "reason")


@query(f"with {_QUALITY} select doc_id, case when band = 'high' then 'cache' else 'review' end as action, case when band = 'high' then 'crf_pipeline' end as source, case when band <> 'high' then case when country = '' then 'missing_country' when town = '' then 'missing_town' when c < 0.85 or t < 0.85 then 'low_confidence' else reason end end as review from assessed")
def fill_decision(s, d):
    return L.decide(_assessed(s, d)).select("doc_id", "action", "source", "review")


@query(f"with {_QUALITY} select count(*) as processed, count(*) filter (band = 'high') as cached, count(*) filter (band <> 'high') as review, count(*) filter (band <> 'high') as skipped from assessed")
def fill_summary(s, d):
    return L.summary(L.decide(_assessed(s, d)))


@query("""select c_custkey, c_nationkey % 4 <> 0 and c_nationkey < 20 and c_nationkey % 3 <> 2 as valid from customer""")
def judge_validate(s, d):
    k = F.col("c_nationkey")
    countries = F.array(F.struct(F.lit("fr").alias("code")), F.struct(F.lit("DE").alias("code")))
    towns = F.array(F.struct(F.lit("Paris").alias("name"), F.lit("FR").alias("country_code")), F.struct(F.lit("BERLIN").alias("name"), F.lit("de").alias("country_code")))
    country = F.when(k >= 20, "").when(k % 3 == 0, "FR ").otherwise("de")
    town = F.when(k % 3 == 0, "paris").when(k % 3 == 1, " Berlin").otherwise("PARIS")
    return table(s, d, "customer").select("c_custkey", L.valid_decision(k % 4 != 0, country, town, countries, towns).alias("valid"))


# ---------------------------------------------------------------- cache


@query(f"""with k as (select doc_id, {X.normalize_address_sql('text')} as key from documents), c as (select key, min(doc_id) as entry from k group by key) select k.doc_id, c.entry, k.doc_id = c.entry as own from k left join c using (key)""")
def cache_exact_lookup(s, d):
    keys = table(s, d, "documents").select("doc_id", X.normalize_address(F.col("text")).alias("key"))
    cache = keys.groupBy(F.col("key").alias("normalized_address")).agg(F.min("doc_id").alias("entry"))
    return C.exact_lookup(keys, cache).select("doc_id", F.col("hit.entry").alias("entry"), (F.col("doc_id") == F.col("hit.entry")).alias("own"))


_KNN = "p as (select a.vec_id as query_id, b.vec_id as entry_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity from embeddings a, embeddings b where a.vec_id % 20 = 0), k as (select *, row_number() over (partition by query_id order by similarity desc, entry_id)::int as rank from p qualify rank <= 5)"


def _knn(s, d):
    # the stated query set of a search: ids divisible by 20, against all rows
    e = table(s, d, "embeddings")
    return C.nearest(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("entry_id"), "embedding"))


@query(f"with {_KNN} select query_id, entry_id, round(similarity, 5) as similarity, rank from k")
def cache_knn(s, d):
    return _knn(s, d).select("query_id", "entry_id", F.round("similarity", 5).alias("similarity"), "rank")


@query(f"""with {_KNN}, g as (select query_id as item, rank, similarity as semantic, (entry_id * 7 % 10) / 10 as lexical, ['human_verified', 'crf_pipeline', 'sonnet_seed', 'llm_assisted'][entry_id % 4 + 1] as source from k),
r as (select *, case when semantic < 0.3 then 'semantic_gate_failed' when lexical < 0.5 then 'lexical_gate_failed' when source in ('sonnet_seed', 'llm_assisted') then 'untrusted_cache_source' end as reason from g)
select item, coalesce(min(rank) filter (reason is null), max(rank)) as rank, coalesce(arg_min(source, rank) filter (reason is null), arg_max(source, rank)) as source, case when count(*) filter (reason is null) > 0 then null else arg_max(reason, rank) end as reason, count(*) filter (reason is null) > 0 as served from r group by item""")
def cascade_gates(s, d):
    e = F.col("entry_id")
    rows = _knn(s, d).select(F.col("query_id").alias("item"), "rank", F.col("similarity").alias("semantic"), (e * 7 % 10 / 10).alias("lexical"), F.get(F.array(*[F.lit(x) for x in S.SOURCES]), (e % 4).cast("int")).alias("source"))
    return C.gate(rows, S.Limits(semantic=0.3, lexical=0.5)).select("item", "rank", "source", "reason", "served")


@query("""with o as (select o_custkey::varchar as normalized_address, arg_min(o_orderkey, o_orderkey) as raw_address, case when min(o_orderkey) % 3 = 0 then 'human_verified' else 'crf_pipeline' end as source, 'old' as town from orders where o_orderstatus <> 'O' group by 1),
n as (select o_custkey::varchar as normalized_address, max(o_orderkey) as raw_address, case when max(o_orderkey) % 5 = 0 then 'human_verified' else 'llm_assisted' end as source, 'new' as town from orders where o_orderstatus <> 'F' group by 1)
select coalesce(n.normalized_address, o.normalized_address) as normalized_address, coalesce(n.raw_address, o.raw_address) as raw_address,
case when n.source is null or (o.source = 'human_verified' and n.source <> 'human_verified') then o.source else n.source end as source, case when n.source is null or (o.source = 'human_verified' and n.source <> 'human_verified') then o.town else n.town end as town from o full join n using (normalized_address)""")
def cache_upsert(s, d):
    o = table(s, d, "orders").withColumn("normalized_address", F.col("o_custkey").cast("string"))
    old = o.where("o_orderstatus <> 'O'").groupBy("normalized_address").agg(F.min("o_orderkey").alias("raw_address")).select("normalized_address", "raw_address", F.when(F.col("raw_address") % 3 == 0, "human_verified").otherwise("crf_pipeline").alias("source"), F.lit("old").alias("town"))
    new = o.where("o_orderstatus <> 'F'").select("normalized_address", F.col("o_orderkey").alias("raw_address"), F.when(F.col("o_orderkey") % 5 == 0, "human_verified").otherwise("llm_assisted").alias("source"), F.lit("new").alias("town"), F.col("o_orderkey").alias("ord"))
    return C.upsert(old, new)


# ---------------------------------------------------------------- evaluation

_LABELLED = "lab as (select o_orderkey as id, 'address ' || o_orderkey as address, 'Town ' || o_orderpriority as town, 'c' || c_nationkey as country from orders join customer on o_custkey = c_custkey)"
_GROUPS = f"{_LABELLED}, g as (select country, town, count(*) as n, upper(country) || ':' || case when count(*) >= 1000 then 'common' when count(*) >= 100 then 'medium' else 'rare' end as stratum from lab group by country, town)"
_PLAN = f"{_GROUPS}, st as (select stratum, count(*) as groups, row_number() over (order by stratum) as nth, count(*) over () as k from g group by stratum), al as (select stratum, groups, 100 // k + case when nth <= 100 % k then 1 else 0 end as draws from st), dr as (select stratum, groups, unnest(range(1, draws + 1)) as draw from al), pk as (select *, ('0x' || substring(md5('42/group/' || stratum || '/' || draw), 1, 12))::bigint as hg, ('0x' || substring(md5('42/row/' || stratum || '/' || draw), 1, 12))::bigint as h from dr), nb as (select *, row_number() over (partition by stratum order by country, town) - 1 as gi from g), plan as (select pk.stratum, draw, nb.country, nb.town, h % n as off from pk join nb on pk.stratum = nb.stratum and hg % groups = gi)"


def _labelled(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("address "), F.col("o_orderkey")).alias("address"), F.concat(F.lit("Town "), F.col("o_orderpriority")).alias("town"), F.concat(F.lit("c"), F.col("c_nationkey")).alias("country"))


@query(f"with {_GROUPS} select country, town, n, stratum from g")
def strata_groups(s, d):
    return V.groups(_labelled(s, d))


@query(f"with {_PLAN} select stratum, groups, draws::bigint as draws from al")
def sample_allocation(s, d):
    return V.allocation(V.groups(_labelled(s, d)), 100)


@query(f"with {_PLAN}, placed as (select *, row_number() over (partition by country, town order by id) - 1 as off from lab) select distinct placed.id, placed.country, placed.town, plan.stratum from placed join plan using (country, town, off)")
def sample_fetch(s, d):
    lab = _labelled(s, d)
    return V.fetch(V.plan(V.groups(lab), 100), lab).select("id", "country", "town", "stratum")


_EVAL = "e as (select source as stratum, lang as expected_country, case when doc_id % 3 = 0 then upper(lang) || ' ' when doc_id % 11 = 0 then 'xx' else lang end as actual_country, 'Sankt-Town ' || source as expected_town, case when doc_id % 4 = 0 then 'SANKT TOWN.' || source when doc_id % 13 = 0 then '' else 'Sankt-Town ' || source end as actual_town from documents)"


def _evaluated(s, d):
    k = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", F.col("source").alias("stratum"), F.col("lang").alias("expected_country"), F.when(k % 3 == 0, F.concat(F.upper("lang"), F.lit(" "))).when(k % 11 == 0, "xx").otherwise(F.col("lang")).alias("actual_country"), F.concat(F.lit("Sankt-Town "), F.col("source")).alias("expected_town"), F.when(k % 4 == 0, F.concat(F.lit("SANKT TOWN."), F.col("source"))).when(k % 13 == 0, "").otherwise(F.concat(F.lit("Sankt-Town "), F.col("source"))).alias("actual_town"))


_OK = f"upper(trim(expected_country)) = upper(trim(actual_country)) as c, {X.normalize_address_sql('expected_town')} = {X.normalize_address_sql('actual_town')} as t"


@query(f"with {_EVAL}, k as (select stratum, {_OK} from e) select stratum, count(*) as total, count(*) filter (c) as country_correct, count(*) filter (t) as town_correct, count(*) filter (c and t) as both_correct, round(count(*) filter (c) / count(*), 6) as country_rate, round(count(*) filter (t) / count(*), 6) as town_rate, round(count(*) filter (c and t) / count(*), 6) as both_rate from k group by grouping sets ((stratum), ())")
def accuracy_grouping_sets(s, d):
    return V.accuracy(_evaluated(s, d))


@query("select doc_id, source as expected from documents where (doc_id % 3 <> 0 and doc_id % 11 = 0) or (doc_id % 4 <> 0 and doc_id % 13 = 0)")
def mismatch_rows(s, d):
    return V.mismatches(_evaluated(s, d)).select("doc_id", F.col("stratum").alias("expected"))


@query("select c_custkey, printf('%.2f%%', ((c_custkey * 37) % 80001) / 80000.0 * 100) as shown from customer")
def confidence_text(s, d):
    return table(s, d, "customer").select("c_custkey", sinks.percent(F.col("c_custkey") * 37 % 80001 / F.lit(80000.0)).alias("shown"))


# ---------------------------------------------------------------- end to end


def _addresses(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").alias("addr_id"), F.concat_ws("\n", "c_name", F.lower("n_name"), "r_name").alias("text"))


@query()
def resolve_addresses(s, d):
    """Every customer's address against the gazetteer of nations and regions; tests hold it against a plain restatement."""
    got = resolve.resolve(_addresses(s, d), _reference(s, d))
    return got.select("addr_id", "address_line", "country", "town", F.round("country_confidence", 6).alias("country_confidence"), F.round("town_confidence", 6).alias("town_confidence"), "status", "band", "reason")


@query()
def review_rows(s, d):
    got = resolve.resolve(_addresses(s, d), _reference(s, d))
    rows = L.review_rows(L.decide(got))
    return rows.withColumns({k: F.round(k, 6) for k in ("country_confidence", "town_confidence")})


from . import more  # noqa: E402, F401  (registers its queries here)
