"""Queries over listening notes, ledgers, arrangements and decisions. Each takes (spark, sf_dir); ORACLES holds their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import choices as C
from cadenza.functions import keys as K
from cadenza.functions import names as NA
from cadenza.functions import notes as NO
from cadenza.operators import arrangement, lattice, ledger, patches
from cadenza.plans.series import E_, HOUR, _events, r6
from cadenza.session import Workbench
from cadenza.sinks.versions import Versions
from cadenza.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _text(c):
    return c.cast("string")


@query("""
WITH m AS (SELECT event_id, event_id % 6 AS k, user_id, event_type, value, epoch_us(ts) AS t FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'gemini' WHEN 1 THEN 'neel' WHEN 2 THEN 'user-' || user_id ELSE 'neel' END AS author, CASE WHEN k = 3 THEN 'unknown' WHEN k = 4 THEN 'off-beat' ELSE lower(event_type) END AS category,
       CASE WHEN k = 5 THEN 'a b ' || user_id ELSE '' END AS note, CASE WHEN k = 1 THEN 0.0 ELSE round_even(round(value, 4), 3) END AS at_second, CASE k WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE user_id END::INT AS bar,
       CASE WHEN k = 0 THEN floor(t / 1000000)::DOUBLE WHEN k = 1 THEN 5.5 ELSE 0 END AS stamp, CASE WHEN k = 3 THEN 'Unknown' WHEN k = 4 THEN 'Off-beat' ELSE upper(event_type[1:1]) || event_type[2:] END AS said FROM m""")
def marker_normalise(spark, sf_dir):
    """Markers that several tools wrote, each in its own way, in one shape."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 6
    user = _text(F.col("user_id"))
    written = F.struct(
        F.when(k == 0, " Gemini ").when(k == 2, F.concat(F.lit("User: "), user, F.lit("!"))).when(k == 3, "").alias("author"), F.when(k == 3, "  ").when(k == 4, " Off-Beat").when(k != 3, F.upper("event_type")).alias("category"),
        F.when(k == 5, F.concat(F.lit(" a \n  b\t"), user)).alias("note"), F.when(k == 1, "soon").otherwise(_text(F.round("value", 4))).alias("time"), F.when(k == 2, "-7").when(k == 3, None).otherwise(user).alias("bar"),
        F.when(k == 1, "5.5").when(k == 2, "-1").alias("at"), F.when(k == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, "yesterday").alias("ts"), F.lit(None).cast("string").alias("slot"), F.lit(None).cast("string").alias("slot_bars"),
    )
    m = e.select("event_id", NO.marker(written).alias("m"))
    return m.select("event_id", "m.author", "m.category", "m.note", F.col("m.time").alias("at_second"), "m.bar", F.col("m.at").alias("stamp"), NO.category_label(F.col("m.category")).alias("said"))


@query("""
WITH x AS (SELECT event_id, event_id % 5 AS k, value FROM events), i AS (SELECT event_id, k, value, unnest([0, 1]) AS place FROM x WHERE k <> 3)
SELECT event_id, place::INT AS place, CASE k WHEN 1 THEN 0.0 WHEN 2 THEN 85.0 ELSE round_even(least(100, CASE WHEN round(value, 2) < 1 THEN round(value, 2) * 100 ELSE round(value, 2) END), 1) END AS score, CASE place WHEN 0 THEN 'off_beat' ELSE 'artifact' END AS category,
       CASE WHEN place = 1 THEN 0.0 ELSE least(200, round(value, 1)) END AS at_second, (CASE WHEN place = 1 THEN 2 ELSE 1 + event_id % 3 END)::INT AS severity, CASE WHEN place = 0 THEN 'late' ELSE '' END AS note FROM i""")
def json_issues(spark, sf_dir):
    """The issues in a critic's replies, with fences and prose around them, invented categories, severities as text and times past the end."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    score = F.when(k == 1, '"high"').when(k == 2, "0.85").otherwise(_text(F.round("value", 2)))
    first = F.concat(F.lit('{"time_sec": '), _text(F.round("value", 1)), F.lit(', "category": " Off Beat ", "severity": "'), _text(1 + F.col("event_id") % 3), F.lit('", "note": " late "}'))
    body = F.concat(F.lit('{"overall_score": '), score, F.lit(', "verdict": "ok", "issues": ['), first, F.lit(', {"time_sec": "Infinity", "category": "magic", "severity": "much"}]}'))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 3, "no JSON at all").when(k == 4, F.concat(F.lit("Here: "), body, F.lit(" bye"))).otherwise(body)
    c = e.select("event_id", NO.critique(reply, F.lit(200.0)).alias("c"))
    # not posexplode: from it a condition on the size of c.issues would be inferred, which reads every reply a second time
    each = c.select("event_id", F.col("c.overall_score").alias("score"), F.posexplode_outer("c.issues").alias("place", "x")).where("place is not null")
    return each.select("event_id", "place", "score", "x.category", F.col("x.time_sec").alias("at_second"), "x.severity", "x.note")


@query("""
WITH c AS (SELECT l_orderkey AS url, min(l_linenumber) AS place, l_partkey AS p, max(l_tax) AS cs, max(l_discount) AS s FROM lineitem GROUP BY l_orderkey, l_partkey),
     v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY place, p) AS n FROM c), j AS (SELECT *, CASE WHEN s >= 0.08 THEN 'match' WHEN s >= 0.05 THEN 'needs_review' ELSE 'reject' END AS v FROM v WHERE cs >= 0.02),
     f AS (SELECT *, coalesce(max(CASE WHEN v = 'match' THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM j),
     b AS (SELECT url, arg_max(v, [CASE WHEN v = 'match' THEN 1 ELSE 0 END, s, -n]) AS v, arg_max(p, [CASE WHEN v = 'match' THEN 1 ELSE 0 END, s, -n]) AS p, arg_max(s, [CASE WHEN v = 'match' THEN 1 ELSE 0 END, s, -n]) AS s FROM f WHERE m = 0 GROUP BY url),
     r AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN b.v = 'match' THEN 'done' WHEN b.v = 'needs_review' THEN 'needs_review' ELSE 'standalone' END AS status, b.p, b.s FROM orders LEFT JOIN b ON b.url = o_orderkey)
SELECT url, status, CASE WHEN status IN ('done', 'needs_review') THEN p END AS original_url, CASE WHEN status <> 'failed' THEN s END AS score FROM r""")
def ledger_judge(spark, sf_dir):
    """What becomes of each link, by its candidates in the order in which they are tried."""
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 11 == 0, "gone").alias("error"))
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("url"), F.col("l_partkey").alias("original_url")).agg((F.min("l_linenumber") * 10_000_000 + F.first("l_partkey")).alias("place"), F.max("l_tax").alias("candidate_score"), F.max("l_discount").alias("score"))
    verdict = F.when(F.col("score") >= 0.08, "match").when(F.col("score") >= 0.05, "needs_review").otherwise("reject")
    return ledger.judged(links, c.withColumn("verdict", verdict), 0.02)


@query("""
WITH s AS (SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS slug FROM part), t AS (SELECT DISTINCT slug, unnest([1, 2, 4, 5, 9]) AS n FROM s WHERE right(slug, 1) <> '3'),
     k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s), n AS (SELECT slug, unnest(range(1, (SELECT max(k) FROM k) + 10)) AS n FROM (SELECT DISTINCT slug FROM s)),
     f AS (SELECT slug, n, row_number() OVER (PARTITION BY slug ORDER BY n) AS k FROM n ANTI JOIN t USING (slug, n))
SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS free FROM k JOIN f USING (slug, k)""")
def ledger_free_slugs(spark, sf_dir):
    """A name of its own for each part: its brand's, or that with the next free number."""
    new = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-x"))).alias("slug"))
    used = new.where("not slug like '%3'").select(F.explode(F.transform(F.array(*map(F.lit, (1, 2, 4, 5, 9))), lambda n: F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))))).alias("slug")).distinct()
    return ledger.free_slugs(new, used, "slug", "p_partkey").select("p_partkey", F.regexp_replace("free", "-x", "-").alias("free"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND (o_orderkey % 2 = 0 OR o_orderstatus = 'F') THEN 'done' WHEN o_orderkey % 5 = 1 THEN 'standalone' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 5 = 0 AND (o_orderkey % 2 = 0 OR o_orderstatus = 'F') THEN 'accepted by hand' WHEN o_orderkey % 5 = 1 THEN 'rejected by hand' ELSE '' END AS verdict,
       CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'u' || o_orderkey WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderstatus = 'F' THEN 'old' ELSE '' END AS original_url FROM orders""")
def ledger_decide(spark, sf_dir):
    """A ledger after some pairs were accepted and some rejected by hand."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", _text(k).alias("slug"), F.col("o_orderstatus").alias("status"), F.lit("").alias("verdict"), F.when(F.col("o_orderstatus") == "F", "old").otherwise("").alias("original_url"))
    said = o.where("o_orderkey % 5 < 2").select(_text(k).alias("slug"), F.when(k % 5 == 0, "accept").otherwise("reject").alias("decision"), F.when((k % 5 == 0) & (k % 2 == 0), F.concat(F.lit("u"), _text(k))).alias("original_url"))
    return ledger.decided(rows, said).drop("slug")


@query("""
WITH RECURSIVE p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN [16, 8, 32, 16, 8, 32, 16] WHEN 1 THEN [8, 8, 24, 8, 8, 24, 8] ELSE [32, 8, 32, 16, 8, 32, 32] END AS b, 60.0 + c_custkey % 500 AS s, 240.0 / (120 + c_custkey % 9) AS bar FROM customer),
     w AS (SELECT *, list_sum([b[1], b[3], b[4], b[6], b[7]]) AS flex, greatest(16 + 40, round_even(s / bar / 8, 0)::INT * 8) AS want FROM p),
     z AS (SELECT c_custkey, want, 0 AS n, list_transform(range(1, 8), lambda i: CASE WHEN i IN (2, 5) THEN b[i] ELSE greatest(8, round_even(b[i] * (greatest(want - 16, 40) / flex) / 8, 0)::INT * 8) END) AS b FROM w),
     r AS (SELECT * FROM z UNION ALL SELECT c_custkey, want, n + 1, list_transform(range(1, 8), lambda i: b[i] + CASE WHEN i = list_position(list_transform(range(1, 8), lambda j: CASE WHEN j IN (2, 5) THEN 0 ELSE b[j] END), list_max(list_transform(range(1, 8), lambda j: CASE WHEN j IN (2, 5) THEN 0 ELSE b[j] END)))
            THEN CASE WHEN list_sum(b) < want THEN 8 WHEN list_sum(b) > want AND list_max(list_transform(range(1, 8), lambda j: CASE WHEN j IN (2, 5) THEN 0 ELSE b[j] END)) > 8 THEN -8 ELSE 0 END ELSE 0 END) FROM r WHERE n < 64 AND list_sum(b) <> want),
     l AS (SELECT c_custkey, arg_max(b, n) AS b FROM r GROUP BY c_custkey), e AS (SELECT c_custkey, b, unnest(range(1, 8)) AS i FROM l)
SELECT c_custkey, (i - 1)::INT AS slot, ['intro', 'build', 'drop', 'breakdown', 'build', 'drop', 'outro'][i] AS kind, b[i]::INT AS bars, coalesce(list_sum(b[1:i - 1]), 0)::INT AS start_bar, CASE WHEN i IN (5, 6) THEN 1 ELSE 0 END::INT AS nth FROM e""")
def arrangement_layout(spark, sf_dir):
    """The slots of forms that are scaled to a length, in whole phrases."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    parts = arrangement.form(F.when(k % 3 == 0, "club").when(k % 3 == 1, "radio").otherwise("tool"))
    rows = c.select("c_custkey", parts.alias("form"), (60.0 + k % 500).alias("seconds"), (240.0 / (120 + k % 9)).alias("bar"))
    plans = rows.select("c_custkey", arrangement.for_length(F.col("form"), F.col("seconds"), F.col("bar")).alias("parts"))
    return arrangement.laid_out(plans).select("c_custkey", "slot", "kind", "bars", F.col("start_bar").cast("int").alias("start_bar"), F.col("nth").cast("int").alias("nth"))


_SECTIONS = """s AS (SELECT l_orderkey AS track, ((l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey) * 100 + l_quantity::BIGINT AS o, l_linenumber * 10.0::DOUBLE AS a, l_linenumber * 10.0::DOUBLE + l_quantity AS b, CASE l_returnflag WHEN 'R' THEN 'hook' WHEN 'A' THEN 'verse' ELSE 'section' END AS label, round(l_discount * 10, 6) AS energy, l_suppkey % 3 AS g FROM lineitem)"""


def _sections(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), (((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("o"), (F.col("l_linenumber") * 10.0).alias("start"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias("end"),
        F.when(flag == "R", "hook").when(flag == "A", "verse").otherwise("section").alias("label"), F.round(F.col("l_discount") * 10, 6).alias("energy"), (F.col("l_suppkey") % 3).alias("g"),
    )


@query(f"""
WITH {_SECTIONS}, d AS (SELECT track, 'drop' AS want, o, a, row_number() OVER (PARTITION BY track ORDER BY label <> 'hook', -energy * least(b - a, 40), o, a, b, label) AS k FROM s
     UNION ALL SELECT track, 'breakdown', o, a, row_number() OVER (PARTITION BY track ORDER BY label NOT IN ('verse', 'breakdown', 'intro'), energy, o, a, b, label) FROM s UNION ALL SELECT track, 'intro', o, a, row_number() OVER (PARTITION BY track ORDER BY energy, o, a, b, label) FROM s)
SELECT track, want, o, a AS start FROM d WHERE k = 1""")
def section_pick(spark, sf_dir):
    """For each track the section that feeds drops, breakdowns and intros."""
    return arrangement.picked(_sections(spark, sf_dir), "track", "o").select("track", "want", "o", "start")


@query(f"""
WITH {_SECTIONS}, g AS (SELECT track, g, avg(energy) * (1 + 0.35 * (count(*) - 1)) AS score, min(o) AS f FROM s GROUP BY track, g), p AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(score, 9) DESC, f) AS place FROM g),
     x AS (SELECT s.*, place, row_number() OVER (PARTITION BY track ORDER BY o) AS k, count(*) OVER (PARTITION BY track) AS n FROM s JOIN p USING (track, g))
SELECT track, o, CASE WHEN place = 1 THEN 'hook' WHEN k = n AND n > 1 AND energy < 0.7 THEN 'outro' WHEN k = 1 AND energy < 0.7 THEN 'intro' WHEN place = 2 THEN 'verse' WHEN energy < 0.45 THEN 'breakdown' ELSE 'section' END AS label FROM x""")
def section_labels(spark, sf_dir):
    """What each section of a track is, by the energy of its group and its place."""
    return arrangement.labelled(_sections(spark, sf_dir).drop("label"), "track", "o", "g", "energy").select("track", "o", "label")


@query("""
WITH m AS (SELECT l_suppkey, avg(l_discount) * 10 AS s, avg(l_tax) * 12 AS t, (60.0 + l_suppkey % 100)::DOUBLE AS bpm, avg(l_quantity) / 10 AS p, avg(l_linenumber) / 2 AS r, avg(l_discount) * 8 AS d, avg(l_tax) * 10 AS e, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN t - least(1, 0.06 / (60 / bpm / 6)) - (s - least(1, 0.06 / (60 / bpm / 4))) >= 0.06 THEN 'triplet' ELSE 'straight' END AS lattice, CASE WHEN r / (60 / bpm) <= 2 OR r / p <= 0.65 THEN 'chopped' ELSE 'continuous' END AS treatment,
       round_even(r / p, 3) AS phrase_ratio, round_even(least(1.5, e / d), 3) AS vocal_kept, CASE WHEN n >= 3 AND bpm BETWEEN 100 AND 150 THEN bpm END AS learned,
       CASE WHEN d >= 0.05 AND s >= 0.62 AND t >= 0.65 THEN 'chop' ELSE 'flow' END AS vocal, CASE WHEN -50 + 10 * p < -45 THEN 'none' WHEN p * 3 >= 4 AND s >= 0.35 OR p * 3 >= 10 AND t >= 0.55 THEN 'sub' ELSE 'source' END AS bass FROM m""")
def treatment_choices(spark, sf_dir):
    """What a remix did with a voice, and what is to be done with bass and vocals, from measurements."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") * 10).alias("s"), (F.avg("l_tax") * 12).alias("t"), (F.avg("l_quantity") / 10).alias("p"), (F.avg("l_linenumber") / 2).alias("r"), (F.avg("l_discount") * 8).alias("d"), (F.avg("l_tax") * 10).alias("e"), F.count("*").alias("n"))
    m = m.withColumn("bpm", 60.0 + F.col("l_suppkey") % 100)
    c = F.col
    rows = m.select("*", C.treatment_of(c("p"), c("r"), c("d"), c("e"), c("bpm")).alias("x"))
    return rows.select("l_suppkey", C.lattice_of(c("s"), c("t"), c("bpm")).alias("lattice"), "x.treatment", "x.phrase_ratio", "x.vocal_kept", C.learned_bpm(c("n"), c("bpm")).alias("learned"), C.vocal_mode(c("d"), c("s"), c("t")).alias("vocal"), C.bass_mode(-50 + 10 * c("p"), c("p") * 3, c("s"), c("t")).alias("bass"))


@query(r"""
WITH n AS (SELECT p_partkey, p_partkey % 4 AS k, p_name, p_brand FROM part)
SELECT p_partkey, replace(p_name, '#', ' ') || ' ' || lower(substr(p_brand, 1, 5)) AS title, CASE k WHEN 0 THEN '.mp3' WHEN 1 THEN NULL ELSE '.wav' END AS extension, CASE k WHEN 0 THEN lower(substr(p_brand, 1, 5)) || '-1' WHEN 1 THEN NULL WHEN 2 THEN lower(substr(p_brand, 1, 5)) END AS kit,
       CASE k WHEN 0 THEN 'rekordbox,csv' WHEN 1 THEN 'rekordbox,serato,csv,tags' WHEN 2 THEN 'csv,tags' END AS formats, CASE WHEN k = 3 THEN '00000000' || lpad(p_partkey::VARCHAR, 8, '0') END AS id FROM n""")
def name_rules(spark, sf_dir):
    """Titles, extensions, kit names, formats and ids that are taken as they are, changed, or refused (null)."""
    k, brand = F.col("p_partkey") % 4, F.lower(F.substring("p_brand", 1, 5))
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/in/"), F.replace("p_name", F.lit("#"), F.lit("_")), F.lit("-"), brand, F.when(k == 0, ".MP3").when(k == 1, ".exe").otherwise(".wav"))
    kit = F.when(k == 0, F.concat(F.lit(" "), F.upper(brand), F.lit("-1 "))).when(k == 1, "../x").when(k == 2, brand).otherwise("Default")
    wanted = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("rekordbox"), F.lit("All"))).when(k == 2, F.array(F.lit(" csv ,tags"), F.lit("CSV"))).otherwise(F.array(F.lit("csv"), F.lit("ogg")))
    own = F.when(k == 3, F.concat(F.lit("00000000"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).when(k == 2, "XYZ")
    return p.select("p_partkey", NA.row_title(path).alias("title"), NA.upload_extension(path).alias("extension"), NA.kit_name(kit).alias("kit"), F.array_join(NA.formats(wanted), ",").alias("formats"), NA.own_id(own).alias("id"))


@query(f"""
WITH {E_}, f AS (SELECT user_id, (t % 3600000000) * 480 // 3600000000 AS p, sum(value) AS w FROM e GROUP BY ALL), o AS (SELECT unnest(list_concat(range(-120, 121, 2), [240])) AS o),
     s AS (SELECT user_id, o, sum(w * greatest(0, 1 - least((p - o + 960) % 480, 480 - (p - o + 960) % 480) / 8)) AS s FROM f, o GROUP BY ALL),
     b AS (SELECT user_id, arg_max(o, round(s, 9) * 1000 - o / 1000.0) FILTER (WHERE o <= 120) AS o, max(round(s, 9)) FILTER (WHERE o <= 120) AS s, avg(s) FILTER (WHERE o <= 120) AS m, greatest(max(s) FILTER (WHERE o = 0), 1e-9) AS g, max(s) FILTER (WHERE o = 240) AS h FROM s GROUP BY user_id)
SELECT user_id, round(o / 480, 6) AS "offset", round((s - m) / greatest(s, 1e-9), 6) AS sharpness, round(h / g, 6) AS half_ratio, CASE WHEN h / g > 1.35 THEN 'half-beat' WHEN abs(o / 480) < 0.1 THEN 'grid' ELSE 'offset' END AS alignment FROM b""")
def layer_comb(spark, sf_dir):
    """Where a comb of hours fits a user's events best, how sharply, and whether the half hour is stronger."""
    return r6(lattice.comb(_events(spark, sf_dir), ["user_id"], "t", "value", HOUR))


@query(f"""
WITH {E_}, r AS (SELECT user_id, t // 57600000000 AS b, value AS w, (t % 3600000000) / 3600000000 AS f FROM e), z AS (SELECT user_id, sum(w * sin(4 * pi() * f)) AS y, sum(w * cos(4 * pi() * f)) AS x, sum(w) AS s, count(*) AS n FROM r GROUP BY user_id),
     l AS (SELECT user_id, n, CASE WHEN n >= 8 AND sqrt(x * x + y * y) > 0.08 * s THEN atan2(y, x) / (4 * pi()) ELSE 0 END AS lag FROM z), q AS (SELECT r.*, lag, n, round_even((f - lag + 1 - floor(f - lag + 1)) * 12, 0)::INT % 12 AS p FROM r JOIN l USING (user_id)),
     w AS (SELECT user_id, b, sum(CASE WHEN p IN (4, 8) THEN w ELSE 0 END) AS t, sum(CASE WHEN p IN (3, 9) THEN w ELSE 0 END) AS u, count(*) FILTER (WHERE p IN (3, 4, 8, 9)) AS c, any_value(lag) AS lag, count(*) AS n FROM q GROUP BY ALL),
     g AS (SELECT user_id, sum(n)::BIGINT AS onsets, any_value(lag) AS lag, sum(t) AS t, sum(u) AS u, avg(CASE WHEN c >= 6 THEN CASE WHEN t > u THEN 1.0 ELSE 0.0 END END) AS v FROM w GROUP BY user_id),
     e4 AS (SELECT user_id, value AS w, least(t % 900000000, 900000000 - t % 900000000) AS d4, least(t % 600000000, 600000000 - t % 600000000) AS d6 FROM e),
     h AS (SELECT user_id, sum(CASE WHEN d4 <= 60000000 THEN w ELSE 0 END) / greatest(sum(w), 1e-12) AS a, sum(CASE WHEN d6 <= 60000000 THEN w ELSE 0 END) / greatest(sum(w), 1e-12) AS c, coalesce(median(CASE WHEN d4 > 60000000 THEN d4 END), 0) AS m FROM e4 GROUP BY user_id)
SELECT user_id, onsets, round(lag, 6) AS lag, round(CASE WHEN onsets >= 8 AND t + u > 0 THEN t / (t + u) ELSE 0.5 END, 6) AS triplet_share, round(CASE WHEN onsets >= 8 AND t + u > 0 THEN coalesce(v, 0) ELSE 0 END, 6) AS triplet_windows,
       round(a, 6) AS straight, round(c, 6) AS triplet, round(c - a, 6) AS advantage, round(m, 6) AS scatter FROM g JOIN h USING (user_id)""")
def vocal_lattice(spark, sf_dir):
    """Whether events sit on a straight or a triplet lattice: shares within a minute, and the evidence of the places between beats."""
    e = _events(spark, sf_dir)
    a = lattice.triplet_evidence(e, ["user_id"], "t", "value", HOUR)
    return r6(a.join(lattice.lattice_shares(e, ["user_id"], "t", "value", HOUR, 60_000_000), "user_id"))


@query("""
WITH c AS (SELECT label, vec_id, list_transform(embedding[1:12], lambda x: abs(x::DOUBLE)) AS c FROM embeddings), t AS (SELECT unnest(range(24)) AS k), n AS (SELECT label, vec_id, c, list_sum(c) AS total FROM c),
     s AS (SELECT label, vec_id, k, round((c[k % 12 + 1] + c[(k % 12 + CASE WHEN k < 12 THEN 4 ELSE 3 END) % 12 + 1] + c[(k % 12 + 7) % 12 + 1]) / 3 / total, 9) AS s FROM n, t),
     r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS p FROM s), m AS (SELECT label, vec_id, max(CASE WHEN p = 1 THEN k END) AS k, max(CASE WHEN p = 1 THEN s END) AS a, max(CASE WHEN p = 2 THEN s END) AS b FROM r WHERE p <= 2 GROUP BY label, vec_id),
     f AS (SELECT *, (a - b) / greatest(a, 1e-9) AS margin, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM m),
     g AS (SELECT label, vec_id, margin, last_value(CASE WHEN margin >= 0.04 OR n = 1 THEN k END IGNORE NULLS) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT label, vec_id, (k % 12)::INT AS root, k >= 12 AS minor, round(margin, 6) AS margin FROM g""")
def chords_per_bar(spark, sf_dir):
    """The triad of each bar (a vector's first 12 values as pitch classes); an ambiguous bar takes the one before it."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("c"))
    line = Window.partitionBy("label").orderBy("vec_id")
    t = v.select("label", "vec_id", K.triad(F.col("c")).alias("t")).withColumn("n", F.row_number().over(line))
    own = F.when((F.col("t.margin") >= 0.04) | (F.col("n") == 1), F.struct(F.col("t.root").alias("root"), F.col("t.minor").alias("minor")))
    kept = t.withColumn("own", F.last(own, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return r6(kept.select("label", "vec_id", "own.root", "own.minor", F.col("t.margin").alias("margin")))


@query()
def layer_report(spark, sf_dir):
    """Every measure of a user's events against a grid of hours: phase, comb, bar phase, and what is wrong."""
    return r6(lattice.layer_report(_events(spark, sf_dir), "user_id", "t", "value", "event_id", HOUR, 4, 60_000_000, (120_000.0, 300_000.0, 0.2)))


@query(f"""
WITH {E_}, d AS (SELECT user_id, t, value AS w, least(t % 3600000000, 3600000000 - t % 3600000000) AS d1, least(t % 1800000000, 1800000000 - t % 1800000000) AS d2 FROM e)
SELECT user_id, count(*) AS hits, round(count(*) / greatest((max(t) - min(t)) / 14400000000.0, 1e-9), 6) AS per_bar, round(sum(CASE WHEN d1 <= 300000000 THEN w ELSE 0 END) / greatest(sum(w), 1e-12), 6) AS on_beat,
       round(sum(CASE WHEN d2 > 300000000 THEN w ELSE 0 END) / greatest(sum(w), 1e-12), 6) AS off_eighth FROM d GROUP BY user_id""")
def kick_collision(spark, sf_dir):
    """How much of a user's events fall on the hour, and off the half hours."""
    return r6(lattice.kick_collision(_events(spark, sf_dir), ["user_id"], "t", "value", HOUR, 300_000_000))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, value, event_id % 3 AS b, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, arg_max(event_id, b) AS event_id, arg_max(event_type, b) AS event_type, arg_max(value, b) AS value, (min(b) + 1)::BIGINT AS added, (max(b) + 1)::BIGINT AS updated FROM e WHERE k = 1 GROUP BY user_id""")
def ledger_versions(spark, sf_dir):
    """A versioned ledger of users' last events, put in three batches: what its third version holds."""
    bench = Workbench(spark)
    ledger_ = Versions(spark, bench.path("ledger"))
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    for b in range(3):
        ledger_.put(e.where(F.col("event_id") % 3 == b), "user_id", ["ts", "event_id"], ("events", b))
    out = bench.put(ledger_.read().drop("ts"), keep=True)
    bench.clear()
    return out


_PATCH = """
WITH p AS (SELECT l_orderkey, 20.0 + l_orderkey % 3 * 20 AS duration, 1 + l_orderkey % 2 AS grain FROM lineitem GROUP BY l_orderkey),
     i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k, l_linenumber % 3 + 1 + CASE WHEN l_partkey % 5 = 0 THEN 10 ELSE 0 END AS slot, CASE l_suppkey % 4 WHEN 0 THEN 'drop_var' WHEN 1 THEN 'intro' WHEN 2 THEN 'polka' END AS pattern, l_quantity / 25 AS gain, l_extendedprice % 80 AS start, CASE WHEN l_partkey % 7 > 0 THEN l_returnflag || repeat('x', (l_partkey % 40)::INT) ELSE '' END AS label FROM lineitem),
     v AS (SELECT i.*, CASE WHEN pattern IN ('drop_var', 'intro') THEN pattern END AS p, CASE WHEN gain <= 1 THEN gain END AS g, CASE WHEN start < duration AND round_even(start / (2 * grain), 0) * 2 * grain < duration THEN round_even(start / (2 * grain), 0) * 2 * grain END AS s, CASE WHEN label <> '' THEN label[1:32] END AS l FROM i JOIN p USING (l_orderkey)),
     a AS (SELECT l_orderkey, slot, arg_max(p, k) FILTER (WHERE p IS NOT NULL) AS p, arg_max(g, k) FILTER (WHERE g IS NOT NULL) AS g, arg_max(s, k) FILTER (WHERE s IS NOT NULL) AS s, arg_max(l, k) FILTER (WHERE l IS NOT NULL) AS l, count(p) + count(g) + count(s) + count(l) AS taken, count(pattern) + 3 * count(*) - count(p) - count(g) - count(s) - count(l) AS refused FROM v GROUP BY l_orderkey, slot)"""


@query(f"""{_PATCH}
SELECT lineitem.l_orderkey, l_linenumber AS slot, coalesce(p, 'drop') AS drum_pattern, coalesce(g, l_discount) AS source_gain, coalesce(s, 0.0) AS source_start, coalesce(l, l_linestatus) AS source_label, coalesce(taken, 0) AS taken, coalesce(refused, 0) AS refused FROM lineitem LEFT JOIN a ON a.l_orderkey = lineitem.l_orderkey AND a.slot = l_linenumber""")
def plan_patches(spark, sf_dir):
    """Orders as plans with lines as slots, after a reply for each order with an instruction by line: some for slots that aren't there, some with fields that are refused."""
    li = table(spark, sf_dir, "lineitem")
    pattern = F.when(F.col("l_suppkey") % 4 == 0, "drop_var").when(F.col("l_suppkey") % 4 == 1, "intro").when(F.col("l_suppkey") % 4 == 2, "polka")
    label = F.when(F.col("l_partkey") % 7 > 0, F.concat("l_returnflag", F.expr("repeat('x', int(l_partkey % 40))"))).otherwise("")
    index = F.col("l_linenumber") % 3 + 1 + F.when(F.col("l_partkey") % 5 == 0, 10).otherwise(0)
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.struct(index.alias("index"), pattern.alias("drum_pattern"), (F.col("l_quantity") / 25).alias("source_gain"), (F.col("l_extendedprice") % 80).alias("source_start"), label.alias("source_label")).alias("item"))
    items = F.sort_array(F.collect_list(item))["item"]
    replies = li.groupBy("l_orderkey").agg(F.concat(F.lit("Here you are: "), F.to_json(F.struct(F.lit("note").alias("note"), items.alias("slots"))), F.lit(" Enjoy.")).alias("reply"))
    plans = li.select("l_orderkey").distinct().select("l_orderkey", (20.0 + F.col("l_orderkey") % 3 * 20).alias("duration"), F.lit(2.0).alias("bar"), (1 + F.col("l_orderkey") % 2).alias("grain"))
    slots = li.select("l_orderkey", F.col("l_linenumber").alias("slot"), F.lit("drop").alias("drum_pattern"), F.col("l_discount").alias("source_gain"), F.lit(0.0).alias("source_start"), F.col("l_linestatus").alias("source_label"))
    return patches.patched(slots, patches.instructions(replies, slots, plans, "l_orderkey"), "l_orderkey")
